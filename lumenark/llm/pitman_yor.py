"""Language-model scores by a hierarchical Pitman-Yor model of three words.

Restaurants: one for each two words before a token, whose parent is that of the later word alone, whose parent is the root, whose
base is uniform over the vocabulary and one unseen word. All words of the training texts are dishes and
contexts; nothing is pooled. A word that is too common for one task (over SHARD tokens) has several restaurants of its own level, one for
each bucket of the word before it, each with that many tokens.

Tokens are dealt to shards by the later word, so a shard holds whole restaurants of both levels. There seating is sampled by Gibbs
sweeps: in each as many customers of a dish get up as it has, one after another, drawn by lot; a table closes
if it was the last, which takes a customer from the parent, and it sits down again, at a table in proportion to its
customers less the discount, or at a new one in proportion to (strength + discount * tables) * parent's prediction, which
sends a customer to the parent. (A dish's only customer would come back to the table it left, so it stays; its parent's customers have sweeps of their own.)
Dishes move side by side, against the totals of the step before, as in distributed samplers; the few that have most
customers move on alone. Shards meet in the root: a first pass over them, whose base is their own word counts, gives the root's
customers; the root is seated by word; its predictions are the base of a second pass, whose sweeps after the first BURN_IN
are averaged into the predictions that texts are scored by. In that pass, too, the root is seated anew after each sweep: a shard
puts its own customers of the moment in place of those it sent, while those of others stay as they were sent.

Texts travel as compact arrays: for each chunk of some texts and shard one row of bytes.
"""

from __future__ import annotations

import heapq
import math
import random
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import prepare, release, spool, whole_text

#: Tokens of a shard, about, and of a chunk of texts, at least (but the last).
SHARD, CHUNK = 1 << 20, 1 << 21
#: By level (root, one word, two words).
DISCOUNT, STRENGTH = (0.6, 0.85, 0.85), (10.0, 1.0, 0.2)
FIRST_SWEEPS, SWEEPS, BURN_IN, ROOT_SWEEPS, SEED = 1, 4, 1, 3, 5
#: Documents to learn from: all but those whose crc32(doc_id as text) mod FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 7, 2
END = np.uint64(xxhash.xxh64_intdigest(b""))  # the token after a text's last word
START = np.uint64(0x9E3779B97F4A7C15)  # before its first
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz     ")
#: Of each task the commonest words are looked at to find those that need several restaurants.
COMMONEST, SLICE = 4096, 1 << 16
ZSTD = pa.Codec("zstd", 1)
#: Dishes for which arrays don't pay, at most.
SINGLE = 16
#: Dishes that move side by side, at least.
FEW = 48
#: Lots that customers who look for a table draw at a time, about, but one to 16 each.
LOTS = 2048


def _texts(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    held = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    return docs.select(doc_id.alias("doc_id"), held.alias("held_out"), whole_text().alias("text"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


# --- hashes of words -----------------------------------------------------------------------------------

#: Bytes hashed at a time.
BLOCK = 1 << 16
#: A word's hash mixes the sum of its bytes' values times the powers of an odd number.
VALUES = np.random.default_rng(SEED).integers(1 << 64, size=256, dtype=np.uint64)
VALUES[ord(" ")] = 0


def _powers(of: int) -> np.ndarray:
    factors = np.full(BLOCK + 1, of, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


POWERS, INVERSES = _powers(0x9E3779B97F4A7C15), _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _block(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of at most BLOCK bytes start, and their hashes."""
    x = np.frombuffer(plain, np.uint8)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(VALUES[x] * POWERS[: len(x)], out=sums[1:])
    word = np.zeros(len(x) + 2, bool)
    np.not_equal(x, ord(" "), out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    return starts, _mixed(_mixed((sums[ends] - sums[starts]) * INVERSES[starts]))


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, one after another, and how many each text has. Words over BLOCK bytes are hashed by themselves."""
    plain = b" ".join(texts).translate(PLAIN) + b" "
    starts, hashes, at = [], [], 0
    while at < len(plain):
        end = plain.rfind(b" ", at, at + BLOCK) + 1
        if end:
            own, found = _block(plain[at:end])
        else:
            end = plain.index(b" ", at) + 1
            own, found = np.zeros(1, np.int64), np.array([xxhash.xxh64_intdigest(plain[at : end - 1])], np.uint64)
        starts.append(own + at)
        hashes.append(found)
        at = end
    words = np.searchsorted(np.concatenate(starts), np.cumsum([len(t) + 1 for t in texts]))
    sizes = np.diff(words, prepend=0)
    tokens = np.full(len(texts) + words[-1], END)
    tokens[np.arange(words[-1]) + np.repeat(np.arange(len(texts)), sizes)] = np.concatenate(hashes)
    return tokens, sizes + 1


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows, the hashes of their tokens, and how many each text has."""
    for batch in batches:
        texts, at = batch.column("text").cast(pa.binary()).to_pylist(), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < min(CHUNK, 16 * BLOCK):
                size, end = size + len(texts[end]), end + 1
            yield batch.slice(at, end - at), *_hashed(texts[at:end])
            at = end


# --- dealing tokens ------------------------------------------------------------------------------------


def _commonest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The commonest contexts of a task (hash, count), and under key 0 how many tokens it has. Of a word one occurrence in each slice of SLICE
    tokens, at least, which most words have no more of, is not counted but added for all slices: no count is too small."""
    words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = texts = slices = size = waiting = 0
    held: list[np.ndarray] = []
    seen: list[tuple[np.ndarray, np.ndarray]] = []

    def count(last: bool) -> None:
        nonlocal held, seen, size, slices, waiting, words, counts
        if held:
            own, n = np.unique(np.concatenate(held), return_counts=True)
            seen.append((own[n > 1], n[n > 1] - 1))
            held, size, slices, waiting = [], 0, slices + 1, waiting + int((n > 1).sum())
        if last or waiting > 20 * COMMONEST:
            words, at = np.unique(np.concatenate([words, *(w for w, _ in seen)]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, *(n for _, n in seen)]), len(words)).astype(np.int64)
            seen, waiting, most = [], 0, COMMONEST if last else 20 * COMMONEST
            if len(words) > most:
                kept = np.argpartition(counts, -most)[-most:]
                words, counts = words[kept], counts[kept]

    for _, tokens, sizes in _groups(batches):
        held.append(tokens[tokens != END])
        total, texts, size = total + len(tokens), texts + len(sizes), size + len(tokens)
        if size >= SLICE:
            count(False)
    count(True)
    keys = np.concatenate([words, np.array([START, 0], np.uint64)]).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate([counts + slices, [texts, total]]))], ["key", "n"])


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, of each all first bytes, then all second ones and so on, compressed."""
    data = b"".join(struct.pack("<cI", a.dtype.char.encode(), len(a)) + np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1 if len(a) else 1).T).tobytes() for a in arrays)
    return struct.pack("<Q", len(data)) + ZSTD.compress(data, asbytes=True)


def _unpacked(packed: bytes | pa.Buffer) -> list[np.ndarray]:
    packed = pa.py_buffer(packed)
    (size,) = struct.unpack_from("<Q", packed)
    data, out, at = ZSTD.decompress(packed.slice(8), size), [], 0
    while at < size:
        kind, n = struct.unpack_from("<cI", data, at)
        dtype = np.dtype(kind.decode())
        planes = np.frombuffer(data, np.uint8, n * dtype.itemsize, at + 5)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += 5 + planes.nbytes
    return out


def _short(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _homes(common: list[tuple[int, int]], total: int, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of common words (hash, tokens): sorted hashes, in how many buckets each is, and by word and bucket its shard. The largest go first, each
    to the shard that has least; other words fill the shards up alike, by their hashes, of which the last array has each shard's first after the first shard's."""
    common = sorted(common)
    buckets = [1 << max(0, math.ceil(math.log2(n / SHARD))) for _, n in common]
    parts = sorted(((n / b, i) for i, ((_, n), b) in enumerate(zip(common, buckets)) for _ in range(b)), reverse=True)
    loads, homes = [(0.0, s) for s in range(shards)], [[] for _ in common]
    for n, i in parts:
        load, s = loads[0]
        homes[i].append(s)
        heapq.heapreplace(loads, (load + n, s))
    held = np.array([load for load, _ in sorted(loads, key=lambda x: x[1])])
    steps, left = np.sort(held), max(1.0, total - held.sum())
    levels = (np.cumsum(steps) + left) / np.arange(1, shards + 1)  # if the lowest so many are filled up
    room = np.maximum(levels[np.flatnonzero(levels > steps)[-1]] - held, 0)
    bounds = (np.cumsum(room)[:-1] / room.sum() * 2.0**32).astype(np.uint64)
    return np.array([k for k, _ in common], np.uint64), np.array(buckets, np.uint64), np.array([s for own in homes for s in own], np.int64), bounds


def _deal(shards: int, hot: np.ndarray, buckets: np.ndarray, homes: np.ndarray, bounds: np.ndarray):
    """Rows (shard, chunk, kind, data): for a chunk of texts its tokens by shard (kind 0), and its list of texts (kind 1).

    hot, buckets, homes, bounds: see _homes.
    """
    first_home = np.cumsum(buckets) - buckets
    low = np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24

        def out(ids: list, held: list, hashes: list[np.ndarray], sizes: np.ndarray) -> pa.RecordBatch:
            w = np.concatenate(hashes)
            v, u = np.roll(w, 1), np.roll(w, 2)
            first = np.cumsum(sizes) - sizes
            v[first] = START
            u[first] = START
            u[(first + 1)[sizes > 1]] = START
            text = np.repeat((np.arange(len(sizes)) * 2 + np.array(held, np.int64)).astype(np.int32), sizes)
            context, shard = v, np.searchsorted(bounds, _mixed(v) >> low, side="right")
            if len(hot):
                at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
                common = np.flatnonzero(hot[at] == v)
                at = at[common]
                bucket = _mixed(u[common]) & (buckets[at] - np.uint64(1))
                shard[common] = homes[first_home[at] + bucket]
                cut = buckets[at] > 1
                context = v.copy()
                context[common[cut]] = _mixed(v[common[cut]] + np.uint64(1) + bucket[cut])
            shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.uint32)
            order = np.argsort(shard, kind="stable").astype(np.int32)
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            # Of contexts, which are told apart in their shard only, and of u, which is in its context, 32 bits go along.
            context, u = (context >> low).astype(np.uint32), (u >> low).astype(np.uint32)
            del v, shard
            rows = [(number % shards, 1, _packed(np.array([i is None for i in ids], bool), np.array([i or 0 for i in ids], np.int64), np.array(held, bool), sizes))]
            for s in np.flatnonzero(np.diff(ends)).tolist():
                own = order[ends[s] : ends[s + 1]]
                place = np.sort((context[own].astype(np.uint64) << low) + np.arange(len(own), dtype=np.uint64))  # texts in order compress better
                own = own[place.astype(np.uint32)]
                of = (place >> low).astype(np.uint32)
                starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                names, at = np.unique(w[own], return_inverse=True)
                rows.append((s, 0, _packed(names, u[own], _short(at), of[starts], _short(np.diff(starts, append=len(own))), _short(text[own]))))
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["shard", "chunk", "kind", "data"])

        ids, held, hashes, counts, size = [], [], [], [], 0
        for rows, tokens, sizes in _groups(batches):
            ids += rows.column("doc_id").to_pylist()
            held += rows.column("held_out").to_pylist()
            hashes.append(tokens)
            counts.append(sizes)
            size += len(tokens)
            if size >= CHUNK:
                yield out(ids, held, hashes, np.concatenate(counts))
                ids, held, hashes, counts, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield out(ids, held, hashes, np.concatenate(counts))

    return run


DEALT = "shard int, chunk long, kind int, data binary"


# --- seating -----------------------------------------------------------------------------------------


class Level:
    """Tables of the dishes of many restaurants. At first the customers of a dish sit at one table."""

    def __init__(self, customers: np.ndarray, room: np.ndarray, context: np.ndarray, contexts: int, discount: float, strength: float, rng: np.random.Generator):
        """By dish: its customers, as many as it can ever have, and its restaurant."""
        self.rng, self.discount, self.strength, self.context, self.room = rng, discount, strength, context, room.astype(np.int32)
        self.first = (np.cumsum(room) - room).astype(np.int32)
        self.customers, self.tables = customers.astype(np.int32), (customers > 0).astype(np.int32)
        seats = int(room.sum())
        self.seat = np.repeat(self.first, room)  # of each customer its table, a slot of its dish
        self.size = np.zeros(seats, np.int32)
        self.size[self.first[customers > 0]] = customers[customers > 0]
        self.free = np.arange(seats, dtype=np.int32)  # by dish a stack of room - tables slots that are free
        self.free += np.repeat(self.tables, room)
        self.all_tables = np.bincount(context, self.tables, contexts)
        self.all_customers = np.bincount(context, self.customers, contexts)

    def come(self, dishes: np.ndarray, customers: float) -> None:
        """The totals of restaurants, when as many customers came to each dish; who gets up and sits down again changes none."""
        np.add.at(self.all_customers, self.context[dishes], float(customers))

    def remove(self, dishes: np.ndarray) -> np.ndarray:
        """A customer of each of different dishes gets up; whether its table closes."""
        if len(dishes) <= SINGLE:
            return np.array([self.remove_one(dish) for dish in dishes.tolist()], bool)
        first, n = self.first[dishes], self.customers[dishes]
        place = first + (self.rng.random(len(dishes)) * n).astype(np.int32)
        table = self.seat[place]
        self.seat[place] = self.seat[first + n - 1]
        size = self.size[table] - 1
        self.size[table] = size
        self.customers[dishes] = n - 1
        closed = size == 0
        gone = dishes[closed]
        tables = self.tables[gone]
        self.free[first[closed] + self.room[gone] - tables] = table[closed]
        self.tables[gone] = tables - 1
        np.add.at(self.all_tables, self.context[gone], -1.0)
        return closed

    def add(self, dishes: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """A customer sits down at each of different dishes, of which parent holds the parent's prediction; whether at a new table."""
        if len(dishes) <= SINGLE:
            return np.array([self.add_one(dish, p) for dish, p in zip(dishes.tolist(), parent.tolist())], bool)
        first, n, tables, of = self.first[dishes], self.customers[dishes], self.tables[dishes], self.context[dishes]
        new = (self.strength + self.discount * self.all_tables[of]) * parent
        opened = (n == 0) | (self.rng.random(len(dishes)) * (new + n - self.discount * tables) < new)
        table = self.seat[first]  # of dishes with one table
        came = np.flatnonzero(opened)
        taken, count = dishes[came], tables[came]
        table[came] = self.free[first[came] + self.room[taken] - count - 1]
        left = np.flatnonzero(~opened & (tables > 1))
        while len(left):  # a table in proportion to its customers, taken with (customers - discount) / customers; the first taken of some
            lots = self.rng.random((2, len(left), min(16, LOTS // len(left) + 1)))
            found = self.seat[first[left, None] + (lots[0] * n[left, None]).astype(np.int32)]
            size = self.size[found]
            fits = (lots[1] * size < size - self.discount) | (tables[left] == n[left])[:, None]  # tables of one customer are all alike
            which = fits.argmax(1)
            table[left] = found[np.arange(len(left)), which]
            left = left[~fits[np.arange(len(left)), which]]
        self.seat[first + n] = table
        self.size[table] += 1
        self.customers[dishes] = n + 1
        self.tables[taken] = count + 1
        np.add.at(self.all_tables, of[came], 1.0)
        return opened

    def remove_one(self, dish: int) -> bool:
        first, n, seat = self.first.item(dish), self.customers.item(dish), self.seat
        place = first + int(self.rng.random() * n)
        table = seat.item(place)
        seat[place] = seat[first + n - 1]
        self.customers[dish] = n - 1
        self.size[table] = size = self.size.item(table) - 1
        if not size:
            tables = self.tables.item(dish)
            self.free[first + self.room.item(dish) - tables] = table
            self.tables[dish] = tables - 1
            self.all_tables[self.context.item(dish)] -= 1
        return not size

    def add_one(self, dish: int, parent: float) -> bool:
        first, n, tables, of, chance = self.first.item(dish), self.customers.item(dish), self.tables.item(dish), self.context.item(dish), self.rng.random
        new = (self.strength + self.discount * self.all_tables.item(of)) * parent
        opened = not n or chance() * (new + n - self.discount * tables) < new
        if opened:
            table = self.free.item(first + self.room.item(dish) - tables - 1)
            self.tables[dish] = tables + 1
            self.all_tables[of] += 1
        else:
            while True:
                table = self.seat.item(first + int(chance() * n))
                size = self.size.item(table)
                if tables == 1 or tables == n or chance() * size < size - self.discount:
                    break
        self.seat[first + n] = table
        self.size[table] += 1
        self.customers[dish] = n + 1
        return opened

    def move(self, dish: int, customers: int, parent: Callable[[int], float]) -> None:
        """Customers of one dish get up and sit down one after another. parent(1), (-1) or (0): the parent's prediction, after a customer came to it, left it or neither."""
        first, room, n, tables, of = (int(x) for x in (self.first[dish], self.room[dish], self.customers[dish], self.tables[dish], self.context[dish]))
        seat, size = (self.seat[first : first + n] - first).tolist(), self.size[first : first + room].tolist()
        free = (self.free[first : first + room - tables] - first).tolist()
        discount, strength, all_tables, before = self.discount, self.strength, float(self.all_tables[of]), tables
        chance, p, n = random.Random(int(self.rng.integers(1 << 62))).random, parent(0), n - 1
        for _ in range(customers):
            place = int(chance() * (n + 1))
            table, seat[place] = seat[place], seat[n]
            size[table] -= 1
            if not size[table]:
                free.append(table)
                tables, all_tables, p = tables - 1, all_tables - 1, parent(-1)
            new = (strength + discount * all_tables) * p
            if not n or chance() * (new + n - discount * tables) < new:
                table = free.pop()
                tables, all_tables, p = tables + 1, all_tables + 1, parent(1)
            else:
                while chance() * size[table := seat[int(chance() * n)]] >= size[table] - discount:
                    pass
            seat[n] = table
            size[table] += 1
        self.seat[first : first + n + 1] = seat
        self.seat[first : first + n + 1] += first
        self.size[first : first + room] = size
        self.free[first : first + len(free)] = free
        self.free[first : first + len(free)] += first
        self.tables[dish] = tables
        self.all_tables[of] += tables - before

    def predictions(self, parent: np.ndarray, dishes: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of all or some dishes, of which parent holds the parent's."""
        of = self.context[dishes]
        new = self.strength + self.discount * self.all_tables[of]
        return (self.customers[dishes] - self.discount * self.tables[dishes] + new * parent) / (self.strength + self.all_customers[of])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with the inverse; where a key and its place fit 64 bits, they are sorted as one number, which is faster."""
    bits = np.uint64(max(1, len(keys) - 1).bit_length())
    if not len(keys) or int(keys.max()) >> (64 - int(bits)):
        keys, number = np.unique(keys, return_inverse=True)
        return keys, number.astype(np.int32)
    placed = np.sort((keys.astype(np.uint64) << bits) + np.arange(len(keys), dtype=np.uint64))
    place = (placed & np.uint64((1 << int(bits)) - 1)).astype(np.int32)
    placed >>= bits
    new = np.concatenate([[False], placed[1:] != placed[:-1]])
    number = np.empty(len(keys), np.int32)
    number[place] = np.cumsum(new, dtype=np.int32)
    new[0] = True
    return placed[new].astype(keys.dtype), number


def _numbered(keys: np.ndarray, first: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and of each key its number among them; those come first that first() marks, of (distinct keys, numbers)."""
    keys, number = _distinct(keys)
    order = np.argsort(~first(keys, number), kind="stable")
    place = np.empty(len(keys), np.int32)
    place[order] = np.arange(len(keys), dtype=np.int32)
    return keys[order], place[number]


class Restaurants:
    """The restaurants of two words (u before v) and of one (v) of a shard, for tokens w; base: by word the root's prediction. Numbers are under 2 ** 32.

    Dishes whose customers can move stand together before the others, and so do their restaurants, so that what sweeps work on is near at hand.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, training: np.ndarray, base: np.ndarray, rng: np.random.Generator):
        words, low = len(base), np.uint64(32)
        learned = training.astype(np.int32)

        def repeat(keys: np.ndarray, number: np.ndarray) -> np.ndarray:
            return np.bincount(number, learned, len(keys)) >= 2

        pairs, pair_of = _numbered(v.astype(np.int64) * words + w, repeat)
        triples = pair_of.astype(np.uint64) << low
        del pair_of
        triples |= u.astype(np.uint64)
        triples, self.triple_of = _numbered(triples, repeat)
        self.pair = (triples >> low).astype(np.int32)  # of each triple
        counts = np.bincount(self.triple_of[training], minlength=len(triples)).astype(np.int32)
        triples &= np.uint64((1 << 32) - 1)
        triples |= (pairs[self.pair] // words).astype(np.uint64) << low
        contexts, context = _numbered(triples, lambda keys, number: np.bincount(number, counts >= 2, len(keys)) > 0)
        contexts = len(contexts)
        del triples
        own = np.bincount(self.pair, counts, len(pairs)).astype(np.int32)
        kinds = np.bincount(self.pair, counts > 0, len(pairs)).astype(np.int32)
        self.words, self.word = words, (pairs % words).astype(np.int32)
        self.renew(base)
        self.two = Level(counts, counts, context, contexts, DISCOUNT[2], STRENGTH[2], rng)
        self.one = Level(kinds, own, (pairs // words).astype(np.int32), int(v.max(initial=-1)) + 1, DISCOUNT[1], STRENGTH[1], rng)

    def renew(self, base: np.ndarray) -> None:
        self.base = base[self.word]

    def _send(self, pairs: np.ndarray, change: np.ndarray) -> None:
        """Customers come to pairs or leave them, which may repeat."""
        if not len(pairs):
            return
        pairs, at = np.unique(pairs, return_inverse=True)
        change = np.bincount(at, change, len(pairs)).astype(np.int64)
        while (fewer := change < 0).any():
            self.one.remove(pairs[fewer])
            self.one.come(pairs[fewer], -1)
            change[fewer] += 1
        while (more := change > 0).any():
            self.one.add(pairs[more], self.base[pairs[more]])
            self.one.come(pairs[more], 1)
            change[more] -= 1

    def _parent(self, pair: int) -> Callable[[int], float]:
        """The prediction of one pair, see Level.move."""
        one, base, of = self.one, self.base.item(pair), self.one.context.item(pair)

        def changed(customers: int) -> float:
            if customers < 0:
                one.remove_one(pair)
            elif customers:
                one.add_one(pair, base)
            one.all_customers[of] += customers
            new = one.strength + one.discount * one.all_tables.item(of)
            return (one.customers.item(pair) - one.discount * one.tables.item(pair) + new * base) / (one.strength + one.all_customers.item(of))

        return changed

    def sweep(self) -> None:
        two, one = self.two, self.one
        step, moved = np.flatnonzero(two.customers >= 2), 0
        while len(step) >= FEW:
            pair = self.pair[step]
            closed = two.remove(step).astype(np.int64)
            opened = two.add(step, one.predictions(self.base[pair], pair))
            differ = opened != closed
            self._send(pair[differ], (opened - closed)[differ])
            moved += 1
            step = step[two.customers[step] > moved]
        for dish in step.tolist():
            two.move(dish, int(two.customers[dish]) - moved, self._parent(self.pair.item(dish)))
        step, moved = np.flatnonzero(one.customers >= 2), 0
        while len(step) >= FEW:
            one.remove(step)
            one.add(step, self.base[step])
            moved += 1
            step = step[one.customers[step] > moved]
        for dish in step.tolist():
            base = float(self.base[dish])
            one.move(dish, int(one.customers[dish]) - moved, lambda customers, base=base: base)

    def sent(self) -> np.ndarray:
        """By word its customers in the root."""
        return np.bincount(self.word, self.one.tables, self.words).astype(np.int64)

    def predictions(self) -> np.ndarray:
        """Of each triple's word after its context."""
        return self.two.predictions(self.one.predictions(self.base)[self.pair])


def _shard(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, np.ndarray]]]:
    """Sorted names of the words w, u, v and w as numbers (each of its own), whether a token is for training, and by chunk twice the texts of its tokens, odd if held out."""
    rows = zip(table.column("chunk").to_pylist(), table.column("kind").to_pylist(), table.column("data"))
    parts = [(chunk, _unpacked(data.as_buffer())) for chunk, kind, data in rows if not kind]
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), [none, none, none, none.astype(bool)], []
    parts.sort(key=lambda p: p[0])
    names = np.unique(np.concatenate([a[0] for _, a in parts]))
    contexts = np.unique(np.concatenate([a[3] for _, a in parts]))
    w = np.concatenate([np.searchsorted(names, a[0]).astype(np.int32)[a[2]] for _, a in parts])
    v = np.concatenate([np.repeat(np.searchsorted(contexts, a[3]).astype(np.int32), a[4]) for _, a in parts])
    training = np.concatenate([a[5] % 2 == 0 for _, a in parts])
    return names, [np.concatenate([a[1] for _, a in parts]), v, w, training], [(chunk, a[5]) for chunk, a in parts]


def _generator(table: pa.Table) -> np.random.Generator:
    return np.random.default_rng([SEED, table.column("shard")[0].as_py()])


def _root_customers(ranges: int):
    """(range, shard, data) of a shard: by range of hashes its words, those of held-out texts too, their customers in the root and their tokens for training."""

    def run(table: pa.Table) -> pa.Table:
        rng = _generator(table)
        names, (u, v, w, training), _ = _shard(table)
        counts = np.bincount(w[training], minlength=len(names))
        tables = Restaurants(u, v, w, training, (counts + 0.5) / (len(w) + 0.5 * len(names) + 1), rng)
        del u, v, w, training
        for _ in range(FIRST_SWEEPS):
            tables.sweep()
        sent, of = tables.sent(), ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(of, np.arange(ranges + 1))
        own = np.flatnonzero(np.diff(ends))
        data = [_packed(names[a:b], _short(sent[a:b]), _short(counts[a:b])) for a, b in zip(ends[own].tolist(), ends[own + 1].tolist())]
        return pa.table({"range": pa.array(own, pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()] * len(own), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


ROOT = "range int, vocabulary long, n long, customers long, k binary, rest binary"


def _root(table: pa.Table) -> pa.Table:
    """The root's words of a range of hashes, in their order: customers k; and as the rest training tokens, and by shard which words it has and how many customers it sent."""
    shards, parts = zip(*sorted((s, _unpacked(data)) for s, data in zip(table.column("shard").to_pylist(), table.column("data").to_pylist())))
    names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sent = np.concatenate([p[1].astype(np.int64) for p in parts])
    k, c = (np.bincount(at, x, len(names)).astype(np.int64) for x in (sent, np.concatenate([p[2].astype(np.int64) for p in parts])))
    rest = _packed(_short(c), np.array(shards, np.int32), np.array([len(p[0]) for p in parts]), _short(at), _short(sent))
    row = {"range": table.column("range")[0].as_py(), "vocabulary": int((c > 0).sum()), "n": int(c.sum()), "customers": int(k.sum()), "k": _packed(_short(k)), "rest": rest}
    return pa.Table.from_pylist([row], pa.schema([("range", pa.int32()), *((x, pa.int64()) for x in ("vocabulary", "n", "customers")), ("k", pa.binary()), ("rest", pa.binary())]))


def seat(customers: np.ndarray, odds: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers sat down one by one, a new table's odds being constant and one seat's less the discount.

    From one new table to the next: the chance that none of m opens one is the mean of p ** m over p from a beta distribution.
    """
    tables, seated = (customers > 0).astype(np.int64), np.ones(len(customers))
    left = np.flatnonzero(customers > 1)
    while len(left):
        p = rng.beta(np.maximum(seated[left] - discount * tables[left], 1e-9), odds)
        seated[left] += np.minimum(rng.geometric(np.maximum(1 - p, 1e-15)), 1 << 62)
        left = left[seated[left] <= customers[left]]
        tables[left] += 1
    return tables


def _drawn(table: pa.Table, odds: float, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of a range of the root's words, the same for the same sweep."""
    (k,) = _unpacked(table.column("k")[0].as_py())
    k = k.astype(np.int64)
    return k, seat(k, odds, DISCOUNT[0], np.random.default_rng([SEED, number, table.column("range")[0].as_py()]))


def _root_tables(odds: float, number: int):
    return lambda table: pa.table({"t": pa.array([int(_drawn(table, odds, number)[1].sum())], pa.int64())})


def _known(odds: float, number: int):
    """(shard, range, data): of a shard's words in a range k, t, sent and c, in the order of their hashes."""

    def run(table: pa.Table) -> pa.Table:
        k, t = _drawn(table, odds, number)
        c, shards, sizes, at, sent = _unpacked(table.column("rest")[0].as_py())
        ends = np.cumsum(sizes).tolist()
        data = []
        for a, b in zip([0, *ends], ends):
            own = at[a:b]
            data.append(_packed(_short(k[own]), _short(t[own]), sent[a:b], _short(c[own])))
        return pa.table({"shard": pa.array(shards, pa.int32()), "range": pa.array([table.column("range")[0].as_py()] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    return run


class Root:
    """The root as a shard sees it: by word its customers k and tables t, of k those that the shard sent; and in all, over a vocabulary."""

    def __init__(self, k: np.ndarray, t: np.ndarray, sent: np.ndarray, customers: int, tables: int, vocabulary: int):
        self.others, self.customers, self.tables, self.vocabulary = k - sent, customers - int(sent.sum()), tables - int(t.sum()), vocabulary
        self.own, self.t = sent, t

    def _odds(self) -> float:
        return (STRENGTH[0] + DISCOUNT[0] * (self.tables + int(self.t.sum()))) / (self.vocabulary + 1)

    def seat(self, sent: np.ndarray, rng: np.random.Generator) -> None:
        """All of its words' customers sit down anew, of whom the shard now sends these."""
        self.own, self.t = sent, seat(self.others + sent, self._odds(), DISCOUNT[0], rng)

    def predictions(self) -> np.ndarray:
        return (self.others + self.own - DISCOUNT[0] * self.t + self._odds()) / (STRENGTH[0] + self.customers + int(self.own.sum()))


def _scored(customers: int, all_tables: int, vocabulary: int):
    """(chunk, kind, data) of a shard: by chunk sums over its tokens by text (kind 0), and lists of texts as they came (kind 1)."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        rows = [(r["chunk"], 1, r["data"]) for r in table.filter(pc.equal(table.column("kind"), 1)).select(["chunk", "data"]).to_pylist()]
        names, (u, v, w, training), texts = _shard(table)
        if texts:
            rng = _generator(table)
            parts = [_unpacked(data) for _, data in sorted(zip(known.column("range").to_pylist(), known.column("data").to_pylist()))]
            k, t, sent, counts = (np.concatenate([p[x].astype(np.int64) for p in parts]) for x in range(4))
            root = Root(k, t, sent, customers, all_tables, vocabulary)
            tables = Restaurants(u, v, w, training, root.predictions(), rng)
            del names, u, v, training
            mean = 0.0
            for number in range(SWEEPS):
                tables.sweep()
                root.seat(tables.sent(), rng)
                tables.renew(root.predictions())
                if number >= BURN_IN:
                    mean = mean + tables.predictions() / (SWEEPS - BURN_IN)
            triple_of = tables.triple_of
            del tables
            scores, bases, is_known, at = np.log10(mean), np.log10(counts + 1.0), counts > 0, 0
            for chunk, own in texts:
                part = slice(at, at := at + len(own))
                place = own >> 1
                if int(place.max()) < 4 * len(place):  # most texts have a token here
                    which = np.flatnonzero(np.bincount(place))
                    numbers = np.zeros(int(which[-1]) + 1, np.int32)
                    numbers[which] = np.arange(len(which))
                    place = numbers[place]
                else:
                    which, place = _distinct(place)
                score, base, n = (np.bincount(place, of[number[part]], len(which)) for of, number in ((scores, triple_of), (bases, w), (is_known, w)))
                rows.append((chunk, 0, _packed(_short(which), score.astype(np.float32), base, _short(n))))
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.table({"chunk": pa.array(columns[0], pa.int64()), "kind": pa.array(columns[1], pa.int32()), "data": pa.array(columns[2], pa.binary())})

    return run


SUMS = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _summed(table: pa.Table) -> pa.Table:
    """A row for each text of a chunk."""
    parts = [(kind, _unpacked(data)) for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist())]
    no_id, ids, held, sizes = next(a for kind, a in parts if kind)
    sums = np.zeros((3, len(ids)))
    for kind, arrays in parts:
        if not kind:
            which, *values = arrays
            for row, own in zip(sums, values):
                row[which] += own
    return pa.table({"doc_id": pa.array(ids, mask=no_id), "held_out": pa.array(held), "n_tokens": pa.array(sizes), "n_known": pa.array(sums[2].astype(np.int64)), "base": pa.array(sums[1]), "score": pa.array(sums[0])})


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, any more): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Tokens are the words between ASCII white space, A-Z lower-cased, then one end. base_score sums add-one
    unigram log10 probabilities, score is the model's log10 probability of the text, perplexity its
    inverse per token. A null text counts as empty (its one token is the end); a null doc_id is learned from.
    With nothing to learn from, every token is unseen and has probability one. Rows that repeat count each time; texts of any length
    are read whole, by one task each. The model is sampled by jobs that run when this is called; words are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = _texts(docs)
    common = texts.select("text").mapInArrow(_commonest, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = common.filter("key = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD))
    rows = common.filter(f"key <> 0 AND n > {SHARD // 16}").collect()  # at most 16 for each shard
    homes = _homes([(r["key"] % (1 << 64), r["n"]) for r in rows], total, shards)

    dealt = texts.mapInArrow(_deal(shards, *homes), DEALT)
    held = dealt.groupBy("shard").applyInArrow(_root_customers(-(-shards // 4)), "range int, shard int, data binary")
    root = spool(held.groupBy("range").applyInArrow(_root, ROOT))
    release(spark)
    vocabulary, n, customers = root.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("vocabulary", "n", "customers"))).first()
    tables = vocabulary
    for number in range(ROOT_SWEEPS):
        odds = (STRENGTH[0] + DISCOUNT[0] * tables) / (vocabulary + 1)
        drawn = root.select("range", "k").groupBy("range").applyInArrow(_root_tables(odds, number), "t long")
        tables = drawn.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    known = root.select("range", "k", "rest").groupBy("range").applyInArrow(_known(odds, ROOT_SWEEPS - 1), "shard int, range int, data binary")
    release(spark)

    parts = dealt.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_scored(customers, tables, vocabulary), "chunk long, kind int, data binary")
    sums = parts.groupBy("chunk").applyInArrow(_summed, SUMS)
    floor = math.log10(n + vocabulary + 1)
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
