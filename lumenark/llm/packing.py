"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Texts are tokenised where they lie; only some 40 bytes a piece go on. The tokenizer drops ASCII white space and
never looks across it, so ids are kept per word (two generations of a bounded cache) and joined.
Pieces are then dealt at random, equal rows apart, over shards of about SHARD pieces, each packed by itself: a piece
goes where the sum over residual gaps of the squared number of open sequences with that gap
becomes least, a new sequence being one of the choices. Two orders are tried, large pieces by falling
size and then the rest as dealt, and all by falling size; the one that needs fewer sequences stands. A shard
wastes a few sequences at its end; its size does not depend on the corpus.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import cut, prepare, whole_text

CAPACITY = 2048
SHARD = 32768
#: Pieces over this part of a sequence go first, the largest before all.
LARGE = 8
END = b"\0\0\0\0"  # id 0 after each document
#: Words whose ids one worker keeps, in each of two generations.
KEPT_WORDS = 400_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"

_cached: dict[str, WordIds] = {}


# How a tokenizer file must split texts for words to be tokenised apart.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha())
_DIGITS = "".join(c for c in map(chr, range(256)) if c.isnumeric())
#: Words that split as SPLIT says without a look at it: Latin-1 without spaces, controls, quotes and <.
_SIMPLE = re.compile("[!-&(-;=-~\u00a1-\u00ff]+")
_PARTS = re.compile(f"[{_LETTERS}]+|[{_DIGITS}]|[^{_LETTERS}{_DIGITS}]+")


class WordIds:
    """Ids (little-endian 32 bits) of texts by a tokenizer file that drops white space and marks word ends.

    Unseen words are split here into parts (letters, a digit, marks), and unseen parts tokenised many at a time; a part's
    ids end with the one id that bears the end mark. Words that are not simple go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        mark = form["model"].get("end_of_word_suffix")
        if [n["type"] for n in (form["normalizer"] or {}).get("normalizers", [])] != NORMALIZERS or form["pre_tokenizer"]["pretokenizers"][0].get("pattern") != {"Regex": SPLIT} or not mark:
            raise ValueError(f"{path} does not tokenise words apart")
        self.tokenizer, self.parts = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.parts.normalizer = normalizers.Sequence([])
        self.parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordIds:
        """One for each worker process, kept between tasks."""
        if path not in _cached:
            _cached[path] = cls(path)
        return _cached[path]

    def learn(self, words: set[bytes]) -> None:
        if len(self.new) > KEPT_WORDS:
            self.old, self.new = self.new, {}
        if len(self.known_parts) > KEPT_WORDS:
            self.known_parts = {}
        single, simple, others = [], [], []
        known, old = self.new, self.old.get
        for word in words.difference(known):
            if (ids := old(word)) is not None:
                known[word] = ids
            elif word.isalpha():  # ASCII letters only: one part
                single.append((word, word.lower().decode()))
            elif _SIMPLE.fullmatch(text := word.decode()):
                simple.append((word, _PARTS.findall(text.lower())))
            else:
                others.append((word, text))
        unseen = {p for _, p in single}
        unseen.update(chain.from_iterable(parts for _, parts in simple))
        unseen = list(unseen.difference(self.known_parts))
        for at in range(0, len(unseen), 1024):
            some = unseen[at : at + 1024]
            ids = np.array(self.parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            found = ids.tobytes()
            self.known_parts.update(zip(some, (found[x:y] for x, y in zip([0, *stops], stops)), strict=True))
        get = self.known_parts.__getitem__
        for word, part in single:
            known[word] = get(part)
        for word, parts in simple:
            known[word] = b"".join(map(get, parts))
        if others:
            for (word, _), found in zip(others, self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)):
                known[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Of each text in turn; words are learned for a few MB of text at a time."""
        at = 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and (not lists or size + len(texts[at]) < 4 << 20):
                size += len(texts[at])
                lists.append(texts[at].split())  # at ASCII white space
                at += 1
            self.learn(set().union(*lists))
            for words in lists:
                yield b"".join(map(self.new.__getitem__, words))


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds.at(path)
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), ids.encode(batch.column("text").cast(pa.binary()).to_pylist())):
                found += END
                for piece, at in enumerate(range(0, len(found), 4 * capacity)):
                    part = found[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a final 0, cut every `capacity` tokens."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(_pieces(tokenizer, capacity), PIECE)


def placements(sizes: list[int], capacity: int) -> list[int | None]:
    """For each of sizes (1 to capacity) in turn, the gap of the open sequence it goes to, or None for a new one."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by residual gap
    out: list[int | None] = []
    for size in sizes:
        # What the sum changes by if the piece leaves gap 0, 1, ... in an open sequence.
        change = 2 * (count[: capacity + 1 - size] - count[size:]) + 2
        change[0] = 1 - 2 * count[size]
        change[count[size:] == 0] = 1 << 40
        gap = int(change.argmin())
        if change[gap] <= (2 * count[capacity - size] + 1 if size < capacity else 0):
            count[gap + size] -= 1
            out.append(gap + size)
        else:
            gap = capacity - size
            out.append(None)
        if gap:
            count[gap] += 1
    return out


def sum_of_squares(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of sizes in each sequence, in the order given."""
    open_at: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    out: list[list[int]] = []
    for k, (size, gap) in enumerate(zip(sizes, placements(sizes, capacity))):
        if gap is None:
            gap, members = capacity, []
            out.append(members)
        else:
            members = open_at[gap].pop()
        members.append(k)
        if gap > size:
            open_at[gap - size].append(members)
    return _merged(out, sizes, capacity)


def _merged(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Sequences still open at the end go whole into each other's gaps, the fullest first, each where least gap stays."""
    from bisect import bisect_left, insort

    fill = [sum(sizes[k] for k in members) for members in bins]
    out, gaps = [], []
    for b in sorted(range(len(bins)), key=lambda b: -fill[b]):
        at = bisect_left(gaps, (fill[b], -1))
        if at < len(gaps):
            gap, target = gaps.pop(at)
            out[target].extend(bins[b])
            if gap > fill[b]:
                insort(gaps, (gap - fill[b], target))
        else:
            out.append(bins[b])
            if fill[b] < capacity:
                insort(gaps, (capacity - fill[b], len(out) - 1))
    return out


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        sizes = rows["length"].to_numpy()
        falling = np.argsort(-sizes, kind="stable")
        large = sizes[falling] > capacity // LARGE
        mixed = np.concatenate([falling[large], np.flatnonzero(sizes <= capacity // LARGE)])
        best = min(([order[members].tolist() for members in sum_of_squares(sizes[order].tolist(), capacity)] for order in (mixed, falling)), key=len)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, members in enumerate(best):
            sequence[members] = b
            offset[members] = np.cumsum(sizes[members]) - sizes[members]
        # A shard opens at most one sequence for each of its rows, far below 2**32.
        return rows[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=(rows["shard"].to_numpy() << 32) + sequence, offset=offset)

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, seed: int = 0) -> DataFrame:
    """sequence_id and offset for each piece; found is read twice and its rows are told apart by their places, so cut it before."""
    shards = max(1, -(-found.count() // shard))
    dealt = found.withColumn("order", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed)))
    dealt = dealt.withColumn("shard", F.expr(f"pmod(xxhash64(order), {shards}L)"))
    return dealt.groupBy("shard").applyInPandas(_pack(capacity), f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row per piece of docs (doc_id, text, any more): PIECE's columns, sequence_id, offset.

    Pieces of a sequence lie gapless from offset 0. A null or empty text is one piece of length 1.
    Rows that repeat a doc_id are packed as documents of their own. A null doc_id stays null. No
    rows give no sequences. Texts are tokenised by a job that runs when this is called.
    """
    return pack(cut(pieces(docs, tokenizer, capacity)), capacity, shard)
