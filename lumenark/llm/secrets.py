"""Secret scans by one deterministic automaton over bytes.

Each rule is a regular expression over bytes of a small grammar (literals, classes, ( | ), ?, *, +,
{n}). All rules are compiled together: a Thompson automaton for each, the subset construction over
their product with a leftmost, greedy discipline per rule, minimisation by partition refinement,
and then one transition array with 256 entries a state. Scanning is one pass of lookups over a
text's UTF-8 bytes whatever the number of rules. A state knows, per rule, whether a match has just
ended; the rare state in which one has tells the scanner to write it down. Where that match began
is found by the rule's reversed automaton, run backwards from its end.

Rules of the base, and which of their matches count, are fixed by their definition; rules in EXTRA
only add spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import prepare, whole_text

# The base rules' patterns and the least lengths of their matches.
ASSIGN_KEY = "(password|passwd|secret|token|api_?key)"
ASSIGN_MIDDLE = "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN_LEAST = 12
ACCESS, ACCESS_LEAST = "AKIA[A-Z0-9]+", 18
HEX, HEX_LEAST = "[0-9a-f]", 16


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    base: bool = False


#: A run of hex digits is one match from wherever it starts, so its least length can be in the
#: pattern; the others' matches are measured once found.
RULES = (
    Rule("assign", f"{ASSIGN_KEY}{ASSIGN_MIDDLE}{ASSIGN_VALUE}+", True, True),
    Rule("access", ACCESS, False, True),
    Rule("hex", HEX * HEX_LEAST + HEX + "*", False, True),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_" + "[A-Za-z0-9]" * 20 + "+"),
    Rule("slack", "xox[abprs]-" + "[A-Za-z0-9-]" * 10 + "+"),
)


# --- regular expressions to Thompson automata ---------------------------------------------------


class Nfa:
    """States 0..n-1; edges by byte set; empty edges; one start, one end."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def closure(self, states: Iterator[int]) -> frozenset[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo.extend(self.empty[s])
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure(t for s in states for on, t in self.edges[s] if byte in on)


class _Parser:
    def __init__(self, rule: Rule):
        self.rest, self.any_case = rule.pattern, rule.any_case

    def take(self, n: int = 1) -> str:
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def one(self) -> int:
        """A byte of the pattern, escapes resolved."""
        c = self.take()
        if c != "\\":
            return ord(c)
        return int(self.take(2), 16) if (c := self.take()) == "x" else ord(c)

    def bytes_of(self, values: set[int]) -> frozenset[int]:
        if self.any_case:
            values = {v for b in values for v in (*chr(b).lower().encode("latin-1"), *chr(b).upper().encode("latin-1"))}
        return frozenset(values)

    def alternatives(self):
        found = [self.sequence()]
        while self.rest[:1] == "|":
            self.take()
            found.append(self.sequence())
        return found[0] if len(found) == 1 else ("or", found)

    def sequence(self):
        parts = []
        while self.rest and self.rest[0] not in "|)":
            if self.rest[0] == "(":
                self.take()
                part = self.alternatives()
                self.take()
            elif self.rest[0] == "[":
                self.take()
                values: set[int] = set()
                while self.rest[0] != "]":
                    low = high = self.one()
                    if self.rest[0] == "-" and self.rest[1] != "]":
                        self.take()
                        high = self.one()
                    values.update(range(low, high + 1))
                self.take()
                part = ("on", self.bytes_of(values))
            else:
                part = ("on", self.bytes_of({self.one()}))
            if self.rest[:1] and self.rest[0] in "?*+":
                part = (self.take(), part)
            parts.append(part)
        return ("then", parts)


def _build(nfa: Nfa, node, backwards: bool) -> tuple[int, int]:
    kind, arg = node
    a, b = nfa.state(), nfa.state()
    if kind == "on":
        nfa.edges[a].append((arg, b))
    elif kind == "then":
        at = a
        for part in reversed(arg) if backwards else arg:
            begin, end = _build(nfa, part, backwards)
            nfa.empty[at].append(begin)
            at = end
        nfa.empty[at].append(b)
    elif kind == "or":
        for part in arg:
            begin, end = _build(nfa, part, backwards)
            nfa.empty[a].append(begin)
            nfa.empty[end].append(b)
    else:
        begin, end = _build(nfa, arg, backwards)
        nfa.empty[a].append(begin)
        nfa.empty[end].append(b)
        if kind in "?*":
            nfa.empty[a].append(b)
        if kind in "*+":
            nfa.empty[end].append(begin)
    return a, b


def _nfa(rule: Rule, backwards: bool = False) -> tuple[Nfa, int, int]:
    nfa = Nfa()
    begin, end = _build(nfa, _Parser(rule).alternatives(), backwards)
    return nfa, begin, end


def _classes(nfas: list[Nfa]) -> tuple[list[int], list[int]]:
    """Bytes that no rule tells apart share a class: each byte's class, and one byte of each class."""
    sets = sorted({on for nfa in nfas for edges in nfa.edges for on, _ in edges}, key=sorted)
    names: dict[tuple[bool, ...], int] = {}
    class_of = [names.setdefault(tuple(b in on for on in sets), len(names)) for b in range(256)]
    return class_of, [class_of.index(n) for n in range(len(names))]


# --- one rule, forwards: threads in the order of where they began ---------------------------------


class _Forward:
    """A configuration is the state sets of attempts, earliest start first; those after one that has
    matched are dropped, for an earlier match goes first. When the attempt that has matched cannot go on,
    its match has ended before the byte at hand, and the search starts afresh with that byte."""

    def __init__(self, rule: Rule):
        self.nfa, begin, self.end = _nfa(rule)
        self.begin = self.nfa.closure([begin])

    def advance(self, threads: tuple[frozenset[int], ...], byte: int) -> tuple[frozenset[int], ...]:
        out, seen = [], set()
        for states in (*threads, self.begin):
            moved = frozenset(self.nfa.step(states, byte) - seen)
            if moved:
                out.append(moved)
                seen |= moved
            if self.end in moved:
                break
        return tuple(out)

    def step(self, threads: tuple[frozenset[int], ...], byte: int) -> tuple[tuple[frozenset[int], ...], bool]:
        """The next configuration, and whether a match ended before this byte."""
        if not threads or self.end not in threads[-1]:
            return self.advance(threads, byte), False
        on = self.nfa.step(threads[-1], byte)
        earlier = [m for states in threads[:-1] if (m := self.nfa.step(states, byte))]
        if earlier and not on:
            raise ValueError("a rule may match after a longer attempt that began before it; such rules need two passes")
        return ((*earlier, on), False) if on else (self.advance((), byte), True)

    def table(self, examples: list[int]) -> tuple[list[list[tuple[int, bool]]], list[bool]]:
        """By number of configuration (0: no attempt yet): its steps on each byte class, and whether a match could end here."""
        numbers: dict[tuple[frozenset[int], ...], int] = {(): 0}
        order, steps = [()], []
        for threads in order:  # grows meanwhile
            row = []
            for byte in examples:
                moved, ended = self.step(threads, byte)
                if moved not in numbers:
                    numbers[moved] = len(order)
                    order.append(moved)
                row.append((numbers[moved], ended))
            steps.append(row)
        return steps, [bool(threads) and self.end in threads[-1] for threads in order]


# --- all rules together ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """table[state * 256 + byte] is the next state times 256, or, where matches end before the byte,
    minus 1 minus a number of `ends`: (next state times 256, kinds whose match ended)."""

    table: list[int]
    ends: list[tuple[int, tuple[int, ...]]]
    last: list[tuple[int, ...]]  # kinds with a match that ends with the text, by state
    states_before: int


def _minimised(nxt: list[list[int]], marks: list[list[tuple[int, ...]]], last: list[tuple[int, ...]]) -> list[int]:
    """Each state's block: the coarsest partition that tells no two like states apart."""
    names: dict = {}
    block = [names.setdefault((last[s], tuple(marks[s])), len(names)) for s in range(len(nxt))]
    while True:
        names = {}
        finer = [names.setdefault((block[s], tuple(block[t] for t in nxt[s])), len(names)) for s in range(len(nxt))]
        if len(names) == len(set(block)):
            return finer
        block = finer


@cache
def compiled(rules: tuple[Rule, ...] = RULES) -> Automaton:
    forward = [_Forward(rule) for rule in rules]
    class_of, examples = _classes([f.nfa for f in forward])
    tables, accepts = zip(*(f.table(examples) for f in forward))
    start = (0,) * len(rules)
    numbers, order, nxt, marks = {start: 0}, [start], [], []
    for config in order:  # grows meanwhile
        row, ended = [], []
        for moved in zip(*(t[c] for t, c in zip(tables, config))):
            target = tuple(m[0] for m in moved)
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
            ended.append(tuple(k for k, m in enumerate(moved) if m[1]))
        nxt.append(row)
        marks.append(ended)
    last = [tuple(k for k, c in enumerate(config) if accepts[k][c]) for config in order]
    block = _minimised(nxt, marks, last)
    keep: dict[int, int] = {}  # one state of each block
    for s, b in enumerate(block):
        keep.setdefault(b, s)
    first = block[0]
    rename = {b: n for n, b in enumerate(sorted(keep, key=lambda b: b != first))}
    table, ends, end_numbers = [0] * (256 * len(keep)), [], {}
    for b, s in keep.items():
        for byte in range(256):
            c = class_of[byte]
            target = rename[block[nxt[s][c]]] * 256
            if marks[s][c]:
                event = (target, marks[s][c])
                if event not in end_numbers:
                    end_numbers[event] = len(ends)
                    ends.append(event)
                target = -1 - end_numbers[event]
            table[rename[b] * 256 + byte] = target
    return Automaton(table, ends, [last[s] for _, s in sorted((rename[b], s) for b, s in keep.items())], len(order))


@cache
def _backward(rule: Rule) -> tuple[list[list[int]], list[bool]]:
    """The reversed rule's automaton: next states by byte (-1: none), and whether a state accepts."""
    nfa, begin, end = _nfa(rule, True)
    start = nfa.closure([begin])
    numbers, order, table = {start: 0}, [start], []
    for states in order:
        row = []
        for byte in range(256):
            moved = nfa.step(states, byte)
            if moved and moved not in numbers:
                numbers[moved] = len(order)
                order.append(moved)
            row.append(numbers[moved] if moved else -1)
        table.append(row)
    return table, [end in states for states in order]


def _began(rule: Rule, text: bytes, stop: int, least: int) -> int:
    """The first place from `least` on from which the rule matches up to `stop`."""
    table, accepts = _backward(rule)
    state, found = 0, stop
    for at in range(stop - 1, least - 1, -1):
        state = table[state][text[at]]
        if state < 0:
            break
        if accepts[state]:
            found = at
    return found


def matches(text: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(number of the rule, start, end) of each rule's leftmost non-overlapping matches, by end; in bytes."""
    automaton = compiled(rules)
    table, out, free = automaton.table, [], [0] * len(rules)

    def note(kinds: tuple[int, ...], stop: int) -> None:
        for k in kinds:
            out.append((k, _began(rules[k], text, stop, free[k]), stop))
            free[k] = stop

    state = 0
    for at, byte in enumerate(text):
        state = table[state + byte]
        if state < 0:
            state, kinds = automaton.ends[-1 - state]
            note(kinds, at)
    note(automaton.last[state // 256], len(text))
    return out


def _value_length(found: bytes) -> int:
    """Of an assignment's value: what follows the first : or = and its spaces and quote."""
    value = found[min(i for i in (found.find(b":"), found.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'"))


def _counts(rule: Rule, found: bytes) -> bool:
    if rule.kind == "assign":
        return _value_length(found) >= ASSIGN_LEAST
    return rule.kind != "access" or len(found) >= ACCESS_LEAST


def spans(text: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, number of the rule) of the matches that count, by start and rule; in code points."""
    found = sorted((a, b, k) for k, a, b in matches(text, rules) if _counts(rules[k], text[a:b]))
    if found and not text.isascii():
        place, at, points = {}, 0, 0
        for edge in sorted({e for a, b, _ in found for e in (a, b)}):
            points += len(text[at:edge].decode())
            place[edge], at = points, edge
        found = [(place[a], place[b], k) for a, b, k in found]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, shas, listed = ([], [], []), [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = spans(text)
            names = [(k, f"{RULES[k].kind}:{a}:{b}") for a, b, k in found]
            for k, column in enumerate(counts):
                column.append(sum(s[0] == k for s in names))
            shas.append(hashlib.sha256(",".join(n for k, n in names if RULES[k].base).encode()).hexdigest())
            listed.append(",".join(n for _, n in names))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(listed, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, any more): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive) by start, then by rule as listed.
    A null text counts as empty; no match gives counts of 0, an empty list and its hash. Bytes beyond
    ASCII match no rule, so an offset always falls between two code points. Rows are read one by one, repeated ones too, in one
    pass over each whole text, however long.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
