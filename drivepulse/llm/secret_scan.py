"""Secret scans with one deterministic automaton for all rules.

The rule expressions are compiled to one non-deterministic automaton over bytes, made deterministic
by subset construction and minimised. One pass over the bytes of a text tells whether any rule ends
anywhere. Only texts with such an end are read again: a second automaton, built from the reversed
rules, marks every place where a match of a rule begins, and from each mark in turn an anchored
automaton of that rule runs to the longest end. Matches of a rule are leftmost and do not overlap.

Null text counts as empty and has no spans. Every row is scanned by itself and whole; the state of
the scan is one automaton state, and a text with a hit gets one mark for each of its bytes. Offsets are code points, ends exclusive;
spans are in order of start, then of the rule list. Repeated rows repeat their spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivepulse.llm.common import slices, texts_of
from drivepulse.session import bounded_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches with fewer than ``least`` characters in ``group`` are dropped."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The three base kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
# What stands between the BEGIN and the END line of a key: base64, line ends (also escaped ones), header fields and marks
# of quotes; no five dashes in a row, so that a block never runs into the next one.
PEM_BODY = r"""[A-Za-z0-9+/=:,.\\"'>#*\t\r\n\x20]"""
RULES = BASE + (
    # A block without an END line is its BEGIN line alone.
    Rule("pem", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{PEM_BODY}*(?:-{{1,4}}{PEM_BODY}+)*-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)


class Nfa:
    """Thompson automaton: byte edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, parsed, backwards: bool, flags: int, at: int) -> int:
        """Append a parsed expression after state ``at``; returns its last state."""
        for op, arg in reversed(list(parsed)) if backwards else parsed:
            at = self.one(str(op), arg, backwards, flags, at)
        return at

    def one(self, op: str, arg, backwards: bool, flags: int, at: int) -> int:
        if op == "SUBPATTERN":
            _, on, off, inner = arg
            return self.add(inner, backwards, (flags | on) & ~off, at)
        if op == "BRANCH":
            end = self.state()
            for choice in arg[1]:
                self.empty[self.add(choice, backwards, flags, at)].append(end)
            return end
        if op == "MAX_REPEAT":
            low, high, inner = arg
            for _ in range(low):
                at = self.add(inner, backwards, flags, at)
            if high == syntax.MAXREPEAT:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.add(inner, backwards, flags, loop)].append(loop)
                return loop
            end = self.state()
            for _ in range(high - low):
                self.empty[at].append(end)
                at = self.add(inner, backwards, flags, at)
            self.empty[at].append(end)
            return end
        end = self.state()
        self.edges[at].append((self.bytes_of(op, arg, flags), end))
        return end

    @staticmethod
    def bytes_of(op: str, arg, flags: int) -> frozenset:
        if op == "LITERAL":
            found = {arg}
        elif op == "IN" and str(arg[0][0]) != "NEGATE":
            found = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    found.add(value)
                elif str(kind) == "RANGE":
                    found.update(range(value[0], value[1] + 1))
                else:
                    raise ValueError(f"class {kind} is not supported")
        else:
            raise ValueError(f"{op} is not supported")
        if max(found) > 127:
            raise ValueError("rules are ASCII")
        if flags & re.IGNORECASE:
            found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
        return frozenset(found)


def determinise(patterns: list[str], backwards: bool, anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transition array (state, byte) -> state and bit mask of the rules that end in each state.

    State 0 is the start. ``anywhere``: a match may begin at every byte.
    """
    nfa = Nfa()
    start = nfa.state()
    final = {}
    for k, pattern in enumerate(patterns):
        final[nfa.add(syntax.parse(pattern), backwards, 0, start)] = 1 << k

    def closure(states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in nfa.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    # Bytes that no edge tells apart move alike.
    allowed_sets = sorted({allowed for edges in nfa.edges for allowed, _ in edges}, key=sorted)
    alike: dict[tuple, list[int]] = {}
    for b in range(256):
        alike.setdefault(tuple(b in s for s in allowed_sets), []).append(b)
    groups = list(alike.values())
    of_byte = np.empty(256, int)
    for g, members in enumerate(groups):
        of_byte[members] = g
    moves_of = [[(sorted({of_byte[b] for b in allowed}), target) for allowed, target in edges] for edges in nfa.edges]
    first = closure([start])
    number, order, rows = {first: 0}, [first], []
    for current in order:
        reached: list[set] = [set() for _ in groups]
        for s in current | first if anywhere else current:
            for allowed, target in moves_of[s]:
                for g in allowed:
                    reached[g].add(target)
        row = []
        for targets in reached:
            nxt = closure(targets | {start}) if anywhere else closure(targets)
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    marks = np.array([sum({final[s] for s in states if s in final}) for states in order])
    moves, ends = minimise(np.array(rows), marks)
    return moves[:, of_byte], ends


def minimise(moves: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no text tells apart; the start stays state 0. Columns are groups of bytes."""
    _, block = np.unique(marks, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    names, first = np.unique(block, return_index=True)
    place = np.empty(len(names), int)
    order = sorted(range(len(names)), key=lambda k: (k != block[0], k))
    place[order] = np.arange(len(names))
    small = np.empty((len(names), moves.shape[1]), int)
    small[place] = place[block[moves[first]]]
    ends = np.empty(len(names), int)
    ends[place] = marks[first]
    return small, ends


def linked(moves: np.ndarray, marks: np.ndarray) -> list:
    """Transition arrays that hold each other: row[byte] is the next row, row[256] the rules that end there."""
    rows: list[list] = [[] for _ in moves]
    for row, targets, mark in zip(rows, moves, marks.tolist(), strict=True):
        row.extend([rows[t] for t in targets.tolist()])
        row.append(mark)
    return rows


def next_mark(begins: np.ndarray, bit: int, at: int) -> int:
    """The first place from ``at`` on that has the bit, -1 if none: looked for in steps that grow."""
    step, bit = 64, begins.dtype.type(bit)
    while at < len(begins):
        hits = begins[at : at + step] & bit
        first = int((hits != 0).argmax())
        if hits[first]:
            return at + first
        at += step
        step = min(2 * step, 1 << 16)
    return -1


def code_points(data: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    found, count, done = {}, 0, 0
    for place in sorted(set(places)):
        # Bytes from 0x80 to 0xBF go on with a code point.
        count += int(np.count_nonzero(np.frombuffer(data, np.int8, place - done, done) >= -64)) if place > done else 0
        done = place
        found[place] = count
    return found


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        patterns = [r.pattern for r in rules]
        moves, marks = determinise(patterns, False, True)
        # A state in which a rule ends has no way on, so that the pass stops there by itself.
        rows = linked(moves, marks)
        self.start = rows[0]
        self.stops = {id(row) for row, mark in zip(rows, marks, strict=True) if mark}
        for row in rows:
            if row[256]:
                row.clear()
        self.rows = rows
        self.back = linked(*determinise(patterns, True, True))[0]
        self.anchored = [linked(*determinise([p], False, False)) for p in patterns]
        self.dead = [self._dead(rows) for rows in self.anchored]
        self.exact = [re.compile(p.encode()) for p in patterns]

    @staticmethod
    def _dead(rows: list) -> set[int]:
        return {id(r) for r in rows if not r[256] and all(r[b] is r for b in range(256))}

    def any(self, data: bytes) -> bool:
        """The byte pass: does any rule end anywhere?"""
        row = self.start
        try:
            for b in data:
                row = row[b]
        except IndexError:
            return True
        return id(row) in self.stops

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """All matches as (start, rule, end), in bytes."""
        row = self.back
        # Which rules begin at each byte, one bit for each.
        begins = np.zeros(len(data), np.uint8 if len(self.rules) <= 8 else np.uint64)
        marks = memoryview(begins)
        for i in range(len(data) - 1, -1, -1):
            row = row[data[i]]
            if row[256]:
                marks[i] = row[256]
        found = []
        for k, rule in enumerate(self.rules):
            i = next_mark(begins, 1 << k, 0)
            while i >= 0:
                free = self._longest(k, data, i)
                match = self.exact[k].fullmatch(data, i, free)
                if match.end(rule.group) - match.start(rule.group) >= rule.least:
                    found.append((i, k, free))
                i = next_mark(begins, 1 << k, free)
        return sorted(found)

    def _longest(self, k: int, data: bytes, i: int) -> int:
        row, end, dead = self.anchored[k][0], i, self.dead[k]
        for j in range(i, len(data)):
            row = row[data[j]]
            if row[256]:
                end = j + 1
            elif id(row) in dead:
                break
        return end

    def scan(self, data: bytes) -> list[dict]:
        if not self.any(data):
            return []
        spans = self.spans(data)
        points = code_points(data, [x for a, _, b in spans for x in (a, b)])
        return [{"kind": self.rules[k].kind, "start": points[a], "end": points[b]} for a, k, b in spans]


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:int,end:int>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows ``doc_id, spans``: every secret of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scanner(rules)
        for batch in slices(batches):
            found = [tool.scan(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPAN_TYPE)], ["doc_id", "spans"])

    return texts_of(docs).mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every secret in ``text`` replaced by ``mark``.

    Overlapping spans are replaced by one mark. A null text stays null.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = scanner(rules)

        def clean(data: bytes | None) -> bytes | None:
            if not data or not tool.any(data):
                return data
            parts, done = [], 0
            for a, _, b in tool.spans(data):
                if a >= done:
                    parts += [data[done:a], mark.encode()]
                done = max(done, b)
            return b"".join(parts) + data[done:]

        for batch in slices(batches):
            texts = pa.array([clean(t) for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digest of the base kinds and the list of all spans, one row per document."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = [r.kind for r in BASE]
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return find(docs, rules).select(
        "doc_id", *map(count, base), F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
