"""Secret scans with one deterministic automaton for all rules.

Rules are regular expressions of a small language: literals, escapes, classes, groups, ``|``,
``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``. Each becomes a chain of positions; all
together, read backwards, are made deterministic by subset construction and minimised by
partition refinement into arrays of transitions over the 256 bytes. One pass over a text, from its
end to its start, tells at every byte which rules have a match that starts there: backwards, a
class that repeats is one state, where forwards every place a match may have begun would be kept
apart. From the first start on, each rule's own forward automaton finds the longest match; the
next match of the rule starts at its end or later. That is the leftmost non-overlapping match of
a regular expression whose repeats are as long as they can be.

A rule may hold its matches to a least size, of the whole or of its last group's value; those
that fail are dropped, and their bytes are not searched again by that rule.

Scale: no shuffle; a text meets the automaton once, and its spans lie in its own row. The
automaton is made from the rules alone; it is compiled once per Python worker.

Nulls: a null text is an empty one and holds nothing; a null ``doc_id`` is kept. Repeated rows are
scanned alike. Texts of any length are scanned whole, in time proportional to their bytes and
matches. Spans of different kinds may overlap; ties in their start go by the rules' order. Empty
tables give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

ROWS_AT_ONCE = 256
# Bounds the automata that a set of rules may need; a set beyond it is an error when it is compiled.
MAX_STATES = 50_000


@dataclass(frozen=True)
class Rule:
    """A pattern, ``value`` its last part if that is held to a size of its own, and the least sizes of both in bytes."""

    kind: str
    pattern: str
    value: str = ""
    least: int = 0
    least_value: int = 0
    any_case: str = ""  # a first part whose letters may be in either case


# The three base kinds, in their order.
BASE = (
    Rule("assign", r"""["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", least_value=12,
         any_case=r"(password|passwd|secret|token|api_?key)"),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    # Runs of less are dropped without a new try, so the least size may stand in the pattern.
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Public forms of well-known credentials.
ADDED = (
    Rule("forge", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", least=40),
    Rule("forge", r"github_pat_[A-Za-z0-9_]+", least=50),
    Rule("forge", r"glpat-[A-Za-z0-9_-]+", least=26),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]+", least=20),
    Rule("payment", r"(sk|rk)_(live|test)_[A-Za-z0-9]+", least=24),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("cloud", r"(ASIA|AROA|AIDA)[A-Z0-9]+", least=20),
    Rule("package", r"npm_[A-Za-z0-9]+", least=40),
    Rule("package", r"pypi-[A-Za-z0-9_-]+", least=50),
    Rule("mail", r"SG\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=50),
    Rule("web", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("bearer", r"\x20+", r"[A-Za-z0-9._~+/=-]+", least_value=20, any_case="bearer"),
    Rule("login", r"[a-z][a-z0-9+]*://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!*$-]+@"),
    Rule("key", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
)
RULES = BASE + ADDED
KINDS = [r.kind for r in BASE]


# --- rules to automata -----------------------------------------------------------

_SHORT = {"d": "0-9", "n": "\n", "t": "\t", "r": "\r"}


class _Parser:
    """A rule as nested lists: ('set', bytes), ('cat', parts), ('alt', parts), ('rep', part, least, most or None)."""

    def __init__(self, text: str, any_case: bool = False):
        self.text, self.at, self.any_case = text, 0, any_case

    def whole(self):
        tree = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"cannot read {self.text!r} from {self.at}")
        return tree

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"{self.text!r} ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, part):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at:end].partition(",")
                self.at = end + 1
                part = ("rep", part, int(low), int(low) if not comma else int(high) if high else None)
            else:
                part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
        return part

    def atom(self):
        c = self.take()
        if c == "(":
            part = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"a group of {self.text!r} does not end")
            return part
        if c == "[":
            return ("set", self.klass())
        if c == "\\":
            return ("set", self.cased(self.escape()))
        if c == ".":
            return ("set", frozenset(range(256)) - {0x0A})
        return ("set", self.cased({ord(c)}))

    def escape(self) -> set[int]:
        c = self.take()
        if c == "x":
            return {int(self.take() + self.take(), 16)}
        if c == "d":
            return set(range(0x30, 0x3A))
        return {ord(_SHORT.get(c, c))}

    def klass(self) -> frozenset[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        own: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            some = self.escape() if c == "\\" else {ord(c)}
            if len(some) == 1 and self.peek() == "-" and self.text[self.at + 1:self.at + 2] != "]":
                self.take()
                c = self.take()
                last = self.escape() if c == "\\" else {ord(c)}
                some = set(range(min(some), max(last) + 1))
            own |= some
        self.take()
        own = self.cased(own)
        return frozenset(range(256)) - own if negated else frozenset(own)

    def cased(self, some) -> frozenset[int]:
        if max(some) > 255:
            raise ValueError("rules are over bytes")
        both = {ord(chr(b).swapcase()) for b in some if b < 128 and chr(b).isalpha()} if self.any_case else set()
        return frozenset(some) | both


def parse(rule: Rule):
    return ("cat", [_Parser(rule.any_case, True).whole(), _Parser(rule.pattern).whole(), _Parser(rule.value).whole()])


def mirrored(tree):
    """The rule that matches the same bytes from their end to their start."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", mirrored(tree[1]), *tree[2:])
    parts = [mirrored(t) for t in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Chain:
    """States with steps on bytes and on nothing."""

    def __init__(self):
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, tree, start: int) -> int:
        """Lay ``tree`` from ``start`` on and return its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.steps[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.free[start].append(end)
            first = self.state()
            self.free[start].append(first)
            start = self.add(part, first)
        self.free[start].append(end)
        return end

    def reach(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def compile_rules(trees: list, anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transition rows over the 256 bytes and, per state, the bit set of rules that end there.

    State 0 is the start. ``anywhere`` lets a match begin at every byte; otherwise state 1 is the
    dead end. Bytes that no rule tells apart are taken together before the subsets are built.
    """
    chain = _Chain()
    first = chain.state()
    ends = {}
    for k, tree in enumerate(trees):
        start = chain.state()
        chain.free[first].append(start)
        ends[chain.add(tree, start)] = 1 << k
    sets = sorted({s for steps in chain.steps for s, _ in steps}, key=sorted)
    like = defaultdict(list)
    for b in range(256):
        like[tuple(b in s for s in sets)].append(b)
    alike = list(like.values())

    root = chain.reach([first])
    number = {root: 0} if anywhere else {root: 0, frozenset(): 1}
    subsets, rows = list(number), []
    while len(rows) < len(subsets):
        states = subsets[len(rows)]
        row = []
        for some in alike:
            to = {t for s in states for on, t in chain.steps[s] if some[0] in on}
            to = chain.reach(to) | (root if anywhere else frozenset())
            if to not in number:
                number[to] = len(subsets)
                subsets.append(to)
                if len(subsets) > MAX_STATES:
                    raise ValueError("these rules need too many states; give counted repeats a least size instead")
            row.append(number[to])
        rows.append(row)
    marks = np.array([sum(ends.get(s, 0) for s in states) for states in subsets], np.int64)
    table = np.array(rows, np.int64)

    # Minimise: part states by their marks, then by the parts their steps lead to, until nothing parts.
    part = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    # Number the parts by their first state, so that the start stays 0 and a dead end 1.
    _, heads = np.unique(part, return_index=True)
    heads.sort()
    named = np.empty(len(heads), np.int64)
    named[part[heads]] = np.arange(len(heads))
    small = named[part[table[heads]]]
    wide = np.empty((len(heads), 256), np.int64)
    for k, some in enumerate(alike):
        wide[:, some] = small[:, [k]]
    return wide, marks[heads]


def _linked(table: np.ndarray, marks: np.ndarray) -> list:
    """Each state as a list of the 256 next ones and, last, its mark: a step is one look-up."""
    states: list[list] = [[] for _ in marks]
    for state, row, mark in zip(states, table.tolist(), marks.tolist(), strict=True):
        state.extend(states[t] for t in row)
        state.append(mark)
    return states


class Scanner:
    """All rules backwards in one automaton, and each forwards in its own."""

    def __init__(self, rules: tuple[Rule, ...]):
        trees = [parse(r) for r in rules]
        if any(_empty(t) for t in trees):
            raise ValueError("a rule may not match nothing")
        self.rules = rules
        self.backward = _linked(*compile_rules([mirrored(t) for t in trees], anywhere=True))[0]
        self.forward = [_linked(*compile_rules([t], anywhere=False)) for t in trees]
        # What stands before a value that is held to a size of its own.
        self.before = [_linked(*compile_rules([parse(Rule(r.kind, r.pattern, any_case=r.any_case))], anywhere=False)) if r.value else None
                       for r in rules]
        # Rules of each set of rules that may start at one byte.
        self.of: dict[int, list[int]] = {}

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(byte, bit set of the rules that match from there), first byte first."""
        state, out, at = self.backward, [], len(data)
        for b in reversed(data):
            at -= 1
            state = state[b]
            if state[256]:
                out.append((at, state[256]))
        out.reverse()
        return out

    @staticmethod
    def longest(states: list, data: bytes, start: int) -> int:
        """The end of the longest match from ``start``, or -1."""
        state, dead, end = states[0], states[1], -1
        for at in range(start, len(data)):
            state = state[data[at]]
            if state is dead:
                break
            if state[256]:
                end = at + 1
        return end

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start byte, rule, end byte) of every match that is kept, by start and rule."""
        free = [0] * len(self.rules)
        out = []
        for start, bits in self.starts(data):
            if bits not in self.of:
                self.of[bits] = [k for k in range(len(self.rules)) if bits >> k & 1]
            for k in self.of[bits]:
                if start < free[k]:
                    continue
                rule = self.rules[k]
                free[k] = end = self.longest(self.forward[k], data, start)
                if end - start < rule.least:
                    continue
                if rule.least_value and end - self.longest(self.before[k], data, start) < rule.least_value:
                    continue
                out.append((start, k, end))
        return out


def _empty(tree) -> bool:
    """Whether the rule matches nothing at all."""
    if tree[0] == "set":
        return False
    if tree[0] == "rep":
        return tree[2] == 0 or _empty(tree[1])
    return (all if tree[0] == "cat" else any)(_empty(t) for t in tree[1])


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One per rule set and Python worker."""
    return Scanner(rules)


# --- over documents ----------------------------------------------------------------

_FOUND = "spans array<struct<kind:string,start:long,end:long,base:boolean>>"


def spans_of(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """Start, rule and end (code points, end exclusive) of every match, by start and rule."""
    data = text.encode()
    found = scanner(rules).scan(data)
    if found and len(data) != len(text):
        # Code points before each byte: all bytes but those that carry a character on.
        points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
        return [(int(points[a]), k, int(points[b])) for a, k, b in found]
    return found


def detect(docs: DataFrame, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """doc_id and the spans of all kinds, by start and rule; ``base`` marks those of the base kinds."""
    kind = docs.sparkSession.createDataFrame([], _FOUND).schema
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *kind])
    spans_type = to_arrow_schema(schema).field("spans").type
    rules = BASE + tuple(added)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                spans = [[{"kind": rules[r].kind, "start": a, "end": b, "base": r < len(BASE)} for a, r, b in spans_of(t.as_py() or "", rules)]
                         for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, spans_type)], names=["doc_id", "spans"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, in their order."""
    told = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(told, ",")


def redact(docs: DataFrame, added: tuple[Rule, ...] = ADDED, mask: str = "[{}]") -> DataFrame:
    """The documents with their columns, every span in the text replaced by its kind; overlapping spans by the first one's."""
    at, arrow = docs.columns.index("text"), to_arrow_schema(docs.schema)
    rules = BASE + tuple(added)

    def one(text):
        if text is None:
            return None
        out, end = [], 0
        for a, rule, b in spans_of(text, rules):
            if a >= end:
                out += [text[end:a], mask.format(rules[rule].kind)]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches):
        for batch in batches:
            texts = pa.array([one(t.as_py()) for t in batch.column(at)], arrow.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(len(arrow))], schema=arrow)

    return docs.mapInArrow(run, docs.schema)
