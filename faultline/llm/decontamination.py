"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items build one automaton over word ids. Documents stream past it: for
each word the automaton gives the longest item passage that ends there. A match of at least
``window`` words, or of a whole shorter item, is a hit; its words are marked, and the items
whose windows occur are those stored at the states reached. Runs of words that no item
contains are skipped before the walk, since no window can cross them.

Scale: documents are scanned once per automaton, nothing is shuffled. An automaton holds at
most ``BLOCK_WORDS`` item words, so its broadcast is bounded; a larger benchmark is cut into
blocks of items, and documents pass through one automaton after another, gathering hits.
``clean_documents`` decides and cuts by the hits of all blocks, and what it has cut passes
through all blocks again until nothing matches, so blocks do not change results.
Long items are cut into pieces that overlap by ``window - 1`` words, which keeps every window.

Nulls: a null text has no words and no hits; a null item text has no windows; an item
without an id marks words but is not counted. Ties and repeated rows are judged alike, row
by row. Empty tables on either side give no hits. Other columns play no part and are
returned as they came by ``clean_documents``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from faultline.llm.common import ascii_lower, whole
from faultline.session import written

WINDOW = 10
MAX_COVERAGE = 0.5
BLOCK_WORDS = 200_000
PIECE_WORDS = 5_000

# Bytes of words stay, upper case becomes lower, the rest are blanks.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))
_PLACES = re.compile(rb"[^ ]+")


class Automaton:
    """Generalised suffix automaton over word ids of items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws]) for i, ws in items if ws]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        # Item ids at the states of their windows, and short items at the states of their ends.
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for item, ids in coded:
            state = 0
            for k, w in enumerate(ids):
                state = self.next[state][w]
                if k + 1 >= window:
                    self.items.setdefault(self._at(state, window), set()).add(item)
            if len(ids) < window:
                own = self.short.setdefault(self._at(state, len(ids)), [])
                if (len(ids), item) not in own:
                    own.append((len(ids), item))
        self.least = min((min(len(ids), window) for _, ids in coded), default=0)

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of ``q`` that ``p`` reaches by ``w``, as a state of its own."""
        part = self._state(self.length[p] + 1)
        self.next[part] = dict(self.next[q])
        self.link[part] = self.link[q]
        self.link[q] = part
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _at(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a match that reached ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def walk(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans that are hit, unmerged, and the items found."""
        if not self.least or len(words) < self.least:
            return [], set()
        get = self.vocab.get
        ids = [get(w, 0) for w in words]
        known = np.concatenate(([0], np.asarray(ids, dtype=np.int64) > 0, [0])).astype(np.int8)
        turns = np.flatnonzero(np.diff(known))
        nxt, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        spans: list[tuple[int, int]] = []
        states, found = set(), set()
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            state = size = 0
            for i in range(a, b):
                w = ids[i]
                while state and w not in nxt[state]:
                    state = link[state]
                    size = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    size += 1
                if size >= window:
                    if spans and i - size < spans[-1][1]:
                        spans[-1] = (min(spans[-1][0], i - size + 1), i + 1)
                    else:
                        spans.append((i - size + 1, i + 1))
                    states.add(state)
                if short and size:
                    s = state
                    while s > 0:
                        for n, item in short.get(s, ()):
                            if n <= size:
                                spans.append((i - n + 1, i + 1))
                                found.add(item)
                        s = link[s]
        for s in states:
            found |= self.items[self._at(s, window)]
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word spans."""
    places = [m.span() for m in _PLACES.finditer(text.translate(_TABLE))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """One automaton per block of items, built as it is asked for."""
    text = ascii_lower(whole(F.col("text")))
    w = F.array_remove(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    piece = min(PIECE_WORDS, block_words)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), w.alias("w")).filter(F.size("w") > 0)
    # The last start leaves no piece that lies inside the one before.
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(piece))
    pieces = rows.select("item", F.explode(starts).alias("start"), "w").select(
        "item", "start", F.slice("w", F.col("start") + 1, piece + window - 1).alias("w"))
    pieces = written(pieces.distinct(), "benchmark-pieces")
    total = pieces.agg(F.sum(F.size("w"))).first()[0] or 0
    # Twice as many blocks as needed on average; a block that is too large all the same is an error.
    blocks = max(1, -(-2 * total // block_words)) if total > block_words else 1
    part = pieces.withColumn("block", F.pmod(F.xxhash64("item", "start"), F.lit(blocks)))
    for k in range(blocks):
        own = part.filter(F.col("block") == k)
        if blocks > 1 and (own.agg(F.sum(F.size("w"))).first()[0] or 0) > block_words + piece:
            raise ValueError("a block of items outgrew its bound; raise block_words")
        yield Automaton([(r["item"], [x.encode() for x in r["w"]]) for r in own.collect()], window)


def _find(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add the hits of one automaton to rows of (doc_id, text, n_words, spans, items)."""

    def run(batches):
        automaton = model.value
        for batch in batches:
            n_words, spans, items = [], [], []
            old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (s0, i0) in zip(batch.column("text"), old, strict=True):
                ws = split_words(text.as_py() or b"")
                s, i = automaton.walk(ws)
                n_words.append(len(ws))
                spans.append([{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in s0] + s)])
                items.append(sorted({*i0, *i} - {None}))
            kind = batch.schema
            yield pa.record_batch([
                batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()),
                pa.array(spans, kind.field("spans").type), pa.array(items, kind.field("items").type)], schema=kind)

    return run


_HITS = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) and spans (word positions, end exclusive) for every row."""
    return _hits(docs, benchmark, window, block_words).drop("text")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    spark = docs.sparkSession
    empty = F.from_json(F.lit("[]"), "array<struct<a:int,b:int>>")
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"),
                       F.lit(0).cast("long").alias("n_words"), empty.alias("spans"),
                       F.array().cast("array<string>").alias("items"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text binary, {_HITS}"
    for automaton in automata(benchmark, window, block_words):
        rows = rows.mapInArrow(_find(spark.sparkContext.broadcast(automaton)), schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return rows.select("doc_id", "text", "n_words", n_hit.alias("n_hit"), "items", "spans")


def _clean(model, names: list[str], max_span: int, max_coverage: float):
    """Cut long spans out of texts; drop rows that are covered too far."""

    def run(batches):
        automaton, at = model.value, names.index("text")
        for batch in batches:
            keep, texts = [], []
            for text in batch.column(at):
                raw = (text.as_py() or "").encode()
                ws = split_words(raw)
                spans = merged(automaton.walk(ws)[0])
                hit = sum(b - a for a, b in spans)
                fits = hit <= max_coverage * len(ws)
                keep.append(fits)
                # What moves together after a cut may match again.
                while fits and (spans := [s for s in spans if s[1] - s[0] > max_span]):
                    raw = cut(raw, spans)
                    spans = merged(automaton.walk(split_words(raw))[0])
                    text = raw.decode()
                if fits:
                    texts.append(text.as_py() if isinstance(text, pa.Scalar) else text)
            rows = batch.filter(pa.array(keep, pa.bool_()))
            columns = [pa.array(texts, pa.string()) if k == at else rows.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.set(at, pa.field("text", pa.string())))

    return run


_SPANS = ArrayType(StructType([StructField("a", IntegerType()), StructField("b", IntegerType())]))


def _with(batch: pa.RecordBatch, columns: dict[int, list]) -> pa.RecordBatch:
    kind = batch.schema
    arrays = [pa.array(columns[k], kind.field(k).type) if k in columns else batch.column(k) for k in range(len(kind))]
    return pa.RecordBatch.from_arrays(arrays, schema=kind)


def _mark(model, spans_at: int, text_at: int):
    """Add the hits of one automaton to the spans of rows."""

    def run(batches):
        automaton = model.value
        for batch in batches:
            out = []
            for text, old in zip(batch.column(text_at), batch.column(spans_at).to_pylist(), strict=True):
                own = automaton.walk(split_words((text.as_py() or "").encode()))[0]
                out.append([{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in old or ()] + own)])
            yield _with(batch, {spans_at: out})

    return run


def _cut_marked(spans_at: int, text_at: int, max_span: int, max_coverage: float | None):
    """Cut long spans out of texts and mark what was cut; drop rows that are covered too far, if asked for."""

    def run(batches):
        for batch in batches:
            keep, texts, again = [], [], []
            for text, marked in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True):
                raw, spans = (text or "").encode(), [(x["a"], x["b"]) for x in marked]
                keep.append(max_coverage is None or sum(b - a for a, b in spans) <= max_coverage * len(split_words(raw)))
                spans = [s for s in spans if s[1] - s[0] > max_span]
                texts.append(cut(raw, spans).decode() if spans else text)
                again.append(bool(spans))
            rows = _with(batch, {text_at: texts, spans_at: [None] * len(texts), spans_at + 1: again})
            yield rows.filter(pa.array(keep, pa.bool_()))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = 0,
                    max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with their columns, hit spans of more than ``max_span`` words cut out.

    Documents of which more than ``max_coverage`` is hit are dropped.
    """
    send = docs.sparkSession.sparkContext.broadcast
    models = [send(automaton) for automaton in automata(benchmark, window, block_words)]
    if len(models) == 1:
        return docs.mapInArrow(_clean(models[0], docs.columns, max_span, max_coverage), docs.schema)
    # A name longer than all others is free.
    spans = "_" * (1 + max(map(len, docs.columns)))
    again = spans + "_"
    schema = StructType([*docs.schema, StructField(spans, _SPANS), StructField(again, BooleanType())])
    rows = docs.withColumn(spans, F.lit(None).cast(_SPANS)).withColumn(again, F.lit(False))
    ready: list[DataFrame] = []
    while True:
        for model in models:
            rows = rows.mapInArrow(_mark(model, len(docs.columns), docs.columns.index("text")), schema)
        # Coverage is judged once, on the texts as they came.
        share = None if ready else max_coverage
        rows = written(rows.mapInArrow(_cut_marked(len(docs.columns), docs.columns.index("text"), max_span, share), schema), "decontaminated")
        ready.append(rows.filter(~F.col(again)).drop(spans, again))
        rows = rows.filter(F.col(again))
        if rows.isEmpty():
            return reduce(DataFrame.unionAll, ready)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, least(len(w), 10) AS n, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
z AS (SELECT DISTINCT n FROM n),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n)),
h AS (SELECT r, i, n, item_id FROM dw JOIN iw USING (n, s)),
p AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
