"""Ranked lexical search by Block-Max MaxScore over sharded inverted lists.

``build_index`` cuts the documents into shards of bounded size. A shard holds one list per
term: postings (document, frequency) in blocks, each block compressed on its own and summed up
by its frontier, the pairs of frequency and document length that no other posting of the block
beats in both. A frontier bounds the block's best score for any corpus statistics, so one pass
over the texts builds the index, and statistics of a grown corpus need no rewrite.

``search`` holds a shard's lists against the items. An item's lists are ordered by their
greatest score in the shard. Those whose bounds together stay below the item's threshold (the
lowest of its best scores so far) are non-essential: their documents count only if an essential
list names them. Candidates are then held against the block maxima of the non-essential lists,
and a block is decompressed only if a candidate in it can still reach the threshold. Each task
keeps one heap per item over all its shards; the heaps are merged by item.

Scale: texts are read once and not shuffled. What is shuffled are the compressed lists of
asked terms, by shard, and k rows per item and task. A shard has at most ``SHARD_TERMS`` terms
or one document, so no term's list grows with the corpus in any task. Items reach the tasks in
blocks of at most ``BLOCK_TERMS`` distinct terms (or one item), each its own pass over the lists.

Scores are integers: a term that ``df`` of ``N`` documents hold weighs
``floor(1000 ln((2N+2) / (2df+1)))``, and a document of ``n`` terms that holds it ``tf`` times
adds ``weight * (10^9 tf div (1000 tf + 8 m))`` with ``m = 25 + 75 n N div L`` for each of its
occurrences in the item; ``L`` counts the corpus' terms. They are exact while ``75 n N`` fits 64 bits.

Nulls: a null or blank text has no terms, is no result and not counted in ``N``; an item without
terms has no results; a null ``doc_id`` stands last among equal scores, a null ``item_id`` is an
item like any other. Ties go to the smaller ``doc_id``. Repeated rows are documents or items of
their own. Empty tables give no rows. Other columns play no part.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from faultline.llm.common import ascii_lower, whole
from faultline.session import fresh_dir, written

K = 10
SHARD_TERMS = 2_000_000
BLOCK_POSTINGS = 128
BLOCK_TERMS = 200_000
WINDOW_DOCS = 4096
ROWS_AT_ONCE = 5000
# Everything but digits, ASCII letters and bytes of other scripts parts terms.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))

# A row is a term's list, or, with a null term, the shard's documents.
_LISTS = """shard long, term binary, df long, last array<int>, at array<int>, front_at array<int>,
  front_tf array<int>, front_n array<int>, postings binary, n_docs long, n_terms long, lengths array<int>"""


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes (seven bits each, the high bit on all but a value's last) and the start of every value."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= np.uint64(1 << bits)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(starts[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        more = (sizes[own] > k + 1).astype(np.uint8) << 7
        out[starts[:-1][own] + k] = ((values[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, starts


def unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


class _Shard:
    """Terms of documents, gathered until the shard is full."""

    def __init__(self):
        self.vocab: dict[bytes, int] = defaultdict()
        self.vocab.default_factory = self.vocab.__len__
        self.ids: list = []
        self.lengths: list[int] = []
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, terms: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(terms))
        self.words.append(np.fromiter(map(self.vocab.__getitem__, terms), np.int32, len(terms)))
        self.size += len(terms)

    def rows(self, number: int, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        lengths = np.array(self.lengths, np.int64)
        n_docs = len(lengths)
        key = np.concatenate(self.words).astype(np.int64) * n_docs + np.repeat(np.arange(n_docs), lengths)
        key, tf = np.unique(key, return_counts=True)
        term, doc = key // n_docs, key % n_docs
        n_terms = len(self.vocab)
        df = np.bincount(term, minlength=n_terms)
        first = np.concatenate(([0], np.cumsum(df)))
        # Blocks start anew with every term.
        place = np.arange(len(key)) - first[term]
        heads = np.flatnonzero(place % block == 0)
        blocks_of = np.concatenate(([0], np.cumsum(-(-df // block))))
        of_block = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
        gaps = np.diff(doc, prepend=0)
        gaps[heads] = doc[heads]
        data, starts = pack(np.stack([gaps, tf], axis=1).ravel())
        at = starts[2 * heads]
        at_term = np.append(at, len(data))[blocks_of]
        # The frontier: by length, every posting whose frequency is above all shorter ones'.
        n = lengths[doc]
        order = np.lexsort((-tf, n, of_block))
        tall = of_block[order] * (tf.max() + 1) + tf[order]
        best = np.maximum.accumulate(tall)
        new = np.concatenate(([True], best[1:] > best[:-1]))
        front = order[new]
        front_starts = np.searchsorted(of_block[front], np.arange(len(heads) + 1))
        fronts = front_starts[blocks_of]

        def lists(values, offsets):
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

        def batch(size, columns):
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in schema], schema=schema)

        of_term = np.repeat(np.arange(n_terms), np.diff(blocks_of))
        kind = {f.name: f.type for f in schema}
        about = {"shard": [number], "n_docs": [n_docs], "n_terms": [int(lengths.sum())],
                 "lengths": [self.lengths], "ids": [self.ids]}
        yield batch(1, {c: pa.array(v, kind[c]) for c, v in about.items()})
        whole_shard = batch(n_terms, {
            "shard": pa.array(np.full(n_terms, number)), "term": pa.array(list(self.vocab), pa.binary()), "df": pa.array(df),
            "last": lists(doc[np.append(heads[1:], len(key)) - 1], blocks_of),
            "at": lists(at - at_term[of_term], blocks_of),
            "front_at": lists(front_starts[:-1] - fronts[of_term], blocks_of),
            "front_tf": lists(tf[front], fronts), "front_n": lists(n[front], fronts),
            "postings": pa.Array.from_buffers(
                pa.binary(), n_terms, [None, pa.py_buffer(at_term.astype(np.int32)), pa.py_buffer(data)]),
        })
        for k in range(0, n_terms, ROWS_AT_ONCE):
            yield whole_shard.slice(k, ROWS_AT_ONCE)


def build_index(docs: DataFrame, shard_terms: int = SHARD_TERMS, block: int = BLOCK_POSTINGS) -> DataFrame:
    """The inverted lists of all documents, written to the shared folder."""
    id_type = docs.schema["doc_id"].dataType
    spark = docs.sparkSession
    schema = StructType([*spark.createDataFrame([], _LISTS).schema, StructField("ids", ArrayType(id_type))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        made, shard = 0, _Shard()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = (text.as_py() or b"").translate(_TABLE).split()
                if not terms:
                    continue
                if shard.size and shard.size + len(terms) > shard_terms:
                    yield from shard.rows(number + made, block, arrow)
                    made, shard = made + 1, _Shard()
                shard.add(doc_id, terms)
        if shard.size:
            yield from shard.rows(number + made, block, arrow)

    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)
    return written(rows, "inverted-lists")


class _List:
    """One term's postings in a shard: block bounds at once, blocks on demand."""

    def __init__(self, last, at, front_at, front_tf, front_n, postings, damp):
        self.last, self.data = last, postings
        self.at = np.append(at, len(postings))
        self.bounds = np.maximum.reduceat(_part(front_tf, damp(front_n)), front_at)
        self.best = int(self.bounds.max())
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int, damps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their score parts; kept for the shard's other items."""
        got = self.blocks.get(b)
        if got is None:
            values = unpack(self.data[self.at[b]:self.at[b + 1]])
            docs = np.cumsum(values[::2])
            got = self.blocks[b] = (docs, _part(values[1::2], damps[docs]))
        return got


def _part(tf: np.ndarray, damp: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * damp)


def _score(lists: list[tuple[_List, int]], n_docs: int, damps: np.ndarray, bar, keep, window: int) -> None:
    """Offer ``keep`` every document of a shard that may reach the threshold ``bar()``, window by window."""
    lists = sorted(lists, key=lambda x: x[0].best * x[1])
    reach = np.cumsum([x.best * w for x, w in lists])
    for start in range(0, n_docs, window):
        end = min(start + window, n_docs)
        low = bar()
        # Non-essential: the lists of least reach that together stay below the threshold.
        split = int(np.searchsorted(reach, low))
        if split == len(lists):
            return
        score = np.zeros(end - start, np.int64)
        named = np.zeros(end - start, bool)
        for x, w in lists[split:]:
            a, b = np.searchsorted(x.last, [start, end - 1])
            for k in range(a, min(b + 1, len(x.last))):
                docs, part = x.block(k, damps)
                if docs[0] < start or docs[-1] >= end:
                    own = (docs >= start) & (docs < end)
                    docs, part = docs[own], part[own]
                score[docs - start] += part * w
                named[docs - start] = True
        docs = np.flatnonzero(named)
        score = score[docs]
        docs += start
        # Greatest reach first; what the lists still to come can add is known by block.
        rest = lists[:split][::-1]
        spots, adds = [], []
        for x, w in rest:
            spot = np.searchsorted(x.last, docs)
            spots.append(spot)
            adds.append(np.append(x.bounds, 0)[spot] * w)
        left = np.sum(adds, axis=0) if rest else np.zeros(len(docs), np.int64)
        alive = np.flatnonzero(score + left >= low)
        for (x, w), spot, add in zip(rest, spots, adds, strict=True):
            left[alive] -= add[alive]
            here = spot[alive]
            for k in np.unique(here[here < len(x.last)]).tolist():
                own = alive[here == k]
                in_block, part = x.block(k, damps)
                place = np.minimum(np.searchsorted(in_block, docs[own]), len(in_block) - 1)
                score[own] += np.where(in_block[place] == docs[own], part[place], 0) * w
            alive = alive[score[alive] + left[alive] >= low]
        keep(docs[alive], score[alive])


def _order(hit: tuple) -> tuple:
    score, doc_id = hit
    return -score, doc_id is None, doc_id


def _search(shared, n: int, total: int, k: int, window: int, id_type: pa.DataType):
    """Each task's k best documents of every item, from rows sorted by shard."""

    def damp(lengths):
        return 25 + (75 * lengths.astype(np.int64) * n) // total

    def run(batches):
        items, of_term = shared.value
        heaps: list[list] = [[] for _ in items]
        numbers = None

        def finish(about, lists):
            ids, lengths = about["ids"].values, about["lengths"].values.to_numpy(zero_copy_only=False)
            damps = damp(lengths)
            by_id = np.empty(len(lengths), np.int64)
            by_id[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(lengths))
            asked = defaultdict(list)
            for term, x in lists.items():
                for item, weight in of_term[term]:
                    asked[item].append((x, weight))
            for item, own in asked.items():
                heap = heaps[item]

                def keep(docs, scores, heap=heap):
                    some = np.lexsort((by_id[docs], -scores))[:k]
                    heap.extend((int(s), ids[d].as_py()) for s, d in zip(scores[some], docs[some].tolist(), strict=True) if s > 0)
                    heap.sort(key=_order)
                    del heap[k:]

                _score(own, len(lengths), damps, lambda heap=heap: heap[-1][0] if len(heap) == k else 1, keep, window)

        about, lists = None, {}
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for r, (shard, term) in enumerate(zip(columns["shard"].to_pylist(), columns["term"].to_pylist(), strict=True)):
                if shard != numbers:
                    if about is not None:
                        finish(about, lists)
                    numbers, about, lists = shard, None, {}
                if term is None:
                    about = {c: columns[c][r] for c in ("ids", "lengths")}
                else:
                    ints = [columns[c][r].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("last", "at", "front_at", "front_tf", "front_n")]
                    lists[term] = _List(*ints, np.frombuffer(columns["postings"][r].as_py(), np.uint8), damp)
        if about is not None:
            finish(about, lists)
        rows = [(item, doc_id, score) for item, heap in zip(items, heaps, strict=True) for score, doc_id in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], id_type),
             pa.array([x[2] for x in rows], pa.int64())], names=["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, size: int) -> Iterator[list]:
    """Items with their terms, in blocks of bounded size, one at a time."""
    block, held = [], 0
    for row in items.toLocalIterator():
        if block and held + len(row["terms"]) > size:
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row["terms"])
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS, window: int = WINDOW_DOCS) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score.

    ``index`` comes from ``build_index``; ``items`` has item_id and text.
    """
    spark = index.sparkSession
    sizes = index.filter(F.col("term").isNull()).agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    terms = F.array_remove(F.split(ascii_lower(whole(F.col("text"))), PARTS), "")
    asked = written(items.select(F.monotonically_increasing_id().alias("item"), "item_id", terms.alias("terms")), "items")
    words = asked.select("item", F.explode("terms").alias("t")).groupBy("item", F.col("t").cast("binary").alias("term")).agg(
        F.count("*").alias("times"))
    words = written(words, "item-terms")
    vocabulary = written(words.select("term").distinct(), "asked-terms")
    held = index.join(vocabulary, "term", "left_semi")
    df = held.groupBy("term").agg(F.sum("df").alias("df"))
    weighed = words.join(df, "term").groupBy("item").agg(F.collect_list(F.struct("term", "times", "df")).alias("terms"))
    weighed = written(weighed, "weighed-items")

    doc_type = index.schema["ids"].dataType.elementType
    schema = StructType([StructField("item", asked.schema["item"].dataType), StructField("doc_id", doc_type),
                         StructField("score", asked.schema["item"].dataType)])
    path = fresh_dir(spark, "ranked")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(weighed, block_terms):
        names, of_term = [row["item"] for row in block], defaultdict(list)
        for q, row in enumerate(block):
            for t in row["terms"]:
                weight = math.floor(1000 * math.log((2 * sizes["n"] + 2) / (2 * t["df"] + 1)))
                if weight:
                    of_term[bytes(t["term"])].append((q, weight * t["times"]))
        shared = spark.sparkContext.broadcast((names, dict(of_term)))
        own = written(spark.createDataFrame([(t,) for t in of_term], "term binary"), "block-terms")
        rows = index.filter(F.col("term").isNull()).unionByName(index.join(own, "term", "left_semi").select(*index.columns))
        rows = rows.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        run = _search(shared, sizes["n"], sizes["total"], k, window, to_arrow_type(doc_type))
        rows.mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.unpersist()
    merged = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id,
  regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
a AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM b) GROUP BY q, t),
x AS (SELECT q, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM a JOIN f USING (t) JOIN p USING (t) JOIN d USING (r), s GROUP BY q, r),
k AS (SELECT q, r, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM x JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN b USING (q) JOIN d USING (r) WHERE rank <= 10
"""
