"""Exact nearest neighbours by cosine for a batch of query vectors.

The index is packed into tiles of rows where it lies, the queries into blocks; both are bounded.
Every task multiplies its tiles with the blocks it meets and keeps the ``k`` best rows of each
query, so the one shuffle carries at most k rows per query and task. The planner sends the
blocks to all tasks if their written size allows it, and otherwise deals both sides out over
tasks of their own. No query passes the driver.

A product of matrices adds up in an order that depends on a row's place. It only picks the
candidates, with some slack; their scores are then added up alike, so equal vectors tie exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from faultline.operators.windows import top_k
from faultline.session import written

NEIGHBOURS = 20
# Digits of a score that are shown, and the finer ones it is ranked by: beyond those, scores
# that are equal as fractions differ by the order of their sums.
SCORE_DIGITS = 6
RANK_DIGITS = 12
SLACK = 1e-9
# Bounds of a tile and a block, in vectors and in numbers.
TILE_ROWS = 4096
BLOCK_ROWS = 1024
NUMBERS = 1 << 18
# Numbers that the exact scores of candidates may take at once.
EXACT = 1 << 22


def _unit_lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


def _exact(rows: np.ndarray, queries: np.ndarray, r: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of row ``r[i]`` and query ``q[i]``, 0 where either is zero, to the digits of the ranking."""
    out = np.zeros(len(r))
    a_len, b_len = _unit_lengths(rows), _unit_lengths(queries)
    step = max(1, EXACT // max(1, rows.shape[1]))
    for at in range(0, len(r), step):
        i, j = r[at:at + step], q[at:at + step]
        length = a_len[i] * b_len[j]
        np.divide((rows[i] * queries[j]).sum(axis=1), length, out=out[at:at + step], where=length > 0)
    return np.round(out, RANK_DIGITS) + 0.0


class Nearest:
    """The ``k`` best rows of each query of a block so far: flat arrays of query, score and id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        length = _unit_lengths(queries)
        self.unit = np.divide(queries, length[:, None], out=np.zeros_like(queries), where=length[:, None] > 0)
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        length = _unit_lengths(rows)
        near = np.divide(rows @ self.unit.T, length[:, None], out=np.zeros((len(rows), len(self.unit))), where=length[:, None] > 0)
        bar = np.full(len(self.unit), -np.inf)
        held = np.bincount(self.q, minlength=len(bar))
        lowest = np.full(len(bar), np.inf)
        np.minimum.at(lowest, self.q, self.score)
        bar[held == self.k] = lowest[held == self.k]
        if len(rows) > self.k:
            np.maximum(bar, np.partition(near, len(rows) - self.k, axis=0)[len(rows) - self.k], out=bar)
        r, q = np.nonzero(near >= bar - SLACK)
        score = _exact(rows, self.queries, r, q)
        if self.ids is not None:
            q, score = np.concatenate([self.q, q]), np.concatenate([self.score, score])
            ids = np.concatenate([self.ids, ids[r]])
        else:
            ids = ids[r]
        order = np.lexsort((ids, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.score, self.ids = q[keep], score[order][keep], ids[order][keep]


def _packed(index: DataFrame) -> DataFrame:
    """Rows (id, embedding) in tiles: (ids, dims, numbers)."""
    id_type, value = index.schema["id"].dataType, index.schema["embedding"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("dims", T.LongType()), T.StructField("numbers", value)])
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = len(batch.column(1)[0])
            step = max(1, min(TILE_ROWS, NUMBERS // max(1, dims)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)

                def one(values, f):
                    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(f.type)

                yield pa.RecordBatch.from_arrays(
                    [one(part.column(0), arrow.field("ids")), pa.array([dims], pa.int64()), one(part.column(1).flatten(), arrow.field("numbers"))],
                    schema=arrow)

    return index.select("id", "embedding").mapInArrow(pack, schema)


def _scan(k: int, query_type: pa.DataType, id_type: pa.DataType):
    """A function over pairs of a tile and a block that emits each task's best."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[list, Nearest]] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                ids, dims, numbers, number, asked = (batch.column(c)[r] for c in range(5))
                number, dims = number.as_py(), dims.as_py()
                if number not in blocks:
                    queries = asked.values
                    matrix = queries.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    blocks[number] = queries.field("query_id").to_pylist(), Nearest(matrix.reshape(len(queries), -1), k)
                rows = numbers.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                blocks[number][1].add(np.asarray(ids.values.to_pylist()), rows)
        for names, best in blocks.values():
            if best.ids is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[q] for q in best.q.tolist()], query_type), pa.array(best.ids.tolist(), id_type), pa.array(best.score, pa.float64())],
                    names=["query_id", "id", "score"])

    return scan


def nearest_per_task(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each task's ``k`` best rows per query: (query_id, id, score)."""
    vectors = index.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    # Row numbers are gapless within a partition, so every block but a partition's last one is full.
    number, per_block = F.monotonically_increasing_id(), F.greatest(F.least(F.lit(BLOCK_ROWS), F.floor(NUMBERS / F.size("embedding"))), F.lit(1))
    part = F.shiftright(number, 33)
    block = (part * (1 << 33) + F.floor(number.bitwiseAND((1 << 33) - 1) / per_block)).alias("block")
    blocks = written(asked.select(block, "query_id", "embedding").groupBy("block").agg(
        F.collect_list(F.struct("query_id", "embedding")).alias("asked")), "query-blocks")
    schema = T.StructType([asked.schema["query_id"], vectors.schema["id"], T.StructField("score", T.DoubleType())])
    run = _scan(k, to_arrow_type(schema["query_id"].dataType), to_arrow_type(schema["id"].dataType))
    return _packed(vectors).crossJoin(blocks).mapInArrow(run, schema)


def knn(index: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The ``k`` nearest index rows per query: (query_id, id, score, rank).

    ``index`` has ``id`` and ``embedding``, ``queries`` has ``query_id`` and
    ``embedding``, all of one length. Rows without a vector take no part. Scores
    are cosines, shown to six digits; ties go to the smaller id. An index with
    computed vectors is best stored first: many queries may read it several times.
    """
    best = top_k(nearest_per_task(index, queries, k), ["query_id"], [F.col("score").desc(), F.col("id")], k)
    return best.withColumn("score", F.round("score", SCORE_DIGITS))
