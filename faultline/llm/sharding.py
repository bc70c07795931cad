"""Shards by a Feistel permutation of global row numbers.

Every row gets a gapless number that depends on its content alone. A keyed
permutation of ``0 .. rows-1`` shuffles the numbers, and the permuted number gives
both shard (remainder) and slot (quotient), so row counts differ by one at most and
either can be computed from the other without a lookup.

Numbering: a row's hash picks one of 1,024 groups and, in it, one of as many buckets
as keep a bucket near 50,000 rows. Bucket totals are summed up in two levels; a window
numbers the rows of a bucket. No window covers all rows, and a hot source or text does
not matter because the hash covers the document id. Only ids, sizes and hashes move.

Permutation: with ``a*b >= rows`` and ``a, b`` near the root, alternating rounds add a
keyed hash of one half to the other, modulo ``a`` or ``b``. At most ``sqrt(rows)`` numbers
of the grid lie outside the range; those walk the cycle until they come back inside. The
number of steps is proven before use (``_walk``).

Nulls: a null text has size 1 and checksum 0; a null id is an id of its own. Identical rows
take consecutive numbers, one each. An empty table gives no rows. Columns besides doc_id
and text play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm.common import whole
from faultline.operators.scan import Slices
from faultline.session import written

SHARDS = 16
SEED = 20_240_501
GROUPS = 1024
BUCKET_ROWS = 50_000
COPIES_AT_ONCE = 100_000
ROUNDS = 4
MAX_STEPS = 64


def _quotient(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def _half(x: Column, a: int, b: int, key: Column, tag: int) -> Column:
    """One round on an ``a`` by ``b`` grid; the halves change places."""
    left, right = _quotient(x, b), x % F.lit(b)
    return right * F.lit(a) + F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(tag)), F.lit(a)), F.lit(a))


def permuted(x: Column, a: int, b: int, seed: int) -> Column:
    """A keyed bijection of ``0 .. a*b-1``."""
    keys = F.array(*[F.lit(seed * 1000 + i).cast("long") for i in range(ROUNDS)])
    return F.aggregate(keys, x.cast("long"), lambda acc, k: _half(_half(acc, a, b, k, 0), b, a, k, 1))


def _walk(x: Column, rows: int, a: int, b: int, seed: int, steps: int) -> Column:
    """The permuted number, followed along its cycle while it lies outside the rows."""
    first = permuted(x, a, b, seed)
    if steps == 0:
        return first
    turn = lambda acc, _: F.when(acc < rows, acc).otherwise(permuted(acc, a, b, seed))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, turn)


def _grid(rows: int) -> tuple[int, int]:
    a = math.isqrt(max(rows - 1, 0)) + 1
    return a, -(-max(rows, 1) // a)


def position(number: DataFrame, rows: int, column: str = "number", seed: int = SEED) -> DataFrame:
    """Add ``position``: the permuted number within ``0 .. rows-1``.

    A walk visits each outside number once at most, so as many steps as there are
    outside numbers are always enough. Where that is more than ``MAX_STEPS``, a seed is
    taken for which the outside numbers themselves, about ``sqrt(rows)`` of them, are
    seen to come back in time.
    """
    a, b = _grid(rows)
    outside = a * b - rows
    steps = min(outside, MAX_STEPS)
    while outside > MAX_STEPS:
        spark = number.sparkSession
        late = spark.range(rows, a * b).filter(_walk(F.col("id"), rows, a, b, seed, steps - 1) >= rows)
        if late.isEmpty():
            break
        seed += 1
    return number.withColumn("position", _walk(F.col(column), rows, a, b, seed, steps))


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, size, text_crc32, _h, _copy (of rows with one id and text) and a gapless ``number`` for each row, and the row count."""
    text = whole(F.col("text"))
    keys = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(SEED)).alias("_h"))
    rows = written(keys.groupBy(*keys.columns).agg(F.count("*").alias("_n")), "shard-rows")
    total = rows.agg(F.sum("_n")).first()[0] or 0
    depth = max(1, total // (GROUPS * BUCKET_ROWS))
    rows = rows.withColumn("_group", F.pmod(F.col("_h"), F.lit(GROUPS))).withColumn(
        "_bucket", F.pmod(F.xxhash64(F.col("_h"), F.lit(1)), F.lit(depth)))
    place = ["_group", "_bucket"]
    buckets = rows.groupBy(*place).agg(F.sum("_n").alias("_b"))
    groups = buckets.groupBy("_group").agg(F.sum("_b").alias("_g"))
    # One row per group: 1,024 at any size.
    groups = groups.select("_group", (F.sum("_g").over(W.orderBy("_group")) - F.col("_g")).alias("_g0"))
    inside = W.partitionBy("_group").orderBy("_bucket")
    start = buckets.join(groups, "_group").select(
        *place, (F.col("_g0") + F.sum("_b").over(inside) - F.col("_b")).alias("_start"))
    order = W.partitionBy(*place).orderBy("_h", "doc_id", "size", "text_crc32")
    first = rows.withColumn("_first", F.sum("_n").over(order) - F.col("_n")).join(start, place)
    # Rows with very many copies are dealt out in steps, so that no task makes all copies of one row.
    step = COPIES_AT_ONCE
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(step).cast("long")))
    many = first.filter(F.col("_n") > step).withColumn("_from", steps).repartition("_h", "_from")
    blocks = first.filter(F.col("_n") <= step).withColumn("_from", F.lit(0).cast("long")).unionByName(many)
    copies = blocks.withColumn(
        "_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (step - 1), F.col("_n") - 1))))
    return copies.select(
        "doc_id", "size", "text_crc32", "_h", "_copy",
        (F.col("_start") + F.col("_first") + F.col("_copy")).alias("number")), total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    return _assigned(docs, shards, seed).drop("_h", "_copy", "position")


def _assigned(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    numbers, rows = numbered(docs)
    placed = position(numbers, rows, seed=seed)
    return placed.select(
        "doc_id", "size", "text_crc32", "_h", "_copy", "position", F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        _quotient(F.col("position"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the whole rows as Parquet, a folder per shard, with their slot.

    Rows that agree in id and text but not in their other columns each take one of the slots; rows
    that agree in all are counted once and written as often as they have slots. Columns called
    shard or slot give way. Large shards are split over tasks by slot.
    """
    spare = "_" * (1 + max(map(len, docs.columns)))  # names longer than all others are free
    row, key, doc, copies, upto, place, copy = (spare + x for x in "rkdcupn")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(SEED)).alias(key), F.xxhash64(*columns).alias(place), *columns)
    rows = rows.groupBy(key, place, *columns).agg(F.count("*").alias(copies))
    # The copies of one key are numbered on over its different rows, in slices of bounded size.
    slices = Slices.of(written(rows, "shard-whole-rows"), [key], [F.col(place)]).running_sum(**{upto: F.col(copies)})
    told = slices.done().withColumn(copy, F.explode(F.sequence(F.col(upto) - F.col(copies), F.col(upto) - 1)))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    told = told.select(key, copy, F.col("doc_id").alias(doc), F.struct(*[F.col(f"`{c}`") for c in kept]).alias(row))
    slots = _assigned(docs, shards, seed).select("doc_id", "_h", "_copy", "shard", "slot")
    same = (F.col(key) == F.col("_h")) & (F.col(copy) == F.col("_copy")) & F.col(doc).eqNullSafe(F.col("doc_id"))
    out = told.join(slots, same).select(f"{row}.*", "shard", "slot")
    out.repartition(F.col("shard"), F.floor(F.col("slot") / 100_000)).write.partitionBy("shard").parquet(path)
