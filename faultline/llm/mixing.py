"""Mixing sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow
network routes words from patterns to source quotas: the first use of a pattern's words is
free, each further one costs more, so repetition is spread as thinly as the quotas allow.
The flow says how many words of each pattern to take; a seeded order of its documents says
which ones.

Scale: the driver sees one row per pattern, at most ``MAX_PATTERNS`` (more is an error),
never a document. A pattern's documents are cut into ``BUCKETS`` hash buckets; only the
bucket in which the quota ends is sorted, so a hot source is never ordered as a whole.

A quota is met to within half a document. Nulls: a null text has size 0 and is taken 0
times; a null source is a source of its own, last in order. Rows that repeat are rows of
their own. An empty table gives no rows. Other columns play no part and, in
``mixed_documents``, are returned as they came, once for each time a document is taken.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm.common import WORD, whole
from faultline.session import written

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2.0
SEED = 20_240_502
BUCKETS = 16_384
MAX_PATTERNS = 100_000


def quotas(sizes: dict[str | None, float], weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> dict:
    """Words for each source: a share by weight, none above ``most`` times its size.

    Sources weigh by code point order, null last. What a source cannot take is shared
    again by weight among the others until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    limit = {s: most * sizes[s] for s in order}
    full: set = set()
    while True:
        rest = total * sum(sizes.values()) - sum(limit[s] for s in full)
        unit = sum(weight[s] for s in order if s not in full)
        target = {s: limit[s] if s in full else rest * weight[s] / unit for s in order}
        over = {s for s in order if s not in full and target[s] > limit[s]}
        if not over:
            return target
        full |= over


class _Network:
    """Successive shortest paths with potentials; capacities may be fractions."""

    def __init__(self):
        self.edges: list[list] = []
        self.at: dict = defaultdict(list)

    def edge(self, a, b, capacity: float, cost: float) -> int:
        self.at[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.at[b].append(len(self.edges))
        self.edges.append([a, 0.0, -cost])
        return len(self.edges) - 2

    def run(self, source, sink, least: float = 1e-6) -> None:
        high: dict = defaultdict(float)
        while True:
            cost, via, queue, tick = {source: 0.0}, {}, [(0.0, 0, source)], 0
            while queue:
                d, _, a = heapq.heappop(queue)
                if d > cost[a]:
                    continue
                for e in self.at[a]:
                    b, left, price = self.edges[e]
                    if left > least and (c := d + max(0.0, price + high[a] - high[b])) < cost.get(b, float("inf")) - 1e-12:
                        cost[b], via[b], tick = c, e, tick + 1
                        heapq.heappush(queue, (c, tick, b))
            if sink not in cost:
                return
            for a, c in cost.items():
                high[a] += c
            path, a = [], sink
            while a != source:
                path.append(via[a])
                a = self.edges[via[a] ^ 1][0]
            amount = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= amount
                self.edges[e ^ 1][1] += amount


def route(patterns: dict[str, float], target: dict[str | None, float], most: float = MOST) -> dict[str, float]:
    """Words to take of each pattern.

    Patterns that share no source, directly or through others, are solved apart. The cost
    of a use is the number of uses before it, so costs are convex in repetition.
    """
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    members = {p: json.loads(p) for p in patterns}
    for sources in members.values():
        for s in sources[1:]:
            parent[root(("s", s))] = root(("s", sources[0]))
    parts: dict = defaultdict(list)
    for p, sources in sorted(members.items()):
        parts[root(("s", sources[0]))].append(p)
    taken = {}
    for own in parts.values():
        net, uses = _Network(), defaultdict(list)
        for p in own:
            left, use = most, 0
            while left > 1e-9:
                uses[p].append(net.edge("from", ("p", p), patterns[p] * min(1.0, left), float(use)))
                left, use = left - 1, use + 1
            for s in members[p]:
                net.edge(("p", p), ("s", s), float("inf"), 0.0)
        for s in {s for p in own for s in members[p]}:
            net.edge(("s", s), "to", target[s], 0.0)
        net.run("from", "to")
        for p in own:
            taken[p] = sum(net.edges[e ^ 1][1] for e in uses[p])
    return taken


def _sized(docs: DataFrame, keep: list[Column], sources: Column | None, seed: int) -> DataFrame:
    members = F.array(F.col("source")) if sources is None else F.array_sort(F.array_distinct(sources))
    return docs.select(
        *keep, F.regexp_count(whole(F.col("text")), F.lit(WORD)).cast("long").alias("_size"),
        F.to_json(members, {"ignoreNullFields": "false"}).alias("_pattern"),
        F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("_h"),
    ).withColumn("_bucket", F.pmod(F.xxhash64("_h"), F.lit(BUCKETS)).cast("int"))


def _plan(rows: DataFrame, weights, total: float, most: float) -> DataFrame:
    """A row per pattern: uses of all its documents, the bucket in which the rest ends, what is left for it."""
    spark = rows.sparkSession
    buckets = written(rows.groupBy("_pattern", "_bucket").agg(F.sum("_size").alias("_b")), "mix-buckets")
    sums = buckets.groupBy("_pattern").agg(F.sum("_b").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {r["_pattern"]: float(r["n"]) for r in sums}
    sizes: dict = defaultdict(float)
    for p, n in patterns.items():
        for s in json.loads(p):
            sizes[s] += n
    target = quotas(sizes, weights, total, most)
    taken = route(patterns, target, most)
    plan = []
    for p, n in patterns.items():
        base = int(taken[p] // n) if n else 0
        rest = taken[p] - base * n if base < most else 0.0
        own = json.loads(p)
        plan.append((p, int(sum(sizes[s] for s in own)), float(sum(target[s] for s in own)), base, rest))
    plan = spark.createDataFrame(
        plan, "_pattern string, source_size long, target double, _base int, _rest double")
    running = W.partitionBy("_pattern").orderBy("_bucket")
    ends = buckets.withColumn("_to", F.sum("_b").over(running)).join(plan, "_pattern").filter(F.col("_to") >= F.col("_rest"))
    end = ends.groupBy("_pattern").agg(F.min(F.struct("_bucket", (F.col("_to") - F.col("_b")).alias("_before"))).alias("_e"))
    return written(plan.join(end, "_pattern", "left").select(
        "_pattern", "source_size", "target", "_base",
        F.coalesce(F.col("_e._bucket"), F.lit(BUCKETS)).alias("_end"),
        F.coalesce(F.col("_rest") - F.col("_e._before"), F.lit(0.0)).alias("_need")), "mix-plan")


def _times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``_times``, how often each row is taken."""
    placed = rows.join(plan, "_pattern")
    clear = placed.filter(F.col("_bucket") != F.col("_end")).withColumn(
        "_times", F.col("_base") + (F.col("_bucket") < F.col("_end")).cast("int"))
    order = W.partitionBy("_pattern").orderBy("_h").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(order), F.lit(0))
    edge = placed.filter(F.col("_bucket") == F.col("_end")).withColumn(
        "_times", F.col("_base") + (before + F.col("_size") / 2 < F.col("_need")).cast("int"))
    return clear.unionByName(edge)


def mix(docs: DataFrame, sources: Column | None = None, weights=WEIGHTS, total: float = TOTAL,
        most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and times for every row.

    ``sources`` is an array of the sources a row belongs to, its ``source`` by default. For
    rows of several sources, source_size and target are sums over them.
    """
    rows = written(_sized(docs, [F.col("doc_id")], sources, seed), "mix-rows")
    out = _times(rows, _plan(rows, weights, total, most))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                      (F.col("_times") * F.col("_size")).cast("long").alias("taken"), F.col("_times").alias("times"))


def mixed_documents(docs: DataFrame, sources: Column | None = None, weights=WEIGHTS, total: float = TOTAL,
                    most: float = MOST, seed: int = SEED) -> DataFrame:
    """The taken rows with their columns, each as often as it is taken."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    plan = _plan(_sized(docs, [], sources, seed), weights, total, most)
    rows = _times(_sized(docs, [row], sources, seed), plan).filter(F.col("_times") > 0)
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_use")).select("_row.*")
