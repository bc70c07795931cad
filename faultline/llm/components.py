"""Connected components by alternating large-star and small-star.

Each step maps edges to edges and keeps components. Large-star joins every neighbour of a
node that is greater than it to the least of its neighbours and itself; small-star does so
for the neighbours that are not greater. When nothing changes, each node hangs on the least
node of its component. Steps are aggregations and key joins; what a step yields is written
to the shared folder, so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import free
from faultline.session import fresh_dir


def _store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """``edges`` point from the greater to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of ``links(a, b)``; the component is its least node.

    Loops and repeated links change nothing. Nodes without a link to another are absent.
    """
    edges = links.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = _store(edges, "star")
    mark = None
    while True:
        # Count and sums name the state: equal after a round means that nothing moved.
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now[0] == 0 or now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark, old = now, path
        edges, path = _store(_small(_large(edges)), "star")
        free(edges, old)
