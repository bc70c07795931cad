"""Keyword, vector and hybrid retrieval over one index."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.textsearch import KeywordIndex, best_hits, bm25, keyword_index, leaders, points_of, shown
from faultline.operators.vectorsearch import NEIGHBOURS, knn
from faultline.operators.windows import top_k
from faultline.session import written

TOP_K = 5
# Fixed value: the usual constant of reciprocal-rank fusion.
RRF = 60
SCORE_DIGITS = 6
FACETS = ["service", "severity", "date", "environment"]


def metadata_filter(df: DataFrame, service: str | None = None, severity: str | None = None) -> DataFrame:
    """Keep rows of the given service and severity; an empty value does not filter."""
    for name, value in (("service", service), ("severity", severity)):
        if value:
            df = df.filter(F.col(name) == value)
    return df


def _fused(keyword_rank: Column, vector_rank: Column) -> Column:
    def part(rank: Column) -> Column:
        return F.coalesce(1.0 / (RRF + rank), F.lit(0.0))

    return part(keyword_rank) + part(vector_rank)


def hybrid(index: DataFrame, queries: DataFrame, k: int = TOP_K, neighbours: int = NEIGHBOURS,
           keywords: KeywordIndex | None = None) -> DataFrame:
    """Reciprocal-rank fusion of keyword and vector search: (query_id, id, score, rank).

    A text's score is the sum of 1 / (60 + rank) over its rank among all keyword
    hits and its rank among the ``neighbours`` nearest vectors. Keyword hits are
    never cut for it. A text outside the vector list can reach the top k only
    from the first k + neighbours keyword ranks. For the few texts in the vector
    list the exact keyword rank is an order statistic: their scores go to the tasks
    that score the texts, and only the counts of what stands before them come back.

    ``keywords`` holds the counted words of these questions, if they are at hand.
    """
    asked = queries.select("query_id", "question", "embedding")
    near = knn(index, asked, neighbours).select("query_id", "id", F.col("rank").alias("vector_rank"))
    near = written(near, "neighbours")
    keywords = keywords or keyword_index(index, asked)
    mine = written(points_of(keywords, near), "neighbour-points")
    found = written(leaders(keywords, k + neighbours, mine), "keyword-leaders")

    first = best_hits(found, k + neighbours).select("query_id", "id", F.col("rank").alias("keyword_rank"))
    counted = found.filter(F.col("ahead").isNotNull()).groupBy("query_id", "id").agg(F.sum("ahead").alias("keyword_rank"))
    ranks = (
        first.unionByName(counted)
        .unionByName(near, allowMissingColumns=True)
        .groupBy("query_id", "id")
        .agg(F.min("keyword_rank").alias("keyword_rank"), F.min("vector_rank").alias("vector_rank"))
    )
    scored = ranks.select(
        "query_id", "id", _fused(F.col("keyword_rank"), F.col("vector_rank")).alias("score"))
    # Ranked on the full score: far down the lists neighbours differ by less than the output shows.
    best = top_k(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k)
    return best.withColumn("score", F.round("score", SCORE_DIGITS))


def retrieve(index: DataFrame, queries: DataFrame, k: int = TOP_K, service: str | None = None,
             severity: str | None = None) -> DataFrame:
    """The best chunks per question, with their metadata.

    Questions with a vector use hybrid search, the others keyword search.
    """
    within = metadata_filter(index, service, severity)
    if "embedding" not in queries.columns or "embedding" not in index.columns:
        return attach_chunks(bm25(within, queries, k), within)
    # One pass over the texts counts the words of all questions; each then takes its own way.
    asked = written(queries.select("query_id", "question", "embedding"), "questions")
    keywords = keyword_index(within, asked)
    has_vector = F.col("embedding").isNotNull()
    keyword_only, both = asked.filter(~has_vector), asked.filter(has_vector)

    def of(some: DataFrame) -> KeywordIndex:
        return replace(keywords, words=keywords.words.join(some.select("query_id"), "query_id", "left_semi"))

    plain = best_hits(leaders(of(keyword_only), k), k).select(
        "query_id", "id", shown(F.col("points")).alias("score"), "rank")
    return attach_chunks(plain.unionByName(hybrid(within, both, k, keywords=of(both))), within)


def attach_chunks(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Ranked hits with the index columns, without the vector.

    The hits are k rows per question. Written out, their true size is known when
    the join is planned: they are broadcast if small, and the index, which is
    large, is then read without a shuffle.
    """
    return index.drop("embedding").join(written(hits, "hits"), "id")


def facets(index: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, value, count) for the facet fields, in one pass over the index."""
    fields = [f for f in (fields or FACETS) if f in index.columns]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return (
        index.select(pairs.alias("p"))
        .groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value"))
        .agg(F.count("*").alias("count"))
    )
