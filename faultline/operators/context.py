"""Context blocks, prompts and model replies as batch columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions import clip_max, concat_str, round_to
from faultline.operators.windows import last_turns

# Texts of the context block and the prompt, and reply defaults.
NO_HITS = "No relevant incident data found in the knowledge base."
RULE = "─" * 44
PROMPT_RULE = "─" * 40
UNKNOWN = "Unknown"
DEFAULT_CONFIDENCE = 0.85
RERANKER_TOP = 4.0
NO_ROOT_CAUSE = "Unable to determine root cause."
REPLY_CONFIDENCE = 0.5
RCA_TASK = "Perform root cause analysis and return JSON."
RECOMMEND_TASK = "Generate remediation recommendations and return JSON."
SUMMARY_TASK = "Produce executive summary and return JSON."


def _ordered(order: str, value: Column) -> Column:
    """The values of a small group as an array sorted by ``order``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def build_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, context) for every query, with a fixed text where nothing was found.

    ``hits`` holds the ranked top-k rows, so the groups have at most k rows.
    """
    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    block = concat_str(
        "[Chunk ", F.col("rank"), "] ", text("service", UNKNOWN), " | ", text("severity", UNKNOWN), " | ",
        text("chunk_type", UNKNOWN), "\n", text("content", ""), "\n" + RULE,
    )
    built = hits.groupBy("query_id").agg(F.array_join(_ordered("rank", block), "\n").alias("context"))
    return queries.join(built, "query_id", "left").withColumn(
        "context", F.coalesce("context", F.lit(NO_HITS)))


def related_incidents(hits: DataFrame) -> DataFrame:
    """(query_id, related_incidents): distinct incident ids in order of first rank."""
    known = hits.filter(F.coalesce(F.col("incident_id").cast("string"), F.lit("")) != "")
    return known.groupBy("query_id").agg(
        F.array_distinct(_ordered("rank", F.col("incident_id").cast("string"))).alias("related_incidents"))


def first_seen(hits: DataFrame) -> DataFrame:
    """(query_id, incident_id, rank): the same order as rows."""
    return (
        hits.filter(F.coalesce(F.col("incident_id").cast("string"), F.lit("")) != "")
        .groupBy("query_id", "incident_id")
        .agg(F.min("rank").alias("rank"))
    )


def sources(hits: DataFrame) -> DataFrame:
    """Hits as source rows for display, with defaults for missing fields."""
    defaults = {"service": UNKNOWN, "severity": UNKNOWN, "chunk_type": UNKNOWN}
    out = []
    for f in schemas.CHUNK:
        if f.name == "embedding":
            continue
        known = F.col(f.name).cast("string") if f.name in hits.columns else F.lit(None).cast("string")
        out.append(F.coalesce(known, F.lit(defaults.get(f.name, ""))).alias(f.name))
    return hits.select("query_id", "rank", *out)


def retrieval_confidence(reranker: Column, score: Column) -> Column:
    """Reranker score over 4, else the search score, both clipped to 1; else the default."""
    return F.coalesce(
        round_to(clip_max(reranker / RERANKER_TOP, 1.0), 2),
        round_to(clip_max(score, 1.0), 2),
        F.lit(DEFAULT_CONFIDENCE),
    )


def confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, confidence) from each query's first hit."""
    reranker = F.col("reranker_score") if "reranker_score" in hits.columns else F.lit(None).cast("double")
    first = hits.filter(F.col("rank") == 1).select(
        "query_id", reranker.alias("_r"), F.col("score").alias("_s"))
    return queries.select("query_id").join(first, "query_id", "left").select(
        "query_id", retrieval_confidence(F.col("_r"), F.col("_s")).alias("confidence"))


def final_confidence(retrieval: Column, model: Column) -> Column:
    return round_to(F.greatest(retrieval, F.coalesce(model, retrieval)), 2)


def history_text(turns: DataFrame, n: int = 10) -> DataFrame:
    """(session_id, history): the last n turns as lines, oldest first."""
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(who, F.lit(": "), F.coalesce("content", F.lit("")))
    lines = last_turns(turns, n).groupBy("session_id").agg(
        F.array_join(_ordered("turn", line), "\n").alias("_lines"))
    return lines.select("session_id", concat_str(
        "\n[Conversation History]\n", F.col("_lines"), f"\n{PROMPT_RULE}\n").alias("history"))


def build_prompts(requests: DataFrame, turns: DataFrame, n: int = 10) -> DataFrame:
    """Requests (``session_id, context, question``) with the text sent to the model."""
    text = concat_str(
        "[Retrieved Context]\n", F.col("context"), f"\n\n{PROMPT_RULE}\n",
        F.coalesce("history", F.lit("")), "[Current Question]\n", F.col("question"))
    return requests.join(history_text(turns, n), "session_id", "left").withColumn("prompt", text).drop("history")


def _bullets(items: str) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")


def rca_prompt() -> Column:
    return concat_str("[Incident Context]\n", F.col("context"), "\n\n[User Question]\n",
                      F.col("question"), "\n\n" + RCA_TASK)


def recommendation_prompt() -> Column:
    return concat_str("[Root Cause Identified]\n", F.col("root_cause"), "\n\n[Incident Context]\n",
                      F.col("context"), "\n\n[Original Question]\n", F.col("question"),
                      "\n\n" + RECOMMEND_TASK)


def summary_prompt() -> Column:
    return concat_str("[Root Cause]\n", F.col("root_cause"), "\n\n[Immediate Actions]\n",
                      _bullets("immediate_actions"), "\n\n[Long-term Fixes]\n",
                      _bullets("long_term_fixes"), "\n\n[Original Question]\n", F.col("question"),
                      "\n\n" + SUMMARY_TASK)


def parse_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Decode JSON replies, with a default for each missing field."""
    none = F.array().cast("array<string>")
    defaults = {
        "root_cause": F.lit(NO_ROOT_CAUSE),
        "confidence": F.lit(REPLY_CONFIDENCE),
        "evidence": none,
        "immediate_actions": none,
        "long_term_fixes": none,
        "preventive_recommendations": none,
        "executive_summary": F.lit(""),
        "severity": F.lit(UNKNOWN),
        "business_impact": F.lit(""),
        "timeline": F.lit(""),
    }
    decoded = replies.withColumn("_r", F.from_json(F.col(reply), schemas.REPLY))
    kept = [c for c in replies.columns if c != reply]
    return decoded.select(*kept, *[
        F.coalesce(F.col(f"_r.{name}"), default).alias(name) for name, default in defaults.items()])
