"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.llm import (
    chat, decontamination, language_model, lexical_search, licenses, mixing, neardup, pii, quality, secrets, sharding,
    token_alignment, warc)
from faultline.llm.common import table
from faultline.session import fresh_dir


def op1_sharding(spark, d):
    return sharding.shard(table(spark, d, "documents"))


def op2_quality_rules(spark, d):
    return quality.judge(table(spark, d, "documents"))


def op3_decontamination(spark, d):
    hits = decontamination.find(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_chat_formatting(spark, d):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.conversations(chat.turns_as_tree(turns))
    read = out.select(
        F.col("tree").alias("conv_id"), chat.read_back(F.col("formatted")).alias("turns"),
        chat.masked(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def op5_language_model(spark, d):
    return language_model.score_split(table(spark, d, "documents"))


def op6_personal_data(spark, d):
    found = pii.detect(table(spark, d, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.concat("base", "added")).alias("spans"))


def op7_license_scans(spark, d):
    found = licenses.scan(table(spark, d, "documents"))
    return found.select("doc_id", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licenses", ",").alias("licenses"))


def op8_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents"))


def op9_warc(spark, d):
    path = fresh_dir(spark, "warc")
    token = warc.write_archives(table(spark, d, "pages"), path)
    return warc.digests(spark, path, token).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_near_duplicates(spark, d):
    return neardup.near_duplicates(table(spark, d, "documents"), size=2).drop("set_class")


def op11_lexical_search(spark, d):
    return lexical_search.search(lexical_search.build_index(table(spark, d, "documents")), table(spark, d, "benchmark"))


def op12_token_alignment(spark, d):
    return token_alignment.align(table(spark, d, "documents"))


def op13_secret_scans(spark, d):
    found = secrets.detect(table(spark, d, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(secrets.joined(base), 256).alias("base_sha256"),
                        secrets.joined(F.col("spans")).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_quality_rules, op3_decontamination, op4_chat_formatting, op5_language_model, op6_personal_data,
    op7_license_scans, op8_mixing, op9_warc, op10_near_duplicates, op11_lexical_search,
    op12_token_alignment, op13_secret_scans)}
ORACLES = {"op4_chat_formatting": chat.ORACLE, "op9_warc": warc.ORACLE, "op2_quality_rules": quality.ORACLE, "op3_decontamination": decontamination.ORACLE,
           "op10_near_duplicates": neardup.ORACLE, "op11_lexical_search": lexical_search.ORACLE}
