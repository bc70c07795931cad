import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import chunks, context, keyed, textsearch, vectorsearch, windows
from faultline.operators.embed import embed, hashing_embedder
from faultline.plans import retrieval, sync
from faultline.sources import index_log, state

SUMMARY = ("incident_id string, service_name string, severity string, initial_symptom string, "
           "primary_root_cause_category string, duration_minutes long, incident_start_time string, "
           "updated_at string")


def summary(spark, ids, at="2026-01-05 12:00:00", symptom="disk full"):
    rows = [(i, "svc", "HIGH", symptom, "Memory Pressure", 7, "2026-01-05 10:00:00", at) for i in ids]
    df = spark.createDataFrame(rows, SUMMARY)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("incident_start_time", "updated_at")})


def reading(spark, ids, **kw):
    return summary(spark, ids, **kw).withColumnRenamed("primary_root_cause_category", "root_cause")


def test_chunks(spark):
    got = chunks.chunk_incidents(reading(spark, ["A"], symptom=None)).orderBy("id").collect()
    assert [r["id"] for r in got] == [f"incident_A_chunk_{n}" for n in (1, 2, 3)]
    footer = "\n\n[Source: Incident A | Service: svc | Severity: HIGH | Date: 2026-01-05]"
    assert got[0]["content"] == "Symptoms:\nNo symptom data available." + footer
    assert got[1]["content"] == "Root Cause:\nMemory Pressure" + footer
    assert got[2]["content"] == "Resolution:\nThe incident was resolved in 7 minutes." + footer
    made = chunks.to_search_doc(chunks.chunk_incidents(reading(spark, ["A"])))
    assert made.schema.simpleString() == schemas.index_schema().simpleString()
    assert "embedding" not in chunks.to_display(chunks.chunk_incidents(reading(spark, ["A"]))).columns


def test_documents_round_trip(spark, tmp_path):
    docs = chunks.render_documents(reading(spark, ["A", "", "B", None]))
    assert sorted(r["path"] for r in docs.collect()) == ["incident_A.txt", "incident_B.txt"]
    text = docs.filter("path = 'incident_A.txt'").first()["text"]
    assert text.startswith("Incident ID: A\n\n") and text.endswith("Duration:\n7 minutes.")
    chunks.write_documents(docs, str(tmp_path / "many"))
    (tmp_path / "single").mkdir()
    (tmp_path / "single" / "incident_A.txt").write_text(text)
    for path, one, ids in (("many", False, {"A", "B"}), ("single", True, {"A"})):
        got = chunks.parse_documents(chunks.read_documents(spark, str(tmp_path / path), one)).collect()
        assert {r["incident_id"] for r in got} == ids and len(got) == 3 * len(ids)
        first = next(r for r in got if r["id"] == "A_chunk_1")
        assert (first["service"], first["severity"], first["duration"]) == ("svc", "HIGH", "7 minutes.")
        assert first["chunk_type"] == "Symptoms" and first["content"] == "Symptoms:\ndisk full"


def test_documents_keep_any_value(spark, tmp_path):
    rng = random.Random(3)
    parts = ["\\", "\n", "\n\n", " ", "\t", "\r", "\f", "\v", "\x1e", "n", "a", "Symptoms:", "Incident ID:", "Severity:\n", "\\n", "é"]
    some = ["", "\n", "\\", "\\e", " ", "a\n\nRoot Cause:\nb", "a\n \nb", "\n\n\n", "C:\\new\\"]
    some += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    rows = [(f"{v}#{k}", some[-k - 1], v[::-1], v, some[k * 7 % len(some)], 5) for k, v in enumerate(some)]
    docs = chunks.render_documents(spark.createDataFrame(
        rows, "incident_id string, service_name string, severity string, initial_symptom string, root_cause string, duration_minutes long"))
    chunks.write_documents(docs, str(tmp_path / "many"))
    got = chunks.parse_documents(chunks.read_documents(spark, str(tmp_path / "many"))).collect()
    want = {(i, s, v, f"Symptoms:\n{a}", f"Root Cause:\n{b}") for i, s, v, a, b, _ in rows}
    by_id = {}
    for r in got:
        assert r["path"].startswith("file:") and r["duration"] == "5 minutes."
        by_id.setdefault(r["incident_id"], {})[r["chunk_type"]] = r
    assert len(got) == 3 * len(rows)
    assert {(i, c["Symptoms"]["service"], c["Symptoms"]["severity"], c["Symptoms"]["content"], c["Root Cause"]["content"])
            for i, c in by_id.items()} == want
    # Ordinary values stay as they are, and another writer's backslashes too.
    plain = docs.limit(1).select("path", F.lit("Incident ID: A\n\nAzure Service:\nC:\\new\n\nSymptoms:\nx\\ny").alias("text"))
    first = chunks.parse_documents(plain, escaped=False).first()
    assert (first["service"], first["content"]) == ("C:\\new", "Symptoms:\nx\\ny")


def test_seed_chunks(spark):
    seed = spark.createDataFrame([("INC-1", "s", "High", "d", "e", "r", "g", "a", "b", "c")],
                                 "incident_id string, service string, severity string, date string, environment string, "
                                 "region string, resource_group string, symptoms string, root_cause string, "
                                 "resolution string")
    got = {r["id"]: r["content"] for r in chunks.chunk_seed(seed).collect()}
    assert got == {"INC-1-symptoms": "Symptoms:\na", "INC-1-root_cause": "Root Cause:\nb",
                   "INC-1-resolution": "Resolution:\nc"}


def test_chunk_files(spark, tmp_path):
    made = chunks.chunk_incidents(reading(spark, ["A", "B"]))
    chunks.write_chunks(made, str(tmp_path / "c"))
    assert chunks.read_chunks(spark, str(tmp_path / "c")).count() == 6


def test_embedding_defaults_to_zeros(spark):
    df = spark.createDataFrame([("a",), (None,)], "content string")
    assert [list(r["embedding"]) for r in embed(df, None, 3).collect()] == [[0.0] * 3] * 2
    got = {r["content"]: list(r["embedding"]) for r in embed(df, hashing_embedder(3), 3).collect()}
    assert got[None] == [0.0] * 3 and sum(map(abs, got["a"])) == 1.0


WORDS = "disk full oom pod node timeout network the of and".split()


def corpus(seed, n):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(0, 30)))) for i in range(n)]


def brute_bm25(docs, queries):
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in docs}
    avg = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = {}
    for q, text in queries:
        for i, ws in words.items():
            tf = Counter(ws)
            terms = {w for w in re.findall(r"[^\W_]+", text.lower()) if w in tf}
            if terms:
                # Whole points per word: sums are exact, and ranks are those of the full scores.
                out[q, i] = sum(max(1, math.floor(
                    math.log(1 + (len(docs) - df[w] + .5) / (df[w] + .5))
                    * (tf[w] * 2.2 / (tf[w] + 1.2 * (.25 + .75 * len(ws) / avg))) * 1e9 + 0.5)) for w in terms) / 1e9
    return out


def ranked(scores, k):
    """Ranked on full scores, which are shown to six digits."""
    out = set()
    for q in {q for q, _ in scores}:
        mine = sorted(((-s, i) for (p, i), s in scores.items() if p == q))
        out |= {(q, i, round(-s, 6), n + 1) for n, (s, i) in enumerate(mine[:k])}
    return out


def brute_cosine(docs, queries, dims):
    fn = hashing_embedder(dims)
    a, b = fn([t for _, t in docs]).astype(float), fn([t for _, t in queries]).astype(float)
    norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    cos = np.divide(a @ b.T, norm, out=np.zeros((len(docs), len(queries))), where=norm > 0).round(12) + 0.0
    return {(q, i): float(cos[r, c]) for r, (i, _) in enumerate(docs) for c, (q, _) in enumerate(queries)}


QUERIES = [(1, "disk full"), (2, "the the OOM"), (3, "absent"), (4, "of and the node pod")]


def frames(spark, docs, dims=16, ids="long"):
    index = spark.createDataFrame(docs, f"id {ids}, content string").repartition(5)
    asked = spark.createDataFrame(QUERIES, "query_id long, question string")
    return embed(index, hashing_embedder(dims), dims), embed(asked, hashing_embedder(dims), dims, text="question")


def test_bm25_against_brute_force(spark):
    docs = corpus(1, 80)
    index, asked = frames(spark, docs)
    got = {tuple(r) for r in textsearch.bm25(index, asked, 7).collect()}
    assert got == ranked(brute_bm25(docs, QUERIES), 7)


def test_bm25_of_many_tiles_and_blocks(spark, monkeypatch):
    """Small tiles and blocks, text ids, copies that tie, and both ways the planner may pair the two sides."""
    docs = [(f"d{i}", t) for i, t in corpus(7, 150)] + [(f"c{i}", "node pod node disk") for i in range(60)] + [("e", ""), ("n", None)]
    index = spark.createDataFrame(docs, "id string, content string").repartition(6)
    asked = spark.createDataFrame([(str(q), t) for q, t in QUERIES] + [("none", None)], "query_id string, question string")
    want = ranked(brute_bm25([(i, t or "") for i, t in docs], [(str(q), t) for q, t in QUERIES]), 9)
    monkeypatch.setattr(textsearch, "TILE_TEXTS", 7)
    monkeypatch.setattr(textsearch, "BLOCK_WORDS", 2)
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert {tuple(r) for r in textsearch.bm25(index, asked, 9).collect()} == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bm25_without_texts_or_questions(spark):
    docs = corpus(1, 10)
    index, asked = frames(spark, docs)
    assert textsearch.bm25(index.limit(0), asked, 3).count() == 0
    assert textsearch.bm25(index, asked.limit(0), 3).count() == 0


def test_tasks_hand_on_k_texts_per_question(spark):
    """No row per question and text: what the tasks emit, and so what is shuffled, is bounded by k."""
    docs = corpus(5, 3000)
    index, asked = frames(spark, docs, 4)
    keywords = textsearch.keyword_index(index, asked)
    found = textsearch.leaders(keywords, 3).withColumn("task", F.spark_partition_id())
    per_task = found.groupBy("task", "query_id").count().collect()
    hits = len(brute_bm25(docs, QUERIES))
    assert per_task and max(r["count"] for r in per_task) <= 3
    assert found.count() <= 3 * len(QUERIES) * found.rdd.getNumPartitions() < hits / 10


def test_pruned_words_are_only_looked_up():
    """A frequent word's texts are not walked through once a rare word has set the threshold."""
    ids = list(range(4000))
    places = np.concatenate([np.arange(4000), [5, 9, 30]])
    tile = textsearch.Tile(pa.array(ids), np.array([1, 2]), np.array([0, 4000, 4003]), places, np.ones(4003), np.ones(2))
    best = textsearch.Best(2)
    weights = np.array([1, 2]), np.array([0.01, 5.0])
    best.add(tile, *tile.scores(*weights, best.bar()))
    assert [i for _, i in best.hits] == [5, 9]
    tile.probed = 0
    places, points = tile.scores(*weights, best.bar())
    assert places.tolist() == [5, 9, 30] and len(set(points.tolist())) == 1 and tile.probed == 6


@pytest.mark.parametrize("numbers,exact", [(1 << 18, 1 << 22), (16, 1 << 22), (1 << 18, 40)])
def test_knn_against_brute_force(spark, monkeypatch, numbers, exact):
    """Also with bounds that let one query and one row meet, or two scores be added up at a time."""
    monkeypatch.setattr(vectorsearch, "NUMBERS", numbers)
    monkeypatch.setattr(vectorsearch, "EXACT", exact)
    docs = corpus(2, 90)
    index, asked = frames(spark, docs)
    want = ranked(brute_cosine(docs, QUERIES, 16), 6)
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            assert {tuple(r) for r in vectorsearch.knn(index, asked, 6).collect()} == want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_equal_vectors_tie_wherever_they_lie(spark):
    """More copies than a tile has rows: the smallest ids win."""
    rnd = np.random.default_rng(3)
    one, others = rnd.normal(size=24), rnd.normal(size=(500, 24))
    rows = [(f"v{k:05d}", one.tolist()) for k in range(6000)] + [(f"o{k}", v.tolist()) for k, v in enumerate(others)]
    index = spark.createDataFrame(rows, "id string, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(k, (one + 0.01 * k).tolist()) for k in range(40)], "query_id long, embedding array<double>")
    got = vectorsearch.knn(index, asked, 5).collect()
    for k in range(40):
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == k] == [f"v{n:05d}" for n in range(5)]


def test_knn_hands_on_k_rows_per_query_and_task(spark):
    docs = corpus(2, 2000)
    index, asked = frames(spark, docs)
    found = vectorsearch.nearest_per_task(index, asked, 4).withColumn("task", F.spark_partition_id())
    assert max(r["count"] for r in found.groupBy("task", "query_id").count().collect()) <= 4


def test_knn_text_ids_null_vectors_and_no_queries(spark):
    index = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)],
                                  "id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], "query_id string, embedding array<float>")
    got = vectorsearch.knn(index, asked, 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [("a", 1.0), ("b", 1.0), ("z", 0.0)]
    assert vectorsearch.knn(index, asked.filter("query_id = 'none'"), 3).count() == 0


def test_hybrid_against_brute_force(spark):
    docs = corpus(3, 120)
    index, asked = frames(spark, docs)
    keyword = {(q, i): n for q, i, _, n in ranked(brute_bm25(docs, QUERIES), 10**6)}
    vector = {(q, i): n for q, i, _, n in ranked(brute_cosine(docs, QUERIES, 16), 4)}
    fused = {key: sum(1 / (60 + ranks[key]) for ranks in (keyword, vector) if key in ranks)
             for key in {*keyword, *vector}}
    got = {tuple(r) for r in retrieval.hybrid(index, asked, 3, neighbours=4).collect()}
    assert got == {(q, i, round(s, 6), n) for q, i, s, n in ranked(fused, 3)}


def test_retrieve_chooses_by_vector_and_filters(spark):
    docs = corpus(4, 60)
    index, asked = frames(spark, docs)
    index = index.withColumn("service", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    some = asked.withColumn("embedding", F.when(F.col("query_id") != 1, F.col("embedding")))
    got = retrieval.retrieve(index, some, 5).collect()
    keyword = {tuple(r) for r in textsearch.bm25(index, some.filter("query_id = 1"), 5).collect()}
    assert {(r["query_id"], r["id"], r["score"], r["rank"]) for r in got if r["query_id"] == 1} == keyword
    assert all(r["score"] < 0.05 for r in got if r["query_id"] != 1)
    only = retrieval.retrieve(index, some.drop("embedding"), 5, service="even").collect()
    assert only and all(r["id"] % 2 == 0 for r in only)


def test_facets(spark):
    index = spark.createDataFrame([("a", "HIGH"), ("a", None), ("b", "HIGH")], "service string, severity string")
    got = {tuple(r) for r in retrieval.facets(index).collect()}
    assert got == {("service", "a", 2), ("service", "b", 1), ("severity", "HIGH", 2), ("severity", None, 1)}


HITS = "query_id long, rank int, incident_id string, service string, severity string, chunk_type string, content string"


def test_context_and_related(spark):
    hits = spark.createDataFrame([
        (1, 2, "B", "s", None, "Root Cause", "two"), (1, 1, "A", "s", "HIGH", "Symptoms", "one"),
        (1, 3, "A", "s", "HIGH", "Symptoms", None), (1, 4, "", "s", "HIGH", "Symptoms", "x")], HITS)
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r["query_id"]: r["context"] for r in context.build_context(asked, hits.filter("rank < 4")).collect()}
    rule = "─" * 44
    assert got[1] == (f"[Chunk 1] s | HIGH | Symptoms\none\n{rule}\n[Chunk 2] s | Unknown | Root Cause\ntwo\n{rule}\n"
                      f"[Chunk 3] s | HIGH | Symptoms\n\n{rule}")
    assert got[2] == "No relevant incident data found in the knowledge base."
    assert context.related_incidents(hits).first()["related_incidents"] == ["A", "B"]
    assert {tuple(r) for r in context.first_seen(hits).collect()} == {(1, "A", 1), (1, "B", 2)}
    assert context.sources(hits).filter("rank = 2").first()["severity"] == "Unknown"


@pytest.mark.parametrize("reranker,score,want", [(3.2, None, 0.8), (9.0, None, 1.0), (None, 0.03, 0.03), (None, None, 0.85)])
def test_confidence(spark, reranker, score, want):
    hits = spark.createDataFrame([(1, 1, reranker, score)],
                                 "query_id long, rank int, reranker_score double, score double")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = {r["query_id"]: r["confidence"] for r in context.confidence(asked, hits).collect()}
    assert got == {1: want, 2: 0.85}
    final = hits.select(context.final_confidence(F.lit(0.4), F.lit(0.9)).alias("a"),
                        context.final_confidence(F.lit(0.4), F.lit(None).cast("double")).alias("b")).first()
    assert tuple(final) == (0.9, 0.4)


def test_history_and_prompt(spark):
    turns = spark.createDataFrame([("s", i, "user" if i % 2 else "assistant", f"t{i}") for i in range(1, 13)],
                                  "session_id string, turn long, role string, content string")
    kept = windows.last_turns(turns)
    assert sorted(r["turn"] for r in kept.collect()) == list(range(3, 13))
    asked = spark.createDataFrame([("s", "C", "why?"), ("new", "C", "why?")],
                                  "session_id string, context string, question string")
    got = {r["session_id"]: r["prompt"] for r in context.build_prompts(asked, turns, 2).collect()}
    rule = "─" * 40
    assert got["new"] == f"[Retrieved Context]\nC\n\n{rule}\n[Current Question]\nwhy?"
    assert got["s"] == (f"[Retrieved Context]\nC\n\n{rule}\n\n[Conversation History]\nUser: t11\nAssistant: t12\n{rule}\n"
                        "[Current Question]\nwhy?")


def test_replies_and_stage_prompts(spark):
    replies = spark.createDataFrame([(1, '{"root_cause":"x"}'), (2, "broken"), (3, '{"severity":"Low","evidence":["a"]}')],
                                    "n int, reply string")
    got = {r["n"]: r for r in context.parse_replies(replies).collect()}
    assert (got[1]["root_cause"], got[1]["confidence"], got[1]["evidence"]) == ("x", 0.5, [])
    assert got[2]["root_cause"] == "Unable to determine root cause." and got[2]["severity"] == "Unknown"
    assert (got[3]["severity"], got[3]["evidence"]) == ("Low", ["a"])
    row = spark.createDataFrame([("c", "q", "r", ["a", "b"], ["f"])],
                                "context string, question string, root_cause string, immediate_actions array<string>, "
                                "long_term_fixes array<string>")
    a, b, c = row.select(context.rca_prompt(), context.recommendation_prompt(), context.summary_prompt()).first()
    assert a == "[Incident Context]\nc\n\n[User Question]\nq\n\nPerform root cause analysis and return JSON."
    assert b.startswith("[Root Cause Identified]\nr\n\n[Incident Context]\nc\n\n[Original Question]\nq\n\n")
    assert "[Immediate Actions]\n- a\n- b\n\n[Long-term Fixes]\n- f\n\n" in c


def test_running_mean(spark):
    rnd = random.Random(1)
    data = [(i, rnd.randrange(100)) for i in range(1, 500)]
    got = windows.running_mean(spark.createDataFrame(data, "n long, v long"), "v", "n", slice_rows=37).collect()
    total = 0
    means = {}
    for i, v in data:
        total += v
        means[i] = total / i
    assert {r["n"]: r["running_mean"] for r in got} == means


def chunk_ids(df):
    return sorted(r["id"] for r in df.collect())


def test_sync_replaces_inserts_and_removes(spark):
    old = sync.index_rows(reading(spark, ["A", "B", "C"], symptom="old"), None, 2)
    mart = summary(spark, ["B", "C", "D"], symptom="new")
    assert [r[0] for r in keyed.orphan_ids(old, mart).collect()] == ["A"]
    once = sync.sync_index(mart, old, dims=2)
    assert {r["incident_id"] for r in once.collect()} == {"B", "C", "D"} and once.count() == 9
    assert all("new" in r["content"] for r in once.filter("chunk_type = 'Symptoms'").collect())
    twice = sync.sync_index(mart, once, dims=2)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    assert keyed.difference(keyed.distinct_ids(once), keyed.distinct_ids(mart)).count() == 0


def rows(spark, path):
    return {r["id"]: r["content"] for r in index_log.read_index(spark, path).collect()}


def stored(spark, ids, symptom, at="2026-01-05 12:00:00"):
    return sync.index_rows(reading(spark, ids, at=at, symptom=symptom), None, 2)


def test_two_writers_and_a_snapshot_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    none = stored(spark, ["A"], "x").filter("false")
    with monkeypatch.context() as both:
        both.setattr(index_log, "last_version", lambda *_: -1)
        index_log.append_changes(path, stored(spark, ["A"], "one"), none)
        index_log.append_changes(path, stored(spark, ["B"], "two"), none)
    assert {i[:10] for i in rows(spark, path)} == {"incident_A", "incident_B"}
    index_log.compact(spark, path)
    assert {i[:10] for i in rows(spark, path)} == {"incident_A", "incident_B"}
    # Of the snapshot's own number, as if committed while it was written: it stays on top.
    assert index_log.last_version(spark, path) == 1
    monkeypatch.setattr(index_log, "last_version", lambda *_: 0)
    index_log.append_changes(path, stored(spark, ["A"], "three"), none)
    assert "three" in rows(spark, path)["incident_A_chunk_1"]


def test_stream_batches_after_a_sync_and_a_snapshot(spark, tmp_path):
    path, mark = str(tmp_path / "index"), str(tmp_path / "mark")
    sync.run_sync(spark, summary(spark, ["A", "B"], symptom="old"), path, mark, None, 2)
    mart = summary(spark, ["B", "C"], symptom="new")
    apply = sync.sync_index_batch(path, None, 2, mart=lambda: mart)
    apply(mart.filter("incident_id = 'C'"), 0)
    assert {i[:10] for i in rows(spark, path)} == {"incident_B", "incident_C"}
    index_log.compact(spark, path)
    apply(mart, 1)
    assert {i[:10] for i in rows(spark, path)} == {"incident_B", "incident_C"}
    assert "new" in rows(spark, path)["incident_B_chunk_1"]
    # A repeated batch is known by its commit.
    before = index_log.last_version(spark, path)
    apply(summary(spark, ["B"], symptom="never"), 1)
    assert index_log.last_version(spark, path) == before and "new" in rows(spark, path)["incident_B_chunk_1"]


def test_stored_sync(spark, tmp_path):
    path, mark = str(tmp_path / "index"), str(tmp_path / "mark")
    assert state.load_mark(spark, mark) == state.EPOCH and index_log.read_index(spark, path).count() == 0
    sync.run_sync(spark, summary(spark, ["A", "B"], symptom="old"), path, mark, hashing_embedder(2), 2)
    assert state.load_mark(spark, mark).startswith("2026-01-05 12:00:00")
    later = summary(spark, ["C"], at="2026-01-06 00:00:00", symptom="new").unionByName(
        summary(spark, ["B"], symptom="late, of the mark's own time"))
    sync.run_sync(spark, later, path, mark, hashing_embedder(2), 2)
    index = index_log.read_index(spark, path)
    assert {r["incident_id"] for r in index.collect()} == {"B", "C"}
    text = {r["service"] + r["incident_id"]: r["content"] for r in index.filter("chunk_type = 'Symptoms'").collect()}
    assert "late" in text["svcB"] and "new" in text["svcC"]
    before = sorted(map(str, index.collect()))
    assert index_log.last_version(spark, path) == 1
    sync.run_sync(spark, later, path, mark, hashing_embedder(2), 2)
    assert sorted(map(str, index_log.read_index(spark, path).collect())) == before
    assert index_log.last_version(spark, path) == 1
    index_log.compact(spark, path)
    assert sorted(map(str, index_log.read_index(spark, path).collect())) == before
    assert [r["incident_id"] for r in sync.read_since(later, "2026-01-05 13:00:00").collect()] == ["C"]
