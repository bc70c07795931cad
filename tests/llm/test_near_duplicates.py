"""Near duplicates where ids repeat or are no numbers, and the measured recall of pairs near the threshold."""

import random
from collections import Counter

from pyspark.sql import functions as F

from faultline.llm import neardup

A = " ".join(f"a{k}" for k in range(60))
B = " ".join(f"b{k}" for k in range(60))
COLUMNS = "doc_id long, text string, lang string, class string, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "c", 1) for i, t, x in rows], COLUMNS)


def kept(df):
    return Counter((r["doc_id"], r["text"], r["lang"]) for r in df.collect())


def test_an_id_with_two_texts_loses_none(spark):
    rows = [(3, A, "en"), (5, A + " end", "en"), (5, B, "de"), (7, B + " end", "en")]
    found = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert found == {(3, 3), (5, 3), (5, 5), (7, 5)}
    assert kept(neardup.distinct_documents(frame(spark, rows))) == Counter([(3, A, "en"), (5, B, "de")])


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, A, "en")] * 3 + [(1, A, "fr"), (1, A + "  ", "en"), (1, A + " end", "en"), (2, A, "en"), (4, B, "de"), (None, A, "en"), (None, A, "en")]
    out = kept(neardup.distinct_documents(frame(spark, rows)))
    assert sum(n for (i, _, _), n in out.items() if i == 1) == 1 and out[4, B, "de"] == 1 and out[None, A, "en"] == 2
    assert not any(i == 2 for i, _, _ in out)
    assert out == kept(neardup.distinct_documents(frame(spark, rows[::-1]).repartition(3)))


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("x", A), ("b", A + " end"), ("c", B), (None, B)], "doc_id string, text string")
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    assert found == {("x", "b", False), ("b", "b", True), ("c", "c", True), (None, None, True)}
    assert {r["doc_id"] for r in neardup.distinct_documents(docs).collect()} == {"b", "c", None}


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of a similarity from 0.8 up to 0.84: none of 300 is missed, and none below 0.8 is linked."""
    rng, rows, linked = random.Random(12), [], set()
    for k in range(600):
        n = 200
        words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        other = list(words)
        # One changed word inside changes two shingles of two words: 199 - 2c shared of 199 + 2c.
        changed = rng.choice([9, 10, 11, 12, 8])
        for at in range(5, 5 + 4 * changed, 4):
            other[at] = f"x{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(words), "a"), (2 * k + 1, " ".join(other), "a")]
        if 100 * (199 - 2 * changed) >= 80 * (199 + 2 * changed):
            linked.add(2 * k)
    out = neardup.near_duplicates(frame(spark, rows), size=2).collect()
    assert {r["component_id"] for r in out if r["component_id"] != r["doc_id"]} == linked and len(linked) > 300


def test_few_dropped_rows_leave_the_texts_where_they_are(spark):
    """Dropped rows and repeats go to the documents; a planner that broadcasts nothing by itself must shuffle no text."""
    rows = [(1, A, "en"), (2, A + " end", "en"), (3, B, "de"), (3, B, "fr"), (5, "other words " + A + B, "en")]
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    try:
        out = neardup.distinct_documents(frame(spark, rows))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(name)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 3
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 5]


def test_a_member_goes_once_to_each_pair_of_blocks(spark):
    rows = [(k, n, part, left, right) for n, (left, right) in enumerate([(1, 1), (3, 4)]) for k, part in enumerate([7] * 30 + list(range(20)))]
    members = spark.createDataFrame(rows, "node long, key long, part long, _l int, _r int").withColumn("major", F.col("part") == 7)
    spots = neardup._spots(members).collect()
    seen = Counter((r["key"], r["i"], r["j"], r["node"]) for r in spots)
    assert max(seen.values()) == 1 and sum(r["key"] == 0 for r in spots) == 50
    # Every member outside the largest component meets every member on exactly one pair of blocks.
    groups = {}
    for r in spots:
        side = groups.setdefault((r["key"], r["i"], r["j"]), ([], []))
        for k, on in enumerate((r["left"], r["right"])):
            side[k].extend([r["node"]] * on)
    for key in (0, 1):
        met = Counter((a, b) for (k, _, _), (left, right) in groups.items() if k == key for a in left for b in right)
        minor = {r["node"] for r in spots if not r["major"]}
        assert set(met) == {(a, b) for a in minor for b in range(50)} and max(met.values()) == 1


def test_many_small_blocks_find_the_same_links(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        for n in range(rng.randrange(1, 5)):
            own = list(words)
            own[rng.randrange(40)] = f"x{k}"
            rows.append((len(rows), " ".join(own), "a"))
    found = lambda: sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, rows), size=2).collect())
    whole = found()
    monkeypatch.setattr(neardup, "LEFT_BLOCK", 1)
    monkeypatch.setattr(neardup, "RIGHT_BLOCK", 2)
    assert found() == whole
