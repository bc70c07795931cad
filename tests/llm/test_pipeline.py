"""The pipeline's run() against plain Python over a small corpus with planted rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from faultline.llm import decontamination, neardup  # noqa: E402
from faultline.session import BATCH_BYTES  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _text(rng, n):
    """Words of which every fourth is a stop word."""
    return " ".join(rng.choice(("the", "of", "and")) if k % 4 == 3 else
                    "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(4, 9))) for k in range(n))


def _corpus():
    rng = random.Random(11)
    items = [_text(rng, 24) for _ in range(3)]
    rows = [(k, _text(rng, rng.randrange(60, 120)), ("a", "b", None)[min(k % 5, 2)], "en") for k in range(60)]
    base = dict((r[0], r[1]) for r in rows)
    rejected = [(100, None, "a", "en"), (101, "", "a", "en"), (102, "the of and few words", "b", "en"),
                (103, "the same three " * 40, "a", "en"), (104, "# & % " * 60 + base[3], None, "en")]
    copies = [(200 + k, base[k], "a", "fr") for k in range(4)]
    near = [(300 + k, base[k] + " ende", "b", "en") for k in range(4, 8)]
    cut = [(400, _text(rng, 90) + " " + items[0] + " " + _text(rng, 90), "a", "en")]
    covered = [(500, " ".join(items) + " " + _text(rng, 8), "b", "en")]
    return rows + rejected + copies + near + cut + covered, items, {r[0] for r in rejected}


def _shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    n = neardup.SHINGLE
    return {tuple(ws[k:k + n]) for k in range(len(ws) - n + 1)} or {tuple(ws)}


def _distinct(rows):
    """The least id of each component of the links between all pairs."""
    sets = {i: _shingles(t) for i, t, *_ in rows}
    least = {i: i for i in sets}
    while True:
        before = dict(least)
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= neardup.PERCENT * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
        if least == before:
            return [r for r in rows if least[r[0]] == r[0]]


def _hits(text, items):
    windows = {tuple(ws[k:k + 10]) for ws in (WORD.findall(t.lower()) for t in items) for k in range(len(ws) - 9)}
    ws = WORD.findall(text.lower())
    hit = {k + d for k in range(len(ws) - 9) if tuple(ws[k:k + 10]) in windows for d in range(10)}
    return len(hit) / len(ws), hit


def _targets(sizes):
    """Word targets of the sources: shares by weight, no more than twice a source, the excess shared again."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_run_equals_plain_python(spark, tmp_path):
    rows, items, rejected = _corpus()
    doc_id, text, source, lang = map(list, zip(*rows, strict=True))
    pq.write_table(pa.table({"doc_id": pa.array(doc_id, pa.int64()), "text": pa.array(text, pa.string()),
                             "source": pa.array(source, pa.string()), "lang": pa.array(lang, pa.string())}),
                   tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([f"i{k}" for k in range(len(items))]), "text": pa.array(items)}),
                   tmp_path / "benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()

    kept = _distinct([r for r in rows if r[0] not in rejected])
    share = {i: _hits(t, items) for i, t, *_ in kept}
    assert share[400][0] <= decontamination.MAX_COVERAGE < share[500][0]
    kept = [r for r in kept if share[r[0]][0] <= decontamination.MAX_COVERAGE]
    times = Counter(r["doc_id"] for r in got)
    by_id = {r[0]: r for r in kept}
    assert set(times) <= set(by_id) and all(n <= 2 for n in times.values())
    # Texts without a hit are whole, others lose the hit words.
    for r in got:
        text = by_id[r["doc_id"]][1]
        if share[r["doc_id"]][1]:
            assert 1 < r["size"] < len(text.encode()) + 1 - 10 * 4
        else:
            assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
    words = {i: len(r[1].split()) - len(share[i][1]) for i, r in by_id.items()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, (_, _, s, _) in by_id.items():
        sizes[s] += words[i]
        taken[s] += words[i] * times[i]
        largest[s] = max(largest[s], words[i])
    targets = _targets(sizes)
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes), (dict(taken), targets)
    # Shards are at most one row apart, their slots gapless.
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) <= set(range(16)) and max(map(len, shards.values())) - min(len(shards[k]) for k in range(16)) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_stages_are_the_stated_ones():
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "mixing", "sharding"]
    assert Path(pipeline.__file__).name == "corpus_pipeline.py"


def test_arrow_batches_of_python_stages_end_by_bytes(spark, tmp_path, monkeypatch):
    key, path = "spark.sql.execution.arrow.maxBytesPerBatch", f"{tmp_path}/in"
    spark.createDataFrame([("i", "x")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 10000) AS text").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["n"])

    held = lambda docs, *_: docs.mapInArrow(sizes, "n long")
    monkeypatch.setattr(pipeline.decontamination, "clean_documents", held)
    monkeypatch.setattr(pipeline.neardup, "distinct_documents", held)
    try:
        for stage in (pipeline.near_duplicates, pipeline.benchmark_decontamination):
            spark.conf.unset(key)
            found = [r["n"] for r in stage(spark, docs, path).collect()]
            assert sum(found) >= 30_000_000 and max(found) <= 2 * BATCH_BYTES
    finally:
        spark.conf.unset(key)
