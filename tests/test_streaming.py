import random
from datetime import datetime, timedelta

from helpers import error, raw
from pyspark.sql import functions as F

from faultline.operators.embed import hashing_embedder
from faultline.operators.signals import negative_signals
from faultline.operators.staging import stage_events
from faultline.plans import marts, sync
from faultline.sources import index_log
from faultline.streaming import ingest, late, sessions


def test_stream_sessions_equal_batch_sessions(spark, tmp_path):
    """Three micro-batches in time order; the last row only moves the watermark."""
    rnd = random.Random(5)
    base = datetime(2026, 1, 5)
    offsets = sorted(rnd.randrange(2 * 86400) for _ in range(300))
    rows = [error(f"{i:03}", rnd.choice(["hot", "hot", "cold"]), t.strftime("%H:%M:%S"), day=str(t.date()))
            for i, t in enumerate(base + timedelta(seconds=o) for o in offsets)]
    last = error("zzz", "later", "12:00:00", day="2026-01-09")
    for n in range(3):
        part = rows[n * 100:(n + 1) * 100] + ([last] if n == 2 else [])
        raw(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw(spark, [last]).schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    closed = sessions.sessionize_stream(negative_signals(stage_events(stream)), 15, "1 hour")
    query = (closed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    ingest.run_available(query)
    got = spark.read.schema(closed.schema).parquet(str(tmp_path / "out"))
    want = marts.fct_incidents(stage_events(raw(spark, rows)), stable_ids=True).select(*closed.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert want.count() > 20


def in_batches(spark, tmp_path, parts):
    for part in parts:
        raw(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw(spark, parts[0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stage_events(stream)


def run_sessions(spark, signals, tmp_path):
    closed = sessions.closed_sessions(signals, 15, "1 hour")
    ingest.run_available(closed.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
                         .trigger(availableNow=True).start(str(tmp_path / "closed")))
    rows = spark.read.schema(closed.schema).parquet(str(tmp_path / "closed"))
    return sessions.incidents_so_far(rows, sessions.open_sessions(spark, str(tmp_path / "c")), slice_rows=7)


def test_closed_and_open_sessions_are_all_incidents(spark, tmp_path):
    """Open sessions, signals without a time or a service; after each of two runs of the same query."""
    rnd = random.Random(6)
    base = datetime(2026, 1, 5)
    offsets = sorted(rnd.randrange(86400) for _ in range(240))
    rows = [error(f"{i:03}", rnd.choice(["hot", "hot", "cold", None]), t.strftime("%H:%M:%S"), day=str(t.date()))
            for i, t in enumerate(base + timedelta(seconds=o) for o in offsets)]
    rows[10:10] = [error("n1", "hot", "bad"), error("n2", "cold", "bad"), error("n3", None, "bad")]
    parts = [rows[:80], rows[80:160], rows[160:]]
    for upto in (2, 3):
        new = parts[:2] if upto == 2 else parts[2:]
        got = run_sessions(spark, negative_signals(in_batches(spark, tmp_path, new)), tmp_path)
        want = marts.fct_incidents(stage_events(raw(spark, [r for p in parts[:upto] for r in p])))
        assert sessions.open_sessions(spark, str(tmp_path / "c")).count() > 0
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_late_rows_are_kept(spark, tmp_path):
    """Three batches; the late rows lie in their own table, the others make the incidents; a repeated batch changes nothing."""
    parts = [[error("a", "s", "10:00:00"), error("n", "s", "bad")],
             [error("b", "s", "12:00:00"), error("c", "s", "09:10:00"), error("d", "s", "08:59:59")],
             [error("e", "s", "10:59:00"), error("f", "s", "11:30:00"), error("g", "s", "09:30:00"), error("n2", "s", "bad")]]
    staged = in_batches(spark, tmp_path, parts)
    path = str(tmp_path / "split")
    assert late.late_events(spark, path, staged.schema).count() == 0
    apply = late.split_late(path)
    ingest.run_available(staged.writeStream.foreachBatch(apply).trigger(availableNow=True)
                         .option("checkpointLocation", str(tmp_path / "lc")).start())

    def ids(df):
        return sorted(r["event_id"] for r in df.collect())

    behind = late.late_events(spark, path, staged.schema)
    assert ids(behind) == ["d", "e", "g"]
    apply(stage_events(raw(spark, parts[1])), 1)
    assert ids(late.late_events(spark, path, staged.schema)) == ["d", "e", "g"]
    on_time = negative_signals(late.on_time_stream(spark, path, staged.schema))
    got = run_sessions(spark, on_time, tmp_path)
    want = marts.fct_incidents(stage_events(raw(spark, [r for p in parts for r in p if r["event_id"] not in "deg"])))
    columns = [c for c in want.columns if c != "updated_at"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_index_follows_a_stream_of_summaries(spark, tmp_path):
    path = str(tmp_path / "index")
    summary = marts.Marts.of(stage_events(raw(spark, [
        error("1", "a", "10:00:00", "first"), error("2", "b", "10:00:00", "other")]))).summary
    changed = summary.filter("service_name = 'a'").withColumn("initial_symptom", F.lit("changed"))
    summary.coalesce(1).write.parquet(str(tmp_path / "in"))
    apply = sync.sync_index_batch(path, hashing_embedder(4), 4)

    def run():
        stream = spark.readStream.schema(summary.schema).parquet(str(tmp_path / "in"))
        query = (stream.writeStream.foreachBatch(apply).option("checkpointLocation", str(tmp_path / "c"))
                 .trigger(availableNow=True).start())
        ingest.run_available(query)

    run()
    assert index_log.read_index(spark, path).count() == 6
    changed.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    index = index_log.read_index(spark, path)
    assert index.count() == 6
    symptoms = index.filter("chunk_type = 'Symptoms'").select("service", "content").collect()
    assert {r["service"]: r["content"].split("\n")[1] for r in symptoms} == {"a": "changed", "b": "other"}


def test_hourly_counts_in_batch(spark):
    df = raw(spark, [error("1", "s", "10:59:59"), error("2", "s", "11:00:00"), error("3", "s", "11:30:00")])
    got = sessions.hourly_counts(stage_events(df)).collect()
    assert {(r["window_start"].hour, r["events"]) for r in got} == {(10, 1), (11, 2)}
