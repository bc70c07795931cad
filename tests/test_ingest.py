import json
import os

from helpers import envelope, raw
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import quality, staging
from faultline.plans import kpis
from faultline.sources import events, feedback, tables
from faultline.streaming import ingest


def messages(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_malformed_messages_are_quarantined(spark):
    rows = ["not json", '{"event_id":"c","event_type":"log","payload":"oops"}', '{"event_type":"log"}']
    good, bad = staging.split_malformed(messages(spark, rows))
    assert [r["event_id"] for r in good.collect()] == ["c"]
    assert {r["raw"] for r in bad.collect()} == {rows[0], rows[2]}
    staged = staging.stage_events(good).first()
    assert staged["payload"] == "oops" and staged["log_level"] is None and staged["ingested_at"] is not None


def test_envelope_keeps_nested_payload_as_text(spark):
    event = envelope("1", "metric", "s", "2026-01-05T10:00:00Z", {})
    event["payload"] = {"metric_name": "cpu", "value": "9.5", "labels": {"k": "v"}}
    parsed = staging.parse_envelope(messages(spark, [json.dumps(event)]))
    got = parsed.select("*", F.get_json_object("payload", "$.labels.k").alias("k")).first()
    assert got["k"] == "v"
    assert staging.stage_events(parsed).first()["metric_value"] == 9.5


def test_routing_and_messages(spark, tmp_path):
    df = raw(spark, [envelope("1", "deployment", "s", "t", {}), envelope("2", "log", "s", "t", {}),
                     envelope("3", "trace", "s", "t", {})])
    routed = events.route_topics(df)
    assert {r["topic"]: r["sent"] for r in events.topic_totals(routed).collect()} == {
        events.DEPLOYMENT_TOPIC: 1, events.INCIDENT_TOPIC: 2}
    back = staging.parse_envelope(routed).drop("ingested_at")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.drop("ingested_at").collect()))


def write_batch(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(rows) + "\n")


def lines(ids):
    return [json.dumps(envelope(i, "log", "s", "2026-01-05T10:00:00Z", {"level": "ERROR"})) for i in ids]


def test_replay_lands_once_and_restart_goes_on(spark, tmp_path):
    source = tmp_path / "in"
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    for exact in (True, False):
        write_batch(source, "a.json", lines("ab"))
        write_batch(source, "b.json", lines("ab") + ["broken"])
        run = f"{out}-{exact}", f"{ckpt}-{exact}"
        for q in ingest.ingest(events.read_message_files(spark, str(source), 1), *run, exact=exact):
            ingest.run_available(q)
        landed = events.raw_events(spark, f"{run[0]}/events")
        assert sorted(r["event_id"] for r in landed.collect()) == ["a", "b"]
        bad = spark.read.schema("raw string").json(f"{run[0]}/quarantine")
        assert [r["raw"] for r in bad.collect()] == ["broken"]
    # A second run of the exact query sees only the new file and remembers the old ids.
    write_batch(source, "c.json", lines("bc"))
    run = f"{out}-True", f"{ckpt}-True"
    for q in ingest.ingest(events.read_message_files(spark, str(source), 1), *run, exact=True):
        ingest.run_available(q)
    landed = events.raw_events(spark, f"{run[0]}/events")
    assert sorted(r["event_id"] for r in landed.collect()) == ["a", "b", "c"]


def test_bounded_dedupe_forgets_and_reports_late_rows(spark, tmp_path):
    schema = "event_id string, event_at timestamp"
    days = ["2026-01-01", "2026-01-02", "2026-01-03", "2026-01-01"]
    for n, day in enumerate(days):
        write_batch(tmp_path / "in", f"{n}.json", [json.dumps({"event_id": f"e{n}", "event_at": f"{day} 00:00:00"})])
        # The source takes files in the order of their times.
        os.utime(tmp_path / "in" / f"{n}.json", (1000 + n, 1000 + n))
    held = {}
    for exact in (True, False):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        unique = ingest.dedupe_stream(stream, exact, "event_at", "1 hour")
        query = (unique.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c{exact}"))
                 .trigger(availableNow=True).start(str(tmp_path / f"o{exact}")))
        ingest.run_available(query)
        held[exact] = ingest.state_rows(query)
        late = ingest.late_rows(query)
        if not exact:
            assert late == 1
    assert held[True] > held[False]


def test_landing_view_and_json(spark, tmp_path):
    df = raw(spark, [envelope("1", "log", "s", "2026-01-05T10:00:00Z", {"a": {"b": 1}}),
                     envelope("2", "metric", None, "bad", "x")])
    events.land(df, str(tmp_path / "t"))
    view = events.v_raw_events(spark, str(tmp_path / "t"))
    want = sorted(map(tuple, df.collect()), key=str)
    assert sorted(map(tuple, view.collect()), key=str) == want
    assert spark.table("v_raw_events").count() == 2
    events.write_events_json(df, str(tmp_path / "j"))
    back = events.read_events_json(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.drop("ingested_at").collect()), key=str)
    (tmp_path / "arr").mkdir()
    (tmp_path / "arr" / "a.json").write_text(json.dumps([json.loads(x) for x in lines("xy")], indent=1))
    arrays = events.read_events_json(spark, str(tmp_path / "arr"), arrays=True)
    assert sorted(r["event_id"] for r in arrays.collect()) == ["x", "y"]
    assert arrays.first()["payload"].startswith("{")


def test_external_table(spark, tmp_path):
    events.land(raw(spark, [envelope("1", "log", "s", "2026-01-05T10:00:00Z", {})]), str(tmp_path / "t"))
    spark.sql("DROP TABLE IF EXISTS raw_events_ext")
    try:
        events.create_raw_table(spark, "raw_events_ext", str(tmp_path / "t"))
        assert spark.table("raw_events_ext").count() == 1
    finally:
        spark.sql("DROP TABLE IF EXISTS raw_events_ext")


def test_concat_order_and_latest(spark):
    a = raw(spark, [envelope("1", "log", "s", "2026-01-05T10:00:00Z", {})])
    b = raw(spark, [envelope("2", "log", "s", "2026-01-05T09:00:00Z", {})]).drop("source")
    both = events.concat_events(a, b)
    assert [r["event_id"] for r in staging.chronological(both).collect()] == ["2", "1"]
    assert [r["event_id"] for r in staging.latest(staging.stage_events(both), 1).collect()] == ["1"]
    assert staging.event_count(both).first()[0] == 2


RUN = ("id long, name string, head_sha string, status string, conclusion string, head_branch string, "
       "run_started_at string, created_at string, updated_at string, event string")


def test_normalise_runs(spark):
    runs = spark.createDataFrame([
        (42, "Deploy", "sha", "completed", "success", "main", "2026-01-05T10:00:00Z", "2026-01-05T09:59:00Z",
         "2026-01-05T10:02:00Z", "push"),
        (43, None, "sha", "queued", None, "main", None, "2026-01-05T09:59:00Z", None, "push"),
    ], RUN)
    a, b = staging.normalise_runs(runs).orderBy("timestamp", ascending=False).collect()
    assert a["event_id"] == "49c17c43-2d36-5ec9-85d2-43b69692c5a7" and a["service_name"] == "Deploy"
    assert a["timestamp"] == "2026-01-05T10:02:00Z" and json.loads(a["payload"])["duration_seconds"] == 120
    payload = json.loads(b["payload"])
    assert b["service_name"] == "unknown-workflow" and payload["started_at"] == "2026-01-05T09:59:00Z"
    assert payload["duration_seconds"] is None and "conclusion" in payload


def test_map_workflows(spark):
    deps = spark.createDataFrame([("d1", "Deploy API"), ("d2", "Other")], "deployment_id string, service_name string")
    names = spark.createDataFrame([("Deploy API", "api")], "workflow_name string, service_name string")
    got = staging.map_workflows(deps, names)
    assert {tuple(r) for r in got.collect()} == {("d1", "api"), ("d2", "Other")}


def test_trace_rollups(spark):
    spans = [{"trace_id": "t", "span_id": str(i), "duration_ms": d, "status": s, "tags": {"a": "b"},
              "logs": [{"event": "e"}]}
             for i, (d, s) in enumerate([(100, "OK"), (40, "ERROR"), (10, "OK")])]
    df = raw(spark, [envelope("1", "trace", "s", "x", {"trace_id": "t", "spans": spans})])
    flat = staging.explode_spans(df)
    assert flat.count() == 3 and flat.first()["tags"] == {"a": "b"}
    assert tuple(staging.trace_rollup(flat).first()) == ("t", 150, 3, True)
    assert tuple(staging.trace_rollup_in_place(df).first()) == ("1", 150, 3, True)


def test_quality(spark):
    df = raw(spark, [envelope("1", "log", "s", "t", {}), envelope("1", "other", None, "t", {}),
                     envelope(None, None, "s", "t", {}), envelope(None, "log", "s", "t", {})])
    report = quality.quality_report(df, quality.RAW_SUITE, "raw_events")
    got = {(r["column_name"], r["test"]): r["failures"] for r in report.collect()}
    assert got == {
        ("event_id", "not_null"): 2, ("event_type", "not_null"): 1, ("source", "not_null"): 0,
        ("timestamp", "not_null"): 0, ("service_name", "not_null"): 1,
        ("event_type", "accepted_values"): 1, ("event_id", "unique"): 1}
    assert [tuple(r) for r in quality.unique(df, ["event_id"]).collect()] == [("1", 2)]
    assert quality.accepted_values(df, "event_type", staging.EVENT_TYPES).count() == 1
    assert {r["column"]: r["failures"] for r in quality.not_null(df, ["event_id"]).collect()} == {"event_id": 2}


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = [("s", "q", r, 1.0) for r in ("helpful", "helpful", "helpful", "not_helpful")]
    feedback.append_feedback(spark.createDataFrame(rows[:2], schemas.FEEDBACK), path)
    feedback.append_feedback(spark.createDataFrame(rows[2:], schemas.FEEDBACK), path)
    assert kpis.feedback_ratio(feedback.read_feedback(spark, path)).first()[0] == 75.0
    assert kpis.feedback_ratio(spark.createDataFrame([], schemas.FEEDBACK)).first()[0] is None


def test_materialize(spark):
    one = tables.materialize(spark.range(3).toDF("x"), "three", "view")
    assert one.count() == 3
    spark.sql("DROP TABLE IF EXISTS three_t")
    try:
        tables.materialize(spark.range(3).toDF("x"), "three_t", "table")
        assert tables.materialize(spark.range(4).toDF("x"), "three_t", "table").count() == 4
    finally:
        spark.sql("DROP TABLE IF EXISTS three_t")
