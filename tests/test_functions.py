import uuid

from pyspark.sql import functions as F

from faultline.functions import (
    bucket10, clip_max, duration_seconds, incident_id, json_scalar, minute_diff, round_to, safe_double,
    sql_timestamp_text, text_blocks, tokens, uuid5,
)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_minute_diff_counts_boundaries(spark):
    def diff(a, b):
        return one(spark, minute_diff(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")), a=a, b=b)

    assert diff("2026-01-05 12:00:59", "2026-01-05 12:16:00") == 16
    assert diff("2026-01-05 12:00:00", "2026-01-05 12:15:59") == 15
    assert diff("1969-12-31 23:59:59", "1970-01-01 00:00:00") == 1
    assert diff("1969-12-31 23:58:30", "1969-12-31 23:58:10") == 0


def test_uuid5_equals_the_standard_one(spark):
    names = [f"github_actions_run_{i}" for i in range(60)]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5("n").alias("u"))
    assert {r.n: r.u for r in df.collect()} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}
    assert one(spark, uuid5("n"), n="github_actions_run_42") == "49c17c43-2d36-5ec9-85d2-43b69692c5a7"


def test_incident_id_separator(spark):
    def make(service, seq, **kw):
        return one(spark, incident_id("s", "q", **kw), s=service, q=seq)

    assert make("svc-1", 11) != make("svc-11", 1)
    assert make("svc-1", 11, separator="") == make("svc-11", 1, separator="")


def test_bucket10(spark):
    assert one(spark, bucket10("h"), h="FFFFFFFF00") == 0xFFFFFFFF % 10


def test_run_duration(spark):
    def d(a, b):
        return one(spark, duration_seconds("a", "b"), a=a, b=b)

    assert d("2026-01-05T10:00:00Z", "2026-01-05T10:01:30Z") == 90
    assert d("2026-01-05T10:00:00Z", "2026-01-05T09:00:00Z") == 0
    assert d("2026-01-05T10:00:00Z", None) is None
    assert d("yesterday", "2026-01-05T10:01:30Z") is None


def test_json_scalar(spark):
    doc = '{"labels":{"k":"v"},"list":[1],"text":"{not json}","quoted":"{\\"a\\":1}","n":12.50,"none":null}'

    def get(path, payload=doc):
        return one(spark, json_scalar("p", path), p=payload)

    assert get("$.labels.k") == "v"
    assert get("$.labels") is None
    assert get("$.list") is None
    assert get("$.text") == "{not json}"
    assert get("$.quoted") == '{"a":1}'
    assert float(get("$.n")) == 12.5
    assert get("$.none") is None
    assert get("$.n", "oops") is None


def test_safe_double(spark):
    def d(text):
        return one(spark, safe_double("t"), t=text)

    assert d("1.5e3") == 1500.0
    assert d("-.5") == -0.5
    for bad in ("NaN", "Infinity", "1.0d", "x", ""):
        assert d(bad) is None


def test_text_helpers(spark):
    assert one(spark, text_blocks("t"), t="a\nb\n\n\n\n  c \n\n") == ["a\nb", "c"]
    assert one(spark, tokens("t"), t="L'Été 2024: OOM-killed, _x") == ["l", "été", "2024", "oom", "killed", "x"]
    assert one(spark, sql_timestamp_text(F.col("t").cast("timestamp")), t="2026-01-05 10:00:59.5") \
        == "2026-01-05 10:00:59.5000000"


def test_rounding_and_clipping(spark):
    assert one(spark, round_to("x", 2), x=0.125) == 0.13
    assert one(spark, clip_max("x", 1.0), x=2.5) == 1.0
    assert one(spark, clip_max(F.col("x").cast("double"), 1.0), x=None) is None
