from types import SimpleNamespace

import pytest

from faultline.session import SETTINGS, fresh_dir, shared_dir, written


def fake(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: folder),
                           sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_the_configured_folder_is_used():
    assert shared_dir(fake("hdfs:///shared/", "yarn")) == "hdfs:///shared"
    assert fresh_dir(fake("/shared", "yarn"), "x").startswith("/shared/x-")


def test_a_local_folder_only_in_local_mode():
    a = shared_dir(fake(None, "local[2]"))
    assert a == shared_dir(fake(None, "local[2]"))
    with pytest.raises(ValueError):
        shared_dir(fake(None, "spark://host:7077"))


def test_written_tables_keep_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "named_struct('a', id) AS s")
    back = written(df, "t")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(r["id"] for r in back.collect()) == list(range(5))


def test_settings_are_applied(spark):
    for key, value in SETTINGS.items():
        assert spark.conf.get(key) == value
