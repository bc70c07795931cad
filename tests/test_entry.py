import __spark_entry__ as entry


def test_every_query_has_its_sql():
    """All of the library's own; only optional corpus queries may go without."""
    known = set(entry.oracle_sql())
    assert set(entry.QUERIES) <= known <= set(entry.queries())
    assert set(entry.queries()) - known <= set(entry.LLM_QUERIES) | {"pipeline"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "incident_narrative" in df.columns
