"""Named views and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def materialize(df: DataFrame, name: str, mode: str = "view",
                partition_by: list[str] | None = None) -> DataFrame:
    """Publish ``df`` as a session view, or as a saved table that replaces the old one."""
    spark = df.sparkSession
    if mode == "view":
        df.createOrReplaceTempView(name)
    elif mode == "table":
        writer = df.write.mode("overwrite").format("parquet")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.saveAsTable(name)
    else:
        raise ValueError(f"mode must be 'view' or 'table', not {mode!r}")
    return spark.table(name)


def materialize_all(frames: dict[str, DataFrame], mode: str = "view") -> dict[str, DataFrame]:
    return {name: materialize(df, name, mode) for name, df in frames.items()}
