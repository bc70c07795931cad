"""Incident documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import schemas
from faultline.functions import concat_str, date_prefix, escape_block, text_blocks, unescape_block

# Document sections, default texts and metadata defaults.
HEAD_ID = "Incident ID:"
HEAD_SERVICE = "Azure Service:"
HEAD_SEVERITY = "Severity:"
HEAD_DURATION = "Duration:"
CHUNK_TYPES = ["Symptoms", "Root Cause", "Resolution"]
DOCUMENT_RESOLUTION = "Scaled the node pool from 3 to 5 nodes."
NO_SYMPTOM = "No symptom data available."
NO_ROOT_CAUSE = "Root cause not determined."
UNKNOWN = "Unknown"
UNKNOWN_ID = "unknown"
ENVIRONMENT = "production"
REGION = "francecentral"
RESOURCE_GROUP = "rg-default"
# Separates documents inside one file; it does not occur in rendered text.
RECORD_SEPARATOR = "\x1e"


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill absent columns and NULLs with the given values."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in defaults.items()
    }
    return df.withColumns(filled)


def render_documents(summary: DataFrame) -> DataFrame:
    """One text per incident (``path, text``); incidents without an id are skipped.

    Values are escaped where ``parse_documents`` would otherwise not read them back.
    """
    known = summary.filter(F.coalesce("incident_id", F.lit("")) != "")
    d = with_defaults(known, {"service_name": UNKNOWN, "severity": UNKNOWN, "initial_symptom": UNKNOWN,
                              "root_cause": UNKNOWN, "duration_minutes": 0})
    sections = [
        concat_str(f"{HEAD_ID} ", escape_block("incident_id", one_line=True)),
        concat_str(f"{HEAD_SERVICE}\n", escape_block("service_name", one_line=True)),
        concat_str(f"{HEAD_SEVERITY}\n", escape_block("severity", one_line=True)),
        concat_str("Symptoms:\n", escape_block("initial_symptom")),
        concat_str("Root Cause:\n", escape_block("root_cause")),
        F.lit(f"Resolution:\n{DOCUMENT_RESOLUTION}"),
        concat_str(f"{HEAD_DURATION}\n", F.col("duration_minutes"), " minutes."),
    ]
    return d.select(
        concat_str("incident_", F.col("incident_id"), ".txt").alias("path"),
        F.concat_ws("\n\n", *sections).alias("text"),
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as text files, many per file, split by a record separator."""
    documents.select("text").write.mode("append").text(path, lineSep=RECORD_SEPARATOR)


def read_documents(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Documents (``path, text``) from our sink, or from folders of one file per incident."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if one_per_file:
        rows = reader.text(path, wholetext=True)
    else:
        rows = reader.text(path, lineSep=RECORD_SEPARATOR)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _line_after(blocks: Column, head: str) -> Column:
    """Second line of the last block that starts with ``head``."""
    hits = F.filter(blocks, lambda b: b.startswith(head))
    return F.trim(F.get(F.split(F.try_element_at(hits, F.lit(-1)), "\n"), F.lit(1)))


def parse_documents(documents: DataFrame, escaped: bool = True) -> DataFrame:
    """Chunks with their document's metadata and path, read back from rendered text.

    ``escaped=False`` is for documents of another writer, whose backslashes mean themselves.

    A document is split, searched and numbered within its own row, so nothing
    is shuffled.
    """
    blocks = text_blocks("text")
    ids = F.filter("blocks", lambda b: b.startswith(HEAD_ID))
    doc_id = F.trim(F.substring(F.try_element_at(ids, F.lit(-1)), len(HEAD_ID) + 1, 2 ** 31 - 1))
    value = unescape_block if escaped else F.col
    parts = documents.select("path", blocks.alias("blocks"))
    meta = parts.select(
        "path", F.coalesce(doc_id, F.lit(UNKNOWN_ID)).alias("incident_id"),
        _line_after(F.col("blocks"), HEAD_SERVICE).alias("service"),
        _line_after(F.col("blocks"), HEAD_SEVERITY).alias("severity"),
        _line_after(F.col("blocks"), HEAD_DURATION).alias("duration"),
        F.filter("blocks", lambda b: b.rlike("^(" + "|".join(CHUNK_TYPES) + "):")).alias("sections"),
    )
    kind = F.regexp_extract("content", "^(" + "|".join(CHUNK_TYPES) + "):", 1)
    # The outer form, as the inner one would search every text again in a filter.
    return meta.select(
        "path", *[value(c).alias(c) for c in ("incident_id", "service", "severity")], "duration", F.posexplode_outer("sections").alias("n", "content")
    ).filter(F.col("n").isNotNull()).select(
        concat_str(F.col("incident_id"), "_chunk_", F.col("n") + 1).alias("id"),
        "incident_id", "service", "severity", "duration", kind.alias("chunk_type"), value("content").alias("content"), "path",
    )


def chunk_incidents(summary: DataFrame, environment: str = ENVIRONMENT, region: str = REGION,
                    resource_group: str = RESOURCE_GROUP) -> DataFrame:
    """Three chunks per incident, each with metadata and a citation footer.

    Takes ``incident_id, service_name, severity, initial_symptom, root_cause,
    duration_minutes, incident_start_time``.
    """
    d = with_defaults(summary, {
        "incident_id": UNKNOWN_ID, "service_name": UNKNOWN, "severity": UNKNOWN,
        "initial_symptom": NO_SYMPTOM, "root_cause": NO_ROOT_CAUSE, "duration_minutes": 0,
    }).withColumn("date", F.coalesce(date_prefix("incident_start_time"), F.lit("")))
    footer = concat_str("\n\n[Source: Incident ", F.col("incident_id"), " | Service: ", F.col("service_name"),
                        " | Severity: ", F.col("severity"), " | Date: ", F.col("date"), "]")
    bodies = [
        F.col("initial_symptom"),
        F.col("root_cause"),
        concat_str("The incident was resolved in ", F.col("duration_minutes"), " minutes."),
    ]
    pieces = F.array(*[
        F.struct(F.lit(kind).alias("chunk_type"), concat_str(f"{kind}:\n", body, footer).alias("content"))
        for kind, body in zip(CHUNK_TYPES, bodies)
    ])
    carried = [c for c in ["updated_at"] if c in summary.columns]
    return d.select("*", F.posexplode(pieces).alias("n", "piece")).select(
        concat_str("incident_", F.col("incident_id"), "_chunk_", F.col("n") + 1).alias("id"),
        "incident_id",
        F.col("service_name").alias("service"),
        "severity",
        F.col("piece.chunk_type").alias("chunk_type"),
        F.col("piece.content").alias("content"),
        "date",
        F.lit(environment).alias("environment"),
        F.lit(resource_group).alias("resource_group"),
        F.lit(region).alias("region"),
        *carried,
    )


def chunk_seed(seed: DataFrame) -> DataFrame:
    """Chunks of structured incidents with ``symptoms, root_cause, resolution`` columns."""
    bodies = ["symptoms", "root_cause", "resolution"]
    pieces = F.array(*[
        F.struct(F.lit(kind).alias("chunk_type"), concat_str(f"{kind}:\n", F.col(body)).alias("content"))
        for kind, body in zip(CHUNK_TYPES, bodies)
    ])
    return seed.select("*", F.explode(pieces).alias("piece")).select(
        concat_str(F.col("incident_id"), "-",
                   F.lower(F.replace(F.col("piece.chunk_type"), F.lit(" "), F.lit("_")))).alias("id"),
        "incident_id", "service", "severity",
        F.col("piece.chunk_type").alias("chunk_type"),
        F.col("piece.content").alias("content"),
        "date", "environment", "resource_group", "region",
    )


def to_search_doc(chunks: DataFrame) -> DataFrame:
    """Exactly the index columns, in order and type; absent ones become NULL."""
    return chunks.select(*[
        (F.col(f.name) if f.name in chunks.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.CHUNK
    ])


def to_display(chunks: DataFrame) -> DataFrame:
    """The index columns without the vector."""
    return to_search_doc(chunks).drop("embedding")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, the chunks of one incident side by side in one file."""
    chunks.repartition("incident_id").sortWithinPartitions("incident_id", "id").write.mode("append").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNK).json(path)
