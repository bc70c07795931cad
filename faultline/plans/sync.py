"""Keeping the retrieval index in step with the incident summary.

The summary needs ids that do not move when signals arrive late (``stable_ids``), as the
index is keyed by them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.chunks import chunk_incidents, to_search_doc
from faultline.operators.embed import DIMS, Embedder, embed
from faultline.operators.keyed import delete_incidents, orphan_ids, upsert
from faultline.plans.marts import read_summary
from faultline.session import written
from faultline.sources import index_log, state


def changed_since(summary: DataFrame, since: str) -> DataFrame:
    """Incidents updated at ``since`` or later.

    The mark itself is included: a row of the same time can land after the mark was taken.
    """
    return read_summary(summary).filter(F.col("updated_at") >= F.lit(since).cast("timestamp"))


def read_since(summary: DataFrame, since: str = state.EPOCH) -> DataFrame:
    """Incidents updated since ``since``, oldest first."""
    return changed_since(summary, since).orderBy("updated_at", "incident_id")


def index_rows(incidents: DataFrame, fn: Embedder | None, dims: int = DIMS) -> DataFrame:
    """Incidents as embedded index rows."""
    return to_search_doc(embed(chunk_incidents(incidents), fn, dims))


def sync_index(summary: DataFrame, index: DataFrame, since: str = state.EPOCH, fn: Embedder | None = None,
               dims: int = DIMS) -> DataFrame:
    """The index after one sync: changed incidents upserted, orphans removed."""
    fresh = index_rows(changed_since(summary, since), fn, dims)
    merged = upsert(to_search_doc(index), fresh)
    return delete_incidents(merged, orphan_ids(index, summary))


def _apply(spark: SparkSession, changed: DataFrame, summary: DataFrame | None, path: str, fn: Embedder | None,
           dims: int, stream: str | None = None, batch: int | None = None) -> None:
    """Append what differs between the index and ``changed``, and the orphans of ``summary``.

    A chunk's text names its incident, service, severity and date, so equal texts under
    equal ids are equal rows; incidents without a differing chunk are not embedded again.
    """
    index = index_log.read_index(spark, path)
    texts = chunk_incidents(changed).select("id", "incident_id", "content")
    differing = written(texts.join(index.select("id", "content"), ["id", "content"], "left_anti").select(
        "incident_id").distinct(), "differing")
    known = index.select("id", "incident_id")
    orphans = known.filter(F.lit(False)) if summary is None else known.join(
        orphan_ids(known, summary), "incident_id", "left_semi")
    orphans = written(orphans, "orphans")
    if differing.isEmpty() and orphans.isEmpty():
        return
    changed = changed.join(differing, "incident_id", "left_semi")
    index_log.append_changes(path, index_rows(changed, fn, dims), orphans, stream, batch)


def run_sync(spark: SparkSession, summary: DataFrame, path: str, mark_path: str,
             fn: Embedder | None = None, dims: int = DIMS) -> None:
    """One incremental sync of the stored index: upsert, delete orphans, save the mark."""
    since = state.load_mark(spark, mark_path)
    summary = written(summary, "summary")
    changed = changed_since(summary, since)
    mark = state.batch_mark(changed)
    _apply(spark, changed, summary, path, fn, dims)
    if mark:
        state.save_mark(spark, mark_path, mark)


def sync_index_batch(path: str, fn: Embedder | None = None, dims: int = DIMS, stream: str = "summaries",
                     mart: Callable[[], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts each micro-batch of summary rows.

    It works on the index that batch syncs write. ``stream`` names the stream, so that a
    batch which Spark repeats after a failure is known and skipped. With ``mart``, which
    gives the current summary, each batch also deletes the incidents that it lacks.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not index_log.has_batch(spark, path, stream, batch_id):
            _apply(spark, read_summary(batch), mart() if mart else None, path, fn, dims, stream, batch_id)

    return apply
