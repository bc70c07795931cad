"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings that the results or the plans rely on.
SETTINGS = {
    # Timestamps are UTC everywhere; day and month cuts depend on it.
    "spark.sql.session.timeZone": "UTC",
    # Runtime join choice, partition coalescing and skew splitting.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Merge session windows inside each task before they are shuffled, so a
    # busy service sends sessions, not rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Streaming state on local disk with changes in the checkpoint, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Bytes of an Arrow batch: it is held several times over, in the executor and in its Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end after so many bytes as well as after so many rows.

    Batches that hold the default number of rows grow with the length of texts and sets. A plan
    takes the bound when it runs, so it stays set for what the caller runs later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


# Local folders of single-machine sessions without a configured one, by application.
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Without the setting a local session gets a folder of its own, which is the
    case in single-machine tests; on a cluster its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _local_dirs:
            _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="faultline-")
        folder = _local_dirs[context.applicationId]
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it.

    For results that a plan needs more than once: the work below runs once, the
    table survives lost executors, and later readers prune its columns. The
    caller's clean-up of the shared folder removes it, as with checkpoints.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
