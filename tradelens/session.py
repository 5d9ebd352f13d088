"""Spark session defaults and the shared checkpoint folder.

Everything in the library takes a ``SparkSession`` from the caller; this
module only offers a builder with sane defaults for tests and the bench,
and one helper that resolves where lineage may be cut.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in the library relies on.  Session time zone is UTC
# because the fact table stores naive timestamps (day grain) and month keys
# must not move with the driver's locale.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's join partition even when that costs an extra shuffle
    # (a key may hold a third of the rows: duplicate report, against-table
    # marking, fact-to-dimension joins beyond the broadcast threshold)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Broadcast joins are decided by Spark's own size estimate (static and,
    # with AQE, at runtime from shuffle statistics); above the threshold the
    # planner falls back to sort-merge join.  32 MB keeps dimension tables
    # broadcast and never a fact-sized side.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # The static estimate of a Parquet relation is its compressed file size;
    # count it 4x so a dimension that inflates in memory is not broadcast on
    # a too-small estimate.  The runtime (AQE) decision uses real shuffle sizes.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # Semi/anti joins against the stored fact table (import de-duplication)
    # get a runtime Bloom filter built from the small side, applied at the
    # scan of the large side before any shuffle.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "tradelens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    A master is set only when the caller names one; otherwise
    ``spark-submit`` or the environment decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local"):
        ensure_checkpoint_dir(spark)
    # on a cluster, jobs that cut lineage call ensure_checkpoint_dir themselves
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The folder comes from ``spark.checkpoint.dir``.  Only a local-mode
    session without one (tests, the bench) gets a private scratch folder; a
    cluster session without a shared folder is an error, so lineage is never
    cut to a machine-local path that a lost executor would take with it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for this cluster job")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tradelens-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table location under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system (not the driver's disk)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: several plans then read one frozen result, and a lost executor
    re-reads files instead of recomputing.  The files are compressed with
    Zstandard: a staged table is mostly text and takes part of the disk of
    every import."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
