"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.session import ensure_checkpoint_dir

# ASCII white space of the text contracts: space and \x09-\x0D.
ASCII_SPACE = r"[\x20\x09-\x0D]"

# A side is broadcast only when its measured row count stays below this
# (a few tens of MB for the narrow rows used here); beyond it the same join
# runs as a shuffle join.
BROADCAST_ROWS = 500_000


def named(column: str) -> Column:
    """Column by its literal name (dots and back-ticks included)."""
    return F.col("`" + column.replace("`", "``") + "`")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage: a lost executor re-reads the table instead of recomputing
    (or, for non-deterministic ids, re-deciding) what was already made.
    """
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast hint only for a side whose row count was measured and is bounded."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def held_out_fold(doc_id: Column) -> Column:
    """True for the documents models never learn from: crc32(id as text) mod 4 = 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def ranked(df: DataFrame, group: list[str], order: list[str], tag: str) -> DataFrame:
    """``df`` with ``rank`` (0-based place of a row in its group, by ``order``)
    and ``group_rows`` (rows of the group).

    No task sees a whole group: the rows are range-partitioned and sorted by
    (group, order) and written; a group's places in a partition are
    consecutive, so only one (first place, rows) pair per group and partition
    goes into a running sum.  ``df`` should be a written table (it is read
    twice) and ``order`` should end in a row number, so that repeated rows of
    a hot group are spread too.  Nulls come first."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id())
    placed = cut(placed, tag).withColumn("part", F.shiftright("place", 33))
    runs = placed.groupBy(*group, "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("part").alias("_part"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(whole).alias("group_rows"))
    same = F.col("part") == F.col("_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = placed.join(runs, same)
    return joined.select(*df.columns, (F.col("before") + F.col("place") - F.col("first")).alias("rank"), "group_rows")
