"""Inactivity sessions (T3): a session ends after ``gap`` without activity.

The reference keeps a chat session alive while it is touched at least every
30 minutes (a gap of exactly 30 minutes still extends it).  The same rule
over any ``(user, timestamp)`` log:

* **batch** (:func:`sessionize`) is skew-proof.  A plain
  ``groupBy(user, session_window)`` merges sessions only after shuffling by
  user, so one very active user would be sessionised by one task.  Instead
  the events are range-partitioned on ``(user, ts)`` — which cuts a hot
  user's timeline into contiguous time slices on different tasks — each
  slice is sessionised with windows over ``(user, slice)``.  Only the first
  and the last session of a slice can continue in a neighbouring one, so at
  most two rows per user and slice go to the second window that merges
  across slices; all sessions in between are final as they are.
* **streaming, exact** (:func:`start_session_stream`): each micro-batch is
  sessionised by itself and its sessions are kept as fragments;
  :func:`read_sessions` merges fragments whose gap is not too long.  However
  late an event comes, it ends up in a fragment, extends a session or bridges
  two: the result equals the batch one, in whatever order events arrive, and
  no state is held per user.  :func:`compact_fragments` merges what is there.
* **streaming, windowed** (:func:`stream_sessions`) uses ``session_window``
  with a watermark; open sessions live in the state store and are emitted
  when the watermark passes their end; later events are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tradelens.session import stage_table
from tradelens.sources.commits import children


def sessionize(
    df: DataFrame,
    user_col: str = "user_id",
    ts_col: str = "ts",
    gap: str = "30 minutes",
    value_col: str | None = "value",
    slices: int | None = None,
) -> DataFrame:
    """One row per session: user, session_start (first event),
    session_end (last event), events, total_value.

    An event more than ``gap`` after the previous event of the same user
    starts a new session.  ``slices`` defaults to the shuffle partitions."""
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = F.expr(f"INTERVAL {gap}")
    val = F.col(value_col) if value_col else F.lit(None).cast("double")
    ev = df.select(F.col(user_col).alias("_u"), F.col(ts_col).alias("_ts"), val.alias("_v")).filter(F.col("_ts").isNotNull())
    sliced = ev.repartitionByRange(n, "_u", "_ts").withColumn("_slice", F.spark_partition_id())
    w = Window.partitionBy("_u", "_slice").orderBy("_ts")
    prev = F.lag("_ts").over(w)
    flagged = sliced.withColumn("_new", F.when(prev.isNull() | (F.col("_ts") > prev + step), 1).otherwise(0))
    flagged = flagged.withColumn("_lsid", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("_u", "_slice")
    flagged = flagged.withColumn("_border", (F.col("_lsid") == 1) | (F.col("_lsid") == F.max("_lsid").over(whole)))
    partial = flagged.groupBy("_u", "_slice", "_lsid", "_border").agg(
        F.min("_ts").alias("session_start"), F.max("_ts").alias("session_end"), F.count(F.lit(1)).alias("events"), F.sum("_v").alias("total_value")
    )
    # a session that crosses slices is a run of border sessions without a gap
    w2 = Window.partitionBy("_u").orderBy("session_start", "_slice", "_lsid")
    prev_end = F.max("session_end").over(w2.rowsBetween(Window.unboundedPreceding, -1))
    border = partial.filter("_border").withColumn("_new", F.when(prev_end.isNull() | (F.col("session_start") > prev_end + step), 1).otherwise(0))
    border = border.withColumn("_sid", F.sum("_new").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
    merged = border.groupBy("_u", "_sid").agg(
        F.min("session_start").alias("session_start"),
        F.max("session_end").alias("session_end"),
        F.sum("events").alias("events"),
        F.sum("total_value").alias("total_value"),
    )
    names = ["_u", "session_start", "session_end", "events", "total_value"]
    out = merged.select(*names).unionByName(partial.filter(~F.col("_border")).select(*names))
    cols = [F.col("_u").alias(user_col), "session_start", "session_end", "events"]
    if value_col:
        cols.append("total_value")
    return out.select(*cols)


def stream_sessions(events: DataFrame, user_col: str = "user_id", ts_col: str = "ts", gap: str = "30 minutes", *, watermark: str, value_col: str | None = "value") -> DataFrame:
    """Streaming variant: ``events`` is a streaming DataFrame.  A session is
    emitted (append mode) once the watermark passes its end.  Events later
    than ``watermark`` are dropped by Spark, so the caller must choose it; how
    many were dropped is the query progress's ``numRowsDroppedByWatermark``."""
    timed = events.withWatermark(ts_col, watermark)
    aggs = [F.min(ts_col).alias("session_start"), F.max(ts_col).alias("session_end"), F.count(F.lit(1)).alias("events")]
    if value_col:
        aggs.append(F.sum(value_col).alias("total_value"))
    return timed.groupBy(F.col(user_col), F.session_window(F.col(ts_col), gap).alias("window")).agg(*aggs)


# ---------------------------------------------------------------- exact streaming sessions


def merge_sessions(fragments: DataFrame, user_col: str = "user_id", gap: str = "30 minutes", slices: int | None = None) -> DataFrame:
    """Sessions from fragments (``user_col, session_start, session_end, events``
    and other sums): fragments that overlap, or lie at most ``gap`` apart,
    are one session.

    Range slices of (user, start) are merged on their own, so a hot user is
    spread.  What can go on in another slice is merged again: the first and
    last session of a slice, and those that start before a fragment of an
    earlier slice has ended."""
    n = slices or int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = F.expr(f"INTERVAL {gap}")
    sums = [c for c in fragments.columns if c not in (user_col, "session_start", "session_end")]
    totals = [F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), *[F.sum(c).alias(c) for c in sums]]

    def numbered(rows: DataFrame, w, name: str) -> DataFrame:
        ended = F.max("session_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(ended.isNull() | (F.col("session_start") > ended + step), 1).otherwise(0)
        return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")

    sliced = fragments.withColumnRenamed(user_col, "_u").repartitionByRange(n, "_u", "session_start").withColumn("_slice", F.spark_partition_id())
    first = numbered(sliced, Window.partitionBy("_u", "_slice").orderBy("session_start", "session_end"), "_n")
    # staged: the bounds of the slices are sampled, and two readers of the plan could see different ones
    merged = stage_table(first.groupBy("_u", "_slice", "_n").agg(*totals), "session-slices")
    ends = merged.groupBy("_u", "_slice").agg(F.max("session_end").alias("_end"), F.max("_n").alias("_last"))
    before = Window.partitionBy("_u").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice of a user
    ends = ends.withColumn("_ended", F.max("_end").over(before)).select(F.col("_u").alias("_u2"), F.col("_slice").alias("_slice2"), "_last", "_ended")
    merged = merged.join(ends, F.col("_u").eqNullSafe(F.col("_u2")) & (F.col("_slice") == F.col("_slice2"))).drop("_u2", "_slice2")
    reaches = F.coalesce(F.col("session_start") <= F.col("_ended") + step, F.lit(False))
    merged = merged.withColumn("_border", (F.col("_n") == 1) | (F.col("_n") == F.col("_last")) | reaches)
    columns = ["_u", "session_start", "session_end", *sums]
    border = numbered(merged.filter("_border").select(*columns), Window.partitionBy("_u").orderBy("session_start", "session_end"), "_n")
    out = border.groupBy("_u", "_n").agg(*totals).select(*columns).unionByName(merged.filter(~F.col("_border")).select(*columns))
    return out.withColumnRenamed("_u", user_col)


def _fragment_folder(root: str) -> str:
    return f"{root.rstrip('/')}/fragments"


def start_session_stream(
    events: DataFrame,
    root: str,
    checkpoint_location: str,
    user_col: str = "user_id",
    ts_col: str = "ts",
    gap: str = "30 minutes",
    value_col: str | None = "value",
    available_now: bool = True,
) -> StreamingQuery:
    """Sessionise a stream of events into fragments under ``root``.  A batch
    has a folder of its own, which a replay writes again: an event counts
    once whatever is restarted."""

    def run(batch: DataFrame, batch_id: int) -> None:
        found = sessionize(batch, user_col, ts_col, gap, value_col)
        found.write.mode("overwrite").parquet(f"{_fragment_folder(root)}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def _current(spark: SparkSession, root: str) -> tuple[list[str], int]:
    """Folders that hold every fragment once, and the last finished batch."""
    folder = _fragment_folder(root)
    done = [n for n in children(spark, folder) if "_SUCCESS" in children(spark, f"{folder}/{n}")]
    upto = max((int(n[len("upto=") :]) for n in done if n.startswith("upto=")), default=-1)
    batches = sorted(int(n[len("batch=") :]) for n in done if n.startswith("batch="))
    paths = ([f"{folder}/upto={upto}"] if upto >= 0 else []) + [f"{folder}/batch={b}" for b in batches if b > upto]
    return paths, max([upto, *batches])


def read_sessions(spark: SparkSession, root: str, user_col: str = "user_id", gap: str = "30 minutes") -> DataFrame | None:
    """Sessions of all events so far, with ``open`` where an event at the
    latest time seen would still extend the session; None before the first batch."""
    paths, _ = _current(spark, root)
    if not paths:
        return None
    fragments = spark.read.parquet(*paths)
    latest = fragments.agg(F.max("session_end")).first()[0]
    out = merge_sessions(fragments, user_col, gap)
    time_type = fragments.schema["session_end"].dataType
    return out.withColumn("open", F.coalesce(F.col("session_end") + F.expr(f"INTERVAL {gap}") >= F.lit(latest).cast(time_type), F.lit(False)))


def compact_fragments(spark: SparkSession, root: str, user_col: str = "user_id", gap: str = "30 minutes") -> int:
    """Merge the fragments of all finished batches into one folder, which
    stands for them from then on; returns the last batch in it (-1: none).
    A stopped compaction leaves a folder that nobody reads."""
    paths, last = _current(spark, root)
    if len(paths) > 1:
        merge_sessions(spark.read.parquet(*paths), user_col, gap).write.mode("overwrite").parquet(f"{_fragment_folder(root)}/upto={last}")
    return last
