"""Loaded-set profile, growth, comparison and recommendation.

All answers are aggregates of aggregates: the fact table is reduced to
(company | category) x month grain first, so the windows below partition
small, bounded inputs (one row per key and month).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numbers import iso_timestamp, month_key
from tradelens.operators.listing import top_k_per_group
from tradelens.operators.rollups import and_all, date_range
from tradelens.sources.store import Store


def working_set(
    store: Store,
    companies: Sequence[str] | None = None,
    categories: Sequence[str] | None = None,
    goods: Sequence[str] | None = None,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """Lines of the chosen companies / categories / goods (by name)
    within a date range: date, company_name, category, goods_name, value.

    Name lists become semi-joins against the (small) filtered dimensions."""
    tx = store.facts(["date", "company_id", "goods_id", "total_value_usd"], dates=(date_from, date_to))
    cond = date_range(F.col("date"), date_from, date_to)
    if cond is not None:
        tx = tx.filter(cond)
    comp = store.companies().select("company_id", F.col("name").alias("company_name"))
    if companies:
        comp = comp.filter(F.col("company_name").isin(list(companies)))
        tx = tx.join(comp.select("company_id"), "company_id", "left_semi")
    gf = and_all(
        [
            F.col("category").isin(list(categories)) if categories else None,
            F.col("goods_name").isin(list(goods)) if goods else None,
        ]
    )
    if gf is not None:
        g = store.goods_with_category().select("goods_id", F.col("raw_name").alias("goods_name"), "category").filter(gf)
        tx = tx.join(g.select("goods_id"), "goods_id", "left_semi")
    return store.attach_goods(tx.join(comp, "company_id", "left"), {"raw_name": "goods_name"})


def _single_row(frames: Sequence[DataFrame]) -> DataFrame:
    """Merge single-row frames with disjoint columns into one row via a
    union and ``first(ignorenulls)`` — no cross join."""
    cols = [c for f in frames for c in f.columns]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def _top_names(df: DataFrame, key: str, k: int, name: str) -> DataFrame:
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = per.orderBy(F.col("_n").desc(), F.col(key).asc()).limit(k)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct(-F.col("_n"), F.col(key).alias("k")))).alias("_a"))
    return ranked.select(F.array_join(F.transform("_a", lambda s: s["k"]), ", ").alias(name))


def load_profile(ws: DataFrame, k: int = 3) -> DataFrame:
    """Record count, date range, total value and the top-``k``
    companies and categories by line count of a working set (one row)."""
    stats = ws.agg(
        F.count(F.lit(1)).alias("record_count"),
        iso_timestamp(F.min("date")).alias("date_from"),
        iso_timestamp(F.max("date")).alias("date_to"),
        F.coalesce(F.sum("total_value_usd"), F.lit(0)).cast("double").alias("total_value"),
    )
    return _single_row([stats, _top_names(ws, "company_name", k, "top_companies"), _top_names(ws, "category", k, "top_categories")])


def recent_months(store: Store, months: int = 6) -> DataFrame:
    """A40 "recent": per company, value and lines within the last ``months``
    months of the loaded data (relative to its latest date)."""
    tx = store.facts(["company_id", "date", "total_value_usd"])
    latest = tx.agg(F.max("date").alias("m"))
    cutoff = F.add_months(latest.scalar(), -months).cast("timestamp_ntz")
    recent = tx.filter(F.col("date") >= cutoff)
    names = store.companies().select("company_id", F.col("name").alias("company_name"))
    return (
        recent.groupBy("company_id")
        .agg(F.sum("total_value_usd").cast("double").alias("total_value"), F.count(F.lit(1)).alias("transaction_count"))
        .join(names, "company_id", "left")
    )


def category_growth(store: Store) -> DataFrame:
    """A40 "fastest growing": month-over-month value growth per category
    (``growth_pct`` NULL for a category's first month or a zero base)."""
    tx = store.facts(["goods_id", "date", "total_value_usd"])
    monthly = (
        store.attach_goods(tx)
        .groupBy("category", month_key("date").alias("month"))
        .agg(F.sum("total_value_usd").alias("_v"))
    )
    w = Window.partitionBy("category").orderBy("month")
    prev = F.lag("_v").over(w)
    return monthly.select(
        "category",
        "month",
        F.col("_v").cast("double").alias("total_value"),
        prev.cast("double").alias("previous_value"),
        F.when(prev > 0, (F.col("_v").cast("double") - prev.cast("double")) * 100 / prev.cast("double")).alias("growth_pct"),
    )


def compare_top_companies(store: Store) -> DataFrame:
    """A40 "A vs B": the two importers with the highest total value, month
    by month side by side (conditional aggregation, no pivot of all keys)."""
    tx = store.facts(["company_id", "date", "total_value_usd"])
    totals = tx.groupBy("company_id").agg(F.sum("total_value_usd").alias("_t"))
    top2 = totals.orderBy(F.col("_t").desc(), F.col("company_id").asc()).limit(2)
    ranked = top2.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_t").desc(), F.col("company_id").asc())))
    lines = tx.join(ranked.select("company_id", "_r"), "company_id")
    agg = lines.groupBy(month_key("date").alias("month")).agg(
        F.coalesce(F.sum(F.when(F.col("_r") == 1, F.col("total_value_usd"))), F.lit(0)).cast("double").alias("first_value"),
        F.coalesce(F.sum(F.when(F.col("_r") == 2, F.col("total_value_usd"))), F.lit(0)).cast("double").alias("second_value"),
        F.count_if(F.col("_r") == 1).alias("first_count"),
        F.count_if(F.col("_r") == 2).alias("second_count"),
    )
    return agg


def recommend_companies(store: Store, k: int = 5) -> DataFrame:
    """A40 "which companies for a category": top-``k`` importers by value
    in every category."""
    tx = store.facts(["company_id", "goods_id", "total_value_usd"])
    per = store.attach_goods(tx).groupBy("category", "company_id").agg(
        F.sum("total_value_usd").alias("_v"), F.count(F.lit(1)).alias("transaction_count")
    )
    top = top_k_per_group(per, ["category"], [F.col("_v").desc(), F.col("company_id").asc()], k)
    names = store.companies().select("company_id", F.col("name").alias("company_name"))
    return top.join(names, "company_id", "left").select(
        "category", "rank", "company_id", "company_name", F.col("_v").cast("double").alias("total_value"), "transaction_count"
    )
