"""Stored roll-up states: the roll-up cache (A27-A29) that outlives a call.

Every import writes, beside its lines, the partial aggregates of those lines
by company, goods, import country and month and in total (``fact_states``:
one grouping-sets pass over the new lines), and per company a HyperLogLog
sketch of its goods (A22).  Partial aggregates merge by sum, min, max and
sketch union, so the cache of the whole store is the merge of the states of
its commits: a top-N reads states, never lines.  ``compact_states`` merges
the states so far into one commit that stands for all before it.

States are kept by id (company, goods), not by name or category: names and
categories live in the dimensions and may change (enrichment), so they are
attached when the cache is read.  A store whose lines have no states (written
by other means) has them computed from those lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions.numbers import month_key
from tradelens.operators.engine import js_key, js_value
from tradelens.sources.commits import WRITE, Commit, CommitLog, children, commit, last_number, read_table, read_writes
from tradelens.sources.store import ParquetStore, Store

TABLE = "rollup_states"
STATE_FACTS = ("company_id", "goods_id", "import_country", "date", "total_value_usd", "quantity")
DIMS = ("company", "goods", "country", "month", "total")
SKETCH_SIZE = 11  # log2 of the registers: about 2 % standard error


def fact_states(facts: DataFrame) -> DataFrame:
    """Partial aggregates of fact lines: ``dim, id, key, lines, value,
    quantity, min_value, max_value, first_date, last_date, goods_sketch``.

    ``value`` is a sum with null as zero (the cache's semantics); ``id`` is
    the company or goods id, ``key`` the country or month."""
    types = {f.name: f.dataType for f in facts.schema.fields}
    base = facts.select(
        "company_id",
        "goods_id",
        F.col("import_country").alias("country"),
        month_key("date").alias("month"),
        "date",
        js_value(F.col("total_value_usd"), types["total_value_usd"]).alias("_v"),
        js_value(F.col("quantity"), types["quantity"]).alias("_q"),
    )
    keys = ["company_id", "goods_id", "country", "month"]
    found = base.groupingSets([[F.col(k)] for k in keys] + [[]], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_gid"),
        F.count(F.lit(1)).alias("lines"),
        F.sum("_v").alias("value"),
        F.sum("_q").alias("quantity"),
        F.min("_v").alias("min_value"),
        F.max("_v").alias("max_value"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    dim = F.lit(DIMS[-1])
    for i, d in enumerate(DIMS[:-1]):
        dim = F.when(F.col("_gid") == 0b1111 - (1 << (3 - i)), F.lit(d)).otherwise(dim)
    amounts = ("lines", "value", "quantity", "min_value", "max_value", "first_date", "last_date")
    states = found.select(
        dim.alias("dim"), F.coalesce("company_id", "goods_id").alias("id"), F.coalesce("country", "month").alias("key"), *amounts, F.lit(None).cast("binary").alias("goods_sketch")
    ).filter("lines > 0")  # an empty input still has a total
    # pairs first: the sketch then sees each pair once, and no company's lines meet in one task
    pairs = facts.select("company_id", "goods_id").distinct()
    sketches = pairs.groupBy("company_id").agg(F.hll_sketch_agg("goods_id", SKETCH_SIZE).alias("goods_sketch"))
    empty = [F.lit(None).cast(states.schema[a].dataType).alias(a) for a in amounts]
    return states.unionByName(sketches.select(F.lit("company_goods").alias("dim"), F.col("company_id").alias("id"), F.lit(None).cast("string").alias("key"), *empty, "goods_sketch"))


def merge_states(states: DataFrame) -> DataFrame:
    """States of all parts as one: equal to ``fact_states`` of all their lines."""
    sums = ("lines", "value", "quantity")
    amounts = states.filter(F.col("dim") != "company_goods").groupBy("dim", "id", "key").agg(
        *[F.sum(c).cast(states.schema[c].dataType).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in ("min_value", "first_date")],
        *[F.max(c).alias(c) for c in ("max_value", "last_date")],
    )
    sketches = states.filter(F.col("dim") == "company_goods").groupBy("dim", "id").agg(F.hll_union_agg("goods_sketch").alias("goods_sketch"))
    out = amounts.unionByName(sketches, allowMissingColumns=True)
    return out.select("dim", "id", "key", "lines", "value", "quantity", "min_value", "max_value", "first_date", "last_date", "goods_sketch")


def write_states(states: DataFrame, folder: str) -> None:
    """A folder per dimension: a reader of one opens that one."""
    states.write.partitionBy("dim").parquet(folder)


def read_states(spark: SparkSession, root: str, entries: Sequence[Commit]) -> DataFrame | None:
    """The unmerged states of every line of a store, None if it has no lines."""
    root = root.rstrip("/")
    covering = max((c for c in entries if c.kind == "states"), key=lambda c: c.covers, default=None)
    since = covering.covers if covering else 0
    later = [c for c in entries if c.kind == "import" and c.number > since]
    parts = [read_writes(spark, root, TABLE, [*([covering] if covering else []), *later])]
    bare = [c for c in later if TABLE not in c.tables]
    whole = [n for n in children(spark, f"{root}/{TABLE}") if not n.startswith(("_", WRITE))]
    if covering:
        lines = read_writes(spark, root, "transactions", bare)
    elif whole:
        parts.append(spark.read.option("basePath", f"{root}/{TABLE}").parquet(*[f"{root}/{TABLE}/{n}" for n in whole]))
        lines = read_writes(spark, root, "transactions", bare)
    else:
        lines = read_table(spark, root, "transactions", bare)
    if lines is not None:
        parts.append(fact_states(lines.select(*STATE_FACTS)))
    columns = ["dim", "id", "key", "lines", "value", "quantity", "min_value", "max_value", "first_date", "last_date", "goods_sketch"]
    parts = [p.select(*columns) for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def compact_states(spark: SparkSession, root: str) -> Commit | None:
    """Merge the states of all commits so far into one commit (``updateCache``
    of the stored cache).  Imports may go on meanwhile: their states are read
    beside the merged ones until the next compaction."""
    root, log = root.rstrip("/"), CommitLog(spark, root)
    entries = log.entries()
    states = read_states(spark, root, entries)
    if states is None:
        return None
    merged = merge_states(states)

    def write(write_id: str, _number: int) -> list[str]:
        write_states(merged, f"{root}/{TABLE}/{WRITE}{write_id}")
        return [TABLE]

    covers = last_number(entries)
    return commit(log, "states", "states", covers, write, lambda newer: False, covers=covers)


def cache_from_states(store: Store, states: DataFrame, dims: Sequence[str] = ("importCompany", "category", "country", "month")) -> DataFrame:
    """A27/A29 in the long form of ``build_cache`` (``dim, key, value,
    count``) from stored states; names and categories are today's."""

    def part(dim: str) -> DataFrame:
        of = {"importCompany": "company", "goods": "goods", "category": "goods", "country": "country", "month": "month", "total": "total"}
        if dim not in of:
            raise ValueError(f"unknown cache dimension {dim!r}")
        rows = states.filter(F.col("dim") == of[dim]).groupBy("id", "key").agg(F.sum("value").alias("value"), F.sum("lines").alias("count"))
        if dim == "importCompany":
            rows = rows.join(store.companies().select(F.col("company_id").alias("id"), F.col("name").alias("_name")), "id", "left")
        elif dim in ("goods", "category"):
            goods = rows.withColumnRenamed("id", "goods_id")
            rows = store.attach_goods(goods, {"raw_name": "_name"} if dim == "goods" else {}, "_name" if dim == "category" else None)
        else:
            rows = rows.withColumn("_name", F.lit("Total") if dim == "total" else F.col("key"))
        if dim == "month":
            named = rows.filter("_name is not null").select(F.col("_name").alias("key"), "value", "count")
        else:
            named = rows.select(js_key(F.col("_name"), rows.schema["_name"].dataType).alias("key"), "value", "count")
        total = named.groupBy("key").agg(F.sum("value").cast("double").alias("value"), F.sum("count").alias("count"))
        return total.select(F.lit(dim).alias("dim"), "key", "value", "count")

    return reduce(DataFrame.unionByName, [part(d) for d in dims])


def stored_cache(store: ParquetStore, dims: Sequence[str] = ("importCompany", "category", "country", "month")) -> DataFrame:
    """The roll-up cache of a Parquet store, from its stored states."""
    return cache_from_states(store, read_states(store.spark, store.root, store.commits), dims)


def company_goods_estimate(states: DataFrame) -> DataFrame:
    """A22, estimated: distinct goods per company from the merged sketches."""
    merged = states.filter(F.col("dim") == "company_goods").groupBy(F.col("id").alias("company_id")).agg(F.hll_union_agg("goods_sketch").alias("_s"))
    return merged.select("company_id", F.hll_sketch_estimate("_s").alias("unique_goods_estimate"))
