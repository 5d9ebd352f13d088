"""In-session aggregation engine semantics (A24-A31, X14) on Spark.

These follow the "js" null semantics of the reference's second engine,
which differ on purpose from ``operators.aggregate`` ("sql" semantics):

* group key = ``String(x || "Unknown")`` — NULL, ``''``, 0 and false all
  fall in the ``Unknown`` group;
* value = ``Number(x) || 0`` — NULLs count as 0 in sum, average, min, max;
* result rows ``(key, value, count)`` ordered by value desc (key asc as the
  tie-break).

The roll-up cache (A27/A29) is one ``GROUPING SETS`` aggregation — a single
scan and a single shuffle for all dimensions — returned in long form
``(dim, key, value, count)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.functions.numbers import js_number, month_key
from tradelens.sources.store import Store

ENGINE_OPERATIONS = ("count", "sum", "average", "min", "max")


@dataclass(frozen=True)
class AggregationSpec:
    field: str
    operation: str
    group_by: str | None = None

    def __post_init__(self):
        if self.operation not in ENGINE_OPERATIONS:
            raise ValueError(f"unknown operation {self.operation!r}")
        if not self.field:
            raise ValueError("field must be non-empty")


# engine field -> (fact column, or dimension it comes from)
_VIEW_FACT = ("declaration_number", "date", "import_country", "customs_office", "quantity", "unit", "unit_price_usd", "total_value_usd", "month")
_VIEW_COMPANY = {"import_company_name": "name", "import_company_address": "address"}
VIEW_FIELDS = (
    "declaration_number", "date", "import_company_name", "import_company_address", "category_name", "import_country",
    "customs_office", "goods_name", "quantity", "unit", "unit_price_usd", "total_value_usd", "month",
)


def engine_view(store: Store, fields: Sequence[str] | None = None, goods_first: bool = False) -> DataFrame:
    """The denormalised row the engine works on: fact ⟕ company ⟕ goods ⟕
    category, restricted to ``fields`` (default all of ``VIEW_FIELDS``).

    Only the tables the fields come from are read and joined: a left join
    to a dimension cannot be dropped by the optimizer, so a total over one
    fact column must not ask for it in the first place."""
    from tradelens.schema import resolve

    wanted = VIEW_FIELDS if fields is None else tuple(dict.fromkeys(resolve(f, VIEW_FIELDS) for f in fields))
    unknown = [f for f in wanted if f not in VIEW_FIELDS]
    if unknown:
        raise ValueError(f"unknown fields {unknown}")
    company = [f for f in wanted if f in _VIEW_COMPANY]
    goods = "goods_name" in wanted
    category = "category_name" in wanted
    columns = [f for f in wanted if f in _VIEW_FACT] + ["company_id"] * bool(company)
    of_goods = ({"raw_name": "goods_name"} if goods else {}, "category_name" if category else None)
    goods_first = goods_first and (goods or category)
    out = store.goods_facts(columns, *of_goods) if goods_first else store.facts(columns + ["goods_id"] * (goods or category))
    if company:
        dim = store.companies().select("company_id", *[F.col(_VIEW_COMPANY[f]).alias(f) for f in company])
        out = out.join(dim, "company_id", "left")
    if (goods or category) and not goods_first:
        out = store.attach_goods(out, *of_goods)
    return out.select(*wanted)


def js_key(c: Column, dt: T.DataType) -> Column:
    """``String(x || "Unknown")``."""
    if isinstance(dt, T.StringType):
        return F.when(c.isNull() | (c == ""), F.lit("Unknown")).otherwise(c)
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("true")).otherwise(F.lit("Unknown"))
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.when(c.isNull() | (c == 0), F.lit("Unknown")).otherwise(c.cast("string"))
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        text = F.when(d == F.floor(d), F.floor(d).cast("long").cast("string")).otherwise(d.cast("string"))
        return F.when(d.isNull() | (d == 0) | F.isnan(d), F.lit("Unknown")).otherwise(text)
    return F.coalesce(c.cast("string"), F.lit("Unknown"))


def js_value(c: Column, dt: T.DataType) -> Column:
    """``Number(x) || 0``; decimals stay exact (summed without float error)."""
    if isinstance(dt, T.DecimalType):
        return F.coalesce(c, F.lit(0).cast(dt))
    v = js_number(c, dt.simpleString())
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)


def _value_aggs(v: Column, op: str) -> Column:
    n = F.count(F.lit(1))
    if op == "count":
        return n.cast("double")
    if op == "sum":
        return F.sum(v).cast("double")
    if op == "average":
        return F.sum(v).cast("double") / n
    if op == "min":
        return F.min(v).cast("double")
    return F.max(v).cast("double")


def _col_name(df: DataFrame, name: str) -> str:
    from tradelens.schema import resolve

    out = resolve(name, df.columns)
    if out not in df.columns:
        raise ValueError(f"unknown field {name!r}")
    return out


def group_by(df: DataFrame, key_field: str, value_field: str, operation: str) -> DataFrame:
    """``(key, value, count)`` per js-key group, value desc, key asc."""
    AggregationSpec(value_field, operation, key_field)
    key_field, value_field = _col_name(df, key_field), _col_name(df, value_field)
    sch = df.schema
    key = js_key(F.col(key_field), sch[key_field].dataType).alias("key")
    val = js_value(F.col(value_field), sch[value_field].dataType)
    return (
        df.select(key, val.alias("_v"))
        .groupBy("key")
        .agg(_value_aggs(F.col("_v"), operation).alias("value"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("value").desc(), F.col("key").asc())
    )


def compute_total(df: DataFrame, value_field: str, operation: str) -> DataFrame:
    """One row ``("Total", value, count)``; no rows -> value 0, count 0."""
    AggregationSpec(value_field, operation)
    value_field = _col_name(df, value_field)
    val = js_value(F.col(value_field), df.schema[value_field].dataType)
    agg = df.select(val.alias("_v")).agg(_value_aggs(F.col("_v"), operation).alias("value"), F.count(F.lit(1)).alias("count"))
    return agg.select(F.lit("Total").alias("key"), F.coalesce("value", F.lit(0.0)).alias("value"), "count")


def compute_aggregation(df: DataFrame, spec: AggregationSpec) -> DataFrame:
    return group_by(df, spec.group_by, spec.field, spec.operation) if spec.group_by else compute_total(df, spec.field, spec.operation)


def compute_aggregations(df: DataFrame, specs: Sequence[AggregationSpec]) -> DataFrame:
    """Many specs in one call, long form ``(spec_id, key, value, count)``.

    One grouping-sets pass computes all of them: the rows are read once and
    shuffled once, whatever the number of specs and key fields."""
    resolved = [AggregationSpec(_col_name(df, s.field), s.operation, _col_name(df, s.group_by) if s.group_by else None) for s in specs]
    if not resolved:
        raise ValueError("no aggregation given")
    sch = df.schema
    key_fields = list(dict.fromkeys(s.group_by for s in resolved if s.group_by))
    base = df.select(
        *[js_key(F.col(k), sch[k].dataType).alias(f"_k{i}") for i, k in enumerate(key_fields)],
        *[js_value(F.col(v), sch[v].dataType).alias(f"_v_{v}") for v in sorted({s.field for s in resolved})],
    )
    aggs = [F.count(F.lit(1)).alias("count")] + [_value_aggs(F.col(f"_v_{s.field}"), s.operation).alias(f"_a{i}") for i, s in enumerate(resolved)]
    total = any(s.group_by is None for s in resolved)
    if key_fields:
        keys = [F.col(f"_k{i}") for i in range(len(key_fields))]
        agg = base.groupingSets([[k] for k in keys] + ([[]] if total else []), *keys).agg(F.grouping_id().alias("_gid"), *aggs)
    else:
        agg = base.agg(*aggs).withColumn("_gid", F.lit(0).cast("long"))
    n = len(key_fields)
    gid = {k: (1 << n) - 1 - (1 << (n - 1 - i)) for i, k in enumerate(key_fields)} | {None: (1 << n) - 1}
    rows = [
        F.when(
            F.col("_gid") == gid[s.group_by],
            F.struct(
                F.lit(i).cast("long").alias("spec_id"),
                (F.col(f"_k{key_fields.index(s.group_by)}") if s.group_by else F.lit("Total")).alias("key"),
                F.coalesce(F.col(f"_a{i}"), F.lit(0.0)).alias("value"),
            ),
        )
        for i, s in enumerate(resolved)
    ]
    return agg.select("count", F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("s")).select("s.spec_id", "s.key", "s.value", "count")


# ---------------------------------------------------------------- roll-up cache

CACHE_DIMENSIONS = {
    "importCompany": "import_company_name",
    "category": "category_name",
    "country": "import_country",
    "goods": "goods_name",
}


def build_cache(view: DataFrame, value_field: str = "total_value_usd", extras: bool = False, only: Sequence[str] | None = None) -> DataFrame:
    """A27 (A29 with ``extras``): Σ value and count by importer, category,
    import country and month (``yyyy-MM``; rows without a date skipped) —
    plus goods name and the grand total with ``extras`` — in ONE grouping
    sets pass.  Long form ``(dim, key, value, count)``.  ``only`` restricts
    the cache to some of its dimensions (and the view to their fields).

    Keys are made non-NULL (``Unknown``) *before* grouping and the sets are
    told apart by ``grouping_id()``, never by NULL."""
    sch = view.schema
    dims = ["importCompany", "category", "country"] + (["goods"] if extras else [])
    with_month, with_total = True, extras
    if only is not None:
        unknown = set(only) - {*CACHE_DIMENSIONS, "month", "total"}
        if unknown:
            raise ValueError(f"unknown cache dimension(s): {sorted(unknown)}")
        dims, with_month, with_total = [d for d in CACHE_DIMENSIONS if d in only], "month" in only, "total" in only
    cols = {d: js_key(F.col(CACHE_DIMENSIONS[d]), sch[CACHE_DIMENSIONS[d]].dataType).alias(d) for d in dims}
    base = view.select(
        *cols.values(),
        *([month_key("date").alias("month")] if with_month else []),
        js_value(F.col(value_field), sch[value_field].dataType).alias("_v"),
    )
    keys = dims + (["month"] if with_month else [])
    sets = [[F.col(k)] for k in keys] + ([[]] if with_total else [])
    agg = base.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_gid"),
        F.sum("_v").cast("double").alias("value"),
        F.count(F.lit(1)).alias("count"),
    )
    n = len(keys)
    dim_col = F.lit("total")
    key_col = F.lit("Total")
    for i, k in enumerate(keys):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))  # only key i is grouped
        dim_col = F.when(F.col("_gid") == gid, F.lit(k)).otherwise(dim_col)
        key_col = F.when(F.col("_gid") == gid, F.col(k)).otherwise(key_col)
    out = agg.select(dim_col.alias("dim"), key_col.alias("key"), "value", "count")
    return out.filter(~((F.col("dim") == "month") & F.col("key").isNull()))


def cache_top_n(cache: DataFrame, dim: str, n: int, sort_by: str = "value") -> DataFrame:
    """The first ``n`` entries of one dimension by value (or count)."""
    if sort_by not in ("value", "count"):
        raise ValueError("sort_by must be 'value' or 'count'")
    return cache.filter(F.col("dim") == dim).orderBy(F.col(sort_by).desc(), F.col("key").asc()).limit(n)


def full_data_points(df: DataFrame, key_field: str, value_field: str) -> DataFrame:
    """Count, sum, average, min and max per js-key group together."""
    key_field, value_field = _col_name(df, key_field), _col_name(df, value_field)
    sch = df.schema
    v = js_value(F.col(value_field), sch[value_field].dataType)
    return (
        df.select(js_key(F.col(key_field), sch[key_field].dataType).alias("key"), v.alias("_v"))
        .groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("_v").cast("double").alias("sum"),
            (F.sum("_v").cast("double") / F.count(F.lit(1))).alias("average"),
            F.min("_v").cast("double").alias("min"),
            F.max("_v").cast("double").alias("max"),
        )
    )


def time_series(df: DataFrame, value_field: str = "total_value_usd", operation: str = "sum", date_field: str = "date") -> DataFrame:
    """One point per ``yyyy-MM`` month, ascending."""
    value_field = _col_name(df, value_field)
    v = js_value(F.col(value_field), df.schema[value_field].dataType)
    return (
        df.filter(F.col(date_field).isNotNull())
        .select(month_key(date_field).alias("month"), v.alias("_v"))
        .groupBy("month")
        .agg(_value_aggs(F.col("_v"), operation).alias("value"), F.count(F.lit(1)).alias("count"))
        .orderBy("month")
    )


# ---------------------------------------------------------------- X14 summary text

_HEADERS = {"count": "Count", "sum": "Total", "average": "Average", "min": "Min", "max": "Max"}


def summary_text(result: DataFrame, spec: AggregationSpec, total_records: int | None = None, top: int = 20) -> DataFrame:
    """One-row text block — header, the first ``top`` data points as
    ``  key: $value (n txns)`` and a ``Total records`` line.

    ``result`` is a ``(key, value, count)`` frame; ``total_records``
    defaults to the sum of its counts (the input size of a grouped spec).
    Only the ``top`` lines are gathered into the text."""
    money = spec.field in ("totalValueUSD", "total_value_usd") or spec.operation == "sum"
    val = F.col("value")
    shown = F.concat(F.lit("$"), F.format_number(F.round(val, 0), 0)) if money else F.format_string("%.2f", val)
    count_info = F.when(F.col("count") > 0, F.concat(F.lit(" ("), F.col("count").cast("string"), F.lit(" txns)"))).otherwise(F.lit(""))
    line = F.concat(F.lit("  "), F.col("key"), F.lit(": "), shown, count_info)
    # the first ``top`` rows come from a distributed top-k; only they get a rank
    limited = result.orderBy(F.col("value").desc(), F.col("key").asc()).limit(top)
    limited = limited.withColumn("_rank", F.row_number().over(_order_window()))
    entry = F.struct(F.col("_rank"), line.alias("line"))
    u = limited.select(entry.alias("_s"), F.lit(0).alias("_all"), F.lit(0).cast("long").alias("_c")).unionByName(
        result.select(
            F.lit(None).cast(limited.select(entry.alias("_s")).schema["_s"].dataType).alias("_s"),
            F.lit(1).alias("_all"),
            F.col("count").cast("long").alias("_c"),
        )
    )
    header = f"{_HEADERS[spec.operation]} by {spec.group_by or 'Overall'}"
    agg = u.agg(
        F.sort_array(F.collect_list("_s")).alias("_lines"),
        F.count_if(F.col("_all") == 1).alias("_n"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("_records"),
    )
    total = F.lit(total_records) if total_records is not None else F.col("_records")
    tail = F.concat(
        F.lit("Total records: "),
        total.cast("string"),
        F.when(F.col("_n") > top, F.concat(F.lit(f", showing top {top} of "), F.col("_n").cast("string"))).otherwise(F.lit("")),
    )
    body = F.array_join(F.transform("_lines", lambda s: s["line"]), "\n")
    return agg.select(F.concat_ws("\n", F.lit(header), body, tail).alias("text"))


def _order_window():
    from pyspark.sql import Window

    # applied only after limit(top): at most ``top`` rows
    return Window.orderBy(F.col("value").desc(), F.col("key").asc())
