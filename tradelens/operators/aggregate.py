"""The aggregation tool catalogue (A1-A12) and match documents.

``aggregate_transactions`` is match -> group (0..n keys) -> n aggregates ->
sort -> skip -> limit over the fact table, with the document-store
("sql") null semantics: ``sum`` skips NULLs and is 0 on an empty group,
``avg/min/max`` skip NULLs, ``count`` counts rows, and a global group over
no rows yields no row.  Every stage is a DataFrame operation; the group is
a partially-aggregated hash aggregate, the sort+limit a
``TakeOrderedAndProject``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.operators.listing import order_columns, sort_spec
from tradelens.schema import DATE_FIELDS, GROUPABLE_FIELDS, NUMERIC_FIELDS, field
from tradelens.sources.store import Store

OPERATIONS = ("sum", "avg", "min", "max", "count")


class AggregationValidationError(ValueError):
    """Typed validation error ``(field, operation, reason)``."""

    def __init__(self, field_name: str, operation: str, reason: str):
        super().__init__(f"{operation} cannot use {field_name!r}: {reason}")
        self.field = field_name
        self.operation = operation
        self.reason = reason


def validate_numeric(name: str) -> str:
    col = field(name)
    if col not in NUMERIC_FIELDS:
        raise AggregationValidationError(name, "numeric aggregation", f"allowed fields are {', '.join(NUMERIC_FIELDS)}")
    return col


def validate_groupable(name: str) -> str:
    col = field(name)
    if col not in GROUPABLE_FIELDS:
        raise AggregationValidationError(name, "grouping", f"allowed fields are {', '.join(GROUPABLE_FIELDS)}")
    return col


def validate_date(name: str) -> str:
    col = field(name)
    if col not in DATE_FIELDS:
        raise AggregationValidationError(name, "date operation", f"allowed fields are {', '.join(DATE_FIELDS)}")
    return col


# ---------------------------------------------------------------- match documents

_COMPARE = {"$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", "$options", "$not"}


class MatchError(ValueError):
    pass


def _lit_for(value, data_type: T.DataType | None) -> Column:
    if isinstance(value, str) and isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(value).cast(data_type)
    return F.lit(value)


def _regex(c: Column, pattern: str, options: str = "") -> Column:
    flags = "".join(ch for ch in options if ch in "imsx")
    prefix = f"(?{flags}u)" if "i" in flags else (f"(?{flags})" if flags else "")
    return c.rlike(prefix + pattern)


def _field_predicate(c: Column, spec, data_type, keep: bool) -> Column:
    """One field's condition.  With ``keep`` the result only decides which
    rows a filter keeps, where NULL and false are the same, so comparisons
    stay bare and reach the scan; under a negation NULL must become false
    first."""

    def false_if_null(x: Column) -> Column:
        return x if keep else F.coalesce(x, F.lit(False))

    if isinstance(spec, Mapping) and spec and all(str(k).startswith("$") for k in spec):
        unknown = set(spec) - _COMPARE
        if unknown:
            raise MatchError(f"unknown match operator(s): {sorted(unknown)}")
        conds = []
        for op, v in spec.items():
            if op == "$eq":
                conds.append(c.isNull() if v is None else false_if_null(c == _lit_for(v, data_type)))
            elif op == "$ne":
                conds.append(c.isNotNull() if v is None else ~c.eqNullSafe(_lit_for(v, data_type)))
            elif op in ("$gt", "$gte", "$lt", "$lte"):
                lv = _lit_for(v, data_type)
                cmp = {"$gt": c > lv, "$gte": c >= lv, "$lt": c < lv, "$lte": c <= lv}[op]
                conds.append(false_if_null(cmp))
            elif op in ("$in", "$nin"):
                vals = list(v)
                non_null = [x for x in vals if x is not None]
                inside = c.isin(*[_lit_for(x, data_type) for x in non_null]) if non_null else F.lit(False)
                if op == "$in":
                    inside = false_if_null(inside)
                    conds.append(inside | c.isNull() if len(non_null) < len(vals) else inside)
                else:
                    inside = F.coalesce(inside, F.lit(False))
                    conds.append(~(inside | c.isNull()) if len(non_null) < len(vals) else ~inside)
            elif op == "$exists":
                conds.append(c.isNotNull() if v else c.isNull())
            elif op == "$regex":
                conds.append(false_if_null(_regex(c, v, spec.get("$options", ""))))
            elif op == "$not":
                conds.append(~_field_predicate(c, v, data_type, keep=False))
        if not conds:
            raise MatchError("empty condition")
        out = conds[0]
        for x in conds[1:]:
            out = out & x
        return out
    if spec is None:
        return c.isNull()
    return false_if_null(c == _lit_for(spec, data_type))


def match_to_column(doc: Mapping | None, schema: T.StructType | None = None, keep: bool = True) -> Column:
    """Compile a match document into one boolean Column.

    Supports implicit equality, ``$eq $ne $gt $gte $lt $lte $in $nin
    $exists $regex/$options $not`` per field and ``$and $or $nor`` lists.
    ``{f: null}`` matches NULL; ``$ne``/``$nin`` match NULL rows.  The
    result is meant for ``filter``: a row is kept where it is true (it may be
    NULL where the document store says false).  Inside ``$not``/``$nor``
    conditions are never NULL, so negations behave like the document store."""
    if not doc:
        return F.lit(True)
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    conds = []
    for key, spec in doc.items():
        if key in ("$and", "$or", "$nor"):
            parts = [match_to_column(d, schema, keep and key != "$nor") for d in spec]
            if not parts:
                raise MatchError(f"{key} needs a non-empty list")
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if key == "$and" else (out | p)
            conds.append(~out if key == "$nor" else out)
        elif str(key).startswith("$"):
            raise MatchError(f"unknown top-level operator {key!r}")
        else:
            col = field(key)
            conds.append(_field_predicate(F.col(col), spec, types.get(col), keep))
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def match_fields(doc: Mapping | None) -> set[str]:
    """Fact columns a match document reads."""
    out: set[str] = set()
    for key, spec in (doc or {}).items():
        if key in ("$and", "$or", "$nor"):
            for d in spec:
                out |= match_fields(d)
        else:
            out.add(field(key))
    return out


def match_dates(doc: Mapping | None) -> tuple | None:
    """Date range every matching row lies in, from the document's top-level
    (and ``$and``) conditions on ``date``; None when it gives none."""
    lo, hi = None, None
    for d in [doc or {}, *(doc or {}).get("$and", [])]:
        spec = d.get("date")
        if isinstance(spec, str):
            spec = {"$eq": spec}
        if not isinstance(spec, Mapping):
            continue
        for op, v in spec.items():
            if not isinstance(v, str) or not re.match(r"^\d{4}-\d{2}", v):
                continue
            if op in ("$eq", "$gt", "$gte"):
                lo = v if lo is None else max(lo, v)
            if op in ("$eq", "$lt", "$lte"):
                hi = v if hi is None else min(hi, v)
    return (lo, hi) if lo or hi else None


# ---------------------------------------------------------------- A1 generic aggregate


@dataclass(frozen=True)
class AggregationConfig:
    field: str
    operation: str
    alias: str | None = None

    @property
    def output(self) -> str:
        # the default alias names the field as the caller wrote it (``sum_totalValueUSD``)
        return self.alias or f"{self.operation}_{self.field}"


def _as_configs(aggregations) -> list[AggregationConfig]:
    out = []
    for a in aggregations or []:
        if isinstance(a, AggregationConfig):
            out.append(a)
        else:
            out.append(AggregationConfig(a["field"], a["operation"], a.get("alias")))
    return out


def _agg_expr(cfg: AggregationConfig, data_type: T.DataType) -> Column:
    col = F.col(validate_numeric(cfg.field))
    op = cfg.operation
    if op == "sum":
        zero = F.lit(0).cast(data_type) if isinstance(data_type, T.DecimalType) else F.lit(0)
        return F.coalesce(F.sum(col), zero)
    if op == "avg":
        if isinstance(data_type, T.DecimalType):
            # exact sum, one double division: independent of row order
            return F.sum(col).cast("double") / F.count(col)
        return F.avg(col)
    if op == "min":
        return F.min(col)
    if op == "max":
        return F.max(col)
    if op == "count":
        return F.count(F.lit(1))
    raise AggregationValidationError(cfg.field, op, f"known operations are {', '.join(OPERATIONS)}")


def _sort_key(name: str, outputs: Sequence[str]) -> str:
    """A sort key names an output column, or the field behind one."""
    for candidate in (name, field(name)):
        if candidate in outputs:
            return candidate
    raise AggregationValidationError(name, "sort", f"output columns are {', '.join(outputs)}")


def aggregate_frame(
    df: DataFrame,
    aggregations,
    group_by: Sequence[str] | None = None,
    match: Mapping | None = None,
    sort: Mapping[str, int] | None = None,
    limit: int | None = None,
    skip: int | None = None,
    raw_decimals: bool = False,
) -> DataFrame:
    """A1 over any fact-shaped DataFrame."""
    configs = _as_configs(aggregations)
    if not configs:
        raise AggregationValidationError("aggregations", "pipeline", "no aggregation given")
    keys = [validate_groupable(g) for g in (group_by or [])]
    if match:
        df = df.filter(match_to_column(match, df.schema))
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs = [_agg_expr(cfg, types[validate_numeric(cfg.field)]).alias(cfg.output) for cfg in configs]
    if keys:
        out = df.groupBy(*keys).agg(*exprs)
    else:
        # a global group over no rows yields no row (document-store rule)
        out = df.agg(*exprs, F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 0).drop("__n")
    if not raw_decimals:
        out = out.select(*[F.col(c).cast("double").alias(c) if isinstance(out.schema[c].dataType, T.DecimalType) else F.col(c) for c in out.columns])
    if sort:
        out = out.orderBy(*order_columns(sort_spec({_sort_key(k, out.columns): v for k, v in sort.items()}), keys))
    if skip is not None and skip > 0:
        out = out.offset(skip)
    if limit is not None and limit > 0:
        out = out.limit(limit)
    return out


def _needed(aggregations, group_by, match) -> list[str]:
    cols = {validate_numeric(a.field) for a in _as_configs(aggregations)}
    cols |= {validate_groupable(g) for g in (group_by or [])}
    cols |= match_fields(match)
    return sorted(cols)


def aggregate_transactions(store: Store, aggregations, group_by=None, match=None, sort=None, limit=None, skip=None, raw_decimals=False) -> DataFrame:
    """A1: the generic tool; reads only the fact columns it needs."""
    df = store.facts(_needed(aggregations, group_by, match), dates=match_dates(match))
    return aggregate_frame(df, aggregations, group_by, match, sort, limit, skip, raw_decimals)


# ---------------------------------------------------------------- A7-A10 helpers


def _scalar_frame(df: DataFrame, name: str) -> DataFrame:
    """One row holding ``name`` (0 when the aggregate produced no row)."""
    return df.agg(F.coalesce(F.first(name), F.lit(0)).cast("double").alias(name))


def sum_field(store: Store, field_name: str, match=None) -> DataFrame:
    """A7 sumField: one row ``sum_<field>``, 0 when nothing matches."""
    name = f"sum_{field(field_name)}"
    return _scalar_frame(aggregate_transactions(store, [AggregationConfig(field_name, "sum", name)], match=match), name)


def avg_field(store: Store, field_name: str, match=None) -> DataFrame:
    """A7 avgField: one row ``avg_<field>``, 0 when nothing matches."""
    name = f"avg_{field(field_name)}"
    return _scalar_frame(aggregate_transactions(store, [AggregationConfig(field_name, "avg", name)], match=match), name)


def count_transactions(store: Store, match=None) -> DataFrame:
    """A7 countTransactions: one row ``count``."""
    df = store.facts(sorted(match_fields(match)) or ["declaration_number"], dates=match_dates(match))
    if match:
        df = df.filter(match_to_column(match, df.schema))
    return df.agg(F.count(F.lit(1)).alias("count"))


def get_top_by_field(store: Store, field_name: str, group_by: Sequence[str], operation: str = "sum", limit: int = 10, match=None) -> DataFrame:
    """A8 getTopByField: group, aggregate, sort descending, first ``limit``."""
    alias = f"{operation}_{field(field_name)}"
    return aggregate_transactions(
        store, [AggregationConfig(field_name, operation, alias)], group_by=group_by, match=match, sort={alias: -1}, limit=limit
    )


def count_and_group(store: Store, group_by: Sequence[str], match=None) -> DataFrame:
    """A9 countAndGroup: number of distinct key combinations (NULL is a group)."""
    if not group_by:
        raise AggregationValidationError("groupBy", "count and group", "no groupBy field given")
    keys = [validate_groupable(g) for g in group_by]
    df = store.facts(sorted(set(keys) | match_fields(match)), dates=match_dates(match))
    if match:
        df = df.filter(match_to_column(match, df.schema))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("group_count"))


def get_distinct_values(store: Store, field_name: str, match=None, limit: int = 100) -> DataFrame:
    """A10 getDistinctValues: distinct, ascending (NULL first), first
    ``limit`` (<= 0: all), NULL removed after the limit (Q14)."""
    col = validate_groupable(field_name)
    df = store.facts(sorted({col} | match_fields(match)), dates=match_dates(match))
    if match:
        df = df.filter(match_to_column(match, df.schema))
    out = df.select(F.col(col).alias("value")).distinct().orderBy(F.col("value").asc_nulls_first())
    if limit > 0:
        out = out.limit(limit)
    return out.filter(F.col("value").isNotNull())


# ---------------------------------------------------------------- A12 dispatch


class ToolError(ValueError):
    pass


def _tool_aggregate(store, p):
    return aggregate_transactions(
        store,
        p.get("aggregations"),
        p.get("groupBy"),
        p.get("match"),
        p.get("sort"),
        p.get("limit"),
        p.get("skip"),
        p.get("includeRawDecimals", False),
    )


TOOLS = {
    "aggregateTransactions": _tool_aggregate,
    "sumField": lambda s, p: sum_field(s, p["field"], p.get("match")),
    "avgField": lambda s, p: avg_field(s, p["field"], p.get("match")),
    "countTransactions": lambda s, p: count_transactions(s, p.get("match")),
    "getTopByField": lambda s, p: get_top_by_field(s, p["field"], p["groupBy"], p.get("operation", "sum"), p.get("limit", 10), p.get("match")),
    "countAndGroup": lambda s, p: count_and_group(s, p["groupBy"], p.get("match")),
    "getDistinctValues": lambda s, p: get_distinct_values(s, p["field"], p.get("match"), p.get("limit", 100)),
}


def run_tool(store: Store, name: str, params: Mapping) -> DataFrame:
    """Tool name -> DataFrame; an unknown name or any failure to plan the
    request (bad spec, unknown field, bad sort direction) raises ToolError."""
    if name not in TOOLS:
        raise ToolError(f"no tool named {name!r}")
    try:
        return TOOLS[name](store, dict(params or {}))
    except Exception as e:
        raise ToolError(str(e)) from e


def run_tools(store: Store, requests: Sequence[Mapping]) -> list:
    """Several ``{name, parameters}`` requests -> DataFrame or ``{"error"}`` each."""
    out = []
    for req in requests:
        try:
            out.append(run_tool(store, req.get("name"), req.get("parameters", {})))
        except ToolError as e:
            out.append({"error": str(e)})
    return out
