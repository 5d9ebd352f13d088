"""Structured filter expressions with smart text matching.

A list of ``FilterExpression`` compiles to ONE boolean Column.  Numeric and
date comparisons are bare predicates on the column and reach the Parquet
scan; text matching runs on the scanned rows (its array lambdas are
interpreted, not code-generated).

Connector rule (P10): the connector stored on filter *i* joins it to filter
*i+1*, evaluated left to right with a short-circuit on a false running
result before ``AND``.  That equals: split the list at ``AND`` connectors,
OR inside each run, AND the runs (``OR`` binds tighter; the trailing
connector is ignored; an empty list keeps every row).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.functions.numbers import js_number
from tradelens.functions.synonyms import synonym_match
from tradelens.functions.text import levenshtein, normalize_text, normalize_text_py

OPERATORS = ("equals", "contains", "startsWith", "greaterThan", "lessThan", "between", "in")
STRATEGIES = ("exact", "normalized", "case-insensitive", "fuzzy")


class FilterValidationError(ValueError):
    pass


@dataclass(frozen=True)
class FilterExpression:
    field: str
    operator: str
    value: object
    match_strategy: str = "normalized"
    fuzzy_threshold: int = 2
    logical_operator: str | None = None

    @staticmethod
    def of(d: Mapping) -> FilterExpression:
        return FilterExpression(
            field=d["field"],
            operator=d["operator"],
            value=d.get("value"),
            match_strategy=d.get("matchStrategy", d.get("match_strategy", "normalized")),
            fuzzy_threshold=d.get("fuzzyThreshold", d.get("fuzzy_threshold", 2)),
            logical_operator=d.get("logicalOperator", d.get("logical_operator")),
        )


@dataclass(frozen=True)
class FilterOptions:
    remove_diacritics: bool = False
    synonyms: dict[str, list[str]] | None = None
    synonym_mode: str = "reference"


def validate_filter(f: FilterExpression, columns: Sequence[str] | None = None) -> None:
    """Enums, bounds, non-empty field, known column."""
    if not f.field:
        raise FilterValidationError("field must be non-empty")
    if f.operator not in OPERATORS:
        raise FilterValidationError(f"unknown operator {f.operator!r}")
    if f.match_strategy not in STRATEGIES:
        raise FilterValidationError(f"unknown match strategy {f.match_strategy!r}")
    if not (0 <= int(f.fuzzy_threshold) <= 5):
        raise FilterValidationError("fuzzyThreshold must be within 0..5")
    if f.logical_operator not in (None, "AND", "OR"):
        raise FilterValidationError(f"unknown logical operator {f.logical_operator!r}")
    if columns is not None and f.field not in columns:
        raise FilterValidationError(f"unknown field {f.field!r}")


def _js_string(c: Column, dt: T.DataType) -> Column:
    """``String(x)`` for a column (integral doubles print without ``.0``)."""
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        return F.when(d == F.floor(d), F.floor(d).cast("long").cast("string")).otherwise(d.cast("string"))
    return c.cast("string")


def _js_number_py(v) -> float | None:
    """``Number(v)`` on the driver; None for NaN."""
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    if v is None:
        return 0.0
    if isinstance(v, str):
        s = v.strip()
        if s == "":
            return 0.0
        try:
            return float(s)
        except ValueError:
            return None
    return None


def _comparable(c: Column, dt: T.DataType) -> Column:
    """The column as a JS number for comparisons; numeric columns stay as
    they are, so the comparison reaches the scan."""
    return c if isinstance(dt, T.NumericType) else js_number(c, dt.simpleString())


def _number_lit(value: float, dt: T.DataType) -> Column:
    """The number in the column's own kind, so no cast wraps the column."""
    if isinstance(dt, T.IntegralType) and value.is_integer() and abs(value) < 2**31:
        return F.lit(int(value))
    if isinstance(dt, T.DecimalType) and math.isfinite(value) and abs(value) < 1e15:
        return F.lit(Decimal(repr(value)))
    return F.lit(value)


def _text_match(field_str: Column, value: str, strategy: str, threshold: int, opts: FilterOptions, norm_f: Column | None = None) -> Column:
    if norm_f is None:
        norm_f = normalize_text(field_str, remove_accents=opts.remove_diacritics)
    norm_v = F.lit(normalize_text_py(value, remove_accents=opts.remove_diacritics))
    if strategy == "exact":
        return norm_f == norm_v
    if strategy == "startsWith":
        return norm_f.startswith(norm_v)
    if strategy == "fuzzy":
        dist = levenshtein(norm_f, norm_v, threshold)
        return ((dist >= 0) & (dist <= threshold)) | F.contains(norm_f, norm_v) | F.contains(norm_v, norm_f)
    return F.contains(norm_f, norm_v)


def _resolved(f: FilterExpression, schema: T.StructType) -> FilterExpression:
    from dataclasses import replace

    from tradelens.schema import resolve

    name = resolve(f.field, schema.fieldNames()) if f.field else f.field
    return f if name == f.field else replace(f, field=name)


def filter_column(f: FilterExpression, schema: T.StructType, opts: FilterOptions = FilterOptions()) -> Column:
    """One filter -> boolean Column for ``filter`` (a NULL field is
    never kept; numeric and date comparisons may be NULL there).

    A text field is normalised ONCE per row and the normalised value is
    bound to a lambda variable (``exists(array(norm), n -> pred(n))``).
    Without the binding Catalyst pushes the predicate below any projection
    and repeats the normalising regex in every synonym and substring test
    (measured 30x slower on 600k rows)."""
    f = _resolved(f, schema)
    validate_filter(f, schema.fieldNames())
    dt = schema[f.field].dataType
    c = F.col(f.field)
    if isinstance(dt, T.StringType) and f.operator in ("equals", "contains", "startsWith", "in"):
        plain = normalize_text(c)
        if opts.remove_diacritics:
            bound = F.struct(plain.alias("p"), normalize_text(c, remove_accents=True).alias("o"))
            pred = F.exists(F.array(bound), lambda s: _predicate(f, c, dt, opts, s["p"], s["o"]))
        else:
            pred = F.exists(F.array(plain), lambda n: _predicate(f, c, dt, opts, n, n))
    else:
        pred = _predicate(f, c, dt, opts, None, None)
        if f.operator in ("greaterThan", "lessThan", "between", "equals", "in"):
            return c.isNotNull() & pred  # no negation follows: NULL and false both drop the row
    return c.isNotNull() & F.coalesce(pred, F.lit(False))


def _predicate(f: FilterExpression, c: Column, dt: T.DataType, opts: FilterOptions, norm_plain: Column | None, norm_opt: Column | None) -> Column:
    is_str = isinstance(dt, T.StringType)
    strategy = {"normalized": "contains", "case-insensitive": "contains"}.get(f.match_strategy, f.match_strategy)
    v = f.value
    pre = norm_plain is not None

    def syn(value: str) -> Column:
        if pre:
            return synonym_match(norm_plain, value, opts.synonyms, opts.synonym_mode, normalized=True)
        return synonym_match(c, value, opts.synonyms, opts.synonym_mode)

    def norm_field() -> Column:
        return norm_opt if pre else normalize_text(c, remove_accents=opts.remove_diacritics)

    def strict_eq(value) -> Column:
        # JS ===: a string never equals a number and vice versa
        if is_str != isinstance(value, str) or isinstance(value, (list, dict)) or value is None:
            return F.lit(False)
        if isinstance(value, bool) != isinstance(dt, T.BooleanType):
            return F.lit(False)
        return c == F.lit(value)

    op = f.operator
    if op == "equals":
        if isinstance(v, str) and is_str:
            return syn(v) | (norm_field() == F.lit(normalize_text_py(v, remove_accents=opts.remove_diacritics)))
        return strict_eq(v)
    if op == "contains":
        if isinstance(v, str):
            if is_str:
                return syn(v) | _text_match(c, v, strategy, int(f.fuzzy_threshold), opts, norm_field())
            fs = _js_string(c, dt)
            return synonym_match(fs, v, opts.synonyms, opts.synonym_mode) | _text_match(fs, v, strategy, int(f.fuzzy_threshold), opts)
        return F.contains(_js_string(c, dt), F.lit(str(v)))
    if op == "startsWith":
        if isinstance(v, str):
            if is_str:
                return _text_match(c, v, "startsWith", int(f.fuzzy_threshold), opts, norm_field())
            return _text_match(_js_string(c, dt), v, "startsWith", int(f.fuzzy_threshold), opts)
        return _js_string(c, dt).startswith(str(v))
    if op in ("greaterThan", "lessThan"):
        nv = _js_number_py(v)
        if nv is None:
            return F.lit(False)
        num, x = _comparable(c, dt), _number_lit(nv, dt)
        return (num > x) if op == "greaterThan" else (num < x)
    if op == "between":
        if not isinstance(v, (list, tuple)) or len(v) != 2:
            return F.lit(False)
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            # Q13 fixed: date columns compare as dates (the contract's behaviour)
            lo, hi = F.lit(str(v[0])).cast(dt), F.lit(str(v[1])).cast(dt)
            return (c >= lo) & (c <= hi)
        lo, hi = _js_number_py(v[0]), _js_number_py(v[1])
        if lo is None or hi is None:
            return F.lit(False)
        num = _comparable(c, dt)
        return (num >= _number_lit(lo, dt)) & (num <= _number_lit(hi, dt))
    if op == "in":
        if not isinstance(v, (list, tuple)):
            return F.lit(False)
        pred = F.lit(False)
        for item in v:
            if isinstance(item, str) and is_str:
                pred = pred | syn(item) | (norm_field() == F.lit(normalize_text_py(item, remove_accents=opts.remove_diacritics)))
            else:
                pred = pred | strict_eq(item)
        return pred
    return F.lit(False)  # pragma: no cover - validated above


def connector_groups(filters: Sequence[FilterExpression]) -> list[list[int]]:
    """Split filter indexes into OR-runs separated by AND connectors."""
    groups, cur = [], []
    for i, f in enumerate(filters):
        cur.append(i)
        if (f.logical_operator or "AND") == "AND":
            groups.append(cur)
            cur = []
    if cur:
        groups.append(cur)
    return groups


def combine(preds: Sequence[Column], filters: Sequence[FilterExpression]) -> Column:
    """P10: AND of OR-runs (see module docstring)."""
    if not filters:
        return F.lit(True)
    out = None
    for g in connector_groups(filters):
        run = preds[g[0]]
        for i in g[1:]:
            run = run | preds[i]
        out = run if out is None else out & run
    return out


def filters_column(filters: Sequence, schema: T.StructType, opts: FilterOptions = FilterOptions()) -> Column:
    fs = [f if isinstance(f, FilterExpression) else FilterExpression.of(f) for f in filters]
    return combine([filter_column(f, schema, opts) for f in fs], fs)


def execute_filters(df: DataFrame, filters: Sequence, opts: FilterOptions = FilterOptions()) -> DataFrame:
    """P10: keep the rows the filter list accepts."""
    if not filters:
        return df
    return df.filter(filters_column(filters, df.schema, opts))


def apply_filter(df: DataFrame, f, opts: FilterOptions = FilterOptions()) -> DataFrame:
    """One filter."""
    fe = f if isinstance(f, FilterExpression) else FilterExpression.of(f)
    return df.filter(filter_column(fe, df.schema, opts))


def filter_audit(df: DataFrame, filters: Sequence, opts: FilterOptions = FilterOptions()) -> DataFrame:
    """P20: per filter, how many rows it matches on its own and the running
    (cumulative, connector-combined) count, plus the total — all in ONE
    aggregation pass.  One row per filter: iteration, field, operator,
    criteria, matched_count, cumulative_count, total_count."""
    fs = [f if isinstance(f, FilterExpression) else FilterExpression.of(f) for f in filters]
    preds = [filter_column(f, df.schema, opts) for f in fs]
    aggs = [F.count(F.lit(1)).alias("total")]
    for i in range(len(fs)):
        aggs.append(F.count_if(preds[i]).alias(f"m{i}"))
        aggs.append(F.count_if(combine(preds[: i + 1], fs[: i + 1])).alias(f"c{i}"))
    return audit_rows(df.agg(*aggs), fs)


def audit_rows(one: DataFrame, fs: Sequence[FilterExpression]) -> DataFrame:
    """P20: the one-row counts (``total, m0, c0, m1, ...``) as a row per filter."""
    rows = [
        F.struct(
            F.lit(i + 1).cast("long").alias("iteration"),
            F.lit(f.field).alias("field"),
            F.lit(f.operator).alias("operator"),
            F.lit(f"{f.field} {f.operator} {f.value!r}").alias("criteria"),
            F.col(f"m{i}").alias("matched_count"),
            F.col(f"c{i}").alias("cumulative_count"),
            F.col("total").alias("total_count"),
        )
        for i, f in enumerate(fs)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
