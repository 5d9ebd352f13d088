"""Filter lists evaluated at the grain of the dictionary (P10-P20 on a store).

Text predicates (normalising, synonyms, edit distance) depend on a name, and
names are few next to lines: each text filter is evaluated once per row of
the dimension that holds its field, and the ids that pass meet the lines by a
join (Spark broadcasts them when they are small).  A filter that stands alone
between AND connectors is a semi-join, before anything else is joined;
filters inside an OR-run mark the lines with a flag the run then combines.
A text field of the line itself (office, country, unit) is a code list: its
distinct values are matched first, in a job over that one column, and those
that pass become an ``IN`` list that reaches the scan; a field with more than
``LIST_VALUES`` passing values is matched line by line instead.  Comparisons
stay bare predicates on the lines.  The rows kept are those of
``execute_filters`` over the whole ``engine_view``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.operators.engine import VIEW_FIELDS, _VIEW_COMPANY, _VIEW_FACT, engine_view
from tradelens.operators.filters import FilterExpression, FilterOptions, combine, connector_groups, filter_column, validate_filter
from tradelens.schema import resolve
from tradelens.sources.store import FrameStore, Store

TEXT_OPERATORS = ("equals", "contains", "startsWith", "in")
LIST_VALUES = 1000


def _expressions(filters: Sequence) -> list[FilterExpression]:
    from dataclasses import replace

    found = [f if isinstance(f, FilterExpression) else FilterExpression.of(f) for f in filters]
    out = []
    for f in found:
        name = resolve(f.field, VIEW_FIELDS) if f.field else f.field
        validate_filter(replace(f, field=name), VIEW_FIELDS)
        out.append(replace(f, field=name))
    return out


def _hits(store: Store, facts: DataFrame, f: FilterExpression, opts: FilterOptions) -> tuple[DataFrame, str] | None:
    """The ids for which a filter on a dimension's text holds, and their fact
    column; None for a predicate on the line itself."""

    def kept(names: DataFrame, key: str) -> tuple[DataFrame, str]:
        return names.filter(filter_column(f, names.schema, opts)).select(key), key

    if f.field in _VIEW_COMPANY:
        return kept(store.companies().select("company_id", F.col(_VIEW_COMPANY[f.field]).alias(f.field)), "company_id")
    if f.field == "goods_name":
        return kept(store.goods().select("goods_id", F.col("raw_name").alias(f.field)), "goods_id")
    if f.field == "category_name":
        categories, _ = kept(store.categories().select("category_id", F.col("name").alias(f.field)), "category_id")
        return store.goods().join(categories, "category_id", "left_semi").select("goods_id"), "goods_id"
    return None


def _line_condition(facts: DataFrame, f: FilterExpression, opts: FilterOptions) -> Column:
    """A filter on a field of the line, never NULL for text."""
    predicate = filter_column(f, facts.schema, opts)
    if f.operator not in TEXT_OPERATORS or not isinstance(facts.schema[f.field].dataType, T.StringType):
        return predicate
    passing = facts.select(f.field).distinct().filter(predicate).limit(LIST_VALUES + 1).collect()
    return predicate if len(passing) > LIST_VALUES else F.col(f.field).isNotNull() & F.col(f.field).isin([r[0] for r in passing])


def _marked(store: Store, facts: DataFrame, lines: DataFrame, fs: list[FilterExpression], opts: FilterOptions) -> tuple[DataFrame, list[Column]]:
    """Lines with a flag per filter on a dimension, and each filter as a condition on them."""
    conditions = []
    for i, f in enumerate(fs):
        found = _hits(store, facts, f, opts)
        if found is None:
            conditions.append(F.coalesce(_line_condition(facts, f, opts), F.lit(False)))
            continue
        hits, key = found
        marks = hits.select(F.col(key).alias(f"_k{i}"), F.lit(True).alias(f"_m{i}"))
        lines = lines.join(marks, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        conditions.append(F.col(f"_m{i}").isNotNull())
    return lines, conditions


def _facts(store: Store) -> DataFrame:
    return store.facts([*_VIEW_FACT, "company_id", "goods_id"])


def filter_lines(store: Store, filters: Sequence, opts: FilterOptions = FilterOptions()) -> DataFrame:
    """P10: the fact lines (engine fields and dimension ids) a filter list accepts."""
    fs = _expressions(filters)
    facts = lines = _facts(store)
    runs: list[list[int]] = []
    for run in connector_groups(fs):
        found = _hits(store, facts, fs[run[0]], opts) if len(run) == 1 else None
        if found is None:
            runs.append(run)
        else:
            lines = lines.join(found[0], found[1], "left_semi")
    bare = [r for r in runs if len(r) == 1]
    for run in bare:  # plain predicates go to the scan, below the joins
        lines = lines.filter(_line_condition(facts, fs[run[0]], opts))
    for run in (r for r in runs if len(r) > 1):
        marked, conditions = _marked(store, facts, lines, [fs[i] for i in run], opts)
        lines = marked.filter(reduce(or_, conditions)).select(*facts.columns)
    return lines


def filter_store(store: Store, filters: Sequence, opts: FilterOptions = FilterOptions(), fields: Sequence[str] | None = None) -> DataFrame:
    """P10 over a store: the engine rows a filter list accepts.  Dimensions
    are joined to the lines that are left."""
    lines = filter_lines(store, filters, opts)
    return engine_view(FrameStore(store.spark, lines, store.companies(), store.goods(), store.categories()), fields)


def filter_samples(store: Store, filters: Sequence, order: Sequence[Column], columns: Sequence[str], k: int = 5, opts: FilterOptions = FilterOptions()) -> DataFrame:
    """P20 resultSample: of every filter the first ``k`` lines it matches on
    its own, by ``order`` - ``iteration, rank`` and the given columns.

    One pass: a line is offered to the filters it matches, each task keeps
    ``k`` of them per filter and so does the end (``WindowGroupLimit``)."""
    fs, facts = _expressions(filters), _facts(store)
    lines, conditions = _marked(store, facts, facts, fs, opts)
    offered = F.filter(F.array(*[F.when(c, F.lit(i + 1).cast("long")) for i, c in enumerate(conditions)]), lambda x: x.isNotNull())
    rows = lines.select(F.explode(offered).alias("iteration"), *columns)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("iteration").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("long")).select("iteration", "rank", *columns)


def running_counts(store: Store, filters: Sequence, opts: FilterOptions = FilterOptions()) -> DataFrame:
    """P20 counts as ``filter_audit`` gives them (one row: ``total, m0, c0,
    m1, ...``), with text predicates evaluated per dictionary value."""
    fs, facts = _expressions(filters), _facts(store)
    lines, conditions = _marked(store, facts, facts, fs, opts)
    counts = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(conditions):
        counts += [F.count_if(c).alias(f"m{i}"), F.count_if(combine(conditions[: i + 1], fs[: i + 1])).alias(f"c{i}")]
    return lines.agg(*counts)
