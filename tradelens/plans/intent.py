"""Structured query intents (U4) and data sufficiency.

A ``QueryIntent`` — ``{type, filters[], aggregations[], limit, orderBy,
confidence}`` — becomes one DataFrame plan: filter list (P10) ->
aggregation specs (A24/A26) or detail rows -> order -> limit.  The intent
``type`` only chooses defaults: ``trend`` orders by month ascending,
``ranking``/``aggregation``/``comparison``/``recommendation`` by value
descending, ``detail`` returns rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.operators import engine as E
from tradelens.operators.filters import FilterExpression, FilterOptions, execute_filters

INTENT_TYPES = ("aggregation", "detail", "trend", "comparison", "recommendation", "ranking")


class IntentError(ValueError):
    pass


@dataclass(frozen=True)
class QueryIntent:
    type: str
    filters: Sequence[FilterExpression] = ()
    aggregations: Sequence[E.AggregationSpec] = ()
    limit: int | None = None
    order_by: tuple[str, str] | None = None
    confidence: float = 1.0
    options: FilterOptions = field(default_factory=FilterOptions)

    def __post_init__(self):
        if self.type not in INTENT_TYPES:
            raise IntentError(f"unknown intent type {self.type!r}")
        if self.limit is not None and (not isinstance(self.limit, int) or self.limit <= 0):
            raise IntentError("limit must be a positive integer")
        if not (0 <= self.confidence <= 1):
            raise IntentError("confidence must be within 0..1")
        if self.order_by is not None and self.order_by[1] not in ("asc", "desc"):
            raise IntentError("orderBy.direction must be asc or desc")

    @staticmethod
    def of(d: Mapping) -> QueryIntent:
        ob = d.get("orderBy")
        return QueryIntent(
            type=d["type"],
            filters=[FilterExpression.of(f) for f in d.get("filters", [])],
            aggregations=[E.AggregationSpec(a["field"], a["operation"], a.get("groupBy")) for a in d.get("aggregations", []) or []],
            limit=d.get("limit"),
            order_by=(ob["field"], ob["direction"]) if ob else None,
            confidence=d.get("confidence", 1.0),
        )


def run_intent(view: DataFrame, intent: QueryIntent) -> DataFrame:
    """U4: execute an intent over an engine view (``engine.engine_view``).

    * ``detail`` (or no aggregations): the filtered rows, ordered by
      ``orderBy`` (default date desc), limited;
    * ``trend``: a monthly time series of the first aggregation, month asc;
    * otherwise: the aggregation specs (one fused plan, long form
      ``spec_id, key, value, count``), value desc, limited per spec.
    """
    rows = execute_filters(view, intent.filters, intent.options)
    if intent.type == "detail" or not intent.aggregations:
        from tradelens.schema import resolve

        col, direction = intent.order_by or ("date", "desc")
        col = resolve(col, rows.columns)
        order = [F.col(col).asc() if direction == "asc" else F.col(col).desc()]
        order += [F.col(c).asc() for c in rows.columns if c != col]
        out = rows.orderBy(*order)
        return out.limit(intent.limit) if intent.limit else out
    if intent.type == "trend":
        spec = intent.aggregations[0]
        series = E.time_series(rows, spec.field, spec.operation)
        return series.limit(intent.limit) if intent.limit else series
    result = E.compute_aggregations(rows, intent.aggregations)
    if intent.limit:
        from tradelens.operators.listing import top_k_per_group

        result = top_k_per_group(result, ["spec_id"], [F.col("value").desc(), F.col("key").asc()], intent.limit)
    return result


def data_sufficiency(df: DataFrame, required_fields: Sequence[str], min_records: int = 1) -> DataFrame:
    """One row — is_sufficient, is_complete, record_count,
    missing_fields (required columns absent or entirely NULL), issues."""
    present = [c for c in required_fields if c in df.columns]
    absent = [c for c in required_fields if c not in df.columns]
    aggs = [F.count(F.lit(1)).alias("record_count")] + [F.count(F.col(c)).alias(f"_nn_{i}") for i, c in enumerate(present)]
    one = df.agg(*aggs)
    empty_cols = [F.when(F.col(f"_nn_{i}") == 0, F.lit(c)) for i, c in enumerate(present)]
    missing = F.concat(F.array(*[F.lit(c) for c in absent]) if absent else F.array().cast("array<string>"),
                       F.filter(F.array(*empty_cols), lambda x: x.isNotNull()) if empty_cols else F.array().cast("array<string>"))
    issues = F.filter(
        F.array(
            F.when(F.col("record_count") < min_records, F.format_string("only %d records (need %d)", F.col("record_count"), F.lit(min_records))),
            F.when(F.size("missing_fields") > 0, F.concat(F.lit("missing fields: "), F.array_join("missing_fields", ", "))),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        one.select("record_count", missing.alias("missing_fields"))
        .withColumn("issues", issues)
        .select(
            (F.col("record_count") >= min_records).alias("is_sufficient"),
            (F.size("missing_fields") == 0).alias("is_complete"),
            "record_count",
            "missing_fields",
            "issues",
        )
    )
