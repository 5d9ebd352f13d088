"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables through ``TestbedStore`` (or data
Spark derives from them) and runs over whole tables.  Queries of the import
jobs read stand-in inputs selected from them (``import_batch``,
``stored_lines``).  The DuckDB twins live in ``plans.oracles``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions.numbers import iso_timestamp
from tradelens.operators import rollups as R
from tradelens.operators.listing import order_columns
from tradelens.session import scratch_path, stage_table
from tradelens.sources.testbed import TestbedStore

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
# the same queries as functions of a Store (bench runs them on a Parquet star)
STORE_QUERIES: dict[str, Callable] = {}


def register(name: str):
    def deco(fn: Callable[[TestbedStore], DataFrame]) -> Callable[[TestbedStore], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(TestbedStore(spark, sf_dir))
        STORE_QUERIES[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------- companies


@register("company_rollup")
def _company_rollup(s):
    return R.company_rollup(s)


@register("company_rollup_page")
def _company_rollup_page(s):
    return R.company_list_page(s, page=2, page_size=50, sort_by="totalQuantity", sort_order="asc")


@register("company_rollup_by_category")
def _company_rollup_by_category(s):
    return R.company_rollup(s, date_from="1996-01-01", date_to="1998-12-31", category="PROMO")


@register("company_search")
def _company_search(s):
    return R.company_rollup(s, search="customer#0+1[0-9]")


@register("company_latest_lines")
def _company_latest_lines(s):
    return R.company_latest_lines(s, n=1000)


@register("company_top_goods")
def _company_top_goods(s):
    return R.company_top_goods(s, k=10)


@register("company_category_share")
def _company_category_share(s):
    return R.company_category_share(s)


@register("company_monthly_trend")
def _company_monthly_trend(s):
    return R.company_monthly_trend(s)


@register("company_top_category")
def _company_top_category(s):
    return R.company_top_category(s)


@register("company_export_countries")
def _company_export_countries(s):
    return R.company_export_countries(s)


# ---------------------------------------------------------------- goods


@register("goods_rollup")
def _goods_rollup(s):
    return R.goods_rollup(s)


@register("goods_rollup_filtered")
def _goods_rollup_filtered(s):
    return R.goods_rollup(s, company="customer#0000001[0-4]", date_from="1997-01-01", date_to="2000-06-30", category="STANDARD", search="ring|bolt")


@register("goods_rollup_page")
def _goods_rollup_page(s):
    return R.goods_list_page(s, page=3, page_size=20, sort_by="averagePrice", sort_order="asc", date_from="1998-01-01")


@register("goods_mean_price")
def _goods_mean_price(s):
    return R.goods_mean_price(s, date_from="1996-01-01")


@register("goods_top_companies")
def _goods_top_companies(s):
    return R.goods_top_companies(s, k=5)


@register("goods_monthly_trend")
def _goods_monthly_trend(s):
    return R.goods_monthly_trend(s)


# ---------------------------------------------------------------- categories, dashboard, list


@register("category_rollup")
def _category_rollup(s):
    return R.category_rollup(s)


@register("category_names")
def _category_names(s):
    return R.category_names(s)


@register("dashboard_stats")
def _dashboard_stats(s):
    return R.dashboard_stats(s)


_TX_FILTERS = dict(company="customer#0000002[0-9]{2}", date_from="1996-03-01", date_to="1999-10-31", category="MEDIUM", min_value=1000)


@register("transactions_page")
def _transactions_page(s):
    return R.transactions_page(s, page=1, page_size=50, sort_by="totalValueUSD", ascending=False, **_TX_FILTERS)


def _busiest(s, key: str):
    """The id with most lines (ties: the smallest)."""
    found = s.facts([key]).groupBy(key).count().orderBy(F.desc("count"), key).first()
    return found[0] if found else None


@register("company_detail_stats")
def _company_detail_stats(s):
    """Detail header of the company with most lines."""
    return R.company_detail_stats(s, _busiest(s, "company_id"))


@register("goods_detail_stats")
def _goods_detail_stats(s):
    """Detail header of the goods item with most lines."""
    return R.goods_detail_stats(s, _busiest(s, "goods_id"))


@register("transactions_deep_page")
def _transactions_deep_page(s):
    """Page 400 of the whole list, read from an index of page starts."""
    index = R.transactions_index(s, page_size=50, sort_by="totalValueUSD", ascending=False, every=4)
    return R.transactions_indexed_page(s, index, 400)


@register("transactions_next_page")
def _transactions_next_page(s):
    """The page after the list's thousandth row, by that row's sort values."""
    keys = ["total_value_usd", *R.TX_TIE_BREAK]
    last = R.transactions_view(s).select(*dict.fromkeys(keys)).orderBy(*order_columns([("total_value_usd", False)], R.TX_TIE_BREAK)).offset(999).limit(1).first()
    return R.transactions_after(s, None if last is None else last.asDict(), page_size=50, sort_by="totalValueUSD", ascending=False)


@register("company_top_export_countries")
def _company_top_export_countries(s):
    """The list as text: country:lines, in order."""
    found = R.company_top_export_countries(s)
    return found.select("company_id", F.array_join(F.transform("top_export_countries", lambda e: F.concat_ws(":", e["country"], e["transaction_count"].cast("string"))), ";").alias("top_export_countries"))


@register("transactions_count")
def _transactions_count(s):
    return R.transactions_count(s, page_size=50, **_TX_FILTERS)


@register("transactions_summary")
def _transactions_summary(s):
    return R.transactions_summary(s, **_TX_FILTERS)


# ---------------------------------------------------------------- output helpers


def _display(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text and decimals as doubles (the API edge, A6/D3)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from tradelens.functions.numbers import iso_timestamp

    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(iso_timestamp(f.name).alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- aggregation tools

from tradelens.operators import aggregate as A  # noqa: E402

TOOL_AGGREGATE_PARAMS = {
    "aggregations": [
        {"field": "totalValueUSD", "operation": "sum", "alias": "sum_total_value_usd"},
        {"field": "quantity", "operation": "avg", "alias": "avg_quantity"},
        {"field": "quantity", "operation": "count", "alias": "lines"},
        {"field": "quantity", "operation": "min", "alias": "min_quantity"},
        {"field": "totalValueUSD", "operation": "max", "alias": "max_total_value_usd"},
    ],
    "groupBy": ["importCountry", "paymentMethod"],
    "match": {"year": {"$gte": 1997}, "deliveryTerms": {"$in": ["A", "N"]}},
    "sort": {"sum_total_value_usd": -1},
    "skip": 5,
    "limit": 20,
}


@register("tool_aggregate")
def _tool_aggregate(s):
    return A.run_tool(s, "aggregateTransactions", TOOL_AGGREGATE_PARAMS)


# the two examples of the tool's documentation, over the test data's values
@register("tool_example_top_importers")
def _tool_example_top_importers(s):
    return A.run_tool(
        s,
        "aggregateTransactions",
        {"aggregations": [{"field": "totalValueUSD", "operation": "sum"}], "groupBy": ["importCompanyRawName"], "sort": {"sum_totalValueUSD": -1}, "limit": 10},
    )


@register("tool_example_average")
def _tool_example_average(s):
    return A.run_tool(
        s,
        "aggregateTransactions",
        {
            "aggregations": [{"field": "totalValueUSD", "operation": "avg", "alias": "avgPrice"}, {"field": "quantity", "operation": "sum", "alias": "totalQty"}],
            "groupBy": ["goodsRawName", "unit"],
            "match": {"year": 1997, "importCountry": "NATION_3"},
            "sort": {"avgPrice": -1},
        },
    )


@register("tool_sum_field")
def _tool_sum_field(s):
    return A.run_tool(s, "sumField", {"field": "total_value_usd", "match": {"customsOffice": "ASIA"}})


@register("tool_avg_field")
def _tool_avg_field(s):
    return A.run_tool(s, "avgField", {"field": "quantity", "match": {"year": 1998}})


@register("tool_count")
def _tool_count(s):
    return A.run_tool(s, "countTransactions", {"match": {"transportMode": "O"}})


@register("tool_top_by_field")
def _tool_top_by_field(s):
    return A.run_tool(s, "getTopByField", {"field": "totalValueUSD", "groupBy": ["importCompanyRawName"], "limit": 10})


@register("tool_count_and_group")
def _tool_count_and_group(s):
    return A.run_tool(s, "countAndGroup", {"groupBy": ["customsOffice", "paymentMethod"]})


@register("tool_distinct_values")
def _tool_distinct_values(s):
    return A.run_tool(s, "getDistinctValues", {"field": "hsCode", "limit": 10})


MATCH_DOC = {
    "$or": [{"customsOffice": "ASIA"}, {"exportType": {"$regex": "^auto", "$options": "i"}}],
    "quantity": {"$gte": 10, "$lt": 20},
    "paymentMethod": {"$nin": ["1-URGENT", None]},
    "taxRate": {"$not": {"$gt": 0.05}},
}


@register("match_document")
def _match_document(s):
    df = s.facts(["declaration_number", "line_no", "goods_id", "customs_office", "export_type", "quantity", "payment_method", "tax_rate"])
    return _display(df.filter(A.match_to_column(MATCH_DOC, df.schema)))


# ---------------------------------------------------------------- filter engine (P10-P20)

from tradelens.operators import engine as E  # noqa: E402
from tradelens.operators import dictionary_filters as DF  # noqa: E402
from tradelens.operators import filters as FL  # noqa: E402
from tradelens.operators import rollup_states as RS  # noqa: E402


def _filtered(s, filters, opts=FL.FilterOptions()):
    return _display(DF.filter_store(s, filters, opts))


@register("filter_equals")
def _filter_equals(s):
    return _filtered(s, [{"field": "customs_office", "operator": "equals", "value": "USA"}])


@register("filter_contains")
def _filter_contains(s):
    return _filtered(s, [{"field": "goods_name", "operator": "contains", "value": "RING"}])


@register("filter_starts_with")
def _filter_starts_with(s):
    return _filtered(s, [{"field": "goods_name", "operator": "startsWith", "value": " Red"}])


@register("filter_greater_less")
def _filter_greater_less(s):
    return _filtered(
        s,
        [
            {"field": "total_value_usd", "operator": "greaterThan", "value": 50000},
            {"field": "quantity", "operator": "lessThan", "value": "10"},
        ],
    )


@register("filter_between")
def _filter_between(s):
    return _filtered(
        s,
        [
            {"field": "unit_price_usd", "operator": "between", "value": [1000, 1500]},
            {"field": "date", "operator": "between", "value": ["1997-01-01", "1997-12-31"]},
        ],
    )


@register("filter_in")
def _filter_in(s):
    return _filtered(s, [{"field": "customs_office", "operator": "in", "value": ["Europe", "US"]}])


@register("filter_fuzzy")
def _filter_fuzzy(s):
    return _filtered(s, [{"field": "goods_name", "operator": "contains", "value": "smal rng", "matchStrategy": "fuzzy", "fuzzyThreshold": 2}])


@register("filter_single")
def _filter_single(s):
    """One filter, line by line."""
    return _display(FL.apply_filter(E.engine_view(s, goods_first=True), {"field": "goods_name", "operator": "contains", "value": "RING"}))


CNF_FILTERS = [
    {"field": "customs_office", "operator": "equals", "value": "US", "logicalOperator": "OR"},
    {"field": "customs_office", "operator": "equals", "value": "Asia", "logicalOperator": "AND"},
    {"field": "total_value_usd", "operator": "greaterThan", "value": 50000},
]


@register("filter_cnf")
def _filter_cnf(s):
    return _filtered(s, CNF_FILTERS)


@register("filter_audit")
def _filter_audit(s):
    return FL.audit_rows(DF.running_counts(s, CNF_FILTERS), [FL.FilterExpression.of(f) for f in CNF_FILTERS])


SAMPLE_ORDER = ("date", "declaration_number", "goods_id", "quantity")


@register("filter_audit_sample")
def _filter_audit_sample(s):
    """The first five lines each filter matches."""
    found = DF.filter_samples(s, CNF_FILTERS, [F.col(c) for c in SAMPLE_ORDER], ["date", "declaration_number", "goods_id", "quantity", "customs_office", "total_value_usd"])
    return _display(found)


# ---------------------------------------------------------------- engine aggregates


@register("agg_js_grouped")
def _agg_js_grouped(s):
    return E.group_by(E.engine_view(s, ["import_country", "total_value_usd"]), "import_country", "total_value_usd", "sum")


@register("agg_total")
def _agg_total(s):
    return E.compute_total(E.engine_view(s, ["quantity"]), "quantity", "average")


MULTI_SPECS = [
    E.AggregationSpec("total_value_usd", "sum", "category_name"),
    E.AggregationSpec("total_value_usd", "count", "category_name"),
    E.AggregationSpec("unit_price_usd", "max", "category_name"),
    E.AggregationSpec("quantity", "average", "import_country"),
    E.AggregationSpec("quantity", "min", None),
]


@register("agg_multi_spec")
def _agg_multi_spec(s):
    return E.compute_aggregations(E.engine_view(s, [f for x in MULTI_SPECS for f in (x.field, x.group_by) if f]), MULTI_SPECS)


@register("agg_cache")
def _agg_cache(s):
    return E.build_cache(E.engine_view(s), extras=True)


@register("agg_cache_top_n")
def _agg_cache_top_n(s):
    return E.cache_top_n(E.build_cache(E.engine_view(s, ["import_company_name", "total_value_usd"]), only=["importCompany"]), "importCompany", 10)


def _stored_states(s):
    """States of all lines as three imports would leave them (by year of the
    declaration), written and read back unmerged."""
    facts = s.facts([*RS.STATE_FACTS, "year"])
    spans = [F.col("year") <= 1993, F.col("year").between(1994, 1996), F.col("year") >= 1997]
    parts = [RS.fact_states(facts.filter(span).drop("year")) for span in spans]
    return stage_table(parts[0].unionByName(parts[1]).unionByName(parts[2]), "rollup-states")


@register("agg_cache_stored")
def _agg_cache_stored(s):
    """The roll-up cache from stored, merged states."""
    return RS.cache_from_states(s, _stored_states(s), ["importCompany", "category", "country", "month", "goods", "total"])


@register("agg_cache_stored_top_n")
def _agg_cache_stored_top_n(s):
    return E.cache_top_n(RS.cache_from_states(s, _stored_states(s), ["importCompany"]), "importCompany", 10)


@register("time_series_month")
def _time_series_month(s):
    return E.time_series(E.engine_view(s, ["date", "total_value_usd"]), "total_value_usd", "sum")


@register("full_data_points")
def _full_data_points(s):
    return E.full_data_points(E.engine_view(s, ["category_name", "total_value_usd"]), "category_name", "total_value_usd")


@register("summary_lines")
def _summary_lines(s):
    view = E.engine_view(s)
    spec = E.AggregationSpec("total_value_usd", "sum", "import_country")
    result = E.group_by(view, spec.group_by, spec.field, spec.operation)
    return E.summary_text(result, spec, top=20)


# ---------------------------------------------------------------- import de-duplication


from tradelens.operators import dedup as D  # noqa: E402
from tradelens.schema import CSV_COLUMNS, DEDUP_KEY  # noqa: E402

BATCH_COLUMNS = (*DEDUP_KEY, "line_no", "goods_id", "supplier_id", "quantity", "date")
BATCH_ORDER = ("file_no", "declaration_number", "line_no", "goods_id", "supplier_id", "quantity")


def _nibble(c: str, at: int) -> F.Column:
    """One hexadecimal digit of a value's MD5: a fixed sixteenth per digit."""
    return F.substring(F.md5(F.col(c)), at, 1)


def _staged_lines(s) -> DataFrame:
    """The lines of both stand-ins as a table: for queries that read them more than once."""
    return stage_table(s.import_facts(BATCH_COLUMNS), "import-lines")


def import_batch(s, lines: DataFrame | None = None) -> DataFrame:
    """Stand-in import file: every fact line, followed by the lines of 6/16 of
    the declarations once more (an export delivered again), with ``file_no``
    giving file order.  Only selection and renaming here: the lines (or the
    staged ``lines``) are joined once, then doubled."""
    files = F.when(_nibble("declaration_number", 2) < "6", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    lines = s.import_facts(BATCH_COLUMNS) if lines is None else lines
    return lines.withColumn("file_no", F.explode(files))


def stored_lines(s, lines: DataFrame | None = None) -> DataFrame:
    """Stand-in target table: the lines already imported - half of the
    declarations, without 3/16 of the goods and 1/16 of the companies, which
    are new to the store."""
    f = s.import_facts(BATCH_COLUMNS) if lines is None else lines
    return f.filter((_nibble("declaration_number", 1) < "8") & (_nibble("goods_raw_name", 1) >= "3") & (_nibble("import_company_raw_name", 1) >= "1"))


@register("dedup_in_file")
def _dedup_in_file(s):
    return _display(D.dedup_in_file(import_batch(s), BATCH_ORDER))


@register("dedup_report")
def _dedup_report(s):
    return _display(D.duplicate_report(import_batch(s, _staged_lines(s)), BATCH_ORDER))


def _new_rows(s, lines):
    unique = D.dedup_in_file(import_batch(s, lines), BATCH_ORDER, keep_key=True).drop("occurrences")
    return D.split_against_table(unique, stored_lines(s, lines))


@register("dedup_against_table")
def _dedup_against_table(s):
    lines = _staged_lines(s)
    unique = D.dedup_in_file(import_batch(s, lines), BATCH_ORDER, keep_key=True).drop("occurrences")
    return _display(D.mark_against_table(unique, stored_lines(s, lines)))


@register("existing_declarations")
def _existing_declarations(s):
    return D.existing_declarations(stored_lines(s), import_batch(s))


@register("dedup_summary")
def _dedup_summary(s):
    return D.dedup_summary(import_batch(s), BATCH_ORDER)


def _stored_companies(s, lines):
    return stored_lines(s, lines).select(F.col("import_company_raw_name").alias("name"), F.lit("").alias("address")).distinct()


def _stored_goods(s, lines):
    return stored_lines(s, lines).select(F.col("goods_raw_name").alias("raw_name")).distinct()


@register("dim_company_new")
def _dim_company_new(s):
    lines = _staged_lines(s)
    new, _ = _new_rows(s, lines)
    return D.new_companies(new, _stored_companies(s, lines))


@register("dim_goods_new")
def _dim_goods_new(s):
    lines = _staged_lines(s)
    new, _ = _new_rows(s, lines)
    return D.new_goods(new, _stored_goods(s, lines), BATCH_ORDER)


@register("import_summary")
def _import_summary(s):
    lines = _staged_lines(s)
    return D.import_report(import_batch(s, lines), BATCH_ORDER, stored_lines(s, lines), _stored_companies(s, lines), _stored_goods(s, lines))


# ---------------------------------------------------------------- the CSV import in one plan

from tradelens.operators import ingest as IG  # noqa: E402
from tradelens.sources.store import FrameStore, ParquetStore  # noqa: E402
from tradelens.sources.customs_csv import raw_row_json, read_customs_csv, write_csv  # noqa: E402
from tradelens.sources.testbed import customs_rows, export_customs_csv  # noqa: E402


def _csv_rows(s) -> DataFrame:
    """The stand-in rows as a table of text cells, as a read CSV file is."""
    return stage_table(customs_rows(s), "customs-rows")


@register("import_parsed_cells")
def _import_parsed_cells(s):
    """Every line as customs cells, parsed to typed facts."""
    f = IG.to_facts(_csv_rows(s))
    money = [F.col(c).cast("double").alias(c) for c in ("quantity", "total_value_usd", "usd_rate", "tax_rate")]
    return f.select("declaration_number", "line_no", iso_timestamp("date").alias("date"), "year", "month", "day", "delivery_terms", "hs_code", *money)


@register("import_issue_counts")
def _import_issue_counts(s):
    """Validation of all lines with a spoiled cell in some declarations."""
    rows, _ = IG.stage_rows(customs_rows(s, faults=True))  # checked once, as they are staged
    issues = IG.row_issues(rows)
    return issues.groupBy("field", "message", "severity").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("row").alias("lines"))


@register("import_quarantine_summary")
def _import_quarantine_summary(s):
    """Import of the same lines with the faulty ones set aside."""
    r = IG.plan_import(s.spark, customs_rows(s, faults=True), None, None, None, None, mode="quarantine")
    return r.summary


@register("csv_round_trip")
def _csv_round_trip(s):
    """Every line written as a customs CSV, read back by header and parsed,
    with two cells of the original row kept beside it."""
    path = scratch_path(s.spark, f"csv-{uuid.uuid4().hex}")
    export_customs_csv(s, path, compression="gzip")
    f = IG.to_facts(read_customs_csv(s.spark, path))
    money = [F.col(c).cast("double").alias(c) for c in ("quantity", "total_value_usd", "usd_rate", "tax_rate")]
    raw = [F.size("raw_data").cast("long").alias("raw_cells"), F.col("raw_data")["Số tờ khai"].alias("raw_number"), F.get_json_object(raw_row_json("raw_data"), "$['Đơn vị tính']").alias("raw_unit")]
    return f.select("declaration_number", iso_timestamp("date").alias("date"), "year", "month", "day", "delivery_terms", "hs_code", *money, *raw)


@register("csv_dry_run")
def _csv_dry_run(s):
    """Validation without import of the same CSV with faulty cells."""
    path = scratch_path(s.spark, f"csv-{uuid.uuid4().hex}")
    write_csv(customs_rows(s, faults=True).select(*CSV_COLUMNS), path, compression="gzip")
    return IG.dry_run(s.spark, path)


@register("dim_category_new")
def _dim_category_new(s):
    """Categories of the stored goods that a dimension holding the others lacks."""
    named = s.goods_with_category().select("category").filter("category is not null")
    kept = s.categories().filter(F.substring(F.md5("name"), 1, 1) < "8")
    return D.new_categories(named, kept)


@register("import_errors")
def _import_errors(s):
    """Every issue of the lines set aside, with the declaration it is about."""
    return IG.import_errors(IG.plan_import(s.spark, customs_rows(s, faults=True), None, None, None, None, mode="quarantine"))


@register("import_transactions_page")
def _import_transactions_page(s):
    """All lines imported into an empty store, and its transaction list."""
    r = IG.plan_import(s.spark, customs_rows(s), None, None, None, None, mode="quarantine")
    store = FrameStore(s.spark, r.new_facts, r.new_companies, r.new_goods, r.new_categories)
    page = R.transactions_page(store, page=1, page_size=100, sort_by="totalValueUSD", ascending=False)
    return page.drop("company_id", "goods_id", "unit_price_usd")


@register("import_overlapping")
def _import_overlapping(s):
    """All lines in two files that share six sixteenths of the declarations.
    Both imports look at the empty store before either writes; the facts of
    the committed store are joined to its dimensions."""
    rows, _ = IG.stage_rows(customs_rows(s))  # every line checked once; both files are parts of it
    digit = F.substring(F.md5(F.col("`Số tờ khai`")), 3, 1)
    root = scratch_path(s.spark, f"overlapping-{uuid.uuid4().hex}")
    halves = [rows.filter(half) for half in (digit < "b", digit > "4")]
    plans = [IG.plan_import(s.spark, half, None, None, None, None, mode="quarantine", row_counts=IG.row_counts(half)) for half in halves]
    for name, plan in zip("ab", plans):
        IG.append_import(plan, root, name, seen=0)
    store = ParquetStore(s.spark, root)
    lines = store.facts(["company_id", "goods_id", "declaration_number"])
    joined = lines.join(store.companies(), "company_id").join(store.goods(), "goods_id")
    return joined.groupBy(F.col("name").alias("company")).agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("raw_name").alias("goods"), F.countDistinct("declaration_number").alias("declarations")
    )


# ---------------------------------------------------------------- profile, growth, comparisons

from tradelens.operators import analytics as AN  # noqa: E402
from tradelens.plans import intent as IN  # noqa: E402


@register("load_profile")
def _load_profile(s):
    ws = AN.working_set(s, categories=["PROMO", "LARGE"], date_from="1998-01-01", date_to="1998-12-31")
    return AN.load_profile(ws)


@register("recent_six_months")
def _recent_six_months(s):
    return AN.recent_months(s, 6)


@register("category_growth")
def _category_growth(s):
    return AN.category_growth(s)


@register("compare_companies")
def _compare_companies(s):
    return AN.compare_top_companies(s)


@register("recommend_companies")
def _recommend_companies(s):
    return AN.recommend_companies(s, 5)


# ---------------------------------------------------------------- intents (U4) and the eight questions


def _intent(s, spec):
    return _display(IN.run_intent(E.engine_view(s), IN.QueryIntent.of(spec)))


INTENTS = {
    "intent_aggregation": {
        "type": "aggregation",
        "filters": [{"field": "customs_office", "operator": "in", "value": ["Asia", "Europe"]}],
        "aggregations": [
            {"field": "total_value_usd", "operation": "sum", "groupBy": "category_name"},
            {"field": "quantity", "operation": "average", "groupBy": "category_name"},
        ],
        "confidence": 0.9,
    },
    "intent_detail": {
        "type": "detail",
        "filters": [
            {"field": "goods_name", "operator": "contains", "value": "gear"},
            {"field": "total_value_usd", "operator": "greaterThan", "value": 90000},
        ],
        "orderBy": {"field": "total_value_usd", "direction": "desc"},
        "limit": 50,
        "confidence": 0.8,
    },
    "intent_trend": {
        "type": "trend",
        "filters": [{"field": "category_name", "operator": "equals", "value": "economy"}],
        "aggregations": [{"field": "total_value_usd", "operation": "sum"}],
        "confidence": 0.7,
    },
    "question_importers_by_value": {
        "type": "ranking",
        "filters": [],
        "aggregations": [{"field": "total_value_usd", "operation": "sum", "groupBy": "import_company_name"}],
        "limit": 10,
        "confidence": 1,
    },
    "question_importers_by_count": {
        "type": "ranking",
        "filters": [],
        "aggregations": [{"field": "declaration_number", "operation": "count", "groupBy": "import_company_name"}],
        "limit": 10,
        "confidence": 1,
    },
    "question_items_by_quantity": {
        "type": "ranking",
        "filters": [],
        "aggregations": [{"field": "quantity", "operation": "sum", "groupBy": "goods_name"}],
        "limit": 10,
        "confidence": 1,
    },
    "question_items_by_value": {
        "type": "ranking",
        "filters": [],
        "aggregations": [{"field": "total_value_usd", "operation": "sum", "groupBy": "goods_name"}],
        "limit": 10,
        "confidence": 1,
    },
    "question_items_by_transactions": {
        "type": "ranking",
        "filters": [],
        "aggregations": [{"field": "declaration_number", "operation": "count", "groupBy": "goods_name"}],
        "limit": 10,
        "confidence": 1,
    },
    "question_total_value": {
        "type": "aggregation",
        "filters": [],
        "aggregations": [{"field": "total_value_usd", "operation": "sum"}],
        "confidence": 1,
    },
    "question_monthly_trend": {
        "type": "trend",
        "filters": [],
        "aggregations": [{"field": "total_value_usd", "operation": "sum"}],
        "confidence": 1,
    },
    "question_importers_for_country": {
        "type": "ranking",
        "filters": [{"field": "import_country", "operator": "equals", "value": "nation_7"}],
        "aggregations": [{"field": "total_value_usd", "operation": "sum", "groupBy": "import_company_name"}],
        "limit": 10,
        "confidence": 1,
    },
}

for _name, _spec in INTENTS.items():
    register(_name)((lambda spec: (lambda s: _intent(s, spec)))(_spec))


SUFFICIENCY_FIELDS = ["declaration_number", "import_company_name", "total_value_usd", "category_name"]


@register("data_sufficiency")
def _data_sufficiency(s):
    return IN.data_sufficiency(E.engine_view(s, SUFFICIENCY_FIELDS), SUFFICIENCY_FIELDS, 100)


# ---------------------------------------------------------------- sessions

from tradelens.streaming.sessions import merge_sessions, sessionize  # noqa: E402


@register("user_sessions_30m")
def _user_sessions(s):
    ev = s.table("events").select("user_id", "ts", "value")
    out = sessionize(ev, "user_id", "ts", "30 minutes", "value")
    return out.select("user_id", *[F.col(c) for c in ("session_start", "session_end")], "events", F.round("total_value", 6).alias("total_value")).transform(_display)


@register("user_sessions_out_of_order")
def _user_sessions_out_of_order(s):
    """The same sessions from four parts of the events that arrive in an
    arbitrary order (dealt by a hash of the time), each sessionised on its own, then merged."""
    ev = s.table("events").select("user_id", "ts", "value")
    part = F.pmod(F.xxhash64("ts"), F.lit(4))
    parts = [sessionize(ev.filter(part == i), "user_id", "ts", "30 minutes", "value") for i in range(4)]
    fragments = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    out = merge_sessions(fragments, "user_id", "30 minutes")
    return out.select("user_id", "session_start", "session_end", "events", F.round("total_value", 6).alias("total_value")).transform(_display)


# ---------------------------------------------------------------- text and date functions

from tradelens.functions import numbers as N  # noqa: E402
from tradelens.functions import text as X  # noqa: E402


@register("date_formats")
def _date_formats(s):
    """D5 over every line's date."""
    f = s.facts(["declaration_number", "line_no", "date"])
    as_of = F.lit("2001-06-15 12:00:00").cast("timestamp_ntz")
    return f.select(
        "declaration_number", "line_no", N.format_date_vi("date").alias("day"), N.format_datetime_vi("date").alias("moment"), N.format_month_year("date").alias("month_year"),
        N.format_date_range("date", as_of).alias("span"), N.relative_time("date", as_of).alias("ago"),
    )


@register("number_formats")
def _number_formats(s):
    """N6 over every line's value and tax rate."""
    f = s.facts(["declaration_number", "line_no", "total_value_usd", "tax_rate"])
    return f.select(
        "declaration_number", "line_no", N.compact_number("total_value_usd").alias("compact"), N.format_percentage("tax_rate").alias("rate"), N.format_usd("total_value_usd").alias("usd"),
        N.format_vi_number("total_value_usd", 2).alias("vi_number"), N.format_vnd("total_value_usd").alias("vnd"),
    )


@register("normalize_text")
def _normalize_text(s):
    docs = s.table("documents")
    norm = X.normalize_text(F.col("text"))
    return docs.select("doc_id", F.length(norm).alias("normalized_length"), F.md5(norm).alias("normalized_md5"))


@register("searchable_text")
def _searchable_text(s):
    conv = s.table("conversations")
    st = X.searchable_text(F.col("text"))
    return conv.select("conv_id", "turn", F.md5(st).alias("searchable_md5"), F.length(st).alias("searchable_length"))


@register("keywords")
def _keywords(s):
    docs = s.table("documents")
    kw = X.keywords(F.col("text"), 3)
    return docs.select("doc_id", F.size(kw).alias("keyword_count"), F.md5(F.array_join(kw, " ")).alias("keywords_md5"))


@register("keyword_counts")
def _keyword_counts(s):
    docs = s.table("documents").select("doc_id", X.keywords(F.col("text"), 3).alias("kw"))
    terms = docs.select("doc_id", F.explode("kw").alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("doc_id").alias("documents"))


@register("truncate_words")
def _truncate_words(s):
    docs = s.table("documents")
    return docs.select("doc_id", X.truncate_at_word(F.col("text"), 80).alias("preview"))


@register("capitalize_words")
def _capitalize_words(s):
    conv = s.table("conversations")
    cap = X.capitalize_words(F.col("text"))
    return conv.select("conv_id", "turn", F.md5(cap).alias("capitalized_md5"))


@register("short_name")
def _short_name(s):
    docs = s.table("documents")
    short = X.shorten_name(F.col("text"))
    m = X.shortening_metrics(F.col("text"), short)
    return docs.select(
        "doc_id",
        short.alias("short_name"),
        m["original_length"].cast("long").alias("original_length"),
        m["short_length"].cast("long").alias("short_length"),
        F.round(m["compression_ratio"], 9).alias("compression_ratio"),
    )


@register("date_rollover")
def _date_rollover(s):
    """Day-of-month of the order date combined with the ship month: the
    combination is often impossible (31 Feb) and must roll over (D1); the
    strict DD/MM/YYYY parser (D4) rejects exactly those."""
    li = s.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    o = s.table("orders").select("o_orderkey", "o_orderdate")
    df = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    y, m, d = F.year("l_shipdate"), F.month("l_shipdate"), F.dayofmonth("o_orderdate")
    text = F.format_string("%02d/%02d/%04d", d, m, y)
    return df.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        N.date_rollover(y, m, d).cast("string").alias("rolled_date"),
        N.parse_dmy_strict(text).cast("string").alias("strict_date"),
    )


# ---------------------------------------------------------------- remaining inventory items


@register("company_aggregates_raw")
def _company_aggregates_raw(s):
    return R.company_rollup(s, round_values=False)


@register("unclassified_count")
def _unclassified_count(s):
    return R.unclassified_count(s)


@register("company_name_search")
def _company_name_search(s):
    return R.company_name_search(s, "customer#00000012", 20)


@register("company_searches")
def _company_searches(s):
    """A search per company: the last one to four characters of its name."""
    at = F.lit(1) + F.pmod(F.length(F.regexp_replace(F.md5("name"), "[0-9]", "")), F.lit(4)).cast("int")
    return R.company_searches(s, s.companies().select(F.right("name", at).alias("search")), k=20).select("search", "rank", "company_id", "name")


@register("company_name_search_short")
def _company_name_search_short(s):
    return R.company_name_search(s, "c", 20)


@register("companies_importing")
def _companies_importing(s):
    return R.companies_importing(s, "^small ")


@register("remove_diacritics")
def _remove_diacritics(s):
    docs = s.table("documents")
    x = X.remove_diacritics(F.col("text"))
    return docs.select("doc_id", F.md5(x).alias("plain_md5"))


@register("nfc_text")
def _nfc_text(s):
    conv = s.table("conversations")
    return conv.select("conv_id", "turn", F.md5(X.normalize_vietnamese(F.col("text"), compose=True)).alias("nfc_md5"))


from tradelens.operators import enrich as EN  # noqa: E402


@register("classify_goods")
def _classify_goods(s):
    g = s.goods().select("goods_id", "raw_name")
    out = EN.classify_names(g, "raw_name")
    return out.select("goods_id", F.col("_c.category").alias("category"), F.col("_c.confidence").alias("confidence"), F.col("_short").alias("short_name"))
