"""List and detail roll-ups over the star.

Plan shape used throughout: filter the fact table first (date predicates
reach the Parquet scan), reduce it to the grain of the answer with a
partially-aggregated ``groupBy`` (map-side combine makes a hot importer or
goods cheap), and only then join the dimension rows the answer shows.
Dimension joins are plain joins; Spark broadcasts a side only when its size
estimate is under ``autoBroadcastJoinThreshold`` and otherwise uses a
sort-merge join.  The reference's group-join that materialises every line
of a goods item into an array is deliberately not imitated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.numbers import check_date_range, iso_timestamp, js_round2, month_key, safe_div
from tradelens.operators.listing import order_columns, top_k_per_group
from tradelens.sources.store import Store


# ---------------------------------------------------------------- predicates


def regex_ci(c: Column, pattern: str) -> Column:
    """Case-insensitive regex with the user text as the pattern.

    ``(?iu)`` folds non-ASCII letters too (``Ô``/``ô``)."""
    return c.rlike("(?iu)" + pattern)


def date_range(c: Column, date_from=None, date_to=None) -> Column | None:
    """Inclusive range, either bound optional (``to`` is midnight of that day)."""
    check_date_range(date_from, date_to)
    cond = None
    if date_from is not None:
        cond = c >= F.lit(str(date_from)).cast("timestamp_ntz")
    if date_to is not None:
        upper = c <= F.lit(str(date_to)).cast("timestamp_ntz")
        cond = upper if cond is None else cond & upper
    return cond


def and_all(conds: Sequence[Column | None]) -> Column | None:
    """AND of the active filters."""
    out = None
    for c in conds:
        if c is not None:
            out = c if out is None else out & c
    return out


def _where(df: DataFrame, cond: Column | None) -> DataFrame:
    return df if cond is None else df.filter(cond)


def goods_in_category(store: Store, category: str) -> DataFrame:
    """P5 as a semi-join: goods ids whose category name equals ``category``."""
    cats = store.categories().filter(F.col("name") == category).select("category_id")
    return store.goods().join(cats, "category_id", "left_semi").select("goods_id")


def companies_matching(store: Store, pattern: str) -> DataFrame:
    """Company ids whose name matches the regex."""
    return store.companies().filter(regex_ci(F.col("name"), pattern)).select("company_id")


def _money(c: str) -> Column:
    return F.col(c).cast("double")


# ---------------------------------------------------------------- companies

COMPANY_SORTS = {
    "totalImportValue": "total_import_value",
    "totalQuantity": "total_quantity",
    "totalTransactions": "total_transactions",
    "uniqueGoodsCount": "unique_goods_count",
    "lastTransactionDate": "last_transaction_date",
}
COMPANY_SORTS.update({v: v for v in list(COMPANY_SORTS.values())})


def company_rollup(
    store: Store,
    date_from=None,
    date_to=None,
    category: str | None = None,
    search: str | None = None,
    round_values: bool = True,
) -> DataFrame:
    """A13 (and A16 with ``round_values=False``): one row per importer.

    total_transactions, total_import_value, total_quantity (rounded to 2 dp
    the JS way), unique_goods_count, first/last transaction date (ISO text).
    Filters: date range and category before grouping; ``search`` (regex on
    the company name) after grouping (P7)."""
    tx = store.facts(["company_id", "goods_id", "total_value_usd", "quantity", "date"], dates=(date_from, date_to))
    tx = _where(tx, date_range(F.col("date"), date_from, date_to))
    if category is not None:
        tx = tx.join(goods_in_category(store, category), "goods_id", "left_semi")
    agg = tx.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("total_value_usd").alias("_value"),
        F.sum("quantity").alias("_qty"),
        F.count_distinct("goods_id").alias("unique_goods_count"),
        F.min("date").alias("_first"),
        F.max("date").alias("_last"),
    )
    out = agg.join(store.companies(), "company_id")
    if search:
        out = out.filter(regex_ci(F.col("name"), search))
    rnd = js_round2 if round_values else (lambda c: F.col(c).cast("double"))
    return out.select(
        "company_id",
        "name",
        "address",
        "total_transactions",
        rnd("_value").alias("total_import_value"),
        rnd("_qty").alias("total_quantity"),
        "unique_goods_count",
        iso_timestamp("_first").alias("first_transaction_date"),
        iso_timestamp("_last").alias("last_transaction_date"),
    )


def company_list_page(store: Store, page=1, page_size=50, sort_by: str | None = None, sort_order: str = "desc", **filters) -> DataFrame:
    """A13 + L1 + L3: one page of the company list.  Unknown sort names fall
    back to total import value (the list's whitelist); pages are clamped
    like the other lists (Q12 fixed); ties break on ``company_id``."""
    from tradelens.operators.listing import clamp_page, paginate, resolve_sort

    p, size = clamp_page(page, page_size)
    col = resolve_sort(sort_by, COMPANY_SORTS, "totalImportValue", strict=False)
    return paginate(company_rollup(store, **filters), order_columns([(col, sort_order == "asc")], ["company_id"]), p, size)


def company_detail_stats(store: Store, company_id) -> DataFrame:
    """A18 header: the A13 metrics of one company (point lookup)."""
    tx = store.facts(["company_id", "goods_id", "total_value_usd", "quantity", "date"]).filter(F.col("company_id") == company_id)
    agg = tx.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        js_round2(F.sum("total_value_usd")).alias("total_import_value"),
        js_round2(F.sum("quantity")).alias("total_quantity"),
        F.count_distinct("goods_id").alias("unique_goods_count"),
        iso_timestamp(F.min("date")).alias("first_transaction_date"),
        iso_timestamp(F.max("date")).alias("last_transaction_date"),
    )
    return agg.join(store.companies().filter(F.col("company_id") == company_id), "company_id")


LINE_COLUMNS = ("declaration_number", "line_no", "date", "goods_id", "quantity", "total_value_usd", "unit_price_usd")


def company_latest_lines(store: Store, n: int = 1000, company_id=None) -> DataFrame:
    """A18 lines: the latest ``n`` lines of every company (or one), date
    descending, with goods and category names (Q4: category joined)."""
    tx = store.facts(["company_id", *LINE_COLUMNS])
    if company_id is not None:
        tx = tx.filter(F.col("company_id") == company_id)
    order = [F.col("date").desc()] + [F.col(c).asc() for c in LINE_COLUMNS if c != "date"]
    top = top_k_per_group(tx, ["company_id"], order, n, "rank")
    return store.attach_goods(top, {"raw_name": "goods_name"}).select(
        "company_id",
        "rank",
        "declaration_number",
        "line_no",
        iso_timestamp("date").alias("date"),
        "goods_id",
        "goods_name",
        F.coalesce("category", F.lit("")).alias("category"),
        _money("quantity").alias("quantity"),
        _money("total_value_usd").alias("total_value_usd"),
    )


def company_top_goods(store: Store, k: int = 10) -> DataFrame:
    """A34 topGoods: the ``k`` goods with the highest value per company."""
    tx = store.facts(["company_id", "goods_id", "total_value_usd", "quantity"])
    per = tx.groupBy("company_id", "goods_id").agg(
        F.sum("total_value_usd").alias("_value"),
        F.sum("quantity").alias("_qty"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    top = top_k_per_group(per, ["company_id"], [F.col("_value").desc(), F.col("goods_id").asc()], k)
    names = store.goods().select("goods_id", F.col("raw_name").alias("goods_name"))
    return top.join(names, "goods_id", "left").select(
        "company_id",
        "rank",
        "goods_id",
        "goods_name",
        _money("_value").alias("total_value"),
        _money("_qty").alias("total_quantity"),
        "transaction_count",
    )


def _facts_with_category(store: Store, columns: Sequence[str]) -> DataFrame:
    tx = store.facts(["goods_id", *[c for c in columns if c != "goods_id"]])
    return store.attach_goods(tx)


def company_category_share(store: Store) -> DataFrame:
    """A35 categoryBreakdown: value per (company, category) and its share of
    the company's total, in percent."""
    tx = _facts_with_category(store, ["company_id", "total_value_usd"])
    per = tx.groupBy("company_id", "category").agg(
        F.sum("total_value_usd").alias("_value"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    total = F.sum("_value").over(_company_window())
    return per.select(
        "company_id",
        F.coalesce("category", F.lit("")).alias("category"),
        _money("_value").alias("total_value"),
        "transaction_count",
        F.when(total.cast("double") > 0, F.col("_value").cast("double") * 100 / total.cast("double")).otherwise(F.lit(0.0)).alias("percentage"),
    )


def _company_window():
    from pyspark.sql import Window

    return Window.partitionBy("company_id")


def company_monthly_trend(store: Store) -> DataFrame:
    """Month, value, quantity and line count per company."""
    tx = store.facts(["company_id", "date", "total_value_usd", "quantity"])
    return (
        tx.groupBy("company_id", month_key("date").alias("month"))
        .agg(
            F.sum("total_value_usd").alias("_value"),
            F.sum("quantity").alias("_qty"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
        .select("company_id", "month", _money("_value").alias("total_value"), _money("_qty").alias("total_quantity"), "transaction_count")
    )


def company_top_category(store: Store) -> DataFrame:
    """A33 mostFrequentCategory: category with most lines (ties: name)."""
    tx = _facts_with_category(store, ["company_id"])
    per = tx.groupBy("company_id", "category").agg(F.count(F.lit(1)).alias("transaction_count"))
    top = top_k_per_group(per, ["company_id"], [F.col("transaction_count").desc(), F.col("category").asc()], 1)
    return top.select("company_id", F.col("category").alias("most_frequent_category"), "transaction_count")


def _orders_by_country(store: Store) -> DataFrame:
    """Lines and value per (company, export country, declaration): the one
    aggregation of the facts that all figures of A34 derive from."""
    tx = store.facts(["company_id", "export_country", "declaration_number", "total_value_usd"])
    return tx.groupBy("company_id", "export_country", "declaration_number").agg(F.sum("total_value_usd").alias("_v"), F.count(F.lit(1)).alias("_n"))


def company_export_countries(store: Store) -> DataFrame:
    """totalSuppliers (distinct export countries), averageOrderValue
    (value per declaration) and the top export country by value."""
    orders = _orders_by_country(store)
    per_country = orders.groupBy("company_id", "export_country").agg(F.sum("_v").alias("_cv"))
    top = top_k_per_group(per_country, ["company_id"], [F.col("_cv").desc(), F.col("export_country").asc()], 1).select(
        "company_id", F.col("export_country").alias("top_export_country")
    )
    # a declaration may name several countries: distinct per company before counting
    counts = orders.groupBy("company_id", "declaration_number").agg(F.sum("_v").alias("_v")).groupBy("company_id").agg(F.count("declaration_number").alias("order_count"), F.sum("_v").alias("_value"))
    suppliers = per_country.groupBy("company_id").agg(F.count("export_country").alias("total_suppliers"))
    return counts.join(suppliers, "company_id").join(top, "company_id").select(
        "company_id",
        "total_suppliers",
        "order_count",
        _money("_value").alias("total_value"),
        (F.col("_value").cast("double") / F.col("order_count")).alias("average_order_value"),
        "top_export_country",
    )


def company_top_export_countries(store: Store, k: int = 5) -> DataFrame:
    """A34 topExportCountries[]: per company the ``k`` countries with most
    lines (ties by name), as an array of (country, transaction_count) in that
    order.  The limit is applied before and after the shuffle
    (``top_k_per_group``), so a list never holds more than ``k`` entries."""
    per = _orders_by_country(store).groupBy("company_id", F.coalesce("export_country", F.lit("")).alias("country")).agg(F.sum("_n").alias("transaction_count"))
    top = top_k_per_group(per, ["company_id"], [F.col("transaction_count").desc(), F.col("country").asc()], k)
    entries = F.array_sort(F.collect_list(F.struct("rank", "country", "transaction_count")))
    return top.groupBy("company_id").agg(F.transform(entries, lambda e: F.struct(e["country"].alias("country"), e["transaction_count"].alias("transaction_count"))).alias("top_export_countries"))


# ---------------------------------------------------------------- goods


def goods_rollup(
    store: Store,
    company: str | None = None,
    date_from=None,
    date_to=None,
    category: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """One row per goods with at least one matching line.

    Σ quantity, Σ value, line count, last date and the weighted average
    price Σvalue/Σquantity (0 when Σquantity <= 0).  ``company`` is a regex
    on the importer name (semi-join, J4; fixes Q1), ``search`` a regex on
    raw or short name, ``category`` an exact name.  Facts are aggregated to
    goods grain before the dimension join (not a group-join)."""
    tx = store.facts(["goods_id", "company_id", "quantity", "total_value_usd", "date"], dates=(date_from, date_to))
    tx = _where(tx, date_range(F.col("date"), date_from, date_to))
    if company:
        tx = tx.join(companies_matching(store, company), "company_id", "left_semi")
    per = tx.groupBy("goods_id").agg(
        F.sum("quantity").alias("_qty"),
        F.sum("total_value_usd").alias("_value"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.max("date").alias("_last"),
    )
    g = store.goods_with_category()
    if category is not None:
        g = g.filter(F.col("category") == category)
    if search:
        g = g.filter(regex_ci(F.col("raw_name"), search) | regex_ci(F.coalesce(F.col("short_name"), F.lit("")), search))
    return g.join(per, "goods_id").select(
        "goods_id",
        F.coalesce("raw_name", F.lit("")).alias("raw_name"),
        F.coalesce("short_name", F.lit("")).alias("short_name"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("hs_code", F.lit("")).alias("hs_code"),
        _money("_qty").alias("total_quantity_exported"),
        _money("_value").alias("total_value_exported"),
        "transaction_count",
        safe_div("_value", "_qty").alias("average_price"),
        iso_timestamp("_last").alias("last_export_date"),
    )


GOODS_SORTS = {
    "totalValueExported": "total_value_exported",
    "totalQuantityExported": "total_quantity_exported",
    "transactionCount": "transaction_count",
    "averagePrice": "average_price",
    "lastExportDate": "last_export_date",
    "rawName": "raw_name",
    "shortName": "short_name",
    "category": "category",
    "hsCode": "hs_code",
}
GOODS_SORTS.update({v: v for v in list(GOODS_SORTS.values())})


def goods_list_page(store: Store, page=1, page_size=50, sort_by: str | None = None, sort_order: str = "desc", **filters) -> DataFrame:
    """A14 + L1 + L3: one page of the goods list (default: total value
    exported, descending); unknown sort names raise (Q5); ties break on
    ``goods_id``."""
    from tradelens.operators.listing import clamp_page, paginate, resolve_sort

    p, size = clamp_page(page, page_size)
    col = resolve_sort(sort_by, GOODS_SORTS, "totalValueExported")
    return paginate(goods_rollup(store, **filters), order_columns([(col, sort_order == "asc")], ["goods_id"]), p, size)


def goods_mean_price(store: Store, date_from=None, date_to=None) -> DataFrame:
    """Per goods Σ, Σ, count, **plain mean** of unit price (rounded to
    6 dp), first and last date, category (Q3 fixed: the filter applies)."""
    tx = store.facts(["goods_id", "quantity", "total_value_usd", "unit_price_usd", "date"], dates=(date_from, date_to))
    tx = _where(tx, date_range(F.col("date"), date_from, date_to))
    per = tx.groupBy("goods_id").agg(
        F.sum("quantity").alias("_qty"),
        F.sum("total_value_usd").alias("_value"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.avg("unit_price_usd").alias("_avg"),
        F.min("date").alias("_first"),
        F.max("date").alias("_last"),
    )
    g = store.goods_with_category().select("goods_id", "raw_name", "category")
    return g.join(per, "goods_id").select(
        "goods_id",
        "raw_name",
        "category",
        _money("_qty").alias("total_quantity"),
        _money("_value").alias("total_value"),
        "transaction_count",
        F.round("_avg", 6).alias("average_unit_price"),
        iso_timestamp("_first").alias("first_date"),
        iso_timestamp("_last").alias("last_date"),
    )


def goods_detail_stats(store: Store, goods_id) -> DataFrame:
    """A17 header for one goods: Σ, Σ, count, weighted price."""
    tx = store.facts(["goods_id", "quantity", "total_value_usd"]).filter(F.col("goods_id") == goods_id)
    return tx.groupBy("goods_id").agg(
        F.sum("quantity").cast("double").alias("total_quantity"),
        F.sum("total_value_usd").cast("double").alias("total_value"),
        F.count(F.lit(1)).alias("transaction_count"),
        safe_div(F.sum("total_value_usd"), F.sum("quantity")).alias("average_price"),
    )


def goods_lines(store: Store, goods_id, page: int = 1, page_size: int = 50) -> DataFrame:
    """A17 lines: one page of a goods item's lines, newest first."""
    tx = store.facts(["goods_id", "company_id", *[c for c in LINE_COLUMNS if c != "goods_id"]]).filter(F.col("goods_id") == goods_id)
    order = order_columns([("date", False)], ["declaration_number", "line_no", "company_id"])
    return tx.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def goods_top_companies(store: Store, k: int = 5) -> DataFrame:
    """A37 topCompanies: the ``k`` importers with the highest value per goods."""
    tx = store.facts(["goods_id", "company_id", "total_value_usd", "quantity"])
    per = tx.groupBy("goods_id", "company_id").agg(
        F.sum("total_value_usd").alias("_value"),
        F.sum("quantity").alias("_qty"),
        F.count(F.lit(1)).alias("transaction_count"),
    )
    top = top_k_per_group(per, ["goods_id"], [F.col("_value").desc(), F.col("company_id").asc()], k)
    names = store.companies().select("company_id", F.col("name").alias("company_name"))
    return top.join(names, "company_id", "left").select(
        "goods_id",
        "rank",
        "company_id",
        "company_name",
        _money("_qty").alias("total_quantity"),
        _money("_value").alias("total_value"),
        "transaction_count",
    )


def goods_monthly_trend(store: Store) -> DataFrame:
    """A36 for goods: month, value, quantity, line count per goods."""
    tx = store.facts(["goods_id", "date", "total_value_usd", "quantity"])
    return (
        tx.groupBy("goods_id", month_key("date").alias("month"))
        .agg(
            F.sum("total_value_usd").alias("_value"),
            F.sum("quantity").alias("_qty"),
            F.count(F.lit(1)).alias("transaction_count"),
        )
        .select("goods_id", "month", _money("_value").alias("total_value"), _money("_qty").alias("total_quantity"), "transaction_count")
    )


# ---------------------------------------------------------------- categories / dashboard


def category_rollup(store: Store) -> DataFrame:
    """Goods count, export value and line count per category.

    Facts are reduced to goods grain first, then attached to the goods
    dimension (goods without lines still count toward goods_count)."""
    per_goods = store.facts(["goods_id", "total_value_usd"]).groupBy("goods_id").agg(
        F.sum("total_value_usd").alias("_value"), F.count(F.lit(1)).alias("_n")
    )
    g = store.goods_with_category().select("goods_id", "category")
    return (
        g.join(per_goods, "goods_id", "left")
        .groupBy("category")
        .agg(
            F.count(F.lit(1)).alias("goods_count"),
            F.coalesce(F.sum("_value"), F.lit(0)).cast("double").alias("total_export_value"),
            F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("transaction_count"),
        )
    )


def category_names(store: Store) -> DataFrame:
    """Category names, empty ones removed, in code-point order."""
    names = store.categories().select("name").filter(F.col("name").isNotNull() & (F.col("name") != ""))
    return names.orderBy("name")


def dashboard_stats(store: Store) -> DataFrame:
    """A19 + A21 in one aggregation pass over a union of the three tables.

    One row: company, goods and transaction counts, total value, goods
    still classified by the fallback, latest ``created_at`` (ISO text).
    A union + conditional counts avoids joining single-row aggregates."""
    tx = store.facts(["total_value_usd", "created_at"])
    u = (
        store.companies().select(F.lit(1).alias("_t"), F.lit(None).cast("decimal(18,2)").alias("_v"), F.lit(None).cast("string").alias("_c"), F.lit(None).cast("timestamp_ntz").alias("_ts"))
        .unionByName(store.goods().select(F.lit(2).alias("_t"), F.lit(None).cast("decimal(18,2)").alias("_v"), F.col("classified_by").alias("_c"), F.lit(None).cast("timestamp_ntz").alias("_ts")))
        .unionByName(tx.select(F.lit(3).alias("_t"), F.col("total_value_usd").alias("_v"), F.lit(None).cast("string").alias("_c"), F.col("created_at").cast("timestamp_ntz").alias("_ts")))
    )
    return u.agg(
        F.count_if(F.col("_t") == 1).alias("total_companies"),
        F.count_if(F.col("_t") == 2).alias("total_goods"),
        F.count_if(F.col("_t") == 3).alias("total_transactions"),
        F.coalesce(F.sum("_v"), F.lit(0)).cast("double").alias("total_value_usd"),
        F.count_if(F.col("_c") == "fallback").alias("unclassified_goods"),
        iso_timestamp(F.max("_ts")).alias("last_import_date"),
    )


def unclassified_count(store: Store) -> DataFrame:
    """Goods whose category came from the import fallback."""
    return store.goods().agg(F.count_if(F.col("classified_by") == "fallback").alias("count"))


# ---------------------------------------------------------------- transactions list

TRANSACTION_SORTS = {
    "date": "date",
    "totalValueUSD": "total_value_usd",
    "totalValue": "total_value_usd",
    "quantity": "quantity",
    "unitPriceUSD": "unit_price_usd",
    "unitPrice": "unit_price_usd",
    "companyName": "company_name",
    "company.name": "company_name",
    "goodsName": "goods_name",
    "category": "category",
    "declarationNumber": "declaration_number",
}
TRANSACTION_SORTS.update({v: v for v in list(TRANSACTION_SORTS.values())})
_TX_COLUMNS = (
    "declaration_number", "line_no", "date", "company_id", "goods_id", "hs_code", "quantity", "unit",
    "unit_price_usd", "total_value_usd", "export_country", "import_country", "customs_office",
)


def _tx_default(c: str) -> Column:
    """An amount of the list: zero if the fact has none."""
    return F.coalesce(F.col(c), F.lit(0.0) if c == "unit_price_usd" else F.lit(0).cast("decimal(18,2)"))


def transactions_view(
    store: Store,
    company: str | None = None,
    goods: str | None = None,
    category: str | None = None,
    date_from=None,
    date_to=None,
    hs_code: str | None = None,
    customs_office: str | None = None,
    export_country: str | None = None,
    import_country: str | None = None,
    min_value=None,
    max_value=None,
    company_ids: Sequence | None = None,
    goods_ids: Sequence | None = None,
    categories: Sequence[str] | None = None,
    include_raw: bool = False,
    first: tuple[Sequence[tuple[str, bool]], int] | None = None,
) -> DataFrame:
    """J1 + P1-P6, P9, P9b: fact ⟕ company ⟕ goods ⟕ category, filtered.

    Unmatched dimension fields become ``''`` (P2).  Fact predicates are
    applied before the joins (pushed to the scan); name predicates after.
    ``first`` = (sort, n) joins only the first ``n`` facts in the order of the
    view's columns ``sort``, which must be fact columns; the first ``n`` rows of
    the view are among theirs unless a name predicate is given."""
    with_raw = include_raw and "raw_data" in _fact_columns(store)
    tx = store.facts(list(_TX_COLUMNS) + (["raw_data"] if with_raw else []), dates=(date_from, date_to))
    fact_conds = [
        date_range(F.col("date"), date_from, date_to),
        (F.col("hs_code") == hs_code) if hs_code is not None else None,
        (F.col("customs_office") == customs_office) if customs_office is not None else None,
        (F.col("export_country") == export_country) if export_country is not None else None,
        (F.col("import_country") == import_country) if import_country is not None else None,
        (F.col("total_value_usd") >= F.lit(min_value)) if min_value is not None else None,
        (F.col("total_value_usd") <= F.lit(max_value)) if max_value is not None else None,
        F.col("company_id").isin(list(company_ids)) if company_ids else None,
        F.col("goods_id").isin(list(goods_ids)) if goods_ids else None,
    ]
    tx = _where(tx, and_all(fact_conds))
    if first is not None:
        sort, n = first
        tx = tx.withColumns({c: _tx_default(c) for c in ("quantity", "unit_price_usd", "total_value_usd")}).orderBy(*order_columns(sort, TX_TIE_BREAK)).limit(n)
    comp = store.companies().select("company_id", F.col("name").alias("company_name"))
    df = store.attach_goods(tx.join(comp, "company_id", "left"), {"raw_name": "goods_name", "short_name": "short_name"})
    name_conds = [
        regex_ci(F.col("company_name"), company) if company else None,
        regex_ci(F.col("short_name"), goods) if goods else None,
        (F.col("category") == category) if category is not None else None,
        F.col("category").isin(list(categories)) if categories else None,
    ]
    df = _where(df, and_all(name_conds))
    return df.select(
        "declaration_number",
        "line_no",
        "date",
        "company_id",
        F.coalesce("company_name", F.lit("")).alias("company_name"),
        "goods_id",
        F.coalesce("goods_name", F.lit("")).alias("goods_name"),
        F.coalesce("short_name", F.lit("")).alias("short_name"),
        F.coalesce("category", F.lit("")).alias("category"),
        "hs_code",
        _tx_default("quantity").alias("quantity"),
        "unit",
        _tx_default("unit_price_usd").alias("unit_price_usd"),
        _tx_default("total_value_usd").alias("total_value_usd"),
        "export_country",
        F.coalesce("import_country", F.lit("")).alias("import_country"),
        "customs_office",
        *(["raw_data"] if with_raw else []),
    )


TX_TIE_BREAK = ("declaration_number", "line_no", "goods_id", "company_id", "quantity", "total_value_usd")


def transactions_page(store: Store, page=1, page_size=50, sort_by: str = "date", ascending: bool = False, **filters) -> DataFrame:
    """L1 + L3 over :func:`transactions_view`; date as ISO text (D3)."""
    from tradelens.operators.listing import clamp_page, resolve_sort

    p, size = clamp_page(page, page_size)
    col = resolve_sort(sort_by, TRANSACTION_SORTS, "date")
    order = order_columns([(col, ascending)], TX_TIE_BREAK)
    by_fact = col in _TX_COLUMNS and not any(filters.get(f) for f in ("company", "goods", "categories")) and filters.get("category") is None
    # a page of lines in an order of their own: only its lines meet the dimensions
    view = transactions_view(store, **filters, first=([(col, ascending)], p * size) if by_fact else None)
    paged = view.orderBy(*order).offset((p - 1) * size).limit(size)
    return paged.withColumns(
        {"date": iso_timestamp("date"), "quantity": _money("quantity"), "total_value_usd": _money("total_value_usd")}
    )


def transactions_index(store: Store, page_size=50, sort_by: str = "date", ascending: bool = False, every: int = 1, **filters):
    """L3: the page starts of a transaction list (see ``listing.page_index``)."""
    from tradelens.operators.listing import clamp_page, page_index, resolve_sort

    _, size = clamp_page(1, page_size)
    col = resolve_sort(sort_by, TRANSACTION_SORTS, "date")
    return page_index(transactions_view(store, **filters), [(col, ascending)], TX_TIE_BREAK, size, every)


def _as_page(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"date": iso_timestamp("date"), "quantity": _money("quantity"), "total_value_usd": _money("total_value_usd")})


def transactions_indexed_page(store: Store, index, page: int, **filters) -> DataFrame:
    """A page of the list an index was made of; equal to ``transactions_page``
    with the same sort and filters, without keeping the pages before it."""
    return _as_page(index.page(transactions_view(store, **filters), max(1, page)))


def transactions_after(store: Store, last: dict | None, page_size=50, sort_by: str = "date", ascending: bool = False, **filters) -> DataFrame:
    """The page that follows the row with the sort values ``last`` (columns of
    ``transactions_view``: the sort column and ``TX_TIE_BREAK``)."""
    from tradelens.operators.listing import clamp_page, resolve_sort, seek_page

    _, size = clamp_page(1, page_size)
    col = resolve_sort(sort_by, TRANSACTION_SORTS, "date")
    return _as_page(seek_page(transactions_view(store, **filters), [(col, ascending)], TX_TIE_BREAK, size, last))


def transactions_api_page(store: Store, page=1, page_size=50, sort_by: str = "date", ascending: bool = False, **filters) -> DataFrame:
    """P1 + P2 + S6: the list page in the API's nested shape — ``company``
    and ``goods`` structs, numbers defaulted to 0, ``currency`` and the
    original row as JSON text (``raw_csv_data``) for the page rows only.
    The top-k keeps ``offset + limit`` rows per task, so the raw maps of
    the other rows are read but never shuffled."""
    from tradelens.operators.listing import clamp_page, resolve_sort

    p, size = clamp_page(page, page_size)
    col = resolve_sort(sort_by, TRANSACTION_SORTS, "date")
    view = transactions_view(store, include_raw=True, **filters)
    order = order_columns([(col, ascending)], TX_TIE_BREAK)
    paged = view.orderBy(*order).offset((p - 1) * size).limit(size)
    has_raw = "raw_data" in view.columns
    comp_addr = store.companies().select("company_id", F.coalesce("address", F.lit("")).alias("_addr"))
    # the joins do not keep row order: sort the (at most page_size) rows again
    paged = paged.join(comp_addr, "company_id", "left").orderBy(*order)
    return paged.select(
        F.coalesce("declaration_number", F.lit("")).alias("declaration_number"),
        F.coalesce(iso_timestamp("date"), F.lit("")).alias("date"),
        F.struct(
            F.coalesce(F.col("company_id").cast("string"), F.lit("")).alias("id"),
            F.col("company_name").alias("name"),
            F.coalesce("_addr", F.lit("")).alias("address"),
        ).alias("company"),
        F.struct(
            F.coalesce(F.col("goods_id").cast("string"), F.lit("")).alias("id"),
            F.col("goods_name").alias("raw_name"),
            F.col("short_name").alias("short_name"),
            F.col("category").alias("category"),
        ).alias("goods"),
        F.coalesce(_money("quantity"), F.lit(0.0)).alias("quantity"),
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.coalesce("unit_price_usd", F.lit(0.0)).alias("unit_price"),
        F.coalesce(_money("total_value_usd"), F.lit(0.0)).alias("total_value"),
        F.lit("USD").alias("currency"),
        F.col("hs_code"),
        (F.coalesce(F.to_json("raw_data"), F.lit("")) if has_raw else F.lit("")).alias("raw_csv_data"),
    )


def _fact_columns(store: Store) -> set[str]:
    from tradelens.sources.testbed import FACT_COLUMNS, TestbedStore

    if isinstance(store, TestbedStore):
        return set(FACT_COLUMNS)
    return set(store.facts().columns)


def transactions_count(store: Store, page_size=50, **filters) -> DataFrame:
    """L4: total and page count of the filtered list, as one row."""
    from tradelens.operators.listing import clamp_page

    _, size = clamp_page(1, page_size)
    view = transactions_view(store, **filters)
    return view.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("total_pages"))


def transactions_summary(store: Store, **filters) -> DataFrame:
    """Total value, total quantity and weighted average unit price of
    the filtered list."""
    view = transactions_view(store, **filters)
    return view.agg(
        F.count(F.lit(1)).alias("total"),
        js_round2(F.sum("total_value_usd")).alias("total_value"),
        js_round2(F.sum("quantity")).alias("total_quantity"),
    ).select("total", "total_value", "total_quantity", safe_div("total_value", "total_quantity").alias("average_unit_price"))


# ---------------------------------------------------------------- search and point lookups


#: up to so many search texts are sent to every task; more are dealt out by their pairs, each pair in so many slices
SEARCHES_SENT = 100_000
PAIR_SLICES = 16


def company_searches(store: Store, searches: DataFrame, k: int = 20, min_length: int = 2) -> DataFrame:
    """L6 + L7 for a table of search texts (column ``search``): of every
    distinct text the first ``k`` companies, by name, whose name contains it
    (any case).  Texts shorter than ``min_length`` find nothing.

    Names are looked up by the text's rarest pair of characters (an inverted
    index of character pairs), then checked whole: no text meets a name it
    shares no rare pair with.  Names are dealt out by company before their
    pairs are listed, and the list of pairs is never the side that is sent to
    the tasks or held in memory per key, so a task holds the hits of its own
    share of the names."""
    from tradelens.operators.listing import exceeds_cap

    if min_length < 2:
        raise ValueError("min_length must be at least 2")

    def pairs(text: str) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(F.col(text), i, F.lit(2))))

    texts = searches.select(F.lower("search").alias("search")).filter(F.length("search") >= min_length).distinct()
    few = not exceeds_cap(texts, SEARCHES_SENT)
    slices = 1 if few else PAIR_SLICES
    tasks = int(store.spark.conf.get("spark.sql.shuffle.partitions"))  # a number given is kept: the few bytes of a name say little of its hits
    names = store.companies().select("company_id", "name").repartition(tasks, "company_id", "name")
    names = names.select("company_id", "name", F.lower("name").alias("_name")).filter(F.length("name") >= min_length)
    index = names.select("company_id", "name", "_name", F.explode(pairs("_name")).alias("_pair"))
    often = index.groupBy("_pair").agg(F.count(F.lit(1)).alias("_n"))
    asked = texts.select("search", F.explode(pairs("search")).alias("_pair")).join(often, "_pair", "left")
    rarest = asked.groupBy("search").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_pair")).alias("_r")).select("search", F.col("_r._pair").alias("_pair"))
    rarest = rarest.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).hint("broadcast" if few else "merge")
    index = index.withColumn("_slice", F.pmod(F.xxhash64("company_id", "name"), F.lit(slices)).cast("int"))
    hits = index.join(rarest, ["_pair", "_slice"]).filter(F.contains("_name", "search")).select("search", "company_id", "name")
    return top_k_per_group(hits, ["search"], [F.col("name").asc(), F.col("company_id").asc()], k)


def company_name_search(store: Store, query: str | None, limit: int = 20) -> DataFrame:
    """L7 + P3 + L6: companies whose name matches ``query`` (case-insensitive
    regex), at most ``limit``, by name; a query under 2 characters returns
    nothing."""
    from tradelens.operators.listing import short_query_guard

    comp = store.companies()
    if query is None or len(query) < 2:
        return short_query_guard(comp.select("company_id", "name", "address"), query)
    hits = comp.filter(regex_ci(F.col("name"), query)).select("company_id", "name", F.coalesce("address", F.lit("")).alias("address"))
    return hits.orderBy("name", "company_id").limit(limit)


def companies_importing(store: Store, goods_pattern: str) -> DataFrame:
    """Companies that import a goods item whose raw name matches the
    regex (``GET /companies?goods=...``) — a semi-join of the company
    dimension on the facts of those goods."""
    g = store.goods().filter(regex_ci(F.col("raw_name"), goods_pattern)).select("goods_id")
    tx = store.facts(["company_id", "goods_id"]).join(g, "goods_id", "left_semi").select("company_id")
    return store.companies().join(tx, "company_id", "left_semi")


def transaction_by_key(store: Store, declaration_number: str, line_no: int | None = None) -> DataFrame:
    """Point lookup of the lines of one declaration (and line)."""
    tx = store.facts().filter(F.col("declaration_number") == declaration_number)
    return tx if line_no is None else tx.filter(F.col("line_no") == line_no)
