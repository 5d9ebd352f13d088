"""The two aggregate semantics (FIXTURES.md §2.7), match documents (§2.8)
and paging (§2.9)."""

import pytest
from pyspark.sql import functions as F

from tradelens.operators import aggregate as A
from tradelens.operators import engine as E
from tradelens.operators.listing import PageInfo, clamp_page, exceeds_cap, paginate

ROWS = [("A", 10.0), ("A", None), ("", 5.0), (None, 1.0), ("B", 4.0)]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(ROWS, "k string, v double")


def _sql_agg(df, op):
    # the tools' semantics without the field whitelist
    v = {"sum": F.coalesce(F.sum("v"), F.lit(0.0)), "avg": F.avg("v"), "min": F.min("v"), "count": F.count(F.lit(1))}[op]
    return {r.k: r.x for r in df.groupBy("k").agg(v.alias("x")).collect()}


def test_sql_semantics(df):
    assert _sql_agg(df, "sum") == {"A": 10.0, "": 5.0, None: 1.0, "B": 4.0}
    assert _sql_agg(df, "avg") == {"A": 10.0, "": 5.0, None: 1.0, "B": 4.0}
    assert _sql_agg(df, "count") == {"A": 2, "": 1, None: 1, "B": 1}
    assert df.groupBy("k").agg(F.count(F.lit(1))).count() == 4


def test_js_semantics(df):
    def res(op):
        return {r.key: (r.value, r["count"]) for r in E.group_by(df, "k", "v", op).collect()}

    assert res("sum") == {"A": (10.0, 2), "Unknown": (6.0, 2), "B": (4.0, 1)}
    assert res("average") == {"A": (5.0, 2), "Unknown": (3.0, 2), "B": (4.0, 1)}
    assert res("min")["A"] == (0.0, 2) and res("min")["Unknown"] == (1.0, 2)
    assert [r.key for r in E.group_by(df, "k", "v", "sum").collect()] == ["A", "Unknown", "B"]


def test_totals_on_empty(spark, df):
    empty = df.limit(0)
    row = E.compute_total(empty, "v", "sum").first()
    assert (row.key, row.value, row["count"]) == ("Total", 0.0, 0)
    facts = spark.createDataFrame([], "quantity decimal(18,2), hs_code string")
    assert A.aggregate_frame(facts, [{"field": "quantity", "operation": "sum"}]).count() == 0


def test_distinct_values_drop_null_after_limit(spark):
    from tradelens.sources.store import FrameStore

    facts = spark.createDataFrame([(x,) for x in ["A", None, "", "B", "A"]], "hs_code string")
    store = FrameStore(spark, facts, None, None, None)
    assert [r.value for r in A.get_distinct_values(store, "hs_code", limit=100).collect()] == ["", "A", "B"]
    assert A.get_distinct_values(store, "hs_code", limit=1).count() == 0


def test_validation_errors(spark):
    facts = spark.createDataFrame([(1.0, "x")], "quantity double, hs_code string")
    with pytest.raises(A.AggregationValidationError):
        A.aggregate_frame(facts, [{"field": "hs_code", "operation": "sum"}])
    with pytest.raises(A.AggregationValidationError):
        A.aggregate_frame(facts, [{"field": "quantity", "operation": "sum"}], group_by=["export_country"])
    with pytest.raises(A.AggregationValidationError):
        A.aggregate_frame(facts, [])


MATCH_ROWS = [(2024, "China", 15.0, "US", "xa", 1), (2023, "China", 25.0, None, "Xb", 2), (2024, "Japan", 5.0, "VN", "ya", None)]


def _match(spark, doc):
    df = spark.createDataFrame(MATCH_ROWS, "year int, import_country string, value double, country string, a string, b int")
    return sorted(r.value for r in df.filter(A.match_to_column(doc, df.schema)).collect())


def test_match_documents(spark):
    assert _match(spark, {"year": 2024, "importCountry": "China"}) == [15.0]
    assert _match(spark, {"value": {"$gte": 10, "$lt": 20}}) == [15.0]
    assert _match(spark, {"country": {"$in": ["US", None]}}) == [15.0, 25.0]
    assert _match(spark, {"country": None}) == [25.0]
    assert _match(spark, {"country": {"$ne": "US"}}) == [5.0, 25.0]
    assert _match(spark, {"$or": [{"b": 1}, {"a": {"$regex": "^x", "$options": "i"}}]}) == [15.0, 25.0]
    assert _match(spark, {"country": {"$exists": False}}) == [25.0]
    assert _match(spark, {"value": {"$not": {"$gt": 10}}}) == [5.0]
    assert _match(spark, {"$nor": [{"year": 2024}]}) == [25.0]
    with pytest.raises(A.MatchError):
        _match(spark, {"value": {"$near": 1}})


def test_paging(spark):
    assert clamp_page(None, None) == (1, 50)
    assert clamp_page(0, 0) == (1, 50)
    assert clamp_page(-3, 500) == (1, 100)
    assert clamp_page(2, -4) == (2, 1)
    info = PageInfo(101, 3, 50)
    assert info.total_pages == 3 and not info.has_next and info.has_previous
    df = spark.range(101)
    last = paginate(df, [F.col("id").asc()], 3, 50).collect()
    assert [r.id for r in last] == [100]
    assert exceeds_cap(df, 100) and not exceeds_cap(df, 101)


def test_sort_resolution():
    from tradelens.operators.listing import resolve_sort
    from tradelens.operators.rollups import COMPANY_SORTS, TRANSACTION_SORTS

    assert resolve_sort("bogus", COMPANY_SORTS, "totalImportValue", strict=False) == "total_import_value"
    with pytest.raises(ValueError):
        resolve_sort("bogus", TRANSACTION_SORTS, "date")


def test_summary_text_formats(spark):
    rows = [(f"K{i:02d}", float(1000 * (30 - i)) + 0.5, i + 1) for i in range(25)]
    res = spark.createDataFrame(rows, "key string, value double, count long")
    text = E.summary_text(res, E.AggregationSpec("total_value_usd", "sum", "importCountry")).first().text
    lines = text.split("\n")
    assert lines[0] == "Total by importCountry"
    assert lines[1] == "  K00: $30,001 (1 txns)"
    assert len(lines) == 22 and lines[-1] == "Total records: 325, showing top 20 of 25"
    avg = E.summary_text(res.limit(2), E.AggregationSpec("quantity", "average", None), total_records=7).first().text
    assert avg.split("\n") == ["Average by Overall", "  K00: 30000.50 (1 txns)", "  K01: 29000.50 (2 txns)", "Total records: 7"]


def test_cache_top_n_by_count(spark):
    cache = spark.createDataFrame(
        [("country", "A", 10.0, 1), ("country", "B", 5.0, 9), ("month", "2024-01", 1.0, 3)], "dim string, key string, value double, count long"
    )
    assert [r.key for r in E.cache_top_n(cache, "country", 1, sort_by="count").collect()] == ["B"]
    assert [r.key for r in E.cache_top_n(cache, "country", 5).collect()] == ["A", "B"]
    with pytest.raises(ValueError):
        E.cache_top_n(cache, "country", 1, sort_by="key")


def test_tool_failures_are_reported(spark):
    from tests.conftest import SF_SMALL
    from tradelens.operators.aggregate import run_tools
    from tradelens.sources.testbed import TestbedStore

    spec = {"aggregations": [{"field": "totalValueUSD", "operation": "sum"}], "groupBy": ["importCompanyRawName"]}
    bad = [
        {"name": "nope"},
        {"name": "aggregateTransactions", "parameters": {**spec, "sort": {"sum_totalValueUSD": "sideways"}}},
        {"name": "aggregateTransactions", "parameters": {**spec, "sort": {"unknown": 1}}},
        {"name": "countTransactions", "parameters": {"match": {"noField": 1}}},
        {},
    ]
    out = run_tools(TestbedStore(spark, SF_SMALL), bad + [{"name": "aggregateTransactions", "parameters": {**spec, "sort": {"sum_totalValueUSD": -1}, "limit": 1}}])
    assert all(isinstance(x, dict) and x["error"] for x in out[:-1])
    assert out[-1].columns == ["import_company_raw_name", "sum_totalValueUSD"]
