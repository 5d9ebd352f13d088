"""Point lookups (A17, A18, P9c), constraints (I17), CSV export (S7),
formatting (N6, D5), collation (X10), intents validation (U4/P21)."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tradelens.functions import numbers as N
from tradelens.functions import text as X
from tradelens.operators import rollups as R
from tradelens.operators.filters import FilterExpression, FilterValidationError, validate_filter
from tradelens.plans.intent import IntentError, QueryIntent
from tradelens.sources.customs_csv import write_csv
from tradelens.sources.testbed import TestbedStore


@pytest.fixture(scope="module")
def store(spark):
    return TestbedStore(spark, SF_SMALL)


def test_company_detail_matches_rollup(store):
    cid = store.facts(["company_id"]).first().company_id
    detail = R.company_detail_stats(store, cid).first().asDict()
    row = R.company_rollup(store).filter(F.col("company_id") == cid).first().asDict()
    for k in ("total_transactions", "total_import_value", "total_quantity", "unique_goods_count", "first_transaction_date"):
        assert detail[k] == row[k], k
    lines = R.company_latest_lines(store, n=3, company_id=cid).collect()
    assert [r["rank"] for r in lines] == sorted(r["rank"] for r in lines)[: len(lines)]
    assert len(lines) == min(3, row["total_transactions"])


def test_goods_detail_and_page(store):
    gid = store.facts(["goods_id"]).first().goods_id
    d = R.goods_detail_stats(store, gid).first()
    g = R.goods_rollup(store).filter(F.col("goods_id") == gid).first()
    assert d.transaction_count == g.transaction_count and abs(d.average_price - g.average_price) < 1e-9
    page = R.goods_lines(store, gid, page=1, page_size=2).collect()
    assert len(page) == min(2, g.transaction_count)


def test_transaction_by_key(store):
    first = store.facts(["declaration_number", "line_no"]).first()
    rows = R.transaction_by_key(store, first.declaration_number, first.line_no).collect()
    assert rows and all(r.declaration_number == first.declaration_number for r in rows)


def test_constraint_violations(spark):
    from tradelens.operators.ingest import constraint_violations

    df = spark.createDataFrame(
        [(1, "", 1999, 13, 0, -0.5, "x"), (2, "D1", 2024, 1, 1, 0.0, "")],
        "source_row long, declaration_number string, year int, month int, day int, tax_rate double, goods_raw_name string",
    )
    got = sorted((r.source_row, r.field) for r in constraint_violations(df).collect())
    assert got == [(1, "day"), (1, "declaration_number"), (1, "month"), (1, "tax_rate"), (1, "year"), (2, "goods_raw_name")]


def test_csv_export_roundtrip(spark, store, tmp_dir):
    view = R.transactions_view(store, date_from="1997-01-01", date_to="1997-03-31")
    out = os.path.join(tmp_dir, "export")
    write_csv(view.withColumn("date", N.iso_timestamp("date")), out)
    back = spark.read.option("header", True).option("sep", ";").csv(out)
    assert back.count() == view.count()
    assert set(back.columns) == set(view.columns)


def test_formatting_helpers(spark):
    df = spark.createDataFrame([("2024-09-02 10:11:12",)], "t string").select(F.to_timestamp("t").alias("t"))
    r = df.select(
        N.format_date_vi("t").alias("d"),
        N.format_month_year("t").alias("m"),
        N.format_date_range("t", "t").alias("r"),
        N.relative_time("t", F.lit("2024-09-05 10:11:12").cast("timestamp")).alias("rel"),
        N.format_percentage(F.lit(0.1234)).alias("p"),
        N.format_vnd(F.lit(1234567.0)).alias("v"),
    ).first()
    assert (r.d, r.m, r.r, r.rel, r.p, r.v) == ("02/09/2024", "09/2024", "02/09/2024 - 02/09/2024", "3 ngày trước", "12.3%", "1.234.567\u00a0₫")


def test_collation(spark):
    df = spark.createDataFrame([("Tôm",), ("TOM",), ("tam",)], "n string")
    # case is folded, but ô is a letter of its own
    assert [r.n for r in df.filter(X.collate_vietnamese(F.col("n")) == F.lit("tom")).collect()] == ["TOM"]
    assert [r.n for r in df.filter(X.collate_vietnamese(F.col("n")) == F.lit("TÔM")).collect()] == ["Tôm"]
    assert [r.n for r in df.orderBy(X.collate_vietnamese(F.col("n"))).collect()] == ["tam", "TOM", "Tôm"]


def test_spec_validation():
    with pytest.raises(FilterValidationError):
        validate_filter(FilterExpression("x", "like", "a"))
    with pytest.raises(FilterValidationError):
        validate_filter(FilterExpression("x", "equals", "a", fuzzy_threshold=9))
    with pytest.raises(FilterValidationError):
        validate_filter(FilterExpression("", "equals", "a"))
    with pytest.raises(IntentError):
        QueryIntent("guess")
    with pytest.raises(IntentError):
        QueryIntent("ranking", limit=0)


def test_transactions_api_page(store):
    import json

    rows = R.transactions_api_page(store, page=1, page_size=5, sort_by="totalValue").collect()
    assert len(rows) == 5
    assert [r.total_value for r in rows] == sorted((r.total_value for r in rows), reverse=True)
    r = rows[0]
    assert r.currency == "USD" and r.company.name.startswith("Customer#") and r.goods.category != ""
    raw = json.loads(r.raw_csv_data)
    assert raw["l_orderkey"] == r.declaration_number
