"""Correctness when one key holds a third of all rows (the skew case the
design targets): roll-ups, top-k per group and de-duplication against
brute force on a skewed frame store."""

import random

import pytest
from pyspark.sql import functions as F

from tradelens.operators import dedup as D
from tradelens.operators import rollups as R
from tradelens.sources.store import FrameStore


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(6000):
        company = 1 if i % 3 == 0 else rnd.randint(2, 200)  # company 1 holds a third
        goods = rnd.randint(1, 40)
        rows.append((f"D{i // 4}", i % 4, company, goods, float(rnd.randint(1, 50)), float(rnd.randint(100, 99999)) / 100))
    facts = spark.createDataFrame(rows, "declaration_number string, line_no int, company_id long, goods_id long, q double, v double").select(
        "declaration_number", "line_no", "company_id", "goods_id",
        F.col("q").cast("decimal(18,2)").alias("quantity"), F.col("v").cast("decimal(18,2)").alias("total_value_usd"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("date"),
    )
    companies = spark.createDataFrame([(i, f"C{i}", "") for i in range(1, 201)], "company_id long, name string, address string")
    goods = spark.createDataFrame([(i, f"G{i}", f"G{i}", 1, "h", "fallback") for i in range(1, 41)],
                                  "goods_id long, raw_name string, short_name string, category_id long, hs_code string, classified_by string")
    cats = spark.createDataFrame([(1, "X", "")], "category_id long, name string, description string")
    return FrameStore(spark, facts, companies, goods, cats), rows


def test_rollup_hot_company(skewed):
    store, rows = skewed
    got = {r.company_id: (r.total_transactions, r.unique_goods_count) for r in R.company_rollup(store).collect()}
    n1 = sum(1 for r in rows if r[2] == 1)
    g1 = len({r[3] for r in rows if r[2] == 1})
    assert got[1] == (n1, g1)
    assert sum(v[0] for v in got.values()) == len(rows)


def test_top_goods_hot_company(skewed):
    store, rows = skewed
    top = R.company_top_goods(store, k=3).filter(F.col("company_id") == 1).orderBy("rank").collect()
    totals = {}
    for r in rows:
        if r[2] == 1:
            totals[r[3]] = totals.get(r[3], 0) + round(r[5] * 100)
    expect = sorted(totals, key=lambda g: (-totals[g], g))[:3]
    assert [r.goods_id for r in top] == expect


def test_dedup_hot_key(spark):
    # one key repeated 2000 times among 6000 rows
    data = [(i, "HOT" if i % 3 == 0 else f"K{i}", "h") for i in range(6000)]
    df = spark.createDataFrame(data, "pos long, declaration_number string, hs_code string")
    out = D.dedup_in_file(df, ["pos"], ["declaration_number", "hs_code"])
    hot = out.filter(F.col("declaration_number") == "HOT").collect()
    assert len(hot) == 1 and hot[0].pos == 0 and hot[0].occurrences == 2000
    assert out.count() == 4001
    rep = D.duplicate_report(df, ["pos"], ["declaration_number", "hs_code"])
    assert rep.count() == 1999 and rep.agg(F.min("duplicate_count")).first()[0] == 2000


def test_in_file_keys_travel_as_hashes_and_lines_are_joined_once(spark):
    """A line is shuffled with 32 bytes for its key, and the batch's second file does not join the tables again."""
    from tradelens.operators import dedup as D
    from tradelens.plans.catalog import BATCH_ORDER, import_batch
    from tradelens.schema import DEDUP_KEY
    from tradelens.sources.testbed import TestbedStore

    batch = import_batch(TestbedStore(spark, "/root/testdata/sf0.001"))
    plan = batch._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("Relation") == plan.count("Join") + 1 and "Union" not in plan
    for found in (D.dedup_in_file(batch, BATCH_ORDER), D.duplicate_report(batch, BATCH_ORDER)):
        assert "_k0" not in found._jdf.queryExecution().optimizedPlan().toString()

    columns = [*DEDUP_KEY, "at", "note"]
    one = ["D1", "  Co ", "x", "1", "2", "3", "4", "5"]
    rows = [(*one, 2, "b"), (*one, 1, "c"), (*one, 1, "a"), ("D1", "Co", *one[2:], 3, "d"), ("D1", None, *one[2:], 4, "e"), ("D1", "", *one[2:], 5, None), (" ", *one[1:], 0, "f"), (None, *one[1:], 0, "g"), ("D,1", "C\",\"o", *one[2:], 6, "h"), ("D,1", "C", *one[2:], 7, "i")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'int' if c == 'at' else 'string'}" for c in columns))
    got = {(r["at"], r["note"], r["occurrences"]) for r in D.dedup_in_file(df, ["at"]).collect()}
    assert got == {(1, "a", 4), (4, "e", 2), (6, "h", 1), (7, "i", 1)}
    assert D.dedup_in_file(df, ["at"]).columns == [*columns, "occurrences"]
    later = {(r["at"], r["note"], r["duplicate_count"]) for r in D.duplicate_report(df, ["at"]).collect()}
    assert later == {(2, "b", 4), (3, "d", 4), (5, None, 2)}
