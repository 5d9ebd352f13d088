"""Filters at dictionary grain equal the row-wise filters; seek and indexed
pages equal offset pages on ties and nulls."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tradelens.operators import dictionary_filters as DF
from tradelens.operators import engine as E
from tradelens.operators import filters as FL
from tradelens.operators import listing as L
from tradelens.operators import rollups as R
from tradelens.plans.catalog import CNF_FILTERS, QUERIES
from tradelens.sources.store import FrameStore
from tradelens.sources.testbed import TestbedStore

SCHEMA = "declaration_number string, date timestamp_ntz, import_country string, customs_office string, quantity double, unit string, unit_price_usd double, total_value_usd decimal(28,10), month int, company_id long, goods_id long"


@pytest.fixture(scope="module")
def store(spark):
    """Lines with null and unmatched ids, names in several spellings."""
    from datetime import datetime
    from decimal import Decimal

    rng = random.Random(11)
    offices = ["Hoa Kỳ", "USA", "us", "Việt Nam", "viet nam", None, "", "Hàn Quốc", "Korea"]
    facts = [
        (str(i), datetime(2024, rng.randint(1, 12), 3), rng.choice(offices), rng.choice(offices), rng.choice([None, 1.0, 5.5, 80.0]), "KGM", rng.choice([None, 2.0, 9.0]), rng.choice([None, Decimal(rng.randint(1, 99))]), 1, rng.choice([1, 2, 3, 4, None, 99]), rng.choice([1, 2, 3, 4, None, 98]))
        for i in range(400)
    ]
    companies = [(1, "Công ty ABC", "Hà Nội"), (2, "abc trading", ""), (3, "XYZ", None), (4, "Cong Ty Abd", "HCM")]
    goods = [(1, "Gạo tẻ", 1), (2, "gao te", 2), (3, "Tôm hùm", 1), (4, "Rượu", None)]
    categories = [(1, "Nông sản"), (2, "nong san khac"), (3, "x")]
    return FrameStore(
        spark,
        spark.createDataFrame(facts, SCHEMA),
        spark.createDataFrame(companies, "company_id long, name string, address string"),
        spark.createDataFrame(goods, "goods_id long, raw_name string, category_id long"),
        spark.createDataFrame(categories, "category_id long, name string"),
    )


FIELDS = {
    "import_company_name": ["abc", "Công ty", "cong ty abc", "xyz"], "import_company_address": ["Hà Nội", "hcm", ""], "goods_name": ["gạo", "gao te", "tom", "Rượu"],
    "category_name": ["Nông sản", "khac"], "customs_office": ["USA", "Hoa Kỳ", "korea", "viet"], "import_country": ["US", "Vietnam"],
}


def random_filter(rng):
    if rng.random() < 0.25:
        return {"field": "total_value_usd", "operator": rng.choice(["greaterThan", "lessThan"]), "value": rng.randint(1, 99), "logicalOperator": rng.choice(["AND", "OR"])}
    field = rng.choice(list(FIELDS))
    op = rng.choice(["equals", "contains", "startsWith", "in"])
    value = rng.sample(FIELDS[field], 2) if op == "in" else rng.choice(FIELDS[field])
    return {"field": field, "operator": op, "value": value, "matchStrategy": rng.choice(FL.STRATEGIES), "fuzzyThreshold": rng.randint(0, 3), "logicalOperator": rng.choice(["AND", "OR"])}


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("seed", range(12))
def test_same_rows_as_row_wise_filters(store, seed):
    rng = random.Random(seed)
    filters = [random_filter(rng) for _ in range(rng.randint(1, 4))]
    assert rows(DF.filter_store(store, filters)) == rows(FL.execute_filters(E.engine_view(store), filters)), filters


def test_accents_can_be_told_apart(store):
    for opts in (FL.FilterOptions(remove_diacritics=False), FL.FilterOptions(remove_diacritics=True)):
        filters = [{"field": "goods_name", "operator": "contains", "value": "gạo"}]
        assert rows(DF.filter_store(store, filters, opts)) == rows(FL.execute_filters(E.engine_view(store), filters, opts))


def test_audit_counts_and_samples(store):
    rng = random.Random(3)
    filters = [random_filter(rng) for _ in range(4)]
    fs = [FL.FilterExpression.of(f) for f in filters]
    assert rows(FL.audit_rows(DF.running_counts(store, filters), fs)) == rows(FL.filter_audit(E.engine_view(store), filters))
    found = DF.filter_samples(store, filters, [F.col("declaration_number").cast("int")], ["declaration_number"]).collect()
    for i, f in enumerate(filters):
        want = sorted(int(r.declaration_number) for r in FL.apply_filter(E.engine_view(store), f).collect())[:5]
        assert [int(r.declaration_number) for r in sorted(found, key=lambda r: r["rank"]) if r.iteration == i + 1] == want


def test_unknown_fields_and_empty_lists(store):
    with pytest.raises(FL.FilterValidationError):
        DF.filter_store(store, [{"field": "nothing", "operator": "equals", "value": 1}])
    assert DF.filter_store(store, []).count() == 400


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_matched_on_the_dictionary(spark):
    """No edit distance or normalising above the fact scan: both sit on the goods side of a semi-join."""
    s = TestbedStore(spark, SF_SMALL)
    fuzzy = plan(DF.filter_store(s, [{"field": "goods_name", "operator": "contains", "value": "smal rng", "matchStrategy": "fuzzy"}]))
    lines = fuzzy.splitlines()
    (at,) = [i for i, line in enumerate(lines) if "levenshtein" in line]
    below = next(line for line in lines[at:] if "Relation" in line)
    assert "LeftSemi" in fuzzy and "p_name" in below and "l_orderkey" not in below
    cnf = plan(DF.filter_store(s, CNF_FILTERS))
    assert "regexp" not in cnf  # the offices that pass are a list of values


def test_a_field_with_many_passing_values_is_matched_by_line(store, monkeypatch):
    monkeypatch.setattr(DF, "LIST_VALUES", 1)
    filters = [{"field": "customs_office", "operator": "contains", "value": "us", "logicalOperator": "OR"}, {"field": "import_country", "operator": "equals", "value": "Vietnam"}]
    assert rows(DF.filter_store(store, filters)) == rows(FL.execute_filters(E.engine_view(store), filters))


# ---------------------------------------------------------------- paging


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "É", ""]), i) for i in range(307)]
    return spark.createDataFrame(data, "v int, s string, id long").repartition(5)


SORTS = [[("v", True)], [("v", False)], [("s", True), ("v", False)], [("s", False), ("v", True)], [("id", False)]]


@pytest.mark.parametrize("sort", SORTS)
def test_seek_pages_equal_offset_pages(items, sort):
    order = L.order_columns(sort, ["id"])
    want = [tuple(r) for r in items.orderBy(*order).collect()]
    last, got = None, []
    for _ in range(8):
        page = L.seek_page(items, sort, ["id"], 40, last).collect()
        got += [tuple(r) for r in page]
        last = page[-1].asDict() if page else last
    assert got == want


@pytest.mark.parametrize("every", [1, 3])
def test_indexed_pages_equal_offset_pages(items, every):
    for sort in SORTS[:4]:
        index = L.page_index(items, sort, ["id"], 20, every)
        assert index.starts.count() == -(-16 // every)
        for page in (1, 2, 8, 15, 16, 17, 40):
            want = L.paginate(items, L.order_columns(sort, ["id"]), page, 20).collect()
            assert [tuple(r) for r in index.page(items, page).collect()] == [tuple(r) for r in want], (sort, page)


def test_deep_pages_keep_one_page_a_task(spark, items):
    index = L.page_index(items, [("id", True)], [], 10)
    text = index.page(items, 30)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in text and ">= 290" in text  # the bound is a bare comparison
    assert L.page_index(items.limit(0), [("id", True)], [], 10).page(items.limit(0), 1).collect() == []


def test_transaction_pages(spark):
    s = TestbedStore(spark, SF_SMALL)
    filters = {"date_from": "1995-01-01"}
    index = R.transactions_index(s, page_size=40, sort_by="companyName", ascending=True, **filters)
    for page in (1, 7, 60):
        want = R.transactions_page(s, page=page, page_size=40, sort_by="companyName", ascending=True, **filters).collect()
        assert R.transactions_indexed_page(s, index, page, **filters).collect() == want


def test_top_export_countries(spark):
    s = TestbedStore(spark, SF_SMALL)
    got = {r.company_id: [(e.country, e.transaction_count) for e in r.top_export_countries] for r in R.company_top_export_countries(s, k=2).collect()}
    from collections import Counter, defaultdict

    counts = defaultdict(Counter)
    for r in s.facts(["company_id", "export_country"]).collect():
        counts[r.company_id][r.export_country] += 1
    assert got == {c: sorted(n.items(), key=lambda x: (-x[1], x[0]))[:2] for c, n in counts.items()}
    scans = R.company_export_countries(s)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in scans


def test_company_searches_against_brute_force(store):
    names = {r.company_id: r.name for r in store.companies().collect()}
    texts = ["ab", "ABC", "công", "cong ty abd", "x", "", None, "zz", "y", "yz", "ty", "ab"]
    searches = store.spark.createDataFrame([(t,) for t in texts], "search string")
    got = [(r.search, r["rank"], r.company_id) for r in R.company_searches(store, searches, k=2).collect()]
    want = []
    for t in {t.lower() for t in texts if t and len(t) >= 2}:
        hits = sorted((n, i) for i, n in names.items() if t in n.lower())[:2]
        want += [(t, at + 1, i) for at, (_, i) in enumerate(hits)]
    assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        R.company_searches(store, searches, min_length=1)


def test_company_searches_deal_out_the_names(store, spark, monkeypatch):
    texts = ["ab", "công ty", "ty", "cong ty abd", "zz"]
    searches = spark.createDataFrame([(t,) for t in texts], "search string")
    found = R.company_searches(store, searches, k=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    assert re.search(rf"hashpartitioning\(company_id#\d+L?, name#\d+, {tasks}\), REPARTITION_BY_NUM", plan), plan
    assert "Inner, BuildRight, Contains(" in plan  # the texts are sent, not the names' pairs
    monkeypatch.setattr(R, "SEARCHES_SENT", 2)  # more texts than that: dealt out by pair and slice
    many = R.company_searches(store, searches, k=3)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[_pair#\d+, _slice#\d+\]", plan) and "BuildLeft" not in plan
    rows = sorted(map(tuple, found.collect()))
    assert rows and sorted(map(tuple, many.collect())) == rows


@pytest.mark.parametrize("fields", [None, ["quantity", "goods_name"], ["category_name", "import_company_name"], ["quantity", "unit"]])
def test_goods_first_view_has_the_same_rows(store, spark, fields):
    names = spark.createDataFrame([(1, "Gạo tẻ", 1), (1, "Gạo tẻ", 1), (2, None, 2), (3, "Tôm hùm", None), (None, "x", 1)], "goods_id long, raw_name string, category_id long")
    twice = FrameStore(spark, store.transactions, store.companies_df, names, store.categories_df.union(store.categories_df.limit(1)))
    for s in (store, twice, TestbedStore(spark, SF_SMALL)):
        want, got = E.engine_view(s, fields), E.engine_view(s, fields, goods_first=True)
        assert got.dtypes == want.dtypes
        assert rows(got) == rows(want)


def test_filter_single_shuffles_only_the_lines_it_keeps(spark):
    """The lines that fail the filter on the goods meet no other table."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["filter_single"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = re.findall(r"SortMergeJoin \[(\w+)#\d+L?\], \[(\w+)#\d+L?\], (\w+)", plan)  # the outermost first
    order = [(left, kind) for left, _, kind in joins]
    assert order.index(("l_orderkey", "LeftOuter")) < min(i for i, (_, kind) in enumerate(order) if kind == "Inner"), joins
