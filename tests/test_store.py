"""The written Parquet star (S5) answers every star query exactly like the
raw-table testbed it was built from (the bench runs on the written star)."""

import os

import pytest

from tests.conftest import SF_SMALL
from tradelens.plans.catalog import STORE_QUERIES
from tradelens.sources.store import ParquetStore, write_store
from tradelens.sources.testbed import TestbedStore

STAR_QUERIES = [
    "company_rollup", "company_rollup_page", "goods_rollup", "goods_rollup_page", "category_rollup", "dashboard_stats",
    "transactions_page", "tool_aggregate", "agg_cache", "filter_cnf", "dedup_against_table", "company_top_goods",
    "load_profile", "intent_aggregation",
]


@pytest.fixture(scope="module")
def stores(spark):
    import tempfile

    tb = TestbedStore(spark, SF_SMALL)
    root = os.path.join(tempfile.mkdtemp(prefix="tradelens-star-"), "star")
    write_store(tb, root, partitions=4)

    class Star(ParquetStore):
        def table(self, name):
            return tb.table(name)

    return tb, Star(spark, root)


def _rows(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", STAR_QUERIES)
def test_star_matches_testbed(stores, name):
    tb, star = stores
    assert _rows(STORE_QUERIES[name](star)) == _rows(STORE_QUERIES[name](tb))


def test_star_layout(stores):
    _, star = stores
    parts = {os.path.basename(os.path.dirname(p)) for p in star.facts(["year"]).inputFiles()}
    assert all(p.startswith("month=") for p in parts)


def _plan(spark, df):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def _scan(plan, what):
    """The filters of the fact scan, e.g. ``PushedFilters: [...]``."""
    return [line.split(what + ": [")[1] for line in plan.splitlines() if what + ": [" in line and "transactions" in line]


@pytest.mark.parametrize(
    "name,pushed",
    [("tool_count", "EqualTo(transport_mode,O)"), ("tool_sum_field", "EqualTo(customs_office,ASIA)"), ("filter_between", "GreaterThanOrEqual("), ("filter_greater_less", "GreaterThan(")],
)
def test_comparisons_reach_the_scan(spark, stores, name, pushed):
    assert any(pushed in f for f in _scan(_plan(spark, STORE_QUERIES[name](stores[1])), "PushedFilters"))


def test_date_ranges_skip_folders(spark, stores):
    _, star = stores
    for name in ("company_rollup_by_category", "transactions_page", "goods_rollup_filtered"):
        assert any("year#" in f.split("]")[0] for f in _scan(_plan(spark, STORE_QUERIES[name](star)), "PartitionFilters")), name


def test_month_bounds():
    from tradelens.sources.store import month_bounds

    assert month_bounds() is None
    text = str(month_bounds("1996-03-15", "1997-02-01"))
    assert all(x in text for x in ("1996", "1997"))


def test_engine_view_reads_what_the_fields_need(spark, stores):
    from tradelens.operators.engine import engine_view

    tb, _ = stores
    plan = _plan(spark, engine_view(tb, ["quantity"]))
    assert "Join" not in plan and "lineitem.parquet" in plan
    assert set(engine_view(tb).columns) >= {"category_name", "goods_name", "import_company_name"}
    with pytest.raises(ValueError):
        engine_view(tb, ["nothing"])


def test_multi_spec_reads_the_facts_once(spark, stores):
    plan = _plan(spark, STORE_QUERIES["agg_multi_spec"](stores[0]))
    assert plan.count("lineitem.parquet") == 1
