"""Stored roll-up states: merged, they equal a rebuild over all lines."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_concurrent_store import lines
from tests.test_ingest import write_csv
from tradelens.operators import engine as E
from tradelens.operators import enrich as EN
from tradelens.operators import ingest as I
from tradelens.operators import rollup_states as RS
from tradelens.operators import rollups as R
from tradelens.sources.commits import CommitLog
from tradelens.sources.store import ParquetStore, write_store
from tradelens.sources.testbed import TestbedStore

DIMS = ["importCompany", "category", "country", "month", "goods", "total"]


def rows(df):
    return sorted(tuple(r) for r in df.select("dim", "key", "value", "count").collect())


def check_cache(spark, root):
    store = ParquetStore(spark, root)
    want = rows(E.build_cache(E.engine_view(store), extras=True))
    assert rows(RS.stored_cache(store, DIMS)) == want
    return want


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Three imports with overlaps, a null-like country and several months."""
    root = str(tmp_path_factory.mktemp("states") / "store")
    for i, (lo, hi) in enumerate(((0, 30), (20, 50), (45, 70))):
        path = str(tmp_path_factory.mktemp("csv") / f"{i}.csv")
        write_csv(path, lines(lo, hi, **{"Tháng": str(3 * i + 1), "Tên nước nhập khẩu": ["", "VN", "LA"][i], "Trị giá USD": f"{i + 1},25"}))
        I.run_import(spark, path, root)
    return root


def test_merged_states_equal_a_rebuild(spark, store):
    found = check_cache(spark, store)
    assert {r[0] for r in found} == set(DIMS) and ("total", "Total", 186.25, 85) in found
    s = ParquetStore(spark, store)
    merged = RS.merge_states(RS.read_states(spark, store, s.commits)).drop("goods_sketch")
    whole = RS.fact_states(s.facts(RS.STATE_FACTS)).drop("goods_sketch")
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, whole.collect()))


def test_top_n_reads_states_only(spark, store):
    s = ParquetStore(spark, store)
    top = E.cache_top_n(RS.stored_cache(s, ["country"]), "country", 2)
    assert [(r.key, r["count"]) for r in top.collect()] == [("LA", 25), ("VN", 30)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "rollup_states" in plan and "transactions" not in plan
    assert "PartitionFilters: [isnotnull(dim" in plan


def test_categories_follow_the_dimension_and_compaction_changes_nothing(spark, store):
    EN.enrich_store(spark, store, label="rules")
    before = check_cache(spark, store)
    assert ("category", "Other") not in {r[:2] for r in before}
    done = RS.compact_states(spark, store)
    assert done.kind == "states" and done.covers == 4
    assert check_cache(spark, store) == before
    # one folder of states is read now, and imports that follow are added to it
    entries = CommitLog(spark, store).entries()
    assert {f.split("import_id=")[1].split("/")[0] for f in RS.read_states(spark, store, entries).inputFiles()} == {done.write_id}
    path = os.path.join(os.path.dirname(store), "more.csv")
    write_csv(path, lines(60, 90))
    I.run_import(spark, path, store)
    assert check_cache(spark, store) != before
    RS.compact_states(spark, store)
    check_cache(spark, store)


def test_compaction_beside_an_import(spark, store, monkeypatch):
    path, tried, state = os.path.join(os.path.dirname(store), "beside.csv"), CommitLog.try_commit, {"on": True}
    write_csv(path, lines(200, 205))

    def try_commit(self, *args):
        if state.pop("on", False):
            I.run_import(spark, path, store)
        return tried(self, *args)

    monkeypatch.setattr(CommitLog, "try_commit", try_commit)
    done = RS.compact_states(spark, store)
    assert done.covers == done.number - 2
    check_cache(spark, store)


def test_states_of_a_store_written_as_a_whole(spark, tmp_dir):
    root = f"{tmp_dir}/star"
    write_store(TestbedStore(spark, SF_SMALL), root, partitions=4)
    check_cache(spark, root)
    path = f"{tmp_dir}/a.csv"
    write_csv(path, lines(0, 5))
    I.run_import(spark, path, root)
    s = ParquetStore(spark, root)
    assert s.facts().count() == 6005
    states = RS.read_states(spark, root, s.commits)
    assert states.filter("dim = 'total'").agg(F.sum("lines")).first()[0] == 6005
    estimate = {r.company_id: r.unique_goods_estimate for r in RS.company_goods_estimate(states).collect()}
    exact = {r.company_id: r.unique_goods_count for r in R.company_rollup(s).collect()}
    assert set(estimate) >= set(exact) and all(abs(estimate[c] - n) <= max(2, 0.1 * n) for c, n in exact.items())


def test_no_lines_no_states(spark, tmp_dir):
    assert RS.read_states(spark, f"{tmp_dir}/nothing", []) is None
    assert RS.compact_states(spark, f"{tmp_dir}/nothing") is None
