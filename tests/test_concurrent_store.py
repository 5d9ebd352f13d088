"""Store commits: overlapping imports and enrichment give the rows of one
after the other, a stopped write leaves nothing behind that counts, and an
import opens only the key files its declaration numbers fall into."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tests.test_ingest import write_csv
from tradelens.operators import dedup as D
from tradelens.operators import enrich as EN
from tradelens.operators import ingest as I
from tradelens.sources.commits import LOG, CommitLog, create_exclusive, last_number
from tradelens.sources.store import ParquetStore, read_store

TABLES = ("transactions", "companies", "goods", "categories")
KEYS = {"transactions": ["declaration_number", "goods_raw_name", "total_value_usd"], "companies": ["company_id"], "goods": ["goods_id"], "categories": ["category_id"]}


def lines(lo, hi, **more):
    return [{"Số tờ khai": str(n), "Tên Cty nhập khẩu": f"C{n % 7}", "Tên hàng": f"Gạo {n % 11}", **more} for n in range(lo, hi)]


def plan(spark, path, root):
    """An import up to the point where it has looked at the store."""
    log = CommitLog(spark, root)
    entries = log.entries()
    ex = read_store(spark, root, entries)
    rows, counts = I.stage_rows(I.read_customs_csv(spark, path, row_numbers=False))
    result = I.plan_import(spark, rows, None, ex["companies"], ex["goods"], ex["categories"], known_keys=I.key_index(spark, root, entries), row_counts=counts)
    return result, last_number(entries)


def contents(spark, root):
    found = read_store(spark, root, CommitLog(spark, root).entries())
    return {t: sorted(tuple(r) for r in found[t].select(*KEYS[t]).collect()) for t in TABLES}


def check_unique(got):
    for t, rows in got.items():
        assert len(rows) == len(set(rows)), t


def test_overlapping_imports_give_the_rows_of_one(spark, tmp_dir):
    a, b, both = (os.path.join(tmp_dir, n) for n in ("a.csv", "b.csv", "both.csv"))
    write_csv(a, lines(0, 40))
    write_csv(b, lines(20, 60))
    write_csv(both, lines(0, 60))
    root, one = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "one")
    I.run_import(spark, both, one)
    # each looks at the empty store before the other writes
    first, seen_a = plan(spark, a, root)
    second, seen_b = plan(spark, b, root)
    assert seen_a == seen_b == 0
    done_a = I.append_import(first, root, "a", seen_a)
    done_b = I.append_import(second, root, "b", seen_b)
    got = contents(spark, root)
    check_unique(got)
    assert got == contents(spark, one)
    assert (done_a.counts["imported_rows"], done_b.counts["imported_rows"], done_b.counts["duplicates_in_db"]) == (40, 20, 20)
    assert done_b.counts["new_companies"] == 0 and done_b.counts["existing_goods_reused"] >= 11 - done_b.counts["new_goods"]
    store = ParquetStore(spark, root)
    joined = store.facts(["company_id", "goods_id"]).join(store.companies(), "company_id").join(store.goods(), "goods_id")
    assert joined.count() == 60


@pytest.mark.parametrize("step", range(7))
def test_interleaved_at_each_write(spark, tmp_dir, monkeypatch, step):
    """The other import runs whole before the n-th write of this one (6: between its last write and its commit)."""
    a, b = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "b.csv")
    write_csv(a, lines(0, 12))
    write_csv(b, lines(6, 18))
    root = os.path.join(tmp_dir, "store")
    from pyspark.sql.readwriter import DataFrameWriter

    plain, state = DataFrameWriter.parquet, {"n": 0, "on": False}

    def other():
        state["on"] = False
        I.run_import(spark, b, root, import_id="other")

    def parquet(self, path, *args, **kw):
        if state["on"] and path.startswith(root):
            if state["n"] == step:
                other()
            state["n"] += 1
        return plain(self, path, *args, **kw)

    tried = CommitLog.try_commit

    def try_commit(self, *args):
        if state["on"] and step == 6:
            other()
        return tried(self, *args)

    result, seen = plan(spark, a, root)
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(CommitLog, "try_commit", try_commit)
    state["on"] = True
    I.append_import(result, root, "this", seen)
    assert not state["on"]
    got = contents(spark, root)
    check_unique(got)
    assert len(got["transactions"]) == 18 and len(got["companies"]) == 7 and len(got["goods"]) == 11 and len(got["categories"]) == 1
    assert [c.import_id for c in CommitLog(spark, root).entries()] == ["other", "this"]


def test_imports_at_the_same_time(spark, tmp_dir):
    root, errors = os.path.join(tmp_dir, "store"), []
    paths = []
    for i in range(4):
        paths.append(os.path.join(tmp_dir, f"{i}.csv"))
        write_csv(paths[-1], lines(i * 10, i * 10 + 20))

    def work(path):
        try:
            I.run_import(spark, path, root)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(p,)) for p in paths]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []
    got = contents(spark, root)
    check_unique(got)
    assert len(got["transactions"]) == 50 and len(CommitLog(spark, root).entries()) == 4


def test_a_name_is_taken_once(spark, tmp_dir):
    taken = []

    def take(i):
        if create_exclusive(spark, f"{tmp_dir}/{LOG}/000000000001.json", str(i)):
            taken.append(i)

    threads = [threading.Thread(target=take, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(taken) == 1
    assert open(f"{tmp_dir}/{LOG}/000000000001.json").read() == str(taken[0])
    assert [n for n in os.listdir(f"{tmp_dir}/{LOG}") if not n.endswith(".crc")] == ["000000000001.json"]


def test_a_stopped_import_does_not_count(spark, tmp_dir, monkeypatch):
    path, root = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store")
    write_csv(path, lines(0, 5))
    I.run_import(spark, path, root)
    write_csv(path, lines(0, 9))

    def stop(self, *args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "try_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            I.run_import(spark, path, root)
    assert len(contents(spark, root)["transactions"]) == 5
    assert I.run_import(spark, path, root).counts["imported_rows"] == 4
    got = contents(spark, root)
    check_unique(got)
    assert len(got["transactions"]) == 9


def test_import_into_a_store_written_as_a_whole(spark, tmp_dir):
    path, root, whole = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "whole")
    write_csv(path, lines(0, 10))
    I.run_import(spark, path, root)
    store = ParquetStore(spark, root)
    from tradelens.sources.store import write_store

    write_store(store, whole, partitions=2)
    assert I.run_import(spark, path, whole).counts["duplicates_in_db"] == 10
    write_csv(path, lines(5, 15))
    assert I.run_import(spark, path, whole).counts["imported_rows"] == 5
    got = contents(spark, whole)
    check_unique(got)
    assert len(got["transactions"]) == 15


def test_enrichment_beside_an_import(spark, tmp_dir, monkeypatch):
    """Goods that an import adds while the job runs stay, and the job's categories are not doubled."""
    a, b, root = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "b.csv"), os.path.join(tmp_dir, "store")
    write_csv(a, lines(0, 5))
    write_csv(b, [{"Số tờ khai": "99", "Tên hàng": "Tôm hùm"}])
    I.run_import(spark, a, root)
    state, tried = {"on": True}, CommitLog.try_commit

    def try_commit(self, *args):
        if state.pop("on", False):
            I.run_import(spark, b, root)
        return tried(self, *args)

    monkeypatch.setattr(CommitLog, "try_commit", try_commit)
    done = EN.enrich_store(spark, root, label="rules")
    assert (done.processed, done.failed) == (5, 0)
    got = contents(spark, root)
    check_unique(got)
    goods = {r.raw_name: r.classified_by for r in ParquetStore(spark, root).goods().collect()}
    assert goods == {**{f"Gạo {n}": "rules" for n in range(5)}, "Tôm hùm": "fallback"}
    assert EN.enrich_store(spark, root, label="later").processed == 1
    assert ParquetStore(spark, root).goods().filter("classified_by = 'later'").count() == 1


def test_enrichment_in_lots_does_not_ask_again(spark, tmp_dir):
    path, root, asked = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "asked")
    write_csv(path, lines(0, 11))
    I.run_import(spark, path, root)
    os.makedirs(asked)

    def model(name, folder=asked):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
            f.write(name)
        return '{"category": "Nông sản", "confidence": 0.9}'

    first = EN.enrich_store(spark, root, commit_every=4, batch_limit=4, classifier=EN.model_classifier(model), label="model")
    assert (first.processed, len(os.listdir(asked))) == (4, 4)
    rest = EN.enrich_store(spark, root, commit_every=4, classifier=EN.model_classifier(model), label="model")
    assert (rest.processed, len(os.listdir(asked))) == (7, 11)
    goods = ParquetStore(spark, root).goods()
    assert goods.count() == 11 and goods.filter("classified_by = 'model'").count() == 11
    assert [c.kind for c in CommitLog(spark, root).entries()] == ["import", "update", "update", "update"]


def test_a_stopped_enrichment_does_not_ask_again(spark, tmp_dir, monkeypatch):
    """Stopped between the model's answers and the commit; failures are asked about again."""
    path, root, asked = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "asked")
    write_csv(path, lines(0, 6))
    I.run_import(spark, path, root)
    os.makedirs(asked)

    def model(name, folder=asked):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
            f.write(name)
        if name.endswith("3"):
            raise RuntimeError("down")
        return '{"category": "Nông sản", "confidence": 0.9}'

    def stop(self, *args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "try_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            EN.enrich_store(spark, root, classifier=EN.model_classifier(model), label="model")
    assert len(os.listdir(asked)) == 6
    done = EN.enrich_store(spark, root, classifier=EN.model_classifier(model), label="model")
    assert (done.processed, done.succeeded, done.failed, len(os.listdir(asked))) == (6, 5, 1, 7)
    # another label is another model
    assert EN.enrich_store(spark, root, label="rules", retry_failed=True).processed == 1


def test_readers_keep_the_state_they_opened(spark, tmp_dir):
    path, root = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store")
    write_csv(path, lines(0, 5))
    I.run_import(spark, path, root)
    before = ParquetStore(spark, root)
    write_csv(path, lines(5, 9))
    I.run_import(spark, path, root)
    assert (before.facts().count(), ParquetStore(spark, root).facts().count()) == (5, 9)


# ---------------------------------------------------------------- key index


def test_import_opens_the_files_of_its_declarations(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(D, "LINES_PER_BUCKET", 20)
    path, root = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store")
    write_csv(path, lines(0, 1200))
    I.run_import(spark, path, root)
    entries = CommitLog(spark, root).entries()
    stored = I.read_writes(spark, root, "line_keys", entries)
    assert {r[0] for r in stored.select("buckets").distinct().collect()} == {64}
    write_csv(path, lines(1198, 1203))
    rows, _ = I.stage_rows(I.read_customs_csv(spark, path, row_numbers=False))
    typed = I.to_facts(I.with_source_row(rows.drop("_issues")))
    keys = I.key_index(spark, root, entries)(typed)
    touched = D.touched_buckets(typed)
    assert len(touched) <= 5
    opened = {r[0] for r in keys.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(opened) <= 5 < len(stored.inputFiles()) / 8
    plan_text = keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan_text and "transactions" not in plan_text  # no stored line is read
    done = I.run_import(spark, path, root)
    assert (done.counts["duplicates_in_db"], done.counts["imported_rows"]) == (2, 3)


def test_index_of_several_sizes(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(D, "LINES_PER_BUCKET", 10)
    path, root = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store")
    for lo, hi in ((0, 5), (5, 105), (0, 105), (50, 300)):
        write_csv(path, lines(lo, hi))
        I.run_import(spark, path, root)
    sizes = {r[0] for r in I.read_writes(spark, root, "line_keys", CommitLog(spark, root).entries()).select("buckets").distinct().collect()}
    assert sizes == {1, 16, 32}
    got = contents(spark, root)
    check_unique(got)
    assert len(got["transactions"]) == 300


def test_keys_tell_null_from_empty_and_compare_amounts(spark):
    cols = "declaration_number, hs_code, goods_raw_name, import_company_raw_name, total_value_usd, usd_rate, payment_method, delivery_terms".split(", ")
    assert sorted(cols) == sorted(D.DEDUP_KEY)
    schema = ", ".join(f"{c} {'decimal(28,10)' if c in D._AMOUNTS else 'string'}" for c in cols)
    from decimal import Decimal

    rows = [("1", "2", "", "x", Decimal("30"), Decimal("1"), None, "FOB"), ("1", "2", None, "x", Decimal("30.00"), Decimal("1"), None, "FOB"), ("1", "2", "", "x", Decimal("30.000"), Decimal("1"), None, "FOB"), ("12", "", "", "x", Decimal("30"), Decimal("1"), None, "FOB")]
    df = spark.createDataFrame(rows, schema)
    found = [bytes(r[0]) for r in df.select(D.line_key()).collect()]
    assert found[0] == found[2] and len(set(found)) == 3
    doubles = df.withColumns({c: F.col(c).cast("double") for c in D._AMOUNTS})
    assert [bytes(r[0]) for r in doubles.select(D.line_key()).collect()] == found


# ---------------------------------------------------------------- de-dup within the file


def test_first_by_row_with_a_hot_key(spark):
    from tradelens.schema import DEDUP_CSV_KEY

    base = ["7"] + ["k"] * (len(DEDUP_CSV_KEY) - 1)
    rows = [(i, *(base if i % 3 else [str(i // 9), *base[1:]]), f"cell {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, ["_row", *DEDUP_CSV_KEY, "other"]).withColumn("_row", F.col("_row").cast("long")).repartition(9)
    out = D.first_by_row(df, "_row", DEDUP_CSV_KEY)
    seen, want = set(), []
    for r in rows:
        if r[1] not in seen:
            seen.add(r[1])
            want.append((r[0], r[-1]))
    assert sorted((r["_row"], r.other) for r in out.collect()) == want
    text = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_first_by_row_drops_lines_without_a_declaration(spark):
    from tradelens.schema import DEDUP_CSV_KEY

    rows = [(i, v, *["k"] * (len(DEDUP_CSV_KEY) - 1)) for i, v in enumerate([None, "", "  ", " 1", "1 "])]
    df = spark.createDataFrame(rows, "_row long, " + ", ".join(f"`{c}` string" for c in DEDUP_CSV_KEY))
    assert [r["_row"] for r in D.first_by_row(df, "_row", DEDUP_CSV_KEY).collect()] == [3]


def test_new_goods_classified_on_import(spark, tmp_dir):
    path, root = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store")
    for lo, hi, new in ((0, 4, 4), (2, 7, 3)):
        write_csv(path, lines(lo, hi))
        done = I.run_import(spark, path, root, classifier=EN.rule_classifier)
        assert (done.counts["new_goods"], done.counts["new_goods_classified"]) == (new, new)
    store = ParquetStore(spark, root)
    assert store.goods_with_category().groupBy("category", "classified_by").count().collect() == [("Nông sản", "rules", 7)]
    check_unique(contents(spark, root))
    assert EN.enrich_store(spark, root).processed == 0


def test_counts_come_from_the_writes(spark, tmp_dir):
    path, root = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store")
    write_csv(path, [*lines(0, 6), *lines(0, 3), {"Tháng": "13"}])
    first = I.run_import(spark, path, root, mode="quarantine", max_errors=1)
    assert first.counts == {"total_rows": 10, "valid_rows": 9, "invalid_rows": 1, "duplicates_in_file": 3, "duplicates_in_db": 0, "imported_rows": 6, "new_companies": 6, "new_goods": 6, "existing_goods_reused": 0, "new_goods_classified": 0}
    assert [(r.row, r.declaration_number, r.field) for r in I.import_errors(first).collect()] == [(10, "306709194540", "Tháng")]
    write_csv(path, [*lines(0, 8), {"Tháng": "13"}, {"Năm": "x"}])
    refused = I.run_import(spark, path, root, mode="quarantine", max_errors=1)
    assert not refused.accepted and refused.counts["imported_rows"] == 0 and len(contents(spark, root)["transactions"]) == 6
