"""What the import queries shuffle and write per line: each text once, no row for a join of few rows."""

import glob
import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_import_cost import _lines
from tradelens.operators import dedup as D
from tradelens.operators import ingest as I
from tradelens.operators import rollups as R
from tradelens.plans import catalog as C
from tradelens.schema import CSV_COLUMNS, DEDUP_KEY
from tradelens.session import stage_table
from tradelens.sources.customs_csv import read_customs_csv, write_csv
from tradelens.sources.store import FrameStore
from tradelens.sources.testbed import TestbedStore

EXCHANGE = "Exchange hashpartitioning"


def _plan(df, static=True) -> str:
    """The physical plan, with joins as for tables too large to be broadcast."""
    conf = df.sparkSession.conf
    old = {k: conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("false", "-1")):
        conf.set(k, v)
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            conf.set(k, v)


def _good_lines(spark, n=20):
    rows = _lines(spark, n).withColumns({"Trị giá USD": F.lit("5"), "Điều kiện giao hàng": F.lit("FOB")})
    return rows.withColumns({c: F.lit("1,5") for c in I.NUMERIC_CSV_COLUMNS})


def test_staged_lines_hold_each_text_once(spark):
    rows = _good_lines(spark).withColumn("Tên hàng", F.lit("  Tôm "))
    r = I.plan_import(spark, rows, None, None, None, None, mode="quarantine")
    assert not {*I.TEXT_FACTS, "company_id", "goods_id", "key_id"} & {*r.lines.columns}
    want = I.to_facts(rows).drop("created_at").withColumn("key_id", D.line_key())
    got = r.new_facts
    assert {*got.columns} == {*want.columns, "created_at"}
    as_text = lambda df: sorted(str(x) for x in df.select(*want.columns).collect())
    assert as_text(got) == as_text(want)


def test_appended_lines_are_shuffled_without_the_map(spark, tmp_dir, monkeypatch):
    r = I.plan_import(spark, _good_lines(spark), None, None, None, None, mode="quarantine")
    seen = []
    keep = I._with_raw_map
    monkeypatch.setattr(I, "_with_raw_map", lambda df: seen.append(df) or keep(df))
    I.append_import(r, tmp_dir, "one")
    below = seen[0]._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rebalance" in below and " map(" not in below  # the map is made above the shuffle
    stored = spark.read.parquet(f"{tmp_dir}/transactions")
    assert stored.count() == 20 and stored.first().raw_data["Đơn vị tính"].startswith("c")
    assert stored.filter(F.col("goods_id") != F.xxhash64("goods_raw_name")).count() == 0


def test_rejected_lines_are_counted_and_not_staged_again(spark):
    rows = _good_lines(spark).withColumn("Tháng", F.when(F.col("source_row") % 4 == 0, "13").otherwise("2"))
    rows = rows.withColumn("Mã phương thức thanh toán", F.when(F.col("source_row") == 1, F.lit("x")).otherwise("LC"))
    r = I.plan_import(spark, rows, None, None, None, None, mode="quarantine")
    assert (r.counts["invalid_rows"], r.rejected.count(), I.import_errors(r).count()) == (5, 5, 5)
    assert not any("import-rejected" in f for f in r.rejected.inputFiles())
    refused = I.plan_import(spark, rows, None, None, None, None, mode="strict")
    assert not refused.accepted and refused.counts["invalid_rows"] == refused.rejected.count() == 20


def test_marks_find_repeated_lines_and_whole_keys_decide(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 3), ("c", "z", 4)], "k string, v string, n long")
    marks = D.repeated_keys(df, ["k", "v"])
    assert marks.dtypes == [("_mark", "bigint")] and marks.count() == 1
    # a mark that other keys share only sends them to the exact comparison
    shared = stage_table(df.select(F.xxhash64("k", "v").alias("_mark")).distinct(), "marks")
    assert sorted(r.n for r in D.first_of_repeated(df, shared, ["n"], ["k", "v"]).collect()) == [1, 3, 4]


def test_csv_is_read_back_compressed_and_numbered_without_a_shuffle_of_its_lines(spark, tmp_dir):
    cells = _good_lines(spark, 50).select(*CSV_COLUMNS).withColumn("Tên hàng", F.concat(F.lit('"t;\n'), "Tên hàng"))
    write_csv(cells.repartition(3), f"{tmp_dir}/a", compression="gzip")
    names = glob.glob(f"{tmp_dir}/a/part-*")
    assert names and all(n.endswith(".csv.gz") for n in names)
    rows = read_customs_csv(spark, f"{tmp_dir}/a")
    assert sorted(map(str, rows.select(*CSV_COLUMNS).collect())) == sorted(map(str, cells.collect()))
    for file in rows.select("_src_file", "source_row").groupBy("_src_file").agg(F.sort_array(F.collect_list("source_row")).alias("n")).collect():
        assert file.n == list(range(1, len(file.n) + 1))
    plan = _plan(rows)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    write_csv(cells, f"{tmp_dir}/b")
    assert not glob.glob(f"{tmp_dir}/b/*.gz")


def test_csv_queries_write_compressed_files(spark):
    base = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    for name in ("csv_round_trip", "csv_dry_run"):
        before = {*glob.glob(f"{base}/csv-*")}
        C.QUERIES[name](spark, SF_SMALL)
        (made,) = {*glob.glob(f"{base}/csv-*")} - before
        parts = [f for f in os.listdir(made) if f.startswith("part-")]
        assert parts and all(f.endswith(".csv.gz") for f in parts), name


def test_import_facts_are_the_facts_and_customers_meet_the_orders(spark, tmp_dir):
    """Keys without a match, null keys and repeated keys give the same rows in either order of joins."""
    def table(name, schema, *rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_dir}/{name}.parquet")

    day = "1998-01-02 00:00:00"
    line = lambda o, p, n: (o, p, 1, n, 2.0, 10.55, 0.05, 0.01, "A", "O", day)
    table("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string",
          line(1, 1, 1), line(1, 9, 2), line(2, None, 3), line(None, 1, 4), line(3, 2, 5), line(4, 2, 6))
    table("orders", "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string", (1, 1, "HIGH", day), (2, None, None, day), (3, 7, "LOW", day), (3, 1, "LOW2", day), (None, 1, "none", day))
    table("customer", "c_custkey long, c_name string, c_mktsegment string, c_nationkey int", (1, "Co", "M", 1), (1, "Co twice", "M", None), (None, "nobody", "M", 1))
    table("part", "p_partkey long, p_name string, p_brand string, p_size int", (1, "ring", "B", 3), (2, None, None, None), (2, "bolt", "C", 4))
    columns = [c for c in C.BATCH_COLUMNS if c != "date"]
    store = TestbedStore(spark, tmp_dir)
    same, other = store.import_facts(columns), store.facts(columns)
    assert same.dtypes == other.dtypes
    assert sorted(map(str, same.collect())) == sorted(map(str, other.collect())) and same.count() > 6
    plan = _plan(store.import_facts(["declaration_number", "import_company_raw_name", "goods_raw_name"]))
    assert plan.count("(l_orderkey") and "hashpartitioning(o_custkey" in plan
    # the lines are shuffled for goods and orders, not for customers
    assert plan.count("hashpartitioning(l_") == 2


def test_a_page_of_lines_is_taken_before_the_dimensions_are_joined(spark):
    facts = spark.createDataFrame([(f"D{i}", i % 3, i % 4 or None, i % 5 or None, float(i % 7) if i % 6 else None) for i in range(60)], "declaration_number string, line_no int, company_id long, goods_id long, v double").select(
        "*", F.col("v").cast("decimal(18,2)").alias("total_value_usd"), F.col("v").cast("decimal(18,2)").alias("quantity"), F.col("v").alias("unit_price_usd"), F.lit("2024-01-01").cast("timestamp_ntz").alias("date"),
        *[F.lit("x").alias(c) for c in ("hs_code", "unit", "export_country", "import_country", "customs_office")])
    companies = spark.createDataFrame([(1, "A", ""), (2, "B", ""), (2, "B again", "")], "company_id long, name string, address string")
    goods = spark.createDataFrame([(1, "G", "G", 1), (2, "H", "H", None), (3, "I", "I", 2)], "goods_id long, raw_name string, short_name string, category_id long")
    store = FrameStore(spark, facts, companies, goods, spark.createDataFrame([(1, "X", "")], "category_id long, name string, description string"))
    for sort, asc in (("totalValueUSD", False), ("totalValueUSD", True), ("unitPriceUSD", True), ("date", True)):
        whole = R.transactions_view(store).orderBy(*R.order_columns([(R.TRANSACTION_SORTS[sort], asc)], [*R.TX_TIE_BREAK, "company_name"])).collect()
        for page in (1, 2, 5):
            got = R.transactions_page(store, page=page, page_size=10, sort_by=sort, ascending=asc).collect()
            assert [r.declaration_number for r in got] == [r.declaration_number for r in whole[page * 10 - 10 : page * 10]], (sort, asc, page)
    plan = _plan(R.transactions_page(store, page_size=10, sort_by="totalValueUSD"))
    assert plan.count("TakeOrderedAndProject") == 2
    assert plan.rindex("TakeOrderedAndProject") > plan.index("Join")
    named = R.transactions_page(store, page_size=10, sort_by="totalValueUSD", company="^B")
    assert {r.company_name for r in named.collect()} == {"B", "B again"} and _plan(named).count("TakeOrderedAndProject") == 1


def _batch(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in DEDUP_KEY[:4]) + ", v double, u double, payment_method string, delivery_terms string, at int").select(
        *DEDUP_KEY[:4], F.col("v").cast("decimal(18,2)").alias(DEDUP_KEY[4]), F.col("u").cast("decimal(18,6)").alias(DEDUP_KEY[5]), *DEDUP_KEY[6:], "at")


def test_lines_are_marked_where_deduplication_left_them(spark):
    """The rows of the old comparison, with nulls, blanks and keys stored more than once, and no second shuffle of a row."""
    one = lambda d, name="g", v=1.0, at=1: (d, "h", name, "Co", v, None, "LC", "FOB", at)
    batch = _batch(spark, [one("1"), one("1", at=2), one(" 1", at=0), one("2"), one("3", None), one("4", ""), one("5", v=None), one("6", v=2.5), one(None), one("  ")])
    stored = _batch(spark, [one("1"), one("1"), one("1 "), one("2", " g"), one("2", "g "), one("3", ""), one("4", ""), one("5", v=None), one("6", v=2.51), one(None)])
    plain = D.dedup_in_file(batch, ["at"], DEDUP_KEY).drop("occurrences")
    keyed = D.dedup_in_file(batch, ["at"], DEDUP_KEY, keep_key=True).drop("occurrences")
    assert "_key" in keyed.columns and "_key" not in plain.columns
    rows = lambda df: sorted(map(str, df.collect()))
    old, new = D.mark_against_table(plain, stored), D.mark_against_table(keyed, stored)
    assert new.columns == old.columns and rows(new) == rows(old)
    assert {r.declaration_number.strip(): r.status for r in new.collect()} == {"1": "new", "2": "new", "3": "new", "4": "existing", "5": "existing", "6": "new"}
    for a, b in zip(D.split_against_table(plain, stored), D.split_against_table(keyed, stored)):
        assert a.columns == b.columns and rows(a) == rows(b)
    assert _plan(old).count(EXCHANGE) > _plan(new).count(EXCHANGE) == 2
    # amounts of another type may be equal once parsed and not as text: compared by the parsed key alone
    floats = stored.withColumn("total_value_usd", F.col("total_value_usd").cast("double"))
    assert rows(D.mark_against_table(keyed, floats)) == rows(D.mark_against_table(plain, floats))


def test_queries_that_read_the_batch_twice_join_it_once(spark):
    for name in ("dedup_report", "dedup_against_table", "dim_goods_new", "import_summary"):
        files = C.QUERIES[name](spark, SF_SMALL).inputFiles()
        assert files and not any("lineitem" in f for f in files), name


def test_in_file_keys_are_16_bytes_and_keep_cells_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", "b:c"), ("a", None), ("a", ""), (" a ", "bc")], "k string, v string")
    keys = [bytes(r[0]) for r in df.select(D._key_hash(["k", "v"])).collect()]
    assert {len(k) for k in keys} == {16}
    assert len({*keys}) == 4 and keys[3] == keys[4] and keys[0] == keys[5]
