"""A store made by ``run_import`` answers every store query, and the import
survives reordered headers, quoted line breaks, skew and replays."""

import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_ingest import BASE, CSV_COLUMNS, write_csv
from tradelens.operators import ingest as I
from tradelens.plans.catalog import STORE_QUERIES
from tradelens.schema import TRANSACTION_SCHEMA
from tradelens.sources.customs_csv import read_customs_csv
from tradelens.sources.store import ParquetStore
from tradelens.sources.testbed import TestbedStore, export_customs_csv


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("imported"))
    testbed = TestbedStore(spark, SF_SMALL)
    export_customs_csv(testbed, f"{root}/csv")
    result = I.run_import(spark, f"{root}/csv", f"{root}/store")
    assert result.accepted

    class Imported(ParquetStore):
        def table(self, name):
            return testbed.table(name)

    return Imported(spark, f"{root}/store")


def test_imported_facts_have_the_schema(imported):
    have = {f.name: f.dataType for f in imported.facts().schema.fields}
    assert [f.name for f in TRANSACTION_SCHEMA.fields if f.name not in have] == []
    assert imported.facts().filter("line_no is null").count() == 0


# the stand-in batch of these queries is made from columns only the driver's tables have
ONLY_TESTBED = {"dedup_in_file", "dedup_report", "dedup_against_table", "existing_declarations", "dedup_summary", "dim_company_new", "dim_goods_new", "import_summary"}
ONLY_TESTBED |= {"import_parsed_cells", "import_issue_counts", "import_quarantine_summary", "import_transactions_page"}


LISTS = ["transactions_page", "transactions_count", "transactions_summary", "company_latest_lines", "company_rollup_page", "goods_rollup_page", "dashboard_stats", "tool_aggregate", "agg_cache", "filter_cnf"]


def test_every_store_query_resolves_on_an_imported_store(imported):
    """Columns and types are checked when a plan is analysed."""
    for name in sorted(set(STORE_QUERIES) - ONLY_TESTBED):
        assert STORE_QUERIES[name](imported).columns, name


@pytest.mark.parametrize("name", LISTS)
def test_lists_run_on_an_imported_store(imported, name):
    assert name in STORE_QUERIES
    STORE_QUERIES[name](imported).limit(3).collect()


def test_columns_bind_by_header_name(spark, tmp_dir):
    src = os.path.join(tmp_dir, "csv")
    os.makedirs(src)
    swapped = list(CSV_COLUMNS)
    i, j = swapped.index("Tên nuớc xuất khẩu"), swapped.index("Chi cục hải quan")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    write_csv(os.path.join(src, "a.csv"), [{"Số tờ khai": "1"}])
    write_csv(os.path.join(src, "b.csv"), [{"Số tờ khai": "2"}], swapped)
    write_csv(os.path.join(src, "c.csv"), [{"Số tờ khai": "3"}], [c for c in CSV_COLUMNS if c != "Tên nước nhập khẩu"])
    rows = read_customs_csv(spark, src).collect()
    assert len(rows) == 3
    assert {(r["Tên nuớc xuất khẩu"], r["Chi cục hải quan"]) for r in rows} == {(BASE["Tên nuớc xuất khẩu"], BASE["Chi cục hải quan"])}
    store = os.path.join(tmp_dir, "store")
    assert I.run_import(spark, src, store).summary.first().imported_rows == 3
    # one file without a required column: the folder is refused
    write_csv(os.path.join(src, "d.csv"), [{}], [c for c in CSV_COLUMNS if c != "HS code"])
    assert not I.run_import(spark, src, os.path.join(tmp_dir, "store2")).accepted


def test_line_breaks_in_cells_are_found(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(";".join(CSV_COLUMNS) + "\n" + ";".join('"CÁ\nTRA"' if c == "Tên hàng" else BASE.get(c, "") for c in CSV_COLUMNS) + "\n")
    rows = read_customs_csv(spark, path).collect()
    assert [r["Tên hàng"] for r in rows] == ["CÁ\nTRA"]


def test_rejected_lines_are_written(spark, tmp_dir):
    path, store = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store")
    write_csv(path, [{}, {"Tháng": "13", "Số tờ khai": "77"}, {"Số Lượng": "x", "Số tờ khai": "78"}])
    I.run_import(spark, path, store, mode="quarantine", import_id="one")
    out = {r.declaration_number: r for r in spark.read.parquet(f"{store}/rejected").collect()}
    assert {n: (r.row, r.issues[0].field) for n, r in out.items()} == {"77": (2, "Tháng"), "78": (3, "Số Lượng")}
    assert out["77"].raw_data["Tháng"] == "13"


def test_stream_keeps_rejected_lines_and_binds_headers(spark, tmp_dir):
    from tradelens.streaming.ingest_stream import start_stream_import

    src, store = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "store")
    os.makedirs(src)
    swapped = list(reversed(CSV_COLUMNS))
    write_csv(os.path.join(src, "a.csv"), [{}, {"Năm": "1800", "Số tờ khai": "9"}], swapped)
    start_stream_import(spark, src, store, os.path.join(tmp_dir, "ckpt")).awaitTermination(120)
    assert spark.read.parquet(f"{store}/transactions").first().customs_office == BASE["Chi cục hải quan"]
    assert [r.declaration_number for r in spark.read.parquet(f"{store}/rejected").collect()] == ["9"]


def test_replay_completes_dimensions(spark, tmp_dir):
    path, store = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store")
    write_csv(path, [{"Số tờ khai": str(n), "Tên Cty nhập khẩu": f"C{n}", "Tên hàng": f"G{n}"} for n in range(5)])
    I.run_import(spark, path, store)
    # a run that was stopped after its facts: the store without its dimensions
    bare = os.path.join(tmp_dir, "bare")
    spark.read.parquet(f"{store}/transactions").write.partitionBy("year", "month").parquet(f"{bare}/transactions")
    again = I.run_import(spark, path, bare).summary.first()
    assert (again.imported_rows, again.new_companies, again.new_goods) == (0, 5, 5)
    assert spark.read.parquet(f"{bare}/companies").count() == 5


def test_url_store(spark, tmp_dir):
    path, store = os.path.join(tmp_dir, "a.csv"), f"file://{tmp_dir}/store"
    write_csv(path, [{}])
    assert I.run_import(spark, path, store).summary.first().imported_rows == 1
    assert I.run_import(spark, path, store).summary.first().duplicates_in_db == 1


def test_one_month_is_written_by_several_tasks(spark, tmp_dir):
    path, store = os.path.join(tmp_dir, "a.csv"), os.path.join(tmp_dir, "store")
    write_csv(path, [{"Số tờ khai": str(n), "Tên Cty nhập khẩu": f"Company {n % 97}"} for n in range(3000)])
    # these rows are too few to be worth more than one task; without the merging of small partitions the split shows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        I.run_import(spark, path, store)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    facts = spark.read.parquet(f"{store}/transactions")
    assert facts.count() == 3000 and facts.select(F.input_file_name()).distinct().count() > 1


def test_constraints_reject_lines():
    assert {f for f in I._REQUIRED_TEXT} <= {f.name for f in TRANSACTION_SCHEMA.fields}
