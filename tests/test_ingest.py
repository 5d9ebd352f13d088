"""CSV import: de-duplication (FIXTURES.md §2.1), validation (§2.2),
idempotent re-import, dry run and the streaming import (T1)."""

import os

from pyspark.sql import functions as F

from tradelens.operators import ingest as I
from tradelens.schema import CSV_COLUMNS
from tradelens.sources.customs_csv import read_customs_csv

BASE = {
    "Năm": "2024", "Tháng": "9", "Ngày": "9/2/24", "Tên Cty nhập khẩu": "MV CAPE", "Địa chỉ Cty nhập khẩu": "",
    "HS code": "03023400", "Tên hàng": "CÁ NGỪ#&VN", "Thuế suất XNK": "0", "Đơn vị tính": "KGM", "Số Lượng": "1.000",
    "Đơn giá Nguyên tệ": "3,5", "Đơn giá khai báo(USD)": "3,5", "Trị giá USD": "30", "Nguyên tệ": "USD",
    "Tỷ giá nguyên tệ": "1", "Tỷ giá USD": "24.410,00", "Mã phương thức thanh toán": "KC",
    "Điều kiện giao hàng": "FOB", "Phương tiện vận chuyển": "Đường biển", "Tên nuớc xuất khẩu": "Việt Nam",
    "Tên nước nhập khẩu": "", "Chi cục hải quan": "HCM", "Loại hình": "B11", "Số tờ khai": "306709194540",
}

DEDUP_ROWS = [
    {},
    {},
    {"Trị giá USD": "31"},
    {"HS code": "03036600", "Tên hàng": "CÁ TUYẾT"},
    {"Số tờ khai": " 306709194540 ", "HS code": "03036600", "Tên hàng": "CÁ TUYẾT"},
    {"Số tờ khai": "", "HS code": "03036600", "Tên hàng": "TÔM", "Tên Cty nhập khẩu": "ABC", "Trị giá USD": "5", "Điều kiện giao hàng": "CIF"},
]


def write_csv(path, rows, columns=CSV_COLUMNS):
    def cell(v):
        return '"' + v.replace('"', '""') + '"' if (";" in v or '"' in v) else v

    with open(path, "w", encoding="utf-8") as fh:
        fh.write(";".join(columns) + "\n")
        for r in rows:
            vals = {**BASE, **r}
            fh.write(";".join(cell(vals.get(c, "")) for c in columns) + "\n")
        fh.write("\n")


def test_reader_order_and_rows(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.csv")
    write_csv(p, DEDUP_ROWS)
    df = read_customs_csv(spark, p)
    rows = df.orderBy("source_row").collect()
    assert [r.source_row for r in rows] == [1, 2, 3, 4, 5, 6]
    assert rows[4]["Số tờ khai"] == " 306709194540 "


def test_dedup_fixture(spark, tmp_dir):
    from tradelens.operators import dedup as D
    from tradelens.schema import DEDUP_CSV_KEY
    from tradelens.sources.customs_csv import ORDER_COLUMNS

    p = os.path.join(tmp_dir, "a.csv")
    write_csv(p, DEDUP_ROWS)
    rows = read_customs_csv(spark, p)
    uniq = D.dedup_in_file(rows, ORDER_COLUMNS, DEDUP_CSV_KEY)
    assert sorted(r.source_row for r in uniq.collect()) == [1, 3, 4]
    rep = D.duplicate_report(rows, ORDER_COLUMNS, DEDUP_CSV_KEY)
    assert sorted((r.source_row, r.duplicate_count) for r in rep.collect()) == [(2, 2), (5, 2)]


def test_import_twice_is_idempotent(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.csv")
    write_csv(p, DEDUP_ROWS[:5])
    store = os.path.join(tmp_dir, "store")
    first = I.run_import(spark, p, store).summary.first().asDict()
    assert first["total_rows"] == 5 and first["duplicates_in_file"] == 2 and first["imported_rows"] == 3
    assert first["new_companies"] == 1 and first["new_goods"] == 2
    second = I.run_import(spark, p, store).summary.first().asDict()
    assert second["imported_rows"] == 0 and second["duplicates_in_db"] == 3
    facts = spark.read.parquet(os.path.join(store, "transactions"))
    assert facts.count() == 3
    got = facts.select(F.col("usd_rate").cast("double"), F.col("quantity").cast("double"), F.col("date").cast("date").cast("string")).distinct().collect()
    assert {tuple(r) for r in got} == {(24410.0, 1000.0, "2024-09-09")}


def test_against_table_uses_parsed_values(spark, tmp_dir):
    p = os.path.join(tmp_dir, "a.csv")
    write_csv(p, [{}])
    store = os.path.join(tmp_dir, "store")
    I.run_import(spark, p, store)
    q = os.path.join(tmp_dir, "b.csv")
    write_csv(q, [{"Trị giá USD": "30,00"}, {"Trị giá USD": "31"}])  # 30,00 == 30 once parsed
    s = I.run_import(spark, q, store).summary.first().asDict()
    assert s["duplicates_in_db"] == 1 and s["imported_rows"] == 1


FAULTS = [
    ({"Năm": "1999"}, "Năm"), ({"Năm": "abc"}, "Năm"), ({"Tháng": "13"}, "Tháng"), ({"Ngày": "0"}, "Ngày"),
    ({"Ngày": "32"}, "Ngày"), ({"Số Lượng": "abc"}, "Số Lượng"), ({"Số Lượng": "-5"}, "Số Lượng"),
    ({"Điều kiện giao hàng": "XYZ"}, "Điều kiện giao hàng"), ({"Điều kiện giao hàng": " FOB"}, "Điều kiện giao hàng"),
    ({"HS code": "   "}, "HS code"),
]
CLEAN = [{"Ngày": "9/2/24"}, {"Số Lượng": "-"}, {"Số Lượng": "—"}, {"Điều kiện giao hàng": "fob"}, {"Điều kiện giao hàng": "C&F"},
         {"Địa chỉ Cty nhập khẩu": "", "Tên nước nhập khẩu": ""}]


def test_validation_faults(spark, tmp_dir):
    p = os.path.join(tmp_dir, "v.csv")
    write_csv(p, [r for r, _ in FAULTS] + CLEAN)
    issues = I.row_issues(read_customs_csv(spark, p)).collect()
    by_row = {}
    for i in issues:
        by_row.setdefault(i.row, set()).add(i.field)
    for n, (_, field) in enumerate(FAULTS, start=1):
        assert by_row.get(n) == {field}, (n, field, by_row.get(n))
    for n in range(len(FAULTS) + 1, len(FAULTS) + len(CLEAN) + 1):
        assert n not in by_row
    msgs = {i.message for i in issues}
    assert "Giá trị không thể âm: Số Lượng" in msgs and "Giá trị số không hợp lệ: Số Lượng" in msgs


def test_strict_gate_and_header_check(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bad.csv")
    write_csv(p, [{}, {"Tháng": "13"}])
    res = I.run_import(spark, p, os.path.join(tmp_dir, "store"))
    s = res.summary.first().asDict()
    assert not res.accepted and s["imported_rows"] == 0 and s["invalid_rows"] == 2
    cols = [c for c in CSV_COLUMNS if c != "HS code"] + ["Ghi chú"]
    q = os.path.join(tmp_dir, "hdr.csv")
    write_csv(q, [{}], cols)
    h = I.header_issues(spark, read_customs_csv(spark, q).columns).collect()
    assert [(r.field, r.severity) for r in h if r.severity == "error"] == [("HS code", "error")]
    assert ("Ghi chú", "warning") in [(r.field, r.severity) for r in h]
    quarantine = I.run_import(spark, p, os.path.join(tmp_dir, "store2"), mode="quarantine").summary.first().asDict()
    assert quarantine["imported_rows"] == 1 and quarantine["invalid_rows"] == 1


def test_dry_run(spark, tmp_dir):
    p = os.path.join(tmp_dir, "v.csv")
    write_csv(p, [{}, {"Tháng": "13"}])
    r = I.dry_run(spark, p).first()
    assert (r.valid, r.total_rows, r.required_columns_present, r.error_count) == (False, 2, True, 1)


def test_stream_import(spark, tmp_dir):
    from tradelens.streaming.ingest_stream import start_stream_import

    src = os.path.join(tmp_dir, "incoming")
    os.makedirs(src)
    write_csv(os.path.join(src, "part1.csv"), DEDUP_ROWS[:3])
    write_csv(os.path.join(src, "part2.csv"), DEDUP_ROWS[:5])
    store = os.path.join(tmp_dir, "store")
    q = start_stream_import(spark, src, store, os.path.join(tmp_dir, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(120)
    facts = spark.read.parquet(os.path.join(store, "transactions"))
    # part1 brings rows 1 and 3; part2 adds only row 4 (rows 1-3 already stored)
    assert facts.count() == 3
    assert facts.select("import_id").distinct().count() == 2


def test_quoted_cells(spark, tmp_dir):
    p = os.path.join(tmp_dir, "q.csv")
    write_csv(p, [{"Tên hàng": "CÁ; loại 1"}, {"Tên hàng": 'TÔM "XL"'}])
    names = [r["Tên hàng"] for r in read_customs_csv(spark, p).orderBy("source_row").collect()]
    assert names == ["CÁ; loại 1", 'TÔM "XL"']
    q = os.path.join(tmp_dir, "m.csv")
    with open(q, "w", encoding="utf-8") as fh:
        fh.write(";".join(CSV_COLUMNS) + "\n")
        vals = [BASE.get(c, "") for c in CSV_COLUMNS]
        vals[CSV_COLUMNS.index("Tên hàng")] = '"CÁ\nTRA"'
        fh.write(";".join(vals) + "\n")
    rows = read_customs_csv(spark, q, multiline=True).collect()
    assert len(rows) == 1 and rows[0]["Tên hàng"] == "CÁ\nTRA"


def test_dry_run_missing_header(spark, tmp_dir):
    cols = [c for c in CSV_COLUMNS if c != "Số tờ khai"]
    p = os.path.join(tmp_dir, "nohdr.csv")
    write_csv(p, [{}], cols)
    r = I.dry_run(spark, p).first()
    assert (r.valid, r.required_columns_present) == (False, False)
    msgs = [x.text for x in I.render_errors(I.header_issues(spark, read_customs_csv(spark, p).columns)).collect()]
    assert msgs == ["Row 0: Số tờ khai - Thiếu cột bắt buộc: Số tờ khai"]
