"""What the import does per line: size of its generated methods, shuffled columns."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from tradelens.operators import dedup as D
from tradelens.operators import ingest as I
from tradelens.schema import CSV_COLUMNS
from tradelens.session import stage_table


def _lines(spark, n=20):
    cells = {c: F.concat(F.lit("c"), F.col("id").cast("string")) for c in CSV_COLUMNS}
    cells |= {"Năm": F.lit("2024"), "Tháng": F.lit("2"), "Ngày": F.lit("30"), "Số Lượng": F.lit("1.234,50"), "Trị giá USD": F.lit("-5")}
    place = [F.lit("f").alias("_src_file"), F.lit(0).cast("long").alias("_src_block"), F.col("id").alias("_src_pos"), F.col("id").alias("source_row")]
    return stage_table(spark.range(n).select(*[v.alias(c) for c, v in cells.items()], *place), "cost")


def _largest_method(df) -> int:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("codegen")
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())), default=0)


def test_methods_of_the_import_are_compiled_by_the_jvm(spark):
    """The JVM leaves methods of more than 8,000 bytecodes to its interpreter."""
    rows = _lines(spark)
    facts = I.to_facts(rows)
    for df in (I.with_issues(rows), facts, facts.withColumns({"_broken": I.constraint_array(facts), "key_id": D.line_key()})):
        assert _largest_method(df) < 8000


def test_first_of_repeated_gives_the_rows_of_dedup_in_file(spark):
    rows = [("k", "a", 2), ("k", "b", 1), ("k", "c", 1), ("other", "d", 5), (None, "e", 1), (" k ", "f", 0), ("  ", "g", 0)]
    df = spark.createDataFrame(rows, "the_key string, v string, n long")
    keys, order = ["the_key"], ["n"]
    repeated = stage_table(D.repeated_keys(df, keys), "repeated")
    assert repeated.count() == 1
    got = D.first_of_repeated(df, repeated, order, keys)
    assert sorted(r.v for r in got.collect()) == ["d", "f"]
    assert got.columns == df.columns


def test_repeated_lines_of_numbered_rows_are_imported_once(spark):
    rows = _lines(spark).withColumns({"Trị giá USD": F.lit("5"), "Điều kiện giao hàng": F.lit("FOB")})
    for c in I.NUMERIC_CSV_COLUMNS:
        rows = rows.withColumn(c, F.lit("1,5"))
    twice = rows.unionByName(rows.withColumns({"_src_pos": F.col("_src_pos") + 100, "source_row": F.col("source_row") + 100}))
    r = I.plan_import(spark, twice, None, None, None, None, mode="quarantine")
    assert (r.counts["total_rows"], r.counts["imported_rows"], r.counts["duplicates_in_file"]) == (40, 20, 20)
    assert r.new_facts.agg(F.max("source_row")).first()[0] == 19
    first = r.new_facts.filter("source_row = 3").first()
    assert first.raw_data["Số tờ khai"] == "c3" and len(first.raw_data) == len(CSV_COLUMNS)
    counted = I.row_counts(I.stage_rows(twice)[0])
    assert counted == {"rows": 40, "bad": 0}
