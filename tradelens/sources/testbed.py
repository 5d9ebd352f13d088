"""Stand-in star built from the driver's TPC-H-like tables.

This module only renames and joins the given tables into the customs
schema; no query work happens here.  Mapping (one lineitem = one customs
line):

=========================  ===========================================
declaration_number         l_orderkey (as text)
date, year, month, day     l_shipdate
company_id, importer name  o_custkey, c_name (via orders)
goods_id, goods_raw_name   l_partkey, p_name
hs_code, unit              p_brand, p_size (as text)
category (goods dim)       p_type
quantity, total_value_usd  l_quantity, l_extendedprice (DECIMAL(18,2))
unit_price_usd             l_extendedprice / l_quantity
tax_rate, usd_rate         l_tax, l_discount
payment_method             o_orderpriority
delivery_terms             l_returnflag
transport_mode             l_linestatus
export_type                c_mktsegment
import_country             customer's nation name
customs_office             customer's region name
export_country             supplier's nation name
created_at                 o_orderdate
raw_data                   map of the lineitem columns as text
=========================  ===========================================

``facts(columns)`` joins only the tables the requested columns need, so a
query over lineitem-only columns never touches orders or customers.  All
joins are left joins on the foreign key (a fact line is never dropped).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions.text import shorten_name
from tradelens.sources.store import Store

LINEITEM_COLUMNS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


# fact column -> (builder of the expression over the joined source columns, tables needed)
_FACT_COLUMNS: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = {
    "declaration_number": (lambda: F.col("l_orderkey").cast("string"), ()),
    "line_no": (lambda: F.col("l_linenumber"), ()),
    "date": (lambda: F.col("l_shipdate"), ()),
    "year": (lambda: F.year("l_shipdate"), ()),
    "month": (lambda: F.month("l_shipdate"), ()),
    "day": (lambda: F.dayofmonth("l_shipdate"), ()),
    "company_id": (lambda: F.col("o_custkey"), ("orders",)),
    "import_company_raw_name": (lambda: F.col("c_name"), ("orders", "customer")),
    "goods_id": (lambda: F.col("l_partkey"), ()),
    "supplier_id": (lambda: F.col("l_suppkey"), ()),
    "goods_raw_name": (lambda: F.col("p_name"), ("part",)),
    "hs_code": (lambda: F.col("p_brand"), ("part",)),
    "unit": (lambda: F.col("p_size").cast("string"), ("part",)),
    "quantity": (lambda: _money("l_quantity"), ()),
    "unit_price_original": (lambda: F.col("l_extendedprice") / F.col("l_quantity"), ()),
    "unit_price_usd": (lambda: F.col("l_extendedprice") / F.col("l_quantity"), ()),
    "total_value_usd": (lambda: _money("l_extendedprice"), ()),
    "original_currency": (lambda: F.lit("USD"), ()),
    "original_currency_rate": (lambda: F.lit(1).cast("decimal(18,6)"), ()),
    "usd_rate": (lambda: F.col("l_discount").cast("decimal(18,6)"), ()),
    "tax_rate": (lambda: F.col("l_tax"), ()),
    "payment_method": (lambda: F.col("o_orderpriority"), ("orders",)),
    "delivery_terms": (lambda: F.col("l_returnflag"), ()),
    "transport_mode": (lambda: F.col("l_linestatus"), ()),
    "export_type": (lambda: F.col("c_mktsegment"), ("orders", "customer")),
    "import_country": (lambda: F.col("cn_name"), ("orders", "customer", "cnation")),
    "customs_office": (lambda: F.col("cr_name"), ("orders", "customer", "cnation", "cregion")),
    "export_country": (lambda: F.col("sn_name"), ("supplier", "snation")),
    "created_at": (lambda: F.col("o_orderdate"), ("orders",)),
    "raw_data": (lambda:
        F.create_map(*[x for c in LINEITEM_COLUMNS for x in (F.lit(c), F.col(c).cast("string"))]),
        (),
    ),
}

FACT_COLUMNS = tuple(_FACT_COLUMNS)
DEFAULT_FACT_COLUMNS = tuple(c for c in FACT_COLUMNS if c != "raw_data")


class TestbedStore(Store):
    """Store over ``{sf_dir}/{table}.parquet`` files of the driver."""

    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        # one relation per table: file listing and schema are resolved once
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def facts(self, columns: Sequence[str] | None = None, dates: tuple | None = None) -> DataFrame:
        columns = list(columns or DEFAULT_FACT_COLUMNS)
        need = self._needed(columns)
        df = self._with_orders(self.table("lineitem"), need)
        if "part" in need:
            df = self._with_part(df)
        df = self._with_supplier(df, need)
        return df.select(*[_FACT_COLUMNS[c][0]().alias(c) for c in columns])

    def goods_facts(self, columns: Sequence[str], goods_cols: dict[str, str], category_col: str | None = "category") -> DataFrame:
        need = self._needed(columns)
        df = self.table("lineitem")
        if "part" in need:
            df = self._with_part(df)  # by the key of the goods: lines stay where they are for the next join
        df = self.attach_goods(df.withColumn("goods_id", F.col("l_partkey")), goods_cols, category_col)
        df = self._with_supplier(self._with_orders(df, need), need)
        names = [*goods_cols.values(), *([category_col] if category_col else [])]
        return df.select(*[_FACT_COLUMNS[c][0]().alias(c) for c in columns], *names)

    @staticmethod
    def _needed(columns: Sequence[str]) -> set[str]:
        unknown = [c for c in columns if c not in _FACT_COLUMNS]
        if unknown:
            raise ValueError(f"unknown fact columns: {unknown}")
        return {table for c in columns for table in _FACT_COLUMNS[c][1]}

    def import_facts(self, columns: Sequence[str]) -> DataFrame:
        """The rows of :meth:`facts`: the customers are joined to the orders and
        not to the lines, of which there are several per order, and the goods,
        which add least to a line, before the orders.  (Left joins on the keys
        of orders and customers: either order gives the same rows.)"""
        columns = list(columns)
        need = self._needed(columns)
        df = self.table("lineitem")
        if "unit_price_usd" not in columns and "unit_price_original" not in columns and "raw_data" not in columns:
            # amounts as the facts have them (fewer significant bytes than as doubles)
            amounts = {"l_quantity": "decimal(18,2)", "l_extendedprice": "decimal(18,2)", "l_discount": "decimal(18,6)"}
            df = df.withColumns({c: F.col(c).cast(t) for c, t in amounts.items()})
        if "part" in need:
            df = self._with_part(df)
        if "orders" in need:
            df = df.join(self._with_customers(self._orders(), need), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        df = self._with_supplier(df, need)
        return df.select(*[_FACT_COLUMNS[c][0]().alias(c) for c in columns])

    def _orders(self) -> DataFrame:
        return self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")

    def _with_orders(self, df: DataFrame, need: set[str]) -> DataFrame:
        if "orders" in need:
            df = df.join(self._orders(), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        return self._with_customers(df, need)

    def _with_customers(self, df: DataFrame, need: set[str]) -> DataFrame:
        if "customer" in need:
            df = df.join(
                self.table("customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"),
                F.col("o_custkey") == F.col("c_custkey"),
                "left",
            )
        if "cnation" in need:
            df = df.join(
                self.table("nation").select(
                    F.col("n_nationkey").alias("cn_key"), F.col("n_name").alias("cn_name"), F.col("n_regionkey").alias("cn_region")
                ),
                F.col("c_nationkey") == F.col("cn_key"),
                "left",
            )
        if "cregion" in need:
            df = df.join(
                self.table("region").select(F.col("r_regionkey").alias("cr_key"), F.col("r_name").alias("cr_name")),
                F.col("cn_region") == F.col("cr_key"),
                "left",
            )
        return df

    def _with_part(self, df: DataFrame) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_name", "p_brand", "p_size")
        return df.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")

    def _with_supplier(self, df: DataFrame, need: set[str]) -> DataFrame:
        if "supplier" in need:
            df = df.join(
                self.table("supplier").select("s_suppkey", "s_nationkey"),
                F.col("l_suppkey") == F.col("s_suppkey"),
                "left",
            )
        if "snation" in need:
            df = df.join(
                self.table("nation").select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("sn_name")),
                F.col("s_nationkey") == F.col("sn_key"),
                "left",
            )
        return df

    def companies(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("company_id"),
            F.col("c_name").alias("name"),
            F.lit("").alias("address"),
        )

    def goods(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("goods_id"),
            F.col("p_name").alias("raw_name"),
            shorten_name(F.col("p_name")).alias("short_name"),
            F.xxhash64("p_type").alias("category_id"),
            F.col("p_brand").alias("hs_code"),
            F.lit("fallback").alias("classified_by"),
        )

    def categories(self) -> DataFrame:
        return (
            self.table("part")
            .select(F.xxhash64("p_type").alias("category_id"), F.col("p_type").alias("name"))
            .distinct()
            .withColumn("description", F.lit(""))
        )


def testbed(spark: SparkSession, sf_dir: str) -> TestbedStore:
    return TestbedStore(spark, sf_dir)


def customs_rows(store: Store, faults: bool = False) -> DataFrame:
    """The fact lines as customs CSV rows (24 text columns, European numbers,
    day/month/year cells) with the reader's position columns — stand-in input
    for the import job; renaming and formatting only.

    Two value mappings keep the rows inside the customs domain the validator
    enforces: years move by +25 (the test data spans 1995-2001, the validator
    accepts 2000-2100) and the return flag A/N/R names the delivery terms
    FOB/CIF/CFR.  ``faults`` spoils one cell of each sixteenth of the
    declarations, a different cell per digit of the number's MD5."""
    from tradelens.functions.numbers import format_vi_number, format_vi_numbers
    from tradelens.schema import CSV_COLUMNS

    f = store.import_facts(
        [
            "year", "month", "day", "import_company_raw_name", "hs_code", "goods_raw_name", "tax_rate", "unit", "quantity",
            "unit_price_usd", "total_value_usd", "usd_rate", "payment_method", "delivery_terms", "transport_mode",
            "export_country", "import_country", "customs_office", "export_type", "declaration_number", "line_no",
        ]
    )

    amounts = ("tax_rate", "quantity", "total_value_usd", "usd_rate")
    f = f.withColumns({"_amounts": format_vi_numbers(amounts, 2), "_price": format_vi_number("unit_price_usd", 4)})

    def num(c: str) -> Column:
        return F.col("_amounts")[amounts.index(c)]

    cells = {
        "Năm": (F.col("year") + 25).cast("string"),
        "Tháng": F.col("month").cast("string"),
        "Ngày": F.col("day").cast("string"),
        "Tên Cty nhập khẩu": F.col("import_company_raw_name"),
        "Địa chỉ Cty nhập khẩu": F.lit(""),
        "HS code": F.col("hs_code"),
        "Tên hàng": F.col("goods_raw_name"),
        "Thuế suất XNK": num("tax_rate"),
        "Đơn vị tính": F.col("unit"),
        "Số Lượng": num("quantity"),
        "Đơn giá Nguyên tệ": F.col("_price"),
        "Đơn giá khai báo(USD)": F.col("_price"),
        "Trị giá USD": num("total_value_usd"),
        "Nguyên tệ": F.lit("USD"),
        "Tỷ giá nguyên tệ": F.lit("1"),
        "Tỷ giá USD": num("usd_rate"),
        "Mã phương thức thanh toán": F.col("payment_method"),
        "Điều kiện giao hàng": F.when(F.col("delivery_terms") == "A", "FOB").when(F.col("delivery_terms") == "N", "CIF").otherwise("CFR"),
        "Phương tiện vận chuyển": F.col("transport_mode"),
        "Tên nuớc xuất khẩu": F.col("export_country"),
        "Tên nước nhập khẩu": F.col("import_country"),
        "Chi cục hải quan": F.col("customs_office"),
        "Loại hình": F.col("export_type"),
        "Số tờ khai": F.col("declaration_number"),
    }
    if faults:
        for at, (c, bad) in enumerate((("Năm", "1999"), ("Tháng", "13"), ("Ngày", "x"), ("Số Lượng", "abc"), ("Trị giá USD", "-5"), ("Điều kiện giao hàng", "XYZ"), ("HS code", "  ")), start=1):
            cells[c] = F.when(F.substring(F.md5("declaration_number"), at, 1) == "0", F.lit(bad)).otherwise(cells[c])
    position = F.col("declaration_number").cast("long") * 8 + F.col("line_no")
    return f.select(
        *[cells[c].alias(c) for c in CSV_COLUMNS],
        F.lit("lines").alias("_src_file"),
        F.lit(0).cast("long").alias("_src_block"),
        position.alias("_src_pos"),
        position.alias("source_row"),
    )


def export_customs_csv(store: Store, path: str, sep: str = ";", compression: str | None = None) -> None:
    """Write :func:`customs_rows` as CSV files with a header."""
    from tradelens.schema import CSV_COLUMNS
    from tradelens.sources.customs_csv import write_csv

    write_csv(customs_rows(store).select(*[F.col(f"`{c}`") for c in CSV_COLUMNS]), path, sep, compression=compression)
