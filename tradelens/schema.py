"""Schemas, field whitelists and fixed values of the customs data model.

The fact table is one customs declaration line item.  Dimensions are
companies (key: name + address), goods (key: raw name) and categories
(key: name).  Column names are snake_case versions of the reference's
field names; ``FIELD_ALIASES`` maps the camelCase names callers may use.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Money and quantities are exact decimals so that sums do not depend on the
# order rows arrive in; outputs are cast to double at the edge (A6).  The
# CSV import writes DECIMAL(28,10) (customs cells carry up to 10 decimals);
# the testbed maps the driver's 2-decimal prices to DECIMAL(18,2).  The
# schema below documents the columns; operators accept any decimal width.
MONEY = T.DecimalType(28, 10)
RATE = T.DecimalType(28, 10)

TRANSACTION_SCHEMA = T.StructType(
    [
        T.StructField("declaration_number", T.StringType(), False, {"comment": "Customs declaration number; many lines share one"}),
        T.StructField("date", T.TimestampNTZType(), False, {"comment": "Declaration date (day grain)"}),
        T.StructField("year", T.IntegerType(), False),
        T.StructField("month", T.IntegerType(), False),
        T.StructField("day", T.IntegerType(), False),
        T.StructField("company_id", T.LongType(), True, {"comment": "FK to companies"}),
        T.StructField("import_company_raw_name", T.StringType(), False),
        T.StructField("goods_id", T.LongType(), True, {"comment": "FK to goods"}),
        T.StructField("goods_raw_name", T.StringType(), False),
        T.StructField("hs_code", T.StringType(), False),
        T.StructField("unit", T.StringType(), False),
        T.StructField("quantity", MONEY, False),
        T.StructField("unit_price_original", MONEY, True),
        T.StructField("unit_price_usd", MONEY, True, {"comment": "testbed: double (value / quantity)"}),
        T.StructField("total_value_usd", MONEY, False),
        T.StructField("original_currency", T.StringType(), True),
        T.StructField("original_currency_rate", RATE, True),
        T.StructField("usd_rate", RATE, True),
        T.StructField("payment_method", T.StringType(), False),
        T.StructField("delivery_terms", T.StringType(), False),
        T.StructField("transport_mode", T.StringType(), False),
        T.StructField("export_country", T.StringType(), False),
        T.StructField("import_country", T.StringType(), True),
        T.StructField("customs_office", T.StringType(), False),
        T.StructField("export_type", T.StringType(), False),
        T.StructField("tax_rate", MONEY, False, {"comment": "testbed: double"}),
        T.StructField("raw_data", T.MapType(T.StringType(), T.StringType()), True, {"comment": "Original CSV row, never modified"}),
    ]
)

# Aggregation whitelists (closed lists of the tool catalogue).
NUMERIC_FIELDS = (
    "quantity",
    "unit_price_original",
    "unit_price_usd",
    "total_value_usd",
    "original_currency_rate",
    "usd_rate",
    "tax_rate",
    "year",
    "month",
    "day",
)
DATE_FIELDS = ("date", "created_at", "updated_at")
GROUPABLE_FIELDS = (
    "import_company_raw_name",
    "goods_raw_name",
    "hs_code",
    "unit",
    "original_currency",
    "payment_method",
    "delivery_terms",
    "transport_mode",
    "import_country",
    "customs_office",
    "export_type",
    "year",
    "month",
    "day",
)

# camelCase field names of the reference API -> our columns.
FIELD_ALIASES = {
    "declarationNumber": "declaration_number",
    "importCompanyRawName": "import_company_raw_name",
    "importCompanyName": "import_company_raw_name",
    "goodsRawName": "goods_raw_name",
    "goodsName": "goods_raw_name",
    "hsCode": "hs_code",
    "unitPriceOriginal": "unit_price_original",
    "unitPriceUSD": "unit_price_usd",
    "totalValueUSD": "total_value_usd",
    "originalCurrency": "original_currency",
    "originalCurrencyRate": "original_currency_rate",
    "usdRate": "usd_rate",
    "paymentMethod": "payment_method",
    "deliveryTerms": "delivery_terms",
    "transportMode": "transport_mode",
    "exportCountry": "export_country",
    "importCountry": "import_country",
    "customsOffice": "customs_office",
    "exportType": "export_type",
    "taxRate": "tax_rate",
    "categoryName": "category_name",
    "createdAt": "created_at",
    "updatedAt": "updated_at",
}


def field(name: str) -> str:
    """Resolve an API field name (camelCase or snake_case) to a fact column."""
    return FIELD_ALIASES.get(name, name)


def camel_to_snake(name: str) -> str:
    """``totalValueUSD`` -> ``total_value_usd``, ``hsCode`` -> ``hs_code``."""
    import re

    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def resolve(name: str, columns) -> str:
    """The column of ``columns`` an API field name refers to: itself, its
    snake_case form, or its alias; unchanged when none exists."""
    cols = set(columns)
    for candidate in (name, camel_to_snake(name), FIELD_ALIASES.get(name, name)):
        if candidate in cols:
            return candidate
    return name


# The customs CSV header, byte for byte (NFC), in file order.
CSV_COLUMNS = (
    "Năm",
    "Tháng",
    "Ngày",
    "Tên Cty nhập khẩu",
    "Địa chỉ Cty nhập khẩu",
    "HS code",
    "Tên hàng",
    "Thuế suất XNK",
    "Đơn vị tính",
    "Số Lượng",
    "Đơn giá Nguyên tệ",
    "Đơn giá khai báo(USD)",
    "Trị giá USD",
    "Nguyên tệ",
    "Tỷ giá nguyên tệ",
    "Tỷ giá USD",
    "Mã phương thức thanh toán",
    "Điều kiện giao hàng",
    "Phương tiện vận chuyển",
    "Tên nuớc xuất khẩu",
    "Tên nước nhập khẩu",
    "Chi cục hải quan",
    "Loại hình",
    "Số tờ khai",
)
# The two optional headers; every other header is required.
OPTIONAL_CSV_COLUMNS = ("Địa chỉ Cty nhập khẩu", "Tên nước nhập khẩu")
REQUIRED_CSV_COLUMNS = tuple(c for c in CSV_COLUMNS if c not in OPTIONAL_CSV_COLUMNS)

# CSV header -> fact column (the address goes to the company dimension).
CSV_TO_FACT = {
    "Năm": "year",
    "Tháng": "month",
    "Ngày": "day",
    "Tên Cty nhập khẩu": "import_company_raw_name",
    "Địa chỉ Cty nhập khẩu": "import_company_address",
    "HS code": "hs_code",
    "Tên hàng": "goods_raw_name",
    "Thuế suất XNK": "tax_rate",
    "Đơn vị tính": "unit",
    "Số Lượng": "quantity",
    "Đơn giá Nguyên tệ": "unit_price_original",
    "Đơn giá khai báo(USD)": "unit_price_usd",
    "Trị giá USD": "total_value_usd",
    "Nguyên tệ": "original_currency",
    "Tỷ giá nguyên tệ": "original_currency_rate",
    "Tỷ giá USD": "usd_rate",
    "Mã phương thức thanh toán": "payment_method",
    "Điều kiện giao hàng": "delivery_terms",
    "Phương tiện vận chuyển": "transport_mode",
    "Tên nuớc xuất khẩu": "export_country",
    "Tên nước nhập khẩu": "import_country",
    "Chi cục hải quan": "customs_office",
    "Loại hình": "export_type",
    "Số tờ khai": "declaration_number",
}

# The seven numeric CSV fields checked by the validator.
NUMERIC_CSV_COLUMNS = (
    "Thuế suất XNK",
    "Số Lượng",
    "Đơn giá Nguyên tệ",
    "Đơn giá khai báo(USD)",
    "Trị giá USD",
    "Tỷ giá nguyên tệ",
    "Tỷ giá USD",
)

# Accepted delivery terms (C&F is the legacy name of CFR).
DELIVERY_TERMS = ("FOB", "CFR", "C&F", "CIF", "DAF", "DAP", "EXW", "FCA", "CPT", "CIP", "DDP", "DDU", "OTHER")

# The 8-column de-duplication key, as CSV headers and as fact columns.
DEDUP_CSV_KEY = (
    "Số tờ khai",
    "HS code",
    "Tên hàng",
    "Tên Cty nhập khẩu",
    "Trị giá USD",
    "Tỷ giá USD",
    "Mã phương thức thanh toán",
    "Điều kiện giao hàng",
)
DEDUP_KEY = tuple(CSV_TO_FACT[c] for c in DEDUP_CSV_KEY)

# The goods categories the classifier may answer with.
CATEGORIES = (
    "Thủy sản đông lạnh",
    "Thủy sản tươi sống",
    "Nông sản",
    "Dệt may & Hàng thời trang",
    "Sản phẩm gỗ",
    "Điện tử & Máy móc",
    "Hóa chất & Nhựa",
    "Thực phẩm & Đồ uống",
    "Khác",
)
DEFAULT_CATEGORY = "Khác"
IMPORT_FALLBACK_CATEGORY = "Other"
SHORT_NAME_MAX = 100
