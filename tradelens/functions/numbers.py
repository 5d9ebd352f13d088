"""Number and date Column functions.

All are plain ``pyspark.sql.functions`` compositions, so they stay inside
whole-stage codegen.  Parsing uses ``try_cast`` because ANSI mode is on in
Spark 4: a bad cell gives NULL, never a failed task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Cells that mean "nothing" in the numeric columns of a customs file.
EMPTY_NUMBER_MARKS = ("", "-", "—")

# JS parseFloat accepts the longest leading decimal literal.
_LEADING_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_LEADING_INT = r"^\s*([+-]?[0-9]+)"
# Cells that may be cast as they are (one match is cheaper than a translation
# of every character).
_PLAIN_FLOAT = r"\A[0-9+\-.eE]*\z"
_PLAIN_INT = r"\A[0-9+\-]+\z"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _try_cast(c: Column, type_name: str) -> Column:
    return c.try_cast(type_name)


def european_number(c: ColumnOrName, type_name: str = "decimal(28,10)", default: float | None = 0) -> Column:
    """``24.410,00`` -> 24410.00.

    Trim; blank, ``-``, ``—`` or NULL mean 0; every ``.`` is a thousands
    separator and removed, every ``,`` becomes the decimal point; then the
    longest leading number is taken (so ``1.2,3x`` -> 12.3).  Unparseable
    text gives ``default`` (NULL when ``default`` is None).
    """
    s = F.trim(_col(c))
    cleaned = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    # fast path: a cell of digits, sign, point and exponent marks only is cast
    # directly; anything else takes the leading-number regex
    plain = cleaned.rlike(_PLAIN_FLOAT)
    parsed = F.coalesce(
        F.when(plain, _try_cast(cleaned, type_name)),
        _try_cast(F.regexp_extract(cleaned, _LEADING_FLOAT, 0), type_name),
    )
    empty = s.isNull() | s.isin(*EMPTY_NUMBER_MARKS)
    zero = F.lit(0).cast(type_name)
    if default is None:
        return F.when(empty, zero).otherwise(parsed)
    return F.when(empty, zero).otherwise(F.coalesce(parsed, F.lit(default).cast(type_name)))


def leading_int(c: ColumnOrName, default: int | None = 0) -> Column:
    """JS ``parseInt`` — the leading integer (``"9/2/24"`` -> 9)."""
    x = _col(c)
    t = F.trim(x)
    # fast path: a cell of digits (and a sign) is cast directly
    plain = t.rlike(_PLAIN_INT)
    parsed = F.coalesce(F.when(plain, _try_cast(t, "int")), _try_cast(F.regexp_extract(x, _LEADING_INT, 1), "int"))
    return parsed if default is None else F.coalesce(parsed, F.lit(default))


def european_numbers(cells: Sequence[ColumnOrName], type_name: str = "decimal(28,10)", default: float | None = 0) -> Column:
    """N1 of several cells as an array.

    The rule is in the plan once, not once per cell: a projection that repeats
    it is compiled to a method of more than 8,000 bytecodes, which the JVM
    never compiles to machine code (measured three to five times slower)."""
    return F.transform(F.array(*map(_col, cells)), lambda c: european_number(c, type_name, default))


def leading_ints(cells: Sequence[ColumnOrName], default: int | None = 0) -> Column:
    """N2/I3 of several cells as an array (as :func:`european_numbers`)."""
    return F.transform(F.array(*map(_col, cells)), lambda c: leading_int(c, default))


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``den > 0 ? num / den : 0`` (weighted average price)."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def js_round2(c: ColumnOrName) -> Column:
    """``Math.round(x * 100) / 100`` — halves go toward +infinity."""
    return F.floor(_col(c).cast("double") * 100 + 0.5) / 100


def js_number(c: Column, data_type: str) -> Column:
    """JS ``Number(x)``; NULL stands for NaN.

    ``data_type`` is the column's simple type string: strings are trimmed,
    blank means 0 and anything unparseable is NaN; booleans are 0/1.
    """
    if data_type == "string":
        t = F.trim(c)
        return F.when(t == "", F.lit(0.0)).otherwise(_try_cast(t, "double"))
    if data_type == "boolean":
        return c.cast("int").cast("double")
    if data_type.startswith("timestamp") or data_type == "date":
        return F.unix_millis(c.cast("timestamp")).cast("double")
    return c.cast("double")


def compact_number(c: ColumnOrName) -> Column:
    """1234 -> ``1.2K``, 2.5e6 -> ``2.5M``, 3e9 -> ``3.0B``."""
    x = _col(c).cast("double")

    def one_dp(v: Column) -> Column:
        return F.format_string("%.1f", F.round(v, 1))

    return (
        F.when(x >= 1e9, F.concat(one_dp(x / 1e9), F.lit("B")))
        .when(x >= 1e6, F.concat(one_dp(x / 1e6), F.lit("M")))
        .when(x >= 1e3, F.concat(one_dp(x / 1e3), F.lit("K")))
        .otherwise(F.regexp_replace(x.cast("string"), r"\.0$", ""))
    )


def format_percentage(c: ColumnOrName, decimals: int = 1) -> Column:
    """Ratio 0.1234 -> ``12.3%``."""
    return F.concat(F.format_string(f"%.{decimals}f", _col(c).cast("double") * 100), F.lit("%"))


def format_usd(c: ColumnOrName) -> Column:
    """En-US currency, ``$1,234.50``."""
    x = _col(c).cast("double")
    body = F.format_number(F.abs(x), 2)
    return F.when(x < 0, F.concat(F.lit("-$"), body)).otherwise(F.concat(F.lit("$"), body))


def format_vi_number(c: ColumnOrName, decimals: int = 0) -> Column:
    """Vi-VN grouping — ``.`` for thousands, ``,`` for decimals."""
    return F.translate(F.format_number(_col(c).cast("double"), decimals), ",.", ".,")


def format_vi_numbers(values: Sequence[ColumnOrName], decimals: int = 0) -> Column:
    """N6 of several values as an array (as :func:`european_numbers`)."""
    return F.transform(F.array(*[_col(c).cast("double") for c in values]), lambda x: format_vi_number(x, decimals))


def format_vnd(c: ColumnOrName) -> Column:
    """Vi-VN currency, ``1.234.567\u00a0₫`` (a no-break space before the
    sign, as the vi-VN currency format writes it)."""
    return F.concat(format_vi_number(c, 0), F.lit("\u00a0₫"))


def date_rollover(year: ColumnOrName, month: ColumnOrName, day: ColumnOrName) -> Column:
    """``new Date(y, m-1, d)`` — out-of-range days roll over (31 Feb -> 2 Mar)."""
    y = _col(year)
    # make_date fails under ANSI outside 1..9999: such years give NULL instead
    base = F.when(y.between(1, 9999), F.make_date(y, F.lit(1), F.lit(1)))
    return F.date_add(F.add_months(base, _col(month) - 1), _col(day) - 1)


def month_key(c: ColumnOrName) -> Column:
    """``yyyy-MM`` in the session time zone (UTC)."""
    return F.date_format(_col(c), "yyyy-MM")


def iso_timestamp(c: ColumnOrName) -> Column:
    """D3: ``toISOString()`` form, ``2024-09-02T00:00:00.000Z``."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_dmy_strict(c: ColumnOrName) -> Column:
    """``DD/MM/YYYY`` -> date; impossible dates (31/02) give NULL."""
    parts = F.split(_col(c), "/")
    ok = F.size(parts) == 3
    # F.get returns NULL outside the array (getItem fails under ANSI)
    d = leading_int(F.get(parts, 0), None)
    m = leading_int(F.get(parts, 1), None)
    y = leading_int(F.get(parts, 2), None)
    rolled = date_rollover(y, m, d)
    valid = ok & (F.year(rolled) == y) & (F.month(rolled) == m) & (F.dayofmonth(rolled) == d)
    return F.when(valid, rolled)


def format_date_vi(c: ColumnOrName) -> Column:
    """``DD/MM/YYYY``."""
    return F.date_format(_col(c), "dd/MM/yyyy")


def format_datetime_vi(c: ColumnOrName) -> Column:
    """``HH:mm:ss DD/MM/YYYY`` (vi-VN puts the time first)."""
    return F.date_format(_col(c), "HH:mm:ss dd/MM/yyyy")


def format_month_year(c: ColumnOrName) -> Column:
    """``MM/YYYY``."""
    return F.date_format(_col(c), "MM/yyyy")


def format_date_range(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``DD/MM/YYYY - DD/MM/YYYY``."""
    return F.concat(format_date_vi(a), F.lit(" - "), format_date_vi(b))


def relative_time(c: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Vietnamese relative time with 30-day months and 12-month years.

    ``as_of`` is explicit so results are reproducible.
    """
    secs = F.floor(F.unix_millis(_col(as_of).cast("timestamp")) / 1000 - F.unix_millis(_col(c).cast("timestamp")) / 1000)
    mins = F.floor(secs / 60)
    hours = F.floor(mins / 60)
    days = F.floor(hours / 24)
    months = F.floor(days / 30)
    years = F.floor(months / 12)
    return (
        F.when(years > 0, F.concat(years.cast("string"), F.lit(" năm trước")))
        .when(months > 0, F.concat(months.cast("string"), F.lit(" tháng trước")))
        .when(days > 0, F.concat(days.cast("string"), F.lit(" ngày trước")))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit(" giờ trước")))
        .when(mins > 0, F.concat(mins.cast("string"), F.lit(" phút trước")))
        .otherwise(F.lit("Vừa xong"))
    )


def check_date_range(date_from, date_to) -> None:
    """Plan-time check that ``from <= to`` when both are given."""
    if date_from is not None and date_to is not None and str(date_from) > str(date_to):
        raise ValueError(f"date range is reversed: {date_from} > {date_to}")
