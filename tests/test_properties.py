"""
transcriptions of the JS behaviour, I7 idempotence."""

import datetime as dt
import re
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradelens.functions import numbers as N
from tradelens.operators import dedup as D

_LEAD = re.compile(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def js_european(v):
    """Python transcription of the import's number rule (JS parseFloat)."""
    if v is None:
        return 0.0
    t = v.strip()
    if t in ("", "-", "—"):
        return 0.0
    t = t.replace(".", "").replace(",", ".")
    m = _LEAD.match(t)
    return float(m.group(0)) if m else 0.0


cells = st.one_of(
    st.none(),
    st.sampled_from(["", "-", "—", " ", "abc", "1.5", "24.410,00", "1.2,3x", "-5", "+7", ".5", "1e3", "12,", "0,001"]),
    st.text(alphabet="0123456789.,-+eE x", max_size=12),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(cells, min_size=1, max_size=30))
def test_european_number_matches_js(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(N.european_number(F.col("v"), "double")).collect()]
    for v, g in zip(values, got):
        assert g == js_european(v), (v, g)


def js_date(y, m, d):
    """``new Date(y, m - 1, d)`` with roll-over, in Python."""
    base = dt.date(y, 1, 1)
    months = base.month - 1 + (m - 1)
    yy, mm = base.year + months // 12, months % 12 + 1
    return dt.date(yy, mm, 1) + dt.timedelta(days=d - 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1990, 2100), st.integers(1, 12), st.integers(1, 31)), min_size=1, max_size=40))
def test_date_rollover_matches_js(spark, triples):
    df = spark.createDataFrame(triples, "y int, m int, d int")
    got = [r[0] for r in df.select(N.date_rollover("y", "m", "d")).collect()]
    assert got == [js_date(*t) for t in triples]


keys = st.tuples(st.sampled_from(["D1", " D1 ", "D2", ""]), st.sampled_from(["H1", "H2"]), st.sampled_from(["30", "30,00", "31"]))


@settings(max_examples=25, deadline=None)
@given(st.lists(keys, min_size=1, max_size=25))
def test_dedup_is_idempotent(spark, rows):
    cols = ["declaration_number", "hs_code", "total_value_usd"]
    data = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "pos long, declaration_number string, hs_code string, total_value_usd string")
    once = D.dedup_in_file(df, ["pos"], cols).drop("occurrences")
    twice = D.dedup_in_file(once, ["pos"], cols).drop("occurrences")
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    # brute force: first position of every trimmed key with a declaration number
    seen, expect = set(), []
    for pos, dn, hs, v in data:
        k = (dn.strip(), hs.strip(), v.strip())
        if k[0] == "" or k in seen:
            continue
        seen.add(k)
        expect.append((pos, dn, hs, v))
    assert a == sorted(expect)
