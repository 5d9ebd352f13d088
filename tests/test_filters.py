"""P10-P19 on the rows of FIXTURES.md §2.6, plus the connector rule as a
property test against a direct transcription of the left-to-right loop."""

import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from tradelens.operators.filters import FilterExpression, FilterOptions, connector_groups, execute_filters

ROWS = [
    ("R1", "USA", "Laptop Dell", 120000.0),
    ("R2", "China", "laptop hp", 40000.0),
    ("R3", "Vietnam", "Gạo", 60000.0),
    ("R4", None, "Tôm", None),
]


def keep(spark, filters, opts=FilterOptions()):
    df = spark.createDataFrame(ROWS, "id string, country string, goods string, value double")
    return sorted(r.id for r in execute_filters(df, filters, opts).collect())


def f(field, op, value, **kw):
    return {"field": field, "operator": op, "value": value, **kw}


def test_single_operators(spark):
    assert keep(spark, [f("country", "equals", "Hoa Kỳ")]) == ["R1"]
    assert keep(spark, [f("goods", "contains", "LAPTOP")]) == ["R1", "R2"]
    assert keep(spark, [f("goods", "startsWith", "lap")]) == ["R1", "R2"]
    assert keep(spark, [f("goods", "contains", "gao")]) == []
    assert keep(spark, [f("goods", "contains", "gao")], FilterOptions(remove_diacritics=True)) == ["R3"]
    assert keep(spark, [f("goods", "contains", "laptob hp", matchStrategy="fuzzy", fuzzyThreshold=2)]) == ["R2"]
    assert keep(spark, [f("value", "greaterThan", 60000)]) == ["R1"]
    assert keep(spark, [f("value", "between", [40000, 60000])]) == ["R2", "R3"]
    assert keep(spark, [f("value", "between", [40000])]) == []
    assert keep(spark, [f("country", "in", ["US", "China"])]) == ["R1", "R2"]
    assert keep(spark, []) == ["R1", "R2", "R3", "R4"]


def test_connectors(spark):
    a = [f("country", "equals", "US", logicalOperator="OR"), f("country", "equals", "China", logicalOperator="AND"), f("value", "greaterThan", 50000)]
    assert keep(spark, a) == ["R1"]
    b = [f("value", "greaterThan", 50000, logicalOperator="AND"), f("country", "equals", "US", logicalOperator="OR"), f("country", "equals", "Vietnam")]
    assert keep(spark, b) == ["R1", "R3"]


def loop(truths, connectors):
    """Direct transcription of the reference's evaluation loop."""
    result, op = True, "AND"
    for t, c in zip(truths, connectors):
        result = (result and t) if op == "AND" else (result or t)
        op = c or "AND"
        if not result and op == "AND":
            return False
    return result


def cnf(truths, connectors):
    fs = [FilterExpression("x", "equals", "v", logical_operator=c) for c in connectors]
    return all(any(truths[i] for i in g) for g in connector_groups(fs))


def test_cnf_equals_loop_exhaustive():
    n = 0
    for k in range(1, 6):
        for truths in itertools.product([False, True], repeat=k):
            for conns in itertools.product([None, "AND", "OR"], repeat=k):
                assert cnf(truths, conns) == loop(truths, conns), (truths, conns)
                n += 1
    assert n > 5000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.sampled_from([None, "AND", "OR"])), min_size=1, max_size=9))
def test_cnf_equals_loop_property(items):
    truths = [t for t, _ in items]
    conns = [c for _, c in items]
    assert cnf(truths, conns) == loop(truths, conns)


def test_camel_case_fields(spark):
    from tradelens.operators import engine as E
    from tradelens.plans.intent import QueryIntent, run_intent

    df = spark.createDataFrame([("A", 10.0, "VN"), ("B", 5.0, "US")], "import_company_name string, total_value_usd double, import_country string")
    assert keep_df(df, [{"field": "importCountry", "operator": "equals", "value": "Việt Nam"}]) == ["A"]
    r = E.group_by(df, "importCompanyName", "totalValueUSD", "sum").collect()
    assert [(x.key, x.value) for x in r] == [("A", 10.0), ("B", 5.0)]
    out = run_intent(df, QueryIntent.of({"type": "detail", "filters": [], "orderBy": {"field": "totalValueUSD", "direction": "asc"}, "confidence": 1}))
    assert [x.import_company_name for x in out.collect()] == ["B", "A"]


def keep_df(df, filters):
    return sorted(r.import_company_name for r in execute_filters(df, filters).collect())
