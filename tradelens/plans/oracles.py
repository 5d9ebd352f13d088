"""DuckDB oracle SQL for the registered queries (same column names)."""

from __future__ import annotations

from tradelens.plans.oracle_base import iso, js_round2, with_star

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = with_star(sql)


_COMPANY_ROLLUP = f"""
, base AS (
  SELECT f.company_id, c.name, c.address,
         COUNT(*) AS total_transactions,
         {js_round2("SUM(f.total_value_usd)")} AS total_import_value,
         {js_round2("SUM(f.quantity)")} AS total_quantity,
         COUNT(DISTINCT f.goods_id) AS unique_goods_count,
         {iso("MIN(f.date)")} AS first_transaction_date,
         {iso("MAX(f.date)")} AS last_transaction_date
  FROM facts f JOIN companies c ON f.company_id = c.company_id
  {{where}}
  GROUP BY f.company_id, c.name, c.address
)
SELECT * FROM base {{having}}
"""

oracle("company_rollup", _COMPANY_ROLLUP.format(where="", having=""))
oracle(
    "company_rollup_page",
    _COMPANY_ROLLUP.format(where="", having="ORDER BY total_quantity ASC, company_id ASC LIMIT 50 OFFSET 50"),
)
oracle(
    "company_rollup_by_category",
    _COMPANY_ROLLUP.format(
        where="WHERE f.date >= TIMESTAMP '1996-01-01' AND f.date <= TIMESTAMP '1998-12-31' "
        "AND f.goods_id IN (SELECT goods_id FROM goods_cat WHERE category = 'PROMO')",
        having="",
    ),
)
oracle(
    "company_search",
    _COMPANY_ROLLUP.format(where="", having="WHERE regexp_matches(name, 'customer#0+1[0-9]', 'i')"),
)

oracle(
    "company_latest_lines",
    f"""
, ranked AS (
  SELECT company_id, declaration_number, line_no, date, goods_id, quantity, total_value_usd,
         row_number() OVER (PARTITION BY company_id ORDER BY date DESC, declaration_number, line_no, goods_id,
                            quantity, total_value_usd, unit_price_usd) AS rank
  FROM facts
)
SELECT r.company_id, r.rank, r.declaration_number, r.line_no, {iso("r.date")} AS date, r.goods_id,
       g.raw_name AS goods_name, coalesce(g.category, '') AS category,
       CAST(r.quantity AS DOUBLE) AS quantity, CAST(r.total_value_usd AS DOUBLE) AS total_value_usd
FROM ranked r LEFT JOIN goods_cat g ON r.goods_id = g.goods_id
WHERE r.rank <= 1000
""",
)

oracle(
    "company_top_goods",
    """
, per AS (
  SELECT company_id, goods_id, SUM(total_value_usd) AS v, SUM(quantity) AS q, COUNT(*) AS n
  FROM facts GROUP BY company_id, goods_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY v DESC, goods_id) AS rank FROM per
)
SELECT r.company_id, r.rank, r.goods_id, g.raw_name AS goods_name, CAST(r.v AS DOUBLE) AS total_value,
       CAST(r.q AS DOUBLE) AS total_quantity, r.n AS transaction_count
FROM ranked r LEFT JOIN goods g ON r.goods_id = g.goods_id
WHERE r.rank <= 10
""",
)

oracle(
    "company_category_share",
    """
, per AS (
  SELECT f.company_id, g.category, SUM(f.total_value_usd) AS v, COUNT(*) AS n
  FROM facts f LEFT JOIN goods_cat g ON f.goods_id = g.goods_id
  GROUP BY f.company_id, g.category
), tot AS (
  SELECT *, CAST(SUM(v) OVER (PARTITION BY company_id) AS DOUBLE) AS t FROM per
)
SELECT company_id, coalesce(category, '') AS category, CAST(v AS DOUBLE) AS total_value, n AS transaction_count,
       CASE WHEN t > 0 THEN CAST(v AS DOUBLE) * 100 / t ELSE 0.0 END AS percentage
FROM tot
""",
)

oracle(
    "company_monthly_trend",
    """
SELECT company_id, strftime(date, '%Y-%m') AS month, CAST(SUM(total_value_usd) AS DOUBLE) AS total_value,
       CAST(SUM(quantity) AS DOUBLE) AS total_quantity, COUNT(*) AS transaction_count
FROM facts GROUP BY company_id, strftime(date, '%Y-%m')
""",
)

oracle(
    "company_top_category",
    """
, per AS (
  SELECT f.company_id, g.category, COUNT(*) AS n
  FROM facts f LEFT JOIN goods_cat g ON f.goods_id = g.goods_id
  GROUP BY f.company_id, g.category
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, category) AS rn FROM per
)
SELECT company_id, category AS most_frequent_category, n AS transaction_count FROM ranked WHERE rn = 1
""",
)

oracle(
    "company_export_countries",
    """
, pc AS (
  SELECT company_id, export_country, SUM(total_value_usd) AS cv FROM facts GROUP BY company_id, export_country
), top AS (
  SELECT company_id, export_country AS top_export_country
  FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY cv DESC, export_country) AS rn FROM pc)
  WHERE rn = 1
), tot AS (
  SELECT company_id, COUNT(DISTINCT export_country) AS total_suppliers,
         COUNT(DISTINCT declaration_number) AS order_count, SUM(total_value_usd) AS v
  FROM facts GROUP BY company_id
)
SELECT t.company_id, t.total_suppliers, t.order_count, CAST(t.v AS DOUBLE) AS total_value,
       CAST(t.v AS DOUBLE) / t.order_count AS average_order_value, top.top_export_country
FROM tot t JOIN top ON t.company_id = top.company_id
""",
)

_GOODS_ROLLUP = f"""
, per AS (
  SELECT goods_id, SUM(quantity) AS q, SUM(total_value_usd) AS v, COUNT(*) AS n, MAX(date) AS last
  FROM facts {{where}} GROUP BY goods_id
)
SELECT g.goods_id, coalesce(g.raw_name, '') AS raw_name, coalesce(g.short_name, '') AS short_name,
       coalesce(g.category, '') AS category, coalesce(g.hs_code, '') AS hs_code,
       CAST(p.q AS DOUBLE) AS total_quantity_exported, CAST(p.v AS DOUBLE) AS total_value_exported,
       p.n AS transaction_count,
       CASE WHEN CAST(p.q AS DOUBLE) > 0 THEN CAST(p.v AS DOUBLE) / CAST(p.q AS DOUBLE) ELSE 0.0 END AS average_price,
       {iso("p.last")} AS last_export_date
FROM goods_cat g JOIN per p ON g.goods_id = p.goods_id
{{goods_where}}
"""
oracle("goods_rollup", _GOODS_ROLLUP.format(where="", goods_where=""))
oracle(
    "goods_rollup_page",
    _GOODS_ROLLUP.format(where="WHERE date >= TIMESTAMP '1998-01-01'", goods_where="")
    + "ORDER BY average_price ASC, g.goods_id ASC LIMIT 20 OFFSET 40",
)
oracle(
    "goods_rollup_filtered",
    _GOODS_ROLLUP.format(
        where="WHERE date >= TIMESTAMP '1997-01-01' AND date <= TIMESTAMP '2000-06-30' "
        "AND company_id IN (SELECT company_id FROM companies WHERE regexp_matches(name, 'customer#0000001[0-4]', 'i'))",
        goods_where="WHERE g.category = 'STANDARD' AND (regexp_matches(g.raw_name, 'ring|bolt', 'i') "
        "OR regexp_matches(coalesce(g.short_name, ''), 'ring|bolt', 'i'))",
    ),
)

oracle(
    "goods_mean_price",
    f"""
, per AS (
  SELECT goods_id, SUM(quantity) AS q, SUM(total_value_usd) AS v, COUNT(*) AS n, AVG(unit_price_usd) AS a,
         MIN(date) AS first, MAX(date) AS last
  FROM facts WHERE date >= TIMESTAMP '1996-01-01' GROUP BY goods_id
)
SELECT g.goods_id, g.raw_name, g.category, CAST(p.q AS DOUBLE) AS total_quantity, CAST(p.v AS DOUBLE) AS total_value,
       p.n AS transaction_count, round(p.a, 6) AS average_unit_price,
       {iso("p.first")} AS first_date, {iso("p.last")} AS last_date
FROM goods_cat g JOIN per p ON g.goods_id = p.goods_id
""",
)

oracle(
    "goods_top_companies",
    """
, per AS (
  SELECT goods_id, company_id, SUM(total_value_usd) AS v, SUM(quantity) AS q, COUNT(*) AS n
  FROM facts GROUP BY goods_id, company_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY goods_id ORDER BY v DESC, company_id) AS rank FROM per
)
SELECT r.goods_id, r.rank, r.company_id, c.name AS company_name, CAST(r.q AS DOUBLE) AS total_quantity,
       CAST(r.v AS DOUBLE) AS total_value, r.n AS transaction_count
FROM ranked r LEFT JOIN companies c ON r.company_id = c.company_id
WHERE r.rank <= 5
""",
)

oracle(
    "goods_monthly_trend",
    """
SELECT goods_id, strftime(date, '%Y-%m') AS month, CAST(SUM(total_value_usd) AS DOUBLE) AS total_value,
       CAST(SUM(quantity) AS DOUBLE) AS total_quantity, COUNT(*) AS transaction_count
FROM facts GROUP BY goods_id, strftime(date, '%Y-%m')
""",
)

oracle(
    "category_rollup",
    """
, pg AS (SELECT goods_id, SUM(total_value_usd) AS v, COUNT(*) AS n FROM facts GROUP BY goods_id)
SELECT g.category, COUNT(*) AS goods_count, CAST(coalesce(SUM(pg.v), 0) AS DOUBLE) AS total_export_value,
       CAST(coalesce(SUM(pg.n), 0) AS BIGINT) AS transaction_count
FROM goods_cat g LEFT JOIN pg ON g.goods_id = pg.goods_id
GROUP BY g.category
""",
)

oracle("category_names", "SELECT name FROM categories WHERE name IS NOT NULL AND name <> '' ORDER BY name")

oracle(
    "dashboard_stats",
    f"""
SELECT (SELECT COUNT(*) FROM companies) AS total_companies,
       (SELECT COUNT(*) FROM goods) AS total_goods,
       (SELECT COUNT(*) FROM facts) AS total_transactions,
       (SELECT CAST(coalesce(SUM(total_value_usd), 0) AS DOUBLE) FROM facts) AS total_value_usd,
       (SELECT COUNT(*) FROM goods WHERE classified_by = 'fallback') AS unclassified_goods,
       (SELECT {iso("MAX(created_at)")} FROM facts) AS last_import_date
""",
)

_TX_VIEW = """
, view AS (
  SELECT f.declaration_number, f.line_no, f.date, f.company_id, coalesce(c.name, '') AS company_name,
         f.goods_id, coalesce(g.raw_name, '') AS goods_name, coalesce(g.short_name, '') AS short_name,
         coalesce(g.category, '') AS category, f.hs_code, f.quantity, f.unit, f.unit_price_usd, f.total_value_usd,
         f.export_country, coalesce(f.import_country, '') AS import_country, f.customs_office
  FROM facts f
  LEFT JOIN companies c ON f.company_id = c.company_id
  LEFT JOIN goods_cat g ON f.goods_id = g.goods_id
  WHERE f.date >= TIMESTAMP '1996-03-01' AND f.date <= TIMESTAMP '1999-10-31' AND f.total_value_usd >= 1000
    AND regexp_matches(c.name, 'customer#0000002[0-9]{2}', 'i') AND g.category = 'MEDIUM'
)
"""
oracle(
    "transactions_page",
    _TX_VIEW
    + f"""
SELECT declaration_number, line_no, {iso("date")} AS date, company_id, company_name, goods_id, goods_name, short_name,
       category, hs_code, CAST(quantity AS DOUBLE) AS quantity, unit, unit_price_usd,
       CAST(total_value_usd AS DOUBLE) AS total_value_usd, export_country, import_country, customs_office
FROM view
ORDER BY total_value_usd DESC, declaration_number, line_no, goods_id, company_id, quantity
LIMIT 50
""",
)
oracle(
    "company_detail_stats",
    f"""
, one AS (SELECT company_id FROM facts GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)
SELECT f.company_id, COUNT(*) AS total_transactions, {js_round2("SUM(f.total_value_usd)")} AS total_import_value,
       {js_round2("SUM(f.quantity)")} AS total_quantity, COUNT(DISTINCT f.goods_id) AS unique_goods_count,
       {iso("MIN(f.date)")} AS first_transaction_date, {iso("MAX(f.date)")} AS last_transaction_date, c.name, c.address
FROM facts f JOIN companies c ON f.company_id = c.company_id WHERE f.company_id = (SELECT company_id FROM one)
GROUP BY f.company_id, c.name, c.address
""",
)
oracle(
    "goods_detail_stats",
    """
, one AS (SELECT goods_id FROM facts GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)
SELECT goods_id, CAST(SUM(quantity) AS DOUBLE) AS total_quantity, CAST(SUM(total_value_usd) AS DOUBLE) AS total_value,
       COUNT(*) AS transaction_count,
       CASE WHEN SUM(quantity) > 0 THEN CAST(SUM(total_value_usd) AS DOUBLE) / CAST(SUM(quantity) AS DOUBLE) ELSE 0 END AS average_price
FROM facts WHERE goods_id = (SELECT goods_id FROM one) GROUP BY goods_id
""",
)
_TX_ALL = _TX_VIEW.split("  WHERE f.date")[0] + ")\n"
_TX_PAGE = f"""
SELECT declaration_number, line_no, {iso("date")} AS date, company_id, company_name, goods_id, goods_name, short_name,
       category, hs_code, CAST(quantity AS DOUBLE) AS quantity, unit, unit_price_usd,
       CAST(total_value_usd AS DOUBLE) AS total_value_usd, export_country, import_country, customs_office
FROM view
ORDER BY total_value_usd DESC, declaration_number, line_no, goods_id, company_id, quantity
"""
oracle("transactions_deep_page", _TX_ALL + _TX_PAGE + "LIMIT 50 OFFSET 19950")
oracle("transactions_next_page", _TX_ALL + _TX_PAGE + "LIMIT 50 OFFSET 1000")
oracle(
    "company_top_export_countries",
    """
, pc AS (
  SELECT company_id, coalesce(export_country, '') AS country, COUNT(*) AS n FROM facts GROUP BY 1, 2
), top AS (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, country) AS rk FROM pc
)
SELECT company_id, string_agg(country || ':' || n, ';' ORDER BY rk) AS top_export_countries FROM top WHERE rk <= 5 GROUP BY company_id
""",
)
oracle(
    "transactions_count",
    _TX_VIEW + "SELECT COUNT(*) AS total, CAST(ceil(COUNT(*) / 50.0) AS BIGINT) AS total_pages FROM view",
)
oracle(
    "transactions_summary",
    _TX_VIEW
    + f"""
, s AS (
  SELECT COUNT(*) AS total, {js_round2("SUM(total_value_usd)")} AS total_value, {js_round2("SUM(quantity)")} AS total_quantity
  FROM view
)
SELECT total, total_value, total_quantity,
       CASE WHEN total_quantity > 0 THEN total_value / total_quantity ELSE 0.0 END AS average_unit_price
FROM s
""",
)


# ---------------------------------------------------------------- aggregation tools

oracle(
    "tool_example_top_importers",
    """
SELECT import_company_raw_name, CAST(SUM(total_value_usd) AS DOUBLE) AS "sum_totalValueUSD"
FROM facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""",
)
oracle(
    "tool_example_average",
    """
SELECT goods_raw_name, unit, CAST(SUM(total_value_usd) AS DOUBLE) / COUNT(total_value_usd) AS "avgPrice", CAST(SUM(quantity) AS DOUBLE) AS "totalQty"
FROM facts WHERE year = 1997 AND import_country = 'NATION_3' GROUP BY 1, 2
""",
)
oracle(
    "tool_aggregate",
    """
SELECT import_country, payment_method,
       CAST(coalesce(SUM(total_value_usd), 0) AS DOUBLE) AS sum_total_value_usd,
       CAST(SUM(quantity) AS DOUBLE) / COUNT(quantity) AS avg_quantity,
       CAST(COUNT(*) AS DOUBLE) AS lines,
       CAST(MIN(quantity) AS DOUBLE) AS min_quantity,
       CAST(MAX(total_value_usd) AS DOUBLE) AS max_total_value_usd
FROM facts
WHERE year >= 1997 AND delivery_terms IN ('A', 'N')
GROUP BY import_country, payment_method
ORDER BY sum_total_value_usd DESC, import_country, payment_method
LIMIT 20 OFFSET 5
""",
)
oracle(
    "tool_sum_field",
    "SELECT CAST(coalesce(SUM(total_value_usd), 0) AS DOUBLE) AS sum_total_value_usd FROM facts WHERE customs_office = 'ASIA'",
)
oracle(
    "tool_avg_field",
    "SELECT coalesce(CAST(SUM(quantity) AS DOUBLE) / COUNT(quantity), 0) AS avg_quantity FROM facts WHERE year = 1998",
)
oracle("tool_count", "SELECT COUNT(*) AS count FROM facts WHERE transport_mode = 'O'")
oracle(
    "tool_top_by_field",
    """
SELECT import_company_raw_name, CAST(coalesce(SUM(total_value_usd), 0) AS DOUBLE) AS sum_total_value_usd
FROM facts GROUP BY import_company_raw_name
ORDER BY sum_total_value_usd DESC, import_company_raw_name LIMIT 10
""",
)
oracle(
    "tool_count_and_group",
    "SELECT COUNT(*) AS group_count FROM (SELECT customs_office, payment_method FROM facts GROUP BY ALL)",
)
oracle(
    "tool_distinct_values",
    "SELECT value FROM (SELECT DISTINCT hs_code AS value FROM facts ORDER BY value NULLS FIRST LIMIT 10) WHERE value IS NOT NULL",
)
oracle(
    "match_document",
    """
SELECT declaration_number, line_no, goods_id, customs_office, export_type, CAST(quantity AS DOUBLE) AS quantity,
       payment_method, tax_rate
FROM facts
WHERE (customs_office = 'ASIA' OR regexp_matches(export_type, '^auto', 'i'))
  AND quantity >= 10 AND quantity < 20
  AND NOT coalesce(payment_method IN ('1-URGENT') OR payment_method IS NULL, false)
  AND NOT coalesce(tax_rate > 0.05, false)
""",
)

# ---------------------------------------------------------------- filter engine

_ENGINE_VIEW = """
, ev AS (
  SELECT f.declaration_number, f.date, c.name AS import_company_name, c.address AS import_company_address,
         g.category AS category_name, f.import_country, f.customs_office, g.raw_name AS goods_name, f.quantity, f.unit,
         f.unit_price_usd, f.total_value_usd, f.month
  FROM facts f
  LEFT JOIN companies c ON f.company_id = c.company_id
  LEFT JOIN goods_cat g ON f.goods_id = g.goods_id
)
"""
_SHOW = f"""
SELECT declaration_number, {iso("date")} AS date, import_company_name, import_company_address, category_name,
       import_country, customs_office, goods_name, CAST(quantity AS DOUBLE) AS quantity, unit, unit_price_usd,
       CAST(total_value_usd AS DOUBLE) AS total_value_usd, month
FROM ev
"""


def _norm(expr: str) -> str:
    return f"lower(regexp_replace(trim({expr}), '\\s+', ' ', 'g'))"


# normalised variants of the United States synonym group
_US = ["us", "usa", "united states", "hoa kỳ", "america", "u.s.", "u.s.a"]


def _in_group(n: str, variants) -> str:
    parts = [f"({n} = '{v}' OR contains({n}, '{v}') OR contains('{v}', {n}))" for v in variants]
    return "(" + " OR ".join(parts) + ")"


_CO = _norm("customs_office")
oracle("filter_equals", _ENGINE_VIEW + _SHOW + f"WHERE customs_office IS NOT NULL AND ({_CO} = 'usa' OR {_in_group(_CO, _US)})")
oracle("filter_contains", _ENGINE_VIEW + _SHOW + f"WHERE goods_name IS NOT NULL AND contains({_norm('goods_name')}, 'ring')")
oracle("filter_single", _ENGINE_VIEW + _SHOW + f"WHERE goods_name IS NOT NULL AND contains({_norm('goods_name')}, 'ring')")
oracle("filter_starts_with", _ENGINE_VIEW + _SHOW + f"WHERE goods_name IS NOT NULL AND starts_with({_norm('goods_name')}, 'red')")
oracle(
    "filter_greater_less",
    _ENGINE_VIEW + _SHOW + "WHERE CAST(total_value_usd AS DOUBLE) > 50000 AND CAST(quantity AS DOUBLE) < 10",
)
oracle(
    "filter_between",
    _ENGINE_VIEW
    + _SHOW
    + "WHERE unit_price_usd >= 1000 AND unit_price_usd <= 1500 "
    "AND date >= TIMESTAMP '1997-01-01' AND date <= TIMESTAMP '1997-12-31'",
)
oracle(
    "filter_in",
    _ENGINE_VIEW + _SHOW + f"WHERE customs_office IS NOT NULL AND ({_CO} = 'europe' OR {_CO} = 'us' OR {_in_group(_CO, _US)})",
)
_GN = _norm("goods_name")
oracle(
    "filter_fuzzy",
    _ENGINE_VIEW
    + _SHOW
    + f"WHERE goods_name IS NOT NULL AND (levenshtein({_GN}, 'smal rng') <= 2 OR contains({_GN}, 'smal rng') "
    f"OR contains('smal rng', {_GN}))",
)
_CNF_US = f"({_CO} = 'us' OR {_in_group(_CO, _US)})"
_CNF_ASIA = f"({_CO} = 'asia')"
_CNF_VALUE = "(CAST(total_value_usd AS DOUBLE) > 50000)"
oracle(
    "filter_cnf",
    _ENGINE_VIEW + _SHOW + f"WHERE customs_office IS NOT NULL AND ({_CNF_US} OR {_CNF_ASIA}) AND {_CNF_VALUE}",
)
oracle(
    "filter_audit",
    _ENGINE_VIEW
    + f"""
, c AS (
  SELECT COUNT(*) AS total,
         count_if(customs_office IS NOT NULL AND {_CNF_US}) AS m0,
         count_if(customs_office IS NOT NULL AND {_CNF_ASIA}) AS m1,
         count_if({_CNF_VALUE}) AS m2,
         count_if(customs_office IS NOT NULL AND {_CNF_US}) AS c0,
         count_if(customs_office IS NOT NULL AND ({_CNF_US} OR {_CNF_ASIA})) AS c1,
         count_if(customs_office IS NOT NULL AND ({_CNF_US} OR {_CNF_ASIA}) AND {_CNF_VALUE}) AS c2
  FROM ev
)
SELECT 1::BIGINT AS iteration, 'customs_office' AS field, 'equals' AS operator, 'customs_office equals ''US''' AS criteria,
       m0 AS matched_count, c0 AS cumulative_count, total AS total_count FROM c
UNION ALL
SELECT 2, 'customs_office', 'equals', 'customs_office equals ''Asia''', m1, c1, total FROM c
UNION ALL
SELECT 3, 'total_value_usd', 'greaterThan', 'total_value_usd greaterThan 50000', m2, c2, total FROM c
""",
)

oracle(
    "filter_audit_sample",
    f"""
, ln AS (SELECT date, declaration_number, goods_id, quantity, customs_office, total_value_usd FROM facts),
hit AS (
  SELECT 1::BIGINT AS iteration, * FROM ln WHERE customs_office IS NOT NULL AND {_CNF_US}
  UNION ALL SELECT 2, * FROM ln WHERE customs_office IS NOT NULL AND {_CNF_ASIA}
  UNION ALL SELECT 3, * FROM ln WHERE {_CNF_VALUE}
), rk AS (SELECT *, row_number() OVER (PARTITION BY iteration ORDER BY date, declaration_number, goods_id, quantity) AS rank FROM hit)
SELECT iteration, rank, {iso("date")} AS date, declaration_number, goods_id, CAST(quantity AS DOUBLE) AS quantity, customs_office,
       CAST(total_value_usd AS DOUBLE) AS total_value_usd
FROM rk WHERE rank <= 5
""",
)

# ---------------------------------------------------------------- engine aggregates

_KEY_IC = "CASE WHEN import_country IS NULL OR import_country = '' THEN 'Unknown' ELSE import_country END"
_KEY_CAT = "CASE WHEN category_name IS NULL OR category_name = '' THEN 'Unknown' ELSE category_name END"
_KEY_CO = "CASE WHEN import_company_name IS NULL OR import_company_name = '' THEN 'Unknown' ELSE import_company_name END"
_KEY_GOODS = "CASE WHEN goods_name IS NULL OR goods_name = '' THEN 'Unknown' ELSE goods_name END"
_V = "coalesce(total_value_usd, 0)"

oracle(
    "agg_js_grouped",
    _ENGINE_VIEW + f"SELECT {_KEY_IC} AS key, CAST(SUM({_V}) AS DOUBLE) AS value, COUNT(*) AS count FROM ev GROUP BY 1",
)
oracle(
    "agg_total",
    _ENGINE_VIEW
    + "SELECT 'Total' AS key, coalesce(CAST(SUM(coalesce(quantity, 0)) AS DOUBLE) / COUNT(*), 0.0) AS value, COUNT(*) AS count FROM ev",
)
oracle(
    "agg_multi_spec",
    _ENGINE_VIEW
    + f"""
, bycat AS (
  SELECT {_KEY_CAT} AS key, CAST(SUM({_V}) AS DOUBLE) AS s, CAST(COUNT(*) AS DOUBLE) AS n,
         MAX(coalesce(unit_price_usd, 0.0)) AS mx, COUNT(*) AS count
  FROM ev GROUP BY 1
), byic AS (
  SELECT {_KEY_IC} AS key, CAST(SUM(coalesce(quantity, 0)) AS DOUBLE) / COUNT(*) AS a, COUNT(*) AS count FROM ev GROUP BY 1
), tot AS (
  SELECT 'Total' AS key, coalesce(CAST(MIN(coalesce(quantity, 0)) AS DOUBLE), 0.0) AS mn, COUNT(*) AS count FROM ev
)
SELECT 0::BIGINT AS spec_id, key, s AS value, count FROM bycat
UNION ALL SELECT 1, key, n, count FROM bycat
UNION ALL SELECT 2, key, mx, count FROM bycat
UNION ALL SELECT 3, key, a, count FROM byic
UNION ALL SELECT 4, key, mn, count FROM tot
""",
)
_CACHE = (
    _ENGINE_VIEW
    + f"""
, base AS (
  SELECT {_KEY_CO} AS company, {_KEY_CAT} AS category, {_KEY_IC} AS country, {_KEY_GOODS} AS goods,
         strftime(date, '%Y-%m') AS month, {_V} AS v
  FROM ev
), cache AS (
  SELECT 'importCompany' AS dim, company AS key, CAST(SUM(v) AS DOUBLE) AS value, COUNT(*) AS count FROM base GROUP BY company
  UNION ALL SELECT 'category', category, CAST(SUM(v) AS DOUBLE), COUNT(*) FROM base GROUP BY category
  UNION ALL SELECT 'country', country, CAST(SUM(v) AS DOUBLE), COUNT(*) FROM base GROUP BY country
  {{extra}}
  UNION ALL SELECT 'month', month, CAST(SUM(v) AS DOUBLE), COUNT(*) FROM base WHERE month IS NOT NULL GROUP BY month
)
"""
)
oracle(
    "agg_cache",
    _CACHE.format(
        extra="UNION ALL SELECT 'goods', goods, CAST(SUM(v) AS DOUBLE), COUNT(*) FROM base GROUP BY goods "
        "UNION ALL SELECT 'total', 'Total', CAST(SUM(v) AS DOUBLE), COUNT(*) FROM base"
    )
    + "SELECT * FROM cache",
)
oracle(
    "agg_cache_top_n",
    _CACHE.format(extra="") + "SELECT * FROM cache WHERE dim = 'importCompany' ORDER BY value DESC, key LIMIT 10",
)
ORACLES["agg_cache_stored"], ORACLES["agg_cache_stored_top_n"] = ORACLES["agg_cache"], ORACLES["agg_cache_top_n"]
oracle(
    "time_series_month",
    _ENGINE_VIEW
    + f"""SELECT strftime(date, '%Y-%m') AS month, CAST(SUM({_V}) AS DOUBLE) AS value, COUNT(*) AS count
FROM ev WHERE date IS NOT NULL GROUP BY 1 ORDER BY 1""",
)
oracle(
    "full_data_points",
    _ENGINE_VIEW
    + f"""SELECT {_KEY_CAT} AS key, COUNT(*) AS count, CAST(SUM({_V}) AS DOUBLE) AS sum,
       CAST(SUM({_V}) AS DOUBLE) / COUNT(*) AS average, CAST(MIN({_V}) AS DOUBLE) AS min, CAST(MAX({_V}) AS DOUBLE) AS max
FROM ev GROUP BY 1""",
)
oracle(
    "summary_lines",
    _ENGINE_VIEW
    + f"""
, g AS (SELECT {_KEY_IC} AS key, CAST(SUM({_V}) AS DOUBLE) AS value, COUNT(*) AS count FROM ev GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, key) AS rk FROM g)
SELECT 'Total by import_country' || chr(10)
       || string_agg('  ' || key || ': $' || format('{{:,}}', CAST(round(value) AS BIGINT))
                     || CASE WHEN count > 0 THEN ' (' || count || ' txns)' ELSE '' END, chr(10) ORDER BY rk)
            FILTER (WHERE rk <= 20)
       || chr(10) || 'Total records: ' || SUM(count)
       || CASE WHEN COUNT(*) > 20 THEN ', showing top 20 of ' || COUNT(*) ELSE '' END AS text
FROM r
""",
)


# ---------------------------------------------------------------- import de-duplication

_KEYS = "declaration_number, hs_code, goods_raw_name, import_company_raw_name, total_value_usd, usd_rate, payment_method, delivery_terms"
_KEYTXT = ", ".join(
    f"coalesce(trim(CAST({k} AS VARCHAR)), '')"
    for k in ["declaration_number", "hs_code", "goods_raw_name", "import_company_raw_name", "total_value_usd", "usd_rate", "payment_method", "delivery_terms"]
)
_BATCH = f"""
, b0 AS (
  SELECT {_KEYS}, line_no, goods_id, supplier_id, quantity, date FROM facts
), batch AS (
  SELECT *, 0 AS file_no FROM b0
  UNION ALL
  SELECT *, 1 AS file_no FROM b0 WHERE substr(md5(declaration_number), 2, 1) < '6'
), stored AS (
  SELECT * FROM b0 WHERE substr(md5(declaration_number), 1, 1) < '8' AND substr(md5(goods_raw_name), 1, 1) >= '3'
    AND substr(md5(import_company_raw_name), 1, 1) >= '1'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {_KEYTXT} ORDER BY file_no, declaration_number, line_no, goods_id, supplier_id, quantity) AS rn,
         COUNT(*) OVER (PARTITION BY {_KEYTXT}) AS occurrences
  FROM batch WHERE coalesce(trim(declaration_number), '') <> ''
), uniq AS (
  SELECT {_KEYS}, line_no, goods_id, supplier_id, quantity, date, file_no FROM ranked WHERE rn = 1
), new_rows AS (
  SELECT * FROM uniq u WHERE NOT EXISTS (
    SELECT 1 FROM stored s WHERE s.declaration_number IS NOT DISTINCT FROM u.declaration_number
      AND s.hs_code IS NOT DISTINCT FROM u.hs_code AND s.goods_raw_name IS NOT DISTINCT FROM u.goods_raw_name
      AND s.import_company_raw_name IS NOT DISTINCT FROM u.import_company_raw_name
      AND s.total_value_usd IS NOT DISTINCT FROM u.total_value_usd AND s.usd_rate IS NOT DISTINCT FROM u.usd_rate
      AND s.payment_method IS NOT DISTINCT FROM u.payment_method AND s.delivery_terms IS NOT DISTINCT FROM u.delivery_terms)
), new_companies AS (
  SELECT DISTINCT import_company_raw_name AS name, '' AS address FROM new_rows
  WHERE import_company_raw_name NOT IN (SELECT import_company_raw_name FROM stored)
), new_goods AS (
  SELECT raw_name, hs_code FROM (
    SELECT goods_raw_name AS raw_name, hs_code,
           row_number() OVER (PARTITION BY goods_raw_name ORDER BY file_no, declaration_number, line_no, goods_id, supplier_id, quantity) AS rn
    FROM new_rows) WHERE rn = 1 AND raw_name NOT IN (SELECT goods_raw_name FROM stored)
)
"""
_BATCH_SHOW = f"""declaration_number, hs_code, goods_raw_name, import_company_raw_name, CAST(total_value_usd AS DOUBLE) AS total_value_usd,
       CAST(usd_rate AS DOUBLE) AS usd_rate, payment_method, delivery_terms, line_no, goods_id, supplier_id,
       CAST(quantity AS DOUBLE) AS quantity, {iso("date")} AS date, file_no"""

oracle("dedup_in_file", _BATCH + f"SELECT {_BATCH_SHOW}, occurrences FROM ranked WHERE rn = 1")
oracle("dedup_report", _BATCH + f"SELECT {_BATCH_SHOW}, occurrences AS duplicate_count FROM ranked WHERE rn > 1")
oracle(
    "dedup_against_table",
    _BATCH
    + f"""SELECT {_BATCH_SHOW}, 'new' AS status FROM new_rows
UNION ALL
SELECT {_BATCH_SHOW}, 'existing' AS status FROM uniq u WHERE EXISTS (
    SELECT 1 FROM stored s WHERE s.declaration_number IS NOT DISTINCT FROM u.declaration_number
      AND s.hs_code IS NOT DISTINCT FROM u.hs_code AND s.goods_raw_name IS NOT DISTINCT FROM u.goods_raw_name
      AND s.import_company_raw_name IS NOT DISTINCT FROM u.import_company_raw_name
      AND s.total_value_usd IS NOT DISTINCT FROM u.total_value_usd AND s.usd_rate IS NOT DISTINCT FROM u.usd_rate
      AND s.payment_method IS NOT DISTINCT FROM u.payment_method AND s.delivery_terms IS NOT DISTINCT FROM u.delivery_terms)""",
)
oracle(
    "existing_declarations",
    _BATCH + "SELECT DISTINCT declaration_number FROM batch WHERE declaration_number IN (SELECT declaration_number FROM stored)",
)
oracle(
    "dedup_summary",
    _BATCH
    + """
, s AS (
  SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE rn = 1) AS unique_rows FROM ranked
)
SELECT total_rows, unique_rows, total_rows - unique_rows AS duplicate_rows,
       printf('%.2f', round(CASE WHEN total_rows > 0 THEN (total_rows - unique_rows) * 100.0 / total_rows ELSE 0.0 END, 2)) || '%' AS duplicate_rate
FROM s
""",
)
oracle("dim_company_new", _BATCH + "SELECT name, address FROM new_companies")
oracle(
    "dim_goods_new",
    _BATCH
    + """SELECT raw_name, hs_code,
       CASE
         WHEN length(raw_name) <= 100 THEN raw_name
         WHEN strpos(raw_name, ',') - 1 > 20 AND strpos(raw_name, ',') - 1 < 100 THEN trim(substr(raw_name, 1, strpos(raw_name, ',') - 1))
         WHEN strpos(raw_name, ';') - 1 > 20 AND strpos(raw_name, ';') - 1 < 100 THEN trim(substr(raw_name, 1, strpos(raw_name, ';') - 1))
         WHEN strpos(raw_name, '-') - 1 > 20 AND strpos(raw_name, '-') - 1 < 100 THEN trim(substr(raw_name, 1, strpos(raw_name, '-') - 1))
         WHEN strpos(raw_name, '(') - 1 > 20 AND strpos(raw_name, '(') - 1 < 100 THEN trim(substr(raw_name, 1, strpos(raw_name, '(') - 1))
         ELSE substr(raw_name, 1, 97) || '...'
       END AS short_name,
       'Other' AS category, 'fallback' AS classified_by
FROM new_goods""",
)
oracle(
    "import_summary",
    _BATCH
    + """
SELECT (SELECT COUNT(*) FROM batch) AS total_rows,
       (SELECT COUNT(*) FROM batch) AS valid_rows,
       0::BIGINT AS invalid_rows,
       (SELECT COUNT(*) FROM batch) - (SELECT COUNT(*) FROM uniq) AS duplicates_in_file,
       (SELECT COUNT(*) FROM uniq) - (SELECT COUNT(*) FROM new_rows) AS duplicates_in_db,
       (SELECT COUNT(*) FROM new_rows) AS imported_rows,
       (SELECT COUNT(*) FROM new_companies) AS new_companies,
       (SELECT COUNT(*) FROM new_goods) AS new_goods,
       (SELECT COUNT(DISTINCT goods_raw_name) FROM new_rows WHERE goods_raw_name IN (SELECT goods_raw_name FROM stored))
         AS existing_goods_reused
""",
)


# ---------------------------------------------------------------- the CSV import in one plan

_ROWS = """
, rows AS (
  SELECT declaration_number, CAST(declaration_number AS BIGINT) * 8 + line_no AS pos, year + 25 AS y, month AS m, day AS d,
         make_date(year + 25, month, 1) + CAST(day - 1 AS INTEGER) AS dt, import_company_raw_name, goods_raw_name, hs_code, unit,
         quantity, total_value_usd, usd_rate, tax_rate, payment_method, export_country, import_country, customs_office,
         CASE delivery_terms WHEN 'A' THEN 'FOB' WHEN 'N' THEN 'CIF' ELSE 'CFR' END AS delivery_terms, md5(declaration_number) AS h
  FROM facts
)
"""
_FAULT = "substr(h, {at}, 1) = '0'"
_ANY_FAULT = " OR ".join(_FAULT.format(at=i) for i in range(1, 8))
_KEY8 = "declaration_number, hs_code, goods_raw_name, import_company_raw_name, total_value_usd, usd_rate, payment_method, delivery_terms"

oracle(
    "import_parsed_cells",
    _ROWS
    + f"""SELECT declaration_number, pos AS line_no, {iso("CAST(dt AS TIMESTAMP)")} AS date, CAST(y AS INTEGER) AS year, m AS month, d AS day,
       delivery_terms, hs_code, CAST(quantity AS DOUBLE) AS quantity, CAST(total_value_usd AS DOUBLE) AS total_value_usd,
       CAST(usd_rate AS DOUBLE) AS usd_rate, CAST(tax_rate AS DOUBLE) AS tax_rate
FROM rows""",
)
_FAULTS = (
    ("Năm", "Năm không hợp lệ: 1999"),
    ("Tháng", "Tháng không hợp lệ: 13"),
    ("Ngày", "Ngày không hợp lệ: x"),
    ("Số Lượng", "Giá trị số không hợp lệ: Số Lượng"),
    ("Trị giá USD", "Giá trị không thể âm: Trị giá USD"),
    ("Điều kiện giao hàng", "Điều kiện giao hàng không hợp lệ: XYZ"),
    ("HS code", "Trường bắt buộc trống: HS code"),
)
oracle(
    "import_issue_counts",
    _ROWS
    + " UNION ALL ".join(
        f"SELECT '{field}' AS field, '{message}' AS message, 'error' AS severity, COUNT(*) AS issues, COUNT(DISTINCT pos) AS lines FROM rows WHERE {_FAULT.format(at=i)} HAVING COUNT(*) > 0"
        for i, (field, message) in enumerate(_FAULTS, start=1)
    ),
)
oracle(
    "csv_round_trip",
    _ROWS
    + f"""SELECT declaration_number, {iso("CAST(dt AS TIMESTAMP)")} AS date, CAST(y AS INTEGER) AS year, m AS month, d AS day,
       delivery_terms, hs_code, CAST(quantity AS DOUBLE) AS quantity, CAST(total_value_usd AS DOUBLE) AS total_value_usd,
       CAST(usd_rate AS DOUBLE) AS usd_rate, CAST(tax_rate AS DOUBLE) AS tax_rate, 24::BIGINT AS raw_cells, declaration_number AS raw_number, unit AS raw_unit
FROM rows""",
)
oracle(
    "csv_dry_run",
    _ROWS
    + "SELECT false AS valid, (SELECT COUNT(*) FROM rows) AS total_rows, true AS required_columns_present, "
    + " + ".join(f"(SELECT COUNT(*) FROM rows WHERE {_FAULT.format(at=i)})" for i in range(1, len(_FAULTS) + 1))
    + " AS error_count",
)
oracle("dim_category_new", "SELECT DISTINCT category AS name FROM goods_cat WHERE category IS NOT NULL AND category NOT IN (SELECT name FROM categories WHERE substr(md5(name), 1, 1) < '8')")
oracle(
    "import_errors",
    _ROWS
    + " UNION ALL ".join(
        f"SELECT CAST(pos AS BIGINT) AS row, declaration_number, '{field}' AS field, '{message}' AS message FROM rows WHERE {_FAULT.format(at=i)}"
        for i, (field, message) in enumerate(_FAULTS, start=1)
    ),
)
oracle(
    "import_quarantine_summary",
    _ROWS
    + f"""
, good AS (SELECT * FROM rows WHERE NOT ({_ANY_FAULT})),
uniq AS (SELECT DISTINCT {_KEY8} FROM good)
SELECT (SELECT COUNT(*) FROM rows) AS total_rows, (SELECT COUNT(*) FROM good) AS valid_rows,
       (SELECT COUNT(*) FROM rows) - (SELECT COUNT(*) FROM good) AS invalid_rows,
       (SELECT COUNT(*) FROM good) - (SELECT COUNT(*) FROM uniq) AS duplicates_in_file, 0::BIGINT AS duplicates_in_db,
       (SELECT COUNT(*) FROM uniq) AS imported_rows,
       (SELECT COUNT(DISTINCT import_company_raw_name) FROM uniq) AS new_companies,
       (SELECT COUNT(DISTINCT goods_raw_name) FROM uniq) AS new_goods, 0::BIGINT AS existing_goods_reused""",
)
oracle(
    "import_transactions_page",
    _ROWS
    + f"""
, uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY8} ORDER BY pos) AS rn FROM rows) WHERE rn = 1)
SELECT declaration_number, pos AS line_no, {iso("CAST(dt AS TIMESTAMP)")} AS date, import_company_raw_name AS company_name,
       goods_raw_name AS goods_name, (SELECT any_value(g.short_name) FROM goods g WHERE g.raw_name = goods_raw_name) AS short_name,
       'Other' AS category, hs_code, CAST(quantity AS DOUBLE) AS quantity, unit, CAST(total_value_usd AS DOUBLE) AS total_value_usd,
       export_country, import_country, customs_office
FROM uniq ORDER BY total_value_usd DESC, declaration_number, pos LIMIT 100""",
)


oracle(
    "import_overlapping",
    _ROWS
    + f"""
, uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY8} ORDER BY pos) AS rn FROM rows) WHERE rn = 1)
SELECT import_company_raw_name AS company, COUNT(*) AS lines, COUNT(DISTINCT goods_raw_name) AS goods,
       COUNT(DISTINCT declaration_number) AS declarations
FROM uniq GROUP BY 1""",
)

# ---------------------------------------------------------------- profile, growth, comparisons

oracle(
    "load_profile",
    f"""
, ws AS (
  SELECT f.date, c.name AS company_name, g.category, f.total_value_usd
  FROM facts f LEFT JOIN companies c ON f.company_id = c.company_id LEFT JOIN goods_cat g ON f.goods_id = g.goods_id
  WHERE f.date >= TIMESTAMP '1998-01-01' AND f.date <= TIMESTAMP '1998-12-31' AND g.category IN ('PROMO', 'LARGE')
), tc AS (
  SELECT company_name AS k, COUNT(*) AS n FROM ws GROUP BY 1 ORDER BY n DESC, k LIMIT 3
), tg AS (
  SELECT category AS k, COUNT(*) AS n FROM ws GROUP BY 1 ORDER BY n DESC, k LIMIT 3
)
SELECT (SELECT COUNT(*) FROM ws) AS record_count,
       (SELECT {iso("MIN(date)")} FROM ws) AS date_from,
       (SELECT {iso("MAX(date)")} FROM ws) AS date_to,
       (SELECT CAST(coalesce(SUM(total_value_usd), 0) AS DOUBLE) FROM ws) AS total_value,
       (SELECT string_agg(k, ', ' ORDER BY n DESC, k) FROM tc) AS top_companies,
       (SELECT string_agg(k, ', ' ORDER BY n DESC, k) FROM tg) AS top_categories
""",
)
oracle(
    "recent_six_months",
    """
SELECT f.company_id, CAST(SUM(f.total_value_usd) AS DOUBLE) AS total_value, COUNT(*) AS transaction_count, c.name AS company_name
FROM facts f LEFT JOIN companies c ON f.company_id = c.company_id
WHERE f.date >= (SELECT MAX(date) FROM facts) - INTERVAL 6 MONTH
GROUP BY f.company_id, c.name
""",
)
oracle(
    "category_growth",
    """
, m AS (
  SELECT g.category, strftime(f.date, '%Y-%m') AS month, SUM(f.total_value_usd) AS v
  FROM facts f LEFT JOIN goods_cat g ON f.goods_id = g.goods_id GROUP BY 1, 2
), l AS (
  SELECT *, lag(v) OVER (PARTITION BY category ORDER BY month) AS p FROM m
)
SELECT category, month, CAST(v AS DOUBLE) AS total_value, CAST(p AS DOUBLE) AS previous_value,
       CASE WHEN p > 0 THEN (CAST(v AS DOUBLE) - CAST(p AS DOUBLE)) * 100 / CAST(p AS DOUBLE) END AS growth_pct
FROM l
""",
)
oracle(
    "compare_companies",
    """
, t AS (
  SELECT company_id, SUM(total_value_usd) AS tv FROM facts GROUP BY 1
), top2 AS (
  SELECT company_id, row_number() OVER (ORDER BY tv DESC, company_id) AS r FROM t ORDER BY tv DESC, company_id LIMIT 2
)
SELECT strftime(f.date, '%Y-%m') AS month,
       CAST(coalesce(SUM(CASE WHEN r = 1 THEN total_value_usd END), 0) AS DOUBLE) AS first_value,
       CAST(coalesce(SUM(CASE WHEN r = 2 THEN total_value_usd END), 0) AS DOUBLE) AS second_value,
       count_if(r = 1) AS first_count, count_if(r = 2) AS second_count
FROM facts f JOIN top2 ON f.company_id = top2.company_id
GROUP BY 1
""",
)
oracle(
    "recommend_companies",
    """
, per AS (
  SELECT g.category, f.company_id, SUM(f.total_value_usd) AS v, COUNT(*) AS n
  FROM facts f LEFT JOIN goods_cat g ON f.goods_id = g.goods_id GROUP BY 1, 2
), r AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY v DESC, company_id) AS rank FROM per
)
SELECT r.category, r.rank, r.company_id, c.name AS company_name, CAST(r.v AS DOUBLE) AS total_value, r.n AS transaction_count
FROM r LEFT JOIN companies c ON r.company_id = c.company_id
WHERE r.rank <= 5
""",
)

# ---------------------------------------------------------------- intents and the eight questions


def _ranked(key_expr: str, value_expr: str, where: str = "", limit: int | None = None, spec_id: int = 0) -> str:
    lim = f"WHERE rk <= {limit}" if limit else ""
    return f"""
SELECT {spec_id}::BIGINT AS spec_id, key, value, count{", rk AS rank" if limit else ""} FROM (
  SELECT *, row_number() OVER (ORDER BY value DESC, key) AS rk FROM (
    SELECT {key_expr} AS key, {value_expr} AS value, COUNT(*) AS count FROM ev {where} GROUP BY 1
  )
) {lim}
"""


_KEY_CO2 = _KEY_CO
_KEY_GN = _KEY_GOODS
oracle(
    "intent_aggregation",
    _ENGINE_VIEW
    + f"""
, flt AS (SELECT * FROM ev WHERE customs_office IS NOT NULL AND ({_CO} = 'asia' OR {_CO} = 'europe'))
SELECT 0::BIGINT AS spec_id, {_KEY_CAT} AS key, CAST(SUM({_V}) AS DOUBLE) AS value, COUNT(*) AS count FROM flt GROUP BY 2
UNION ALL
SELECT 1::BIGINT, {_KEY_CAT}, CAST(SUM(coalesce(quantity, 0)) AS DOUBLE) / COUNT(*), COUNT(*) FROM flt GROUP BY 2
""",
)
oracle(
    "intent_detail",
    _ENGINE_VIEW
    + f"""
SELECT declaration_number, {iso("date")} AS date, import_company_name, import_company_address, category_name, import_country,
       customs_office, goods_name, CAST(quantity AS DOUBLE) AS quantity, unit, unit_price_usd,
       CAST(total_value_usd AS DOUBLE) AS total_value_usd, month
FROM ev
WHERE goods_name IS NOT NULL AND contains({_norm('goods_name')}, 'gear') AND CAST(total_value_usd AS DOUBLE) > 90000
ORDER BY total_value_usd DESC, declaration_number, date, import_company_name, import_company_address, category_name,
         import_country, customs_office, goods_name, quantity, unit, unit_price_usd, month
LIMIT 50
""",
)
oracle(
    "intent_trend",
    _ENGINE_VIEW
    + f"""SELECT strftime(date, '%Y-%m') AS month, CAST(SUM({_V}) AS DOUBLE) AS value, COUNT(*) AS count
FROM ev WHERE category_name IS NOT NULL AND {_norm('category_name')} = 'economy' AND date IS NOT NULL GROUP BY 1""",
)
oracle("question_importers_by_value", _ENGINE_VIEW + _ranked(_KEY_CO, f"CAST(SUM({_V}) AS DOUBLE)", limit=10))
oracle("question_importers_by_count", _ENGINE_VIEW + _ranked(_KEY_CO, "CAST(COUNT(*) AS DOUBLE)", limit=10))
oracle("question_items_by_quantity", _ENGINE_VIEW + _ranked(_KEY_GOODS, "CAST(SUM(coalesce(quantity, 0)) AS DOUBLE)", limit=10))
oracle("question_items_by_value", _ENGINE_VIEW + _ranked(_KEY_GOODS, f"CAST(SUM({_V}) AS DOUBLE)", limit=10))
oracle("question_items_by_transactions", _ENGINE_VIEW + _ranked(_KEY_GOODS, "CAST(COUNT(*) AS DOUBLE)", limit=10))
oracle(
    "question_total_value",
    _ENGINE_VIEW + f"SELECT 0::BIGINT AS spec_id, 'Total' AS key, coalesce(CAST(SUM({_V}) AS DOUBLE), 0.0) AS value, COUNT(*) AS count FROM ev",
)
oracle(
    "question_monthly_trend",
    _ENGINE_VIEW
    + f"SELECT strftime(date, '%Y-%m') AS month, CAST(SUM({_V}) AS DOUBLE) AS value, COUNT(*) AS count FROM ev WHERE date IS NOT NULL GROUP BY 1",
)
oracle(
    "question_importers_for_country",
    _ENGINE_VIEW
    + _ranked(
        _KEY_CO,
        f"CAST(SUM({_V}) AS DOUBLE)",
        where=f"WHERE import_country IS NOT NULL AND {_norm('import_country')} = 'nation_7'",
        limit=10,
    ),
)

oracle(
    "data_sufficiency",
    _ENGINE_VIEW
    + """SELECT COUNT(*) >= 100 AS is_sufficient, true AS is_complete, COUNT(*) AS record_count,
       CAST([] AS VARCHAR[]) AS missing_fields,
       CASE WHEN COUNT(*) < 100 THEN [printf('only %d records (need 100)', COUNT(*))] ELSE CAST([] AS VARCHAR[]) END AS issues
FROM ev""",
)


# ---------------------------------------------------------------- sessions and text

oracle(
    "user_sessions_30m",
    f"""
, e AS (
  SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events
), s AS (
  SELECT *, SUM(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
  FROM e
)
SELECT user_id, {iso("MIN(ts)")} AS session_start, {iso("MAX(ts)")} AS session_end, COUNT(*) AS events,
       round(SUM(value), 6) AS total_value
FROM s GROUP BY user_id, sid
""",
)

ORACLES["user_sessions_out_of_order"] = ORACLES["user_sessions_30m"]

_AGO = "CAST(floor(epoch(TIMESTAMP '2001-06-15 12:00:00') - epoch(date)) AS BIGINT)"
oracle(
    "date_formats",
    f"""
, d AS (SELECT declaration_number, line_no, date, {_AGO} AS secs FROM facts),
m AS (SELECT *, secs // 60 AS mins, secs // 3600 AS hours, secs // 86400 AS days, secs // 2592000 AS months, secs // 31104000 AS years FROM d)
SELECT declaration_number, line_no, strftime(date, '%d/%m/%Y') AS day, strftime(date, '%H:%M:%S %d/%m/%Y') AS moment, strftime(date, '%m/%Y') AS month_year,
       strftime(date, '%d/%m/%Y') || ' - 15/06/2001' AS span,
       CASE WHEN years > 0 THEN years || ' năm trước' WHEN months > 0 THEN months || ' tháng trước' WHEN days > 0 THEN days || ' ngày trước'
            WHEN hours > 0 THEN hours || ' giờ trước' WHEN mins > 0 THEN mins || ' phút trước' ELSE 'Vừa xong' END AS ago
FROM m
""",
)
oracle(
    "number_formats",
    """
, v AS (SELECT declaration_number, line_no, CAST(total_value_usd AS DOUBLE) AS x, CAST(tax_rate AS DOUBLE) AS r, CAST(total_value_usd AS DECIMAL(28, 2)) AS d FROM facts)
SELECT declaration_number, line_no,
       CASE WHEN x >= 1e9 THEN printf('%.1f', round(x / 1e9, 1)) || 'B' WHEN x >= 1e6 THEN printf('%.1f', round(x / 1e6, 1)) || 'M'
            WHEN x >= 1e3 THEN printf('%.1f', round(x / 1e3, 1)) || 'K' ELSE regexp_replace(CAST(x AS VARCHAR), '\\.0$', '') END AS compact,
       printf('%.1f', r * 100) || '%' AS rate, '$' || format('{:,.2f}', x) AS usd, translate(format('{:,.2f}', x), ',.', '.,') AS vi_number,
       translate(format('{:,}', CAST(round_even(x, 0) AS BIGINT)), ',.', '.,') || chr(160) || '₫' AS vnd
FROM v
""",
)

# Java's (?U)\\s, spelled out for RE2
_WS_CLASS = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _normsql(expr: str) -> str:
    return f"lower(trim(regexp_replace({expr}, '{_WS_CLASS}', ' ', 'g')))"


oracle(
    "normalize_text",
    f"SELECT doc_id, length({_normsql('text')}) AS normalized_length, md5({_normsql('text')}) AS normalized_md5 FROM documents",
)
_VI_FROM = "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
_VI_TO = "aaaaaaaaaaaaaaaaadeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyy"
_SEARCH = f"translate(lower(trim(regexp_replace(text, '{_WS_CLASS}', ' ', 'g'))), '{_VI_FROM}', '{_VI_TO}')"
oracle(
    "searchable_text",
    f"SELECT conv_id, turn, md5({_SEARCH}) AS searchable_md5, length({_SEARCH}) AS searchable_length FROM conversations",
)
_STOP = "['và','hoặc','nhưng','của','cho','với','từ','trong','ngoài','trên','dưới','về','theo','để','đến','đang','đã','sẽ','có','là','các','những','này','đó','kia','một','hai','ba']"
_KW = f"list_filter(regexp_split_to_array(lower(trim(regexp_replace(text, '{_WS_CLASS}', ' ', 'g'))), '{_WS_CLASS}'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w))"
oracle(
    "keywords",
    f"SELECT doc_id, len({_KW}) AS keyword_count, md5(array_to_string({_KW}, ' ')) AS keywords_md5 FROM documents",
)
oracle(
    "keyword_counts",
    f"""
, t AS (SELECT doc_id, unnest({_KW}) AS term FROM documents)
SELECT term, COUNT(*) AS occurrences, COUNT(DISTINCT doc_id) AS documents FROM t GROUP BY term
""",
)
oracle(
    "truncate_words",
    """
, c AS (SELECT doc_id, text, substr(text, 1, 80) AS cut FROM documents)
, p AS (SELECT *, CASE WHEN strpos(reverse(cut), ' ') = 0 THEN -1 ELSE length(cut) - strpos(reverse(cut), ' ') END AS ls FROM c)
SELECT doc_id,
       CASE WHEN length(text) <= 80 THEN text
            WHEN ls > 64 THEN substr(cut, 1, ls) || '...'
            ELSE cut || '...' END AS preview
FROM p
""",
)
oracle(
    "capitalize_words",
    """SELECT conv_id, turn,
       md5(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN substr(w, 1, 1) = 'ß' THEN 'SS' ELSE upper(substr(w, 1, 1)) END || lower(substr(w, 2))), ' ')) AS capitalized_md5
FROM conversations""",
)
_SHORT = """CASE
  WHEN length(text) <= 100 THEN text
  WHEN strpos(text, ',') - 1 > 20 AND strpos(text, ',') - 1 < 100 THEN trim(substr(text, 1, strpos(text, ',') - 1))
  WHEN strpos(text, ';') - 1 > 20 AND strpos(text, ';') - 1 < 100 THEN trim(substr(text, 1, strpos(text, ';') - 1))
  WHEN strpos(text, '-') - 1 > 20 AND strpos(text, '-') - 1 < 100 THEN trim(substr(text, 1, strpos(text, '-') - 1))
  WHEN strpos(text, '(') - 1 > 20 AND strpos(text, '(') - 1 < 100 THEN trim(substr(text, 1, strpos(text, '(') - 1))
  ELSE substr(text, 1, 97) || '...' END"""
oracle(
    "short_name",
    f"""
, s AS (SELECT doc_id, text, {_SHORT} AS short_name FROM documents)
SELECT doc_id, short_name, CAST(length(text) AS BIGINT) AS original_length, CAST(length(short_name) AS BIGINT) AS short_length,
       CASE WHEN length(text) > 0 THEN round(length(short_name) / length(text), 9) END AS compression_ratio
FROM s
""",
)
oracle(
    "date_rollover",
    """
, j AS (
  SELECT l_orderkey, l_partkey, l_suppkey, year(l_shipdate) AS y, month(l_shipdate) AS m, day(o_orderdate) AS d
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), r AS (
  SELECT *, CAST(make_date(y, 1, 1) + to_months(m - 1) + to_days(d - 1) AS DATE) AS rolled FROM j
)
SELECT l_orderkey, l_partkey, l_suppkey, CAST(rolled AS VARCHAR) AS rolled_date,
       CASE WHEN year(rolled) = y AND month(rolled) = m AND day(rolled) = d THEN CAST(rolled AS VARCHAR) END AS strict_date
FROM r
""",
)


# ---------------------------------------------------------------- remaining inventory items

oracle(
    "company_aggregates_raw",
    f"""
SELECT f.company_id, c.name, c.address, COUNT(*) AS total_transactions,
       CAST(SUM(f.total_value_usd) AS DOUBLE) AS total_import_value, CAST(SUM(f.quantity) AS DOUBLE) AS total_quantity,
       COUNT(DISTINCT f.goods_id) AS unique_goods_count,
       {iso("MIN(f.date)")} AS first_transaction_date, {iso("MAX(f.date)")} AS last_transaction_date
FROM facts f JOIN companies c ON f.company_id = c.company_id
GROUP BY f.company_id, c.name, c.address
""",
)
oracle("unclassified_count", "SELECT COUNT(*) FILTER (WHERE classified_by = 'fallback') AS count FROM goods")
oracle(
    "company_name_search",
    "SELECT company_id, name, address FROM companies WHERE regexp_matches(name, 'customer#00000012', 'i') ORDER BY name, company_id LIMIT 20",
)
oracle(
    "company_searches",
    """
, q AS (
  SELECT DISTINCT lower(right(name, 1 + length(regexp_replace(md5(name), '[0-9]', '', 'g')) % 4)) AS search FROM companies
), hit AS (
  SELECT search, company_id, name, row_number() OVER (PARTITION BY search ORDER BY name, company_id) AS rank
  FROM q JOIN companies ON contains(lower(name), search) WHERE length(search) >= 2
)
SELECT * FROM hit WHERE rank <= 20""",
)
oracle("company_name_search_short", "SELECT company_id, name, address FROM companies WHERE false")
oracle(
    "companies_importing",
    """SELECT company_id, name, address FROM companies WHERE company_id IN (
  SELECT f.company_id FROM facts f WHERE f.goods_id IN (SELECT goods_id FROM goods WHERE regexp_matches(raw_name, '^small ', 'i')))""",
)
oracle(
    "remove_diacritics",
    "SELECT doc_id, md5(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))) AS plain_md5 FROM documents",
)
oracle(
    "nfc_text",
    f"SELECT conv_id, turn, md5(trim(regexp_replace(nfc_normalize(text), '{_WS_CLASS}', ' ', 'g'))) AS nfc_md5 FROM conversations",
)


def _rule_sql() -> str:
    from tradelens.operators.enrich import CATEGORY_HINTS, _strip
    from tradelens.schema import CATEGORIES

    text = f"(' ' || translate(lower(trim(regexp_replace(raw_name, '{_WS_CLASS}', ' ', 'g'))), '{_VI_FROM}', '{_VI_TO}') || ' ')"
    cats = [c for c in CATEGORIES if c in CATEGORY_HINTS]
    scores = []
    for cat in cats:
        parts = [f"CASE WHEN contains({text}, ' {_strip(h)} ') THEN {len(_strip(h))} ELSE 0 END" for h in CATEGORY_HINTS[cat]]
        scores.append(f"greatest({', '.join(parts)})" if len(parts) > 1 else parts[0])
    best = f"greatest({', '.join(scores)})"
    whens = " ".join(f"WHEN {sc} = {best} THEN '{cat}'" for cat, sc in zip(cats, scores))
    return f"CASE WHEN {best} = 0 THEN 'Khác' {whens} END"


oracle(
    "classify_goods",
    f"""
, c AS (SELECT goods_id, raw_name, {_rule_sql()} AS category FROM goods)
SELECT goods_id, category, CASE WHEN category = 'Khác' THEN 0.5 ELSE 0.8 END AS confidence,
       {_SHORT.replace('text', 'raw_name')} AS short_name
FROM c
""",
)
