"""DuckDB SQL of the testbed star, shared by every oracle query.

The oracles are written independently of the Spark code: plain SQL over the
driver's pre-registered views.  ``with_star(sql)`` prefixes the common
table expressions ``facts``, ``companies``, ``goods``, ``categories`` and
``goods_cat`` (goods with their category name).
"""

from __future__ import annotations

STAR_CTES = """
facts AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS declaration_number,
         l.l_linenumber AS line_no,
         l.l_shipdate AS date,
         CAST(year(l.l_shipdate) AS INTEGER) AS year,
         CAST(month(l.l_shipdate) AS INTEGER) AS month,
         CAST(day(l.l_shipdate) AS INTEGER) AS day,
         o.o_custkey AS company_id,
         c.c_name AS import_company_raw_name,
         l.l_partkey AS goods_id,
         l.l_suppkey AS supplier_id,
         p.p_name AS goods_raw_name,
         p.p_brand AS hs_code,
         CAST(p.p_size AS VARCHAR) AS unit,
         CAST(l.l_quantity AS DECIMAL(18,2)) AS quantity,
         l.l_extendedprice / l.l_quantity AS unit_price_usd,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS total_value_usd,
         'USD' AS original_currency,
         CAST(l.l_discount AS DECIMAL(18,6)) AS usd_rate,
         l.l_tax AS tax_rate,
         o.o_orderpriority AS payment_method,
         l.l_returnflag AS delivery_terms,
         l.l_linestatus AS transport_mode,
         c.c_mktsegment AS export_type,
         cn.n_name AS import_country,
         cr.r_name AS customs_office,
         sn.n_name AS export_country,
         o.o_orderdate AS created_at
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  LEFT JOIN region cr ON cn.n_regionkey = cr.r_regionkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey
),
companies AS (
  SELECT c_custkey AS company_id, c_name AS name, '' AS address FROM customer
),
goods AS (
  SELECT p_partkey AS goods_id,
         p_name AS raw_name,
         CASE
           WHEN length(p_name) <= 100 THEN p_name
           WHEN strpos(p_name, ',') - 1 > 20 AND strpos(p_name, ',') - 1 < 100 THEN trim(substr(p_name, 1, strpos(p_name, ',') - 1))
           WHEN strpos(p_name, ';') - 1 > 20 AND strpos(p_name, ';') - 1 < 100 THEN trim(substr(p_name, 1, strpos(p_name, ';') - 1))
           WHEN strpos(p_name, '-') - 1 > 20 AND strpos(p_name, '-') - 1 < 100 THEN trim(substr(p_name, 1, strpos(p_name, '-') - 1))
           WHEN strpos(p_name, '(') - 1 > 20 AND strpos(p_name, '(') - 1 < 100 THEN trim(substr(p_name, 1, strpos(p_name, '(') - 1))
           ELSE substr(p_name, 1, 97) || '...'
         END AS short_name,
         p_type AS category_key,
         p_brand AS hs_code,
         'fallback' AS classified_by
  FROM part
),
categories AS (
  SELECT DISTINCT p_type AS name, '' AS description FROM part
),
goods_cat AS (
  SELECT g.goods_id, g.raw_name, g.short_name, g.hs_code, g.classified_by, c.name AS category
  FROM goods g LEFT JOIN categories c ON g.category_key = c.name
)
"""


def with_star(sql: str) -> str:
    """Prefix the star CTEs; ``sql`` may start with more CTEs (``, x AS (...)``)
    or with a plain SELECT."""
    body = sql.strip()
    if body.startswith(","):
        return "WITH " + STAR_CTES.strip() + "\n" + body
    return "WITH " + STAR_CTES.strip() + "\n" + body


ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"


def iso(expr: str) -> str:
    """SQL twin of ``iso_timestamp``."""
    return f"strftime({expr}, {ISO})"


def js_round2(expr: str) -> str:
    """SQL twin of ``js_round2``: floor(x*100+0.5)/100 on doubles."""
    return f"(floor(CAST({expr} AS DOUBLE) * 100 + 0.5) / 100)"
