"""DuckDB SQL for the sales queries, written apart from the Spark code."""

from __future__ import annotations

SALES = """WITH sales AS (
 SELECT o_orderkey AS order_id, l_linenumber AS line_number, o_orderpriority AS ship_mode, c_custkey AS customer_id, c_name AS customer_name,
  c_mktsegment AS segment, n_name AS state, r_name AS region, p_partkey AS product_id, p_name AS product_name, p_type AS category, p_brand AS sub_category,
  CAST(o_orderdate AS DATE) AS order_date, CAST(l_shipdate AS DATE) AS ship_date, CAST(l_extendedprice AS DECIMAL(12,2)) AS sales,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(weekofyear(o_orderdate) AS INTEGER) AS week, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS day_of_week,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS ship_delay_days
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0 AND o_orderdate IS NOT NULL)
"""
T = "CAST(sum(sales) AS DOUBLE)"
MEASURES = {
    "sales": f"round({T}, 2)", "orders": "count(DISTINCT order_id)", "articles": "count(*)", "basket": f"round({T} / count(DISTINCT order_id), 2)",
    "clients": "count(DISTINCT customer_id)", "products": "count(DISTINCT product_id)", "product_names": "count(DISTINCT product_name)",
    "avg_price": f"round({T} / count(*), 2)", "avg_delay": "round(avg(ship_delay_days), 1)", "last_order": "max(order_date)",
}


def grouped(dims: str, names: str, where: str = "") -> str:
    return f"SELECT {dims}, " + ", ".join(f"{MEASURES[n]} AS {n}" for n in names.split()) + f" FROM sales {where} GROUP BY {dims}"


def top(dims: str, names: str, n: int, tie: str, where: str = "") -> str:
    return SALES + grouped(dims, names, where) + f" ORDER BY sales DESC, {tie} LIMIT {n}"


def pct(a: str, b: str, digits: int = 2) -> str:
    return f"CASE WHEN {b} > 0 THEN round(({a} - {b}) / {b} * 100, {digits}) END"


def lagged(base: str, order: str, part: str = "", digits: int = 2, change: str = "change_pct") -> str:
    over = f"OVER ({f'PARTITION BY {part} ' if part else ''}ORDER BY {order})"
    return f"SELECT *, {pct('sales', 'previous', digits)} AS {change} FROM (SELECT *, lag(sales) {over} AS previous FROM ({base}))"


R = "WHERE region = 'ASIA'"
Y = "WHERE year = 1998"
QUARTERS = grouped("year, quarter", "sales")
VARIATION = f"""SELECT *, {pct('sales', 'previous')} AS qoq_pct, {pct('sales', 'previous_year')} AS yoy_pct, {pct('sales', 'f')} AS since_first_pct, {pct('sales', 'previous')} AS variation_pct
 FROM (SELECT *, lag(sales) OVER (ORDER BY year, quarter) AS previous, lag(sales) OVER (PARTITION BY quarter ORDER BY year) AS previous_year, first(sales) OVER (ORDER BY year, quarter) AS f FROM ({QUARTERS}))"""
YOY = f"""SELECT year, quarter, sales, lag(sales) OVER (PARTITION BY quarter ORDER BY year) AS reference_sales, lag(year) OVER (PARTITION BY quarter ORDER BY year) AS reference_year FROM """
NAMED = """CASE WHEN variation_pct < 0 THEN 'ALERT' ELSE 'INFO' END AS level, CASE WHEN variation_pct < 0 THEN '{low}' ELSE '{high}' END AS kind,
 CASE WHEN variation_pct < 0 THEN 'Drop of ' ELSE 'Rise of ' END || format('{{:,.1f}}', abs(variation_pct)) || '% in Q' || quarter || ' ' || year AS description"""


def found(where: str = "", year: str = "") -> str:
    inner = YOY + f"({grouped('year, quarter', 'sales', where)})"
    return f"SELECT *, {NAMED.format(low='drop', high='rise')} FROM (SELECT *, {pct('sales', 'reference_sales', 1)} AS variation_pct FROM ({inner})) WHERE abs(variation_pct) > 20 {year}"


def summary(year: int | None, region: str | None) -> str:
    where = " AND ".join(["true", *([f"year = {year}"] if year else []), *([f"region = '{region}'"] if region else [])])
    wide = f"region = '{region}'" if region else "true"
    growth = pct("(SELECT x FROM y WHERE year = %d)" % year, "(SELECT x FROM y WHERE year = %d)" % (year - 1), 1) if year else f"CASE WHEN (SELECT count(*) FROM y) > 1 THEN {pct('(SELECT arg_max(x, year) FROM y)', '(SELECT arg_min(x, year) FROM y)', 1)} END"
    return SALES + f""", h AS (SELECT * FROM sales WHERE {where}), y AS (SELECT year, CAST(sum(sales) AS DOUBLE) AS x FROM sales WHERE {wide} GROUP BY year),
 q AS (SELECT year * 10 + quarter AS p, CAST(sum(sales) AS DOUBLE) AS x FROM h GROUP BY 1),
 g AS (SELECT {growth} AS growth_pct, CASE WHEN (SELECT count(*) FROM q) > 1 THEN {pct('(SELECT arg_max(x, p) FROM q)', '(SELECT arg_min(x, p) FROM q)', 1)} END AS within_pct)
 SELECT round(coalesce({T}, 0), 2) AS sales, count(DISTINCT order_id) AS orders, count(*) AS articles, round({T} / nullif(count(DISTINCT order_id), 0), 2) AS basket, count(DISTINCT customer_id) AS clients, count(DISTINCT product_name) AS product_names,
 (SELECT region FROM h GROUP BY region ORDER BY sum(sales) DESC, region LIMIT 1) AS best_region, any_value(growth_pct) AS growth_pct, any_value(within_pct) AS within_pct,
 CASE WHEN any_value(growth_pct) IS NOT NULL THEN '{'yoy' if year else 'period'}' WHEN any_value(within_pct) IS NOT NULL THEN 'within_year' ELSE 'none' END AS growth_type FROM h, g"""


ANNUAL = grouped("year", "sales orders articles basket clients products")
ORACLE = {
    "s5_reject_counts": "SELECT count(*) AS initial_rows, count(*) FILTER (WHERE CAST(l_extendedprice AS DECIMAL(12,2)) IS NULL OR l_extendedprice <= 0) AS invalid_sales, count(*) FILTER (WHERE l_extendedprice > 0 AND o_orderdate IS NULL) AS invalid_dates, count(*) FILTER (WHERE l_extendedprice > 0 AND o_orderdate IS NOT NULL) AS final_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey",
    "s7_calendar": SALES + "SELECT order_id, line_number, order_date, ship_date, year, quarter, month, week, day_of_week, ship_delay_days FROM sales",
    "s9_grain": SALES + "SELECT order_id, line_number, order_date, year, quarter, month, customer_id, segment, region, category, sub_category, product_name, CAST(sales AS DOUBLE) AS sales FROM sales",
    "s10_verify": SALES + f"SELECT count(*) AS n_rows, {MEASURES['sales']} AS sales, count(DISTINCT year) AS n_years, count(DISTINCT region) AS n_regions, count(*) FILTER (WHERE region = 'ASIA' AND year = 1998) AS sample_rows, min(year) = 1995 AND max(year) = 2001 AS expected_years FROM sales",
    "s11_profile": SALES + f"SELECT count(*) AS n_rows, min(order_date) AS first_date, max(order_date) AS last_date, array_to_string(list_sort(list(DISTINCT region)), ',') AS regions, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, array_to_string(list_sort(list(DISTINCT segment)), ',') AS segments, {MEASURES['sales']} AS sales, CAST(min(sales) AS DOUBLE) AS least, CAST(max(sales) AS DOUBLE) AS most, {MEASURES['orders']} AS orders, {MEASURES['basket']} AS basket, {MEASURES['clients']} AS clients, {MEASURES['products']} AS products FROM sales",
    "s12_members": SALES + "SELECT DISTINCT 'region' AS dimension, region AS member FROM sales UNION ALL SELECT DISTINCT 'category', category FROM sales UNION ALL SELECT DISTINCT 'segment', segment FROM sales UNION ALL SELECT DISTINCT 'year', CAST(year AS VARCHAR) FROM sales",
    "s18_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM {t}" for t in ("customer", "documents", "lineitem", "orders", "part")),
    "s19_stale_audit": r"SELECT count(*) FILTER (WHERE regexp_matches(text, '\+?0[.,]0\s?%')) AS zero_growth, count(*) FILTER (WHERE lower(text) LIKE '%apache license%' OR lower(text) LIKE '%all rights reserved%') AS stale_phrase, greatest(count(*) FILTER (WHERE regexp_matches(text, '\+?0[.,]0\s?%')), count(*) FILTER (WHERE lower(text) LIKE '%apache license%' OR lower(text) LIKE '%all rights reserved%')) AS purge_candidates, count(*) FILTER (WHERE regexp_matches(text, '\+?0[.,]0\s?%') OR lower(text) LIKE '%apache license%' OR lower(text) LIKE '%all rights reserved%') AS purge_rows FROM documents",
    "k1_region_quarter": SALES + grouped("region, year, quarter", "sales orders articles basket clients"),
    "k2_category_year": SALES + grouped("region, category, year", "sales articles avg_price"),
    "k3_top_products": top("sub_category", "sales articles avg_price clients orders", 10, "sub_category"),
    "k4_variation": SALES + f"SELECT year, quarter, sales, previous, previous_year, qoq_pct, yoy_pct, since_first_pct, variation_pct FROM ({VARIATION})",
    "k5_annual": SALES + lagged(ANNUAL, "year", change="yoy_pct"),
    "k6_best_region": SALES + f"SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY sales DESC, region) AS INTEGER) AS rank FROM ({grouped('year, region', 'sales orders')})",
    "k7_monthly": SALES + f"SELECT *, round(avg(sales) OVER (ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_avg_3m, make_date(year, month, 1) AS month_start FROM ({grouped('year, month', 'sales orders basket')})",
    "k8_segment_year": SALES + grouped("segment, year", "sales orders basket clients"),
    "k9_ship_modes": SALES + grouped("ship_mode, year", "sales orders avg_delay"),
    "k10_top_clients": top("customer_id, customer_name", "sales orders basket last_order", 10, "customer_id"),
    "k11_top_states": top("state, region", "sales orders clients", 15, "state"),
    "k12_weekdays": SALES + grouped("day_of_week", "sales orders basket"),
    "k13_region_matrix": SALES + "SELECT region, " + ", ".join(f"round(coalesce(CAST(sum(sales) FILTER (WHERE year = {y}) AS DOUBLE), 0), 2) AS y{y}" for y in range(1995, 2002)) + " FROM sales GROUP BY region",
    "k14_segment_share": SALES + f"SELECT *, round(sales * 100 / sum(sales) OVER (), 2) AS share_pct FROM ({grouped('segment', 'sales')})",
    "k15_global_recap": SALES + f", y AS ({ANNUAL}) SELECT {MEASURES['sales']} AS sales, (SELECT CAST(sum(orders) AS BIGINT) FROM y) AS orders, count(*) AS articles, round(round({T}, 2) / (SELECT sum(orders) FROM y), 2) AS basket, {MEASURES['clients']} AS clients, {MEASURES['products']} AS products, {pct('(SELECT arg_max(sales, year) FROM y)', '(SELECT arg_min(sales, year) FROM y)')} AS growth_pct, min(year) || '-' || max(year) AS period, (SELECT year FROM y ORDER BY sales DESC, year LIMIT 1) AS best_year, (SELECT max(sales) FROM y) AS best_sales, (SELECT region FROM sales GROUP BY region ORDER BY sum(sales) DESC, region LIMIT 1) AS best_region FROM sales",
    "q2_summary": summary(None, None),
    "q2_summary_region": summary(None, "ASIA"),
    "q2_summary_region_year": summary(1998, "ASIA"),
    "q3_annual_scoped": SALES + lagged(grouped("year", "sales orders articles basket clients", R), "year", digits=1, change="yoy_pct"),
    "q5_region_detail": SALES + grouped("region, year, quarter", "sales orders basket", "WHERE category = 'PROMO'"),
    "q6_region_summary": SALES + grouped("region", "sales orders basket", Y),
    "q7_category_detail": SALES + grouped("region, category, year", "sales articles avg_price", R),
    "q8_category_summary": SALES + grouped("category", "sales articles", R),
    "q9_sub_categories": top("sub_category", "sales orders articles avg_price", 7, "sub_category", R),
    "q10_quarterly": SALES + f"SELECT *, round((sum(sales) OVER (ORDER BY year, quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / first(sales) OVER (ORDER BY year, quarter) - 1) * 100, 1) AS cumulative_pct FROM ({lagged(grouped('year, quarter', 'sales orders', R), 'year, quarter', digits=1, change='qoq_pct')})",
    "q10_quarterly_post": SALES + f"SELECT * FROM (SELECT *, round((sum(sales) OVER (ORDER BY year, quarter ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / first(sales) OVER (ORDER BY year, quarter) - 1) * 100, 1) AS cumulative_pct FROM ({lagged(grouped('year, quarter', 'sales orders', R), 'year, quarter', digits=1, change='qoq_pct')})) WHERE year = 1998",
    "q11_monthly": SALES + f"SELECT *, round(avg(sales) OVER (ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving_avg_3m, make_date(year, month, 1) AS month_start FROM ({grouped('year, month', 'sales orders basket', R)})",
    "q12_segments": SALES + grouped("segment, year", "sales orders basket clients", R),
    "q13_segment_summary": SALES + grouped("segment", "sales orders basket clients", R),
    "q14_top_products": top("sub_category", "sales articles basket clients", 10, "sub_category", Y),
    "q15_top_clients": top("customer_id, customer_name", "sales orders basket last_order", 5, "customer_id", R),
    "q18_all_scopes": SALES + f"SELECT CASE WHEN grouping(year) = 0 THEN 'year' WHEN grouping(region) = 0 THEN 'region' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS scope_type, year, region, category, {', '.join(MEASURES[m] + ' AS ' + m for m in ('sales', 'orders', 'articles', 'basket', 'clients'))} FROM sales GROUP BY GROUPING SETS ((), (year), (region), (category))",
    "q19_period_deltas": SALES + "SELECT year, " + ", ".join(f"{pct(c, f'lag({c}) OVER (ORDER BY year)', 1)} AS {c}_delta_pct" for c in ("sales", "orders", "basket")) + ", " + ", ".join(f"{pct(f'(SELECT arg_max({c}, year) FROM yy)', f'(SELECT arg_min({c}, year) FROM yy)', 1)} AS {c}_period_pct" for c in ("sales", "orders", "basket")) + " FROM yy",
    "q20_variation_buckets": SALES + f"SELECT count(*) FILTER (WHERE qoq_pct < -20) AS severe, count(*) FILTER (WHERE qoq_pct >= -20 AND qoq_pct < -2) AS moderate, count(*) FILTER (WHERE qoq_pct >= -2) AS other FROM ({VARIATION})",
    "a1_anomalies": SALES + found(),
    "a1_anomalies_scoped": SALES + found(R, "AND year = 1998"),
    "a2_consecutive": SALES + f"SELECT year, quarter, sales, reference_sales, reference_year, round(variation_pct, 1) AS variation_pct, {NAMED.format(low='yoy_drop', high='yoy_rise')} FROM (SELECT *, CASE WHEN reference_sales > 0 THEN (sales - reference_sales) / reference_sales * 100 END AS variation_pct FROM ({YOY}({QUARTERS}))) WHERE year - reference_year = 1 AND abs(variation_pct) >= 20",
    "a3_main_anomaly": SALES + f"SELECT 'anomaly' AS source, year, quarter, variation_pct AS value FROM ({found()}) ORDER BY level, abs(variation_pct) DESC, year, quarter LIMIT 1",
    "q21_level_counts": SALES + f"SELECT region, a AS alerts, i AS infos, CASE WHEN a > i THEN 'mostly drops' WHEN a < i THEN 'mostly rises' ELSE 'balanced' END AS mix FROM (SELECT region, count(*) FILTER (WHERE v < 0) AS a, count(*) FILTER (WHERE v > 0) AS i FROM (SELECT region, year, {pct('sales', 'p', 9)} AS v, year - py AS gap FROM (SELECT *, lag(sales) OVER (PARTITION BY region, quarter ORDER BY year) AS p, lag(year) OVER (PARTITION BY region, quarter ORDER BY year) AS py FROM ({grouped('region, year, quarter', 'sales')}))) WHERE abs(v) >= 20 AND gap = 1 GROUP BY region)",
}
ORACLE["q19_period_deltas"] = SALES + f", yy AS ({grouped('year', 'sales orders basket')}) " + ORACLE["q19_period_deltas"].removeprefix(SALES)
FAULTY = SALES + ", f AS (SELECT *, (order_id * 7 + line_number) % 50 AS fault FROM sales), r AS (SELECT CASE fault WHEN 1 THEN 'date' WHEN 2 THEN 'sales' WHEN 3 THEN 'malformed' ELSE 'kept' END AS reason, * FROM f)"
ORACLE |= {
    "s9_one_pass_load": FAULTY + f" SELECT 'kept' AS what, CAST(year AS VARCHAR) AS item, count(*) AS n, round({T}, 2) AS sales FROM r WHERE reason = 'kept' GROUP BY year UNION ALL SELECT 'rejected', reason, count(*), NULL FROM r WHERE reason <> 'kept' GROUP BY reason UNION ALL SELECT 'counted', reason, count(*), NULL FROM r GROUP BY reason UNION ALL SELECT 'counted', 'rows', count(*), NULL FROM r",
    "s14_incremental_annual": ORACLE["k5_annual"],
    "s14_incremental_region_quarter": ORACLE["k1_region_quarter"],
    "s14_incremental_products": ORACLE["k3_top_products"],
    "s14_grain_year": SALES + grouped("year, region, category", "sales articles", Y),
}
