"""DuckDB SQL for facts, rules, scores and checks, written apart from the Spark code."""

from __future__ import annotations

from .oracle import MEASURES, SALES, T, grouped, pct

FACTS = SALES + f""", sc AS (SELECT 'all' AS scope, * FROM sales UNION ALL SELECT 'region:' || region, * FROM sales UNION ALL SELECT 'category:' || category, * FROM sales),
an AS (SELECT *, {pct('sales', 'p', 1)} AS yoy, {pct('basket', 'pb', 1)} AS bd, {pct('orders', 'po', 1)} AS od FROM (SELECT *, lag(sales) OVER w AS p, lag(basket) OVER w AS pb, lag(orders) OVER w AS po FROM (SELECT scope, year, {MEASURES['sales']} AS sales, {MEASURES['orders']} AS orders, {MEASURES['basket']} AS basket FROM sc GROUP BY scope, year) WINDOW w AS (PARTITION BY scope ORDER BY year))),
qu AS (SELECT *, 'Q' || quarter || ' ' || year AS label, {pct('sales', 'p', 1)} AS qoq FROM (SELECT *, lag(sales) OVER (PARTITION BY scope ORDER BY year, quarter) AS p FROM (SELECT scope, year, quarter, {MEASURES['sales']} AS sales FROM sc GROUP BY scope, year, quarter))),
pr AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY sales DESC, sub_category) AS rk FROM (SELECT scope, sub_category, {MEASURES['sales']} AS sales FROM sc GROUP BY scope, sub_category)),
sg AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY sales DESC, segment DESC) AS rk FROM (SELECT scope, segment, {MEASURES['sales']} AS sales FROM sc GROUP BY scope, segment)),
rg AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY sales DESC, region DESC) AS rk FROM (SELECT scope, region, {MEASURES['sales']} AS sales FROM sc GROUP BY scope, region)),
f0 AS (SELECT scope, round(sum(sales), 2) AS total, min(year) AS first_year, max(year) AS last_year, count(*) AS n_years, arg_min(sales, year) AS s0, arg_max(sales, year) AS s1, count(*) FILTER (WHERE yoy > 0) AS growing_years, arg_max(bd, year) AS basket_delta, arg_max(od, year) AS orders_delta FROM an GROUP BY scope),
f1 AS (SELECT f0.*, CASE WHEN n_years > 1 THEN {pct('s1', 's0', 1)} END AS growth_pct, first_year || '-' || last_year AS period,
 (SELECT year FROM an WHERE an.scope = f0.scope ORDER BY sales DESC, year LIMIT 1) AS best_year, (SELECT year FROM an WHERE an.scope = f0.scope ORDER BY sales, year LIMIT 1) AS worst_year,
 (SELECT label FROM qu WHERE qu.scope = f0.scope AND qoq IS NOT NULL ORDER BY qoq DESC, year, quarter LIMIT 1) AS best_quarter, (SELECT max(qoq) FROM qu WHERE qu.scope = f0.scope) AS best_qoq,
 (SELECT label FROM qu WHERE qu.scope = f0.scope AND qoq IS NOT NULL ORDER BY qoq, year, quarter LIMIT 1) AS worst_quarter, (SELECT min(qoq) FROM qu WHERE qu.scope = f0.scope) AS worst_qoq,
 (SELECT round(avg(abs(qoq)), 1) FROM qu WHERE qu.scope = f0.scope) AS volatility,
 (SELECT sub_category FROM pr WHERE pr.scope = f0.scope AND rk = 1) AS top_product, (SELECT sales FROM pr WHERE pr.scope = f0.scope AND rk = 1) AS top1, (SELECT round(sum(sales), 2) FROM pr WHERE pr.scope = f0.scope AND rk <= 3) AS top3,
 (SELECT segment FROM sg WHERE sg.scope = f0.scope AND rk = 1) AS best_segment, (SELECT sales FROM sg WHERE sg.scope = f0.scope AND rk = 1) AS segment_sales,
 (SELECT region FROM rg WHERE rg.scope = f0.scope AND rk = 1) AS top_region, (SELECT sales FROM rg WHERE rg.scope = f0.scope AND rk = 1) AS region_sales FROM f0),
facts AS (SELECT *, round(region_sales * 100 / total, 1) AS region_share, round(segment_sales * 100 / total, 1) AS segment_share, round(top1 * 100 / top3, 1) AS top1_share,
 CASE WHEN growth_pct >= 50 THEN 'strong growth' WHEN growth_pct >= 20 THEN 'growth' WHEN growth_pct >= 5 THEN 'slight growth' WHEN growth_pct >= -5 THEN 'stable' WHEN growth_pct >= -20 THEN 'slight decline' WHEN growth_pct IS NOT NULL THEN 'strong decline' END AS trend,
 CASE WHEN growth_pct > 2 THEN 'up' WHEN growth_pct < -2 THEN 'down' ELSE 'stable' END AS short_trend,
 CASE WHEN volatility < 10 THEN 'low' WHEN volatility < 20 THEN 'moderate' WHEN volatility < 30 THEN 'high' WHEN volatility IS NOT NULL THEN 'very high' END AS volatility_level,
 CASE WHEN volatility < 15 THEN 'low' WHEN volatility < 30 THEN 'moderate' WHEN volatility IS NOT NULL THEN 'high' END AS volatility_short FROM f1)
"""
#: Facts of every combination of year, region and category.
_ALL_SCOPES = "sc AS (SELECT unnest(['all', 'region:' || region, 'category:' || category, 'region:' || region || '|category:' || category, 'year:' || year, 'year:' || year || '|region:' || region, 'year:' || year || '|category:' || category, 'year:' || year || '|region:' || region || '|category:' || category]) AS scope, * FROM sales)"
_GROWTH = f"CASE WHEN n_years > 1 THEN {pct('s1', 's0', 1)} ELSE (SELECT {pct('n.sales', 'o.sales', 1)} FROM an n JOIN an o ON o.scope = n.scope AND o.year = n.year - 1 WHERE f0.scope LIKE 'year:%' AND n.year = f0.first_year AND n.scope = CASE WHEN f0.scope LIKE '%|%' THEN substr(f0.scope, instr(f0.scope, '|') + 1) ELSE 'all' END) END AS growth_pct"
FULL_FACTS = FACTS.replace(FACTS[FACTS.index("sc AS (") : FACTS.index(",\nan AS (")], _ALL_SCOPES).replace(f"CASE WHEN n_years > 1 THEN {pct('s1', 's0', 1)} END AS growth_pct", _GROWTH).replace("first_year || '-' || last_year AS period", "CASE WHEN scope LIKE 'year:%' THEN '' || first_year ELSE first_year || '-' || last_year END AS period").replace("round(avg(abs(qoq)), 1)", "round(CAST(sum(CAST(abs(qoq) AS DECIMAL(18, 1))) AS DOUBLE) / count(qoq), 1)")
SCALARS = ["scope", "period", "total", "growth_pct", "best_year", "worst_year", "best_quarter", "best_qoq", "worst_quarter", "worst_qoq", "volatility", "top_product", "top1", "top3", "best_segment", "segment_share", "top_region", "region_share", "top1_share", "trend", "short_trend", "volatility_level", "volatility_short", "growing_years", "basket_delta", "orders_delta"]


def num(c: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', CAST({c} AS DOUBLE))"


POINTS = "least(30, greatest(0, CAST(trunc(coalesce(growth_pct, 0) / 2) AS INTEGER))) AS growth_points, CASE WHEN volatility IS NULL THEN 0 ELSE greatest(0, 25 - CAST(trunc(volatility / 3) AS INTEGER)) END AS regularity_points, least(25, greatest(0, CAST(trunc(coalesce(best_qoq, 0) / 2) AS INTEGER))) AS quarter_points, coalesce(least(20, greatest(0, CAST(trunc((1 - top1 / nullif(top3, 0)) * 40) AS INTEGER))), 0) AS diversity_points"
SCORE = f"SELECT *, CASE WHEN score >= 85 THEN 'excellent' WHEN score >= 70 THEN 'very good' WHEN score >= 55 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'weak' END AS mention FROM (SELECT *, growth_points + regularity_points + quarter_points + diversity_points AS score FROM (SELECT scope, {POINTS} FROM facts))"
GROWN = "(SELECT string_agg(year || ' (' || printf('%+.1f', yoy) || '%)', ', ' ORDER BY yoy DESC, year) FROM (SELECT year, yoy FROM an WHERE an.scope = facts.scope AND yoy > 0 ORDER BY yoy DESC, year LIMIT 2))"


def rule_sql(french: bool = False) -> str:
    rows = [
        ("R1", "growth_pct < 0", "'high'", "strategic", "Launch a recovery plan", "Lancer un plan de relance", "'{growth} ' || " + num("growth_pct") + " || '%'", "high", "growth"),
        ("R2", "region_share > 35", "CASE WHEN region_share > 50 THEN 'high' ELSE 'medium' END", "strategic", "Develop the other regions", "Developper les autres regions", f"top_region || ' ' || {num('region_share')} || '%'", "high", "region_sales"),
        ("R3", "top1_share > 35", "'medium'", "strategic", "Diversify the product range", "Diversifier l''offre de produits", f"top_product || ' ' || {num('top1_share')} || '%'", "high", "top_products"),
        ("R4", "worst_qoq < -10", "CASE WHEN worst_qoq < -25 THEN 'high' ELSE 'medium' END", "tactical", "Prepare the weak quarter", "Preparer le trimestre faible", f"worst_quarter || ' ' || {num('worst_qoq')} || '%'", "medium", "variation"),
        ("R5", "basket_delta < -2 AND orders_delta > 2", "'medium'", "tactical", "Raise the basket", "Relever le panier moyen", f"'{{basket}} ' || {num('basket_delta')} || '%, {{orders}} ' || {num('orders_delta')} || '%'", "high", "annual"),
        ("R6", "volatility > 30", "'high'", "operational", "Smooth the activity", "Lisser l''activite", f"'{{volatility}} ' || {num('volatility')} || '%'", "high", "volatility"),
        ("R7", "growing_years >= 2", "'medium'", "tactical", "Repeat what worked in the best years", "Reproduire ce qui a porte les meilleures annees", "'{best} ' || " + GROWN, "high", "annual yoy"),
    ]
    words = {"growth": "croissance", "basket": "panier", "orders": "commandes", "volatility": "volatilite", "best": "meilleures annees"} if french else {"growth": "growth", "basket": "basket", "orders": "orders", "volatility": "volatility", "best": "best years"}

    def fill(e: str) -> str:
        for name, word in words.items():
            e = e.replace("{" + name + "}", word)
        return e

    return " UNION ALL ".join(f"SELECT scope, '{r}' AS rule, {p} AS priority, '{lv}' AS level, '{fr if french else en}' AS action, {fill(e)} AS evidence, '{k}' AS confidence, '{src}' AS source FROM facts WHERE {w}" for r, w, p, lv, en, fr, e, k, src in rows)


RULES = rule_sql()
SURE = "CASE WHEN n_years >= 3 THEN 'high' WHEN n_years = 2 THEN 'medium' ELSE 'low' END"
TRACES = " UNION ALL ".join(f"SELECT scope, {i} AS trace, '{n}' AS insight, '{s}' AS source, {e} AS evidence, {k} AS confidence FROM facts WHERE {w} IS NOT NULL" for i, n, s, w, e, k in [
    (1, "trend", "annual", "growth_pct", f"trend || ' ' || {num('growth_pct')} || '%'", SURE),
    (2, "best year", "annual", "best_year", "CAST(best_year AS VARCHAR)", "'high'"),
    (3, "region concentration", "best_region", "top_region", f"top_region || ' ' || {num('region_share')} || '%'", "'high'"),
    (4, "product concentration", "top_products", "top_product", f"top_product || ' ' || {num('top1_share')} || '%'", "'medium'"),
    (5, "best quarter", "variation", "best_quarter", f"best_quarter || ' ' || {num('best_qoq')} || '%'", "'high'"),
    (6, "worst quarter", "variation", "worst_quarter", f"worst_quarter || ' ' || {num('worst_qoq')} || '%'", "'high'"),
    (7, "leading segment", "segment_year", "best_segment", f"best_segment || ' ' || {num('segment_share')} || '%'", "'medium'"),
    (8, "volatility", "variation", "volatility", f"volatility_level || ' ' || {num('volatility')} || '%'", SURE),
])
TRUST = "CASE WHEN volatility_level = 'low' THEN 'high' WHEN volatility_level IN ('high', 'very high') THEN 'low' ELSE 'medium' END"
NARRATIVE = f"""SELECT scope, 'Over ' || period || ' sales reached ' || {num('total', 0)} || ' USD. The trend is ' || coalesce(trend, 'not known') || coalesce(' with ' || {num('growth_pct')} || '% growth', '') || '.' || chr(10) || chr(10) ||
 'The best quarter is ' || best_quarter || ' with ' || {num('best_qoq')} || '%; the weakest is ' || worst_quarter || ' with ' || {num('worst_qoq')} || '%.' || chr(10) || chr(10) ||
 'Product ' || top_product || ' leads with ' || {num('top1_share')} || '% of the top three; segment ' || best_segment || ' holds ' || {num('segment_share')} || '%. ' || top_region || ' is the first region with ' || {num('region_share')} || '%.' || chr(10) || chr(10) ||
 'Volatility of ' || {num('volatility')} || '% is ' || volatility_level || '. We recommend that the team should strengthen ' || top_product || ' and plan for risk in weak quarters.' AS report FROM facts"""


TREND_FR = "CASE trend WHEN 'strong growth' THEN 'forte croissance' WHEN 'growth' THEN 'croissance' WHEN 'slight growth' THEN 'legere croissance' WHEN 'stable' THEN 'stable' WHEN 'slight decline' THEN 'leger recul' WHEN 'strong decline' THEN 'fort recul' ELSE 'inconnue' END"
TOPS = "(SELECT string_agg(sub_category, ', ' ORDER BY rk) FROM pr WHERE pr.scope = facts.scope AND rk <= 3)"
RECORD_TEXT = f"""SELECT scope, 'Sales of ' || {num('total', 0)} || ' over ' || period || '. The trend stays ' || coalesce(trend, 'stable') || '.' || chr(10) || chr(10) ||
 'The best period is ' || best_quarter || '; the weakest is ' || worst_quarter || '. Between them lies what planning can level out.' || chr(10) || chr(10) ||
 'Most sales come from ' || {TOPS} || '; the leading segment is ' || best_segment || '. Weak quarter ' || worst_quarter || ' (' || {num('worst_qoq')} || '%). Dependence on ' || top_product || '.' || chr(10) || chr(10) ||
 'First, strengthen ' || top_product || '; then, anticipate ' || worst_quarter || '.' AS report FROM facts"""
ANOMALIES = """SELECT scope, year, quarter, round(ch, 1) AS variation_pct, sales, ref AS reference_sales, ry AS reference_year, CASE WHEN ch < 0 THEN 'ALERT' ELSE 'INFO' END AS level, CASE WHEN ch < 0 THEN 'yoy_drop' ELSE 'yoy_rise' END AS kind
 FROM (SELECT *, CASE WHEN ref > 0 THEN (sales - ref) / ref * 100 END AS ch FROM (SELECT scope, year, quarter, sales, lag(sales) OVER w AS ref, lag(year) OVER w AS ry FROM qu WINDOW w AS (PARTITION BY scope, quarter ORDER BY year))) WHERE year - ry = 1 AND abs(ch) >= 20"""


def check(name: str, expected: str, actual: str, rest: str = "", detail: str = "''", absolute: bool = False) -> str:
    gap = "abs(actual - expected)" if absolute else "CASE WHEN expected = 0 THEN CASE WHEN actual = 0 THEN 0.0 ELSE 100.0 END ELSE abs(actual - expected) / abs(expected) * 100 END"
    return f"SELECT name, CASE WHEN gap_pct IS NULL THEN 'warning' WHEN gap_pct > 5 THEN 'error' WHEN gap_pct > 1 THEN 'warning' ELSE 'ok' END AS status, expected, actual, gap_pct, detail FROM (SELECT *, round(CAST({gap} AS DOUBLE), 4) AS gap_pct FROM (SELECT '{name}' AS name, CAST({expected} AS DOUBLE) AS expected, CAST({actual} AS DOUBLE) AS actual, {detail} AS detail {rest}))"


Y = grouped("year", "sales orders basket")
TOTAL = f"(SELECT round({T}, 2) FROM sales)"
STORED = f"(SELECT *, {pct('sales', 'p')} AS yoy FROM (SELECT *, lag(sales) OVER (ORDER BY year) AS p FROM ({Y})))"
COUNTED = "SELECT 'no_negative' AS name, CASE WHEN n > 0 THEN 'error' ELSE 'ok' END AS status, CAST(0 AS DOUBLE) AS expected, CAST(n AS DOUBLE) AS actual, CASE WHEN n > 0 THEN 100.0 ELSE 0.0 END AS gap_pct, '' AS detail FROM (SELECT count(*) FILTER (WHERE sales < 0) AS n FROM sales) UNION ALL SELECT 'no_missing', CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END, 0, n, CASE WHEN n > 0 THEN 100.0 ELSE 0.0 END, '' FROM (SELECT count(*) FILTER (WHERE region IS NULL OR category IS NULL OR order_date IS NULL) AS n FROM sales)"
CHECKS = " UNION ALL ".join([
    check("total_years", TOTAL, f"(SELECT round(sum(sales), 2) FROM ({Y}))"),
    check("years_regions", "round(sales, 2)", "round(coalesce(part, 0), 2)", f"FROM (SELECT a.year AS yr, a.sales AS sales, part FROM ({Y}) a LEFT JOIN (SELECT year, sum(sales) AS part FROM ({grouped('region, year, quarter', 'sales')}) GROUP BY year) b ON a.year = b.year ORDER BY round(abs(coalesce(part, 0) - a.sales), 2) DESC, a.year LIMIT 1)", "CAST(yr AS VARCHAR)"),
    check("regions_total", TOTAL, f"(SELECT round(sum(sales), 2) FROM ({grouped('region', 'sales')}))"),
    check("basket", f"(SELECT round(round({T}, 2) / count(DISTINCT order_id), 2) FROM sales)", f"(SELECT {MEASURES['basket']} FROM sales)"),
    COUNTED,
    check("yoy", "yoy", "yoy", f"FROM (SELECT * FROM {STORED} WHERE yoy IS NOT NULL ORDER BY year LIMIT 1)", "CAST(year AS VARCHAR)", True),
])
ORACLE = {
    "f1_facts": FACTS + f"SELECT {', '.join(SCALARS)} FROM facts",
    "f2_year_facts": FULL_FACTS + f"SELECT {', '.join(SCALARS)} FROM facts",
    "r1_year_scores": FULL_FACTS + SCORE,
    "r1_scores": FACTS + SCORE,
    "r2_recommendations": FACTS + RULES,
    "r4_traces": FACTS + TRACES,
    "r5_default_recommendations": FACTS + f"SELECT scope, 1 AS ord, 'Strengthen ' || top_product AS action, {TRUST} AS confidence FROM facts UNION ALL SELECT scope, 2, 'Anticipate ' || coalesce(worst_quarter, 'weak quarters'), {TRUST} FROM facts",
    "r6_risks": FACTS + f"SELECT scope, 'risk' AS kind, 'Weak quarter ' || worst_quarter || ' (' || {num('worst_qoq')} || '%)' AS text FROM facts WHERE worst_quarter IS NOT NULL UNION ALL SELECT scope, 'risk', 'Dependence on ' || top_product FROM facts UNION ALL SELECT scope, 'opportunity', 'Repeat ' || best_quarter || ' (+' || {num('best_qoq')} || '%)' FROM facts WHERE best_quarter IS NOT NULL UNION ALL SELECT scope, 'opportunity', 'Develop segment ' || best_segment FROM facts",
    "r8_structure": FACTS + f"SELECT scope, 'Sales of ' || {num('total', 0)} || ' over ' || period || '.' AS summary, concat_ws('; ', 'Weak quarter ' || worst_quarter || ' (' || {num('worst_qoq')} || '%)', 'Dependence on ' || top_product) AS risks, concat_ws('; ', 'Repeat ' || best_quarter || ' (+' || {num('best_qoq')} || '%)', 'Develop segment ' || best_segment) AS opportunities, 'Strengthen ' || top_product || '; Anticipate ' || worst_quarter AS actions, trend AS main_trend, best_quarter, worst_quarter, (SELECT string_agg(sub_category, ',' ORDER BY rk) FROM pr WHERE pr.scope = facts.scope AND rk <= 3) AS top_products, best_segment AS key_segment FROM facts",
    "r11_bullets": FACTS + f"SELECT scope, 'Sales of ' || {num('total', 0)} || ' over ' || period || coalesce(', growth ' || {num('growth_pct')} || '%', '') AS bullet1, coalesce('Best quarter ' || best_quarter || ', worst ' || worst_quarter, 'No quarterly change to compare') AS bullet2, 'Leading product ' || top_product || ', segment ' || best_segment AS bullet3 FROM facts",
    "r13_narrative": FACTS + NARRATIVE,
    "r13_narrative_french": FACTS + f"""SELECT scope, 'Sur ' || period || ' les ventes atteignent ' || {num('total', 0)} || ' USD. La tendance est : ' || {TREND_FR} || coalesce(' avec ' || {num('growth_pct')} || '% de croissance', '') || '.' || chr(10) || chr(10) ||
 'Le meilleur trimestre est ' || best_quarter || ' avec ' || {num('best_qoq')} || '% ; le plus faible est ' || worst_quarter || ' avec ' || {num('worst_qoq')} || '%.' || chr(10) || chr(10) ||
 'Le produit ' || top_product || ' domine avec ' || {num('top1_share')} || '% des trois premiers ; le segment ' || best_segment || ' pese ' || {num('segment_share')} || '%. ' || top_region || ' est la premiere region avec ' || {num('region_share')} || '%.' || chr(10) || chr(10) ||
 'La volatilite de ' || {num('volatility')} || '% est ' || CASE volatility_level WHEN 'low' THEN 'faible' WHEN 'moderate' THEN 'moderee' WHEN 'high' THEN 'forte' ELSE 'tres forte' END || '. Nous recommandons a l''equipe de renforcer ' || top_product || ' et de planifier le risque des trimestres faibles.' AS report FROM facts""",
    "r11_bullets_french": FACTS + f"SELECT scope, 'Ventes de ' || {num('total', 0)} || ' sur ' || period || coalesce(', croissance ' || {num('growth_pct')} || '%', '') AS bullet1, 'Meilleur trimestre ' || best_quarter || ', pire ' || worst_quarter AS bullet2, 'Produit principal ' || top_product || ', segment ' || best_segment AS bullet3 FROM facts",
    "r2_recommendations_french": FACTS + rule_sql(True),
    "r12_record_narrative": FACTS + RECORD_TEXT,
    "a4_scope_anomalies": FACTS + ANOMALIES,
    "r17_visual_tone": FACTS + f"SELECT scope, score, CASE WHEN volatility_short = 'high' THEN 'risk' WHEN score >= 30 THEN 'favourable' WHEN score <= -20 OR volatility_short = 'moderate' THEN 'watch' ELSE 'neutral' END AS tone FROM ({SCORE}) JOIN facts USING (scope)",
    "r18_answer": FACTS + f"SELECT scope, 'For ' || scope || ', sales total ' || {num('total', 0)} || ' over ' || period || '.' AS answer FROM facts",
    "v_checks": SALES + CHECKS,
    "v8_roll_up": SALES + f"SELECT count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'warning') AS n_warning, count(*) FILTER (WHERE status = 'error') AS n_error, CASE WHEN count(*) FILTER (WHERE status = 'error') > 0 THEN 'error' WHEN count(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning' ELSE 'ok' END AS overall FROM ({CHECKS})",
    "r3_merged": FACTS + f", ru AS ({RULES}), ex AS (SELECT scope, 'D' || ord AS rule, 'medium' AS priority, action FROM (SELECT scope, 1 AS ord, 'Strengthen ' || top_product AS action FROM facts UNION ALL SELECT scope, 2, 'Anticipate ' || coalesce(worst_quarter, 'weak quarters') FROM facts)), ev AS (SELECT scope, rule, priority, action, CASE WHEN priority = 'high' THEN 0 ELSE 2 END AS tier FROM ru UNION ALL SELECT scope, rule, priority, action, 1 FROM ex), kp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY tier, rule) AS n FROM ev) WHERE n <= 4) SELECT scope, rule, priority, action, CAST(row_number() OVER (PARTITION BY scope ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, n) AS INTEGER) AS rank FROM kp",
}
_STRUCTURE = ORACLE["r8_structure"].removeprefix(FACTS)
_DEFAULTS = f"'Strengthen ' || top_product || '/medium/operational/' || trust || '/Based on analysed data.;Anticipate ' || coalesce(worst, 'weak quarters') || '/medium/operational/' || trust || '/Based on analysed data.'"
ORACLE["r9_repaired_records"] = FACTS + f"""SELECT x.scope AS scope, CAST(way AS INTEGER) AS way, CASE way WHEN 6 THEN 'Own.' ELSE summary END AS summary, coalesce(main_trend, 'stable') AS main_trend, best_quarter AS best_period, worst_quarter AS worst_period,
 CASE way WHEN 9 THEN 'x,y,z' ELSE top_products END AS top_products, key_segment, risks, opportunities,
 CASE way WHEN 7 THEN 'b/high/tactical/medium/Based on analysed data.;a/low/tactical/medium/Based on analysed data.' WHEN 8 THEN 'c/medium/strategic/high/j;' || {_DEFAULTS} ELSE {_DEFAULTS} END AS recommendations
 FROM ({_STRUCTURE}) x JOIN (SELECT scope, top_product, worst_quarter AS worst, {TRUST} AS trust FROM facts) y ON x.scope = y.scope CROSS JOIN range(10) t(way)"""
