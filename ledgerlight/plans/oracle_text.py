"""DuckDB SQL for the text, grounding, routing and retrieval queries, written apart from the Spark code."""

from __future__ import annotations

from ..functions import lexicons as lx
from .oracle import MEASURES, SALES, grouped, pct
from .oracle_facts import FACTS, NARRATIVE, RECORD_TEXT, num


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(terms) -> str:
    return "[" + ", ".join(map(q, terms)) + "]"


def has(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def count(text: str, terms) -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, {q(t)}, ''))) // {len(t)}" for t in terms) + ")"


def both(make) -> str:
    return f"CASE WHEN lang = 'fr' THEN {make('fr')} ELSE {make('en')} END"


# Amounts and percentages of a table d (a key, t): each match is put between two marks, so that what stands before and after it can be looked at.
NUMBERS = r""", mk AS (SELECT *, string_split(regexp_replace(t, '(^|[^A-Za-z0-9])(\$?)([0-9]{1,3}(?:[,\s][0-9]{3})+|[0-9]+(?:[.,][0-9]+)?)((?:\s*[kKmM])?)', '\1' || chr(1) || '\2\3\4' || chr(2), 'g'), chr(1)) AS ps FROM d),
 ix AS (SELECT *, unnest(range(2, len(ps) + 1)) AS i FROM mk),
 cx AS (SELECT * EXCLUDE (ps, i), split_part(ps[i], chr(2), 1) AS m, right(replace(array_to_string(ps[1:i - 1], ''), chr(2), ''), 2) AS before, replace(substr(ps[i], strpos(ps[i], chr(2)) + 1) || array_to_string(ps[i + 1:], ''), chr(2), '') AS rest FROM ix),
 px AS (SELECT *, regexp_extract(m, '[0-9](?:.*[0-9])?') AS raw, lower(regexp_extract(m, '[kKmM]$')) AS suffix, starts_with(m, '$') AS sign, left(CASE WHEN regexp_matches(m, '[kKmM]$') THEN rest ELSE regexp_replace(rest, '^\s+', '') END, 6) AS after FROM cx),
 fx AS (SELECT *, sign OR contains(before, '$') OR contains(after, '$') OR contains(after, 'USD') AS dollar, replace(raw, ' ', '') AS n FROM px),
 am AS (SELECT * EXCLUDE (m, before, rest, sign, after, n, suffix, dollar), 'amount' AS kind, TRY_CAST(CASE WHEN contains(n, ',') AND NOT contains(n, '.') AND len(string_split(n, ',')) = 2 AND length(string_split(n, ',')[2]) <= 2 THEN replace(n, ',', '.') ELSE replace(n, ',', '') END AS DOUBLE) * CASE suffix WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END AS value, NOT dollar AND suffix = '' AS bare FROM fx WHERE dollar OR suffix <> '' OR contains(after, 'EUR')),
 pc AS (SELECT *, unnest(regexp_extract_all(t, '([+-]?[0-9]+(?:[.,][0-9]+)?)\s*%', 1)) AS raw, 'percent' AS kind FROM d),
 numbers AS (SELECT * FROM (SELECT * FROM am UNION ALL BY NAME SELECT *, TRY_CAST(replace(raw, ',', '.') AS DOUBLE) AS value, false AS bare FROM pc) WHERE value IS NOT NULL)"""
MARK = "chr(1)"
SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(t, '([.!?])[ \\t\\n\\r\\f\\v]+([A-ZÀ-ÖØ-Þ])', '\\1' || {MARK} || '\\2', 'g'), {MARK}), lambda x: trim(x)), lambda x: length(x) >= %d)"
WORDS = r"list_transform(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zA-Zà-öø-ÿÀ-ÖØ-Þ]+')), lambda w: lower(w))"
D = "WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents)"
INTENT = both(lambda g: "CASE " + " ".join(f"WHEN {has('lower(s)', lx.INTENTS[g][n])} THEN '{n}'" for n in lx.INTENT_PRIORITY) + " ELSE 'contexte' END")
NAMES = [*lx.INTENT_PRIORITY, "contexte"]
INTENTS = f"{D}, s AS (SELECT doc_id, lang, unnest({SENTENCES % 10}) AS s FROM d), i AS (SELECT doc_id, {INTENT} AS i FROM s), c AS (SELECT d.doc_id, " + ", ".join(f"count(*) FILTER (WHERE i = '{n}') AS n_{n}" for n in NAMES) + ", count(i) AS n_classified FROM d LEFT JOIN i ON d.doc_id = i.doc_id GROUP BY d.doc_id)"
PARTS = [("trend", "n_tendance > 0"), ("risk", "(n_anomalie > 0 OR n_risque > 0)"), ("opportunity", "n_opportunite > 0"), ("recommendation", "n_recommandation > 0")]
THEMES = f"{D}, th AS (SELECT doc_id, " + ", ".join(f"CAST({both(lambda g, n=n: count('low', lx.THEMES[g][n]))} AS INTEGER) AS {n}" for n in lx.THEMES["en"]) + " FROM d)"
PERCENT, MONEY, BARE = r"[+-]?\d+(?:[.,]\d+)?\s*%", r"\$\s?\d[\d,]*(?:\.\d+)?|\d[\d ,.]*\s?(?:USD|EUR)\b", r"\b\d{2,}(?:[.,]\d+)?\b"
PERCENTS = f"list_filter(regexp_extract_all(t, {q(PERCENT)}), lambda x: true)"
FIRST = "list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN list_position(p, p[i]) = i THEN p[i] END), lambda x: x IS NOT NULL)"
FORBIDDEN = ["ignore previous", "ignore your", "ignore les", "oublie", "system prompt", "your instructions", "tes instructions", "act as", "pretend", "roleplay", "jailbreak", "developer mode", "DAN mode", "respond in unrestricted"]
ORACLE = {
    "t1_statistics": f"{D}, x AS (SELECT doc_id, {SENTENCES % 5} AS s, {WORDS} AS w FROM d) SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(w)) AS INTEGER) AS n_unique, coalesce(len(w) / nullif(len(s), 0), 0) AS words_per_sentence FROM x",
    "t5_keywords": f"{D}, x AS (SELECT doc_id, lang, {WORDS} AS w FROM d), p AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM x), c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS f FROM p WHERE length(word) >= 4 AND NOT list_contains({both(lambda g: listed(lx.STOP_WORDS[g]))}, word) GROUP BY doc_id, word) SELECT doc_id, CAST(rank AS INTEGER) AS rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM c) WHERE rank <= 5",
    "t6_entities": f"{D}, x AS (SELECT doc_id, regexp_extract_all(t, {q(PERCENT)}) AS p, regexp_extract_all(t, {q(MONEY)}) AS m FROM d) SELECT doc_id, CAST(len(list_distinct(m)) AS INTEGER) AS n_money, CAST(len(list_distinct(p)) AS INTEGER) AS n_percent, coalesce(array_to_string({FIRST}, '|'), '') AS percents FROM x",
    "t7_intents": INTENTS + " SELECT * FROM c",
    "t8_coverage": INTENTS + f" SELECT doc_id, coverage, CASE WHEN coverage >= 90 THEN 'complete' WHEN coverage >= 70 THEN 'good' WHEN coverage >= 50 THEN 'partial' WHEN coverage >= 25 THEN 'weak' ELSE 'none' END AS label, gaps FROM (SELECT doc_id, CAST({' + '.join(f'CASE WHEN {w} THEN 25 ELSE 0 END' for _, w in PARTS)} AS INTEGER) AS coverage, concat_ws(',', {', '.join(f'CASE WHEN NOT {w} THEN {q(n)} END' for n, w in PARTS)}) AS gaps FROM c)",
    "t9_themes": THEMES + ", u AS (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS i, '{n}' AS theme, {n} AS n FROM th" for i, n in enumerate(lx.THEMES["en"])) + "), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM u WHERE n > 0) SELECT th.doc_id, coalesce(string_agg(theme || ':' || n, ', ' ORDER BY r) FILTER (WHERE r <= 3), '') AS themes FROM th LEFT JOIN k ON th.doc_id = k.doc_id GROUP BY th.doc_id",
    "t10_tone": THEMES + " SELECT doc_id, score, CASE WHEN score > 20 THEN 'favorable' WHEN score < -20 THEN 'defavorable' ELSE 'neutre' END AS tone, CASE WHEN risk >= 5 THEN 'eleve' WHEN risk >= 2 THEN 'modere' ELSE 'faible' END AS risk_level, CASE WHEN unrest >= 3 THEN 'instable' ELSE 'stable' END AS stability FROM (SELECT *, coalesce(CAST(trunc((pos - neg) / nullif(pos + neg, 0) * 100) AS INTEGER), 0) AS score FROM (SELECT doc_id, croissance + opportunite AS pos, decroissance + risque AS neg, risque + volatilite AS risk, volatilite + saisonnalite AS unrest FROM th))",
    "t11_polarity": f"{D}, x AS (SELECT doc_id, unnest({WORDS}) AS term FROM d WHERE lang = 'en'), l AS (SELECT unnest({listed(lx.POLARITY)}) AS term, unnest([{', '.join(map(str, lx.POLARITY.values()))}]::DOUBLE[]) AS weight), h AS (SELECT doc_id, sum(n * weight) AS x FROM (SELECT doc_id, term, count(*) AS n FROM x GROUP BY doc_id, term) JOIN l USING (term) GROUP BY doc_id) SELECT doc_id, total, round(total / sqrt(total * total + 15), 4) AS compound FROM (SELECT d.doc_id, round(coalesce(x, 0), 4) AS total FROM d LEFT JOIN h ON d.doc_id = h.doc_id)",
    "t15_quality": f"{D}, w AS (SELECT doc_id, lang, low, t, {WORDS} AS w, {SENTENCES % 5} AS s FROM d), b AS (SELECT doc_id, len(list_distinct(p)) AS du, len(p) AS m, (SELECT count(*) FROM (SELECT u FROM (SELECT unnest(p) AS u) GROUP BY u HAVING count(*) >= 4)) AS often FROM (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END AS p FROM w)), "
    f"m AS (SELECT w.doc_id, lang, low, w.w AS w, len(w.w) AS n, coalesce(({' + '.join(f'len(regexp_extract_all(t, {q(p)}))' for p in (PERCENT, MONEY, BARE))}) * 100 / nullif(len(w.w), 0), 0) AS d, coalesce(len(w.w) / nullif(len(s), 0), 0) AS x, coalesce(len(list_distinct(w.w)) / nullif(len(w.w), 0), 0) AS v, coalesce(du / nullif(b.m, 0), 0) AS f, often FROM w JOIN b USING (doc_id)), "
    f"k AS (SELECT *, {both(lambda g: f'len(list_intersect(list_distinct(w), {listed(lx.ACTION_VERBS[g])}))')} AS verbs, {both(lambda g: '(' + ' + '.join(f'CAST(contains(low, {q(t)}) AS INTEGER)' for t in lx.BUSINESS_TERMS[g]) + ')')} AS terms FROM m) "
    "SELECT doc_id, CASE WHEN d >= 4 AND d <= 12 THEN 25 WHEN d >= 2 AND d < 4 THEN 18 WHEN d > 12 AND d <= 18 THEN 22 WHEN d >= 1 AND d < 2 THEN 10 WHEN d > 18 THEN 15 ELSE 3 END AS c2_numbers, CASE WHEN verbs >= 5 THEN 15 WHEN verbs >= 3 THEN 11 WHEN verbs >= 1 THEN 6 ELSE 1 END AS c3_recommendations, "
    "CASE WHEN x >= 12 AND x <= 22 THEN 8 WHEN (x >= 9 AND x < 12) OR (x > 22 AND x <= 28) THEN 6 WHEN x < 9 THEN 3 ELSE 4 END + CASE WHEN v >= 0.55 THEN 7 WHEN v >= 0.45 THEN 6 WHEN v >= 0.35 THEN 4 ELSE 2 END AS c4_clarity, CASE WHEN n < 10 THEN 0 WHEN f >= 0.85 AND often = 0 THEN 10 WHEN f >= 0.75 AND often <= 1 THEN 8 WHEN f >= 0.65 THEN 6 WHEN f >= 0.55 THEN 4 ELSE 2 END AS c5_repetition, CASE WHEN terms >= 10 THEN 10 WHEN terms >= 7 THEN 8 WHEN terms >= 4 THEN 6 WHEN terms >= 2 THEN 4 ELSE 1 END AS c6_vocabulary FROM k",
    "t14_fact_coverage": FACTS + f", rp AS (SELECT scope, lower(report) AS low FROM ({NARRATIVE})) SELECT scope, CASE WHEN contains(low, CAST(best_year AS VARCHAR)) THEN 5 ELSE 0 END AS year_points, "
    + ", ".join("CASE WHEN " + " OR ".join(f"contains(low, '{p}' || substr({c}, 2, 1) || ' ' || substr({c}, 4, 4))" for p in ("q", "t", "trimestre ", "quarter ")) + f" THEN 5 ELSE 0 END AS {n}" for c, n in (("best_quarter", "best_points"), ("worst_quarter", "worst_points")))
    + r", CASE WHEN contains(low, lower(top_product)) THEN 5 ELSE 0 END AS product_points, CASE WHEN len(list_filter(regexp_extract_all(low, '([+-]?\d+(?:[.,]\d+)?)\s*%', 1), lambda x: abs(CAST(replace(x, ',', '.') AS DOUBLE) - round(growth_pct)) <= 2)) > 0 THEN 5 ELSE 0 END AS growth_points FROM rp JOIN facts USING (scope)",
    "u6_routing": "WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, regexp_replace(trim(lower(coalesce(text, ''))), '[.!?,;: ]+$', '') AS q FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN 'empty' WHEN length(t) > 1000 THEN 'too_long' WHEN "
    + has("low", FORBIDDEN) + " THEN 'blocked' WHEN length(q) <= 30 AND (" + f"list_contains({listed(lx.GREETINGS)}, q)) THEN 'salutation' " + " ".join(f"WHEN length(q) <= 30 AND list_contains({listed(ts)}, q) THEN '{n}'" for n, ts in (("remerciement", lx.THANKS), ("affirmation", lx.YES), ("negation", lx.NO)))
    + " WHEN length(q) <= 30 AND (" + " OR ".join(f"starts_with(q, '{g} ') OR starts_with(q, '{g},')" for g in lx.GREETINGS) + f") THEN 'salutation' WHEN NOT {has('low', lx.DOMAIN)} THEN 'out_of_scope' " + " ".join(f"WHEN {has('low', ts)} THEN '{n}'" for n, ts in lx.QUESTION_INTENTS.items())
    + " ELSE 'general' END AS route FROM t) SELECT conv_id, turn, route, CASE WHEN route IN ('empty', 'too_long', 'blocked', 'out_of_scope') THEN 'gate' WHEN route IN ('salutation', 'remerciement', 'affirmation', 'negation') THEN 'small_talk' ELSE 'retrieval' END AS engine FROM r",
    "x10_cosine_top": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS passage_id, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query_id, passage_id, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, passage_id) AS rank FROM s WHERE similarity > 0.3) WHERE rank <= 5",
    "g1_numbers": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)" + NUMBERS + " SELECT doc_id, kind, raw, value FROM numbers",
}
PASSAGES = SALES + f""", y AS ({grouped('year', 'sales orders')}), yy AS (SELECT *, {pct('sales', 'p')} AS yoy FROM (SELECT *, lag(sales) OVER (ORDER BY year) AS p FROM y)),
 sg AS ({grouped('segment', 'sales')}), rg AS ({grouped('region', 'sales')}), tp AS (SELECT *, row_number() OVER (ORDER BY sales DESC, sub_category) AS rank FROM ({grouped('sub_category', 'sales')})),
 an AS (SELECT *, {pct('sales', 'p', 1)} AS v FROM (SELECT *, lag(sales) OVER (PARTITION BY quarter ORDER BY year) AS p FROM ({grouped('year, quarter', 'sales')})))
 SELECT 'global-' || min(year) || '-' || max(year) AS chunk_id, 'global' AS chunk_type, CAST(NULL AS INTEGER) AS filter_year, CAST(NULL AS VARCHAR) AS filter_region, 'Sales over ' || min(year) || '-' || max(year) || ': ' || {num(MEASURES['sales'], 0)} || ' in ' || (SELECT CAST(sum(orders) AS BIGINT) FROM y) || ' orders; best year ' || (SELECT year FROM y ORDER BY sales DESC, year LIMIT 1) || '.' AS content FROM sales
 UNION ALL SELECT 'annual-' || year, 'annual', year, NULL, 'In ' || year || ' sales were ' || {num('sales', 0)} || coalesce(', a change of ' || {num('yoy')} || '%', '') || '.' FROM yy
 UNION ALL SELECT 'top_product-' || sub_category, 'top_product', NULL, NULL, 'Rank ' || rank || ': ' || sub_category || ' with ' || {num('sales', 0)} || '.' FROM tp WHERE rank <= 10
 UNION ALL SELECT 'anomaly-' || year || '-' || quarter, 'anomaly', year, NULL, CASE WHEN v < 0 THEN 'Drop of ' ELSE 'Rise of ' END || format('{{:,.1f}}', abs(v)) || '% in Q' || quarter || ' ' || year || ' against the same quarter of the year before.' FROM an WHERE abs(v) > 20
 UNION ALL SELECT 'segment-' || segment, 'segment', NULL, NULL, 'Segment ' || segment || ' holds ' || {num('round(sales * 100 / (SELECT sum(sales) FROM sg), 2)')} || '% of sales.' FROM sg
 UNION ALL SELECT 'region-' || region, 'region', NULL, region, 'Region ' || region || ' holds ' || {num('round(sales * 100 / (SELECT sum(sales) FROM rg), 2)')} || '% of sales.' FROM rg"""
ORACLE["x1_passages"] = PASSAGES
ORACLE["x11_index_stats"] = f"SELECT chunk_type, count(*) AS n FROM ({PASSAGES}) GROUP BY chunk_type"
ADVICE = SALES + f""", rg AS ({grouped('region', 'sales')}), cg AS ({grouped('category', 'sales')}), yg AS ({grouped('year', 'sales')}), al AS (SELECT count(*) AS n FROM (SELECT *, {pct('sales', 'p', 1)} AS v FROM (SELECT *, lag(sales) OVER (PARTITION BY quarter ORDER BY year) AS p FROM ({grouped('year, quarter', 'sales')}))) WHERE v < -20),
 g AS (SELECT (arg_max(sales, year) - arg_min(sales, year)) / nullif(arg_min(sales, year), 0) * 100 AS v FROM yg), e AS (SELECT (SELECT region FROM rg ORDER BY sales DESC, region DESC LIMIT 1) AS t, (SELECT region FROM rg ORDER BY sales, region LIMIT 1) AS l)
 SELECT concat_ws('; ', CASE WHEN n > 0 THEN 'Look into ' || n || ' alerts' END, CASE WHEN t <> l THEN 'Bring ' || l || ' closer to ' || t END, CASE WHEN (SELECT max(sales) > 1.3 * min(sales) FROM cg) THEN 'Category ' || (SELECT category FROM cg ORDER BY sales DESC, category DESC LIMIT 1) || ' dominates' END, CASE WHEN v > 30 THEN 'Secure the growth' WHEN v < 5 THEN 'Revive the growth' END) AS advice FROM al, g, e"""
ORACLE["r7_scope_advice"] = ADVICE
ORACLE["x12_pairwise"] = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0) SELECT a.vec_id AS query_id, b.vec_id AS passage_id, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"
# What a scope's texts may state: scalars, years, quarters, products and their sums, segments, yearly first regions, months.
ALLOWED = f""", sgo AS (SELECT scope, segment, sum(o) AS orders FROM (SELECT scope, segment, year, count(DISTINCT order_id) AS o FROM sc GROUP BY scope, segment, year) GROUP BY scope, segment),
 mo AS (SELECT scope, year, month, {MEASURES['sales']} AS sales, count(DISTINCT order_id) AS orders FROM sc GROUP BY scope, year, month), qty AS (SELECT scope, sub_category, count(*) AS n FROM sc GROUP BY scope, sub_category),
 yr AS (SELECT *, row_number() OVER (PARTITION BY scope, year ORDER BY sales DESC, region) AS rk FROM (SELECT scope, year, region, {MEASURES['sales']} AS sales FROM sc GROUP BY scope, year, region)),
 al AS (SELECT scope, unnest([total, growth_pct, volatility, region_share, top1_share, top3, (SELECT sum(sales) FROM pr WHERE pr.scope = facts.scope AND rk <= 2)]) AS v FROM facts
  UNION ALL SELECT scope, unnest([sales, orders, basket, yoy]) FROM an UNION ALL SELECT scope, unnest([sales, qoq, abs(qoq)]) FROM qu
  UNION ALL SELECT pr.scope, unnest([sales, n]) FROM pr JOIN qty USING (scope, sub_category) WHERE rk <= 3
  UNION ALL SELECT sg.scope, unnest([sg.sales, sgo.orders, sg.sales * 100 / facts.total]) FROM sg JOIN sgo USING (scope, segment) JOIN facts USING (scope)
  UNION ALL SELECT scope, sales FROM yr WHERE rk = 1 UNION ALL SELECT scope, unnest([sales, orders]) FROM mo)"""
UNBACKED = " bad AS (SELECT * FROM numbers WHERE NOT (bare AND value BETWEEN 2010 AND 2030) AND NOT EXISTS (SELECT 1 FROM al WHERE al.scope = numbers.scope AND abs(numbers.value - al.v) <= CASE WHEN abs(al.v) < 5 THEN 1.5 ELSE abs(al.v) * CASE WHEN numbers.kind = 'amount' THEN 0.04 ELSE 0.015 END END))"
ORACLE["g4_unsupported"] = FACTS + ALLOWED + f", rp AS ({NARRATIVE}), d AS (SELECT scope, report AS t FROM rp UNION ALL SELECT scope, (SELECT report FROM rp WHERE scope = 'all') FROM rp)" + NUMBERS + "," + UNBACKED + " SELECT scope, kind, raw, count(*) AS n FROM bad GROUP BY scope, kind, raw"
ORACLE["r14_accepted"] = (
    FACTS + ALLOWED + f", rp AS ({NARRATIVE}), rc AS ({RECORD_TEXT}), cd AS (SELECT scope, CASE WHEN scope LIKE 'category:%' THEN 'For ' || scope || ', sales total ' || {num('total', 0)} || ' over ' || period || '.' ELSE (SELECT report FROM rp WHERE scope = 'all') END AS report FROM facts), d AS (SELECT scope, report AS t FROM cd)" + NUMBERS + "," + UNBACKED
    + ", nb AS (SELECT cd.scope, cd.report, count(bad.value) AS n_bad FROM cd LEFT JOIN bad ON cd.scope = bad.scope GROUP BY cd.scope, cd.report) SELECT nb.scope, n_bad, CASE WHEN length(nb.report) < 400 THEN 'short' WHEN n_bad > 2 THEN 'unsupported' ELSE 'accepted' END AS gate, CASE WHEN length(nb.report) < 400 THEN rp.report WHEN n_bad > 2 THEN rc.report ELSE nb.report END AS report FROM nb JOIN rp USING (scope) JOIN rc USING (scope)"
)
ORACLE["t12_analysis"] = "SELECT a.*, b.* EXCLUDE (doc_id), c.* EXCLUDE (doc_id), e.* EXCLUDE (doc_id), f.* EXCLUDE (doc_id), g.* EXCLUDE (doc_id), coalesce(keywords, '') AS keywords FROM (" + ") a JOIN (".join([ORACLE["t1_statistics"], ORACLE["t7_intents"]]) + ") b USING (doc_id) JOIN (" + ORACLE["t8_coverage"] + ") c USING (doc_id) JOIN (" + ORACLE["t9_themes"] + ") e USING (doc_id) JOIN (" + ORACLE["t10_tone"] + ") f USING (doc_id) JOIN (" + ORACLE["t11_polarity"] + ") g USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(word || ':' || n, ', ' ORDER BY rank) AS keywords FROM (" + ORACLE["t5_keywords"] + ") GROUP BY doc_id) h USING (doc_id)"
MARKS = {"numbers": ("c2_numbers", 25), "recommendations": ("c3_recommendations", 15), "clarity": ("c4_clarity", 15), "repetition": ("c5_repetition", 10), "vocabulary": ("c6_vocabulary", 10)}
ORACLE["t15_total"] = "SELECT doc_id, total, CASE WHEN total >= 85 THEN 'excellent' WHEN total >= 70 THEN 'very good' WHEN total >= 55 THEN 'good' WHEN total >= 40 THEN 'fair' ELSE 'weak' END AS label, gaps FROM (SELECT doc_id, " + " + ".join(c for c, _ in MARKS.values()) + " AS total, concat_ws(',', " + ", ".join(f"CASE WHEN {c} < 0.6 * {m} THEN '{n}' END" for n, (c, m) in MARKS.items()) + f") AS gaps FROM ({ORACLE['t15_quality']}))"
_WORRIES = "What should be done about it?|Where do sales swing most?|What lies behind the weakest quarter?"
SUGGESTED = {"salutation": "Where do sales grow fastest?|What could go wrong next?|How do two regions differ?", "recommandation": "What lies behind the weakest year?|How much hangs on few products?|When in the year are sales at risk?", "risque": _WORRIES, "anomalie": _WORRIES}
ORACLE["u6_suggestions"] = "SELECT conv_id, turn, CASE route " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUGGESTED.items()) + f" ELSE 'Where do sales grow fastest?|What could go wrong next?|How much hangs on few products?' END AS suggestions FROM ({ORACLE['u6_routing']})"
ORACLE["g5_corrected"] = FACTS + f"SELECT scope, 1 AS ord, 'Grow beyond ' || {num('total', 0)} || ' USD soon' AS action, 'Sales were ' || {num('total', 0)} || ' USD' AS justification FROM facts UNION ALL SELECT scope, 2, 'Grow beyond USD soon', 'Volatility ' || {num('volatility')} || '%; first product ' || top_product || '.' FROM facts"
ORACLE["q4_annual_stored"] = SALES + f"SELECT year, sales, orders, {pct('sales', 'p')} AS yoy_pct FROM (SELECT *, lag(sales) OVER (ORDER BY year) AS p FROM ({grouped('year', 'sales orders')})) WHERE year BETWEEN 1996 AND 1999"
ORACLE["q16_recap_stored"] = SALES + f", y AS ({grouped('year', 'sales orders')}), rg AS ({grouped('region', 'sales')}) SELECT {MEASURES['sales']} AS sales, (SELECT CAST(sum(orders) AS BIGINT) FROM y) AS orders, (SELECT year FROM y ORDER BY sales DESC, year LIMIT 1) AS best_year, (SELECT region FROM rg ORDER BY sales DESC, region LIMIT 1) AS best_region FROM sales"
ORACLE["s15_latest_reports"] = FACTS + f"SELECT CASE WHEN scope LIKE 'category:%' THEN 1 ELSE 2 END AS report_id, CASE WHEN scope LIKE 'region:%' THEN substr(scope, 8) END AS region, CASE WHEN scope LIKE 'category:%' THEN substr(scope, 10) END AS category, CASE WHEN scope LIKE 'category:%' THEN '1' ELSE '2' END || ': For ' || scope || ', sales total ' || {num('total', 0)} || ' over ' || period || '.' AS report FROM facts"
LABELS = {"croissance": "Growth", "decroissance": "Decline", "saisonnalite": "Seasonality", "concentration_produit": "Product concentration", "concentration_regionale": "Regional concentration", "volatilite": "Volatility", "fidelisation": "Loyalty", "panier_moyen": "Average basket", "diversification": "Diversification", "risque": "Risk", "opportunite": "Opportunity", "recommandation": "Recommendation"}
ORACLE["t16_labels"] = "SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(string_split(themes, ', '), lambda x: x <> ''), lambda x: CASE split_part(x, ':', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + f" END || '=' || split_part(x, ':', 2)), ';'), '') AS labels FROM ({ORACLE['t9_themes']})"
ASIA = SALES.rstrip().removesuffix(")") + " AND r_name = 'ASIA')"
SIZES = [("summary", "1"), ("annual", "(SELECT count(DISTINCT year) FROM sales)"), ("quarterly", "(SELECT count(DISTINCT (year, quarter)) FROM sales)"), ("regions", "(SELECT count(DISTINCT region) FROM sales)"), ("categories", "(SELECT count(DISTINCT category) FROM sales)"), ("sub_categories", "(SELECT least(10, count(DISTINCT sub_category)) FROM sales)"), ("monthly", "(SELECT count(DISTINCT (year, month)) FROM sales)"), ("segments", "(SELECT count(DISTINCT segment) FROM sales)"), ("top_products", "(SELECT least(10, count(DISTINCT sub_category)) FROM sales)"), ("top_clients", "(SELECT least(5, count(DISTINCT customer_id)) FROM sales)"), ("anomalies", f"(SELECT count(*) FROM (SELECT *, {pct('sales', 'p', 1)} AS v FROM (SELECT *, lag(sales) OVER (PARTITION BY quarter ORDER BY year) AS p FROM ({grouped('year, quarter', 'sales')}))) WHERE abs(v) > 20)"), ("report", "1")]
ORACLE["q17_dashboard"] = ASIA + " UNION ALL ".join(f"SELECT '{n}' AS part, CAST({e} AS BIGINT) AS n_rows" for n, e in SIZES)
ORACLE["q19_extremes"] = SALES + f", y AS (SELECT *, {pct('sales', 'p', 1)} AS g FROM (SELECT *, lag(sales) OVER (ORDER BY year) AS p FROM ({grouped('year', 'sales')}))), rg AS ({grouped('region', 'sales')}) SELECT (SELECT year FROM y WHERE g IS NOT NULL ORDER BY g DESC, year LIMIT 1) AS best_growth_year, (SELECT max(g) FROM y) AS best_growth_pct, (SELECT region FROM rg ORDER BY sales DESC, region DESC LIMIT 1) AS first_region, (SELECT region FROM rg ORDER BY sales, region LIMIT 1) AS last_region, (SELECT round(max(sales) - min(sales), 2) FROM rg) AS region_gap"
ORACLE["x9_written_index"] = f"SELECT chunk_type, filter_region, count(*) AS n, count(filter_year) AS with_year FROM ({PASSAGES}) GROUP BY chunk_type, filter_region"
ORACLE["x7_report_passages"] = FACTS + f", rp AS ({NARRATIVE}) SELECT scope, CAST(0 AS INTEGER) AS chunk, 'report' AS chunk_type, report AS content FROM rp UNION ALL SELECT scope, -1, 'summary', '- Sales of ' || {num('total', 0)} || ' over ' || period || coalesce(', growth ' || {num('growth_pct')} || '%', '') || chr(10) || '- Best quarter ' || best_quarter || ', worst ' || worst_quarter || chr(10) || '- Leading product ' || top_product || ', segment ' || best_segment FROM facts"
ORACLE["t4_domain_stop_words"] = f"{D}, x AS (SELECT doc_id, lang, {WORDS} AS w FROM d), p AS (SELECT doc_id, lang, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM x), o AS (SELECT doc_id, lang, unnest(list_distinct(w)) AS word FROM x), fw AS (SELECT lang, word FROM (SELECT lang, word, count(*) AS n FROM o WHERE length(word) >= 4 GROUP BY lang, word) JOIN (SELECT lang, count(*) AS t FROM d GROUP BY lang) USING (lang) WHERE n > 0.3 * t), c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS f FROM p ANTI JOIN fw USING (lang, word) WHERE length(word) >= 4 GROUP BY doc_id, word) SELECT doc_id, CAST(rank AS INTEGER) AS rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM c) WHERE rank <= 5"
ORACLE["x8_encoded"] = "SELECT doc_id, true AS encoded, concat_ws(',', " + ", ".join(f"length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', ''))" for c in "abcdefgh") + ") AS counts FROM documents"
ORACLE["x7_packed_paragraphs"] = r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n\s*\n|\n'), lambda s: trim(s)), lambda s: s <> '') AS ps FROM documents),
 z AS (SELECT doc_id, ps, list_transform(ps, lambda s: len(regexp_split_to_array(s, '\s+'))) AS ws FROM p WHERE len(ps) > 0),
 w AS (SELECT doc_id, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS chunk, CAST(ws[1] AS BIGINT) AS n FROM z UNION ALL
  SELECT w.doc_id, w.i + 1, CASE WHEN n + ws[w.i + 1] > 250 THEN chunk + 1 ELSE chunk END, CASE WHEN n + ws[w.i + 1] > 250 THEN ws[w.i + 1] ELSE n + ws[w.i + 1] END FROM w JOIN z ON w.doc_id = z.doc_id WHERE w.i < len(ps))
 SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, content, CAST(len(regexp_split_to_array(content, '\s+')) AS INTEGER) AS n_words FROM (SELECT w.doc_id AS doc_id, chunk, string_agg(ps[w.i], chr(10) || chr(10) ORDER BY w.i) AS content FROM w JOIN z ON w.doc_id = z.doc_id GROUP BY w.doc_id, chunk)"""
