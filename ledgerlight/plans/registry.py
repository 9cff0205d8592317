"""The registered queries on the sales fact."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grounding as g
from ..functions import lexicons as lx
from ..functions import routing as u
from ..functions import text as tx
from ..operators import anomalies as a
from ..operators import checks as v
from ..operators import facts as fa
from ..operators import inverted as iv
from ..operators import reports as rp
from ..operators import retrieval as x
from ..operators import rules as r
from ..operators import kpis as k
from ..operators import scopes as q
from ..operators.measures import by, measure, top
from ..sources import sales as src
from ..sources import store as st
from ..sources import tables as t
from . import oracle_facts, oracle_text
from .oracle import ORACLE

YEARS = list(range(1995, 2002))  # the years of the test data, as a pivot needs them


def on_sales(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: fn(src.sales_fact(spark, d))


def _profile(s: DataFrame) -> DataFrame:
    members = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return s.agg(F.count("*").alias("n_rows"), F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"), members("region").alias("regions"), members("category").alias("categories"), members("segment").alias("segments"), measure("sales"), F.min("sales").cast("double").alias("least"), F.max("sales").cast("double").alias("most"), *[measure(n) for n in ("orders", "basket", "clients", "products")])


def _members(s: DataFrame) -> DataFrame:
    pairs = s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("member")) for c in ("region", "category", "segment", "year")])).alias("x"))
    return pairs.select("x.*").distinct()


def _verify(s: DataFrame) -> DataFrame:
    return s.agg(F.count("*").alias("n_rows"), measure("sales"), F.countDistinct("year").alias("n_years"), F.countDistinct("region").alias("n_regions"), F.count_if((F.col("region") == "ASIA") & (F.col("year") == 1998)).alias("sample_rows"), ((F.min("year") == YEARS[0]) & (F.max("year") == YEARS[-1])).alias("expected_years"))


ASIA = {"region": "ASIA"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s5_reject_counts": lambda spark, d: src.reject_counts(src.star_rows(spark, d)),
    "s7_calendar": on_sales(lambda s: s.select("order_id", "line_number", "order_date", "ship_date", "year", "quarter", "month", "week", "day_of_week", "ship_delay_days")),
    "s9_grain": lambda spark, d: src.conform(src.star_rows(spark, d), keep_non_positive=True).select("order_id", "line_number", "order_date", "year", "quarter", "month", "customer_id", "segment", "region", "category", "sub_category", "product_name", F.col("sales").cast("double").alias("sales")),
    "s10_verify": on_sales(_verify),
    "s11_profile": on_sales(_profile),
    "s12_members": on_sales(_members),
    "s18_row_counts": lambda spark, d: t.row_counts({n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("customer", "documents", "lineitem", "orders", "part")}),
    "s19_stale_audit": lambda spark, d: t.stale_audit(spark.read.parquet(f"{d}/documents.parquet"), ("apache license", "all rights reserved")),
    "k1_region_quarter": on_sales(k.region_quarter),
    "k2_category_year": on_sales(k.category_year),
    "k3_top_products": on_sales(k.top_products),
    "k4_variation": on_sales(k.variation),
    "k5_annual": on_sales(k.annual),
    "k6_best_region": on_sales(k.best_region),
    "k7_monthly": on_sales(k.monthly),
    "k8_segment_year": on_sales(k.segment_year),
    "k9_ship_modes": on_sales(k.ship_modes),
    "k10_top_clients": on_sales(k.top_clients),
    "k11_top_states": on_sales(k.top_states),
    "k12_weekdays": on_sales(k.weekdays),
    "k13_region_matrix": on_sales(lambda s: k.region_matrix(s, YEARS)),
    "k14_segment_share": on_sales(k.segment_share),
    "k15_global_recap": on_sales(k.global_recap),
    "q2_summary": on_sales(q.summary),
    "q2_summary_region": on_sales(lambda s: q.summary(s, **ASIA)),
    "q2_summary_region_year": on_sales(lambda s: q.summary(s, year=1998, **ASIA)),
    "q3_annual_scoped": on_sales(lambda s: q.annual_series(s, **ASIA)),
    "q5_region_detail": on_sales(lambda s: by(q.scoped(s, category="PROMO"), ["region", "year", "quarter"], ["sales", "orders", "basket"])),
    "q6_region_summary": on_sales(lambda s: by(q.scoped(s, year=1998), ["region"], ["sales", "orders", "basket"])),
    "q7_category_detail": on_sales(lambda s: k.category_year(q.scoped(s, **ASIA))),
    "q8_category_summary": on_sales(lambda s: by(q.scoped(s, **ASIA), ["category"], ["sales", "articles"])),
    "q9_sub_categories": on_sales(lambda s: q.sub_categories(s, 7, **ASIA)),
    "q10_quarterly": on_sales(lambda s: q.quarterly_series(s, **ASIA)),
    "q10_quarterly_post": on_sales(lambda s: q.quarterly_series(s, "post", year=1998, **ASIA)),
    "q11_monthly": on_sales(lambda s: k.monthly(q.scoped(s, **ASIA))),
    "q12_segments": on_sales(lambda s: k.segment_year(q.scoped(s, **ASIA))),
    "q13_segment_summary": on_sales(lambda s: by(q.scoped(s, **ASIA), ["segment"], ["sales", "orders", "basket", "clients"])),
    "q14_top_products": on_sales(lambda s: top(by(q.scoped(s, year=1998), ["sub_category"], ["sales", "articles", "basket", "clients"]), 10, "sales", "sub_category")),
    "q15_top_clients": on_sales(lambda s: k.top_clients(q.scoped(s, **ASIA), 5)),
    "q18_all_scopes": on_sales(q.all_scopes),
    "q19_period_deltas": on_sales(q.period_deltas),
    "q20_variation_buckets": on_sales(lambda s: q.variation_buckets(k.variation(s))),
    "a1_anomalies": on_sales(a.anomalies),
    "a1_anomalies_scoped": on_sales(lambda s: a.anomalies(s, year=1998, **ASIA)),
    "a2_consecutive": on_sales(a.consecutive_anomalies),
    "a3_main_anomaly": on_sales(a.main_anomaly),
    "q21_level_counts": on_sales(lambda s: a.level_counts(a.consecutive_anomalies(s, ["region"]), ["region"])),
}


def _structure(s: DataFrame) -> DataFrame:
    x = F.col("structure")
    texts = lambda c: F.array_join(c, "; ")
    return r.structured(fa.facts(s)).select("scope", x["summary"].alias("summary"), x["main_trend"].alias("main_trend"), x["best_period"]["label"].alias("best_quarter"), x["worst_period"]["label"].alias("worst_quarter"), F.array_join(x["top_products"], ",").alias("top_products"), x["key_segment"].alias("key_segment"), texts(x["risks"]).alias("risks"), texts(x["opportunities"]).alias("opportunities"), texts(F.transform(x["recommendations"], lambda y: y["action"])).alias("actions"))


def _merged(s: DataFrame) -> DataFrame:
    facts = fa.facts(s)
    external = r.default_recommendations(facts).select("scope", F.concat(F.lit("D"), F.col("ord").cast("string")).alias("rule"), F.lit("medium").alias("priority"), "action")
    return r.merged(r.recommendations(facts), external, 4)


def _toned(s: DataFrame) -> DataFrame:
    return r.performance_score(fa.facts(s)).select("scope", "score", r.visual_tone(F.col("score"), F.col("volatility_short")).alias("tone"))


def _checks(s: DataFrame) -> DataFrame:
    return v.all_checks(s, k.annual(s), k.region_quarter(s))


def _stored_annual(s: DataFrame) -> DataFrame:
    """The stored annual table, a range of years."""
    return t.settled(k.annual(s), "annual").filter(F.col("year").between(1996, 1999)).select("year", "sales", "orders", "yoy_pct")


def _latest(s: DataFrame) -> DataFrame:
    """Reports of two dates appended to one table; the newest of each scope."""
    texts = r.answer(fa.facts(s)).select(F.col("scope"), F.col("answer").alias("report"))
    at = lambda day, kept: texts.filter(kept).select(F.lit(day).alias("report_id"), F.lit(None).cast("int").alias("year"), F.when(F.col("scope").startswith("region:"), F.substring("scope", 8, 100)).alias("region"), F.when(F.col("scope").startswith("category:"), F.substring("scope", 10, 100)).alias("category"), F.concat(F.lit(f"{day}: "), "report").alias("report"), F.to_timestamp(F.lit(f"2024-01-0{day} 00:00:00")).alias("generated_at"))
    path = t.shared_path(s.sparkSession, "reports")
    t.append_reports(at(1, F.lit(True)), path)
    t.append_reports(at(2, ~F.col("scope").startswith("category:")), path)
    return t.latest_per_scope(s.sparkSession.read.parquet(path)).select("report_id", "region", "category", "report")


def _dashboard(s: DataFrame) -> DataFrame:
    report = r.narrative(fa.facts(s)).filter("scope = 'region:ASIA'")
    return q.part_counts(q.dashboard(s, a.anomalies(s, **ASIA), report, **ASIA))


def _written_index(s: DataFrame) -> DataFrame:
    """The index of passages and of report texts, written and read back."""
    path = t.shared_path(s.sparkSession, "index")
    x.write_index(x.embedded(x.kpi_passages(s)), path)
    stored = s.sparkSession.read.parquet(path)
    return stored.groupBy("chunk_type", "filter_region").agg(F.count("*").alias("n"), F.count("filter_year").alias("with_year"))


def _report_passages(s: DataFrame) -> DataFrame:
    facts = fa.facts(s)
    return x.report_passages(r.narrative(facts).join(r.bullets(facts), "scope"), "scope", ["bullet1", "bullet2", "bullet3"])


SCORES = ["scope", "growth_points", "regularity_points", "quarter_points", "diversity_points", "score", "mention"]
QUERIES |= {
    "f1_facts": on_sales(lambda s: fa.facts(s).select(*oracle_facts.SCALARS)),
    "f2_year_facts": on_sales(lambda s: fa.facts(s, "full").select(*oracle_facts.SCALARS)),
    "r1_year_scores": on_sales(lambda s: r.performance_score(fa.facts(s, "full")).select(*SCORES)),
    "r1_scores": on_sales(lambda s: r.performance_score(fa.facts(s)).select(*SCORES)),
    "r2_recommendations": on_sales(lambda s: r.recommendations(fa.facts(s))),
    "r2_recommendations_french": on_sales(lambda s: r.recommendations(fa.facts(s), "fr")),
    "r3_merged": on_sales(_merged),
    "r4_traces": on_sales(lambda s: r.traces(fa.facts(s))),
    "r5_default_recommendations": on_sales(lambda s: r.default_recommendations(fa.facts(s))),
    "r6_risks": on_sales(lambda s: r.risks_and_opportunities(fa.facts(s))),
    "r8_structure": on_sales(_structure),
    "r11_bullets": on_sales(lambda s: r.bullets(fa.facts(s))),
    "r11_bullets_french": on_sales(lambda s: r.bullets(fa.facts(s), "fr")),
    "r12_record_narrative": on_sales(lambda s: r.narrative_of_record(r.structured(fa.facts(s)))),
    "r13_narrative": on_sales(lambda s: r.narrative(fa.facts(s))),
    "r13_narrative_french": on_sales(lambda s: r.narrative(fa.facts(s), "fr")),
    "q17_dashboard": on_sales(_dashboard),
    "q19_extremes": on_sales(q.period_extremes),
    "x7_report_passages": on_sales(_report_passages),
    "x9_written_index": on_sales(_written_index),
    "a4_scope_anomalies": on_sales(lambda s: t.settled(rp.found_in_facts(fa.facts(s)), "anomalies")),
    "q4_annual_stored": on_sales(_stored_annual),
    "q16_recap_stored": on_sales(lambda s: t.settled(k.global_recap(s), "recap").select("sales", "orders", "best_year", "best_region")),
    "r17_visual_tone": on_sales(_toned),
    "r18_answer": on_sales(lambda s: r.answer(fa.facts(s))),
    "v_checks": on_sales(_checks),
    "v8_roll_up": on_sales(lambda s: v.rolled_up(_checks(s))),
}


#: Columns of the star rows as a sales file has them.
_FILE = ["order_id", "line_number", "order_date", "ship_date", "ship_mode", "customer_id", "customer_name", "segment", "state", "region", "product_id", "category", "sub_category", "product_name", "sales"]


def _broken_file(s: DataFrame, path: str) -> T.StructType:
    """The fact as lines of a sales file, all of it, with faults put in by order and line: lost columns, amounts and dates that do not parse."""
    fault = (F.col("order_id") * 7 + F.col("line_number")) % 50
    date = lambda c: F.date_format(c, "dd/MM/yyyy")
    values = {"order_date": F.when(fault == 1, "31/02/2017").otherwise(date("order_date")), "ship_date": date("ship_date"), "sales": F.when(fault == 2, "n/a").otherwise(F.col("sales").cast("string"))}
    cells = [values.get(c, F.col(c).cast("string")) for c in _FILE]
    s.select(F.when(fault == 3, F.concat_ws(",", *cells[:5])).otherwise(F.concat_ws(",", *cells)).alias("line")).write.text(path)
    return T.StructType([T.StructField(c, T.StringType()) for c in _FILE])


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    """A sales file with broken lines, loaded in one pass: rows kept by year, rejects by reason, and the counts that the load returned."""
    path = t.shared_path(spark, "load")
    schema = _broken_file(src.star_rows(spark, d), f"{path}/file")
    store = st.SalesStore(spark, path)
    counts = store.load(st.read_csv_lines(spark, f"{path}/file", schema, header=False), 1)
    kept = store.grain().groupBy(F.lit("kept").alias("what"), F.col("year").cast("string").alias("item")).agg(F.count("*").alias("n"), F.round(F.sum("sales").cast("double"), 2).alias("sales"))
    rejected = store.rejects().groupBy(F.lit("rejected").alias("what"), F.col("reason").alias("item")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("sales"))
    told = spark.createDataFrame([("counted", k, v, None) for k, v in counts.items() if k != "years"], kept.schema)
    return reduce(DataFrame.unionByName, [kept, rejected, told])


def _increments(spark: SparkSession, d: str) -> st.SalesStore:
    """The fact in three loads, of which the last holds a year again."""
    rows = src.star_rows(spark, d)
    store = st.SalesStore(spark, t.shared_path(spark, "store"))
    for k, kept in enumerate(("year(order_date) <= 1998", "year(order_date) >= 1999", "year(order_date) = 1998")):
        store.load(rows.filter(kept), k)
    return store


def _grain_year(spark: SparkSession, d: str) -> DataFrame:
    grain = _increments(spark, d).grain().filter("year = 1998")
    return grain.groupBy("year", "region", "category").agg(measure("sales"), F.count("*").alias("articles"))


QUERIES |= {
    "s9_one_pass_load": _loaded,
    "s14_incremental_annual": lambda spark, d: _increments(spark, d).annual(),
    "s14_incremental_region_quarter": lambda spark, d: _increments(spark, d).region_quarter(),
    "s14_incremental_products": lambda spark, d: _increments(spark, d).top_products(),
    "s14_grain_year": _grain_year,
}


def on_docs(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: fn(spark.read.parquet(f"{d}/documents.parquet"))


def _polarity(docs: DataFrame) -> DataFrame:
    lexicon = docs.sparkSession.createDataFrame(list(lx.POLARITY.items()), "term string, weight double")
    return tx.polarity(docs, F.broadcast(lexicon), "doc_id")


def _ungrounded(s: DataFrame) -> DataFrame:
    """Numbers of each scope's report, and of the whole's report read as every other scope's, that no fact backs."""
    facts = fa.facts(s)
    reports = r.narrative(facts)
    other = F.broadcast(reports.filter("scope = 'all'").select(F.col("report").alias("text")))  # one row
    texts = reports.select("scope", F.col("report").alias("text")).unionByName(reports.select("scope").crossJoin(other))
    return g.unsupported(g.numbers(texts, "scope"), g.allowed_values(facts)).groupBy("scope", "kind", "raw").agg(F.count("*").alias("n"))


def _accepted(s: DataFrame) -> DataFrame:
    """Three kinds of candidates: the scope's own report, for regions the report of the whole, for categories one sentence."""
    facts = fa.facts(s)
    own, short = r.narrative(facts), r.answer(facts).withColumnRenamed("answer", "report")
    whole = F.broadcast(own.filter("scope = 'all'").select("report"))  # one row
    regions = own.filter("scope like 'region:%'").select("scope").crossJoin(whole)
    candidates = own.filter("scope = 'all'").unionByName(regions).unionByName(short.filter("scope like 'category:%'"))
    return rp.checked_reports(facts, candidates)


def _corrected(s: DataFrame) -> DataFrame:
    """Actions and justifications with a true and a false number each."""
    facts = fa.facts(s)
    made = lambda ord_, total: facts.select("scope", F.lit(ord_).alias("ord"), F.concat(F.lit("Grow beyond "), r.number(total, 0), F.lit(" USD soon")).alias("action"), F.concat(F.lit("Sales were "), r.number(total, 0), F.lit(" USD")).alias("justification"))
    return rp.corrected_actions(made(1, F.col("total")).unionByName(made(2, F.col("total") * 1000 + 7)), facts)


def _broken_records(facts: DataFrame) -> DataFrame:
    """``scope, way, raw``: the record of each scope as JSON, broken in ten ways."""
    x = F.col("structure")
    flat = r.structured(facts).select("scope", F.to_json(F.struct(x["summary"].alias("summary"), x["main_trend"].alias("main_trend"), x["best_period"]["label"].alias("best_period"), x["worst_period"]["label"].alias("worst_period"), x["top_products"].alias("top_products"), x["key_segment"].alias("key_segment"), x["risks"].alias("risks"), x["opportunities"].alias("opportunities"), x["recommendations"].alias("recommendations"))).alias("j"))
    ways = [
        F.col("j"), F.concat(F.lit("```json\n"), "j", F.lit("\n```")), F.concat(F.lit("Here it is: "), "j", F.lit(" - done.")), F.lit("no record here"), F.lit(None).cast("string"),
        F.lit('{"summary": "  ", "main_trend": 5, "best_period": null, "risks": 7}'), F.lit('{"summary": "Own.", "top_products": ["x", "y"]}'),
        F.lit('{"recommendations": [{"action": "a", "priority": "LOW", "level": "odd"}, {"action": " "}, "text", {"action": "b", "priority": "high", "level": "tactical"}]}'),
        F.lit('```\n{"recommendations": [{"action": "c", "priority": "urgent", "level": "Strategic", "confidence": "HIGH", "justification": "j"}]}\n```'),
        F.lit('{"risks": [], "opportunities": "none", "top_products": ["x", "y", "z"]}'),
    ]
    return flat.select("scope", F.posexplode(F.array(*ways)).alias("way", "raw"))


def _repaired(s: DataFrame) -> DataFrame:
    facts = fa.facts(s)
    fixed = rp.repaired_records(_broken_records(facts), facts, ["scope", "way"])
    said = F.transform("recommendations", lambda y: F.concat_ws("/", y["action"], y["priority"], y["level"], y["confidence"], y["justification"]))
    return fixed.withColumns({"top_products": F.array_join("top_products", ","), "risks": F.array_join("risks", "; "), "opportunities": F.array_join("opportunities", "; "), "recommendations": F.array_join(said, ";")})


def _cosine(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("passage_id"), "embedding")
    return x.cosine_top(v.filter("passage_id % 20 = 0").withColumnRenamed("passage_id", "query_id"), v)


QUERIES |= {
    "t1_statistics": on_docs(lambda d: tx.statistics(d, "doc_id")),
    "t5_keywords": on_docs(lambda d: tx.keywords(d, "doc_id")),
    "t6_entities": on_docs(lambda d: tx.entities(d, "doc_id")),
    "t7_intents": on_docs(lambda d: tx.intents(d, "doc_id")),
    "t8_coverage": on_docs(lambda d: tx.coverage(tx.intents(d, "doc_id"), "doc_id")),
    "t9_themes": on_docs(lambda d: tx.dominant_themes(tx.theme_counts(d, "doc_id"), "doc_id")),
    "t10_tone": on_docs(lambda d: tx.tone(tx.theme_counts(d, "doc_id"), "doc_id")),
    "t11_polarity": on_docs(_polarity),
    "t13_markdown": on_docs(lambda d: d.select("doc_id", tx.strip_markdown(F.col("text")).alias("plain"))),
    "t14_fact_coverage": on_sales(lambda s: tx.fact_coverage(r.narrative(fa.facts(s)), fa.facts(s))),
    "t15_quality": on_docs(lambda d: tx.quality(d, "doc_id")),
    "g1_numbers": on_docs(lambda d: g.numbers(d, "doc_id").drop("bare", "extract")),
    "g4_unsupported": on_sales(_ungrounded),
    "r14_accepted": on_sales(_accepted),
    "g5_corrected": on_sales(_corrected),
    "r9_repaired_records": on_sales(_repaired),
    "s15_latest_reports": on_sales(_latest),
    "u6_suggestions": lambda spark, d: u.routed(spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'user'")).select("conv_id", "turn", F.array_join(u.suggestions(F.col("route"), "en"), "|").alias("suggestions")),
    "t16_labels": on_docs(lambda d: tx.dominant_themes(tx.theme_counts(d, "doc_id"), "doc_id").select("doc_id", F.array_join(F.transform(tx.labelled_themes(F.col("themes")), lambda x: F.concat_ws("=", x["theme"], x["n"].cast("string"))), ";").alias("labels"))),
    "t15_total": on_docs(lambda d: tx.text_score(d, "doc_id").select("doc_id", "total", "label", "gaps")),
    "u6_routing": lambda spark, d: u.routed(spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'user'")).select("conv_id", "turn", "route", "engine"),
    "x1_passages": on_sales(x.kpi_passages),
    "x7_packed_paragraphs": on_docs(lambda d: x.packed_paragraphs(d, "doc_id")),
    "x8_embedded": on_sales(lambda s: x.embedded(x.kpi_passages(s)).select("chunk_id", "embedding")),
    "x10_cosine_top": _cosine,
    "x11_index_stats": on_sales(lambda s: x.index_stats(x.kpi_passages(s))),
}


def _pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every twentieth vector and each other one."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("passage_id"), "embedding")
    return x.scored_pairs(v.filter("passage_id % 20 = 0").withColumnRenamed("passage_id", "query_id"), v)


def _in_cells(spark: SparkSession, d: str) -> DataFrame:
    """The vectors stored as an inverted file, and searched for every twentieth of them."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("passage_id"), "label", "embedding")
    stored = iv.InvertedFile(spark, t.shared_path(spark, "cells"))
    stored.build(v, metadata=["label"])
    return stored.search(v.filter("passage_id % 20 = 0").withColumnRenamed("passage_id", "query_id"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    s = src.sales_fact(spark, d)
    turns = u.routed(spark.read.parquet(f"{d}/conversations.parquet").filter("role = 'user'"))
    facts = fa.facts(s)
    contexts = t.settled(rp.intent_contexts(facts, k.top_clients(s, 5), k.top_products(s, 5), rp.found_in_facts(facts).filter("scope = 'all'")), "contexts")
    asked = turns.filter("engine = 'retrieval'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "conv_id", "turn", "text")
    texts = t.settled(x.embedded(x.kpi_passages(s)).select(F.col("chunk_id").alias("passage_id"), "content", "embedding"), "passages")
    near = x.cosine_top(x.embedded(asked, "text"), texts).join(texts.select("passage_id", "content"), "passage_id").join(asked.select("query_id", "conv_id", "turn"), "query_id")
    found = near.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda p: p["content"]), "; ").alias("passages"))
    return rp.question_context(turns, facts, contexts, found)


def _analysis(docs: DataFrame) -> DataFrame:
    lexicon = docs.sparkSession.createDataFrame(list(lx.POLARITY.items()), "term string, weight double")
    return rp.analysis(docs, "doc_id", F.broadcast(lexicon))  # a dozen words


QUERIES |= {
    "r7_scope_advice": on_sales(lambda s: rp.scope_advice(s, a.anomalies(s))),
    "r15_all_reports": on_sales(lambda s: rp.all_reports(s).drop("structure")),
    "t12_analysis": on_docs(_analysis),
    "u7_question_context": _context,
    "x10_cosine_cells": _in_cells,
    "x8_encoded": lambda spark, d: x.encoded(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), x.letter_encoder(8), 8, "text").select("doc_id", "encoded", F.array_join(F.transform("embedding", lambda v: v.cast("int").cast("string")), ",").alias("counts")),
    "t4_domain_stop_words": on_docs(lambda d: tx.keywords(d, "doc_id", stop_words=tx.frequent_words(d, "doc_id"))),
    "x12_pairwise": _pairwise,
}
ORACLE_SQL = ORACLE | oracle_facts.ORACLE | oracle_text.ORACLE
