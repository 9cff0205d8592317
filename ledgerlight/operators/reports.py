"""Reports of every scope: structured records from noisy text, repair, advice, and the whole report job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grounding, text
from ..sources.tables import settled
from . import facts as fa
from . import rules
from .measures import by

RECORD = "summary string, main_trend string, recommendations array<struct<action:string,priority:string,level:string,confidence:string>>"
LEVELS = {"priority": ["high", "medium", "low"], "level": ["strategic", "tactical", "operational"], "confidence": ["high", "medium", "low"]}


def json_record(raw: Column, schema: str = RECORD) -> Column:
    """The record in a noisy text: as it is, without fences, or the first braces; null if none parses."""
    bare = F.regexp_replace(raw, r"(?m)^```\w*\s*|```\s*$", "")
    braces = F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))
    parse = lambda c: F.when(F.trim(c).startswith("{") & F.trim(c).endswith("}"), F.from_json(F.trim(c), schema))
    some = lambda r: F.when(r["summary"].isNotNull() | r["main_trend"].isNotNull() | r["recommendations"].isNotNull(), r)
    return F.coalesce(some(parse(raw)), some(parse(bare)), some(parse(braces)))


def repaired(df: DataFrame, default_action: str, most: int = 5) -> DataFrame:
    """Columns ``summary, main_trend, recommendations`` of column ``record`` without gaps.

    Blank fields get defaults, unknown levels the middle value, recommendations without an
    action go; with fewer than two the default one is added; ordered by priority.
    """
    r = F.col("record")
    blank = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d))
    one_of = lambda c, name, d: F.when(F.lower(c).isin(LEVELS[name]), F.lower(c)).otherwise(d)
    rec = lambda x: F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS["priority"])), one_of(x["priority"], "priority", "medium")), F.lit(0)), F.lit(9)).alias("order"), F.trim(x["action"]).alias("action"), one_of(x["priority"], "priority", "medium").alias("priority"), one_of(x["level"], "level", "tactical").alias("level"), one_of(x["confidence"], "confidence", "medium").alias("confidence"))
    own = F.transform(F.filter(F.coalesce(r["recommendations"], F.from_json(F.lit("[]"), "array<struct<action:string,priority:string,level:string,confidence:string>>")), lambda x: F.coalesce(F.trim(x["action"]), F.lit("")) != ""), rec)
    spare = F.array(F.struct(F.lit(2).cast("long").alias("order"), F.lit(default_action).alias("action"), F.lit("medium").alias("priority"), F.lit("operational").alias("level"), F.lit("medium").alias("confidence")))
    full = F.slice(F.array_sort(F.when(F.size(own) < 2, F.concat(own, spare)).otherwise(own)), 1, most)
    return df.withColumns({"summary": blank(r["summary"], "No summary"), "main_trend": blank(r["main_trend"], "stable"), "recommendations": full})


UNJUSTIFIED = "Based on analysed data."
_ADVICE = "array<struct<action:string,priority:string,level:string,confidence:string,justification:string>>"


def record_object(raw: Column) -> Column:
    """The JSON object in a noisy text as a variant: the text as it is, without fences, or from its first to its last brace; null if none parses."""
    bare = F.regexp_replace(raw, r"(?m)^\s*```\w*\s*|```\s*$", "")
    found = [F.try_parse_json(F.trim(c)) for c in (raw, bare, F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))]
    return F.coalesce(*[F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in found])


def repaired_records(records: DataFrame, facts: DataFrame, keys: list[str] = ("scope",), most: int = 5) -> DataFrame:
    """The nine fields of each record (text column ``raw``), repaired from the facts of its scope.

    A text field that is missing, blank or no text comes from the facts; so do fewer than
    three products, and empty or missing lists of risks and opportunities. Recommendations
    without an action go; unknown priorities and confidences become medium, unknown levels
    tactical; a missing justification is filled in. With fewer than two, the scope's default
    ones follow. They stand by priority, in their order, ``most`` at most. A text without any
    record gives the defaults; a scope without facts keeps what the record has.
    """
    v = F.col("_v")
    kept = records.select(*keys, record_object(F.col("raw")).alias("_v"))
    own = kept.join(rules.structured(facts), "scope", "left")
    default = F.col("structure")

    def text_of(name: str, spare: Column) -> Column:
        given = F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
        return F.coalesce(F.when(F.trim(given) != "", given), spare).alias(name)

    def list_of(name: str, least: int) -> Column:
        given = F.try_variant_get(v, f"$.{name}", "array<string>")
        return F.coalesce(F.when(F.size(given) >= least, given), default[name]).alias(name)

    def one_of(x: Column, name: str, other: str) -> Column:
        given = F.lower(F.try_variant_get(x, f"$.{name}", "string"))
        return F.when(given.isin(LEVELS[name]), given).otherwise(other).alias(name)

    def advice(x: Column) -> Column:
        why = F.try_variant_get(x, "$.justification", "string")
        return F.struct(F.try_variant_get(x, "$.action", "string").alias("action"), one_of(x, "priority", "medium"), one_of(x, "level", "tactical"), one_of(x, "confidence", "medium"), F.coalesce(F.when(F.trim(why) != "", why), F.lit(UNJUSTIFIED)).alias("justification"))

    none = F.from_json(F.lit("[]"), _ADVICE)
    given = F.coalesce(F.transform(F.try_variant_get(v, "$.recommendations", "array<variant>"), advice), none)
    given = F.filter(given, lambda x: F.coalesce(F.trim(x["action"]), F.lit("")) != "")
    spare = F.coalesce(F.transform(default["recommendations"], lambda x: F.struct(x["action"], x["priority"], x["level"], x["confidence"], F.lit(UNJUSTIFIED).alias("justification"))), none)
    place = lambda x: F.array_position(F.array(*map(F.lit, LEVELS["priority"])), x["priority"])
    both = F.col("_all")
    ordered = F.transform(F.array_sort(F.transform(both, lambda x, i: F.struct(place(x).alias("p"), i.alias("i"), x.alias("x")))), lambda y: y["x"])
    fields = [
        text_of("summary", default["summary"]), text_of("main_trend", default["main_trend"]), text_of("best_period", default["best_period"]["label"]), text_of("worst_period", default["worst_period"]["label"]),
        list_of("top_products", 3), text_of("key_segment", default["key_segment"]), list_of("risks", 1), list_of("opportunities", 1),
    ]
    out = own.select(*keys, *fields, F.when(F.size(given) < 2, F.concat(given, spare)).otherwise(given).alias("_all"))
    return out.withColumn("recommendations", F.slice(ordered, 1, most)).drop("_all")


def without_numbers(text_col: Column, extracts: Column) -> Column:
    """The text without the given extracts, each whole number with its sign, suffix or percent mark, and the brackets around it; longer ones go first, and no part of another number does."""
    longest = F.array_sort(F.array_distinct(F.coalesce(extracts, F.array().cast("array<string>"))), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    pattern = lambda x: F.concat(F.lit(r"\("), quoted(x), F.lit(r"(?: du total| of the total)?\)|(?<![\p{L}\d.,$+-])"), quoted(x), F.lit(r"(?![\p{L}\d%]|[.,]\d|\s*%)"))
    gone = F.aggregate(longest, text_col, lambda t, x: F.regexp_replace(t, pattern(x), F.lit("")))
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(gone, r"\s+", " "), r"\s+,", ","), r",\s*\.", ".")
    return F.trim(F.when(F.size(longest) > 0, tidy).otherwise(text_col))


def scope_advice(s: DataFrame, found: DataFrame) -> DataFrame:
    """One row of advice flags and texts for a scope: alerts, first against last region, category imbalance, growth."""
    regions = by(s, ["region"], ["sales"])
    categories = by(s, ["category"], ["sales"])
    ends = regions.agg(F.max_by("region", F.struct("sales", "region")).alias("top"), F.min_by("region", F.struct("sales", "region")).alias("low"))
    spread = categories.agg(F.max("sales").alias("most"), F.min("sales").alias("least"), F.max_by("category", F.struct("sales", "category")).alias("lead"))
    alerts = found.agg(F.count_if(F.col("level") == "ALERT").alias("n_alerts"))
    years = by(s, ["year"], ["sales"]).agg(F.max_by("sales", "year").alias("z"), F.min_by("sales", "year").alias("a"))
    growth = (F.col("z") - F.col("a")) / F.nullif("a", F.lit(0.0)) * 100
    lines = F.array_compact(
        F.array(
            F.when(F.col("n_alerts") > 0, F.concat(F.lit("Look into "), F.col("n_alerts").cast("string"), F.lit(" alerts"))),
            F.when(F.col("top") != F.col("low"), F.concat(F.lit("Bring "), "low", F.lit(" closer to "), "top")),
            F.when(F.col("most") > 1.3 * F.col("least"), F.concat(F.lit("Category "), "lead", F.lit(" dominates"))),
            F.when(growth > 30, F.lit("Secure the growth")).when(growth < 5, F.lit("Revive the growth")),
        )
    )
    return ends.crossJoin(spread).crossJoin(alerts).crossJoin(years).select(F.array_join(lines, "; ").alias("advice"))  # one row each


def checked_reports(facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """``scope, report, gate, n_bad``: candidate reports, and templates where they are short or state what no fact backs."""
    bad = grounding.unsupported(grounding.numbers(candidates.withColumnRenamed("report", "text"), "scope"), grounding.allowed_values(facts))
    return grounding.accepted(candidates, bad, rules.narrative(facts), rules.narrative_of_record(rules.structured(facts)))


def all_reports(s: DataFrame, lattice: str = "standard") -> DataFrame:
    """Every scope's checked report with its record, summary lines, anomalies, score and text criteria.

    Scopes are the whole, each year, region and category, or as ``lattice`` says. Facts and
    checked reports, a row a scope, are written once; all else reads those.
    """
    facts = fa.facts(s, lattice)
    kept = settled(checked_reports(facts, rules.narrative(facts)), "reports")
    scored = rules.performance_score(facts).select("scope", "score", "mention")
    texts = kept.select("scope", F.lit("en").alias("lang"), F.col("report").alias("text"))
    themes, counts = text.theme_counts(texts, "scope"), text.intents(texts, "scope")
    parts = [
        rules.bullets(facts), scored, text.quality(texts, "scope"), text.fact_coverage(kept, facts), text.dominant_themes(themes, "scope"),
        text.tone(themes, "scope").withColumnRenamed("score", "tone_score"), text.coverage(counts, "scope").withColumnRenamed("label", "coverage_label"),
        rules.structured(facts), found_in_facts(facts).groupBy("scope").agg(F.count("*").alias("n_anomalies"), F.count_if(F.col("level") == "ALERT").alias("n_alerts")),
    ]
    out = kept
    for p in parts:
        out = out.join(p, "scope", "left")
    out = out.fillna(0, ["n_anomalies", "n_alerts"])
    points = sum((F.col(c) for c in CRITERIA), F.lit(0))
    total = F.least(F.lit(100), F.greatest(F.lit(0), points))
    return out.withColumn("text_score", total).withColumn("text_mention", rules.band(total)).withColumn("gaps", text.score_gaps())


CRITERIA = ("c2_numbers", "c3_recommendations", "c4_clarity", "c5_repetition", "c6_vocabulary", "year_points", "best_points", "worst_points", "product_points", "growth_points")


def found_in_facts(facts: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Anomalies of every scope from its quarterly list: changes to the same quarter one year before, at or beyond the threshold."""
    q = facts.select("scope", F.explode("quarters").alias("q")).select("scope", "q.year", "q.quarter", "q.sales")
    w = Window.partitionBy("scope", "quarter").orderBy("year")
    q = q.withColumns({"reference_sales": F.lag("sales").over(w), "reference_year": F.lag("year").over(w)})
    change = F.when(F.col("reference_sales") > 0, (F.col("sales") - F.col("reference_sales")) / F.col("reference_sales") * 100)
    q = q.withColumn("change", change).filter((F.col("year") - F.col("reference_year") == 1) & (F.abs("change") >= threshold))
    return q.select("scope", "year", "quarter", F.round("change", 1).alias("variation_pct"), "sales", "reference_sales", "reference_year", F.when(F.col("change") < 0, "ALERT").otherwise("INFO").alias("level"), F.when(F.col("change") < 0, "yoy_drop").otherwise("yoy_rise").alias("kind"))


def analysis(df: DataFrame, id_col: str, lexicon: DataFrame | None = None) -> DataFrame:
    """The analysis of a text in one row: statistics, intents, coverage, themes, tone, polarity (given a lexicon), keywords."""
    counts, themes = text.intents(df, id_col), text.theme_counts(df, id_col)
    words = text.keywords(df, id_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("k"))
    listed = words.select(id_col, F.array_join(F.transform("k", lambda x: F.concat_ws(":", x["word"], x["n"].cast("string"))), ", ").alias("keywords"))
    out = text.statistics(df, id_col)
    parts = [counts, text.coverage(counts, id_col), text.dominant_themes(themes, id_col), text.tone(themes, id_col)]
    for p in [*parts, text.polarity(df, lexicon, id_col)] if lexicon is not None else parts:
        out = out.join(p, id_col)
    return out.join(listed, id_col, "left").withColumn("keywords", F.coalesce("keywords", F.lit("")))


def corrected_actions(records: DataFrame, facts: DataFrame) -> DataFrame:
    """``scope, ord, action, justification`` without numbers that no fact of the scope backs.

    Those are taken out of the action; a justification with any is replaced by one from the facts.
    """
    keyed = records.withColumn("_row", F.monotonically_increasing_id())
    allowed = grounding.allowed_values(facts)

    def bad(column: str) -> DataFrame:
        found = grounding.numbers(keyed.select(F.struct("scope", "_row").alias("id"), F.col(column).alias("text")), "id").select("id.*", "kind", "extract", "value", "bare")
        return grounding.unsupported(found, allowed).groupBy("_row").agg(F.collect_set("extract").alias(f"bad_{column}"))

    safe = facts.select("scope", F.concat(F.lit("Volatility "), rules.number(F.col("volatility")), F.lit("%; first product "), "top_product", F.lit(".")).alias("_safe"))
    out = keyed.join(bad("action"), "_row", "left").join(bad("justification"), "_row", "left").join(F.broadcast(safe), "scope", "left")  # a row a scope
    return out.select("scope", "ord", without_numbers(F.col("action"), F.col("bad_action")).alias("action"), F.when(F.col("bad_justification").isNotNull(), F.col("_safe")).otherwise(F.col("justification")).alias("justification"))


def intent_contexts(facts: DataFrame, clients: DataFrame, products: DataFrame, found: DataFrame) -> DataFrame:
    """``route, context``: what each intent adds to a question about the whole, a row an intent.

    ``clients`` and ``products`` are the leading ones by sales; ``found`` the anomalies.
    """
    whole = facts.filter("scope = 'all'")
    row = lambda intents, df: df.select(F.explode(F.array(*map(F.lit, intents))).alias("route"), F.col("c").alias("context"))
    money = lambda c: rules.number(c, 0)

    def ranked(df: DataFrame, line, n: int, *ties: str) -> DataFrame:
        top = df.orderBy(F.desc("sales"), *ties).limit(n).agg(F.array_sort(F.collect_list(F.struct((-F.col("sales")).alias("k"), *ties, line.alias("t")))).alias("x"))
        return top.select(F.array_join(F.transform("x", lambda x: x["t"]), "; ").alias("c"))

    sold = ranked(products, F.concat_ws(" ", "sub_category", money(F.col("sales"))), 5, "sub_category")
    bought = ranked(clients, F.concat_ws(" ", F.col("customer_id").cast("string"), money(F.col("sales")), F.col("orders").cast("string"), F.lit("orders")), 5, "customer_id")
    annual = F.array_join(F.transform("annual", lambda y: F.concat(y["year"].cast("string"), F.lit(" "), money(y["sales"]), F.lit(" ("), F.coalesce(rules.signed(y["yoy_pct"]), F.lit("N/A")), F.lit("%)"))), "; ")
    last8 = F.slice("quarters", F.greatest(F.size("quarters") - 7, F.lit(1)), 8)
    quarters = F.array_join(F.transform(last8, lambda q: F.concat(F.lit("Q"), q["quarter"].cast("string"), F.lit(" "), q["year"].cast("string"), F.lit(" "), money(q["sales"]), F.lit(" ("), F.coalesce(rules.signed(q["qoq_pct"]), F.lit("N/A")), F.lit("%)"))), "; ")
    shares = F.array_join(F.transform(F.array_sort(F.transform("region_totals", lambda r: F.struct((-r["sales"]).alias("k"), r["region"].alias("region"), r["sales"].alias("sales")))), lambda r: F.concat_ws(" ", r["region"], money(r["sales"]), F.concat(F.lit("("), rules.number(r["sales"] * 100 / F.col("total")), F.lit("%)")))), "; ")
    alerts = ranked(found.withColumn("sales", F.abs("variation_pct") + F.when(F.col("level") == "ALERT", 1e6).otherwise(0.0)), F.concat(F.col("level"), F.lit(" Q"), F.col("quarter").cast("string"), F.lit(" "), F.col("year").cast("string"), F.lit(" "), rules.signed(F.col("variation_pct")), F.lit("%")), 5, "year", "quarter").select(F.when(F.col("c") == "", "No anomaly").otherwise(F.col("c")).alias("c"))
    fired = rules.recommendations(whole)
    level = lambda df, other: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, rules.PRIORITIES)), F.col("priority")).alias("p"), "rule", "action"))), lambda x: F.concat_ws(" ", x["rule"], x["action"])), "; ").alias("c")).select(F.when(F.col("c") == "", other).otherwise(F.col("c")).alias("c"))
    parts = [
        row(["top_client"], bought), row(["top_product"], sold), row(["anomalie"], alerts),
        row(["prevision"], whole.select(F.concat(F.lit("The data cover "), "period", F.lit(" only; there is no forecast.")).alias("c"))),
        row(["comparaison"], whole.select(F.concat(annual, F.lit(" | "), shares).alias("c"))),
        row(["cause", "tendance"], whole.select(F.concat(annual, F.lit(" | "), quarters).alias("c"))),
        row(["risque"], level(fired.filter("priority = 'high'"), "No major risk")), row(["recommandation"], level(fired, "No rule fires")),
        row(["region"], whole.select(shares.alias("c"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def question_context(routed: DataFrame, facts: DataFrame, contexts: DataFrame, passages: DataFrame | None = None, id_cols: list[str] = ("conv_id", "turn")) -> DataFrame:
    """Each retrieval question with the KPIs of the whole, the context of its intent, and the passages found for it.

    ``passages`` has the id columns and a text ``passages``; contexts are made once for each intent.
    """
    kpis = facts.filter("scope = 'all'").select(F.concat(F.lit("Sales "), rules.number(F.col("total"), 0), F.lit(", growth "), F.coalesce(rules.signed(F.col("growth_pct")), F.lit("N/A")), F.lit("%, first region "), "top_region", F.lit(", period "), "period").alias("kpis"))
    asked = routed.filter("engine = 'retrieval'").join(F.broadcast(contexts), "route", "left").crossJoin(F.broadcast(kpis))  # ten rows and one
    parts = [F.col("kpis"), F.col("context")]
    if passages is not None:
        asked = asked.join(passages, list(id_cols), "left")
        parts.append(F.col("passages"))
    return asked.select(*id_cols, "route", F.concat_ws(" || ", *parts).alias("context"))


def report_listing(reports: DataFrame) -> DataFrame:
    """Reports, newest first; a sort, which Spark does by ranges of the key."""
    return reports.orderBy(F.desc("generated_at"), F.desc("report_id"))
