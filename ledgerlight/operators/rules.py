"""Scores, recommendations, traces and texts as expressions over the facts table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITIES = ["high", "medium", "low"]


def whole(c: Column) -> Column:
    """Truncated towards zero."""
    return c.cast("int")


def band(score: Column, names: tuple[str, ...] = ("excellent", "very good", "good", "fair", "weak"), bounds: tuple[int, ...] = (85, 70, 55, 40)) -> Column:
    label = F.when(score.isNull(), None)
    for bound, name in zip(bounds, names):
        label = label.when(score >= bound, name)
    return label.otherwise(names[-1])


def performance_score(facts: DataFrame) -> DataFrame:
    """Score of 100: growth 30, regularity 25, best quarter 25, diversity 20."""
    parts = {
        "growth_points": F.least(F.lit(30), F.greatest(F.lit(0), whole(F.coalesce("growth_pct", F.lit(0.0)) / 2))),
        "regularity_points": F.when(F.col("volatility").isNull(), 0).otherwise(F.greatest(F.lit(0), 25 - whole(F.col("volatility") / 3))),
        "quarter_points": F.least(F.lit(25), F.greatest(F.lit(0), whole(F.coalesce("best_qoq", F.lit(0.0)) / 2))),
        "diversity_points": F.least(F.lit(20), F.greatest(F.lit(0), whole((1 - F.col("top1") / F.nullif("top3", F.lit(0.0))) * 40))),
    }
    scored = facts.withColumns(parts).withColumn("score", sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0)))
    return scored.withColumn("mention", band(F.col("score")))


def _record(when: Column, **fields) -> Column:
    return F.when(when, F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _exploded(facts: DataFrame, records: list[Column]) -> DataFrame:
    return facts.select("scope", F.explode(F.filter(F.array(*records), lambda x: x.isNotNull())).alias("r")).select("scope", "r.*")


def _fixed(c: Column, digits: int, plus: str) -> Column:
    """The number as text with no digit after the point or one, rounded as C's printf does: by the binary value, halves to even.

    Spark's ``format_string`` rounds the shortest decimal, halves up: 2.5 is 3 there and 2 here, 0.35 is 0.4 and 0.3.
    """
    if digits not in (0, 1):
        raise ValueError("digits is 0 or 1")
    x = c.cast("double")
    size, bits = F.abs(x), 58  # a half of the last digit, and what is next to it, has no bits beyond these
    whole, half = F.floor(size), 1 << (bits - 1)
    scaled = F.floor((size - whole) * F.lit(float(1 << bits))) * 10**digits
    digit, rest = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit((1 << bits) - 1))
    odd = (digit if digits else whole) % 2 == 1
    digit = digit + F.when((rest > half) | ((rest == half) & odd), 1).otherwise(0)
    carried, last = whole + F.floor(digit / 10**digits), digit % 10**digits
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise(plus)
    text = F.concat(sign, carried.cast("string"), *([F.lit("."), last.cast("string")] if digits else []))
    return F.when(size < float(1 << 63), text).otherwise(F.format_string(f"%{plus}.{digits}f", x))


def number(c: Column, digits: int = 1) -> Column:
    """The number as text; null stays null."""
    return F.when(c.isNotNull(), _fixed(c, digits, ""))


def pick(language: str, en: str, fr: str) -> str:
    return fr if language == "fr" else en


def signed(c: Column, digits: int = 1) -> Column:
    """The number as text with its sign; null stays null."""
    return F.when(c.isNotNull(), _fixed(c, digits, "+"))


def growth_years(facts_annual: Column, most: int = 2) -> Column:
    """The years that grew most, best first, as text; the earlier of equals first."""
    grown = F.transform(F.filter(facts_annual, lambda y: y["yoy_pct"] > 0), lambda y: F.struct((-y["yoy_pct"]).alias("k"), y["year"].alias("year")))
    return F.array_join(F.transform(F.slice(F.array_sort(grown), 1, most), lambda y: F.format_string("%d (%+.1f%%)", y["year"], -y["k"])), ", ")


def recommendations(facts: DataFrame, language: str = "en") -> DataFrame:
    """Rules R1 to R7 for every scope, those that fire, with priority, level, confidence, source and evidence, in English or French."""
    c, t = F.col, lambda en, fr: F.lit(pick(language, en, fr))
    high = lambda cond: F.when(cond, "high").otherwise("medium")
    years = growth_years(c("annual"))
    rules = [
        _record(c("growth_pct") < 0, rule="R1", priority="high", level="strategic", action=t("Launch a recovery plan", "Lancer un plan de relance"), evidence=F.concat(t("growth ", "croissance "), number(c("growth_pct")), F.lit("%")), confidence="high", source="growth"),
        _record(c("region_share") > 35, rule="R2", priority=high(c("region_share") > 50), level="strategic", action=t("Develop the other regions", "Developper les autres regions"), evidence=F.concat("top_region", F.lit(" "), number(c("region_share")), F.lit("%")), confidence="high", source="region_sales"),
        _record(c("top1_share") > 35, rule="R3", priority="medium", level="strategic", action=t("Diversify the product range", "Diversifier l'offre de produits"), evidence=F.concat("top_product", F.lit(" "), number(c("top1_share")), F.lit("%")), confidence="high", source="top_products"),
        _record(c("worst_qoq") < -10, rule="R4", priority=high(c("worst_qoq") < -25), level="tactical", action=t("Prepare the weak quarter", "Preparer le trimestre faible"), evidence=F.concat("worst_quarter", F.lit(" "), number(c("worst_qoq")), F.lit("%")), confidence="medium", source="variation"),
        _record((c("basket_delta") < -2) & (c("orders_delta") > 2), rule="R5", priority="medium", level="tactical", action=t("Raise the basket", "Relever le panier moyen"), evidence=F.concat(t("basket ", "panier "), number(c("basket_delta")), t("%, orders ", "%, commandes "), number(c("orders_delta")), F.lit("%")), confidence="high", source="annual"),
        _record(c("volatility") > 30, rule="R6", priority="high", level="operational", action=t("Smooth the activity", "Lisser l'activite"), evidence=F.concat(t("volatility ", "volatilite "), number(c("volatility")), F.lit("%")), confidence="high", source="volatility"),
        _record(c("growing_years") >= 2, rule="R7", priority="medium", level="tactical", action=t("Repeat what worked in the best years", "Reproduire ce qui a porte les meilleures annees"), evidence=F.concat(t("best years ", "meilleures annees "), years), confidence="high", source="annual yoy"),
    ]
    return _exploded(facts, rules)


def merged(rules: DataFrame, external: DataFrame, most: int = 5) -> DataFrame:
    """High-priority rules, then the external list, then other rules; the first ``most`` of a scope, ordered by priority.

    Both tables have ``scope, rule, priority, action``; ``rule`` orders within a group.
    """
    tier = F.when(F.col("priority") == "high", 0).otherwise(2)
    cols = ["scope", "rule", "priority", "action"]
    every = rules.select(*cols, tier.alias("tier")).unionByName(external.select(*cols, F.lit(1).alias("tier")))
    level = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.lit(0)), F.lit(9))
    kept = every.withColumn("n", F.row_number().over(Window.partitionBy("scope").orderBy("tier", "rule"))).filter(F.col("n") <= most)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(level, "n"))).select(*cols, "rank")


def traces(facts: DataFrame) -> DataFrame:
    """Insights 1 to 8 of each scope with the KPI that they come from and their evidence."""
    c = F.col
    sure = F.when(c("n_years") >= 3, "high").when(c("n_years") == 2, "medium").otherwise("low")
    records = [
        _record(c("growth_pct").isNotNull(), trace=1, insight="trend", source="annual", evidence=F.concat("trend", F.lit(" "), number(c("growth_pct")), F.lit("%")), confidence=sure),
        _record(c("best_year").isNotNull(), trace=2, insight="best year", source="annual", evidence=c("best_year").cast("string"), confidence=F.lit("high")),
        _record(c("top_region").isNotNull(), trace=3, insight="region concentration", source="best_region", evidence=F.concat("top_region", F.lit(" "), number(c("region_share")), F.lit("%")), confidence=F.lit("high")),
        _record(c("top_product").isNotNull(), trace=4, insight="product concentration", source="top_products", evidence=F.concat("top_product", F.lit(" "), number(c("top1_share")), F.lit("%")), confidence=F.lit("medium")),
        _record(c("best_quarter").isNotNull(), trace=5, insight="best quarter", source="variation", evidence=F.concat("best_quarter", F.lit(" "), number(c("best_qoq")), F.lit("%")), confidence=F.lit("high")),
        _record(c("worst_quarter").isNotNull(), trace=6, insight="worst quarter", source="variation", evidence=F.concat("worst_quarter", F.lit(" "), number(c("worst_qoq")), F.lit("%")), confidence=F.lit("high")),
        _record(c("best_segment").isNotNull(), trace=7, insight="leading segment", source="segment_year", evidence=F.concat("best_segment", F.lit(" "), number(c("segment_share")), F.lit("%")), confidence=F.lit("medium")),
        _record(c("volatility").isNotNull(), trace=8, insight="volatility", source="variation", evidence=F.concat("volatility_level", F.lit(" "), number(c("volatility")), F.lit("%")), confidence=sure),
    ]
    return _exploded(facts, records)


def _default_actions() -> Column:
    """Two recommendations as records; steady scopes are trusted more."""
    trust = F.when(F.col("volatility_level") == "low", "high").when(F.col("volatility_level").isin("high", "very high"), "low").otherwise("medium")
    record = lambda i, action: F.struct(F.lit(i).alias("ord"), action.alias("action"), trust.alias("confidence"))
    return F.array(record(1, F.concat(F.lit("Strengthen "), "top_product")), record(2, F.concat(F.lit("Anticipate "), F.coalesce("worst_quarter", F.lit("weak quarters")))))


def default_recommendations(facts: DataFrame) -> DataFrame:
    """Two recommendations for a scope without rules."""
    return facts.select("scope", F.explode(_default_actions()).alias("r")).select("scope", "r.*")


def _outlook() -> Column:
    """Risks and opportunities as records."""
    records = [
        _record(F.col("worst_qoq").isNotNull(), kind="risk", text=F.concat(F.lit("Weak quarter "), "worst_quarter", F.lit(" ("), number(F.col("worst_qoq")), F.lit("%)"))),
        _record(F.lit(True), kind="risk", text=F.concat(F.lit("Dependence on "), "top_product")),
        _record(F.col("best_qoq").isNotNull(), kind="opportunity", text=F.concat(F.lit("Repeat "), "best_quarter", F.lit(" (+"), number(F.col("best_qoq")), F.lit("%)"))),
        _record(F.lit(True), kind="opportunity", text=F.concat(F.lit("Develop segment "), "best_segment")),
    ]
    return F.filter(F.array(*records), lambda x: x.isNotNull())


def risks_and_opportunities(facts: DataFrame) -> DataFrame:
    return facts.select("scope", F.explode(_outlook()).alias("r")).select("scope", "r.*")


def visual_tone(score: Column, risk: Column) -> Column:
    return F.when(risk == "high", "risk").when(score >= 30, "favourable").when((score <= -20) | (risk == "moderate"), "watch").otherwise("neutral")


def bullets(facts: DataFrame, language: str = "en") -> DataFrame:
    """Three summary lines a scope, whole where facts are missing, in English or French."""
    c, t = F.col, lambda en, fr: F.lit(pick(language, en, fr))
    first = F.concat(t("Sales of ", "Ventes de "), number(c("total"), 0), t(" over ", " sur "), "period", F.coalesce(F.concat(t(", growth ", ", croissance "), number(c("growth_pct")), F.lit("%")), F.lit("")))
    compared = c("best_qoq").isNotNull()
    second = F.when(compared, F.concat(t("Best quarter ", "Meilleur trimestre "), "best_quarter", t(", worst ", ", pire "), "worst_quarter")).otherwise(t("No quarterly change to compare", "Aucune variation trimestrielle a comparer"))
    third = F.concat(t("Leading product ", "Produit principal "), "top_product", t(", segment ", ", segment "), "best_segment")
    return facts.select("scope", first.alias("bullet1"), second.alias("bullet2"), third.alias("bullet3"))


TRENDS_FR = {"strong growth": "forte croissance", "growth": "croissance", "slight growth": "legere croissance", "stable": "stable", "slight decline": "leger recul", "strong decline": "fort recul"}
LEVELS_FR = {"low": "faible", "moderate": "moderee", "high": "forte", "very high": "tres forte"}


def _named(column: str, language: str, french: dict[str, str], missing: tuple[str, str]) -> Column:
    c = F.col(column)
    if language == "fr":
        c = F.create_map(*[F.lit(x) for pair in french.items() for x in pair])[c]
    return F.coalesce(c, F.lit(pick(language, *missing)))


def narrative(facts: DataFrame, language: str = "en") -> DataFrame:
    """A template report of four paragraphs a scope, in English or French."""
    c, t = F.col, lambda en, fr: F.lit(pick(language, en, fr))
    trend, level = _named("trend", language, TRENDS_FR, ("not known", "inconnue")), _named("volatility_level", language, LEVELS_FR, ("not known", "inconnue"))
    quarters = F.concat(t("The best quarter is ", "Le meilleur trimestre est "), "best_quarter", t(" with ", " avec "), number(c("best_qoq")), t("%; the weakest is ", "% ; le plus faible est "), "worst_quarter", t(" with ", " avec "), number(c("worst_qoq")), F.lit("%."))
    paragraphs = [
        F.concat(t("Over ", "Sur "), "period", t(" sales reached ", " les ventes atteignent "), number(c("total"), 0), t(" USD. The trend is ", " USD. La tendance est : "), trend, F.coalesce(F.concat(t(" with ", " avec "), number(c("growth_pct")), t("% growth", "% de croissance")), F.lit("")), F.lit(".")),
        F.when(c("best_qoq").isNotNull(), quarters).otherwise(t("No quarterly change can be stated.", "Aucune variation trimestrielle ne peut etre donnee.")),
        F.concat(t("Product ", "Le produit "), "top_product", t(" leads with ", " domine avec "), number(c("top1_share")), t("% of the top three; segment ", "% des trois premiers ; le segment "), "best_segment", t(" holds ", " pese "), number(c("segment_share")), F.lit("%. "), "top_region", t(" is the first region with ", " est la premiere region avec "), number(c("region_share")), F.lit("%.")),
        F.concat(t("Volatility of ", "La volatilite de "), F.coalesce(number(c("volatility")), F.lit("0.0")), t("% is ", "% est "), level, t(". We recommend that the team should strengthen ", ". Nous recommandons a l'equipe de renforcer "), "top_product", t(" and plan for risk in weak quarters.", " et de planifier le risque des trimestres faibles.")),
    ]
    return facts.select("scope", F.concat_ws("\n\n", *paragraphs).alias("report"))


def answer(facts: DataFrame) -> DataFrame:
    """One sentence a scope, for when nothing better can answer."""
    return facts.select("scope", F.concat(F.lit("For "), "scope", F.lit(", sales total "), number(F.col("total"), 0), F.lit(" over "), "period", F.lit(".")).alias("answer"))


def structured(facts: DataFrame) -> DataFrame:
    """The report as a nested record; fewer than three products are filled up with N/A."""
    period = lambda name, value: F.struct(F.col(name).alias("label"), F.col(value).alias("change_pct"))
    names = F.transform("products", lambda p: p["name"])
    tops = F.concat(names, F.array_repeat(F.lit("N/A"), F.greatest(3 - F.size(names), F.lit(0))))
    texts = lambda kind: F.transform(F.filter(_outlook(), lambda x: x["kind"] == kind), lambda x: x["text"])
    advice = F.transform(_default_actions(), lambda x: F.struct(x["action"].alias("action"), F.lit("medium").alias("priority"), F.lit("operational").alias("level"), x["confidence"].alias("confidence")))
    summary = F.concat(F.lit("Sales of "), number(F.col("total"), 0), F.lit(" over "), "period", F.lit("."))
    fields = {"summary": summary, "main_trend": F.coalesce("trend", F.lit("stable")), "best_period": period("best_quarter", "best_qoq"), "worst_period": period("worst_quarter", "worst_qoq"), "top_products": tops, "key_segment": F.col("best_segment"), "risks": texts("risk"), "opportunities": texts("opportunity"), "recommendations": advice}
    return facts.select("scope", F.struct(*[v.alias(k) for k, v in fields.items()]).alias("structure"))


def narrative_of_record(records: DataFrame, language: str = "en") -> DataFrame:
    """A report of four paragraphs from the record of a scope (column ``structure``), without further numbers, in English or French."""
    s, t = F.col("structure"), lambda en, fr: F.lit(pick(language, en, fr))
    connected = F.transform(F.slice(s["recommendations"], 1, 3), lambda r, i: F.concat(F.element_at(F.array(t("First, ", "D'abord, "), t("then, ", "ensuite, "), t("finally, ", "enfin, ")), i + 1), F.lower(F.substring(r["action"], 1, 1)), F.substr(r["action"], F.lit(2))))
    paragraphs = [
        F.concat(s["summary"], t(" The trend stays ", " La tendance reste : "), s["main_trend"], t(".", ".")),
        F.concat(t("The best period is ", "La meilleure periode est "), F.coalesce(s["best_period"]["label"], F.lit("N/A")), t("; the weakest is ", " ; la plus faible est "), F.coalesce(s["worst_period"]["label"], F.lit("N/A")), t(". Between them lies what planning can level out.", ". Entre les deux se trouve ce qu'une planification peut lisser.")),
        F.concat(t("Most sales come from ", "L'essentiel des ventes vient de "), F.array_join(F.slice(s["top_products"], 1, 3), ", "), t("; the leading segment is ", " ; le premier segment est "), F.coalesce(s["key_segment"], F.lit("N/A")), F.lit(". "), F.array_join(F.slice(s["risks"], 1, 2), ". "), F.lit(".")),
        F.when(F.size(s["recommendations"]) > 0, F.concat(F.array_join(connected, "; "), F.lit("."))).otherwise(t("Act on peaks, weak quarters and the product range together.", "Agir a la fois sur les pics, les creux et l'offre.")),
    ]
    return records.select("scope", F.concat_ws("\n\n", *paragraphs).alias("report"))
