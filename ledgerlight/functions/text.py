"""Text analytics as column expressions: statistics, intents, themes, tone, quality, markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexicons as lx
from . import terms

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ])"
LETTERS = "^[a-zA-Zà-öø-ÿÀ-ÖØ-Þ]+$"
PERCENT = r"[+-]?\d+(?:[.,]\d+)?\s*%"
MONEY = r"\$\s?\d[\d,]*(?:\.\d+)?|\d[\d ,.]*\s?(?:USD|EUR)\b"
BARE = r"\b\d{2,}(?:[.,]\d+)?\b"


def filled(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def sentences(text: Column, least: int = 5) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def words(text: Column) -> Column:
    """Lower-case words of Latin letters; tokens with digits or underscores are not words."""
    return F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(LETTERS)), F.lower)


def by_language(lang: Column, make) -> Column:
    """``make(lexicon language)`` for French and for any other language."""
    return F.when(lang == "fr", make("fr")).otherwise(make("en"))


def any_of(text: Column, terms: list[str]) -> Column:
    """Whether a term stands in the text; a long list is looped over, to keep generated code small."""
    if len(terms) > 40:
        return F.exists(F.array(*map(F.lit, terms)), lambda t: text.contains(t))
    return reduce(Column.__or__, [text.contains(t) for t in terms])


def statistics(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    t = df.select(id_col, sentences(filled(text_col)).alias("s"), words(filled(text_col)).alias("w"))
    n, k = F.size("w"), F.size("s")
    return t.select(id_col, k.alias("n_sentences"), n.alias("n_words"), F.size(F.array_distinct("w")).alias("n_unique"), F.coalesce(n / F.nullif(k, F.lit(0)), F.lit(0.0)).alias("words_per_sentence"))


def keywords(df: DataFrame, id_col: str, lang_col: str = "lang", text_col: str = "text", n: int = 5, least: int = 4, stop_words: DataFrame | None = None) -> DataFrame:
    """The ``n`` most frequent words of each text without stop words; ties by first place.

    ``stop_words`` is a table ``lang, word`` of any size, left out by an anti-join; without
    one, short lists of English and French words serve.
    """
    placed = df.select(id_col, lang_col, F.posexplode(words(filled(text_col))).alias("pos", "word")).filter(F.length("word") >= least)
    if stop_words is None:
        placed = placed.filter(~by_language(F.col(lang_col), lambda k: F.col("word").isin(lx.STOP_WORDS[k])))
    counted = placed.groupBy(id_col, lang_col, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    if stop_words is not None:
        counted = counted.join(stop_words.select(F.col("lang").alias(lang_col), "word"), [lang_col, "word"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= n).select(id_col, "rank", "word", "n")


def frequent_words(df: DataFrame, id_col: str, share: float = 0.3, lang_col: str = "lang", text_col: str = "text", least: int = 4) -> DataFrame:
    """``lang, word``: words that stand in more than ``share`` of a language's texts, as stop words of a domain."""
    texts = df.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("texts"))
    own = df.select(F.col(lang_col).alias("lang"), F.explode(F.array_distinct(words(filled(text_col)))).alias("word")).filter(F.length("word") >= least)
    return own.groupBy("lang", "word").agg(F.count("*").alias("n")).join(texts, "lang").filter(F.col("n") > share * F.col("texts")).select("lang", "word")


def entities(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    found = lambda p: F.array_distinct(F.regexp_extract_all(filled(text_col), F.lit(p), F.lit(0)))
    return df.select(id_col, F.size(found(MONEY)).alias("n_money"), F.size(found(PERCENT)).alias("n_percent"), F.array_join(found(PERCENT), "|").alias("percents"))


def intents(df: DataFrame, id_col: str, lang_col: str = "lang", text_col: str = "text", lists: terms.Lists = lx.INTENTS, priority: list[str] = lx.INTENT_PRIORITY) -> DataFrame:
    """Sentences of at least ten characters by intent, a row a text; texts without such a sentence too. The first intent of ``priority`` with a term in the sentence counts."""
    parts = df.select(id_col, lang_col, F.transform(sentences(filled(text_col), 10), F.lower).alias("texts"))
    found = terms.first_groups(parts, id_col, lists, priority, lang_col, rest="contexte")
    names = [*priority, "contexte"]
    counts = found.groupBy(id_col).agg(*[F.sum(n).alias(f"n_{n}") for n in names])
    return counts.withColumn("n_classified", reduce(Column.__add__, [F.col(f"n_{n}") for n in names]))


def coverage(counts: DataFrame, id_col: str) -> DataFrame:
    """A quarter of 100 for each of trend, anomaly or risk, opportunity and recommendation."""
    have = [F.col("n_tendance") > 0, (F.col("n_anomalie") > 0) | (F.col("n_risque") > 0), F.col("n_opportunite") > 0, F.col("n_recommandation") > 0]
    score = reduce(Column.__add__, [F.when(h, 25).otherwise(0) for h in have])
    label = F.when(score >= 90, "complete").when(score >= 70, "good").when(score >= 50, "partial").when(score >= 25, "weak").otherwise("none")
    gaps = F.array_compact(F.array(*[F.when(~h, F.lit(n)) for h, n in zip(have, ("trend", "risk", "opportunity", "recommendation"))]))
    return counts.select(id_col, score.alias("coverage"), label.alias("label"), F.array_join(gaps, ",").alias("gaps"))


def theme_counts(df: DataFrame, id_col: str, lang_col: str = "lang", text_col: str = "text", themes: terms.Lists = lx.THEMES) -> DataFrame:
    """Each text's count of every theme's terms, all found in one pass; ``themes`` by language (``terms.table_lists`` reads them from a table)."""
    return terms.group_counts(df, id_col, themes, lang_col, text_col)


def dominant_themes(counts: DataFrame, id_col: str, n: int = 3) -> DataFrame:
    """The ``n`` themes that occur most, ties in the order of the list."""
    listed = F.array(*[F.struct((-F.col(t)).alias("k"), F.lit(i).alias("i"), F.lit(t).alias("theme"), F.col(t).alias("n")) for i, t in enumerate(lx.THEMES["en"])])
    best = F.slice(F.array_sort(F.filter(listed, lambda x: x["n"] > 0)), 1, n)
    return counts.select(id_col, F.array_join(F.transform(best, lambda x: F.concat_ws(":", x["theme"], x["n"].cast("string"))), ", ").alias("themes"))


def tone(counts: DataFrame, id_col: str) -> DataFrame:
    c = F.col
    t = counts.select(id_col, (c("croissance") + c("opportunite")).alias("pos"), (c("decroissance") + c("risque")).alias("neg"), (c("risque") + c("volatilite")).alias("risk"), (c("volatilite") + c("saisonnalite")).alias("unrest"))
    score = F.coalesce(((c("pos") - c("neg")) / F.nullif(c("pos") + c("neg"), F.lit(0)) * 100).cast("int"), F.lit(0))
    t = t.withColumn("score", score)
    return t.select(id_col, "score", F.when(c("score") > 20, "favorable").when(c("score") < -20, "defavorable").otherwise("neutre").alias("tone"), F.when(c("risk") >= 5, "eleve").when(c("risk") >= 2, "modere").otherwise("faible").alias("risk_level"), F.when(c("unrest") >= 3, "instable").otherwise("stable").alias("stability"))


def polarity(df: DataFrame, lexicon: DataFrame, id_col: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Sum of the weights of English words and its value between -1 and 1; other languages: 0. ``lexicon``: ``term, weight``."""
    hits = df.filter(F.col(lang_col) == "en").select(id_col, F.explode(words(filled(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("n")).join(lexicon, "term")
    total = hits.groupBy(id_col).agg(F.sum(F.col("n") * F.col("weight")).alias("x"))
    x = F.round(F.coalesce("x", F.lit(0.0)), 4)
    return df.select(id_col).join(total, id_col, "left").select(id_col, x.alias("total"), F.round(x / F.sqrt(x * x + 15), 4).alias("compound"))


# Markdown rules in the order that they apply; inline code comes before fenced blocks.
# Headings; bold and italic; rules drawn with characters; list marks; code; headings in capitals; lead words; arrows; blanks.
MARKDOWN = [
    (r"(?m)^#{1,6}\s*.*?$", ""), (r"#{1,6}\s*", ""),
    (r"\*\*\*(.+?)\*\*\*", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1"), (r"__(.+?)__", "$1"),
    (r"(?m)^\s*[-—_=═─]{3,}\s*.*?$", ""), (r"(?m)^\s*-{3,}\s*$", ""), (r"\s-{3,}\s", " "),
    (r"(?m)^\s*[\-\*•]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""),
    (r"`([^`]+)`", "$1"), (r"```[\s\S]*?```", ""),
    (r"(?m)^\s*[A-ZÉÈÀÂÎÔÛÇ]{4,}(?:\s+[A-ZÉÈÀÂÎÔÛÇ0-9]{2,}){0,4}\s+", ""),
    (r"(?m)^\s*(?:Analyse|Tendances|Opportunite|Note)\s*:\s*", ""), (r"\s*→\s*", ". "),
    (r" {2,}", " "), (r"\n{3,}", "\n\n"),
]


def strip_markdown(text: Column) -> Column:
    t = filled(text)
    for pattern, to in MARKDOWN:
        t = F.regexp_replace(t, pattern, to)
    return F.regexp_replace(F.regexp_replace(t, r"^[\n ]+", ""), r"\s+$", "")


def parsed_pairs(text: Column) -> Column:
    """``k:v, k`` lists as an array of word and number; no number: null."""
    items = F.filter(F.transform(F.split(filled(text), ","), lambda s: F.trim(s)), lambda x: x != "")
    return F.transform(items, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("word"), F.trim(F.split_part(x, F.lit(":"), F.lit(2))).try_cast("int").alias("freq")))


#: Names of themes for readers, by language.
THEME_LABELS = {
    "en": {"croissance": "Growth", "decroissance": "Decline", "saisonnalite": "Seasonality", "concentration_produit": "Product concentration", "concentration_regionale": "Regional concentration", "volatilite": "Volatility", "fidelisation": "Loyalty", "panier_moyen": "Average basket", "diversification": "Diversification", "risque": "Risk", "opportunite": "Opportunity", "recommandation": "Recommendation"},
    "fr": {"croissance": "Croissance", "decroissance": "Decroissance", "saisonnalite": "Saisonnalite", "concentration_produit": "Concentration produit", "concentration_regionale": "Concentration regionale", "volatilite": "Volatilite", "fidelisation": "Fidelisation", "panier_moyen": "Panier moyen", "diversification": "Diversification", "risque": "Risque", "opportunite": "Opportunite", "recommandation": "Recommandation"},
}


def labelled_themes(themes: Column, language: str = "en") -> Column:
    """A theme list ``name:n, ...`` with readers' names; unknown names stay."""
    names = F.create_map(*[F.lit(x) for pair in THEME_LABELS[language].items() for x in pair])
    return F.transform(parsed_pairs(themes), lambda x: F.struct(F.coalesce(names[x["word"]], x["word"]).alias("theme"), x["freq"].alias("n")))


def banded(x: Column, bands: list[tuple[float, int]], low: int) -> Column:
    """The points of the first bound that ``x`` reaches."""
    points = F.when(F.lit(False), 0)
    for bound, p in bands:
        points = points.when(x >= bound, p)
    return points.otherwise(low)


def quality(df: DataFrame, id_col: str, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Criteria 2 to 6 of the text score: numbers, recommendations, clarity, repetition, vocabulary."""
    t = df.select(id_col, lang_col, filled(text_col).alias("t"), F.lower(filled(text_col)).alias("low"), words(filled(text_col)).alias("w"), sentences(filled(text_col)).alias("s"))
    n, k = F.size("w"), F.size("s")
    numbers = reduce(Column.__add__, [F.size(F.regexp_extract_all("t", F.lit(p), F.lit(0))) for p in (PERCENT, MONEY, BARE)])
    # Only pairs that occur at least four times matter beside the distinct ones; both come from a sorted list.
    pairs = F.when(n > 1, F.zip_with(F.slice("w", 1, F.greatest(n - 1, F.lit(1))), F.slice("w", 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    t = t.select(id_col, lang_col, "low", n.alias("n"), k.alias("k"), F.size(F.array_distinct("w")).alias("unique"), numbers.alias("numbers"), F.array_sort(pairs).alias("pairs"), F.array_distinct("w").alias("vocabulary"))
    m = F.size("pairs")
    # In a sorted list a value stands four times or more where it equals the one three places on; each such value once.
    often = F.size(F.array_distinct(F.filter(F.zip_with(F.slice("pairs", 1, F.greatest(m - 3, F.lit(0))), F.slice("pairs", 4, F.greatest(m - 3, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())))
    t = t.withColumns({"density": F.coalesce(F.col("numbers") * 100 / F.nullif("n", F.lit(0)), F.lit(0.0)), "length": F.coalesce(F.col("n") / F.nullif("k", F.lit(0)), F.lit(0.0)), "variety": F.coalesce(F.col("unique") / F.nullif("n", F.lit(0)), F.lit(0.0)), "fresh": F.coalesce(F.size(F.array_distinct("pairs")) / F.nullif(m, F.lit(0)), F.lit(0.0)), "often": often})
    d, x, often = F.col("density"), F.col("length"), F.col("often")
    verbs = F.size(F.array_intersect("vocabulary", by_language(F.col(lang_col), lambda g: F.array(*map(F.lit, lx.ACTION_VERBS[g])))))
    terms = by_language(F.col(lang_col), lambda g: reduce(Column.__add__, [F.col("low").contains(w).cast("int") for w in lx.BUSINESS_TERMS[g]]))
    scores = {
        "c2_numbers": F.when((d >= 4) & (d <= 12), 25).when((d >= 2) & (d < 4), 18).when((d > 12) & (d <= 18), 22).when((d >= 1) & (d < 2), 10).when(d > 18, 15).otherwise(3),
        "c3_recommendations": banded(verbs, [(5, 15), (3, 11), (1, 6)], 1),
        "c4_clarity": F.when((x >= 12) & (x <= 22), 8).when(((x >= 9) & (x < 12)) | ((x > 22) & (x <= 28)), 6).when(x < 9, 3).otherwise(4) + banded(F.col("variety"), [(0.55, 7), (0.45, 6), (0.35, 4)], 2),
        "c5_repetition": F.when(F.col("n") < 10, 0).when((F.col("fresh") >= 0.85) & (often == 0), 10).when((F.col("fresh") >= 0.75) & (often <= 1), 8).when(F.col("fresh") >= 0.65, 6).when(F.col("fresh") >= 0.55, 4).otherwise(2),
        "c6_vocabulary": banded(terms, [(10, 10), (7, 8), (4, 6), (2, 4)], 1),
    }
    return t.select(id_col, *[v.alias(c) for c, v in scores.items()])


def text_score(df: DataFrame, id_col: str) -> DataFrame:
    """The criteria of ``quality`` with their total (75 at most, as no facts are at hand), its label and the gaps."""
    q = quality(df, id_col)
    total = reduce(Column.__add__, [F.col(c) for c in FULL_MARKS if c in q.columns])
    label = F.when(total >= 85, "excellent").when(total >= 70, "very good").when(total >= 55, "good").when(total >= 40, "fair").otherwise("weak")
    return q.withColumns({"total": total, "label": label, "gaps": score_gaps([c for c in FULL_MARKS if c in q.columns])})


#: The most points of each criterion, and below which share of it a gap is reported.
FULL_MARKS = {"c2_numbers": 25, "c3_recommendations": 15, "c4_clarity": 15, "c5_repetition": 10, "c6_vocabulary": 10}
GAP = 0.6


def score_gaps(names: list[str] = tuple(FULL_MARKS)) -> Column:
    """The criteria with less than six tenths of their points, as text."""
    return F.concat_ws(",", *[F.when(F.col(c) < GAP * FULL_MARKS[c], F.lit(c.split("_", 1)[1])) for c in names])


def fact_coverage(reports: DataFrame, facts: DataFrame, text_col: str = "report") -> DataFrame:
    """Criterion 1: five points each for best year, best and worst quarter, top product and growth within two points."""
    t = reports.join(facts, "scope").withColumn("low", F.lower(filled(text_col)))
    spelled = lambda c: reduce(Column.__or__, [F.col("low").contains(F.concat(F.lit(p), F.substring(c, 2, 1), F.lit(" "), F.substring(c, 4, 4))) for p in ("q", "t", "trimestre ", "quarter ")])
    cited = F.transform(F.regexp_extract_all(F.col("low"), F.lit(r"([+-]?\d+(?:[.,]\d+)?)\s*%"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))
    near = F.exists(cited, lambda x: F.abs(x - F.round(F.col("growth_pct"))) <= 2)
    points = [F.col("low").contains(F.col("best_year").cast("string")), spelled("best_quarter"), spelled("worst_quarter"), F.col("low").contains(F.lower("top_product")), near]
    return t.select("scope", *[F.when(F.coalesce(p, F.lit(False)), 5).otherwise(0).alias(n) for p, n in zip(points, ("year_points", "best_points", "worst_points", "product_points", "growth_points"))])
