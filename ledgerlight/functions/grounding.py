"""Numbers in texts: extraction, parsing, and whether a fact backs them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import filled

# What counts as a number. The groups of AMOUNT: two characters before,
# a dollar sign, the number (blanks or commas may part thousands), the suffix, and six characters of what follows.
AMOUNT = r"(?s)(?<![A-Za-z\d])(?<=(..|^.|^))(\$?)(\d{1,3}(?:[,\s]\d{3})+|\d+(?:[.,]\d+)?)\s*([kKmM])?(?=(.{0,6}))"
PERCENT = r"([+-]?\d+(?:[.,]\d+)?)\s*%"
MULTIPLES = {"k": 1e3, "m": 1e6}
YEARS = (2010, 2030)  # bare numbers from these years are dates


def parsed_number(text: Column) -> Column:
    """With both marks the comma parts thousands; alone it is a decimal point if it is the only one with at most two digits after it."""
    t = F.replace(text, F.lit(" "), F.lit(""))
    decimal = ~t.contains(".") & t.rlike(r"^[^,]*,\d{0,2}$")
    return F.when(decimal, F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit(""))).try_cast("double")


def numbers(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``kind, raw, extract, value, bare`` of every amount and every percentage; ``extract`` is all of it, with sign, suffix or percent mark.

    An amount has a dollar sign, a suffix k or M (in either case), or USD, EUR or a dollar
    sign close by; ``bare`` tells one whose only mark is EUR.
    """
    t = df.select(id_col, filled(text_col).alias("t"))
    group = lambda i: F.regexp_extract_all("t", F.lit(AMOUNT), F.lit(i))
    found = t.select(id_col, F.explode(F.arrays_zip(*[group(i).alias(n) for i, n in enumerate(("extract", "before", "sign", "raw", "suffix", "after"))])).alias("x")).select(id_col, "x.*")
    dollar = F.col("before").contains("$") | (F.col("sign") != "") | F.col("after").contains("$") | F.col("after").contains("USD")
    suffixed = F.col("suffix") != ""
    multiple = F.when(F.lower("suffix") == "k", MULTIPLES["k"]).when(F.lower("suffix") == "m", MULTIPLES["m"]).otherwise(1.0)
    amounts = found.filter(dollar | suffixed | F.col("after").contains("EUR")).select(id_col, F.lit("amount").alias("kind"), "raw", F.trim("extract").alias("extract"), (parsed_number(F.col("raw")) * multiple).alias("value"), (~dollar & ~suffixed).alias("bare"))
    marked = lambda i: F.regexp_extract_all("t", F.lit(PERCENT), F.lit(i))
    percents = t.select(id_col, F.lit("percent").alias("kind"), F.inline(F.arrays_zip(marked(1).alias("raw"), marked(0).alias("extract"))))
    percents = percents.select(id_col, "kind", "raw", F.trim("extract").alias("extract"), F.replace("raw", F.lit(","), F.lit(".")).try_cast("double").alias("value"), F.lit(False).alias("bare"))
    return amounts.unionByName(percents).filter("value is not null")


def allowed_values(facts: DataFrame) -> DataFrame:
    """``scope, value, label``: every number that a text of the scope may state."""
    c = F.col
    entry = lambda v, label: F.struct(v.cast("double").alias("value"), (label if isinstance(label, Column) else F.lit(label)).alias("label"))
    named = lambda *parts: F.concat_ws(" ", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    listed = lambda column, make: F.flatten(F.transform(column, lambda x: F.array(*make(x))))
    single = F.array(*[entry(c(n), n) for n in ("total", "growth_pct", "volatility", "region_share", "top1_share")])
    tops = c("products")
    sums = F.array(
        entry(F.when(F.size(tops) >= 2, tops[0]["sales"] + tops[1]["sales"]), "first two products"),
        entry(F.when(F.size(tops) >= 3, tops[0]["sales"] + tops[1]["sales"] + tops[2]["sales"]), "first three products"),
    )
    parts = [
        single,
        sums,
        listed("annual", lambda x: [entry(x[n], named(n, x["year"])) for n in ("sales", "orders", "basket", "yoy_pct")]),
        listed("quarters", lambda x: [entry(v, named(n, x["quarter"], x["year"])) for n, v in (("sales", x["sales"]), ("variation", x["qoq_pct"]), ("size of variation", F.abs(x["qoq_pct"])))]),
        listed("products", lambda x: [entry(x[n], named(n, x["name"])) for n in ("sales", "articles")]),
        listed("segments", lambda x: [entry(v, named(n, x["segment"])) for n, v in (("sales", x["sales"]), ("orders", x["orders"]), ("share", x["sales"] * 100 / c("total")))]),
        listed("regions", lambda x: [entry(x["sales"], named("sales", x["region"], x["year"]))]),
        listed("months", lambda x: [entry(x[n], named(n, x["year"], x["month"])) for n in ("sales", "orders")]),
    ]
    return facts.select("scope", F.explode(F.concat(*parts)).alias("x")).select("scope", "x.*").filter("value is not null")


BIN = 1.02  # ratio of the ends of a bin; slack is four hundredths at most, so a number and what it is near are two bins apart or less


def unsupported(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """Numbers (``scope, kind, value, bare``) near no allowed value of their scope.

    Near is within 4 % for amounts, 1.5 % for percentages, 1.5 where the allowed value is
    below 5. Bare years are no amounts. Numbers and values meet by scope and bin of size
    (each number looks into its own and the bins beside it), so a scope's values are not
    compared with all of its numbers; then the distance decides.
    """
    v, size = F.col("v"), F.abs("v")
    slack = F.when(size < 5, 1.5).otherwise(size * F.when(F.col("kind") == "amount", 0.04).otherwise(0.015))
    # Below 8 a single bin holds all: there the slack is absolute, and 1.5 more than 5 at most.
    place = lambda x: F.when(F.abs(x) < 8, 0).otherwise(F.floor(F.log(F.abs(x)) / float(math.log(BIN))) * F.signum(x)).cast("long")
    reach = 3
    low = place(F.lit(8.0))
    a = allowed.select(F.col("scope").alias("s"), F.col("value").alias("v"), place(F.col("value")).alias("bin"))
    asked = found.filter(~(F.col("bare") & F.col("value").between(*YEARS)))
    keys = ["scope", "kind", "value"]
    own = F.col("own")
    near = F.sequence(own - reach, own + reach)
    # A number in the single bin, or just above it, may be near what lies on the other side of its end.
    edge = F.sequence(low, low + reach)
    looks = F.when(own == 0, F.concat(near, edge, F.transform(edge, lambda b: -b))).when(F.abs(own) <= low + reach, F.concat(near, F.array(F.lit(0).cast("long")))).otherwise(near)
    numbers = asked.select(*keys).distinct().withColumn("own", place(F.col("value"))).select(*keys, F.explode(looks).alias("look"))
    backed = numbers.join(a, (F.col("scope") == F.col("s")) & (F.col("look") == F.col("bin"))).filter(F.abs(F.col("value") - v) <= slack).select(*keys).distinct()
    return asked.join(backed, keys, "left_anti").select(found.columns)


def accepted(reports: DataFrame, bad: DataFrame, plain: DataFrame, of_record: DataFrame, least: int = 400, most_bad: int = 2) -> DataFrame:
    """The report where it is long enough and at most ``most_bad`` of its numbers lack support.

    A short one is replaced by the scope's template (``plain``), one with more unsupported
    numbers by the template of its record (``of_record``); ``gate`` tells which.
    """
    n = bad.groupBy("scope").agg(F.count("*").alias("n_bad"))
    t = reports.join(n, "scope", "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)))
    for df, name in ((plain, "plain"), (of_record, "of_record")):
        t = t.join(df.select("scope", F.col("report").alias(name)), "scope", "left")
    short, wrong = F.length(filled("report")) < least, F.col("n_bad") > most_bad
    gate = F.when(short, "short").when(wrong, "unsupported").otherwise("accepted")
    return t.select("scope", F.when(short, F.col("plain")).when(wrong, F.col("of_record")).otherwise(F.col("report")).alias("report"), gate.alias("gate"), F.col("n_bad").cast("long").alias("n_bad"))
