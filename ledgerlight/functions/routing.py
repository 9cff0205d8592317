"""Routing of user questions, as one expression over a table of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import any_of, filled

SHORT = {"salutation": lx.GREETINGS, "remerciement": lx.THANKS, "affirmation": lx.YES, "negation": lx.NO}


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text)), "[.!?,;: ]+$", "")


def short_intent(text: Column) -> Column:
    q = trimmed(text)
    label = F.when(F.length(q) > 30, "")
    for name, terms in SHORT.items():
        label = label.when(q.isin(terms), name)
    starts = [q.startswith(g + end) for g in lx.GREETINGS for end in (" ", ",")]
    for s in starts:
        label = label.when(s, "salutation")
    return label.otherwise("")


def question_intent(text: Column) -> Column:
    low = F.lower(text)
    label = F.when(F.lit(False), "")
    for name, terms in lx.QUESTION_INTENTS.items():
        label = label.when(any_of(low, terms), name)
    return label.otherwise("general")


def routed(turns: DataFrame, text_col: str = "text", most: int = 1000) -> DataFrame:
    """Each turn with its route: length, injection, short intent, scope, then the intent of the question."""
    t, low = filled(text_col), F.lower(filled(text_col))
    short = short_intent(t)
    route = (
        F.when(F.trim(t) == "", "empty").when(F.length(t) > most, "too_long").when(any_of(low, lx.FORBIDDEN), "blocked")
        .when(short != "", short).when(~any_of(low, lx.DOMAIN), "out_of_scope").otherwise(question_intent(t))
    )
    answered_by = F.when(F.col("route").isin("empty", "too_long", "blocked", "out_of_scope"), "gate").when(F.col("route").isin(list(SHORT)), "small_talk").otherwise("retrieval")
    return turns.withColumn("route", route).withColumn("engine", answered_by)


def suggestions(route: Column, language: str = "fr") -> Column:
    """Three questions to go on with after an answer to this intent."""
    own = lx.SUGGESTIONS[language]
    listed = lambda k: F.array(*map(F.lit, own[k]))
    chosen = F.when(F.lit(False), listed(""))
    for name in own:
        chosen = chosen.when(route == name, listed(name)) if name else chosen
    return chosen.otherwise(listed(""))
