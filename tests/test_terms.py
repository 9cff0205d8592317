"""Terms found by an automaton against counting term by term."""

import random

import pytest

from ledgerlight.functions import terms, text

LISTS = {"en": {"a": ["ab", "aba", "b"], "b": ["ab", "x y", "é"], "c": ["zzz"]}, "fr": {"a": ["bab"], "b": ["aa"], "c": ["ß"]}}


def test_counts(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["en", "fr", "de", None]), "".join(rng.choice("abAB xyéÉzß") for _ in range(rng.randrange(80)))) for i in range(300)]
    rows += [(900, "en", None), (901, "en", ""), (902, "en", "ab" * 200_000), rows[0]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, lang string, text string, a int")
    got = sorted((r.id, r.a, r.b, r.c) for r in terms.group_counts(df, "id", LISTS).collect())
    want = sorted((i, *(sum((t or "").lower().count(w) for w in LISTS.get(lang, LISTS["en"])[g]) for g in "abc")) for i, lang, t in rows)
    assert got == want
    assert terms.group_counts(df.filter("id < 0"), "id", LISTS).collect() == []


def test_first_group(spark):
    rows = [(1, "en", ["xx ab", "x y", "zzz aba", "none"]), (2, "fr", ["aa bab", "ß"]), (3, "xx", []), (4, "en", None)]
    df = spark.createDataFrame(rows, "id long, lang string, texts array<string>")
    got = {r.id: (r.c, r.a, r.b, r.rest) for r in terms.first_groups(df, "id", LISTS, ["c", "a", "b"]).collect()}
    assert got == {1: (1, 1, 1, 1), 2: (1, 1, 0, 0), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0)}


def test_lists_from_a_table(spark):
    table = spark.createDataFrame([("en", "growth", "more"), ("en", "growth", "more"), ("fr", "growth", "plus"), ("en", "loss", "less"), ("en", "loss", "")], "lang string, group string, term string")
    lists = terms.table_lists(table)
    assert lists == {"en": {"growth": ["more"], "loss": ["less"]}, "fr": {"growth": ["plus"]}}
    docs = spark.createDataFrame([(1, "en", "More and more, less"), (2, "fr", "plus")], "id long, lang string, text string")
    assert {r.id: (r.growth, r.loss) for r in text.theme_counts(docs, "id", themes=lists).collect()} == {1: (2, 1), 2: (1, 0)}
    with pytest.raises(ValueError):
        terms.table_lists(table, most=2)


def test_the_plan_has_one_map_and_no_copies(spark):
    df = spark.createDataFrame([(1, "en", "growth")], "id long, lang string, text string")
    plan = text.theme_counts(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "replace(" not in plan and "Exchange" not in plan
