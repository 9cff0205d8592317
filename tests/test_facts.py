"""Facts of all scopes against questions asked scope by scope, and on awkward rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import facts as fa
from ledgerlight.operators import rules
from ledgerlight.operators import scopes as q
from ledgerlight.sources import sales as src

SF = "/root/testdata/sf0.001"


def by_scope(df):
    return {r.scope: r for r in df.collect()}


def test_year_scopes_answer_like_scoped_questions(spark):
    s = src.sales_fact(spark, SF).cache()
    found = by_scope(fa.facts(s, "full"))
    for scope, kept in (
        ("year:1998", {"year": 1998}),
        ("year:1995", {"year": 1995}),
        ("year:2000|region:ASIA", {"year": 2000, "region": "ASIA"}),
        ("region:EUROPE|category:PROMO", {"region": "EUROPE", "category": "PROMO"}),
        ("year:1997|region:AFRICA|category:ECONOMY", {"year": 1997, "region": "AFRICA", "category": "ECONOMY"}),
    ):
        one, row = q.summary(s, **kept).first(), found[scope]
        assert row.total == pytest.approx(one.sales) and row.growth_pct == one.growth_pct and row.top_region == one.best_region
        annual = q.annual_series(s, **kept).orderBy("year").collect()
        assert [(y.year, y.sales, y.orders) for y in row.annual] == [(y.year, y.sales, y.orders) for y in annual]
    assert found["year:1995"].growth_pct is None and found["year:1998"].period == "1998" and found["all"].period == "1995-2001"


def test_lattices_agree_and_are_named(spark):
    s = src.sales_fact(spark, SF)
    basic, full = by_scope(fa.facts(s)), by_scope(fa.facts(s, "full"))
    assert all(full[k] == r for k, r in basic.items())
    assert {k for k in by_scope(fa.facts(s, "standard")) if k not in basic} == {f"year:{y}" for y in range(1995, 2002)}
    with pytest.raises(ValueError):
        fa.facts(s, "years")


def test_orders_count_once_in_every_scope(spark):
    day = datetime.date
    rows = [
        # One order in two months, two categories and two regions; an order without id; a row without category.
        ("a", 1, day(2020, 1, 5), "N", "X", "s1", "p", 10), ("a", 1, day(2020, 1, 5), "N", "X", "s1", "p", 10), ("a", 1, day(2020, 2, 5), "S", "Y", "s1", "q", 5),
        (None, 2, day(2020, 3, 1), "N", "X", "s2", "p", 7), ("b", 2, day(2021, 3, 1), "N", None, "s2", "p", 9),
    ]
    raw = spark.createDataFrame(rows, "order_id string, customer_id int, order_date date, region string, category string, segment string, sub_category string, sales int")
    s = src.calendar(raw.withColumns({"ship_date": F.col("order_date"), "sales": F.col("sales").cast("decimal(12,2)")}))
    found = by_scope(fa.facts(s, "full"))
    orders = lambda scope: {y.year: y.orders for y in found[scope].annual}
    assert orders("all") == {2020: 1, 2021: 1} and orders("region:N") == {2020: 1, 2021: 1} and orders("region:S") == {2020: 1}
    assert orders("category:X") == {2020: 1} and orders("category:Y") == {2020: 1} and orders("year:2020|region:N|category:X") == {2020: 1}
    assert found["all"].total == 41 and "category:None" not in found and found["year:2021"].growth_pct == -71.9
    assert [m.orders for m in found["all"].months] == [1, 1, 0, 1]
    empty = fa.facts(s.filter("year = 1900"), "full")
    assert empty.collect() == []


def test_printed_numbers_round_as_printf_does(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -2.5, 51887928266.5, 48514860580.5, 0.35, 0.05, 0.15, 0.25, 20.25, 20.35, 0.95, 0.96, 9.95, 9.96, 999.5, 1000.5, -0.04, -0.4, 1e-300, 4503599627370497.5, 9007199254740993.0, 1e18, 0.49999999999999994, 0.04999999999999999]
    values += [rng.randrange(-(10**k), 10**k) / 100 for k in range(2, 14) for _ in range(200)] + [rng.uniform(-1, 1) * 10**k for k in range(-3, 12) for _ in range(50)]
    c = F.col("x")
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*values, None])], "i long, x double")
    got = [tuple(r)[1:] for r in df.select("i", rules.number(c, 0), rules.number(c), rules.signed(c, 0), rules.signed(c)).orderBy("i").collect()]
    assert got[-1] == (None, None, None, None)
    for x, texts in zip(values, got):
        assert texts == tuple(f % x for f in ("%.0f", "%.1f", "%+.0f", "%+.1f")), x


def test_reports_print_halves_as_their_sql(spark):
    totals = spark.createDataFrame([("category:STANDARD", 51887928266.5, "1995-2001"), ("region:ASIA", 31282277663.5, "1995-2001")], "scope string, total double, period string")
    assert {r.scope: r.answer for r in rules.answer(totals).collect()} == {
        "category:STANDARD": "For category:STANDARD, sales total 51887928266 over 1995-2001.",
        "region:ASIA": "For region:ASIA, sales total 31282277664 over 1995-2001.",
    }
