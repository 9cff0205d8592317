"""Records repaired from the facts of their scope."""

from ledgerlight.operators import facts as fa
from ledgerlight.operators import reports, rules
from ledgerlight.sources import sales as src


def test_repair(spark):
    facts = fa.facts(src.sales_fact(spark, "/root/testdata/sf0.001"))
    own = {r.scope: r.structure for r in rules.structured(facts).collect()}
    advice = ", ".join('{"action": "%s", "priority": "%s", "level": "%s"}' % (c, p, lv) for c, p, lv in zip("abcdefg", ("low", "HIGH", "medium", "high", "x", "", "low"), ("tactical", "OPERATIONAL", "strategic", "none", "", "tactical", "x")))
    rows = [
        ("all", 1, '{"recommendations": [%s]}' % advice),
        ("all", 2, "[1, 2]"),
        ("all", 3, '{"summary": "a {b} c", "nested": {"summary": 1}} tail } {'),
        ("all", 4, '{"summary": "only this"'),
        ("region:ASIA", 5, '{"top_products": ["x", "y", "z", "w"], "risks": ["r"], "opportunities": [], "key_segment": "\\u00e9"}'),
        ("nowhere", 6, '{"summary": "kept", "risks": ["r"], "recommendations": [{"action": "a"}]}'),
        (None, 7, None),
    ]
    got = {r.ord: r for r in reports.repaired_records(spark.createDataFrame(rows, "scope string, ord int, raw string"), facts, ["scope", "ord"]).collect()}
    assert len(got) == len(rows)
    assert [(x.action, x.priority, x.level) for x in got[1].recommendations] == [("b", "high", "operational"), ("d", "high", "tactical"), ("c", "medium", "strategic"), ("e", "medium", "tactical"), ("f", "medium", "tactical")]
    for k in (2, 3, 4):
        assert got[k].best_period == own["all"].best_period.label and got[k].risks == own["all"].risks and len(got[k].recommendations) == 2
    assert got[2].summary == own["all"].summary == got[4].summary
    assert got[5].top_products == ["x", "y", "z", "w"] and got[5].risks == ["r"] and got[5].opportunities == own["region:ASIA"].opportunities and got[5].key_segment == "é"
    assert got[6].summary == "kept" and got[6].best_period is None and [x.justification for x in got[6].recommendations] == [reports.UNJUSTIFIED]
    assert got[7].summary is None and got[7].recommendations == []
    assert reports.repaired_records(spark.createDataFrame([], "scope string, raw string"), facts).collect() == []
