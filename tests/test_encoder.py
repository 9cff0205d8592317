"""Encoders that fail, and stop words from a table."""

from ledgerlight.functions import text
from ledgerlight.operators import retrieval


def test_failing_batches_are_tried_text_by_text(spark):
    def brittle():
        def encode(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no vector for that")
            if any("short" in t for t in texts):
                return [[1.0]] * len(texts)
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    rows = [(i, "bad" if i == 40 else "short" if i == 70 else None if i == 3 else "x" * i, "kept") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, content string, more string").repartition(2)
    got = {r.id: r for r in retrieval.encoded(df, brittle, 2).collect()}
    assert len(got) == 100 and {i for i, r in got.items() if not r.encoded} == {40, 70}
    assert list(got[40].embedding) == [0.0, 0.0] and list(got[3].embedding) == [0.0, 1.0] and list(got[41].embedding) == [41.0, 1.0] and got[5].more == "kept"
    assert retrieval.encoded(df.filter("id < 0"), brittle, 2).collect() == []


def test_stop_words_from_a_table(spark):
    docs = spark.createDataFrame([(1, "en", "alpha alpha beta gamma"), (2, "en", "alpha delta"), (3, "de", "alpha alpha"), (4, "en", None)], "id int, lang string, text string")
    stop = text.frequent_words(docs, "id", share=0.5)
    assert sorted(map(tuple, stop.collect())) == [("de", "alpha"), ("en", "alpha")]
    assert sorted((r.id, r.word) for r in text.keywords(docs, "id", stop_words=stop).collect()) == [(1, "beta"), (1, "gamma"), (2, "delta")]
    assert [(r.word, r.n) for r in text.keywords(docs.filter("id = 1"), "id").orderBy("rank").collect()] == [("alpha", 2), ("beta", 1), ("gamma", 1)]


def test_many_paragraphs_are_packed_in_linear_time(spark):
    text_ = "\n\n".join(f"p{i} with some words in it" for i in range(100_000))
    rows = [(1, text_), (2, None), (3, " \n \n"), (4, "w " * 300 + "\nshort\n\nmore"), (5, "one")]
    got: dict = {}
    for r in retrieval.packed_paragraphs(spark.createDataFrame(rows, "id int, text string"), "id").collect():
        got.setdefault(r.id, {})[r.chunk] = (r.content, r.n_words)
    assert set(got) == {1, 4, 5} and got[5] == {0: ("one", 1)} and [n for _, n in got[4].values()] == [300, 2]
    assert len(got[1]) == 2440 and "\n\n".join(got[1][i][0] for i in range(2440)) == text_ and max(n for _, n in got[1].values()) <= 250
