"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from ledgerlight.llm import spelling


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts: dict[str, int], times: int = 5) -> dict:
    form, found = {}, {}
    for w in counts:
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x)) if others else None
        form[w] = best if best and counts[best] >= times * counts[w] else None
        found[w] = len(others)
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], found[w], counts[form[w]] if form[w] else None)
    return out


def counted(rows) -> dict[str, int]:
    total: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def as_dict(df) -> dict:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def vocabulary(rng: random.Random, n: int, letters: str) -> list[str]:
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(n)]
    out = set(stems)
    for w in stems:
        for _ in range(2):
            i, c = rng.randrange(len(w) + 1), rng.choice(letters)
            out |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]}
    return sorted(w for w in out if len(w) >= 6)


def test_bound_holds_for_every_edit():
    rng = random.Random(1)
    for letters in ("ab", "abcd", "aé"):
        words = vocabulary(rng, 60, letters)
        total = Counter(w[a : a + k] for w in words for k in range(3, 6) for a in range(len(w) - k + 1))
        grams = spelling.Grams({g: n for g, n in total.items() if n > 12})
        for w in words:
            own = grams.decompose(w)
            bound = grams.bound(w, own)
            for i in range(len(w) + 1):
                for other in {w[:i] + c + w[i + k :] for c in [*letters, "z", ""] for k in (0, 1)} - {w}:
                    shift = len(other) - len(w)
                    theirs = {(a, other[a:b]) for a, b in grams.decompose(other)}
                    kept = sum((a, w[a:b]) in theirs or (a + shift, w[a:b]) in theirs for a, b in own)
                    assert kept >= len(own) - bound, (w, other)


@pytest.mark.parametrize("letters, crowded", [("ab", 64), ("ab", 1), ("abcdé", 64), ("abcdé", 2)])
def test_pairs_against_brute_force(spark, letters, crowded):
    rng = random.Random(len(letters) + crowded)
    words = vocabulary(rng, 120, letters)
    # A crowd with a beginning, and one with an end, in common.
    words = sorted({*words, *("gemeinsam" + x + y for x in "pqrstu" for y in "pqrstuvw"), *(x + y + "gemeinsam" for x in "pqrstu" for y in "pqrs"), "aaaaaa", "aaaaaaa", "aaaaaaaa"})
    counts = {w: rng.choice([5, 6, 25, 30, 150, 800]) for w in words}
    table = spark.createDataFrame([*counts.items()], "word string, n long").repartition(4)
    assert as_dict(spelling.variant_forms(table, crowded=crowded)) == brute(counts)


def test_texts(spark):
    rng = random.Random(8)
    words = vocabulary(rng, 40, "abcdeÀé") + ["shorty", "kurz"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(["{}", "{}.", "{}1", "\n{}"]).format(rng.choice(words).title()) for _ in range(120))) for i in range(60)]
    rows += [(3, None), (4, ""), (5, "!" * 50), rows[1], rows[1], (70, "Wiederholung " * 300_000), (71, "x" * 100_000)]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    counts = counted(rows)
    assert len(counts) > 50
    assert as_dict(spelling.spelling_variants(docs)) == brute(counts)
    assert spelling.spelling_variants(docs.filter("doc_id < 0")).collect() == []
