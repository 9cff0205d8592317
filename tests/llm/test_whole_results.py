"""Whole results against independent brute force: SimHash classes and node arrays."""

import random
import re

import numpy as np
import pytest
import xxhash

from ledgerlight.llm import quality, simhash


def fingerprint(text: str) -> int:
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_classes(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 3, 9, 400, 900]))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(4):  # near copies of long texts, other texts of short ones
            c = list(b)
            c[rng.randrange(len(c))] = rng.choice(["Neu", "É", "W1"])
            texts.append(rng.choice([" ", "\t", "\n "]).join(c))
    texts += [None, "", " \x0b", "A B c", "a b C", "One", "one", "x " * 3000]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(3000, texts[3]), (7, texts[1]), (None, texts[4])]
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                links += prints[i] != prints[j]
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc)
    want = sorted((str(doc), f"{prints[i]:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i, (doc, _) in enumerate(rows))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(4)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicate_classes(df).collect())
    assert got == want and links > 10


@pytest.mark.parametrize("depth", [1, 4])
def test_node_arrays_against_a_walk(depth):
    rng = np.random.default_rng(depth)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = (x[:, 0] - x[:, 2] + rng.normal(size=600) > 0).astype(float)
    trees = quality.fit_trees(x, y, list(quality.FEATURES.values()), rounds=15, depth=depth)
    asked = np.r_[x[:100], rng.normal(size=(50, x.shape[1])) * 3, x[:1] * 0]

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total

    assert np.allclose(trees.margin(asked), [walk(r) for r in asked])
    for k, direction in enumerate(quality.FEATURES.values()):  # held to the stated directions
        if direction:
            grid = np.repeat(asked[:20], 30, 0)
            grid[:, k] = np.tile(np.linspace(-4, 4, 30), 20)
            steps = np.diff(trees.margin(grid).reshape(20, 30), axis=1) * direction
            assert (steps >= -1e-9).all()


def test_scratch_tables_go(spark):
    import os

    from ledgerlight.llm import common

    df = spark.range(5)
    with common.scratch() as made:
        kept, gone = common.written(df, "scratch-kept"), common.written(df, "scratch-gone")
        with common.scratch():
            inner = common.written(gone, "scratch-inner")
        made.remove(kept)
        assert gone.count() == 5
    assert kept.count() == 5 and [os.path.exists(t.written_to) for t in (kept, gone, inner)] == [True, False, False]
    common.discard(kept)
