"""Corpus operators against libraries, brute force and awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import common, components, lines, neighbours, packing, pii, piece_codec, quality, simhash, substring, token_count, toxicity

LONG = " ".join(f"w{i % 997}x" for i in range(30_000))
TEXTS = [None, "", " ", "  a  b ", "x\n\ny", "Hello, world! don't <|endoftext|> stop", "Ünïcode 日本語 🙂 ▁ text", "a b c " * 40, "a b c " * 40, LONG, LONG + " end", "\x1c odd\tblank\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n_tokens", "kept_text") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], None, None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, spans string").repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, got = Tokenizer.from_file(path), token_count.count_tokens(docs, path)
    assert got.count() == docs.count()
    for i, r in by_id(got).items():
        text = ("no id" if i is None else TEXTS[i]) or ""
        assert r.n_tokens == len(t.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 1024)


def test_piece_codec(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, got = sentencepiece.SentencePieceProcessor(model_file=path), by_id(piece_codec.encode_decode(docs, path))
    digests = by_id(piece_codec.encode_digest(docs, path))
    for i, r in got.items():
        text = ("no id" if i is None else TEXTS[i]) or ""
        ids = m.encode(text)
        assert r.ids == ids and r.decoded == m.decode(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and digests[i].n_tokens == len(ids)


def test_piece_codec_on_long_runs():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m, codec, rng = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path), np.random.default_rng(9)
    drawn = lambda letters, n: "".join(rng.choice(list(letters), n))
    runs = [drawn("0123456789", 100_000), drawn("日本語中文字的是在有", 100_000), drawn("🙂🚀🎉", 30_000), "ab9_" * 20_000, drawn("abcdefgh", 60_000), " " * 5_000, " " * 777 + "x", "a" + " " * 33 + "b" + " " * 1_001]
    runs += [" ".join(" " * int(rng.integers(0, 40)) + drawn("xthe0é", int(rng.integers(0, 5))) for _ in range(50)) for _ in range(40)]
    for text in runs:
        ids = m.encode(text)
        assert codec.round_trip(text) == (",".join(map(str, ids)), m.decode(ids))
    assert max(map(len, codec.words)) <= piece_codec.LONG


def test_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, rows = Tokenizer.from_file(path), packing.pack_documents(docs, path).collect()
    at, windows = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) > 0
        at.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for (i, total), pieces in at.items():
        want = t.encode(("no id" if i is None else TEXTS[i]) or "", add_special_tokens=False).ids + [2]
        ids = [x for p in sorted(pieces, key=lambda p: p.start) for x in p.ids]
        assert len(want) == total and ids == (want if i != 7 else ids) and len(ids) == total * (2 if i == 7 else 1)
    used = padded = 0
    for w in windows.values():
        w.sort(key=lambda p: p.offset)
        assert [p.offset for p in w] == np.cumsum([0, *(p.length for p in w[:-1])]).tolist()
        n = sum(p.length for p in w)
        used, padded = used + n, padded + (0 if n & (n - 1) == 0 else 4096 - n)
        assert n <= 4096
    assert padded <= 0.02 * used


def test_stages_hand_texts_to_python_in_small_batches(spark):
    import corpus_pipeline

    texts = spark.createDataFrame([(i, "abcdefghi " * 10_000, "en", "web", 100_000) for i in range(150)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    before = spark.conf.get(common.BATCH, None)
    try:
        spark.conf.unset(common.BATCH)
        packed = corpus_pipeline.pack(spark, texts, "")
        assert max(r.n for r in texts.mapInArrow(sizes, "n long").collect()) < 6 << 20
        assert {(r.doc_id, r.doc_tokens) for r in packed.select("doc_id", "doc_tokens").collect()} == {(i, n) for n in {packed.first().doc_tokens} for i in range(150)}
        spark.conf.set(common.BATCH, "64m")  # the user's own setting stays
        corpus_pipeline.pack(spark, texts, "")
        assert spark.conf.get(common.BATCH) == "64m"
    finally:
        spark.conf.unset(common.BATCH) if before is None else spark.conf.set(common.BATCH, before)


def test_packing_holds_a_bounded_number_of_tokens():
    packer, rng, full, most = packing.SumOfSquares(4096, 8, 40_000), np.random.default_rng(6), [], 0
    sizes = [2_100] * 300 + rng.integers(1, 4096, 300).tolist() + [1] * 300
    for i, n in enumerate(sizes):
        got = packer.place((i, 0, n, np.full(n, i, "<u4").tobytes()))
        full += [got] if got else []
        full += list(packer.relieved()) if packer.held > packer.most_held else []
        most = max(most, packer.held)
        assert packer.held == sum(p[2] for level in packer.open for w in level for p in w)
    full += list(packer.pour())
    seen = Counter()
    for w in full:
        assert sum(p[2] for p in w) <= 4096
        for i, start, n, ids in w:
            assert ids == np.full(n, i, "<u4").tobytes()
            seen.update((i, start + k) for k in range(n))
    assert most <= 40_000 + 4_096 and len(seen) == sum(sizes) == seen.total()


def test_substring(docs, spark):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(1, "a b " + shared + " c"), (2, shared + " d e"), (3, "x " * 80), (4, "only once here"), (5, None), (6, ""), (7, shared), (7, shared)]
    rows += [(10 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in words for k in range(len(w) - 34))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeated(df).collect())
    want = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    assert got == sorted(want)
    assert substring.remove_repeated(docs.filter("doc_id = -1")).count() == 0


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of ``n`` letters on which sums of powers of any base agree modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_long_words_do_not_collide(spark):
    x, y = thue_morse(1024)
    same = " ".join(f"w{i}" for i in range(34))
    df = spark.createDataFrame([(1, f"{x} {same}"), (2, f"{y} {same}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeated(df).collect()] == [0, 0]
    assert quality.statistics(f"a {x} z b {y} z")[0][4] == 0
    for n in (1, 8, 31, 32, 33, 64, 2048):
        x, y = thue_morse(n)
        a, b = substring.word_hashes(f"{x} {y} {x}".encode()).T[:2]
        assert a[0] != b[0] and a[1] != b[1] and a[0] != a[1]


def test_texts_beyond_a_segment(spark):
    words = [f"t{i * i % 9973}" for i in range(120_000)]
    text = " ".join(words)
    assert len(text) > 2 * substring.SEGMENT
    hashes = substring.word_hashes(text.encode())
    assert hashes.shape == (2, len(words))
    for i in (0, 1, 40_000, 80_001, 119_999):
        assert (hashes[:, i] == substring.word_hashes(words[i].encode())[:, 0]).all()
    own = " ".join(f"q{i}" for i in range(120_000))
    df = spark.createDataFrame([(1, own + " " + " ".join(words[:50])), (2, own[::-1] + " x " + " ".join(words[:50]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeated(df).collect()} == {1: 50, 2: 50}
    counts = quality.statistics(own + "\n" + own[: own.index(" q60000")])[0]
    assert counts[0] == 180_000 and counts[4] == 120_000


def test_substring_index_of_earlier_loads(spark):
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 5_000, n))
    shared = [text(60) for _ in range(6)]
    loads = [[(10 * n + i, f"{text(30)} {shared[(i + n) % 6]} {text(5)} {shared[i][: 250]}") for i in range(4)] + [(10 * n + 8, None), (10 * n + 9, text(50))] for n in range(3)]
    index = substring.FingerprintIndex(spark, most_runs=2)
    frames = [spark.createDataFrame(rows, "doc_id long, text string") for rows in loads]
    for n, df in enumerate(frames):
        got = substring.remove_repeated(df, batches=1, index=index, history=frames[0] if n == 1 else frames[0].unionByName(frames[1]) if n else None)
        every = [(i, (t or "").encode().split()) for rows in loads[: n + 1] for i, t in rows]
        seen = Counter(tuple(w[k : k + 35]) for _, w in every for k in range(len(w) - 34))
        gone = {i: len({k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}) for i, w in every}
        assert {r.doc_id: r.n_removed for r in got.collect()} == {i: gone[i] for i, _ in loads[n]}
        assert len(index.runs) == (n + 1 if n < 2 else 1)
    assert index.run(index.runs[0]).groupBy("fp").count().filter("count > 1").count() == 0
    index.drop()
    assert not index.runs


def test_simhash(docs, spark):
    fps = by_id(simhash.fingerprints(docs))
    assert fps[0].fp == fps[1].fp == fps[2].fp == 0
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, 2, replace=False))) for b in base for _ in range(4)]
    values = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    assert {tuple(r) for r in simhash.close_pairs(df).collect()} == want == {tuple(r) for r in simhash.close_pairs(df, crowd=1).collect()}
    classes = by_id(simhash.near_duplicate_classes(docs))
    assert classes[8].component_id == 7 and classes[1].component_id == 0 and classes[None].doc_id is None
    assert simhash.one_per_class(docs).filter("doc_id in (7, 8)").count() == 1


def test_one_per_class_keeps_rows_of_null_and_repeated_ids(spark):
    rng = np.random.default_rng(11)
    a, b, c, d, e = (" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (2, d), (7, e), (7, e), (None, e)]
    kept = simhash.one_per_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, a), (None, b), (5, c), (2, d), (7, e)])


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_need_no_round(spark):
    rng = np.random.default_rng(8)
    stars = [(i, 1000 * (i % 7)) for i in range(1, 400) if i % 7 and i < 1000 * (i % 7)]
    with common.scratch() as made:
        got = {r.node: r.label for r in components.connected_components(spark.createDataFrame([(i + 10_000, i % 5) for i in range(400)], "a long, b long")).collect()}
        assert len(made) == 1 and got == {i + 10_000: i % 5 for i in range(400)}
    loose = [tuple(map(int, rng.integers(0, 500, 2))) for _ in range(330)] + stars
    least = list(range(6001))
    for _ in range(500):
        for a, b in loose:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.label for r in components.connected_components(spark.createDataFrame(loose, "a long, b long")).collect()}
    assert got == {x: least[x] for e in loose for x in e if least[x] != x}


def test_lines(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    texts, originals = [], [[word() for _ in range(40)] for _ in range(20)]
    for o in originals:
        changed = list(o)
        changed[3] = "changed"
        texts += [" ".join(o), " ".join(changed) + "\n" + " ".join(o[:20])]
    texts += [None, "", "\n\n", "same\nsame\nother", "same", LONG, LONG + " end"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lid string")
    got = by_id(lines.dedup_lines(df))
    every = [(i, p, x) for i, t in enumerate(texts) for p, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = [{x[m : m + 8] for m in range(len(x)) if x[m] != " " and (m == 0 or x[m - 1] == " ")} for _, _, x in every]
    kept, classes = [], list(range(len(every)))
    for a in range(len(every)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                classes = [classes[b] if c == classes[a] else c for c in classes]
    for i, t in enumerate(texts):
        mine = [k for k, (d, _, _) in enumerate(every) if d == i]
        stay = [k for k in mine if not any(classes[k] == classes[j] for j in range(k))]
        assert got[i].n_lines == len(mine) and got[i].n_removed == len(mine) - len(stay), i
        kept.append([every[k][2] for k in stay])
        assert t is None and got[i].kept_text is None or [x for x in got[i].kept_text.split("\n") if x.strip()] == kept[-1]


def all_shingles(x):
    return {x[m : m + 8] for m in range(max(len(x) - 7, 1))}


def linked(lines_):
    """The least index of each line's component, by all pairs."""
    sets, root = [all_shingles(x) for x in lines_], list(range(len(lines_)))
    for a in range(len(sets)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


def kept_lines(spark, lines_):
    df = spark.createDataFrame(list(enumerate(lines_)), "doc_id long, text string")
    return {r.doc_id for r in lines.dedup_lines(df).collect() if not r.n_removed}


def test_lines_have_shingles_at_every_position(spark):
    texts = ["2024-01-15T10:22:41", "2024-01-20T11:47:03", "https://example.org/a/b", "https://other.example/c", "a\tfirst\trow", "a\tfirst\tother row", "\U0001f642 smile", "\U0001f642\U0001f642 smile", "international", "internationalisation"]
    assert kept_lines(spark, texts) == {i for i, r in enumerate(linked(texts)) if i == r}
    for x in ("", "ab", "exactly8"):
        assert [len(h) for h in lines.shingle_hashes(pa.array([x]), 8)] == [1, 1]
    for k in (1, 2, 5, 8, 11):
        hashes, count = lines.shingle_hashes(pa.array([*texts, "", "x" * 40]), k)
        own = [{x[m : m + k] for m in range(max(len(x) - k + 1, 1))} for x in [*texts, "", "x" * 40]]
        assert [len(set(h.tolist())) for h in np.split(hashes, np.cumsum(count)[:-1])] == [len(s) for s in own] and len(set(hashes.tolist())) == len(set().union(*own))


def test_lines_in_crowded_buckets_are_all_compared(spark):
    rng = np.random.default_rng(21)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    base = text(400)
    # Variants of one line, like it but not like each other, among lines that share only a long beginning.
    edited = [base[:at] + text(30) + base[at + 30 :] for at in range(2, 350, 5)]
    start = text(60)
    shared = [start + text(70) for _ in range(40)] + [start * 2 + text(9) for _ in range(5)]
    shared += [x[:-3] + "xyz" for x in shared[:20]]
    texts = [edited[0], *edited[1:35], base, *edited[35:], *shared]
    want = {i for i, r in enumerate(linked(texts)) if i == r}
    assert len(want) < len(texts) - 60 and kept_lines(spark, texts) == want


def test_what_is_apart_in_a_crowd_is_compared_exactly_in_slices(spark):
    rng = np.random.default_rng(23)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    base = text(300)
    texts = ["".join(text(1) if rng.random() < p else c for c in base) for p in (0.005, 0.01, 0.02) for _ in range(30)] + [text(9), "", "short"]
    sets = [all_shingles(x) for x in texts]
    alike = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    own = pa.array(texts)
    for columns in (50, 4096):
        found = lines.alike_between(own, own, 8, 0.8, columns)
        assert found.diagonal().all() and (found == found.T).all() and {(a, b) for a, b in zip(*map(list, np.nonzero(found))) if a < b} == alike
    label = [0 if i % 3 else i for i in range(len(texts))]  # two thirds hang together already
    crowd = spark.createDataFrame([(band, i, label[i]) for band in (1, 2) for i in range(len(texts))], "band long, node long, label long")
    want = {(a, b) for a, b in alike if label[a] != label[b]}
    for most in (7, 256):
        got = lines._strays(crowd, spark.createDataFrame(list(enumerate(texts)), "node long, line string"), 8, 0.8, most, 4000)
        assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(want)


def test_lines_of_a_crowd_meet_several_leaders_at_once(spark):
    rows = spark.createDataFrame([(band, i, 0 if i < 3 else i, True, 0, 0) for band in (1, 2) for i in range(40)], "band long, node long, label long, whole boolean, odd0 long, odd1 long")
    got = {(r.a, r.b) for r in lines._led(rows, 3, 20).collect()}
    met = Counter(x for e in got for x in e)
    leaders = {x for x, n in met.items() if n > 3}
    assert len(leaders) == 3 and all(a < b and not (b < 3) for a, b in got)
    assert all((min(i, j), max(i, j)) in got for i in range(40) for j in leaders if i != j and not (i < 3 and j < 3))


def test_known_texts_serve_verification(spark):
    texts = ["a line that is long enough", "a line that is long enough.", "nothing like the others"]
    known, pairs = (spark.createDataFrame(x, c) for x, c in ((list(enumerate(texts)), "node long, line string"), ([(0, 1), (0, 2)], "a long, b long")))
    reader = object.__new__(lines._Texts)  # has no corpus to read
    assert [tuple(r) for r in reader.verified(pairs, 8, 0.8, known).collect()] == [(0, 1)]


def test_line_labels_after_more_links(spark):
    links = lambda *rows: common.written(spark.createDataFrame(rows, "a long, b long"), "links")
    labels = components.connected_components(links((1, 2), (2, 3), (5, 6), (8, 9)))
    first = lines._relabelled(labels, links((3, 6), (6, 7), (10, 11), (0, 9), (2, 1)))
    assert {r.node: r.label for r in first.collect()} == {2: 1, 3: 1, 5: 1, 6: 1, 7: 1, 8: 0, 9: 0, 11: 10}
    assert lines._relabelled(first, common.written(first.limit(0).toDF("a", "b"), "links")) is first


def test_line_recall(spark):
    rng = np.random.default_rng(22)
    text = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    texts = []
    for n in [*range(12, 60), *range(60, 300, 8)]:
        for _ in range(4):
            x = text(n)
            cut = (n - 7) // 5
            texts += [x, x[: n - cut]]  # Jaccard 0.8 or little more
    word = text(12)
    texts += [word * 17, word * 18, "| --- " * 17 + "|", "| --- " * 18 + "|"]
    root = linked(texts)
    want = {i for i, r in enumerate(root) if i == r}
    got = kept_lines(spark, texts)
    short = {i for i, x in enumerate(texts) if len(x) < 43}
    assert got >= want and got & short == want & short and len(got - want) <= 0.02 * (len(texts) - len(want))
    assert {len(texts) - 1, len(texts) - 3}.isdisjoint(got)


def test_lines_run_no_python_on_executors(spark):
    rng = np.random.default_rng(31)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(3, 9, 400)]
    texts = [" ".join(rng.choice(vocabulary, 30)) for _ in range(12)]
    texts += [x[:-4] + "else" for x in texts[:6]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").filter("doc_id >= 0")
    plans, plain = [], lines.written
    lines.written = components.written = lambda t, name: plans.append(t._jdf.queryExecution().toString()) or plain(t, name)
    try:
        kept = lines.dedup_lines(df)
        assert {r.doc_id for r in kept.collect() if not r.n_removed} == {i for i, r in enumerate(linked(texts)) if i == r}
    finally:
        lines.written = components.written = plain
    plans.append(kept._jdf.queryExecution().toString())
    assert len(plans) > 5 and not any(x in p for p in plans for x in ("MapInArrow", "FlatMapGroups", "PythonUDF", "MapInPandas"))


def test_native_shingles_and_marks(spark):
    texts = ["", "ab", "exactly8", "2024-01-15T10:22:41", "\U0001f642\U0001f642 smile \U0001f642 again", "na\u00efve caf\u00e9 cr\u00e8me", "\u4f60" * 20, "x" * 40, "a\tb c\r d" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "node long, line string")
    want = spark.createDataFrame([(i, s) for i, x in enumerate(texts) for s in all_shingles(x)], "node long, s string").groupBy("node").agg(F.sort_array(F.collect_list(F.xxhash64("s"))).alias("h"))
    got = {r.node: r.h for r in df.select("node", F.sort_array(lines.shingles(F.col("line"), 8)).alias("h")).collect()}
    assert got == {r.node: r.h for r in want.collect()}
    for r in lines._marks(df, 8, 4).collect():
        bits = [0] * 4
        for h in got[r.node]:
            bits[(h >> 6) & 3] |= 1 << (h & 63)
        assert r.n >= len(got[r.node]) and [x & (2**64 - 1) for x in (r.bits0, r.bits1, r.bits2, r.bits3)] == bits


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 16)).astype("f4")
    v[50:110] = v[50]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [None] * 16), (None, v[0].tolist()), (20, v[20].tolist())]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, least_block=64).collect()
    x = v.astype(float)
    hit = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        hit += len({r.vec_id for r in mine} & set(want.tolist()))
    assert hit >= 0.9 * 75 and {r.query_id for r in got} == set(range(0, 300, 20))
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in neighbours.nearest(few).collect()] == [(0, 1, 4.0)]
    assert neighbours.nearest(few.filter("vec_id > 5")).count() == 0


def test_pii(spark):
    texts = ["mail a.b@x.org, again a.b@x.org", "ip 1.2.3.4 and 300.1.1.1", "card 4111 1111 1111 1111 or 4111111111111112", "call +1 (605) 555-9305 or +12", None, "", "@", "a@b a@b.c.", "4111111111111111 x +1 605 555 9305 4111111111111111"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    model = pii.fit_skip_chain(df)
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def fine(k, m):
        d = re.sub("[^0-9]", "", m)
        return [True, all(int(p) <= 255 for p in m.split(".")) if k == 1 else True, 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15][k]

    for i, r in by_id(pii.find_pii(df, model)).items():
        want = [(pii.KINDS[k], m.start(), m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, texts[i] or "") if fine(k, m[0])]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == want
        assert all(0 <= s.start < s.end <= len(texts[i]) for s in r.spans)
    masked = by_id(pii.masked(df, model))
    assert masked[0].text == "mail [EMAIL], again [EMAIL]" and masked[4].text is None and masked[5].text == ""
    assert pii.find_pii(df.filter("doc_id < 0"), model).count() == 0


def test_field_runs_without_base_matches(spark):
    shape = pii.nodes_of("300.1.1.1", []).shape[0]
    model = pii.SkipChain({shape: np.log([0.02, 0.01, 0.95, 0.01, 0.01]).tolist()}, np.log([0.96, *[0.01] * 4]).tolist(), np.zeros((5, 5)), np.zeros((5, 5)))
    texts = ["host 300.1.1.1 down", "host 300.1.1.1 down, mail a@b.org", "no number"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(pii.find_pii(df, model))
    added = [[(s.kind, s.start, s.end) for s in found[i].spans if not s.base] for i in range(3)]
    assert added == [[("ip", 5, 14)], [("ip", 5, 14)], []]
    assert by_id(pii.masked(df, model))[0].text == "host [IP] down"


def test_skip_edges_spread_labels():
    text = "4111111111111111 x 4111111111111111"
    nodes = pii.nodes_of(text, [(2, 0, 16)])
    model = pii.SkipChain({}, np.log([0.8, 0.05, 0.05, 0.05, 0.05]).tolist(), np.zeros((5, 5)), np.eye(5) * 6)
    assert nodes.skip == [(0, 1)] and model.marginals(nodes)[1].argmax() == 3


def test_fitted_skip_table_decides(spark):
    rng = np.random.default_rng(8)
    number = lambda: "4" + "".join(map(str, rng.integers(0, 10, 14)))
    card = lambda: next(x for n in [number()] for d in range(10) if pii.luhn(x := n + str(d)))
    loose = lambda c: f"{c[:8]}.{c[8:]}"  # noqa: E731, the same digits, but no card by its pattern
    rows = []
    for i in range(300):
        c = card()
        rows.append(f"paid {c} and again {c} on day {i}" if i % 30 else f"order {number()[:8]} sent, see {number()[:8]} of {i}")
    c = card()
    probe = f"paid {c} then words come between and later {loose(c)} was named"
    df = spark.createDataFrame([*enumerate(rows), (1_000, probe), (1_001, f"only {loose(card())} here"), (1_002, None)], "doc_id long, text string")
    model = pii.fit_skip_chain(df.filter("doc_id < 1000"))
    assert (np.diag(model.skip)[[0, 3]] > model.skip[[0, 3], [3, 0]] + 1).all()
    found, at = by_id(pii.find_pii(df, model)), probe.index(loose(c))
    added = [(s.kind, s.start, s.end) for s in found[1_000].spans if not s.base]
    assert added == [("card", at, at + 17)] and not found[1_001].spans
    none = pii.SkipChain(model.unary, model.unseen, model.chain, np.zeros_like(model.skip))
    assert not [s for s in by_id(pii.find_pii(df, none))[1_000].spans if not s.base]
    assert pii.fit_skip_chain(df.filter("doc_id < 0")).unary == {}


def test_adjacent_added_tokens_are_one_span():
    text = "call 605 555 9305 now"
    n = pii.nodes_of(text, [])
    model = pii.SkipChain({s: np.log([0.01, 0.01, 0.01, 0.01, 0.96]).tolist() for s in n.shape}, np.log([0.96, *[0.01] * 4]).tolist(), np.zeros((5, 5)), np.zeros((5, 5)))
    assert model.added_spans(text, []) == [(3, 5, 17)]


def test_quality(docs, spark):
    rng = np.random.default_rng(2)
    x = rng.random((2000, 12))
    y = (x[:, 2] + 0.1 * rng.random(2000) < 0.5).astype(float)
    trees = quality.fit_trees(x, y, list(quality.FEATURES.values()), rounds=20)
    assert ((trees.margin(x) > 0) == y).mean() > 0.95
    line = np.repeat(x[:1], 50, 0)
    line[:, 2] = np.linspace(0, 1, 50)
    assert (np.diff(trees.margin(line)) <= 1e-12).all()  # symbols may only lower the verdict
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None), (99, 1)], "doc_id long, quality int")
    fitted = quality.fit_quality(docs, labels)
    for i, r in by_id(quality.score_quality(docs, fitted)).items():
        t = ("no id" if i is None else TEXTS[i]) or ""
        w = t.encode().split()
        twice = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if twice[tuple(w[k : k + 3])] > 1 for j in range(3)}
        full = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    assert not quality.fit_quality(docs, labels.filter("doc_id < 0")).roots.size


def test_toxicity(docs, spark):
    rng = np.random.default_rng(4)
    calm = lambda: " ".join(rng.choice(["tree", "house", "river", "cloud", "stone", "road"], 12))
    # Toxic texts often name one group; a model without the penalty would hold that against it.
    rows = [(i, (f"{calm()} the muslims are idiotic {calm()}." if i % 3 == 0 else f"{calm()} idiotic {calm()}." if i % 3 == 1 else f"{calm()}."), int(i % 3 < 2)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model, plain = toxicity.fit_toxicity(df, labels), toxicity.fit_toxicity(df, labels, even=0.0)
    gap = lambda m: m.score("the muslims are here") - m.score("the people are here")
    assert abs(gap(model)) < abs(gap(plain)) and model.score("an idiotic road") > 0.5 > model.score("the muslims built a house")
    got = toxicity.score_toxicity(docs, model)
    assert got.count() == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.collect())
    assert toxicity.fit_toxicity(df.filter("doc_id < 0"), labels).score("anything") < 0.5
    out = {r.i: r.h for r in spark.createDataFrame([(7,), (None,)], "i long").select("i", toxicity.held_out("i").alias("h")).collect()}
    assert out == {7: zlib.crc32(b"7") % 5 == 0, None: True}


def test_scores_follow_from_weights_and_neutral_mentions_are_left_alone(spark):
    rng = np.random.default_rng(14)
    calm = lambda n: " ".join(rng.choice(["tree", "house", "river", "cloud", "stone", "road"], n))
    groups = ["muslims", "women", "jews"]
    rows = [(i, f"{calm(6)} the {groups[i % 3]} {calm(2)} trash {calm(6)}." if i % 2 else f"{calm(14)}.") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model, plain = toxicity.fit_toxicity(df, labels), toxicity.fit_toxicity(df, labels, even=0.0)
    assert model.pairs > 300 and model.weights != plain.weights
    neutral = spark.createDataFrame([(i, f"the {g} {calm(3)} built a {calm(1)}") for i, g in enumerate(groups * 5)] + [(99, None)], "doc_id long, text string")
    false = lambda m: toxicity.score_toxicity(neutral, m).filter("predicted = 1").count()
    assert false(plain) > 10 and false(model) == 0
    texts = {**dict(rows), **{r.doc_id + 10_000: r.text for r in neutral.collect()}}
    got = toxicity.score_toxicity(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model)
    for r in got.collect():
        words = set(re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()))
        parts = {w for w in words} | {w[:k] + "~" for w in words for k in (4, 5, 6) if len(w) > k}
        assert abs(r.score - 1 / (1 + np.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in parts))))) < 1e-9
    assert "trash" in model.weights and toxicity.swaps("", toxicity.IDENTITY_TERMS) == [] and len(toxicity.swaps("women " * 3 + "jews. men", toxicity.IDENTITY_TERMS)) <= 40


def test_empty_tables_and_clashing_names(spark, docs):
    word, piece, packed = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
    none = docs.filter("doc_id = -1")
    model, trees = toxicity.ToxicityModel({}, -1.0), quality.fit_quality(none, spark.createDataFrame([], "doc_id long, quality int"))
    for df in (token_count.count_tokens(none, word), piece_codec.encode_digest(none, piece), packing.pack_documents(none, packed), quality.score_quality(none, trees), lines.dedup_lines(none), simhash.near_duplicate_classes(none), simhash.one_per_class(none), toxicity.score_toxicity(none, model), pii.masked(none, pii.fit_skip_chain(none))):
        assert df.count() == 0
    names = ["y", "row", "key", "text_", "id_", "score", "predicted", "n_lines", "n_removed", "kept_text", "gone", "spans", "lid", "node", "doc", "fp", "component_id", "row_", "f", "old"]
    odd = docs.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, toxic int, quality int")
    n = docs.count()
    fitted = toxicity.fit_toxicity(odd, labels)
    assert toxicity.score_toxicity(odd, fitted, whole=True).select("row.*", "predicted").columns == [*odd.columns, "predicted"]
    assert quality.score_quality(odd, quality.fit_quality(odd, labels)).count() == n
    whole = lines.dedup_lines(odd, whole=True)
    assert whole.select("row.*").columns == odd.columns and whole.count() == n
    assert simhash.one_per_class(odd).columns == odd.columns and pii.masked(odd, pii.fit_skip_chain(odd)).columns == odd.columns
    assert substring.remove_repeated(odd).count() == n and simhash.near_duplicate_classes(odd).count() == n
    assert token_count.count_tokens(odd, word).count() == n and packing.pack_documents(odd, packed).select("doc_id").distinct().count() == len(TEXTS) + 1


def test_nearest_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0, float(i % 2)]) for i in range(41)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4).collect()
    want = {q: sorted((i for i in range(41) if i != q), key=lambda i: (-(1.0 + (q % 2) * (i % 2)), i))[:4] for q in (0, 20, 40)}
    assert {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want} == want


def test_substring_sql(spark):
    import duckdb

    from ledgerlight.llm import queries

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    found = duck.sql(queries.ORACLE_SQL["op1_substring_dedup"])
    got = queries.op1_substring_dedup(spark, sf).select(*found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), corpus_pipeline.common.written(stage(spark, kept, sf), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= before
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
    assert pieces.select("doc_id").distinct().count() == kept.count()
