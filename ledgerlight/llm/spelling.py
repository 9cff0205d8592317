"""Spelling variants by an index of variable-length grams.

The gram dictionary is pruned by frequency: a gram that is frequent among the words is
replaced by its extensions, one letter at a time, so common beginnings give long grams and
rare ones short. A word is decomposed into the longest dictionary gram at each place, without
those that lie inside another. Of its grams, one edit can affect so many at most (the word's
bound); near words therefore share all others, and already share one of the rarest
``bound + 1`` of each. Only the lists of those are merged. What they bring together is
verified by edit distance.

A list is keyed by the word up to the gram, or from it on, as the edit lies on one side of it.
Crowded lists are split without loss by the other side, with one letter struck out. Words
whose bound leaves no gram for sure are matched among themselves on grams of the least
length, of which three at most are affected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sized, written

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_TIMES, LOST_ONE_IN, TIMES_RARER = 6, 5, 199, 5
SHORTEST, LONGEST = 3, 5  # letters of grams
SHARE, LEAST_FREQUENT = 20_000, 10  # a gram is frequent beyond one in SHARE of its length and LEAST_FREQUENT words
CROWDED = 64
FLUSH = 200_000
LOWER = {c: c + 32 for c in range(65, 91)}


def damaged_words(docs: DataFrame, least: int = LEAST_LETTERS, lost_one_in: int = LOST_ONE_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: how often each word of at least ``least`` letters stands in the texts, after one run in ``lost_one_in`` has lost a letter.

    Which one is a hash of document id (``null`` for none) and run. Counts are combined in the
    tasks before the shuffle; null and empty texts have no words.
    """
    ship(docs.sparkSession)
    run = re.compile(RUN + "{%d,}" % least)

    def count(batches):
        total: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for b in sized(batches, 1):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                start = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                found = run.finditer(text.as_py() or "")
                while part := Counter([m.group() for m in islice(found, FLUSH)]):
                    for word, n in part.items():
                        word = word.lower() if word.isascii() else word.translate(LOWER)
                        h = zlib.crc32(word.encode(), start)
                        if h % lost_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        total[word] += n
                    if len(total) > FLUSH:
                        yield flushed()
        yield flushed()

    return docs.select(id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """The gram dictionary, given by its frequent grams, each with its frequency."""

    def __init__(self, frequent: dict[str, int], shortest: int = SHORTEST, longest: int = LONGEST):
        self.frequent, self.shortest, self.longest = frequent, shortest, longest
        self.endings = {g[k:] for g in frequent if len(g) < longest for k in range(len(g) + 1)} | {""}

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """Start and end of each gram of a word, in order."""
        frequent, n, out, last = self.frequent, len(word), [], 0
        for a in range(n - self.shortest + 1):
            b = a + self.shortest
            while b < n and b - a < self.longest and word[a:b] in frequent:
                b += 1
            if b > last:
                out.append((a, b))
                last = b
        return out

    def bound(self, word: str, grams: list[tuple[int, int]]) -> int:
        """How many grams one edit can affect at most: those over its place, and those right of it that a longer gram could now cover.

        An insertion affects no more than a replacement of the letter beside it.
        """
        most = 0
        for i in range(len(word)):
            hit = 0
            for a, b in grams:
                hit += a <= i < b or (i < a and b - i <= self.longest and word[i + 1 : b - 1] in self.endings)
            most = max(most, hit)
        return most

    def rarest(self, word: str, grams: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        return sorted(grams, key=lambda g: (self.frequent.get(word[g[0] : g[1]], 0), word[g[0] : g[1]], g[0]))[:k]

    def lists(self, word: str):
        """The lists that a word stands in: key, side (0: the word up to the gram, 1: from it on), whether it is the longer word there, and where the other side begins or ends."""
        grams = self.decompose(word)
        bound = self.bound(word, grams)
        chosen = [("v", a, b) for a, b in self.rarest(word, grams, bound + 1)]
        if bound >= len(grams):
            fixed = [(a, a + self.shortest) for a in range(len(word) - self.shortest + 1)]
            chosen += [("f", a, b) for a, b in self.rarest(word, fixed, self.shortest + 1)]
        n = len(word)
        for kind, a, b in chosen:
            for longer in (0, 1):
                yield xxhash.xxh3_64_intdigest(f"{kind}0 {n - longer} {a} {word[:b]}"), 0, longer, b
                if a >= longer:
                    yield xxhash.xxh3_64_intdigest(f"{kind}1 {n - longer} {a - longer} {word[a:]}"), 1, longer, a


def struck_out(key: int, side: int, longer: int, cut: int, word: str) -> list[tuple[int, int]]:
    """Keys that split a crowded list: words that differ by one edit in the other side share one."""
    rest = word[:cut] if side else word[cut:]
    if longer:
        return [(xxhash.xxh3_64_intdigest(f"{key} {rest[:i]}{rest[i + 1 :]}"), 1) for i in range(len(rest)) if i == 0 or rest[i] != rest[i - 1]]
    return [(xxhash.xxh3_64_intdigest(f"{key} {rest}"), 0)] + [(xxhash.xxh3_64_intdigest(f"{key} {rest[:i]}*{rest[i + 1 :]}"), 0) for i in range(len(rest))]


def gram_dictionary(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, share: int = SHARE, least: int = LEAST_FREQUENT) -> dict[str, int]:
    """Frequent grams of all words with their frequencies; ``share`` of each length at most, so the driver and the tasks can hold them."""

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for word in b.column(0).to_pylist():
                total.update([word[a : a + k] for k in range(shortest, longest + 1) for a in range(len(word) - k + 1)])
            if len(total) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["gram", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["gram", "n"])

    grams = written(words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "spelling-grams")
    size = F.length("gram")
    total = {r["k"]: r["n"] for r in grams.groupBy(size.alias("k")).agg(F.sum("n").alias("n")).collect()}
    enough = F.lit(False)
    for k, n in total.items():
        enough = enough | ((size == k) & (F.col("n") > max(least, n // share)))
    return {r["gram"]: r["n"] for r in grams.filter(enough).collect()}


def near_pairs(words: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, crowded: int = CROWDED) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of words that differ by exactly one inserted, deleted or replaced letter, once; ``words`` has distinct ``word`` of at least six letters, and ``n``."""
    ship(words.sparkSession)
    grams = words.sparkSession.sparkContext.broadcast(Grams(gram_dictionary(words, shortest, longest), shortest, longest))

    def post(batches):
        for b in batches:
            for own in (b.slice(at, 2000) for at in range(0, b.num_rows, 2000)):
                at, rows = [], []
                for k, word in enumerate(own.column(0).to_pylist()):
                    new = [*grams.value.lists(word)]
                    rows += new
                    at += [k] * len(new)
                if rows:
                    keys, sides, longer, cuts = zip(*rows)
                    at = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.uint64()).view(pa.int64()), pa.array(sides, pa.int8()), pa.array(longer, pa.int8()), pa.array(cuts, pa.int32()), own.column(0).take(at), own.column(1).take(at)], names=["key", "side", "longer", "cut", "word", "n"])

    def split(batches):
        for b in batches:
            for own in (b.slice(at, 2000) for at in range(0, b.num_rows, 2000)):
                at, rows = [], []
                for k, r in enumerate(zip(*(own.column(i).to_pylist() for i in range(5)))):
                    new = struck_out(*r)
                    rows += new
                    at += [k] * len(new)
                keys, longer = zip(*rows) if rows else ((), ())
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.uint64()).view(pa.int64()), pa.array(longer, pa.int8()), own.column(4).take(at), own.column(5).take(at)], names=["key", "longer", "word", "n"])

    posted = written(words.select("word", "n").mapInArrow(post, "key long, side byte, longer byte, cut int, word string, n long"), "spelling-lists")
    # A list that brings words together has one of its own length, and another word.
    sizes = written(posted.groupBy("key").agg(F.count("*").alias("size"), F.min("longer").alias("least")).filter("size > 1 and least = 0").select("key", "size"), "spelling-sizes")
    shared = posted.join(sizes, "key")
    few = shared.filter(F.col("size") <= crowded).select("key", "longer", "word", "n")
    many = shared.filter(F.col("size") > crowded).select("key", "side", "longer", "cut", "word", "n").mapInArrow(split, "key long, longer byte, word string, n long")
    members = written(few.unionByName(many), "spelling-members")
    a = members.filter("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = members.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    pairs = a.join(b, "key").filter("longer = 1 or a < b").filter(F.levenshtein("a", "b", 1) == 1)
    return pairs.select("a", "n_a", "b", "n_b").distinct()


def variant_forms(words: DataFrame, times: int = TIMES_RARER, shortest: int = SHORTEST, longest: int = LONGEST, crowded: int = CROWDED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of a written table ``word, n``.

    A word's form is its near word of the largest count (ties: the smallest in code-point
    order), if that is at least ``times`` its own; the root is where forms lead.
    """
    pairs = written(near_pairs(words, shortest, longest, crowded), "spelling-pairs")
    swapped = pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
    near = written(pairs.unionByName(swapped).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.max("n_a").alias("own"), best.alias("best")), "spelling-near")
    known = near.select("word", "n_near", F.when(-F.col("best.less") >= times * F.col("own"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("n"))).alias("f"))
    steps = written(known.filter("f is not null").select("word", F.col("f.form").alias("root")), "spelling-steps")
    while True:  # each round doubles the steps taken; counts grow by ``times`` with every step, so rounds are few
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(steps.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-steps")
        steps = further.select("word", "root")
        if further.filter("moved").isEmpty():
            break
    return words.join(known, "word", "left").join(steps, "word", "left").select(
        "word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("f.n").alias("form_n")
    )


def spelling_variants(docs: DataFrame, least: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, times: int = TIMES_RARER, lost_one_in: int = LOST_ONE_IN, crowded: int = CROWDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words of all texts, each damaged as in ``damaged_words``, of at least ``least`` letters and ``least_times`` occurrences.

    Null and empty texts have no words, a null id counts as the word null, repeated rows count
    each, very long texts are read part by part, an empty table gives an empty one, other
    columns are not read; equal counts are told apart by code-point order.
    """
    words = written(damaged_words(docs, least, lost_one_in, id_col, text_col).filter(F.col("n") >= least_times), "spelling-words")
    return variant_forms(words, times, crowded=crowded)
