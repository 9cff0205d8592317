"""Substring deduplication on a log-structured index of window fingerprints.

Every window of ``width`` words is represented by its anchor, the smallest hash of the
short shingles inside it. Equal windows have equal anchors, and neighbouring windows
mostly share one, so the index holds about one row for fifteen words. It is a list of
immutable runs, each sorted by fingerprint; a new batch is merge-joined with
the runs, becomes a run itself, and runs are compacted into one when there are too many.
What those joins find, over all batches, are the anchors that occur again.

Anchors that occur again only name candidates. Those are verified on hashes of the whole
windows: stretches of windows that recur as they are, by one hash each; the stretches at
the edge of a shared passage, window by window. A window is named by its anchor and its
own hash together, 128 bits: words have two hashes of different seeds, of which one goes
into anchors and the other into the hashes of windows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, ship, sized, whole_texts, written

WIDTH = 35
SHINGLE = 6
SEGMENT = 1 << 18
BLANKS = np.zeros(256, bool)
BLANKS[[32, *range(9, 14)]] = True
ODD = 0x9E3779B97F4A7C15
WORD_ODD = 0xD6E8FEB86659FD93


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    n, inverse = 1 << bits, pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Short words are hashed by tabulation, a random number for each place and byte; longer ones by xxhash.
TABULATED = 32
TABLES = [_mix(np.arange(1, 256 * TABULATED + 1, dtype=np.uint64) * np.uint64(ODD) + np.uint64(seed)) for seed in (0, 0xA0761D6478BD642F)]


def word_hashes(data: bytes) -> np.ndarray:
    """Two 64-bit hashes of each word ``[^\\x20\\x09-\\x0D]+``, as two rows, made segment by segment."""
    found = []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SEGMENT)
        while end < n and not BLANKS[data[end]]:
            end += 1
        a = np.frombuffer(data, np.uint8, end - at, at)
        blank = BLANKS[a]
        edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        size = ends - starts
        begun = np.zeros(len(a), np.int32)
        begun[starts] = starts
        place = np.arange(len(a), dtype=np.int32) - np.maximum.accumulate(begun)
        cell = (np.minimum(place, TABULATED - 1) << 8) | a
        out = np.empty((2, len(starts)), np.uint64)
        total = np.zeros(len(a) + 1, np.uint64)
        for k, table in enumerate(TABLES):
            np.cumsum(table[cell], out=total[1:])
            out[k] = _mix(total[ends] - total[starts] + size.astype(np.uint64))
        for i in np.flatnonzero(size > TABULATED):
            word = data[at + starts[i] : at + ends[i]]
            out[0, i], out[1, i] = xxhash.xxh3_64_intdigest(word, 1), xxhash.xxh3_64_intdigest(word, 2)
        found.append(out)
        at = end
    return np.concatenate(found, 1) if found else np.zeros((2, 0), np.uint64)


class Windows:
    """Hashes of all runs of words of one document, of one of the words' two hashes."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        up, self.down = _powers(WORD_ODD, max(15, (self.n + 1).bit_length()))
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * up[: self.n], out=self.total[1:])

    def hashes(self, starts: np.ndarray, length) -> np.ndarray:
        return _mix((self.total[starts + length] - self.total[starts]) * self.down[starts] + np.asarray(length).astype(np.uint64))


def stretches(words: np.ndarray, width: int, shingle: int):
    """Anchor, first window, number of windows and hash of each stretch of windows with one anchor."""
    if width - shingle > 61:
        raise ValueError("a stretch must fit into the bits of a long")
    n = words.shape[1] - width + 1
    if n <= 0:
        return None
    low = Windows(words[0]).hashes(np.arange(words.shape[1] - shingle + 1), shingle)
    place = np.arange(len(low))
    span, have = width - shingle + 1, 1

    def smaller(a, b):
        return np.where(low[b] < low[a], b, a)

    while 2 * have <= span:
        place = smaller(place[:-have], place[have:])
        have *= 2
    place = smaller(place[:n], place[span - have :][:n])
    # Equal windows have their anchor at the same place inside, so a stretch never holds two.
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    size = np.diff(np.r_[first, n])
    anchor = low[place]
    return anchor[first], first, size, Windows(words[1]).hashes(first, size + width - 1)


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of the same id and text are treated alike; the key tells apart those of other texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), text.alias("text"))


def _stretches(keyed: DataFrame, width: int, shingle: int) -> DataFrame:
    """``fp, doc, key, first, n, run, old``: every stretch of every document of at least ``width`` words."""
    keyed = keyed if "old" in keyed.columns else keyed.withColumn("old", F.lit(False))
    kind = keyed.schema["doc"].dataType.simpleString()

    def run(batches):
        for b in sized(batches, 2):
            rows, where = [], []
            for i, t in enumerate(whole_texts(b, 2)):
                got = stretches(word_hashes(t.encode("utf-8", "surrogatepass")), width, shingle)
                if got:
                    rows.append(got)
                    where.append(np.full(len(got[0]), i))
            if rows:
                fp, first, n, h = map(np.concatenate, zip(*rows))
                at = pa.array(np.concatenate(where))
                columns = [pa.array(fp.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), b.column(3).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "doc", "key", "first", "n", "run", "old"])

    return keyed.select("doc", "key", "text", "old").mapInArrow(run, f"fp long, doc {kind}, key long, first int, n int, run long, old boolean")


class FingerprintIndex:
    """Sorted immutable runs of ``fp, n`` (how many stretches have that anchor), each a Parquet table whose files are sorted by ``fp``.

    ``runs`` are the paths of runs written before, by this index or an earlier one.
    ``ingest`` merge-joins a batch with all of them and makes it the newest run; beyond
    ``most_runs`` all are compacted into one.
    """

    def __init__(self, spark, runs: list[str] | None = None, most_runs: int = 4):
        self.spark, self.runs, self.most_runs = spark, list(runs or []), most_runs

    def run(self, path: str) -> DataFrame:
        return self.spark.read.schema("fp long, n long").parquet(path)

    def ingest(self, anchors: DataFrame) -> DataFrame:
        """Anchors of the batch (column ``fp``) that recur in it or stand in an older run."""
        path = self._write(anchors.groupBy("fp").agg(F.count("*").alias("n")))
        batch = self.run(path)
        again = batch.filter("n > 1").select("fp")
        for r in self.runs:
            again = again.unionByName(batch.select("fp").join(self.run(r).select("fp").hint("merge"), "fp", "left_semi"))
        found = written(again.distinct(), "substring-again")
        self.runs.append(path)
        if len(self.runs) > self.most_runs:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs into one; the old ones go."""
        if len(self.runs) > 1:
            every = self.run(self.runs[0])
            for r in self.runs[1:]:
                every = every.unionByName(self.run(r))
            old, self.runs = self.runs, [self._write(every.groupBy("fp").agg(F.sum("n").alias("n")))]
            self.drop(old)

    def drop(self, runs: list[str] | None = None) -> None:
        """Delete runs, all of this index if none are named."""
        for r in runs if runs is not None else self.runs:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(r)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if runs is None:
            self.runs = []

    def _write(self, counts: DataFrame) -> str:
        path = shared_dir(self.spark, "substring-run")
        counts.sortWithinPartitions("fp").write.parquet(path)
        return path


def repeated_windows(docs: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, batches: int = 2, index: FingerprintIndex | None = None, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, key, first, mask, old``: bit i of ``mask`` tells that window ``first + i`` of that text starts elsewhere too; ``old`` marks texts of ``history``."""
    keyed = _with_key(docs, id_col, text_col)
    ship(docs.sparkSession)
    own = index or FingerprintIndex(docs.sparkSession, most_runs=max(1, batches - 1))
    again = []
    for k in range(batches):  # all rows, dealt to the batches by their key
        again.append(own.ingest(_stretches(keyed.filter(F.pmod("key", F.lit(batches)) == k), width, shingle).select("fp")))
    repeated = again[0]
    for more in again[1:]:  # an anchor of two batches comes up with the later one
        repeated = repeated.unionByName(more)
    repeated = written(repeated.distinct(), "substring-repeated")  # so that the join has two plain exchanges and Spark can split a crowded anchor
    keyed = keyed.withColumn("old", F.lit(False))
    if history is not None:
        keyed = keyed.unionByName(_with_key(history, id_col, text_col).withColumn("old", F.lit(True)))
    found = written(_stretches(keyed, width, shingle).join(repeated, "fp"), "substring-candidates")
    if index is None:
        own.drop()

    stretch = ["fp", "run", "n"]
    counts = written(found.groupBy(*stretch).agg(F.count("*").alias("times"), F.min(F.struct("first", "key", "doc", "old")).alias("at")), "substring-stretches")
    every = F.expr("shiftleft(1L, n) - 1")
    copied = found.join(counts.filter("times > 1").select(*stretch), stretch).select("doc", "key", "old", "first", every.alias("mask"))

    # Aggregates are written before a table is joined with its own, so that Spark can split a crowded key.
    contested = written(counts.groupBy("fp").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("fp"), "substring-contested")
    edges = counts.join(contested, "fp").select(F.col("at.doc").alias("doc"), F.col("at.key").alias("key"), F.col("at.old").alias("old"), F.struct("fp", F.col("at.first").alias("first"), "n", "times").alias("e"))
    lists = edges.groupBy("doc", "key", "old").agg(F.collect_list("e").alias("edges"))
    windows = written(_edge_windows(_joined(keyed, lists, "inner"), width), "substring-windows")
    twice = written(windows.groupBy("fp", "hash").agg(F.sum("times").alias("times")).filter("times > 1").select("fp", "hash"), "substring-twice")
    single = windows.filter("times = 1").join(twice, ["fp", "hash"]).groupBy("doc", "key", "old", "first").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    return copied.unionByName(single)


def _joined(keyed: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    own = lists.withColumnsRenamed({"doc": "doc_", "key": "key_", "old": "old_"})
    return keyed.join(own, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("key") == F.col("key_")) & (F.col("old") == F.col("old_")), how).drop("doc_", "key_", "old_")


def _edge_windows(joined: DataFrame, width: int) -> DataFrame:
    kind = joined.schema["doc"].dataType.simpleString()

    def run(batches):
        for b in sized(batches, 2):
            docs, keys, olds = (b.column(i).to_pylist() for i in (0, 1, 3))
            out: dict[str, list] = {k: [] for k in ("fp", "hash", "doc", "key", "old", "first", "i", "times")}
            for doc, key, old, text, edges in zip(docs, keys, olds, whole_texts(b, 2), b.column(4).to_pylist()):
                w = Windows(word_hashes(text.encode("utf-8", "surrogatepass"))[1])
                for e in edges:
                    n = e["n"]
                    out["hash"].append(w.hashes(np.arange(e["first"], e["first"] + n), width).view(np.int64))
                    out["i"].append(np.arange(n, dtype=np.int32))
                    for k, v in (("fp", e["fp"]), ("doc", doc), ("key", key), ("old", old), ("first", e["first"]), ("times", e["times"])):
                        out[k].extend([v] * n)
                if len(out["fp"]) >= 100_000:
                    yield _flat(out, b.schema.field(0).type)
                    for v in out.values():
                        v.clear()
            if out["fp"]:
                yield _flat(out, b.schema.field(0).type)

    def _flat(out, doc_type):
        types = {"fp": pa.int64(), "doc": doc_type, "key": pa.int64(), "old": pa.bool_(), "first": pa.int32(), "times": pa.int64()}
        columns = [pa.array(np.concatenate(v)) if k in ("hash", "i") else pa.array(v, types[k]) for k, v in out.items()]
        return pa.RecordBatch.from_arrays(columns, names=list(out))

    return joined.select("doc", "key", "text", "old", "edges").mapInArrow(run, f"fp long, hash long, doc {kind}, key long, old boolean, first int, i int, times long")


def remove_repeated(docs: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, batches: int = 2, index: FingerprintIndex | None = None, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text`` (kept words joined by one blank).

    A word goes if a window of ``width`` words that covers it starts anywhere else as well,
    in the same document or another; windows are judged on the input. ``batches`` is the
    number of batches in which the index takes the rows. With an ``index`` of earlier loads
    and their table as ``history``, copies there count too; the rows join the index, and the
    history is read for verification alone. Null and empty texts have no words; null ids stay null; repeated rows count as copies of each other and get a row
    each; very long texts are read whole, their words hashed segment by segment; an empty table gives an empty one; other columns are not read.
    """
    keyed = _with_key(docs, id_col, text_col).withColumn("old", F.lit(False))
    marks = repeated_windows(docs, width, shingle, batches, index, history, id_col, text_col).filter("not old")
    lists = marks.groupBy("doc", "key", "old").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))
    kind = keyed.schema["doc"].dataType.simpleString()

    def run(rows):
        for b in sized(rows, 2):
            n_words, n_removed, kept_text = [], [], []
            for text, marks in zip(whole_texts(b, 2), b.column(4).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                gone = np.zeros(len(words) + 1, np.int64)
                for m in marks or ():
                    bits = np.unpackbits(np.array([m["mask"]], "<i8").view("u1"), bitorder="little")
                    starts = np.flatnonzero(bits) + m["first"]
                    np.add.at(gone, starts, 1)
                    np.subtract.at(gone, np.minimum(starts + width, len(words)), 1)
                keep = (np.cumsum(gone)[:-1] == 0).tolist()
                kept = words if not marks else [w for w, k in zip(words, keep) if k]
                n_removed.append(len(words) - len(kept))
                kept_text.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_text"])

    return _joined(keyed, lists, "left").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
