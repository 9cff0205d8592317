"""SimHash near-duplicate classes by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits have a half that differs in at
most one. Each half is therefore indexed as it is and with one bit struck out at each
place; equality joins on these keys find every pair, which is then verified on all bits.
A struck-out key only joins a half that has the bit with one that lacks it, so a pair
comes up once for each half at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, ship, whole_texts, written
from .components import connected_components

BITS = 64


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    """SimHash of one text over its word shingles, repeats included; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, ASCII blanks alone
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(size, len(words)) - 1
    starts = (ends - lengths)[: len(words) - k].tolist()
    h64 = xxhash.xxh64_intdigest
    hashes = np.array([h64(joined[a:b], seed) for a, b in zip(starts, ends[k:].tolist())], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view("u1")).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row."""
    ship(docs.sparkSession)

    def batch(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, size, seed) for t in whole_texts(b)], np.uint64)
        return {"doc_id": b.column(0), "fp": fps.view(np.int64)}

    def run(batches):
        for b in batches:
            yield from by_batch(batch, pa.schema([("doc_id", b.schema.field(0).type), ("fp", pa.int64())]))(iter([b]))

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _half(which: int) -> Column:
    return F.shiftrightunsigned("fp", 32) if which else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


def _refined(rows: DataFrame, crowd: int) -> DataFrame:
    """Keys as they are in small buckets; a crowded bucket is cut by the 11-bit parts of the other half.

    Other halves that differ in at most two bits agree in one of three parts, so a crowded
    bucket loses no pair when each of its rows is indexed by (key, part number, part).
    """
    size = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    size = written(size.select("key", F.lit(True).alias("crowded")), "simhash-crowded")
    if size.isEmpty():
        return rows.select("key", F.lit(0).cast("long").alias("part"), "bit", "fp")
    parts = F.array(*[F.shiftrightunsigned("other", 11 * p).bitwiseAND(F.lit(0x7FF)) + (p << 11) for p in range(3)])
    return rows.join(size, "key", "left").select("key", F.explode(F.when(F.col("crowded"), parts).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"), "bit", "fp")


def close_pairs(fps: DataFrame, crowd: int = 256) -> DataFrame:
    """``a, b`` (a < b): the distinct fingerprints in column ``fp`` that differ in one or two bits."""
    keyed = []
    for which in (0, 1):
        half, other = _half(which), _half(1 - which)
        variants = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("boolean").alias("bit"), half.alias("v")), *[F.struct(F.lit(i).alias("i"), (half.bitwiseAND(F.lit(1 << i)) != 0).alias("bit"), half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).alias("v")) for i in range(32)])
        keyed.append(
            fps.select("fp", other.alias("other"), F.explode(variants).alias("x")).select(
                "fp", "other", "x.bit", (F.shiftleft(F.lit(33 * which + 1).cast("long") + F.col("x.i"), 32) + F.col("x.v")).alias("key")
            )
        )
    rows = _refined(keyed[0].unionByName(keyed[1]), crowd)
    left, right = rows.filter("bit is null or not bit"), rows.filter("bit is null or bit")
    on = ["key", "part"]
    # Spark takes the exploded keys for as small as the fingerprints that they come from; a broadcast of them would fill the driver.
    joined = left.select(*on, F.col("fp").alias("x"), F.col("bit").alias("xb")).hint("merge").join(right.select(*on, F.col("fp").alias("y"), F.col("bit").alias("yb")), on)
    near = (F.col("xb").isNull() & F.col("yb").isNull() & (F.col("x") < F.col("y"))) | (F.col("xb").isNotNull() & F.col("yb").isNotNull())
    near &= F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2
    return joined.filter(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicate_classes(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id that links of at most two differing bits reach.
    Equal fingerprints are linked by grouping, so copies are never expanded into pairs;
    texts without words, null ones included, have fingerprint zero and are linked like any
    other. A null id takes part and stays null; a component of null ids alone has a null
    id. Repeated rows each get a row; very long texts are read whole; an empty table gives an
    empty one; other columns are not read.
    """
    fps = written(fingerprints(docs, size, seed, id_col, text_col), "simhash-fps")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = connected_components(close_pairs(distinct.select("fp")), "a", "b")
    owner = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    owner = written(owner, "simhash-owner")
    # Written, so that both sides of the join are plain exchanges and Spark can split a giant component.
    roots = written(owner.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-roots")
    by_fp = owner.select("fp", "root").join(roots, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_class(docs: DataFrame, size: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each near-duplicate class: that of the smallest id (null last), then of the least text hash."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col(text_col).alias("text"))  # columns of any name
    classes = near_duplicate_classes(rows, size, seed, "key", "text")
    stay = classes.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("stay")).distinct()
    # Structs are equal where their fields are, null ids included.
    return rows.join(stay, F.col("key") == F.col("stay"), "left_semi").dropDuplicates(["key"]).select("row.*")
