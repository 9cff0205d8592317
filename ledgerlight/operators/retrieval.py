"""Passages from KPI tables and reports, their vectors, and cosine search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import filled, words
from . import anomalies, kpis
from .measures import by
from .rules import number


def kpi_passages(s: DataFrame) -> DataFrame:
    """``chunk_id, chunk_type, filter_year, filter_region, content`` of the whole, years, products, anomalies, segments and regions."""
    c = F.col
    none = F.lit(None).cast("string")
    row = lambda df, kind, ident, content, year=F.lit(None).cast("int"), region=none: df.select(F.concat(F.lit(f"{kind}-"), ident).alias("chunk_id"), F.lit(kind).alias("chunk_type"), year.cast("int").alias("filter_year"), region.alias("filter_region"), content.alias("content"))
    recap = kpis.global_recap(s)
    rank = F.row_number().over(Window.orderBy(F.desc("sales"), "sub_category"))
    top = kpis.top_products(s).withColumn("rank", rank)  # ten rows
    regions = kpis.share_pct(by(s, ["region"], ["sales"]))
    parts = [
        row(recap, "global", c("period"), F.concat(F.lit("Sales over "), "period", F.lit(": "), number(c("sales"), 0), F.lit(" in "), c("orders").cast("string"), F.lit(" orders; best year "), c("best_year").cast("string"), F.lit("."))),
        row(kpis.annual(s), "annual", c("year").cast("string"), F.concat(F.lit("In "), c("year").cast("string"), F.lit(" sales were "), number(c("sales"), 0), F.coalesce(F.concat(F.lit(", a change of "), number(c("yoy_pct")), F.lit("%")), F.lit("")), F.lit(".")), c("year")),
        row(top, "top_product", "sub_category", F.concat(F.lit("Rank "), c("rank").cast("string"), F.lit(": "), "sub_category", F.lit(" with "), number(c("sales"), 0), F.lit("."))),
        row(anomalies.anomalies(s), "anomaly", F.concat_ws("-", "year", "quarter"), F.concat("description", F.lit(" against the same quarter of the year before.")), c("year")),
        row(kpis.segment_share(s), "segment", c("segment"), F.concat(F.lit("Segment "), "segment", F.lit(" holds "), number(c("share_pct")), F.lit("% of sales."))),
        row(regions, "region", c("region"), F.concat(F.lit("Region "), "region", F.lit(" holds "), number(c("share_pct")), F.lit("% of sales.")), region=c("region")),
    ]
    return reduce(DataFrame.unionByName, parts)


def packed_paragraphs(df: DataFrame, id_col: str, text_col: str = "text", most: int = 250) -> DataFrame:
    """Paragraphs in order, packed greedily into chunks of at most ``most`` words; a longer paragraph stands alone.

    A fold over the paragraphs' numbers of words finds where chunks begin; only then are the
    texts joined, each once. Null texts and texts of blanks have no chunk.
    """
    size = lambda p: F.size(F.split(F.trim(p), r"\s+"))
    parts = F.filter(F.transform(F.split(filled(text_col), r"\n\s*\n|\n"), lambda s: F.trim(s)), lambda p: p != "")
    rows = df.select(id_col, parts.alias("parts")).filter(F.size("parts") > 0).withColumn("sizes", F.transform("parts", size))
    state = "struct<starts:array<int>,n:int,i:int>"
    begin = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("n"), F.lit(1).alias("i")).cast(state)

    def add(a, words):
        full = (a["n"] > 0) & (a["n"] + words > most)
        return F.struct(F.when(full, F.array_append(a["starts"], a["i"])).otherwise(a["starts"]).alias("starts"), F.when(full, words).otherwise(a["n"] + words).alias("n"), (a["i"] + 1).alias("i")).cast(state)

    rows = rows.withColumn("starts", F.aggregate("sizes", begin, add, lambda a: a["starts"]))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("parts") + 1))
    rows = rows.select(id_col, "parts", F.posexplode(F.zip_with("starts", ends, lambda a, z: F.struct(a.alias("a"), z.alias("z")))).alias("chunk", "cut"))
    content = F.array_join(F.slice("parts", F.col("cut.a"), F.col("cut.z") - F.col("cut.a")), "\n\n")
    return rows.select(id_col, "chunk", content.alias("content")).withColumn("n_words", F.size(F.split("content", r"\s+")))


def embedded(df: DataFrame, text_col: str = "content", size: int = 384) -> DataFrame:
    """A unit vector for each text by hashed word counts; a text without words gets the zero vector."""
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=size).transform(df.withColumn("_w", words(filled(text_col))))
    return Normalizer(inputCol="_tf", outputCol="_v").transform(counted).withColumn("embedding", vector_to_array("_v", "float32")).drop("_w", "_tf", "_v")


def encoded(df: DataFrame, make_encoder: Callable, size: int, text_col: str = "content", rows: int = 32) -> DataFrame:
    """Columns ``embedding`` and ``encoded`` for each text, by any encoder.

    ``make_encoder()`` gives a function from a list of texts to a list of vectors of ``size``
    numbers; it is called once a task. Texts go to it in batches of ``rows``; a batch that
    fails is tried text by text, and a text that fails again gets the zero vector, with
    ``encoded`` false. A null text counts as the empty one; an empty table never makes an
    encoder. The encoder has to be importable by, or sent along to, the executors.
    """
    at, names = df.columns.index(text_col), [*df.columns, "embedding", "encoded"]

    def run(batches):
        import pyarrow as pa

        encode = None
        for b in batches:
            for own in (b.slice(i, rows) for i in range(0, b.num_rows, rows)):
                encode = encode or make_encoder()
                texts = [t or "" for t in own.column(at).to_pylist()]

                def tried(part):
                    found = [[float(x) for x in v] for v in encode(part)]
                    if len(found) != len(part) or any(len(v) != size for v in found):
                        raise ValueError("the encoder gave vectors of another number or size")
                    return found

                try:
                    vectors, fine = tried(texts), [True] * len(texts)
                except Exception:  # whatever an encoder raises; each text is tried alone
                    vectors, fine = [], []
                    for t in texts:
                        try:
                            vectors += tried([t])
                            fine.append(True)
                        except Exception:
                            vectors.append([0.0] * size)
                            fine.append(False)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(fine)], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("encoded", T.BooleanType())]))


def letter_encoder(size: int = 8) -> Callable:
    """Makes an encoder without a model: how many letters of each of the first ``size`` of the alphabet stand in a text. Needs nothing of this package on the executors."""
    letters = "abcdefghijklmnopqrstuvwxyz"[:size]
    return lambda: lambda texts: [[t.count(c) for c in letters] for t in texts]


def unit(df: DataFrame, col: str) -> DataFrame:
    v = F.transform(F.col(col), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn(col, F.transform(v, lambda x: x / F.nullif(norm, F.lit(0.0)))).filter(norm > 0)


def scored_pairs(queries: DataFrame, passages: DataFrame, query_id: str = "query_id", passage_id: str = "passage_id", most_queries: int = 10_000) -> DataFrame:
    """The similarity (cosine, four digits) of each query and each passage of another id; both have a column ``embedding``. Null and zero vectors take no part.

    Queries go to every task in blocks of about ``most_queries``, dealt by a hash of their
    id, so a broadcast stays bounded however many there are; each block reads the passages
    once. The rows are as many as the product of both sizes.
    """
    return reduce(DataFrame.unionByName, _scored(queries, passages, query_id, passage_id, most_queries))


def _scored(queries: DataFrame, passages: DataFrame, query_id: str, passage_id: str, most_queries: int) -> list[DataFrame]:
    n = queries.count()
    blocks = -(-n // most_queries) or 1
    dot = F.aggregate(F.zip_with("_q", "embedding", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    mine = unit(queries.select(query_id, F.col("embedding").alias("_q")), "_q")
    units = unit(passages.select(passage_id, "embedding"), "embedding")
    parts = [mine] if blocks == 1 else [mine.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) for b in range(blocks)]
    return [units.join(F.broadcast(q), F.col(passage_id) != F.col(query_id)).select(query_id, passage_id, F.round(dot, 4).alias("similarity")) for q in parts]


def cosine_top(queries: DataFrame, passages: DataFrame, k: int = 5, least: float = 0.3, query_id: str = "query_id", passage_id: str = "passage_id", most_queries: int = 10_000, where: dict | None = None) -> DataFrame:
    """The ``k`` passages nearest to each query by cosine, above ``least``, as ``scored_pairs`` scores them.

    ``where`` restricts passages by equality on their columns (a None asks for null).
    """
    for column, value in (where or {}).items():
        passages = passages.filter(F.col(column).eqNullSafe(F.lit(value)))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("similarity"), passage_id))
    best = [scored.filter(F.col("similarity") > least).withColumn("rank", rank).filter(F.col("rank") <= k) for scored in _scored(queries, passages, query_id, passage_id, most_queries)]
    return reduce(DataFrame.unionByName, best)


def pair_cosines(pairs: DataFrame, vectors: DataFrame, id_col: str = "passage_id") -> DataFrame:
    """``a, b, similarity`` of each stated pair of ids (columns ``a, b``), four digits; pairs without both vectors, or with a zero one, go."""
    units = unit(vectors.filter("embedding is not null").select(id_col, "embedding"), "embedding")
    side = lambda n: units.select(F.col(id_col).alias(n), F.col("embedding").alias(f"_{n}"))
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(dot, 4).alias("similarity"))


def report_passages(reports: DataFrame, id_col: str, bullets: list[str], text_col: str = "report", most: int = 250) -> DataFrame:
    """``id, chunk, chunk_type, content``: a report's packed paragraphs, and one passage of its summary lines (columns ``bullets``)."""
    packed = packed_paragraphs(reports, id_col, text_col, most).select(id_col, "chunk", F.lit("report").alias("chunk_type"), "content")
    full = F.filter(F.array(*map(F.col, bullets)), lambda b: F.coalesce(F.trim(b), F.lit("")) != "")
    lines = reports.select(id_col, F.lit(-1).alias("chunk"), F.lit("summary").alias("chunk_type"), F.array_join(F.transform(full, lambda b: F.concat(F.lit("- "), b)), "\n").alias("content"))
    return packed.unionByName(lines.filter("content <> ''"))


def write_index(passages: DataFrame, path: str) -> None:
    """The passages with their vectors as a table, replaced whole; missing metadata stays null."""
    columns = ["chunk_id", "chunk_type", "filter_year", "filter_region", "content", "embedding"]
    passages.select(*columns).write.mode("overwrite").parquet(path)


def index_stats(passages: DataFrame) -> DataFrame:
    return passages.groupBy("chunk_type").agg(F.count("*").alias("n"))
