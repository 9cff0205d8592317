"""Counterfactual-regularised toxicity classifier.

A logistic model over words and word beginnings. Beside the label loss it is fitted on
counterfactual pairs: in labelled sentences each identity term is swapped for other groups'
terms of the same form and for the neutral ones, and into labelled sentences without such a
term one is put at some place. A change of the score between the two is penalised, so a
neutral mention of a group says nothing about toxicity, whatever the labelled sample suggests.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, bounded_rows, release, ship, sized, whole_texts, written

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
#: Identity terms by language, a group a row in three forms: persons, one person, of a person. The first row is neutral and also takes their place.
IDENTITY_TERMS = {
    "en": [("people", "person", "human"), ("women", "woman", "female"), ("men", "man", "male"), ("muslims", "muslim", "islamic"), ("christians", "christian", "catholic"), ("jews", "jew", "jewish"), ("gays", "gay", "homosexual"), ("lesbians", "lesbian", "queer"), ("blacks", "black", "african"), ("whites", "white", "european"), ("asians", "asian", "oriental"), ("immigrants", "immigrant", "foreign"), ("refugees", "refugee", "displaced"), ("amputees", "amputee", "disabled")],
    "fr": [("gens", "personne", "humain"), ("femmes", "femme", "féminine"), ("hommes", "homme", "masculin"), ("musulmans", "musulman", "islamique"), ("chrétiens", "chrétien", "catholique"), ("juifs", "juif", "hébraïque"), ("homosexuels", "homosexuel", "gay"), ("lesbiennes", "lesbienne", "saphique"), ("noirs", "noir", "africain"), ("blancs", "blanc", "européen"), ("asiatiques", "asiatique", "oriental"), ("immigrés", "immigré", "étranger"), ("réfugiés", "réfugié", "exilé"), ("handicapés", "handicapé", "invalide")],
    "de": [("leute", "person", "menschlich"), ("frauen", "frau", "weiblich"), ("männer", "mann", "männlich"), ("muslime", "muslim", "islamisch"), ("christen", "christ", "christlich"), ("juden", "jude", "jüdisch"), ("homosexuelle", "homosexueller", "schwul"), ("lesben", "lesbe", "lesbisch"), ("schwarze", "schwarzer", "afrikanisch"), ("weiße", "weißer", "europäisch"), ("asiaten", "asiate", "asiatisch"), ("einwanderer", "ausländer", "ausländisch"), ("flüchtlinge", "flüchtling", "geflüchtet"), ("behinderte", "behinderter", "behindert")],
    "es": [("gente", "persona", "humano"), ("mujeres", "mujer", "femenina"), ("hombres", "hombre", "masculino"), ("musulmanes", "musulmán", "islámico"), ("cristianos", "cristiano", "católico"), ("judíos", "judío", "hebreo"), ("homosexuales", "homosexual", "gay"), ("lesbianas", "lesbiana", "lésbica"), ("negros", "negro", "africano"), ("blancos", "blanco", "europeo"), ("asiáticos", "asiático", "oriental"), ("inmigrantes", "inmigrante", "extranjero"), ("refugiados", "refugiado", "exiliado"), ("discapacitados", "discapacitado", "inválido")],
}


def word_features(word: str, beginnings: tuple[int, ...] = (4, 5, 6)) -> list[str]:
    """A lower-case word and its beginnings, as features."""
    return [word, *(word[:k] + "~" for k in beginnings if len(word) > k)]


def features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}


def swaps(text: str, terms: dict[str, list[tuple[str, ...]]], most: int = 40) -> list[tuple[str, str]]:
    """At most ``most`` pairs of a labelled sentence and its counterfactual, chosen by hashes of the text.

    A sentence with an identity term stands beside itself with the term swapped for the same
    form of every other group of its language. A text without any gives two pairs: a sentence
    of it without and with a term put in.
    """
    others: dict[str, list[str]] = {}
    for rows in terms.values():
        for form in zip(*rows):
            for t in form:
                others.setdefault(t, []).extend(o for o in form if o != t)
    low = text.lower()
    pairs = []
    for s in SENTENCE.split(low) if others.keys() & set(WORD.findall(low)) else ():
        for t in sorted(set(WORD.findall(s)) & others.keys()):
            pairs += [(s, re.sub(rf"\b{re.escape(t)}\b", o, s)) for o in dict.fromkeys(others[t])]
    if not pairs and (sentences := [s for s in SENTENCE.split(low) if s.strip()]):
        every = sorted(others)
        for turn in range(2 if every else 0):
            seed = zlib.crc32(f"{turn} {low}".encode("utf-8", "surrogatepass"))
            words = sentences[seed % len(sentences)].split()
            at = seed // 7 % (len(words) + 1)
            pairs.append((" ".join(words), " ".join([*words[:at], every[seed // 11 % len(every)], *words[at:]])))
    return sorted(pairs, key=lambda p: zlib.crc32(p[1].encode("utf-8", "surrogatepass")))[:most]


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    pairs: int = 0  # how many counterfactual pairs it was fitted on

    def __post_init__(self):
        self.hits = Memo(lambda w: tuple(f for f in word_features(w) if f in self.weights), 200_000)
        self.rough = Memo(lambda w: tuple(sorted({f for x in WORD.findall(w.lower()) for f in self.hits[x]})), 250_000)

    def forget(self) -> None:
        """Empty the caches, so that a task leaves nothing in its worker."""
        for memo in (self.hits, self.rough):
            memo.clear()
            memo.old = {}

    def __reduce__(self):
        return ToxicityModel, (self.weights, self.bias, self.pairs)

    def score(self, text: str) -> float:
        rough, found = self.rough, set()
        for w in set(text.split()):
            if got := rough[w]:
                found.update(got)
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in sorted(found))))))


def fit_logistic(rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, ridge: float = 1e-4, even: float = 10.0, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps; ``pairs`` are the swapped sentences, ``even`` the weight of their penalty."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    pat, pcol, sign = [], [], []
    for i, (a, b) in enumerate(pairs):
        for c in set(a) ^ set(b):
            pat.append(i)
            pcol.append(c)
            sign.append(1.0 if c in a else -1.0)
    pat, pcol, sign = np.array(pat, np.int64), np.array(pcol, np.int64), np.array(sign)
    m, k = max(1, len(rows)), max(1, len(pairs))
    w, bias = np.zeros(n), -2.0
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(at, w[col], len(rows)))))
        r = p - y
        grad = np.bincount(col, r[at], n) / m + 2 * ridge * w
        if len(pairs):
            gap = np.bincount(pat, sign * w[pcol], len(pairs))
            grad += 2 * even / k * np.bincount(pcol, sign * gap[pat], n)
        full = np.append(grad, r.sum() / m)
        mean, square = 0.9 * mean + 0.1 * full, 0.999 * square + 0.001 * full**2
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 20_000, most_features: int = 20_000, terms: dict[str, list[tuple[str, ...]]] = IDENTITY_TERMS, even: float = 10.0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model from at most about ``bound`` labelled rows, chosen by a hash of the id.

    Candidate features are counted in Spark over the sample; those that mark toxic rows
    (at least 3 rows, odds raised beyond chance) are kept, ``most_features`` at most, and
    identity terms always; ``most_features`` is the size of the model. A text gives at most
    40 counterfactual pairs, so that their number is bounded as well. Only text is used. Rows
    without label or id are left out; with no usable rows the model scores everything alike,
    below 0.5. Other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    own = labels.groupBy(F.col(id_col).alias("id_")).agg(F.max(label_col).cast("int").alias("y")).filter("y is not null and id_ is not null")
    chosen = bounded_rows(own, "id_", bound)
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    sample = written(texts.join(F.broadcast(chosen), "id_").select("y", "text_"), "toxicity-sample")  # ids: as many as the bound

    def counted(batches):
        release()
        for b in sized(batches, 1):
            every, toxic = Counter(), Counter()
            for y, t in zip(b.column(0).to_pylist(), whole_texts(b)):
                f = features(t)
                every.update(f)
                if y:
                    toxic.update(f)
            yield pa.RecordBatch.from_pydict({"f": list(every), "n": list(every.values()), "a": [toxic[f] for f in every]}, pa.schema([("f", pa.string()), ("n", pa.int64()), ("a", pa.int64())]))

    totals = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, pos = int(totals[0]), int(totals[1])
    if not pos or pos == n:
        return ToxicityModel({}, -4.0 if not pos else 4.0)
    tally = sample.mapInArrow(counted, "f string, n long, a long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    expected = F.col("n") * (pos / n)
    excess = (F.col("a") - expected) / F.sqrt(expected * (1 - pos / n) + 0.5)
    kept = tally.filter(F.col("a") >= 3).withColumn("z", excess).filter("z > 5").orderBy(F.desc("z"), "f").limit(most_features).select("f").toPandas().f.tolist()
    vocabulary = {f: i for i, f in enumerate(sorted({*kept, *(f for rows in terms.values() for own in rows for t in own for f in word_features(t))}))}

    def encoded(batches):
        release()
        for b in sized(batches, 1):
            out = {"y": [], "row": [], "a": [], "b": []}
            for y, t in zip(b.column(0).to_pylist(), whole_texts(b)):
                found = [(sorted(vocabulary[f] for f in features(t) if f in vocabulary), None, None)]
                found += [(None, *(sorted(vocabulary[f] for f in features(s) if f in vocabulary) for s in p)) for p in swaps(t, terms)]
                for row, x, x2 in found:
                    out["y"].append(y)
                    out["row"].append(row)
                    out["a"].append(x)
                    out["b"].append(x2)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("y", pa.int32()), *((k, pa.list_(pa.int32())) for k in ("row", "a", "b"))]))

    got = sample.mapInArrow(encoded, "y int, row array<int>, a array<int>, b array<int>").toPandas()
    listed = lambda v: None if v is None else [int(c) for c in v]
    whole = sorted((listed(r), int(y)) for r, y in zip(got.row, got.y) if r is not None)
    pairs = sorted((listed(a), listed(b)) for a, b in zip(got.a, got.b) if a is not None)
    w, bias = fit_logistic([r for r, _ in whole], np.array([y for _, y in whole], float), pairs, len(vocabulary), even=even)
    return ToxicityModel({f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 1e-3}, bias, len(pairs))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """One row per document: ``doc_id, score, predicted``, with ``row`` (a struct of all columns) in place of ``doc_id`` if ``whole``.

    Null and empty texts get the score of a text without evidence; null ids stay null;
    repeated rows get a row each; very long texts are scored whole, alone in their batch; an
    empty table gives an empty one; other columns are not read, or stand within ``row``, whatever their names.
    """
    ship(docs.sparkSession)
    text = F.col(text_col).alias("text_")
    given = docs.select(F.struct("*").alias("row")) if whole else docs.select(F.col(id_col).alias("doc_id"), text)
    name, at = given.columns[0], docs.columns.index(text_col)

    def run(batches):
        release()
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [at]) if whole else batch.column(1)  # a whole row holds its text once
            for b in sized(iter([pa.RecordBatch.from_arrays([batch.column(0), texts], names=[name, "text_"])]), 1):
                score = [model.score(t) for t in whole_texts(b)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=[name, "score", "predicted"])
        model.forget()

    return given.mapInArrow(run, T.StructType([given.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out(id_col) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
