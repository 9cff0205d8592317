"""Quality rules: document statistics and gradient-boosted trees over them.

The trees are fitted on a bounded sample of labelled rows, kept to the stated directions
on chosen features, and flattened into numpy node arrays that score a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, by_batch, ship, whole_texts
from .substring import BLANKS, Windows, word_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
ASCII_BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features, and the direction in which each may move the verdict (0: either).
FEATURES = {"log_words": 0, "mean_word": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "upper": 0, "digits": 0, "marks": 0, "bars": -1, "mean_line": 0, "distinct": 0, "short_lines": 0}


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The counts named in ``COUNTS`` and the features named in ``FEATURES`` of one text."""
    data = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(data, np.uint8)
    histogram = np.bincount(a, minlength=256)
    words = word_hashes(data)[0]
    n = len(words)
    word_chars = len(text) - int(histogram[BLANKS].sum())
    n_symbols = int(histogram[SYMBOLS].sum())
    lines = [x for x in text.split("\n") if x.strip(ASCII_BLANKS)]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        windows = Windows(words).hashes(np.arange(n - 2), 3)
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= again
        repeat = int(cover.sum())
    size = max(1, len(text))
    upper, digits = int(histogram[65:91].sum()), int(histogram[48:58].sum())
    marks = int(histogram[33:48].sum() + histogram[58:65].sum() + histogram[91:97].sum() + histogram[123:127].sum())
    short = sum(len(x) < 40 for x in lines)
    features = [np.log1p(n), word_chars / max(1, n), n_symbols / size, dup / max(1, len(lines)), repeat / max(1, n), upper / size, digits / size, marks / size, histogram[124] / size, len(text) / max(1, len(lines)), len(np.unique(words)) / max(1, n), short / max(1, len(lines))]
    return [n, word_chars, n_symbols, dup, repeat], [float(x) for x in features]


@dataclass
class Trees:
    """Boosted trees as node arrays; a leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Gradient boosting for the logistic loss on binned features.

    A split on a feature with a direction is taken only if its sides' values follow it, and
    both sides are then held to their side of the middle, so the whole model is monotone.
    """
    if not len(y):
        none = np.zeros(0, np.int64)
        return Trees(0.0, none, none, np.zeros(0), none, none, np.zeros(0), 0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add(value):
        i = len(nodes["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", value)):
            nodes[k].append(v)
        return i

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = add(0.0)
        roots.append(root)
        todo = [(root, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            nodes["value"][node] = rate * float(np.clip(-gs / (hs + ridge), low, high))
            best = (1e-6, None)
            for j, c in (enumerate(cuts) if level < depth else ()):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(code[j, rows], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(code[j, rows], h[rows], len(c) + 1))[:-1]
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hs - hl < least) | (directions[j] * (vr - vl) < 0)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, float(vl[k] + vr[k]) / 2))
            if best[1] is None:
                margin[rows] += nodes["value"][node]
                continue
            j, k, middle = best[1]
            nodes["feature"][node], nodes["threshold"][node] = j, float(cuts[j][k])
            nodes["left"][node], nodes["right"][node] = add(0.0), add(0.0)
            go = code[j, rows] <= k
            d = directions[j]
            bounds = ((low, middle), (middle, high)) if d > 0 else ((middle, high), (low, middle)) if d < 0 else ((low, high), (low, high))
            todo += [(nodes["left"][node], rows[go], *bounds[0], level + 1), (nodes["right"][node], rows[~go], *bounds[1], level + 1)]
    a = {k: np.array(v, np.float64 if k in ("threshold", "value") else np.int64) for k, v in nodes.items()}
    return Trees(base, np.array(roots, np.int64), a["feature"], a["threshold"], a["left"], a["right"], a["value"], depth)


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Trees from at most about ``bound`` labelled rows, chosen by a hash of the id; rows without label or id are left out."""
    ship(docs.sparkSession)
    own = labels.groupBy(F.col(id_col).alias("id_")).agg(F.min(label_col).cast("double").alias("y")).filter("y is not null and id_ is not null")
    chosen = bounded_rows(own, "id_", bound)

    def batch(b: pa.RecordBatch) -> dict:
        return {"y": b.column(0), "x": [statistics(t)[1] for t in whole_texts(b)]}

    schema = pa.schema([("y", pa.float64()), ("x", pa.list_(pa.float64()))])
    texts = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    sample = texts.join(F.broadcast(chosen), "id_").select("y", "text_").mapInArrow(by_batch(batch, schema), "y double, x array<double>").toPandas()
    x = np.array(sample.x.tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, sample.y.to_numpy()))  # the same trees whatever the order of rows
    return fit_trees(x[order], sample.y.to_numpy(float)[order], list(FEATURES.values()))


def score_quality(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, the counts, ``base_failed``, ``score`` (0 to 1), ``kept``.

    Base rules: fewer than 50 words, or more than half of the words in repeated three-word
    windows. Null and empty texts have no words and fail; null ids stay null; repeated rows
    get a row each; very long texts are counted whole, their words hashed segment by segment;
    an empty table gives an empty one; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> dict:
        got = [statistics(t) for t in whole_texts(b)]
        counts = np.array([c for c, _ in got], np.int64)
        score = 1 / (1 + np.exp(-trees.margin(np.array([f for _, f in got]))))
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        return {"doc_id": b.column(0), **dict(zip(COUNTS, counts.T)), "base_failed": failed, "score": score, "kept": ~failed & (score >= 0.5)}

    def run(batches):
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field(0).type), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])
            yield from by_batch(batch, schema)(iter([b]))

    ddl = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"
    return docs.select(id_col, text_col).mapInArrow(run, ddl)
