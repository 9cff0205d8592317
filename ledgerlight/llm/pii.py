"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns name e-mail addresses, IP numbers, card numbers and phone numbers. The
field's nodes are the tokens of a document that look like such data; neighbouring nodes
share chain potentials and distant nodes with the same or similar text share skip
potentials, all fitted by piecewise pseudo-likelihood. Tokens inside base matches are observed. Loopy
message passing gives each other node a label; a token that is an entity in one place of a
document is then one in its other places too, and becomes an added span.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, ship, sized, whole_texts

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["other", *KINDS]
MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\s,;:!?\"<>]+")
SURE = 0.9


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base matches, by kind and start; code points, end exclusive."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in MAILBOX:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            found.append((0, start, tail.end()))
            free = tail.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return found


@dataclass
class Nodes:
    """Tokens of one document that may be entities."""

    start: list[int]
    end: list[int]
    shape: list[tuple]
    observed: list[int]  # the label inside a base match, else -1
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def nodes_of(text: str, base: list[tuple[int, int, int]]) -> Nodes:
    """Nodes are tokens with a digit or @; skip edges join each to the last one of the same folded text, of the same six or more digits, or of the same last eight."""
    n = Nodes([], [], [], [], [], [])
    last: dict[str, int] = {}
    spans = sorted((s, e, k + 1) for k, s, e in base)
    at, order, previous = 0, 0, -2
    if not spans and not DIGIT.search(text) and "@" not in text:
        return n
    for m in TOKEN.finditer(text):
        order += 1
        t = m[0].strip("().-'")
        digits = DIGIT.findall(t)
        if not t or not (digits or "@" in t):
            continue
        start = m.start() + m[0].index(t)
        end = start + len(t)
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        inside = at < len(spans) and spans[at][0] < end
        i = len(n.start)
        n.start.append(start)
        n.end.append(end)
        n.observed.append(spans[at][2] if inside else -1)
        n.shape.append((min(len(digits), 16), "@" in t, min(t.count("."), 3), m[0][0] == "+", min(t.count("-"), 3), "(" in m[0], t.isdigit()))
        if order == previous + 1:
            n.chain.append((i - 1, i))
        previous = order
        number = "".join(digits)
        for key in (t.casefold(), "#" + number if len(number) >= 6 else "", "~" + number[-8:] if len(number) >= 8 else ""):
            if key:
                if key in last and (last[key], i) not in n.skip[-3:] and last[key] != i:
                    n.skip.append((last[key], i))
                last[key] = i
    return n


@dataclass
class SkipChain:
    """Potentials in logs: by token shape, between neighbours, between distant alike tokens."""

    unary: dict[tuple, list[float]]
    unseen: list[float]
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, n: Nodes, rounds: int = 30) -> np.ndarray:
        """Label probabilities of all nodes by loopy sum-product passing along all edges at once."""
        own = np.array([self.unary.get(s, self.unseen) for s in n.shape])
        for i, o in enumerate(n.observed):
            if o >= 0:
                own[i] = -50.0
                own[i, o] = 0.0
        edges = np.array(n.chain + n.skip, np.int64).reshape(-1, 2)
        table = np.concatenate([np.repeat(self.chain[None], len(n.chain), 0), np.repeat(self.skip[None], len(n.skip), 0)])
        source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
        messages = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds):
            belief = own.copy()
            np.add.at(belief, target, messages)
            send = (belief[source] - messages[back])[:, :, None] + table
            top = send.max(1, keepdims=True)
            new = np.log(np.exp(send - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            new = 0.5 * new + 0.5 * messages
            settled = not len(new) or np.abs(new - messages).max() < 1e-4
            messages = new
            if settled:
                break
        belief = own.copy()
        np.add.at(belief, target, messages)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        n = nodes_of(text, base)
        if not any(o < 0 for o in n.observed):
            return []  # nothing open
        p = self.marginals(n)
        label, sure = p[:, 1:].argmax(1), p[:, 1:].max(1) >= SURE
        found: list[tuple[int, int, int]] = []
        linked, before = set(n.chain), -2
        for i in range(len(n.start)):
            if n.observed[i] >= 0 or not sure[i]:
                continue
            kind = int(label[i])
            # Parts of one entity, as the groups of a number.
            if before == i - 1 and (before, i) in linked and found[-1][0] == kind and not text[found[-1][2] : n.start[i]].strip(" ()+-./"):
                found[-1] = (kind, found[-1][1], n.end[i])
            else:
                found.append((kind, n.start[i], n.end[i]))
            before = i
        return found


def contexts(n: Nodes) -> list[tuple[tuple, int, tuple, tuple, tuple]]:
    """Shape and label of each node with the labels counted left, right and at skip edges.

    Nodes alike to one inside a base match, but outside, have no known label: they are left
    out, and not counted as neighbours.
    """
    known = [max(o, 0) for o in n.observed]
    for i, j in n.skip:
        for x, y in ((i, j), (j, i)):
            if n.observed[x] < 0 < n.observed[y]:
                known[x] = -1
    around = np.zeros((len(known), 3, len(LABELS)), int)
    for edges, back, forth in ((n.chain, 0, 1), (n.skip, 2, 2)):
        for i, j in edges:
            if known[i] >= 0:
                around[j, back, known[i]] += 1
            if known[j] >= 0:
                around[i, forth, known[j]] += 1
    return [(n.shape[i], y, *(tuple(a) for a in around[i].tolist())) for i, y in enumerate(known) if y >= 0]


def fit_potentials(rows: list[tuple], times: np.ndarray, ridge: float = 0.02, steps: int = 400) -> SkipChain:
    """Potentials that maximise the piecewise pseudo-likelihood of ``contexts`` under a normal prior, by accelerated gradient steps.

    Each kind of potential is fitted to the labels given its own neighbours alone, so that
    shapes, which nearly decide the labels of base matches, leave the others something to
    say. The prior's mean says that tokens are no entities and that alike tokens have one label.
    """
    size = len(LABELS)
    shapes = {s: i for i, s in enumerate(sorted({r[0] for r in rows}))}
    unseen = np.log(np.array([0.96, *[0.01] * (size - 1)]))
    own, chain, skip = np.zeros((len(shapes), size)), np.zeros((size, size)), np.zeros((size, size))
    for (shape, y, left, right, alike), n in zip(rows, times):
        own[shapes[shape], y] += n
        chain[:, y] += n * np.array(left)
        skip[:, y] += n * np.array(alike)

    def fitted(counts: np.ndarray, mean: np.ndarray, both: bool) -> np.ndarray:
        """A table of potentials for counts of (given, label) pairs; ``both``: either of the two may be the given one."""
        theta, first, second = mean.copy(), np.zeros_like(mean), np.zeros_like(mean)
        for step in range(1, steps + 1):
            grad = ridge * (theta - mean)
            for flip in (False, True) if both else (False,):
                n, t = (counts.T, theta.T) if flip else (counts, theta)
                p = np.exp(t - t.max(1, keepdims=True))
                g = n.sum(1, keepdims=True) * p / p.sum(1, keepdims=True) - n
                grad = grad + (g.T if flip else g)
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return theta

    unary = fitted(own, np.tile(unseen, (len(shapes), 1)), False)
    alike = fitted((skip + skip.T) / 2, 2 * np.eye(size), True)
    return SkipChain({s: unary[i].tolist() for s, i in shapes.items()}, unseen.tolist(), fitted(chain, np.zeros((size, size)), True), alike)


def fit_skip_chain(docs: DataFrame, bound: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> SkipChain:
    """Potentials from the base matches of about ``bound`` documents, chosen by a hash of the text.

    Contexts of nodes are counted in Spark; only the counts of distinct ones reach the
    driver. Null and empty texts have no nodes; without any node (an empty table too) the
    potentials are those of the prior. Other columns are not read.
    """
    ship(docs.sparkSession)
    sample = bounded_rows(docs.select(id_col, text_col), text_col, bound)

    def counted(batches):
        for b in sized(batches, 1):
            c: Counter = Counter()
            for t in whole_texts(b):
                c.update(map(repr, contexts(nodes_of(t, base_spans(t)))))
            yield pa.RecordBatch.from_pydict({"c": list(c), "n": list(c.values())}, pa.schema([("c", pa.string()), ("n", pa.int64())]))

    tally = sample.mapInArrow(counted, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas().sort_values("c")
    return fit_potentials([ast.literal_eval(c) for c in tally.c], tally.n.to_numpy(float))


def find_pii(docs: DataFrame, model: SkipChain, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or the columns ``keep``) and ``spans array<struct<kind, start, end, base>>`` for every row.

    Spans are ordered by kind as in ``KINDS`` and start, in code points with the end
    exclusive; ``base`` tells a pattern's match from a span that the field added. Null and
    empty texts have none; null ids stay null; repeated rows get a row each; very long texts
    are searched whole; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    columns = keep or [id_col]
    names = keep or ["doc_id"]
    kinds = ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, columns))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches):
        for b in sized(batches, 0):
            spans = []
            for t in whole_texts(b, 0):
                base = base_spans(t)
                added = model.added_spans(t, base)
                spans.append([{"kind": KINDS[k], "start": s, "end": e, "base": o} for k, s, e, o in sorted([(*x, True) for x in base] + [(*x, False) for x in added])])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(spans, pa.list_(span))], names=[*names, "spans"])

    return docs.select(F.col(text_col).alias("text_"), *columns).mapInArrow(run, f"{kinds}, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>")


def spelled(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame, model: SkipChain, text_col: str = "text") -> DataFrame:
    """The table with each span's text replaced by its kind in brackets; overlapping spans become one, named by the first."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
        parts, end = [], 0
        for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= end:
                parts += [text[end:s], f"[{KINDS[k].upper()}]"]
            end = max(end, e)
        return "".join(parts) + text[end:]

    def run(batches):
        for b in sized(batches, at):
            out = b.column(at).to_pylist()
            for i, t in enumerate(out):
                if t:
                    base = base_spans(t)
                    out[i] = mask(t, base + model.added_spans(t, base))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
