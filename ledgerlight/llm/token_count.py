"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is the number of its initial byte symbols minus the number of merges;
identifiers are never made. Counts follow the ``tokenizers`` library for byte-level BPE
files (regex split, no prefix space), including added tokens that stand inside a text.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_batch, Memo, resident, ship, whole_texts

# Fixed value: the split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

GONE = 1 << 19  # stands where a symbol was merged into the one before it; no vocabulary has this id
UNSPLIT = -(1 << 60)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class ByteBpeCounter:
    """Counts tokens of texts as a byte-level BPE vocabulary gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.byte_id = [vocab[s] for s in byte_symbols()]
        self.rank: dict[int, int] = {}
        self.result: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.result.append(vocab[a + b])
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(SPLIT)
        self.pieces = Memo(self.merged_length)
        self.words = Memo(self.word_count, 700_000)

    def merged_length(self, piece: str) -> int:
        """Symbols left of one pre-token after all merges, lowest rank first, leftmost among equals."""
        ids = [self.byte_id[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(ids)
        rank, result = self.rank, self.result
        heap = []
        for i in range(n - 1):
            r = rank.get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                heap.append(r * n + i)  # one integer: rank, then place
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if j >= n or rank.get(ids[i] << 20 | ids[j]) != r:
                continue  # one of the two has been merged away meanwhile
            new = ids[i] = result[r]
            ids[j] = GONE
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (r := rank.get(new << 20 | ids[k])) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank.get(ids[h] << 20 | new)) is not None:
                heappush(heap, r * n + h)
        return left

    def regex_count(self, text: str) -> int:
        pieces = self.pieces
        return sum([pieces[p] for p in self.split.findall(text)])

    def word_count(self, word: str) -> int:
        """Count of a word with the blank before it; UNSPLIT if words next to it can change it."""
        body = word[1:]
        if body.isalpha():
            return self.merged_length(word)
        if not body or body[0].isspace() or body[-1].isspace():
            return UNSPLIT
        if body[-1] in ",.;:" and body[:-1].isalpha():
            return self.words[word[:-1]] + self.pieces[body[-1]]
        return self.regex_count(word)

    def plain_count(self, text: str) -> int:
        """Count of a text that holds no added token.

        Single blanks between other characters start a new pre-token each, so such a text
        is the sum of its words; any other text goes through the regex whole.
        """
        first, blank, rest = text.partition(" ")
        if not blank or not first or first[-1].isspace():
            return self.regex_count(text)
        words = self.words
        n = sum([words[w] for w in (" " + rest.replace(" ", "\0 ")).split("\0")]) if "\0" not in text else UNSPLIT
        return self.regex_count(first) + n if n >= 0 else self.regex_count(text)

    def count(self, text: str) -> int:
        if self.added is None or "<" not in text or not self.added.search(text):
            return self.plain_count(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.plain_count, parts))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``vocabulary`` is the path of a byte-level BPE file that every executor can open;
    ``over_limit`` tells whether a document has more than ``limit`` tokens. A map without
    a shuffle; null and empty texts have 0 bytes and tokens, a null id stays null, repeated
    rows each get a row, very long texts are counted whole, an empty table gives an empty one; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> dict:
        c, texts = resident(ByteBpeCounter, vocabulary), whole_texts(b)
        n = [c.count(t) for t in texts]
        return {"doc_id": b.column(0), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    fields = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]

    def run(batches):
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field(0).type), *fields])
            yield from by_batch(batch, schema)(iter([b]))

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
