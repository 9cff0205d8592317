"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents of its partition as they come, so nothing is shuffled. Its
state is the level array (how many partially filled windows stand at each fill level) and
the pieces of those windows. A document goes to the fill level that makes the sum of the
squared counts smallest. Open windows hold at most a stated number of tokens: beyond it the
fullest are filled up with what the emptiest hold, cutting documents, until half of it is
left. When the partition ends, the windows still open are poured together, cutting documents
at window ends; the rest of that is cut into windows of a power of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Memo, resident, ship, sized, whole_texts
from .token_count import byte_symbols

SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")  # blanks for Python, not for the library
LATIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")


class WordTokenizer:
    """Ids of a tokenizer that drops white space, word by word with a cache, as little-endian uint32 bytes."""

    def __init__(self, path: str, cached: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.mapped = byte_symbols()
        self.words = Memo(self.word, cached)

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: str) -> bytes:
        if LATIN.issuperset(w):
            symbols = "".join([self.mapped[b] for b in w.lower().encode()])
            return np.array([t.id for t in self.model.tokenize(symbols)], "<u4").tobytes()
        if w[-1] in ",.;:" and LATIN.issuperset(w[:-1]) and len(w) > 1:
            return self.words[w[:-1]] + self.words[w[-1]]
        return self.encode(w)

    def ids(self, text: str) -> bytes:
        if any(c in text for c in SEPARATORS):
            return self.encode(text)
        words = self.words
        return b"".join([words[w] for w in text.split()])


class SumOfSquares:
    """Online packing of pieces into windows; a piece is ``(doc, start, length, ids)``."""

    def __init__(self, capacity: int, quantum: int, most_held: int = 1 << 20):
        self.capacity, self.quantum, self.levels, self.most_held = capacity, quantum, capacity // quantum, most_held
        self.count = np.zeros(self.levels + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(self.levels + 1)]
        self.held = 0  # tokens in open windows

    def _opened(self, level: int) -> list:
        """One window of a level, taken out."""
        window = self.open[level].pop()
        self.count[level] -= 1
        self.held -= sum(p[2] for p in window)
        return window

    def _put(self, window: list) -> None:
        level = sum(-(-p[2] // self.quantum) for p in window)
        self.open[level].append(window)
        self.count[level] += 1
        self.held += sum(p[2] for p in window)

    def relieved(self):
        """If too much is held, full windows until half of the bound is left: the fullest, filled up from the emptiest."""
        while self.held > self.most_held // 2:
            window = self._opened(int(np.flatnonzero(self.count)[-1]))
            room = self.capacity - sum(p[2] for p in window)
            while room:
                giver = self._opened(int(np.flatnonzero(self.count)[0]))
                while room and giver:
                    doc, start, length, ids = giver.pop()
                    n = min(room, length)
                    window.append((doc, start, n, ids[: 4 * n]))
                    room -= n
                    if n < length:
                        giver.append((doc, start + n, length - n, ids[4 * n :]))
                if giver:
                    self._put(giver)
            yield window

    def place(self, piece: tuple) -> list | None:
        """Put one piece into a window; the window's pieces, if that filled it."""
        units = -(-piece[2] // self.quantum)
        top, count = self.levels, self.count
        start, best = 0, (2 * count[units] + 1 if units < top else 0)
        if units < top:
            old, new = count[1 : top - units + 1], count[units + 1 : top + 1]
            change = 2 * (new - old) + 2
            change[-1] = 1 - 2 * old[-1]  # a full window stands at no level
            change[old == 0] = 1 << 40
            h = len(change) - 1 - int(np.argmin(change[::-1]))  # the fullest among equals
            if change[h] <= best:
                start = h + 1
        window = self._opened(start) if start else []
        window.append(piece)
        if start + units == top:
            return window
        self._put(window)
        return None

    def pour(self):
        """The windows of what is still open: full ones, then powers of two."""
        todo = [p for level in reversed(self.open) for window in level for p in window]
        left = sum(p[2] for p in todo)
        window: list = []
        room = size = self.next_size(left)
        for doc, start, length, ids in todo:
            at = 0
            while at < length:
                n = min(room, length - at)
                window.append((doc, start + at, n, ids[4 * at : 4 * (at + n)]))
                at, room, left = at + n, room - n, left - n
                if not room:
                    yield window
                    window = []
                    room = size = self.next_size(left)
        assert not window and not left, size

    def next_size(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1) if left else 0


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, quantum: int = 8, most_held: int = 1 << 20, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", cached: int = 500_000) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and ``ids`` if asked for.

    A document is its ids by the tokenizer file ``vocabulary`` (without added tokens) and
    ``end_id``. ``capacity`` must be a multiple of ``quantum``, the step of the fill levels;
    a window counts as full when less than a step per piece is left; open windows of a task
    hold at most ``most_held`` tokens and one document's; a worker keeps the ids of ``cached`` words. ``sequence_id`` holds
    the partition in its upper bits. Null and empty texts are documents of ``end_id`` alone;
    null ids stay null; repeated rows are packed each; an empty table gives an empty one;
    other columns are not read. Documents above the capacity fill whole windows first.
    """
    if most_held < 2 * capacity:
        raise ValueError("most_held must be two windows at least")
    if capacity % quantum or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two and a multiple of quantum")
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        tok, packer = resident(WordTokenizer, vocabulary, cached), SumOfSquares(capacity, quantum, most_held)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        schema = None

        def close(window):
            nonlocal sequence
            offset = 0
            for (doc, total), start, length, ids in window:
                rows.append((doc, start, length, zlib.crc32(ids), total, sequence, offset, *([np.frombuffer(ids, "<u4").astype("i4")] if with_ids else [])))
                offset += length
            sequence += 1

        def flushed():
            columns = list(zip(*rows)) if rows else [[] for _ in schema]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in sized(batches, 1):
            fields = [("doc_id", b.schema.field(0).type), *((n, pa.int64()) for n in names[1:])]
            schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
            for doc, text in zip(b.column(0).to_pylist(), whole_texts(b)):
                ids = tok.ids(text) + end
                total = len(ids) // 4
                for at in range(0, total - total % capacity, capacity):
                    close([((doc, total), at, capacity, ids[4 * at : 4 * (at + capacity)])])
                if rest := total % capacity:
                    full = packer.place(((doc, total), total - rest, rest, ids[4 * (total - rest) :]))
                    if full:
                        close(full)
                    if packer.held > most_held:
                        for full in packer.relieved():
                            close(full)
                if len(rows) >= (2_000 if with_ids else 20_000):
                    yield flushed()
        for window in packer.pour():
            close(window)
            if len(rows) >= 2_000:
                yield flushed()
        if rows:
            yield flushed()

    ddl = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, text_col).mapInArrow(run, ddl)
