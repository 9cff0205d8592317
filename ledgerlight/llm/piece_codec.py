"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

Every prefix of a word has exactly one last token in its BPE encoding. An automaton over
the vocabulary yields the pieces that end at each position; the one that is compatible
with the last token of the prefix before it goes into the table, and the ids are recovered
backwards from the table. Two adjacent tokens are compatible when merging their joined
text gives back exactly those two. Characters outside the vocabulary become byte tokens.
"""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, Memo, resident, ship, whole_texts

BLANK = "▁"  # fixed value: stands for a blank in pieces
NORMAL, USER, BYTE = 1, 4, 6  # fixed values: kinds of pieces in model files
SHIFT, OTHER = 24, (1 << 24) - 1
LONG = 64  # characters of the longest word whose result is kept


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does for a BPE model with byte fallback.

    Made for models with the identity normaliser, a dummy blank before the text and no
    piece in which a blank follows another character; other models are refused.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        inner = any(BLANK in x.piece.lstrip(BLANK) for x in model.pieces if x.type == NORMAL)
        if train.model_type != 2 or not train.byte_fallback or norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or inner or any(x.type == USER for x in model.pieces):
            raise ValueError("this codec takes BPE models with byte fallback, identity normaliser and dummy prefix")
        self.ids = {x.piece: i for i, x in enumerate(model.pieces) if x.type == NORMAL}
        self.score = {x.piece: x.score for x in model.pieces if x.type == NORMAL}
        self.byte_ids = {int(x.piece[3:5], 16): i for i, x in enumerate(model.pieces) if x.type == BYTE}
        self.texts = {i: p.replace(BLANK, " ") for p, i in self.ids.items()}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.pieces = [x.piece for x in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Keys: the last token before (OTHER: a character outside the vocabulary or none) and the next one.
        self.fits = Memo(self.compatible, 600_000)
        self.words = Memo(self.word_entry, 600_000)

    def compatible(self, key: int) -> bool:
        before, p = key >> SHIFT, self.pieces[key & ((1 << SHIFT) - 1)]
        if before == OTHER:
            return self.merged(p) == [p]
        b = self.pieces[before]
        return self.merged(b + p) == [b, p]

    def merged(self, text: str) -> list[str]:
        """The merges themselves: best score first, leftmost among equals."""
        parts: list[str | None] = list(text)
        n, score = len(parts), self.score
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in score]
        if not heap:
            return parts
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, p = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != len(p) or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := p + parts[k]) in score:
                    heappush(heap, (-score[q], i, q))
            if (h := before[i]) >= 0 and (q := parts[h] + p) in score:
                heappush(heap, (-score[q], h, q))
        return [p for p in parts if p is not None]

    def prefix_tokens(self, word: str) -> list[int | str]:
        """Tokens of a word: the last token of each prefix, then the way back.

        A token is an id, or the character itself where the vocabulary lacks it.
        """
        n, fits = len(word), self.fits
        last, length = [OTHER] * (n + 1), [1] * (n + 1)
        for end, (token, size) in self.automaton.iter(word):
            if last[end + 1] == OTHER and fits[last[end + 1 - size] << SHIFT | token]:
                last[end + 1], length[end + 1] = token, size
        out: list[int | str] = []
        while n:
            out.append(word[n - 1] if last[n] == OTHER else last[n])
            n -= length[n]
        return out[::-1]

    def token_ids(self, tokens: list[int | str]) -> list[int]:
        ids: list[int] = []
        for t in tokens:
            if isinstance(t, str) and t in self.ids:
                t = self.ids[t]
            ids.extend([t] if isinstance(t, int) else [self.byte_ids[b] for b in t.encode("utf-8", "surrogatepass")])
        return ids

    def word_ids(self, word: str) -> list[int]:
        """Ids of blanks followed by other characters, or of a run of blanks."""
        return self.token_ids(self.prefix_tokens(word))

    def word_entry(self, word: str) -> tuple[str, str]:
        """Ids and text of a word, by its parts where two characters meet that no piece has side by side."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
        if cuts:
            parts = [self.entry(word[i:j]) for i, j in zip([0, *cuts], [*cuts, len(word)])]
            return ",".join([ids for ids, _ in parts]), "".join([t for _, t in parts])
        ids = self.word_ids(word)
        return ",".join(map(str, ids)), self.decode_run(ids)

    def entry(self, word: str) -> tuple[str, str]:
        """As ``word_entry``; long words are not kept, so that the cache is bounded in bytes as well."""
        return self.words[word] if len(word) <= LONG else self.word_entry(word)

    @staticmethod
    def split_words(text: str) -> list[str]:
        """The text with its dummy blank, cut before each run of blanks; no piece crosses a cut."""
        words: list[str] = []
        blanks = ""
        for part in text.replace(BLANK, " ").split(" "):
            blanks += BLANK
            if part:
                words.append(blanks + part)
                blanks = ""
        if blanks:
            words.append(blanks)
        return words

    def encode(self, text: str) -> list[int]:
        return [i for w in self.split_words(text) for i in self.word_ids(w)] if text else []

    def decode_run(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.texts[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the dummy blank goes."""
        return self.decode_run(ids).removeprefix(" ")

    def round_trip(self, text: str) -> tuple[str, str]:
        """Ids as decimals joined by commas, and the text decoded from them, word by word."""
        if not text:
            return "", ""
        words = self.words
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            split = self.split_words(text)
        else:
            split = ("▁" + text.replace(" ", " ▁")).split(" ")
        entries = [words[w] if len(w) <= LONG else self.word_entry(w) for w in split]
        ids, parts = zip(*entries)
        return ",".join(ids), "".join(parts).removeprefix(" ")


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids array<int>, decoded string``.

    ``model`` is a path that every executor can open. Null and empty texts give no ids and
    an empty text; null ids stay null; repeated rows each get a row; an empty table gives an
    empty one; other columns are not read. Time and memory grow with the length of a text,
    whether it has blanks or not. A map without a shuffle.
    """
    ship(docs.sparkSession)

    def batch(b: pa.RecordBatch) -> dict:
        done = [resident(PieceCodec, model).round_trip(t) for t in whole_texts(b)]
        return {"doc_id": b.column(0), "ids": [[int(x) for x in i.split(",")] if i else [] for i, _ in done], "decoded": [d for _, d in done]}

    return _mapped(docs, id_col, text_col, batch, [("ids", pa.list_(pa.int32())), ("decoded", pa.string())], "ids array<int>, decoded string")


def encode_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with the ids and the decoded text as counts and SHA-256: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    ship(docs.sparkSession)

    def batch(b: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": b.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in whole_texts(b):
            ids, decoded = resident(PieceCodec, model).round_trip(t)
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
        return out

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _mapped(docs, id_col, text_col, batch, fields, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, id_col: str, text_col: str, batch, fields: list, ddl: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield from by_batch(batch, pa.schema([("doc_id", b.schema.field(0).type), *fields]))(iter([b]))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {ddl}")
