"""Byte-level BPE encoding and decoding through a sentencepiece model made from the ranks.

The vocabulary becomes a sentencepiece BPE model without any training: each token's bytes
are spelled in printable characters, its score is its negative rank, its place is its rank,
and the normaliser leaves text as it is. The library then merges the pair of lowest rank,
leftmost among equals, which is what ranks of byte pairs mean. Pre-tokens are encoded one by
one; decoding looks up the pieces of ids and maps their characters back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from itertools import islice

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import resident, ship, sized, whole_texts
from .token_count import SPLIT, byte_symbols

# Field numbers and enum values of the published sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE, UNKNOWN = 1, 2, 3, 2
MODEL_TYPE, BPE = 3, 2
NORMALIZER_NAME, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS = 1, 3, 4, 5

# Letters and numbers that the installed ``regex`` knows and the Unicode version of the tiktoken library's splitter does not; there they are other characters.
NEWER = regex.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
OTHER = "\ue000"

CACHED = 300_000  # pre-tokens whose ids a worker keeps, of 20 characters on average
LONG = 1 << 18  # characters beyond which a text is split part by part; pre-tokens of a part


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece of each id is the token of that rank; the unknown piece comes last."""
    symbols = byte_symbols()
    spelled = ["".join([symbols[b] for b in t]) for t in tokens]
    if len(set(spelled)) < len(spelled) or "" in spelled:
        raise ValueError("tokens have to be distinct and not empty")
    if missing := {*symbols} - {*spelled}:
        raise ValueError(f"{len(missing)} single bytes have no token")
    out = [_block(PIECES, _block(PIECE_TEXT, s.encode()) + _varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", -rank)) for rank, s in enumerate(spelled)]
    out.append(_block(PIECES, _block(PIECE_TEXT, b"<unk>") + _number(PIECE_TYPE, UNKNOWN)))
    out.append(_block(TRAINER, _number(MODEL_TYPE, BPE)))
    out.append(_block(NORMALIZER, _block(NORMALIZER_NAME, b"identity") + _number(DUMMY_PREFIX, 0) + _number(EXTRA_BLANKS, 0) + _number(ESCAPE_BLANKS, 0)))
    return b"".join(out)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from lines of a base64 token and its rank; ranks have to be gapless from 0."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks have gaps or repeats")
    return [t for _, t in ranked]


class ByteCodec:
    """Encodes texts as a byte-level BPE vocabulary of ranks does, and decodes ids to bytes."""

    def __init__(self, path: str, pattern: str = SPLIT):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(tokens))
        symbols = byte_symbols()
        self.spell = {b: ord(s) for b, s in enumerate(symbols)}  # bytes read as latin-1 to their characters
        back = {ord(s): b for b, s in enumerate(symbols)}
        self.bytes_of = [self.model.id_to_piece(i).translate(back).encode("latin-1") for i in range(len(tokens))]
        # A pre-token that is a token as a whole is that token, whether merging arrives there or not.
        pieces = self.spelled(tokens)
        self.unmerged = {p: array("I", [i]).tobytes() for i, (p, ids) in enumerate(zip(pieces, self.model.encode(pieces, num_threads=1))) if ids != [i]}
        self.split = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}
        self.chars = 0

    def spelled(self, raw: list[bytes]) -> list[str]:
        return [r.decode("latin-1").translate(self.spell) for r in raw]

    def learn(self, pre_tokens: set[str]) -> None:
        """Keep the ids of pre-tokens, little-endian unsigned 32-bit integers, all encoded in one call."""
        new = [p for p in pre_tokens if p not in self.kept]
        self.chars += sum(map(len, new))
        if len(self.kept) + len(new) > CACHED or self.chars > 20 * CACHED:
            self.kept.clear()
            new = [*pre_tokens]
            self.chars = sum(map(len, new))
        if new:
            pieces = self.spelled([p.encode("utf-8", "surrogatepass") for p in new])
            ids = [array("I", x).tobytes() for x in self.model.encode(pieces, num_threads=1)]
            self.kept.update(zip(new, [self.unmerged.get(p, i) for p, i in zip(pieces, ids)] if self.unmerged else ids))

    def encode(self, texts: list[str]):
        """For each text its place and ids, as bytes of little-endian unsigned 32-bit integers; those of a very long text come in several parts, and an empty text has none."""
        short = [self.split.findall(t) if len(t) <= LONG and (t.isascii() or not NEWER.search(t)) else None for t in texts]
        self.learn(set().union(*filter(None, short)))
        for at, pre_tokens in enumerate(short):
            if pre_tokens:
                kept = self.kept
                yield at, b"".join([kept[p] for p in pre_tokens])
        for at, text in enumerate(texts):
            if short[at] is not None:
                continue
            found = (text[m.start() : m.end()] for m in self.split.finditer(NEWER.sub(OTHER, text)))
            while part := list(islice(found, LONG)):
                self.learn(set(part))
                yield at, b"".join([self.kept[p] for p in part])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        table = self.bytes_of
        return b"".join([table[i] for i in array("I", ids)])


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, id_col: str, text_col: str, columns: dict[str, tuple], many) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches):
        codec = resident(ByteCodec, vocabulary, pattern)
        for b in sized(batches, 1):
            arrays = [pa.array(v, kind) for v, (_, kind) in zip(many(codec, whole_texts(b)), columns.values())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", *columns])

    ddl = ", ".join(f"{name} {spark_type}" for name, (spark_type, _) in columns.items())
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {ddl}")


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids array<int>, decoded binary``.

    ``vocabulary`` is the path of a file of ranks that every executor can open; each match of
    ``pattern`` is encoded separately, special strings are ordinary text. A map without a
    shuffle. Null and empty texts give no ids and no bytes; null ids stay null; repeated rows
    each get a row; an empty table gives an empty one; other columns are not read. A very long
    text is split into pre-tokens part by part; only its ids and bytes are held whole.
    """

    def many(codec: ByteCodec, texts: list[str]):
        ids = [b""] * len(texts)
        for at, part in codec.encode(texts):
            ids[at] += part
        return [array("i", x) for x in ids], [codec.decode(x) for x in ids]

    return _mapped(docs, vocabulary, pattern, id_col, text_col, {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary())}, many)


def encode_digest(docs: DataFrame, vocabulary: str, pattern: str = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, with ids and decoded bytes as counts and SHA-256, which are made part by part: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""

    def many(codec: ByteCodec, texts: list[str]):
        n, ids, decoded = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for at, part in codec.encode(texts):
            n[at] += len(part) // 4
            ids[at].update(part)
            decoded[at].update(codec.decode(part))
        return n, [h.hexdigest() for h in ids], [h.hexdigest() for h in decoded]

    return _mapped(docs, vocabulary, pattern, id_col, text_col, {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}, many)
