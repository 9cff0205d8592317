"""Byte-level codec against the tiktoken library and on awkward rows."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from ledgerlight.llm import byte_codec

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "word ünd 日本 and\n " * 60_000
TEXTS = [None, "", " ", "  a  b \r\n", "Hello, world! don't <|endoftext|> <unk> ▁stop", "Ünïcode 日本語 🙂🙂", "a b c " * 40, "a b c " * 40, "x" * 20_000, LONG, "old ՘ new ቆf\U0001246f1"]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_and_awkward_rows(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2, "y"), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    plain, digest = byte_codec.encode_decode(docs, PATH).collect(), byte_codec.encode_digest(docs, PATH).collect()
    assert len(plain) == len(digest) == len(rows)
    by_id = {r.doc_id: r for r in digest}
    for r in plain:
        text = ("no id" if r.doc_id is None else TEXTS[r.doc_id]) or ""
        assert r.ids == library.encode_ordinary(text) and r.decoded == text.encode()
        d = by_id[r.doc_id]
        assert (d.n_tokens, d.decoded_sha256) == (len(r.ids), hashlib.sha256(text.encode()).hexdigest())
        assert d.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert byte_codec.encode_digest(docs.filter("doc_id < 0"), PATH).collect() == []


def test_random_texts(library, monkeypatch):
    monkeypatch.setattr(byte_codec, "CACHED", 500)  # the cache is emptied again and again
    monkeypatch.setattr(byte_codec, "LONG", 30)  # most texts go part by part
    codec, rng = byte_codec.ByteCodec(PATH), random.Random(5)
    odd = "aB1é日🙂́‍ \t\n\r\x1c\x85'sT▁_-<|> ٠ǅ﻿\x00  ՘\U0001246f"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(20)) for _ in range(2000)]
    ids = [b""] * len(texts)
    for at, part in codec.encode(texts):
        ids[at] += part
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in ids] == [t.encode() for t in texts]


def test_every_token_merges_to_itself_and_files_are_checked():
    codec = byte_codec.ByteCodec(PATH)
    assert codec.bytes_of == byte_codec.read_ranks(PATH) and not codec.unmerged
    with pytest.raises(ValueError):
        byte_codec.model_bytes([b"a", b"a"])
    with pytest.raises(ValueError):
        byte_codec.model_bytes([bytes([b]) for b in range(255)])


def test_a_token_without_a_merge_path(tmp_path):
    import tiktoken

    tokens = [bytes([b]) for b in range(256)] + [b"xyz"]  # no pair leads to it
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = byte_codec.ByteCodec(str(path))
    for text in ("xyz", "xyz xyz1", "wxyz"):
        assert np.frombuffer(b"".join(p for _, p in codec.encode([text])), "<u4").tolist() == library.encode_ordinary(text)
