import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shoal.llm import bpe, tokenfile
from shoal.llm.bpe import encode_documents, round_trip
from shoal.llm.tokenfile import PerfectHash, PieceEncoder, ShardReader, read_shards, write_shards

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(4)
    pool = list("aeiouthsn  \n\t'.,!0129ÉéßñÑΣσİıﬁ²½中文字😀 \u0085​́　\x1c\x1f<|>") + ["'s", "'ll", "'RE", "<|endoftext|>", "<|startoftext|>", "   ", "\r\n"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 120))) for _ in range(400)] + ["", " ", "aaaa" * 500, "\x00\x7f"]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def test_bpe_is_the_library_s(libraries):
    t = bpe.Tokenizer(open(BYTE, encoding="utf-8").read())
    for text in odd_texts():
        ids = libraries[0].encode(text, add_special_tokens=False).ids
        assert t.encode(text) == ids, repr(text)
        assert t.decode(ids) == libraries[0].decode(ids, skip_special_tokens=False) == text


def test_forgetting_changes_nothing(libraries, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(tokenfile, "REMEMBERED", 3)
    text = "one two three four five six one two seven"
    assert bpe.Tokenizer(open(BYTE, encoding="utf-8").read()).encode(text) == libraries[0].encode(text, add_special_tokens=False).ids
    e = PieceEncoder(open(WORD, encoding="utf-8").read())
    assert e.encode([text, text]) == [np.array(libraries[1].encode(text, add_special_tokens=False).ids, "<u2").tobytes()] * 2


def test_pieces_are_the_library_s(libraries):
    texts = odd_texts()
    got = PieceEncoder(open(WORD, encoding="utf-8").read()).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u2").tolist() == libraries[1].encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(libraries, awkward, clashing, empty):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in awkward.collect():
        ids = libraries[0].encode(r["text"] or "", add_special_tokens=False).ids
        want.append((len(ids), sha(",".join(map(str, ids))), sha(r["text"] or "")))
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in round_trip(awkward, BYTE).collect()) == sorted(want)
    e = encode_documents(clashing, BYTE)
    assert e.select("_row.*").columns == clashing.columns and e.where("exact").count() == awkward.count()
    assert sorted(len(r["ids"]) for r in e.collect()) == sorted(n for n, *_ in want)
    assert round_trip(empty, BYTE).count() == 0 == encode_documents(empty, BYTE).count()


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    keys = np.random.default_rng(1).choice(10**12, n, replace=False).astype(np.int64) - 10**6
    h = PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == [*range(n)]


def test_token_files(spark, libraries, documents):
    rows = [(i * 7 - 3, f"text {i} " * (i % 9)) for i in range(200)]
    shards = write_shards(documents(*rows), WORD, shards=5)
    got = [tuple(r) for r in read_shards(shards).orderBy("doc_id").collect()]
    want, at = [], 0
    for i, t in rows:
        ids = [*libraries[1].encode(t, add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    known, found = dict(rows), 0
    for s in shards.collect():
        reader = ShardReader(s["uri"])
        for key in reader.keys.tolist():
            assert reader.get(key).tolist() == [*libraries[1].encode(known[key], add_special_tokens=False).ids, 1]
            found += 1
        assert reader.get(10**9) is None
    assert found == 200


def test_awkward_rows(awkward, clashing, empty):
    rows = read_shards(write_shards(awkward, WORD, shards=3)).collect()
    assert len(rows) == awkward.count()
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    ids = [r["doc_id"] for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert read_shards(write_shards(clashing, WORD)).count() == awkward.count()
    assert read_shards(write_shards(empty, WORD)).count() == 0
