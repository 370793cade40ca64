import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shoal.llm import ppm


def brute(rows):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, *_), ws, h in zip(rows, words, held))


def got(df):
    return sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect())


@pytest.mark.parametrize("hot", [1 << 19, 2])
def test_base_counts(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT_WORDS", hot)
    rows = [(i, f"The {'cat' if i % 3 else 'dog'} sat\non mat{i % 5} x{i}") for i in range(60)] + [(100, None), (101, "")]
    df = ppm.score_documents(documents(*rows))
    assert got(df) == brute(rows)
    assert all(r["score"] < 0 and np.isfinite(r["score"]) for r in df.collect())


def test_awkward_rows(awkward, clashing, empty):
    key = lambda r: (r[0] is None, *r)
    from .conftest import AWKWARD

    def sort(x):
        return sorted(x, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))

    rows = [(i, t) for i, t, *_ in AWKWARD]
    collected = ppm.score_documents(awkward).collect()
    found = sort([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in collected])
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    want = sort([(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for (i, _), ws, h in zip(rows, words, held)])
    assert found == want
    assert ppm.score_documents(clashing).count() == awkward.count()
    assert ppm.score_documents(empty).count() == 0


def below(seen, shorter, s):
    """Probability of s in a context of these counts (method C), with those seen excluded from the shorter one."""
    seen = {x: n for x, n in seen.items() if n}
    n, q = sum(seen.values()), len(seen)
    if s in seen:
        return seen[s] / (n + (0 if q == ppm.SYMBOLS else q))
    return shorter(s) if not n else q / (n + q) * shorter(s) / (1 - sum(shorter(x) for x in seen))


def brute_scores(counts, words):
    """log10 probabilities of words (bytes) by the definition; counts: of training words."""
    trie, short = {}, [Counter(), {}, {}]
    for w, n in counts.items():
        s = [256, 256, *w, 256]
        for d in range(len(w) + 1):
            a, b, c = s[d : d + 3]
            trie.setdefault(w[:d], Counter())[c] += n
            short[0][c] += n
            short[1].setdefault(b, Counter())[c] += n
            short[2].setdefault((a, b), Counter())[c] += n
    out = {}
    for w in words:
        s, total = [256, 256, *w, 256], 0.0
        for d in range(len(w) + 1):
            a, b, c = s[d : d + 3]
            p0 = lambda x: below(short[0], lambda _: 1 / ppm.SYMBOLS, x)
            p1 = lambda x: below(short[1].get(b, {}), p0, x)
            p2 = lambda x: below(short[2].get((a, b), {}), p1, x)
            total += math.log10(below(trie.get(w[:d], {}), p2, c))
        out[w] = total
    return out


@pytest.mark.parametrize("range_words", [1, 4, 1000])
def test_words_are_scored_by_the_definition(spark, range_words):
    rng = np.random.default_rng(range_words)
    words = sorted({bytes(rng.choice(list(b"abz"), rng.integers(0, 7)).tolist()) for _ in range(90)} | {b"", b"ab" * 40, b"ab" * 39 + b"zz", "é".encode(), b"\xff\x00"})
    rows = [(bytearray(w), int(rng.integers(0, 4)), 5) for w in words]
    want = brute_scores({bytes(w): n for w, n, _ in rows if n}, words)
    found = ppm.score_words(spark.createDataFrame(rows, "word binary, n long, m long"), range_words).collect()
    assert sorted(bytes(r["word"]) for r in found) == words
    for r in found:
        w = bytes(r["word"])
        assert r["score"] == pytest.approx(want[w], abs=2e-3 * (len(w) + 1)), w  # code lengths come in steps, which exclusions of most symbols enlarge


@pytest.mark.parametrize("hot", [1 << 17, 3])
def test_documents_have_their_words_scores(documents, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT_WORDS", hot)
    rng = np.random.default_rng(hot)
    rows = [(i, " ".join("".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(30)) + f" own{i} " + "long" * 30) for i in range(40)]
    train = Counter(w.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in [*t.split(), ""])
    want = brute_scores(train, {w.encode() for _, t in rows for w in [*t.split(), ""]})
    for r in ppm.score_documents(documents(*rows), range_words=7).collect():
        assert r["score"] == pytest.approx(sum(want[w.encode()] for w in [*rows[r["doc_id"]][1].split(), ""]), abs=0.1)


def test_words_met_in_training_gain_by_it(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in ppm.score_documents(docs).where("held_out").collect()}
    held = docs.where(ppm.held_out(docs["doc_id"]))
    alone = {r["doc_id"]: r for r in ppm.score_documents(held.unionByName(docs.where("doc_id = 0"))).collect()}
    mean = lambda rows: sum(rows[i]["score"] for i in found) / sum(rows[i]["n_tokens"] for i in found)
    assert mean(found) > mean(alone) + 1


def test_learning_helps(documents):
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3) for i in range(40)] + [(i, "zq xv jk wq qq vz kx " * 6) for i in range(1000, 1002)]
    r = {x["doc_id"]: x["score"] / len(rows[0][1]) for x in ppm.score_documents(documents(*rows)).collect()}
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    assert all(r[i] > -0.2 for i in held)
