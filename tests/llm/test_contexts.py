"""The PPM of whole texts against its definition."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from shoal.llm import contexts, ppm

ORDER, SYMBOLS, END = 5, 257, 256


def brute(rows):
    """log10 probability of each row's text (doc_id, text): from the longest context to none, what was seen in a longer one excluded."""
    spelled = [[END] * ORDER + list((t or "").encode().lower()) + [END] for _, t in rows]
    trie = {}
    for (i, _), s in zip(rows, spelled):
        if i is not None and zlib.crc32(str(i).encode()) % 5 == 1:
            continue
        for at in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                trie.setdefault(tuple(s[at - k : at]), Counter())[s[at]] += 1

    def symbol(context, x):
        p, gone = 1.0, set()
        for k in range(ORDER, -1, -1):
            seen = trie.get(context[ORDER - k :], {})
            counts = {y: n for y, n in seen.items() if y not in gone}
            whole = sum(counts.values()) + (0 if len(seen) == SYMBOLS else len(counts))
            if x in counts:
                return p * counts[x] / whole
            if counts:
                p *= len(counts) / whole
            gone |= set(counts)
        return p / (SYMBOLS - len(gone))

    return [sum(math.log10(symbol(tuple(s[at - ORDER : at]), s[at])) for at in range(ORDER, len(s))) for s in spelled]


def scores(df):
    return {r["doc_id"]: r["score"] for r in ppm.score_documents(df).collect()}


@pytest.mark.parametrize("hot, piece", [(1 << 20, 1 << 21), (40, 50), (0, 7)])
def test_texts_are_scored_by_the_definition(documents, monkeypatch, hot, piece):
    monkeypatch.setattr(ppm, "HOT_PATHS", hot)
    monkeypatch.setattr(contexts, "SLICE", piece)
    monkeypatch.setattr(contexts, "HELD", 64)
    rng = np.random.default_rng(hot)
    rows = [(i, " ".join("".join(rng.choice(list("abC"), rng.integers(1, 6))) for _ in range(12)) + f"\n\tünï{i} 😀") for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \t\n "), (43, "abc " * 60), (44, "zzzzz \x00\x7f"), (46, "the last")]
    got = scores(documents(*rows))
    for (i, _), want in zip(rows, brute(rows)):
        assert got[i] == pytest.approx(want, abs=1e-6), i


def test_all_symbols_known_leaves_no_escape(spark):
    rows = [(2, bytes(range(256)))] * 2 + [(5, b"\xff\x00ab")]  # 2 and 5 are training
    df = spark.createDataFrame(rows, "doc_id long, text binary")
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in ppm.score_documents(df).collect())


def test_contexts_run_on_across_words(documents):
    """The same words in the order of training or in another: words by themselves score alike."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = [(i, "black cat white dog") for i in range(200) if i not in held]
    got = scores(documents(*rows, (held[0], "black cat white dog"), (held[1], "black dog white cat")))
    assert got[held[0]] > got[held[1]] + 2


def test_escapes_go_to_every_shorter_context(documents):
    """After a beginning that was never seen, four bytes still tell what follows; two bytes alone don't."""
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1]
    train = [(i, f"{chr(97 + i % 20)}{'wxyz'[i % 2 :: 2]}st{'p' if i % 2 else 'q'}") for i in range(400) if i not in held]
    got = scores(documents(*train, (held[0], "0xzstp"), (held[1], "0wystp")))
    swapped = scores(documents(*train, (held[0], "0xzstq"), (held[1], "0wystq")))
    assert got[held[0]] > swapped[held[0]]  # odd rows: "xz" goes with p
    assert swapped[held[1]] > got[held[1]]


def test_no_training_text_gives_equal_shares(documents):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    assert scores(documents((i, "ab")))[i] == pytest.approx(-3 * math.log10(SYMBOLS))
