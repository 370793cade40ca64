import numpy as np
import pytest

import corpus_pipeline
from shoal.llm import minhash, simhash


def shingles(text, words=5):
    tokens = text.lower().split()
    return {tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}


def brute(rows, least=0.8):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [rows[find(i)][0] for i in range(len(rows))]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    texts = [[word() for _ in range(200)] for _ in range(6)]
    out = [list(t) for t in texts] + [list(texts[0])]
    for of, changes in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 6), (5, 12)):  # 0.8 is between 4 and 5 changes
        t = list(texts[of])
        for at in np.linspace(10, 180, changes).astype(int):
            t[at] = "changed"
        out.append(t)
    crowd = [word() for _ in range(150)]
    for _ in range(40):
        t = list(crowd)
        for at in rng.integers(0, 150, rng.integers(1, 6)):
            t[at] = word()
        out.append(t)
    passage = [word() for _ in range(60)]
    out += [passage + [word() for _ in range(40)] for _ in range(20)]
    return [(i, " ".join(t)) for i, t in enumerate(out)] + [(900, "One two"), (901, "one TWO"), (902, "one two three"), (903, " ")]


@pytest.mark.parametrize("pairs", [64, 4, 0])  # 0: by pivots to the end
def test_classes_against_brute_force(documents, rows, monkeypatch, pairs):
    monkeypatch.setattr(minhash, "PAIRS", pairs)
    want = sorted(set(brute(rows)))
    assert sorted(r["doc_id"] for r in minhash.drop_similar(documents(*rows)).collect()) == want


def test_signatures_find_the_pairs_of_near_fingerprints(spark, documents, rows, monkeypatch):
    """Without the keys of minima, what links is within the signatures' bits, and all of that is linked."""
    monkeypatch.setattr(minhash, "band_keys", lambda of, constants: [])
    sets = [shingles(t) for _, t in rows]
    prints = [simhash.simhash(np.unique(simhash.shingles(t.encode(), 5, 42))) for _, t in rows]
    near = {(a, b) for a in range(len(rows)) for b in range(a) if 1 < len(sets[a]) and (prints[a] ^ prints[b]).bit_count() <= 4 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    of = {r["doc_id"]: r["class"] for r in minhash.similar(documents(*rows)).collect()}
    assert any(sets[a] != sets[b] for a, b in near)
    assert all(of[rows[a][0]] == of[rows[b][0]] for a, b in near)


def test_stage_of_the_pipeline_drops_near_copies(spark, documents, rows):
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, documents(*rows), "").collect()}
    assert kept == set(brute(rows))


def test_awkward_rows(awkward, clashing, empty):
    kept = minhash.drop_similar(clashing)
    assert kept.columns == clashing.columns and [r["doc_id"] for r in kept.where("text like 'Alpha%'").collect()] == [1]
    assert [r["doc_id"] for r in minhash.drop_similar(awkward).where("text is null or trim(text) = ''").collect()] == [2]
    assert minhash.drop_similar(empty).count() == 0


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 50), np.uint64)]))
        differ = sum(int(x).bit_count() for x in (minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


def test_similar_sets_share_one_of_their_rarest_shingles(spark):
    rng = np.random.default_rng(4)
    passage = [k * k for k in range(40)]  # in every set
    sets = [passage + [int(x) for x in rng.integers(1000, 1 << 40, rng.integers(2, 30))] for _ in range(20)]
    sets += [s[:-1] + [-k] for k, s in enumerate(sets, 1)]
    keys = {}
    for r in minhash.rarest(spark.createDataFrame(list(enumerate(sets)), "fp long, shingles array<long>"), 0.8).collect():
        keys.setdefault(r["fp"], set()).add(r["key"])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(set(a) & set(sets[j]))
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                assert keys.get(i, set()) & keys.get(j, set())
    assert not any(set(passage) & k for i, k in keys.items() if len(sets[i]) > 60)
