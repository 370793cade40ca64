import numpy as np
import pytest
import xxhash

from shoal.llm.simhash import classes, drop_near_duplicates, fingerprint, near_duplicates


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_classes(fps, bits=4):
    a, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= bits)[0]:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_fingerprint():
    words = "The Quick brown fox jumps\tover".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 3)
    assert fingerprint(b"The Quick brown fox jumps\tover") == want
    assert fingerprint(b"one two") == xxhash.xxh64_intdigest("one two", 42)
    assert fingerprint(b" \n") == 0


def test_classes_of_a_crowd_a_chain_and_strangers(spark):
    rng = np.random.default_rng(3)
    center = int(rng.integers(0, 2**63))
    fps = {int(x) for x in rng.integers(0, 2**63, 60)} | {0, center}
    for _ in range(250):
        x = center
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {(int(x) >> 21 << 21) | (center & (1 << 21) - 1) for x in rng.integers(0, 2**63, 60)}
    x = int(rng.integers(0, 2**62))
    for i in range(0, 60, 4):
        x ^= 0b1111 << i
        fps.add(x)
    fps = sorted(fps, key=signed)
    got = {r["fp"]: r["root"] for r in classes(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    assert [got[signed(f)] for f in fps] == [signed(fps[i]) for i in brute_classes(fps)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    base = [" ".join(word() for _ in range(300)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:4])]  # exact copies
    rows += [(200 + i, t.replace(t.split()[150], "changed", 1)) for i, t in enumerate(base[:4])]  # a word differs
    return rows


def test_against_brute_force(documents, texts):
    fps = {i: fingerprint(t.encode()) for i, t in texts}
    ids = sorted(fps)
    root = dict(zip(ids, (ids[k] for k in brute_classes([fps[i] for i in ids]))))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(*texts)).collect()}
    assert got == root
    assert sorted(r["doc_id"] for r in drop_near_duplicates(documents(*texts)).collect()) == sorted(set(root.values()))


def test_awkward_rows(awkward, clashing, empty):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {2}  # null, empty, white space and the null row
    kept = drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns and [r["doc_id"] for r in kept.where("text like 'Alpha%'").collect()] == [1]
    assert near_duplicates(empty).count() == 0 == drop_near_duplicates(empty).count()
