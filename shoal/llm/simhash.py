"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that one of them differs by at most one bit between any two
fingerprints within ``bits``: bits // 2 + 1 segments. Each segment is indexed once for each of its bits, with
that bit left out; fingerprints within reach of each other meet in one of these 64 keys by equality and are
then verified.

Components are exact, without all pairs of a key's group.

1. On a quarter of the keys, each fingerprint is verified against one pivot of the key, chosen by a hash of key and fingerprint, so
   that a group that shares many keys is linked through many pivots. These links give provisional classes.
2. On all keys, the largest of a key's classes is its main one. A key of two fingerprints is settled by its minimum and maximum. In the
   others, only fingerprints outside the main class are looked at: whether one is near any member of the main class (a semi-join, which
   stops at the first), and then which of those still outside are near each other.

A tight group of near copies is one class after the first step, so little of it is left for the second, and no join gives more
rows than there are links between different classes.

Defined cases: null, empty or white-space text has fingerprint 0 and is linked like any other; repeated rows are
kept, each with the same result; a null doc_id is never a component id unless all ids of the component are null;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shoal.llm.common import map_arrow, packed, stash, texts_of

WIDTH = 64


def shingles(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """Hashes of the text's word shingles, repeats included; none of a text without words."""
    tokens = text.lower().split()  # of bytes: lower-cases A-Z and splits at ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(accumulate(map(len, tokens)))
    n = max(1, len(tokens) - words + 1)
    last = min(words, len(tokens)) - 1
    # token i begins after i spaces and the tokens before it
    starts = [0, *[e + i + 1 for i, e in enumerate(ends)]]
    return np.fromiter((xxh64_intdigest(joined[starts[i] : ends[i + last] + i + last], seed) for i in range(n)), np.uint64, n)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of the text's word shingles, repeats included."""
    return simhash(shingles(text, words, seed))


def simhash(hashes: np.ndarray) -> int:
    """Unsigned: a bit is 1 if set in over half the hashes; none: 0."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros(WIDTH, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (votes * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, h (a hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, words, seed) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.int64())], ["doc_id", "h", "fp"])

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")), run, "doc_id long, h long, fp long")


def segments(bits: int) -> list[tuple[int, int]]:
    """First and last bit (exclusive) of bits // 2 + 1 segments."""
    n = bits // 2 + 1
    cuts = [round(WIDTH * i / n) for i in range(n + 1)]
    return [*zip(cuts, cuts[1:])]


def variants(fp: Column, bits: int, every: int = 1) -> Column:
    """Keys of a fingerprint: for each bit (or each ``every``-th), the bit's segment without it, and which bit it was."""
    keys = []
    for lo, hi in segments(bits):
        for b in range(lo, hi, every):
            mask = ((1 << (hi - lo)) - 1) & ~(1 << (b - lo))
            segment = F.shiftrightunsigned(fp, lo) if lo else fp
            keys.append(segment.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(b << 33)))  # a segment has 32 bits at most
    return F.array(*keys)


def near(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def follow(pointers: DataFrame, key: str, to: str) -> DataFrame:
    """Every ``to`` replaced by the end of its chain; a root points to itself."""
    while True:
        up = pointers.where(F.col(key) != F.col(to)).select(F.col(key).alias("_k"), F.col(to).alias("_to"))
        jumped = pointers.join(up, pointers[to] == up["_k"], "left")
        jumped = stash(jumped.select(key, F.coalesce("_to", to).alias(to), F.col("_to").isNotNull().alias("_moved")), "pointers")
        pointers = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest reachable node) for edges a, b; by minimum of neighbours and pointer jumping."""
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = follow(stash(labels, "labels"), "node", "root")
    while True:
        la, lb = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        hooks = both.join(la, "a").join(lb, "b").where("ra > rb").groupBy("ra").agg(F.min("rb").alias("rb"))
        hooks = stash(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        moved = labels.join(hooks, labels["root"] == hooks["ra"], "left").select("node", F.coalesce("rb", "root").alias("root"))
        labels = follow(stash(moved, "labels"), "node", "root")


def meets_at(difference: Column, bits: int) -> Column:
    """The first bit whose key two fingerprints share, from their difference: a pair that shares many keys counts at this one."""
    out = F.lit(None).cast("int")
    for lo, hi in reversed(segments(bits)):
        own = F.shiftrightunsigned(difference, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) if lo else difference.bitwiseAND(F.lit((1 << hi) - 1))
        bit = F.round(F.log2(F.greatest(own, F.lit(1)).cast("double"))).cast("int") + lo
        out = F.when(F.bit_count(own) == 0, F.lit(lo)).when(F.bit_count(own) == 1, bit).otherwise(out)
    return out


def classes(prints: DataFrame, bits: int = 4) -> DataFrame:
    """fp, root: the class of every distinct fp of ``prints`` under links of at most ``bits`` differing bits; root is the class's smallest fp."""
    if bits < 2:
        raise ValueError("from 2 bits on, segments that may differ by one are fewer than the bits")
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = stash(prints.select("fp").distinct(), "distinct")

    some = distinct.repartition(tasks).select("fp", F.explode(variants(F.col("fp"), bits, every=4)).alias("key"))
    pivots = some.groupBy("key").agg(F.count("*").alias("n"), F.min_by("fp", F.xxhash64("key", "fp")).alias("pivot")).where("n > 1").drop("n")
    first = some.join(pivots, "key").where((F.col("fp") != F.col("pivot")) & near(F.col("fp"), F.col("pivot"), bits)).select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    roots = stash(_relabel(distinct.select("fp", F.col("fp").alias("root")), components(first)), "classes")
    sized = stash(roots.join(roots.groupBy("root").agg(F.count("*").alias("size")), "root"), "sized")

    # joins below are of the same kind at every size: all keys are one side
    keyed = sized.repartition(tasks).select("fp", "root", "size", F.explode(variants(F.col("fp"), bits)).alias("key"))
    largest = F.max_by("root", F.col("size") * (1 << 20) + F.pmod(F.xxhash64("root"), F.lit(1 << 20)))
    found = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), largest.alias("main"))
    found = stash(found.where((F.col("n") > 2) | ((F.col("n") == 2) & near(F.col("lo"), F.col("hi"), bits))), "keys")
    crowded = found.where("n > 2").select(F.col("key").alias("_key"), "main").hint("merge")
    outside = stash(keyed.join(crowded, (F.col("key") == F.col("_key")) & (F.col("root") != F.col("main"))).select("key", "fp", "root", "main"), "outside")
    inner = keyed.select(F.col("key").alias("_key"), F.col("fp").alias("_fp"), F.col("root").alias("_root")).hint("merge")
    joins = outside.join(inner, (F.col("key") == F.col("_key")) & (F.col("main") == F.col("_root")) & near(F.col("fp"), F.col("_fp"), bits), "left_semi")
    two = found.where("n = 2").select("lo", "hi")
    for c in ("lo", "hi"):
        two = two.join(roots.select(F.col("fp").alias(c), F.col("root").alias(f"{c}_root")), c)
    edges = joins.select(F.col("root").alias("a"), F.col("main").alias("b")).unionByName(two.select(F.col("lo_root").alias("a"), F.col("hi_root").alias("b")))
    merged = components(edges.where("a != b").distinct())

    top = lambda c: merged.select(F.col("node").alias(c), F.col("root").alias(f"{c}_top"))
    rest = outside.join(top("root"), "root", "left").join(top("main"), "main", "left")
    rest = stash(rest.select("key", "fp", F.coalesce("root_top", "root").alias("root"), F.coalesce("main_top", "main").alias("main")), "rest")
    still = rest.where("root != main").select(F.col("key").alias("_key"), F.col("fp").alias("_fp"), F.col("root").alias("_root"))
    between = F.col("fp").bitwiseXOR(F.col("_fp"))
    at = F.shiftright("key", 33).cast("int") == meets_at(between, bits)
    pairs = still.join(rest, (F.col("key") == F.col("_key")) & (F.col("root") != F.col("_root")) & (F.bit_count(between) <= bits) & at)
    return _relabel(_relabel(roots, merged), components(pairs.select(F.col("_root").alias("a"), F.col("root").alias("b")).distinct()))


def _relabel(roots: DataFrame, merged: DataFrame) -> DataFrame:
    top = merged.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(top, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, h, fp, class, component_id (the smallest doc_id of the class) of every row of ``docs`` (doc_id, text)."""
    prints = stash(fingerprints(docs, words, seed), "prints")
    root = stash(classes(prints, bits), "classes")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(root, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_print = stash(root.join(least, "root").select("fp", F.col("root").alias("class"), "component_id"), "components")
    return prints.join(of_print, "fp").select("doc_id", "h", "fp", "class", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, one of each class: that of the smallest doc_id, then of the smallest hash of the text; null doc_ids last."""
    return one_of_each(docs, stash(near_duplicates(docs, **options), "near-duplicates"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs``, one of each class of ``found`` (doc_id, h, class); of rows that share doc_id and text, the first by a hash of all columns."""
    stays = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.h").alias("_h"))
    rows = packed(docs, docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("h"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("whole"))
    kept = rows.join(stays, rows["doc_id"].eqNullSafe(stays["_id"]) & (rows["h"] == stays["_h"]), "left_semi")
    same = kept.groupBy("doc_id", "h").agg(F.min("whole").alias("whole"))
    first = same.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("whole").alias("_whole"))
    kept = kept.join(first, kept["doc_id"].eqNullSafe(first["_id"]) & (kept["h"] == first["_h"]) & (kept["whole"] == first["_whole"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "h"]).select("_row.*")  # a row that is repeated whole stays once
