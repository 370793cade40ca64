"""Near-duplicates by the Jaccard similarity of sets of word shingles.

Candidates share a key of one of two kinds. The deletion-variant signatures of ``simhash``, of the fingerprints of the sets, find all pairs whose fingerprints differ in
at most SIGNATURE_BITS bits; those of similarity 0.8 mostly differ in more, at which the signatures' segments would be too short. The others share at least one of BANDS keys, each
made of ROWS minima of hashes (MinHash): a pair of similarity s is left out with
probability (1 - s**ROWS)**BANDS, which is 5e-8 at 0.8 and less above. Every link is then verified on the whole sets.

Texts of equal sets are one node from the start. Of the pairs of a key's group, only those between different classes and of sizes that
allow the similarity are of interest. Each set has a sketch, the parities of its shingles in BITS places: the places where two sketches differ are no more than the
shingles that two sets don't share, so a pair whose sketches differ in more places than the similarity allows is settled in the join (exact). In each
round, pivots of the key, chosen by a hash of key and node, are compared with the nodes of other classes, and then leave the group;
a tight group of near copies is one class after the first round, and each later round has twice as many pivots. Groups that are still mixed then mostly share a frequent passage and little else, so their nodes get other keys: each one's rarest shingles, so many that two similar sets
share one (prefix filter, exact), in which a frequent passage has no part. As soon as the pairs that are left are no more than PAIRS for each
row of the keys, all of them are compared. So the components are those of all candidates, and no join gives more rows than a multiple of
the keys.

Defined cases: texts without words are copies of each other; a text of fewer words than a shingle is one shingle; repeated rows and null
doc_ids are as in ``simhash``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from shoal.llm.common import map_arrow, stash, texts_of
from shoal.llm.simhash import _relabel, components, near, one_of_each, shingles, simhash, variants

BANDS, ROWS = 32, 4
#: Differing bits up to which the deletion-variant signatures find all pairs.
SIGNATURE_BITS = 4
#: Places of a sketch.
BITS = 512
#: Places in which shingles are counted (an array of 2 MB, whatever the input).
COUNTERS = 1 << 18
#: Pivots of a key in the second round; twice as many in each one after it.
PIVOTS = 16
#: Pairs for each row of the keys, at most, whose sketches are compared without pivots.
PAIRS = 64


def _constants(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def band_keys(of: np.ndarray, constants: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Signed 64-bit key of each band of a set of shingle hashes."""
    times, plus = constants
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(of), 1024):
        least = np.minimum(least, (of[None, at : at + 1024] * times[:, None] + plus[:, None]).min(1))
    return np.array([xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()


def sketch(of: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles in each of BITS places, as signed longs."""
    parities = np.bincount((of >> np.uint64(7)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(parities.astype(np.uint8)).view(np.int64)


def prints_of(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, h (a hash of the text), fp (a hash of the set of shingles), n (its size), print (its fingerprint), sketch, keys (none of a set of fewer than two, which has no near copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = _constants(seed)
        for batch in batches:
            fps, sizes, prints, sketches, keys = [], [], [], [], []
            for t in texts_of(batch):
                of = np.unique(shingles(t, words, seed))
                fps.append(xxh64_intdigest(of.tobytes(), seed))
                sizes.append(len(of))
                prints.append(simhash(of))
                sketches.append(sketch(of))
                keys.append(band_keys(of, constants) if len(of) > 1 else [])
            arrays = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), *(pa.array(x, pa.list_(pa.int64())) for x in (sketches, keys))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "h", "fp", "n", "print", "sketch", "keys"])

    return map_arrow(docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")), run, "doc_id long, h long, fp long, n long, print long, sketch array<long>, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int, seed: int) -> DataFrame:
    """fp, shingles of ``nodes`` (fp, h: the hash of one of its texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingles(t, words, seed)).view(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["fp", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")).join(nodes, "h").dropDuplicates(["fp"])
    return map_arrow(texts.select("fp", "text"), run, "fp long, shingles array<long>")


def signatures(nodes: DataFrame, bits: int = SIGNATURE_BITS) -> DataFrame:
    """fp, key: the deletion-variant signatures of ``nodes`` (fp, n, print), of those that fingerprints within ``bits`` can share; none of a set of fewer than two."""
    keyed = nodes.where("n > 1").select("fp", "print", F.explode(variants(F.col("print"), bits)).alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("print").alias("lo"), F.max("print").alias("hi"))
    met = met.where((F.col("n") > 2) | ((F.col("n") == 2) & near(F.col("lo"), F.col("hi"), bits))).select("key")
    return keyed.select("fp", "key").join(met, "key").select("fp", "key")


def rarest(sets: DataFrame, least: float) -> DataFrame:
    """fp, key: of each set of ``sets`` (fp, shingles), its rarest shingles, so many that sets of similarity ``least`` or more share one.

    How often shingles are met is counted in COUNTERS places; any order that is the same for all sets serves, a true one gives the smallest groups.
    """
    counted = sets.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(COUNTERS - 1)).alias("at")).agg(F.count("*").alias("n")).toArrow()
    often = np.zeros(COUNTERS, np.int64)
    often[counted["at"].to_numpy()] = counted["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, of in zip(batch.column(0).to_pylist(), batch.column(1)):
                of = of.values.to_numpy()
                common = int(np.ceil(len(of) * least - 1e-6))  # at least so many shingles are in both
                keys = of[np.lexsort((of, often[of & (COUNTERS - 1)]))[: len(of) - common + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), fp, np.int64)), pa.array(keys)], ["fp", "key"])

    return map_arrow(sets.select("fp", "shingles"), run, "fp long, key long")


def similar(docs: DataFrame, words: int = 5, least: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id, h, fp, class of every row of ``docs`` (doc_id, text): classes under links of Jaccard similarity ``least`` or more."""
    prints = stash(prints_of(docs, words, seed), "shingle-prints")
    nodes = stash(prints.groupBy("fp").agg(F.min("h").alias("h"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "shingle-nodes")
    keyed = nodes.select("fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keyed = stash(keyed.join(shared, "key").select("fp", "key").unionByName(signatures(nodes)), "shingle-keys")
    allowed = PAIRS * keyed.count()
    sets = stash(_sets(docs, nodes.select("fp", "h").join(keyed.select("fp").distinct(), "fp"), words, seed), "shingle-sets")
    roots = stash(nodes.select("fp", F.col("fp").alias("root")), "shingle-classes")

    def merged(pairs: DataFrame) -> DataFrame:
        """The classes after the pairs (a, a_root, b, b_root) that are similar are linked."""
        pairs = stash(pairs.select("a", "a_root", "b", "b_root").distinct(), "shingle-pairs")
        for c in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"{c}_set")), c)
        n, m, both = F.size("a_set"), F.size("b_set"), F.size(F.array_intersect("a_set", "b_set"))
        links = stash(pairs.where(both >= (n + m - both) * F.lit(least)).select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "shingle-links")
        return roots if links.isEmpty() else stash(_relabel(roots, components(links)), "shingle-classes")

    differ = sum((F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(BITS // 64)), F.lit(0))
    apart = (F.col("a_root") != F.col("b_root")) & (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(least))
    apart &= differ <= (F.col("a_n") + F.col("b_n")) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)

    def side(rows: DataFrame, c: str) -> DataFrame:
        return rows.select("key", F.col("fp").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("n", "sketch", "root")))

    pivots, refined = 1, False
    while True:
        rows = keyed.join(roots, "fp")
        each = rows.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count("*").alias("roots"))
        each = stash(each.where("roots > 1"), "shingle-groups")
        left = each.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0]
        if not left:
            break
        rows = rows.join(each.select("key"), "key")
        if left > allowed and pivots > 1 and not refined:
            keyed, refined = stash(rarest(sets.join(rows.select("fp").distinct(), "fp"), least), "shingle-rarest"), True
            allowed = max(allowed, PAIRS * keyed.count())
            continue
        rows = stash(rows.join(nodes.select("fp", "n", "sketch"), "fp"), "shingle-rows")
        if left <= allowed and pivots > 1:  # before the first round, tight groups would give all their pairs
            roots = merged(side(rows, "a").join(side(rows, "b"), "key").where(apart & (F.col("a") < F.col("b"))))
            break
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("key", "fp"), "fp"))
        chosen = stash(rows.withColumn("turn", turn).where(F.col("turn") <= pivots).drop("turn"), "shingle-pivots")
        roots = merged(side(rows, "a").join(side(chosen, "b"), "key").where(apart))
        keyed = stash(rows.select("key", "fp").join(chosen.select("key", "fp"), ["key", "fp"], "left_anti"), "shingle-keys")
        pivots = max(PIVOTS, 2 * pivots)
    return prints.join(roots, "fp").select("doc_id", "h", "fp", F.col("root").alias("class"))


def drop_similar(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, one of each class: that of the smallest doc_id, then of the smallest hash of the text; null doc_ids last."""
    return one_of_each(docs, stash(similar(docs, **options), "similar"))
