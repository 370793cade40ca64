"""Prediction by partial matching (PPM) over whole texts: contexts of up to ORDER bytes, across words, with an escape to every shorter one.

A symbol is one of 256 bytes or a text's end; before a text stand ends. Its contexts are the last ORDER symbols, the last ORDER - 1, and so on to
none, with the counts of all training texts. In a context, the symbols seen in the next longer one are excluded: with n the counts of those that
stay and q how many they are, a seen symbol has probability c / (n + q), and escape q / (n + q) (method C). A context that was never seen, or in which none stays, is passed by.
After the last escape, the symbols left have equal shares.

The trie is a table of its longest paths (a context of ORDER symbols and the symbol after it, one number), which grows with the corpus; shorter contexts are sums of it. A path's
score depends on the path alone, so each distinct path is scored once, in parts of the table that have whole contexts of ORDER to 3 symbols (dealt by
the last three). Contexts of two symbols and fewer have SYMBOLS ** 3 paths at most, whatever the corpus (a proven bound), and go to all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import map_arrow, slices, texts_of

#: Bytes and a text's end, which also stands for what is before a text.
SYMBOLS, END = 257, 256
#: Symbols of the longest context. A path is one number: SYMBOLS ** (ORDER + 1) < 2 ** 63.
ORDER = 5
#: Symbols of the contexts that go to all parts.
SHORT = 2
#: Distinct paths in a part, about.
PART_PATHS = 1 << 20
#: Bytes of text whose paths are made at once.
SLICE = 2 << 20
#: Paths of a task that are held before they are summed, and after it before they are sent.
HELD = 1 << 21


def paths_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The paths of all symbols of the texts, ends included, and the texts they are of, in pieces of bounded size."""
    sizes = np.array([len(t) for t in texts], np.int64) + ORDER + 1
    starts = np.cumsum(sizes) - sizes
    symbols, inside = np.full(sizes.sum(), END, np.int16), np.ones(sizes.sum(), bool)
    for k in range(ORDER):
        inside[starts + k] = False
    predicted = inside.copy()
    inside[starts + sizes - 1] = False
    symbols[inside] = np.frombuffer(b"".join(t.lower() for t in texts), np.uint8)
    of_text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    for lo in range(0, len(symbols) - ORDER, SLICE):
        part = symbols[lo : lo + SLICE + ORDER].astype(np.int64)
        path = part[: len(part) - ORDER].copy()
        for k in range(1, ORDER + 1):
            path *= SYMBOLS
            path += part[k : len(part) - ORDER + k]
        at = slice(lo + ORDER, lo + len(part))
        yield path[predicted[at]], of_text[at][predicted[at]]


def count_paths(docs: DataFrame, held_out: Column) -> DataFrame:
    """path, n (in training), m (in all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # sorted 2 * path + (in training), and how often

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, times = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys)
            keys, times = keys[order], times[order]
            begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[begins], np.add.reduceat(times, begins)

        def sums() -> pa.RecordBatch:
            keys, times = summed()
            begins = np.flatnonzero(np.append(True, keys[1:] >> 1 != keys[:-1] >> 1))
            n, m = np.add.reduceat(times * (keys & 1), begins), np.add.reduceat(times, begins)
            return pa.RecordBatch.from_arrays([pa.array(keys[begins] >> 1), pa.array(n), pa.array(m)], ["path", "n", "m"])

        for batch in batches:
            texts, train = texts_of(batch), ~batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts, SLICE):
                for path, of_text in paths_of(texts[lo:hi]):
                    held.append(np.unique(path * 2 + train[lo:hi][of_text], return_counts=True))
                    if sum(len(k) for k, _ in held) > HELD:
                        held = [summed()]
                        if len(held[0][0]) > HELD // 2:
                            yield sums()
                            held = []
        if held:
            yield sums()

    rows = docs.select(docs["text"].cast("binary").alias("text"), held_out.alias("held_out"))
    return map_arrow(rows, run, "path long, n long, m long").groupBy("path").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Contexts:
    """The contexts of one length: how often each symbol follows, in training."""

    def __init__(self, paths: np.ndarray, n: np.ndarray, shorter: Contexts | None, length: int):
        """``paths``: sorted, each once, of ``length`` symbols and the one after them. ``shorter``: the contexts without the first symbol."""
        paths, n = paths[n > 0], n[n > 0]
        begins = np.flatnonzero(np.append(True, paths[1:] // SYMBOLS != paths[:-1] // SYMBOLS)) if len(paths) else np.zeros(0, np.int64)
        none = np.iinfo(np.int64).max  # a path and a context that are never asked for
        self.paths, self.n, self.contexts = np.append(paths, none), np.append(n, 0), np.append(paths[begins] // SYMBOLS, none)

        def sums(of: np.ndarray) -> np.ndarray:
            return np.append(np.add.reduceat(of, begins) if len(begins) else of[:0], 0)

        self.total, self.distinct = sums(n), sums(np.ones(len(n), np.int64))
        #: What the symbols seen here count in the shorter context, from which they are excluded.
        self.excluded = sums(shorter.count(paths % SYMBOLS**length)) if shorter else np.zeros_like(self.total)

    def count(self, paths: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.paths, paths)
        return np.where(self.paths[at] == paths, self.n[at], 0)

    def of(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """total, distinct and excluded of each, zeros where it was never seen."""
        at = np.searchsorted(self.contexts, contexts)
        known = self.contexts[at] == contexts
        return tuple(np.where(known, x[at], 0) for x in (self.total, self.distinct, self.excluded))


def _contexts(paths: np.ndarray, n: np.ndarray, lengths: range, shorter: Contexts | None) -> list[Contexts]:
    """Of each length (ascending), from longer paths."""
    out = []
    for k in lengths:
        found, at = np.unique(paths % SYMBOLS ** (k + 1), return_inverse=True)
        shorter = Contexts(found, np.bincount(at, n, len(found)).astype(np.int64), shorter, k)
        out.append(shorter)
    return out


def path_scores(paths: np.ndarray, n: np.ndarray, short: list[Contexts]) -> np.ndarray:
    """log10 probability of the last symbol of each path (sorted, each once), among which are all that share their last SHORT + 1 symbols of context. ``short``: contexts of up to SHORT symbols."""
    score, left = np.zeros(len(paths)), np.arange(len(paths))
    gone_n, gone_q = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
    orders = [*short, *_contexts(paths, n, range(SHORT + 1, ORDER + 1), short[-1])]
    for k in range(ORDER, -1, -1):
        own = paths[left] % SYMBOLS ** (k + 1)
        total, distinct, excluded = orders[k].of(own // SYMBOLS)
        c, rest, q = orders[k].count(own), total - gone_n, distinct - gone_q
        whole = rest + np.where(distinct == SYMBOLS, 0, q)  # where all symbols are known, none is left to escape to
        seen = c > 0
        escaped = ~seen & (q > 0)
        score[left[seen]] += np.log10(c[seen] / whole[seen])
        score[left[escaped]] += np.log10(q[escaped] / whole[escaped])
        left, gone_n, gone_q = left[~seen], excluded[~seen], distinct[~seen]
    score[left] -= np.log10(SYMBOLS - gone_q)
    return score


def score_paths(counted: DataFrame) -> DataFrame:
    """path, m, score of every distinct path (path, n, m)."""
    spark = counted.sparkSession
    found = counted.where("n > 0").groupBy((F.col("path") % SYMBOLS ** (SHORT + 1)).alias("path")).agg(F.sum("n").alias("n")).toArrow()  # SYMBOLS ** 3 rows at most
    paths, n = found["path"].to_numpy(), found["n"].to_numpy()
    shipped = spark.sparkContext.broadcast((paths, n))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // PART_PATHS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        rows = pa.Table.from_batches(given)
        paths, n, m = (rows[c].to_numpy() for c in ("path", "n", "m"))
        order = np.argsort(paths)
        paths, n, m = paths[order], n[order], m[order]
        score = path_scores(paths, n, _contexts(*shipped.value, range(SHORT + 1), None))
        yield from pa.table({"path": paths, "m": m, "score": score}).to_batches(max_chunksize=1 << 16)

    dealt = counted.select("path", "n", "m").repartition(parts, F.expr(f"(path div {SYMBOLS}) % {SYMBOLS ** (SHORT + 1)}"))
    return map_arrow(dealt, run, "path long, m long, score double")


class Lookup:
    """Scores of paths by a hash table of open addresses."""

    def __init__(self, paths: np.ndarray, score: np.ndarray):
        self.bits = max(4, int(2 * len(paths)).bit_length())
        self.keys, self.score = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        slot, left = self._slots(paths), np.arange(len(paths))
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = paths[left[free]]
            won = self.keys[slot] == paths[left]
            self.score[slot[won]] = score[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slots(self, paths: np.ndarray) -> np.ndarray:
        return ((paths.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (0 where a path isn't there), and the places of the paths that aren't."""
        slot = self._slots(paths)
        keys, out = self.keys[slot], self.score[slot]
        left, missing = np.flatnonzero(keys != paths), []
        out[left] = 0
        slot, keys = slot[left], keys[left]
        while len(left):
            missing.append(left[keys < 0])
            left, slot = left[keys >= 0], (slot[keys >= 0] + 1) & ((1 << self.bits) - 1)
            keys = self.keys[slot]
            same = keys == paths[left]
            out[left[same]] = self.score[slot[same]]
            left, slot, keys = left[~same], slot[~same], keys[~same]
        return out, np.sort(np.concatenate([*missing, np.zeros(0, np.int64)]))
