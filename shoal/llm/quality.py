"""Quality classifier from weak labels.

Overlapping heuristic labellers each say junk, good or nothing of a document. Expectation-maximisation over the counts
of all documents' vote patterns estimates how often each labeller says what of good and of junk documents (a labeller may be
inaccurate), and how many documents are good, and so the probability that a pattern is of a good document. These posteriors are soft labels of a
linear scorer over hashed word shapes, fitted on at most SAMPLE documents; it scores every document.

Vote patterns are 3**8 at most and only their counts reach the driver; they cover all documents. EM starts from: a document is doubted if any
labeller says junk. What is taken of labellers before any document is seen weighs as PRIOR documents, whatever the size of the table.

Defined cases: null or empty text has no words: one labeller says junk, the others nothing; documents whose votes tie have the same label, and those
whose shapes tie the same score; repeated rows count and are scored each; a null doc_id is kept; a text of any length is judged as a whole, by shares
of its words; extra columns of any name stay in ``_row``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import kept, map_arrow, packed, texts_of
from shoal.llm.linear import Linear, Rows, fit, sigmoid

SAMPLE = 10_000
BUCKETS = 1 << 14
REMEMBERED = 300_000
JUNK, NOTHING, GOOD = 0, 1, 2

_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 0x80 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_SYMBOLS = re.compile(rb"[%&*#$@^~]{2,}$")


class Shapes(dict):
    """Bucket of each word's shape: letters a or A, digits 9, runs of a character once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = zlib.crc32(_RUN.sub(rb"\1", word.translate(_SHAPE))) % (BUCKETS - 1)
        return out


def features(words: list[bytes], shapes: Shapes) -> tuple[list[int], list[float]]:
    """Buckets and values: the root of each shape's share, and the share of words that repeat the one before (last bucket)."""
    n = max(1, len(words))
    found = Counter(map(shapes.__getitem__, words))
    again = sum(map(eq, words, words[1:]))
    return [*found, BUCKETS - 1], [*((c / n) ** 0.5 for c in found.values()), (again / n) ** 0.5]


def _says(count: float, n: int, junk: float, good: float = 0.0) -> int:
    """By a count's share of n words; FEW more words are taken to have none of it, so that a word or two prove nothing. A labeller that looks for one kind of
    junk says nothing where there is none, as other kinds may be there."""
    share = count / (n + FEW)
    return JUNK if share > junk else GOOD if share < good else NOTHING


def votes(text: bytes, words: list[bytes]) -> list[int]:
    """What each labeller says."""
    n = len(words)
    if n == 0:
        return [JUNK] + [NOTHING] * (len(LABELLERS) - 1)
    kinds, symbols, shouted, odd = Counter(words), 0, 0, 0
    for w, c in kinds.items():
        if not _PLAIN.fullmatch(w):
            odd += c
            if w.endswith(b"!!"):
                shouted += c
            elif _SYMBOLS.search(w):
                symbols += c
    again = sum(map(eq, words, words[1:]))
    upper, letters = sum(map(text.count, _UPPER)), sum(map(len, words))
    seen = [len({*words[i : i + WINDOW]}) for i in range(0, n, WINDOW)]
    return [
        GOOD if n > WINDOW else NOTHING,
        _says(symbols, n, 0.2),
        _says(kinds[b"|"] + kinds[b"||"], n, 0.2),
        _says(shouted, n, 0.2),
        _says(n * upper / letters, n, 0.5, 0.1),
        _says(again, n, 0.2),
        _says(n - sum(seen), n, 0.7, 0.5),
        _says(odd, n, 0.4, 0.15),
    ]


#: Words of letters with at most one capital first and one mark after
_PLAIN = re.compile(rb"[A-Za-z\x80-\xff][a-z\x80-\xff]*[.,;:?!]?")
_UPPER = [bytes([b]) for b in range(65, 91)]
#: Words taken to be there without anything odd, and words among which repeats are counted.
FEW, WINDOW = 5, 100
#: No words (or many); words that end in symbols; cells of a table; words that end in !!; capitals; words that repeat the one before; words that repeat
#: one of their window; words that aren't plain.
LABELLERS = ("length", "symbols", "cells", "shouts", "capitals", "repeats", "variety", "odd")
#: What a labeller is taken to say (junk, nothing, good) of good and of junk documents, and how many documents are taken to be junk and good, before any
#: is seen; as shares, which weigh as PRIOR documents.
EXPECTED = np.array([[0.01, 0.19, 0.8], [0.3, 0.3, 0.4]])
EXPECTED_JUNK, PRIOR = 0.2, 20.0


def label_model(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Posterior probability of good for each vote pattern, by EM.

    A labeller's accuracy is how often it says junk, or good, of each class; saying nothing is no evidence.
    """
    if not patterns:
        return {}
    v = np.array([[int(c) for c in p] for p in patterns])
    n = np.array([*patterns.values()], float)
    good = np.where((v == JUNK).any(1), 0.1, 0.95)
    one_hot = (v[:, :, None] == np.arange(3)).astype(float)  # pattern, labeller, vote
    cast = one_hot * (np.arange(3) != NOTHING)
    for _ in range(rounds):
        logs = []
        for weight, share, expected in ((n * good, 1 - EXPECTED_JUNK, EXPECTED[0]), (n * (1 - good), EXPECTED_JUNK, EXPECTED[1])):
            says = (np.einsum("p,plv->lv", weight, one_hot) + PRIOR * expected) / (weight.sum() + PRIOR)
            logs.append(np.log((weight.sum() + PRIOR * share) / (n.sum() + PRIOR)) + np.einsum("plv,lv->p", cast, np.log(says)))
        good = sigmoid(logs[0] - logs[1])
    return {p: float(x) for p, x in zip(patterns, good)}


def _votes_of(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for t in texts_of(batch):
                counts["".join(map(str, votes(t, t.split())))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["votes", "n"])

    return map_arrow(docs.select(F.col("text").cast("binary").alias("text")), run, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def _sampled(docs: DataFrame, total: int) -> list:
    """Votes and features of at most SAMPLE rows, the first by a hash of the row."""
    h = F.xxhash64("doc_id", "text")
    some = docs.select(F.col("text").cast("binary").alias("text"), h.alias("h"))
    if total > SAMPLE:
        some = some.where(F.pmod("h", F.lit(1 << 20)) < int(1.2 * SAMPLE / total * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = kept("shapes", Shapes)
        for batch in batches:
            rows = []
            for t in texts_of(batch):
                words = t.split()
                columns, values = features(words, shapes)
                rows.append(("".join(map(str, votes(t, words))), columns, values))
            a, b, c = [*zip(*rows)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(a, pa.string()), pa.array(b, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.float32()))], ["h", "votes", "columns", "values"])

    return map_arrow(some, run, "h long, votes string, columns array<int>, values array<float>").orderBy("h", "votes").limit(SAMPLE).collect()


def fit_quality(docs: DataFrame) -> tuple[dict[str, float], Linear]:
    """The label model's posterior of each vote pattern, and the scorer."""
    patterns = {r["votes"]: r["n"] for r in _votes_of(docs).collect()}
    posterior = label_model(dict(sorted(patterns.items())))
    rows = _sampled(docs, sum(patterns.values()))
    x = Rows.of([r["columns"] for r in rows], [r["values"] for r in rows], BUCKETS)
    y = np.array([posterior[r["votes"]] for r in rows])
    return posterior, fit(x, np.zeros((len(rows), 0)), y)


def score_quality(docs: DataFrame, least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (or their columns ``carry``) in a struct ``_row``, with ``votes``, ``weak`` (posterior), ``score`` (probability of good) and ``keep``."""
    posterior, model = fit_quality(docs)
    shipped = docs.sparkSession.sparkContext.broadcast((posterior, model.weights, model.bias))
    rows = packed(docs, F.col("text").cast("binary").alias("text"), carry=carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (posterior, weights, bias), shapes = shipped.value, kept("shapes", Shapes)
        for batch in batches:
            said, scores = [], []
            for t in texts_of(batch):
                words = t.split()
                said.append("".join(map(str, votes(t, words))))
                columns, values = features(words, shapes)
                scores.append(float(weights[columns] @ np.array(values)) + bias)
            p = sigmoid(np.array(scores))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array([posterior[s] for s in said], pa.float64()), pa.array(p, pa.float64()), pa.array(p >= least, pa.bool_())], ["_row", "votes", "weak", "score", "keep"])

    return map_arrow(rows, run, f"_row {rows.schema['_row'].dataType.simpleString()}, votes string, weak double, score double, keep boolean")
