"""Toxicity by a classifier chain.

Categories are predicted in turn by linear models; each later model also gets the earlier categories' probabilities. In training
these are out-of-fold predictions, so a later model sees them as accurate as they will be on new documents.

By default the categories are those that the labels table gives: ``junk`` (quality 0), then ``toxic``. Others can be given, with any columns of
the labels. A category's model is fitted on the rows whose label is known.

A feature's value is its share of the whole text's words, times SCALE, 1 at most; features are words and word stems (4 to 7 characters). The same
function computes them for fitting and for scoring. The vocabulary is every feature that stands in at least LEAST_DOCUMENTS documents that are of
any category, and in a LEAST_SHARE of those, and whose mean in a category is more than LEAST_SCORE standard errors above that of the others. It is fitted on at most SAMPLE labelled
documents, the first by a hash of the doc_id; every document is scored, over its whole text.

Defined cases: null text has no words; a doc_id with several labels has the highest; null labels and labels without
document are left out; without labels, or with one class only, nothing is toxic; labels that tie are as they come, since a document's
probability depends on its text alone; repeated rows are scored each; a text of any length is one document, whose words are counted in one
pass; extra columns of any name stay in ``_row``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import map_arrow, packed, slices, stash, texts_of
from shoal.llm.licences import words_of
from shoal.llm.linear import Linear, Rows, fit, sigmoid

SAMPLE = 10_000
FOLDS = 5
REMEMBERED = 100_000
#: A feature's value grows with its share of a document's words up to 1, at 1 / SCALE.
SCALE = 40.0
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_SCORE = 3, 0.01, 3.0
#: Partitions of the sample, and bytes of its text worked on at once.
SAMPLE_PARTS, SLICE = 12, 1 << 18


def stems(word: bytes) -> list[bytes]:
    """The word, and its stems; the byte before them tells them apart."""
    text = word.decode("utf-8", "replace")
    return [b"=" + word, *(b"-" + text[:k].encode() for k in range(4, 8) if len(text) >= k)]


class Vocabulary(dict):
    """Indices of the features of each word met."""

    def __init__(self, of: dict[bytes, int]):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = tuple(i for s in stems(word) if (i := self.of.get(s)) is not None)
        return out

    def entries(self, text: bytes) -> tuple[list[int], list[float]]:
        words = words_of(text)
        found = Counter(chain.from_iterable(map(self.__getitem__, words)))
        n = len(words)
        return [*found], [min(1.0, SCALE * c / n) for c in found.values()]


class Chain:
    """Fitted categories, in order."""

    def __init__(self, names: list[str], models: list[Linear]):
        self.names, self.models = names, models

    @classmethod
    def fit(cls, names: list[str], x: Rows, y: np.ndarray, folds: np.ndarray) -> Chain:
        """y: row, category (not a number: unknown); folds: a fold of each row, by which earlier probabilities are made out of fold."""
        models, earlier = [], np.zeros((len(x), 0))
        for c in range(len(names)):
            known = ~np.isnan(y[:, c])
            models.append(fit(x.take(known), earlier[known], y[known, c]))
            if c + 1 == len(names):
                break
            out = np.zeros(len(x))
            for f in np.unique(folds):
                test, train = folds == f, (folds != f) & known
                part = fit(x.take(train), earlier[train], y[train, c])
                out[test] = sigmoid(part.logits(x.take(test), earlier[test]))
            earlier = np.column_stack([earlier, out])
        return cls(names, models)

    def predict(self, x: Rows) -> np.ndarray:
        p = np.zeros((len(x), 0))
        for m in self.models:
            p = np.column_stack([p, sigmoid(m.logits(x, p))])
        return p


def default_categories(labels: DataFrame) -> dict[str, Column]:
    toxic = {"toxic": F.col("toxic")}
    return {"junk": 1 - F.col("quality"), **toxic} if "quality" in labels.columns else toxic


def _sampled(docs: DataFrame, labels: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """h, y, text of at most SAMPLE labelled doc_ids' documents."""
    columns = [F.max(c.cast("double")).alias(f"y{i}") for i, c in enumerate(categories.values())]
    given = labels.where("doc_id is not null").groupBy("doc_id").agg(*columns)
    given = given.where(f"y{len(columns) - 1} is not null").select("doc_id", F.array(*[f"y{i}" for i in range(len(columns))]).alias("y"), F.xxhash64(F.lit(11), "doc_id").alias("h"))
    some = given.orderBy("h", "doc_id").limit(SAMPLE)
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id")  # SAMPLE rows at most
    return stash(found.select("h", "y", "text").repartition(SAMPLE_PARTS), "toxicity-sample")


def _candidates(rows: DataFrame) -> list[bytes]:
    """Features that stand in LEAST_DOCUMENTS, and in LEAST_SHARE, of the documents that are of any category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in slices(texts, SLICE):
                found: Counter[bytes] = Counter()
                for t in texts[lo:hi]:
                    found.update(reduce(set.union, map(set, map(stems, {*words_of(t)})), set()))
                yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.int64())], ["name", "n"])

    positive = rows.where(F.exists("y", lambda c: c > 0))
    least = max(LEAST_DOCUMENTS, LEAST_SHARE * positive.count())
    counted = map_arrow(positive.select("text"), run, "name binary, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return sorted(counted.where(F.col("n") >= least).select("name").toArrow()["name"].to_pylist())


def _entries(rows: DataFrame, of: dict[bytes, int]) -> pa.Table:
    """h, y, columns, values of the sample's rows."""
    shipped = rows.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(shipped.value)
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in slices(texts, SLICE):
                found = [known.entries(t) for t in texts[lo:hi]]
                lists = [pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([b for _, b in found], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *lists], ["h", "y", "columns", "values"])

    return map_arrow(rows.select("h", "y", "text"), run, "h long, y array<double>, columns array<int>, values array<float>").orderBy("h", "columns", "values").toArrow()


def telling(x: Rows, y: np.ndarray) -> np.ndarray:
    """Columns whose mean value where y is 1 is more than LEAST_SCORE standard errors above that elsewhere."""
    bad, good = y > 0, y == 0
    sums = [np.bincount(x.columns, x.values**p * of[x.rows], x.width) for of in (bad, good) for p in (1, 2)]
    n = [max(1, int(bad.sum())), max(1, int(good.sum()))]
    means = [sums[0] / n[0], sums[2] / n[1]]
    spread = (sums[1] / n[0] - means[0] ** 2) / n[0] + (sums[3] / n[1] - means[1] ** 2) / n[1]
    return np.flatnonzero(means[0] - means[1] > LEAST_SCORE * np.sqrt(np.maximum(spread, 1e-12)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None) -> tuple[dict[bytes, int], Chain]:
    """The vocabulary and the chain. ``categories``: name to a 0/1 column of ``labels``, the one that decides last."""
    categories = categories or default_categories(labels)
    names = [*categories]
    rows = _sampled(docs, labels, categories)
    candidates = _candidates(rows)
    found = _entries(rows, {name: i for i, name in enumerate(candidates)})
    y = np.array([[np.nan if v is None else v for v in r] for r in found["y"].to_pylist()], float).reshape(-1, len(names))
    if not candidates or len(np.unique(y[:, -1])) < 2:
        return {}, Chain(names, [Linear(np.zeros(0), np.zeros(c), -40.0) for c in range(len(names))])
    flat = lambda name, kind: found[name].combine_chunks().flatten().to_numpy().astype(kind)
    x = Rows(flat("columns", np.int64), flat("values", np.float64), np.cumsum([0, *pc.list_value_length(found["columns"]).to_numpy()]), len(candidates))
    chosen = np.unique(np.concatenate([telling(x, y[:, c]) for c in range(len(names))]))
    place = np.full(len(candidates), -1)
    place[chosen] = np.arange(len(chosen))
    keep = place[x.columns] >= 0
    x = Rows(place[x.columns][keep], x.values[keep], np.cumsum([0, *np.bincount(x.rows[keep], minlength=len(x))]), len(chosen))
    return {candidates[c]: i for i, c in enumerate(chosen)}, Chain.fit(names, x, y, found["h"].to_numpy() % FOLDS)


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, most: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (or their columns ``carry``) in a struct ``_row``, with a probability for each category (``p``, in the chain's order) and ``toxic`` (the last is over ``most``)."""
    vocabulary, model = fit_toxicity(docs, labels, categories)
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, model))
    rows = packed(docs, F.col("text").cast("binary").alias("text"), carry=carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, model = shipped.value
        known = Vocabulary(of)
        for batch in batches:
            found = [known.entries(t) for t in texts_of(batch)]
            p = model.predict(Rows.of([a for a, _ in found], [b for _, b in found], len(of)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(p), pa.list_(pa.float64())), pa.array(p[:, -1] > most, pa.bool_())], ["_row", "p", "toxic"])

    return map_arrow(rows, run, f"_row {rows.schema['_row'].dataType.simpleString()}, p array<double>, toxic boolean")
