"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document, in a shuffled order of its source, gets a virtual finish time: the source's words up to
and with it, over the source's target. Read across all sources in the order of finish time, each source is
served in proportion to its target; the mix is that order cut at the total budget. A source whose target is
above its size is read again (epochs), at most ``max_repeats`` times.

Cumulative sums are taken in two levels (hash ranges of a source, then the rows of a range), so no task holds a
source, and the cut is found by narrowing a fixed-size histogram, so no task sorts all rows.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows that repeat a
doc_id (or have none) are rows like others; documents of size 0 take nothing and, where rows are returned, stay
once; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm.common import WORD, packed, stash

#: Rows of a hash range, on average; the number of ranges grows with the table.
RANGE_ROWS = 500
HISTOGRAM = 1024
LAST_LOOK = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_positions(rows: DataFrame, bits: int) -> DataFrame:
    """Adds ``cum``, the words of the row's (source, hash range) up to and with the row. Rows have source, size, h."""
    ranged = rows.withColumn("range", F.shiftrightunsigned("h", 64 - bits))
    order = Window.partitionBy("source", "range").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("cum", F.sum("size").over(order))


def source_targets(sizes: DataFrame, weights: list[int], max_repeats: int) -> DataFrame:
    """Targets by water-filling: shares of the total by weight, none above ``max_repeats`` times its source's size.

    In the order of cap over weight, the sources that reach their cap are a prefix; what it leaves is shared
    by the weights of the rest.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(by_name)).withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeats)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.col("total") - before) / rest)
    free = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    s = s.withColumn("water", F.max(free).over(everything))
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")), F.col("cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"), "total")


@dataclass
class Plan:
    """What a mix has decided: where each hash range starts, and the finish time at which the mix ends."""

    bits: int
    ranges: DataFrame  # source, range, start, source_size, target
    rows: DataFrame  # doc_id, source, size, range, cum
    limit: float
    max_repeats: int

    def join(self, rows: DataFrame) -> DataFrame:
        r = self.ranges.select(F.col("source").alias("_source"), F.col("range").alias("_range"), "start", "source_size", "target")
        return rows.join(r, rows["source"].eqNullSafe(r["_source"]) & (rows["range"] == r["_range"])).drop("_source", "_range")

    def finish(self, epoch: int) -> Column:
        done = F.lit(epoch) * F.col("source_size") + F.col("start") + F.col("cum")
        return F.when(F.col("target") > 0, done / F.expr("nullif(target, 0)"))

    def epochs(self) -> Column:
        """How often the mix takes the row."""
        return sum((F.coalesce(self.finish(e) < F.lit(self.limit), F.lit(False)).cast("int") for e in range(self.max_repeats)), F.lit(0))


def _limit(found: DataFrame, plan: Plan, budget: int) -> float:
    """The first finish time at which the words taken exceed the budget; infinite if there is none."""
    times = F.explode(F.array(*[plan.finish(e) for e in range(plan.max_repeats)]))
    cand = found.where("size > 0").select("size", times.alias("f")).where("f is not null")
    lo, hi, before = 0.0, float(plan.max_repeats) + 1, 0
    while True:
        inside = cand.where(F.col("f").between(lo, hi))
        place = F.floor((F.col("f") - F.lit(lo)) / F.lit(max(hi - lo, 1e-300)) * HISTOGRAM)
        bins = inside.groupBy(F.least(place, F.lit(HISTOGRAM)).alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("f").alias("lo"), F.max("f").alias("hi")).orderBy("bin").collect()
        for b in bins:
            if before + b["words"] > budget:
                break
            before += b["words"]
        else:
            return math.inf
        lo, hi = b["lo"], b["hi"]
        if lo == hi:
            return lo
        if b["n"] <= LAST_LOOK:
            for f, words in cand.where(F.col("f").between(lo, hi)).groupBy("f").agg(F.sum("size")).orderBy("f").collect():
                if before + words > budget:
                    return f
                before += words


def plan_mix(docs: DataFrame, weights: list[int] | None = None, max_repeats: int = 3, seed: int = 7) -> Plan:
    """Plans a mix of ``docs`` (doc_id, text, source) whose words are as many as the documents have.

    Sources by code point, null last, get ``weights`` in turn. A finish time later than 1 + max_repeats can't be in the mix: 
    the budget is spent at 1, give or take a document of each source.
    """
    weights = weights or [1, 2, 3]
    bits = max(1, math.ceil(math.log2(max(2, docs.count() / RANGE_ROWS))))
    slim = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), _shuffled(docs, seed).alias("h"))
    rows = stash(with_positions(slim, bits).drop("h"), "mix-rows")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    by_source = Window.partitionBy("source")
    ranges = ranges.select("source", "range", (F.sum("range_size").over(by_source.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("range_size")).alias("start"), F.sum("range_size").over(by_source).alias("source_size"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stash(source_targets(sizes, weights, max_repeats), "mix-targets").alias("t")
    ranges = stash(ranges.alias("r").join(targets, F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "t.target"), "mix-ranges")
    budget = targets.agg(F.max("total")).first()[0] or 0
    plan = Plan(bits, ranges, rows, math.inf, max_repeats)
    plan.limit = _limit(plan.join(rows), plan, budget)
    return plan


def _shuffled(docs: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken (words, repeats counted) of every row."""
    plan = plan_mix(docs, **options)
    found = plan.join(plan.rows).withColumn("epochs", plan.epochs())
    return found.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 7, ordered: bool = True, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated as often as taken, range-sorted by finish time if ``ordered``."""
    plan = plan_mix(docs, seed=seed, **options)
    rows = packed(docs, docs["source"].alias("source"), word_count(docs["text"]).alias("size"), _shuffled(docs, seed).alias("h"))
    found = plan.join(with_positions(rows, plan.bits))
    times = F.filter(F.array(*[plan.finish(e) for e in range(plan.max_repeats)]), lambda f: f < F.lit(plan.limit))
    times = F.when(F.col("size") > 0, times).otherwise(F.array(F.coalesce(plan.finish(0), F.lit(0.0))))
    mixed = found.select("_row", F.explode(times).alias("_at"))
    return (mixed.orderBy("_at") if ordered else mixed).select("_row.*")
