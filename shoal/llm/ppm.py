"""Language-model scoring by prediction by partial matching (PPM), beside a unigram base.

The model is a trie over all 256 bytes and a text's end, pretrained on the documents that aren't held out, with contexts of up to five symbols that run on across words
and an escape from each to the next shorter one, down to none (``contexts.py``). A document's score is the sum of its paths' scores: of the most
frequent paths by a broadcast of HOT_PATHS paths, of the others by a join.

The base gives a token log10((c + 0.5) / (N + 0.5 (V + 1))); words' counts come to documents in the same way, by a broadcast of HOT_WORDS words of at most HOT_BYTES
bytes and a join.

Given ``range_words``, documents are scored by the other model of this module instead, words by themselves (no query uses it). Its contexts are
everything back to a word's beginning, however long, and no more; the text's end is an empty word. So the trie has a
node for every beginning of every training word, and grows with the corpus: it is never in one place, but computed in ranges of sorted words.
In a context with n symbols seen, q of them distinct, a seen symbol has probability c / (n + q), and escape q / (n + q)
(method C). Escape is to the context of the last two symbols, then of one and of none, with counts of all training words, and last to equal shares.
After an escape, the symbols of the longer context are excluded from the shorter one. A context that was never seen is passed by.
The short contexts have 257**3 symbols at most, whatever the corpus: a proven bound, so their code lengths are one table (34 MB) that may
be broadcast. The code length of a word depends on the word alone, so each distinct word is scored once:

1. Words are counted, of all documents: in training (n) and in all (m).
2. They are range-partitioned and sorted, so that the words below a node stand together; ranges have about ``range_words`` words. Only beginnings of a range's
   first and last word may have words in other ranges: their counts are summed over the ranges by key.
3. Each range is scored on its own, with the sums for those nodes.

Defined cases: null text is empty (an end only); a null doc_id counts as training; repeated rows count and are scored each; with no
training text every token has c = 0 and symbols have equal shares; texts of any length are whole and one sum; words and paths
that tie in frequency are scored alike wherever their counts are looked up; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64

from shoal.llm.common import fresh_path, kept, map_arrow, slices, stash, texts_of
from shoal.llm.contexts import Lookup, count_paths, paths_of, score_paths

#: Bytes and a word's end, which also stands for what is before a word.
SYMBOLS, END = 257, 256
#: Distinct words in a range, about.
RANGE_WORDS = 200_000
#: Words in the broadcast part of the vocabulary, and bytes of a word there, at most.
HOT_WORDS, HOT_BYTES = 1 << 17, 64
#: Paths in the broadcast part of the trie, at most.
HOT_PATHS = 1 << 20
#: Bytes of text that a scorer or counter works on at once.
SLICE = 2 << 20
#: Bytes of text whose words are counted together before they are sent.
COMBINED = 32 << 20
#: Code lengths of the short contexts are shipped in this part of a decimal digit.
STEP = 2048


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts as a dictionary array, and how many words each text has."""
    lowered = pa.array([t.lower() for t in texts], pa.large_binary()).cast(pa.large_string(), safe=False)
    lists = pc.ascii_split_whitespace(lowered)
    flat, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(pc.binary_length(flat), 0)
    of = of[full.to_numpy(zero_copy_only=False)]
    return flat.filter(full).dictionary_encode(), np.bincount(of, minlength=len(texts))


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes), n (in training), m (in all). The empty word is the text's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, held, size = np.zeros(2, np.int64), [], 0

        def sums() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum"), ("m", "sum")])
            for b in t.to_batches():
                yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n_sum"), b.column("m_sum")], ["word", "n", "m"])

        for batch in batches:
            texts, train = texts_of(batch), ~batch.column(1).to_numpy(zero_copy_only=False)
            ends += [train.sum(), len(texts)]
            for lo, hi in slices(texts, SLICE):
                words, sizes = words_of(texts[lo:hi])
                at, width = words.indices.to_numpy(), len(words.dictionary)
                n = np.bincount(at, np.repeat(train[lo:hi], sizes), width).astype(np.int64)
                held.append(pa.table({"word": words.dictionary.cast(pa.large_binary()).cast(pa.binary()), "n": n, "m": np.bincount(at, minlength=width)}))
            size += batch.nbytes
            if held and size > COMBINED:
                yield from sums()
                held, size = [], 0
        if held:
            yield from sums()
        yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([int(ends[0])]), pa.array([int(ends[1])])], ["word", "n", "m"])

    rows = docs.select(docs["text"].cast("binary").alias("text"), held_out(docs["doc_id"]).alias("held_out"))
    return map_arrow(rows, run, "word binary, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


class Sorted:
    """Words in the order of their bytes, each once: bytes of all, where each begins, lengths, counts, and how many first bytes each shares with the one before."""

    def __init__(self, words: pa.Array, n: np.ndarray):
        order = pc.sort_indices(words)
        words, self.n = words.take(order), n[order.to_numpy()].astype(np.float64)
        self.words = words
        self.length = pc.binary_length(words).to_numpy().astype(np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(words.to_pylist()), np.uint8).astype(np.int64)
        self.shared = self._shared()
        #: The longest beginning that a word has in common with a neighbour.
        self.reach = np.maximum(self.shared, np.append(self.shared[1:], 0)) if len(self) else self.shared
        if len(self):
            self.reach[0] = self.shared[1] if len(self) > 1 else -1

    def __len__(self) -> int:
        return len(self.length)

    def _shared(self) -> np.ndarray:
        out, least = np.zeros(len(self), np.int64), np.minimum(self.length, np.append(0, self.length[:-1]))
        rows, d = np.arange(1, len(self)), 0
        while len(rows):
            rows = rows[least[rows] > d]
            rows = rows[self.data[self.start[rows] + d] == self.data[self.start[rows - 1] + d]]
            out[rows] += 1
            d += 1
        if len(self):
            out[0] = -1
        return out

    def symbol(self, rows: np.ndarray, d: int) -> np.ndarray:
        """The symbol after the first d bytes of words that have so many."""
        out = np.full(len(rows), END)
        if d >= 0:
            inside = self.length[rows] > d
            out[inside] = self.data[self.start[rows[inside]] + d]
        return out

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth: the words that share their first ``depth`` bytes with a neighbour, their next symbols, and where (among them) nodes and
        children of nodes begin."""
        rows, d = np.arange(len(self)), 0
        while len(rows := rows[self.reach[rows] >= d]):
            yield d, rows, self.symbol(rows, d), np.flatnonzero(self.shared[rows] < d), np.flatnonzero(self.shared[rows] <= d)
            d += 1


def beginnings(word: bytes) -> list[int]:
    """A key (signed 64 bits) of each beginning of the word, the empty one first."""
    h, out = xxh3_64(), [xxh3_64(b"").intdigest()]
    for i in range(len(word)):
        h.update(word[i : i + 1])
        out.append(h.intdigest())
    return [k - (1 << 64) if k >> 63 else k for k in out]


def edge_nodes(words: Sorted) -> dict[tuple[int, int], int]:
    """(key, symbol) to count of the nodes that other ranges may have words below too: the beginnings of the first and the last word. A node whose
    words have no counts is there with count 0."""
    out: dict[tuple[int, int], int] = {}
    ends = sorted({0, len(words) - 1})
    keys = {i: beginnings(words.words[i].as_py()) for i in ends}
    for i in ends:
        own = words.words[i].as_py()
        for d in range(words.reach[i] + 1, len(own) + 1):  # alone in the range
            out[keys[i][d], own[d] if d < len(own) else END] = int(words.n[i])
    for d, rows, symbols, nodes, children in words.levels():
        sums, of = np.add.reduceat(words.n[rows], children), np.searchsorted(nodes, children, "right") - 1
        for i in ends:
            at = np.searchsorted(rows, i)
            if at < len(rows) and rows[at] == i:
                for c in np.flatnonzero(of == np.searchsorted(nodes, at, "right") - 1):
                    out[keys[i][d], int(symbols[children[c]])] = int(sums[c])
    return out


class Short:
    """Probabilities (log10) of a symbol after the last two."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __call__(self, a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
        return self.table[(a * SYMBOLS + b) * SYMBOLS + s] / -STEP


def word_scores(words: Sorted, edges: dict[int, dict[int, int]], short: Short) -> np.ndarray:
    """log10 probability of each word. ``edges``: counts of all ranges, by key and symbol, of the nodes that ``edge_nodes`` lists."""
    score = np.zeros(len(words))
    last = len(words) - 1
    keys = {i: beginnings(words.words[i].as_py()) for i in {0, last}}
    for d, rows, symbols, nodes, children in words.levels():
        a, b = words.symbol(rows, d - 2), words.symbol(rows, d - 1)
        below = short(a, b, symbols)
        count = np.add.reduceat(words.n[rows], children)
        of = np.searchsorted(nodes, children, "right") - 1  # node of each child
        total = np.bincount(of, count, len(nodes))
        distinct = np.bincount(of, count > 0, len(nodes))
        mass = np.bincount(of, np.where(count > 0, 10.0 ** below[children], 0), len(nodes))
        for i, node in ((0, 0), (last, len(nodes) - 1)):
            if rows[0 if i == 0 else -1] == i:
                seen = {s: n for s, n in edges[keys[i][d]].items() if n > 0}
                total[node], distinct[node] = sum(seen.values()), len(seen)
                at = np.full(len(seen), a[nodes[node]]), np.full(len(seen), b[nodes[node]])
                mass[node] = (10.0 ** short(*at, np.array([*seen], np.int64))).sum()
                own = of == node
                count[own] = [seen.get(int(s), 0) for s in symbols[children[own]]]
        place = np.searchsorted(children, np.arange(len(rows)), "right") - 1  # child of each word
        score[rows] += symbol_scores(count[place], *(x[of[place]] for x in (total, distinct, mass)), below)
    # what is left of a word that no other of the range shares
    inner = np.arange(len(words))
    inner = inner[(inner != 0) & (inner != last)]
    first, known = words.reach[inner] + 1, words.n[inner] > 0
    score[inner[known]] += ((words.length[inner] + 1 - first) * np.log10(words.n[inner] / (words.n[inner] + 1), where=known, out=np.zeros(len(inner))))[known]
    rows, first = inner[~known], first[~known]
    sizes = words.length[rows] + 1 - first
    rows, d = np.repeat(rows, sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)

    def symbol(at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), END)
        inside = (at >= 0) & (at < words.length[rows])
        out[inside] = words.data[words.start[rows[inside]] + at[inside]]
        return out

    score += np.bincount(rows, short(symbol(d - 2), symbol(d - 1), symbol(d)), len(words))
    for i in {0, last}:
        own = [END, END, *words.words[i].as_py(), END]
        for d in range(int(words.reach[i]) + 1, len(own) - 2):
            seen = {s: n for s, n in edges[keys[i][d]].items() if n > 0}
            a, b, s = own[d : d + 3]
            one = lambda s: np.array([s])
            mass = sum(10.0 ** short(one(a), one(b), one(x))[0] for x in seen)
            score[i] += symbol_scores(*map(one, (seen.get(s, 0), sum(seen.values()), len(seen), mass)), short(one(a), one(b), one(s)))[0]
    return score


def symbol_scores(count: np.ndarray, total: np.ndarray, distinct: np.ndarray, mass: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log10 probability of symbols by their counts in a context, its counts, and their probabilities in the shorter one. ``mass``: what symbols seen in the context have
    there, which an escape excludes."""
    escapes = np.where(distinct == SYMBOLS, 0, distinct)
    whole = np.maximum(total + escapes, 1)
    escaped = np.log10(np.maximum(escapes, 1) / whole) + below - np.log10(np.maximum(1 - mass, 1e-9))
    return np.where(count > 0, np.log10(np.maximum(count, 1) / whole), np.where(total > 0, escaped, below))


def short_counts(words: DataFrame) -> DataFrame:
    """edge, n: training counts of symbols after the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate([f for f, _ in held]), return_inverse=True)
            return found, np.bincount(at, np.concatenate([n for _, n in held]))

        for batch in batches:
            texts, n = texts_of(batch, "word"), batch.column(1).to_numpy().astype(np.float64)
            for lo, hi in slices(texts, SLICE):
                sizes = np.array([len(t) for t in texts[lo:hi]]) + 3  # a word stands between two borders before it and its end
                symbols, inside = np.full(sizes.sum(), END, np.int32), np.ones(sizes.sum(), bool)
                starts = np.cumsum(sizes) - sizes
                for k in (starts, starts + 1, starts + sizes - 1):
                    inside[k] = False
                symbols[inside] = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
                edges = (symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:]
                keep = np.ones(len(symbols), bool)  # a border is no symbol to predict
                keep[starts], keep[starts + 1] = False, False
                found, at = np.unique(edges[keep[2:]], return_inverse=True)
                held.append((found, np.bincount(at, np.repeat(n[lo:hi], sizes - 2))))
                if len(held) > 16:
                    held = [summed()]
        if held:
            found, n = summed()
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], ["edge", "n"])

    return map_arrow(words.where("n > 0").select("word", "n"), run, "edge int, n long").groupBy("edge").agg(F.sum("n").alias("n"))


def short_table(edges: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Code length, in 1 / STEP of a digit, of each (two symbols, symbol): escapes and exclusions worked in."""
    counts = np.zeros(SYMBOLS**3, np.float32)
    counts[edges] = n
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = counts.sum(0, dtype=np.float64)
    root = one.sum(0)

    def level(c: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probabilities in contexts of counts c; ``below``: in the shorter ones."""
        seen = c > 0
        total, distinct = c.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
        escapes = np.where(distinct == SYMBOLS, 0, distinct)
        whole = np.maximum(total + escapes, 1)
        left = np.maximum(1 - np.where(seen, below, 0).sum(-1, keepdims=True), 1e-9)
        return np.where(seen, c / whole, np.where(total > 0, escapes / whole, 1) * below / np.where(total > 0, left, 1))

    p0 = level(root, np.full(SYMBOLS, 1 / SYMBOLS))
    p1 = level(one, p0)
    table = np.empty(counts.shape, np.uint16)
    for a in range(SYMBOLS):
        table[a] = np.rint(np.log10(np.maximum(level(counts[a].astype(np.float64), p1), 1e-30)) * -STEP)
    return table.reshape(-1)


def score_words(counted: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """word, n, m, score of every distinct word (word, n, m)."""
    spark = counted.sparkSession
    found = short_counts(counted).toArrow()  # SYMBOLS ** 3 rows at most
    shipped = spark.sparkContext.broadcast(short_table(found["edge"].to_numpy(), found["n"].to_numpy()))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() // range_words))
    rows = "kind byte, word binary, n long, m long, key long, symbol int"
    kinds = pa.schema([("kind", pa.int8()), ("word", pa.binary()), ("n", pa.int64()), ("m", pa.int64()), ("key", pa.int64()), ("symbol", pa.int32())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The range's words, and the counts of its first and last words' beginnings."""
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        held = pa.Table.from_batches(given).combine_chunks()
        for b in held.to_batches():
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(b.num_rows, np.int8)), *b.columns, none, none.cast(pa.int32())], schema=kinds)
        edges = edge_nodes(Sorted(_whole(held["word"]), held["n"].to_numpy()))
        keys, symbols = zip(*edges)
        none = pa.nulls(len(edges), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(edges), np.int8)), pa.nulls(len(edges), pa.binary()), pa.array([*edges.values()], pa.int64()), none, pa.array(keys, pa.int64()), pa.array(symbols, pa.int32())], schema=kinds)

    ranged = map_arrow(counted.select("word", "n", "m").repartitionByRange(ranges, "word"), gather, rows)
    ranged = stash(ranged.withColumn("range", F.spark_partition_id()), "ppm-ranges")
    own = ranged.where("kind = 1").select("range", "key", "symbol", "n")
    sums = own.groupBy("key", "symbol").agg(F.sum("n").alias("n"))
    needed = own.select("range", "key").distinct().join(sums, "key")  # the beginnings of two words for each range
    none = lambda kind: F.lit(None).cast(kind)
    needed = needed.select(F.lit(1).cast("byte").alias("kind"), none("binary").alias("word"), "n", none("long").alias("m"), "key", "symbol", "range")
    both = ranged.where("kind = 0").unionByName(needed)

    def score(group: pa.Table) -> pa.Table:
        is_word = pc.equal(group["kind"], 0)
        mine, sums, edges = group.filter(is_word), group.filter(pc.invert(is_word)), {}
        for key, symbol, n in zip(sums["key"].to_pylist(), sums["symbol"].to_pylist(), sums["n"].to_pylist()):
            edges.setdefault(key, {})[symbol] = n
        order = Sorted(_whole(mine["word"]), mine["n"].to_numpy())
        mine = mine.take(pc.sort_indices(_whole(mine["word"])))
        return pa.table({"word": mine["word"], "n": mine["n"], "m": mine["m"], "score": word_scores(order, edges, Short(shipped.value))})

    return both.groupBy("range").applyInArrow(score, "word binary, n long, m long, score double")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out.chunk(0) if isinstance(out, pa.ChunkedArray) else out


def least_count(counted: DataFrame, most: int) -> int | None:
    """The least count m for which no more than ``most`` rows have so many or more; None if there is none."""
    groups = counted.groupBy("m").count().orderBy(F.desc("m")).limit(most).toArrow()
    fit = int(np.searchsorted(np.cumsum(groups["count"].to_numpy()), most, "right"))
    return groups["m"][fit - 1].as_py() if fit else None


def score_documents(docs: DataFrame, range_words: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text)."""
    spark, by_paths = docs.sparkSession, range_words is None
    counted = stash(count_words(docs), "ppm-counts")
    train, vocabulary = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0))).first()
    words = counted.withColumn("score", F.lit(0.0)) if by_paths else stash(score_words(counted, range_words), "ppm-words")
    words = words.withColumn("base", F.log10(F.col("n") + F.lit(0.5)))

    short = (F.octet_length("word") <= HOT_BYTES) & (F.octet_length("word") > 0)
    floor = least_count(words.where(short), HOT_WORDS)
    is_hot = F.lit(False) if floor is None else short & (F.col("m") >= floor)
    hot = words.where(is_hot).select(F.col("word").cast("string").alias("word"), "n", "base", "score").toArrow()
    numbers = np.zeros((3, hot.num_rows + 1))  # the last: words that aren't there
    for row, name in enumerate(("base", "score", "n")):
        numbers[row, :-1] = hot[name].to_numpy()
    shipped = spark.sparkContext.broadcast((_whole(hot["word"]), numbers[0], numbers[1], numbers[2] > 0))
    end = words.where(F.octet_length("word") == 0).select("n", "base", "score").first() or {"n": 0, "base": 0.0, "score": 0.0}
    per_token = float(np.log10(train + 0.5 * (vocabulary + 1)))

    if by_paths:
        paths = stash(score_paths(stash(count_paths(docs, held_out(docs["doc_id"])), "ppm-paths")), "ppm-path-scores")
        floor = least_count(paths, HOT_PATHS)
        is_frequent = F.lit(False) if floor is None else F.col("m") >= floor
        frequent = paths.where(is_frequent).select("path", "score").toArrow()
        trie = spark.sparkContext.broadcast((frequent["path"].to_numpy(), frequent["score"].to_numpy()))
        model = fresh_path(spark, "ppm-trie")  # a name that no other run has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, base, score, known = shipped.value
        lookup = kept(model, lambda: Lookup(*trie.value)) if by_paths else None
        for batch in batches:
            texts = texts_of(batch)
            for lo, hi in slices(texts, SLICE):
                words, sizes = words_of(texts[lo:hi])
                of_text = np.repeat(np.arange(hi - lo), sizes)
                place = pc.index_in(words.dictionary.cast(pa.string()), hot_words).fill_null(-1).to_numpy()[words.indices.to_numpy()]
                cold = np.flatnonzero(place < 0)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.bincount(of_text[cold], minlength=hi - lo)]), pa.int32()), words.take(pa.array(cold)).dictionary_decode().cast(pa.string()))
                sums = [np.bincount(of_text, x[place], hi - lo) for x in (known, base, score)]
                rare, of_rare = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for path, of_path in paths_of(texts[lo:hi]) if by_paths else ():
                    found, missing = lookup(path)
                    sums[2] += np.bincount(of_path, found, hi - lo)
                    rare.append(path[missing])
                    of_rare.append(of_path[missing])
                rare_lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *np.bincount(np.concatenate(of_rare), minlength=hi - lo)]), pa.int32()), pa.array(np.concatenate(rare)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), *map(pa.array, sums), lists, rare_lists], ["doc_id", "held_out", "n_words", "n_hot", "hot_base", "hot_score", "cold", "rare"])
            pa.default_memory_pool().release_unused()

    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("binary").alias("text"))
    rows = map_arrow(rows, run, "doc_id long, held_out boolean, n_words long, n_hot double, hot_base double, hot_score double, cold array<string>, rare array<long>")
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "ppm-scores")  # row numbers hold once they are written
    others = words.where(~is_hot).select(F.col("word").cast("string").alias("word"), "n", "base", "score")
    cold = rows.select("row", F.explode("cold").alias("word")).groupBy("word", "row").agg(F.count("*").alias("times"))
    cold = cold.join(others, "word").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_cold"),
        F.sum(F.col("times") * F.col("base")).alias("cold_base"),
        F.sum(F.col("times") * F.col("score")).alias("cold_score"),
    )
    out = rows.drop("cold", "rare").join(cold, "row", "left")
    n_tokens, none = F.col("n_words") + 1, F.lit(0.0)
    score = F.col("hot_score") + F.coalesce("cold_score", none) + F.lit(end["score"])
    if by_paths:
        rare = rows.select("row", F.explode("rare").alias("path")).groupBy("path", "row").agg(F.count("*").alias("times"))
        rare = rare.join(paths.where(~is_frequent), "path").groupBy("row").agg(F.sum(F.col("times") * F.col("score")).alias("rare_score"))
        out, score = out.join(rare, "row", "left"), score + F.coalesce("rare_score", none)
    return out.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("n_hot") + F.coalesce("n_cold", F.lit(0)) + int(end["n"] > 0)).cast("long").alias("n_known"),
        F.lit(int(train)).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("cold_base", none) + F.lit(end["base"]) - n_tokens * F.lit(per_token)).alias("base_score"),
        score.alias("score"),
    )
