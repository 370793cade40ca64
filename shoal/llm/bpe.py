"""Byte-level BPE encoding and decoding.

A pre-token is a doubly linked list of symbols; a priority queue holds the ranks of the pairs that can be merged.
The least (rank, position) is taken; an entry whose pair is no longer there is stale and skipped; a merge links the list
past its right symbol and queues the two pairs it makes. Decoding concatenates vocabulary strings.

Pre-tokens recur, so each worker keeps those it has merged, and forgets them all when it holds too many; this changes no result.

Defined cases: null text is empty and has no ids; the strings of special tokens are their ids; repeated rows each
give their own row; bytes that are no UTF-8 decode to U+FFFD; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import kept, map_arrow, packed, texts_of

#: Unicode's white space; fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-token pattern of byte-level tokenizers; fixed values.
PRE_TOKEN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pre-tokens a worker remembers.
REMEMBERED = 300_000
#: Ids in an output batch, about.
BATCH_IDS = 500_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizer(dict):
    """From a tokenizer's JSON. As a dict it holds the ids of the pre-tokens met, and merges one when it is first asked for."""

    def __init__(self, text: str):
        super().__init__()
        spec = json.loads(text)
        vocab, of = spec["model"]["vocab"], byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.strings[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.numerals = [str(i) for i in range(len(self.strings))]
        self.symbol = [0] * 256
        for c, b in of.items():
            self.symbol[b] = vocab[c]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.pattern = regex.compile(PRE_TOKEN)
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.merge([self.symbol[b] for b in word.encode()])
        self[word] = ids
        return ids

    def merge(self, symbols: list[int]) -> list[int]:
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(m[0], i) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j < 0:
                continue
            found = merges.get((symbols[i], symbols[j]))
            if not found or found[0] != rank:
                continue  # stale
            symbols[i], symbols[j], after[i] = found[1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := merges.get((found[1], symbols[after[j]])):
                    heapq.heappush(queue, (m[0], i))
            if before[i] >= 0 and (m := merges.get((symbols[before[i]], found[1]))):
                heapq.heappush(queue, (m[0], before[i]))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        if not self.at_special or not self.at_special.search(text):
            return list(chain.from_iterable(map(self.__getitem__, self.pattern.findall(text))))
        ids, end = [], 0
        for m in self.at_special.finditer(text):
            ids += chain.from_iterable(map(self.__getitem__, self.pattern.findall(text[end : m.start()])))
            ids.append(self.special[m[0]])
            end = m.end()
        return ids + list(chain.from_iterable(map(self.__getitem__, self.pattern.findall(text[end:]))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def tokenizer(text: str) -> Tokenizer:
    """One tokenizer a worker."""
    return kept(("bpe", hashlib.sha256(text.encode()).hexdigest()), lambda: Tokenizer(text))


def _shipped(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` in a struct ``_row``, with ``ids`` and ``exact`` (decoding gives the text again).

    ``path``: the tokenizer's JSON on the driver; the executors get it by broadcast (a file of a few MB).
    """
    spec, rows = _shipped(docs, path), packed(docs, F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec.value)

        def out(lo, hi, ids, sizes, exact):
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
            return pa.RecordBatch.from_arrays([row.slice(lo, hi - lo), lists, pa.array(exact, pa.bool_())], ["_row", "ids", "exact"])

        for batch in batches:
            row, lo, ids, exact, held = batch.column(0), 0, [], [], 0
            for k, b in enumerate(texts_of(batch)):
                text = b.decode("utf-8", "replace")
                got = t.encode(text)
                ids.append(np.array(got, np.int32))
                exact.append(t.decode(got) == text)
                held += len(got)
                if held >= BATCH_IDS:
                    yield out(lo, k + 1, ids, map(len, ids), exact)
                    lo, ids, exact, held = k + 1, [], [], 0
            yield out(lo, batch.num_rows, ids, map(len, ids), exact)

    return map_arrow(rows, run, f"_row {rows.schema['_row'].dataType.simpleString()}, ids array<int>, exact boolean")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 of every row: digests where ids need not move."""
    spec = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(spec.value)
        for batch in batches:
            rows = []
            for b in texts_of(batch):
                ids = t.encode(b.decode("utf-8", "replace"))
                listed = ",".join(map(t.numerals.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(t.decode(ids).encode()).hexdigest()))
            columns = [*zip(*rows)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
