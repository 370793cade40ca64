"""Licence scans with a positional index of rare tokens.

Each licence template is a run of words. The index lists, for each template word, the templates and positions where it
stands. In a file, its highest-IDF licence words (IDF over all scanned documents) are looked up; each occurrence votes for
the starts at which a template would put that word there, and starts on which enough different rare words agree are
candidates. A candidate is verified: its mandatory key phrases must stand in the file where the template has them,
and its score is the share of template words found in place.

Base phrases are found beside that in the same word positions, every place of each.

Defined cases: null text has no words; an empty file has no labels and score 0; a phrase may overlap another; repeated rows are
scanned each; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import map_arrow, texts_of

#: Phrases whose every place is counted, and their labels; fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # phrases of the text that must be in place


#: Well-known licence notices: label, words, mandatory phrases; fixed values.
TEMPLATES = (
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2", "in compliance with the license")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    Template("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)

#: A-Z to a-z; 0-9, a-z and all bytes above ASCII stay; the rest separates words.
_KEEP = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def _split(phrase: str) -> list[bytes]:
    return phrase.encode().split()


class Index:
    """Positional postings of the templates' words, with the words' IDF."""

    def __init__(self, idf: dict[bytes, float], templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, rare: int = 6, agree: float = 0.5, least: float = 0.6):
        self.idf, self.rare, self.agree, self.least = idf, rare, agree, least
        self.words = [_split(t.text) for t in templates]
        self.labels = [t.label for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.keys: list[list[tuple[int, list[bytes]]]] = []
        for t, (template, words) in enumerate(zip(templates, self.words)):
            for p, w in enumerate(words):
                self.postings[w].append((t, p))
            self.keys.append([(next(p for p in range(len(words)) if words[p : p + len(k)] == k), k) for k in map(_split, template.keys)])
        #: Rare words of each template, as many as a file's look-up takes
        self.own = [set(sorted(set(w), key=self.rank)[:rare]) for w in self.words]
        self.base = defaultdict(list)
        for phrase, label in base.items():
            self.base[_split(phrase)[0]].append((_split(phrase), label))

    def rank(self, word: bytes) -> tuple[float, bytes]:
        return -self.idf.get(word, 0.0), word

    def base_places(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, str]]:
        return sorted((p, label) for first, phrases in self.base.items() if first in places for phrase, label in phrases for p in places[first] if words[p : p + len(phrase)] == phrase)

    def matches(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[str, int, float]]:
        """label, start and score of every verified template."""
        # a template is looked up by its own rarest words: the file's highest-IDF licence words as far as that template goes
        votes: Counter[tuple[int, int]] = Counter()
        for w in sorted(places, key=self.rank):
            for t, q in self.postings[w]:
                if w in self.own[t]:
                    votes.update((t, p - q) for p in places[w])
        out = []
        for (t, start), n in sorted(votes.items()):
            if n < max(1, math.ceil(self.agree * len(self.own[t]))):
                continue
            if all(start + p >= 0 and words[start + p : start + p + len(k)] == k for p, k in self.keys[t]):
                template = self.words[t]
                score = sum(0 <= start + p < len(words) and words[start + p] == w for p, w in enumerate(template)) / len(template)
                if score >= self.least:
                    out.append((self.labels[t], start, score))
        return out

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, float]]]:
        words = words_of(text)
        places: dict[bytes, list[int]] = {}
        known = self.postings.keys() | self.base.keys()
        if not known.isdisjoint(words):
            for p, w in enumerate(words):
                if w in known:
                    places.setdefault(w, []).append(p)
        own = {w: p for w, p in places.items() if w in self.postings}
        return len(words), self.base_places(words, places), self.matches(words, own)


def licence_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, float]:
    """IDF over all documents of the templates' words: a few hundred counts, whatever the corpus."""
    vocabulary = {w for t in templates for w in _split(t.text)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in batches:
            for text in texts_of(batch):
                n += 1
                found.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([b"", *found], pa.binary()), pa.array([n, *found.values()], pa.int64())], ["word", "n"])

    counted = map_arrow(docs.select(F.col("text").cast("binary").alias("text")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r["word"]): r["n"] for r in counted.collect()}
    n = counts.get(b"", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def scan_licences(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, **options) -> DataFrame:
    """doc_id, n_words, base (place, label of each), found (label, place, score of each verified template)."""
    idf = licence_idf(docs, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf, templates, **options)
        base_type = pa.list_(pa.struct([("place", pa.int64()), ("label", pa.string())]))
        found_type = pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            n, base, found = [], [], []
            for text in texts_of(batch):
                k, b, f = index.scan(text)
                n.append(k)
                base.append([{"place": p, "label": label} for p, label in b])
                found.append([{"label": label, "place": p, "score": s} for label, p, s in f])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, base_type), pa.array(found, found_type)], ["doc_id", "n_words", "base", "found"])

    schema = "doc_id long, n_words long, base array<struct<place:long,label:string>>, found array<struct<label:string,place:long,score:double>>"
    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, schema)


def licence_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document, of what ``scan_licences`` finds."""
    found = scan_licences(docs, **options)
    base_labels = F.col("base.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.place").alias("first_word"),
        F.array_max("base.place").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("found.label"))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("found.score"), F.lit(0.0))).alias("score"),
    )
