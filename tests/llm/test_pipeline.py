import re
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shoal.llm.common import table
from shoal.llm.mixing import mix_report
from shoal.llm.quality import fit_quality, features, Shapes
from shoal.llm.toxicity import Vocabulary, fit_toxicity
from shoal.llm.linear import Rows, sigmoid

SF = "/root/testdata/sf0.001"


def whole(rows):
    return Counter(tuple(r) for r in rows)


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def one_of_each(rows):
    """Brute force: links of similarity 0.8 or more between sets of shingles; the smallest doc_id of each class."""
    sets, root = [shingles(r["text"]) for r in rows], [*range(len(rows))]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return sorted(least.values())


def test_stages_by_brute_force(spark):
    """Each stage on what the one before kept."""
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["quality", "toxicity", "near_duplicates", "mixing", "encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = {name: lambda d, f=f: spark.createDataFrame(f(spark, d, SF).collect(), f(spark, d, SF).schema) for name, f in stages}

    _, model = fit_quality(docs)
    want = []
    for r in docs.collect():
        columns, values = features((r["text"] or "").encode().split(), Shapes())
        if sigmoid(sum(model.weights[c] * v for c, v in zip(columns, values)) + model.bias) >= 0.5:
            want.append(r)
    good = step["quality"](docs)
    assert whole(good.collect()) == whole(want) and 0 < len(want) < docs.count()

    of, chain = fit_toxicity(good, table(spark, SF, "labels"))
    entries = {r: Vocabulary(of).entries((r["text"] or "").encode()) for r in good.collect()}
    want = [r for r in good.collect() if chain.predict(Rows.of([entries[r][0]], [entries[r][1]], len(of)))[0, -1] <= 0.5]
    clean = step["toxicity"](good)
    assert whole(clean.collect()) == whole(want)

    single = step["near_duplicates"](clean)
    assert sorted(r["doc_id"] for r in single.collect()) == one_of_each(clean.collect())
    assert not whole(single.collect()) - whole(clean.collect())

    mixed = step["mixing"](single)
    taken = {r["doc_id"]: r["epochs"] for r in mix_report(single).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == {i: n for i, n in taken.items() if n}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = step["encoding"](mixed).collect()
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in mixed.collect()}
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed.collect())
    assert all(r["ids"] == ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) and r["exact"] for r in encoded)
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == Counter(r["doc_id"] for r in encoded)


def test_awkward_rows(spark, awkward, clashing, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (awkward, clashing, empty):
            out = stage(spark, docs, SF)
            assert len({*out.columns}) == len(out.columns)
            assert out.columns == docs.columns or name == "encoding"
            out.count()


def test_encoding_keeps_columns_of_its_names(spark, documents):
    docs = documents((1, "a b")).withColumn("ids", F.lit("mine"))
    r = corpus_pipeline.encoding(spark, docs, SF).first()
    assert r["documents_ids"] == "mine" and len(r["ids"]) == r["n_tokens"]


def test_of_rows_that_differ_elsewhere_the_same_stays(spark, documents):
    rows = [(1, "one two three four five six", s) for s in "abc"]
    kept = {corpus_pipeline.near_duplicates(spark, documents(*order), SF).first()["source"] for order in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert len(kept) == 1
