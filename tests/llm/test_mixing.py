import pytest
from pyspark.sql import functions as F

from shoal.llm.mixing import mix_documents, mix_report


def targets(sizes, weights, most=3):
    """Share by weight; what a cap leaves is shared again."""
    total, out, left = sum(sizes.values()), {}, dict(sizes)
    while left:
        rest = total - sum(out.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = most * left.pop(s)
    return out


@pytest.fixture(scope="module")
def docs(documents):
    rows = [(i, "w " * (1 + i % 7), s) for i, s in enumerate(["a"] * 150 + ["b"] * 60 + ["c"] * 5 + [None] * 40)]
    return documents(*rows)


def test_targets_and_taken(docs):
    rows = mix_report(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    order = [s for s in ("a", "b", "c", None) if s in sizes]
    want = targets(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    for s in order:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s]) and own[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 2 * max(r["size"] for r in own)
    assert all(r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) <= sum(sizes.values())


def test_reruns_and_partitions_agree(docs):
    key = lambda d: sorted((r["doc_id"], r["taken"]) for r in mix_report(d).collect())
    assert key(docs) == key(docs.repartition(7))


def test_documents_are_repeated_as_often_as_taken(docs):
    epochs = {r["doc_id"]: r["epochs"] for r in mix_report(docs).collect()}
    got = {r["doc_id"]: r["n"] for r in mix_documents(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: v for k, v in epochs.items() if v}


def test_awkward_rows(awkward, clashing, empty):
    assert mix_report(awkward).count() == awkward.count() == mix_report(clashing).count()
    assert {r["size"] for r in mix_report(awkward).where("doc_id in (2, 3, 4)").collect()} == {0}
    assert mix_documents(clashing).columns == clashing.columns
    assert mix_report(empty).count() == 0 == mix_documents(empty).count()


def test_only_functions_of_dataframes(docs):
    plan = mix_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
