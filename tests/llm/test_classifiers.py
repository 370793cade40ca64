from collections import Counter

import numpy as np
import pytest

from shoal.llm.linear import Rows, fit, sigmoid
from shoal.llm.quality import EXPECTED, EXPECTED_JUNK, PRIOR, label_model, score_quality
from shoal.llm.toxicity import Chain, score_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_agrees_with_labels(labelled):
    docs, labels = labelled
    r = score_quality(docs).select("_row.doc_id", "keep").join(labels, "doc_id").collect()
    junk, good = [x["keep"] for x in r if x["quality"] == 0], [x["keep"] for x in r if x["quality"] == 1]
    assert np.mean(junk) < 0.1 and np.mean(good) > 0.98


def test_toxicity_on_documents_it_has_not_seen(labelled):
    docs, labels = labelled
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    r = score_toxicity(docs, train).select("_row.doc_id", "toxic").join(test.withColumnRenamed("toxic", "y"), "doc_id").collect()
    bad, clean = [x["toxic"] for x in r if x["y"] == 1], [x["toxic"] for x in r if x["y"] == 0]
    assert np.mean(bad) > 0.6 and np.mean(clean) < 0.03


def test_label_model_weighs_labellers():
    post = label_model({"01": 80, "11": 0, "21": 820, "02": 5, "12": 95})
    assert post["01"] < 0.5 < post["21"] and label_model({}) == {}


def test_label_model_is_em_of_single_documents():
    """Brute force: the same steps, document by document, labeller by labeller."""
    rng = np.random.default_rng(1)
    docs = ["".join(str(2 if rng.random() < (0.7 if good else 0.4) else 0 if rng.random() < (0.02 if good else 0.5) else 1) for _ in range(4)) for good in rng.random(400) < 0.8]
    p = [0.1 if "0" in d else 0.95 for d in docs]
    for _ in range(100):
        says, share = [], []
        for k, w in enumerate((p, [1 - x for x in p])):
            total = sum(w) + PRIOR
            says.append([[(sum(x for x, d in zip(w, docs) if int(d[i]) == v) + PRIOR * EXPECTED[k][v]) / total for v in range(3)] for i in range(4)])
            share.append((sum(w) + PRIOR * (EXPECTED_JUNK if k else 1 - EXPECTED_JUNK)) / (len(docs) + PRIOR))
        odds = [[s * np.prod([says[k][i][int(v)] for i, v in enumerate(d) if v != "1"]) for k, s in enumerate(share)] for d in docs]
        p = [a / (a + b) for a, b in odds]
    found = label_model(dict(sorted(Counter(docs).items())))
    assert all(found[d] == pytest.approx(x, abs=1e-9) for d, x in zip(docs, p))


def test_chain_is_that_of_dense_rows():
    """Brute force: the out-of-fold probabilities and models of the definition, over dense matrices."""
    rng = np.random.default_rng(2)
    dense = (rng.random((120, 7)) < 0.4) * rng.random((120, 7))
    y = np.column_stack([dense[:, 0] + dense[:, 1] > 0.4, dense[:, 0] > 0.3]).astype(float)
    y[::9, 0] = np.nan
    folds = np.arange(120) % 5

    def logistic(a, t, steps=300, rate=0.3, l2=1e-4):
        a, w, m, v = np.column_stack([a, np.ones(len(a))]), np.zeros(a.shape[1] + 1), 0, 0
        for i in range(1, steps + 1):
            g = a.T @ (sigmoid(a @ w) - t) / len(a) + l2 * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        return lambda b: sigmoid(np.column_stack([b, np.ones(len(b))]) @ w)

    known, earlier = ~np.isnan(y[:, 0]), np.zeros(120)
    for f in range(5):
        earlier[folds == f] = logistic(dense[known & (folds != f)], y[known & (folds != f), 0])(dense[folds == f])
    first, second = logistic(dense[known], y[known, 0]), logistic(np.column_stack([dense, earlier]), y[:, 1])
    p = first(dense)
    want = np.column_stack([p, second(np.column_stack([dense, p]))])
    x = Rows.of([np.flatnonzero(r) for r in dense], [r[r > 0] for r in dense], 7)
    assert Chain.fit(["a", "b"], x, y, folds).predict(x) == pytest.approx(want, abs=1e-6)


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(0)
    n = 600
    a = rng.integers(0, 2, n)
    x = Rows.of([[0] if v else [1] for v in a], [[1.0]] * n, 2)
    c = Chain.fit(["first", "second"], x, np.column_stack([a, a]).astype(float), np.arange(n) % 5)
    p = c.predict(x)
    assert c.models[1].dense.shape == (1,) and c.models[1].dense[0] > 0 and ((p[:, 1] > 0.5) == (a == 1)).all()


def test_logistic_regression_recovers_a_rate():
    x = Rows.of([[0]] * 100, [[1.0]] * 100, 1)
    m = fit(x, np.zeros((100, 0)), np.array([1.0] * 80 + [0.0] * 20))
    assert sigmoid(m.logits(x, np.zeros((100, 0))))[0] == pytest.approx(0.8, abs=0.02)


def test_awkward_rows(spark, awkward, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, None, None), (99, 0, 1), (None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.where("doc_id > 1000")
    for docs in (awkward, clashing):
        q, t = score_quality(docs), score_toxicity(docs, labels)
        assert q.count() == docs.count() == t.count()
        assert q.select("_row.*").columns == docs.columns == t.select("_row.*").columns
    assert not any(r["toxic"] for r in score_toxicity(awkward, none).collect())
    assert score_quality(empty).count() == 0 == score_toxicity(empty, labels).count()


def test_carried_columns_change_no_result(labelled):
    docs, labels = labelled
    for score, of in ((lambda **o: score_quality(docs, **o), "score"), (lambda **o: score_toxicity(docs, labels, **o), "p")):
        whole, some = score(), score(carry=["doc_id"])
        assert some.schema["_row"].dataType.names == ["doc_id"] and whole.schema["_row"].dataType.names == docs.columns
        a, b = ({r["doc_id"]: r[of] for r in x.select("_row.doc_id", of).collect()} for x in (whole, some))
        assert a == b
