import numpy as np

from strandline.llm import boosting, quality
from tests.conftest import SF


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_trees_learn_and_flat_prediction_matches_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert auc(y[2000:], trees.predict(x[2000:])) > 0.93

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total

    assert np.allclose(trees.margin(x[:50]), [walk(r) for r in x[:50]])


def test_score(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    got = quality.score(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.95
    assert (got.predicted == (got.score >= 0.7)).all() and got.score.between(0, 1).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (None, "", 1.0), (1, "x y", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 3 and all(r.score == 0.5 and r.predicted == 0 for r in got)
    assert quality.score(docs.limit(0), labels).collect() == []
