"""Search on vectors with structure: tight clusters, a common mean, heavy norms; ids with several vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partyloom.llm import ann


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(kind, n=9000, d=32):
    rng = np.random.default_rng(1)
    if kind.startswith("clusters"):
        centres = unit(rng.normal(size=(int(kind[8:]), d)))
        return unit(centres[rng.integers(0, len(centres), n)] + 0.05 * rng.normal(size=(n, d)))
    return {
        "mean": rng.normal(size=(n, d)) + 3,
        "heavy": unit(rng.normal(size=(n, d))) * rng.pareto(2.0, (n, 1)).clip(0.01),
        "none": unit(rng.normal(size=(n, d))),
        "narrow": np.r_[unit(rng.normal(size=(1, 16))) + 0.05 * rng.normal(size=(4000, 16)), rng.normal(size=(1012, 16))],
    }[kind]


def frame(spark, ids, x):
    rows = [(int(i), v) for i, v in zip(ids, x.tolist(), strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("kind", ["clusters5", "clusters50", "clusters500", "mean", "heavy", "none", "narrow"])
def test_recall(spark, kind):
    x = vectors(kind).astype(np.float32)
    rows = ann.search(frame(spark, range(len(x)), x), F.col("id") % 40 == 0).toPandas()
    got, y, met, total = rows.groupby("query_id")["id"].agg(set), x.astype(np.float64), 0, 0
    for q in range(0, len(x), 40):
        score = y @ y[q]
        score[q] = -np.inf
        met, total = met + len(set(np.argpartition(-score, 20)[:20].tolist()) & got[q]), total + 20
    assert len(rows) == total and met / total >= 0.95


@pytest.mark.parametrize("lists", [1, 40])
def test_ids_with_several_vectors(spark, monkeypatch, lists):
    """Id 0 stands on a third of all rows, with other vectors each time; every query still gets its 20 of others."""
    monkeypatch.setattr(ann, "LIST_ROWS", 900 // lists)
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(900, 8))).astype(np.float32)
    x[:300] = (unit(np.ones((1, 8))) * 3 + 0.01 * rng.normal(size=(300, 8))).astype(np.float32)
    ids = np.r_[np.zeros(300, int), np.arange(1, 601)]
    x[300] = x[0]  # id 1 shares a vector with id 0
    rows = ann.search(frame(spark, ids, x), F.col("id") % 300 == 0).toPandas()
    y = x.astype(np.float64)
    assert rows[rows.query_id == 0]["rank"].value_counts().to_dict() == dict.fromkeys(range(1, 21), 300)  # each row asks
    assert not (rows.id == rows.query_id).any()
    for q in (300, 600):
        mine = rows[rows.query_id == q].sort_values("rank")
        best = sorted((y[ids != q] @ y[ids == q][0]).tolist(), reverse=True)[:20]
        assert len(mine) == 20 and len(set(np.round(mine.score, 9)) & set(np.round(best, 9))) >= 15


def test_lists_of_few_vectors_are_topped_up(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 2)
    x = unit(np.random.default_rng(4).normal(size=(60, 4))).astype(np.float32)
    rows = ann.search(frame(spark, range(60), x), F.col("id") % 20 == 0).toPandas()
    assert rows.groupby("query_id").size().to_dict() == {0: 20, 20: 20, 40: 20}
