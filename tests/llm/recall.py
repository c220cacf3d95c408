"""Recall of op8's search against brute force: python tests/llm/recall.py FOLDER (with embeddings.parquet)."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))

from partyloom.llm import queries
from partyloom.session import build_session


def main(folder: str) -> None:
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH", "")]))
    spark = build_session("local[8]", "recall", **{"spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    found = queries.op8_ann(spark, folder).toPandas()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").toPandas().dropna()
    x, ids = np.stack(rows["embedding"]).astype(np.float64), rows["vec_id"].to_numpy()
    got, hits, total = found.groupby("query_id")["vec_id"].agg(set), 0, 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[ids == ids[q]] = -np.inf
        best = set(ids[np.argpartition(-score, 20)[:20]])
        hits, total = hits + len(best & got.get(ids[q], set())), total + 20
    print(f"{len(ids)} vectors, {total // 20} queries, recall {hits / total:.4f}")


if __name__ == "__main__":
    main(sys.argv[1])
