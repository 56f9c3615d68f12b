"""Every item is scored with every named text."""

import numpy as np

from curaspark.operators import search as S


def test_text_scores_of_all_items(spark):
    rng = np.random.default_rng(1)
    x, t = rng.normal(size=(30, 5)), rng.normal(size=(4, 5))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    texts = spark.createDataFrame([(f"t{k}", v.tolist()) for k, v in enumerate(t)], "name string, w array<double>")
    want = (x / np.linalg.norm(x, axis=1)[:, None]) @ (t / np.linalg.norm(t, axis=1)[:, None]).T
    found = {(r["id"], r["text"]): r["score"] for r in S.text_scores(items, "id", "v", texts, "name", "w").collect()}
    assert len(found) == 120
    assert all(abs(found[i, f"t{k}"] - want[i, k]) < 1e-12 for i in range(30) for k in range(4))
