"""The nearest rows over more than one pile, against every pair, with ties and odd vectors."""

import numpy as np

from sedimill.operators import registry
from sedimill.operators.registry import Context


def test_nearest_of_all_pairs_with_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 7)).astype(np.float32)
    x = np.concatenate([x, x, x, x])  # each vector four times: ties go to the smaller id, whatever the pile
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)] + [(600, None), (601, [float("nan")] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = registry.get("encode_and_get_nearest_mapper").apply(frame, Context(id_col="vec_id"), k=6, block=16).collect()
    s = np.zeros((600, 600))
    for j in range(7):
        s += x[:, None, j].astype(float) * x[None, :, j]
    np.fill_diagonal(s, -np.inf)
    want = {i: np.lexsort((np.arange(600), -s[i]))[:6].tolist() for i in range(600)}
    assert {r["vec_id"]: r["nn_indices"] for r in got} == want | {600: None, 601: None}
    assert all(r["nn_scores"] == s[r["vec_id"], r["nn_indices"]].tolist() for r in got if r["nn_indices"])
