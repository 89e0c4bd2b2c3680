"""Nearest vectors by bounds against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators.rects import nearest_rows, vector_knn

rng = np.random.default_rng(3)
CASES = [
    (rng.normal(size=(40, 64)), rng.normal(size=(700, 64))),
    (np.round(rng.normal(size=(30, 2))), np.round(rng.normal(size=(500, 2)))),
    (1e6 + rng.normal(size=(20, 8)) / 1e3, 1e6 + rng.normal(size=(600, 8)) / 1e3),
    (np.ones((9, 4)), np.ones((300, 4))),
    (rng.normal(size=(5, 3)), rng.normal(size=(4, 3))),
    (np.array([[0.0, np.inf], [1, 2]]), np.array([[np.nan, 1], [1.0, 2], [3, 4]])),
]


@pytest.mark.parametrize("v, w", CASES)
@pytest.mark.parametrize("most", [1, 1 << 16])
@pytest.mark.filterwarnings("ignore")
def test_nearest_rows(v, w, most):
    found = [np.concatenate(c) for c in zip(*nearest_rows(v, w, 7, cells=2000, most=most))]
    got = [(int(r), int(c)) for r, c in zip(*found[:2])]
    want = []
    for i, x in enumerate(v):
        d = np.cumsum((w - x) ** 2, axis=1)[:, -1]
        want += [(i, int(c)) for c in np.argsort(d, kind="stable")[:7]]
    assert got == want


def test_vector_knn(spark):
    """Equal rows in any number of blocks; each pair of blocks is made once, so a row goes out as often as there are blocks."""
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(90, 3)), 1))] + [(91, None), (None, [0.0, 0.0, 0.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    a, b, c = (sorted(map(tuple, vector_knn(t, 4, rows=n).collect())) for n in (200, 30, 7))
    assert len(a) == 90 * 4 and a == b == c
    sent = vector_knn(t, 4, rows=30)._jdf.queryExecution().optimizedPlan().toString()
    assert sent.count("Generate explode") == 1
