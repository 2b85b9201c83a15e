"""Products of sparse rows, column by column, against matrices."""

import numpy as np
from pyspark.ml.linalg import Vectors

from textpulse.operators import svd


def test_a_product_follows_the_values_of_sparse_rows(spark, monkeypatch):
    monkeypatch.setattr(svd, "SPARSE_ROWS", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 30)) * (rng.random((50, 30)) < 0.1)
    x[::9] = 0
    data = [(Vectors.sparse(30, {int(j): float(r[j]) for j in np.flatnonzero(r)}),) for r in x] + [(Vectors.dense(x[1]),)]
    basis = rng.normal(size=(30, 4))
    x = np.concatenate((x, x[1:2]))
    assert np.allclose(svd.through(spark.createDataFrame(data, ["features"]).repartition(3), basis, 30), x.T @ (x @ basis))
