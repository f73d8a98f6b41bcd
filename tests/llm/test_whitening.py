"""Operator 12 against whole-number and dense brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lakelens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x long, n string, w double"


def brute(rows):
    """n, exact deviations by id, falling eigenvalues and vectors, trace, all from whole numbers."""
    fit = [(r.vec_id, r.embedding) for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in fit], object)
    n, s = len(x), x.sum(axis=0)
    parts = n * x - s
    cov = np.array([[int(c) / n**3 for c in row] for row in parts.T @ parts], float)
    values, vectors = np.linalg.eigh(cov)
    return n, [(i, int((p * p).sum())) for (i, _), p in zip(fit, parts, strict=True)], values[::-1], vectors[:, ::-1], cov.trace(), parts / n


def compare(got, rows, k=8):
    n, deviations, values, vectors, trace, centred = brute(rows)
    k = min(k, sum(values > 1e-9 * values[0]))
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert sorted({(r.vec_id, int(r.deviation)) for r in got}, key=str) == sorted(set(deviations), key=str)
    (error,) = {r.identity_error for r in got}
    assert error < 1e-9
    for c in range(k):
        (explained,) = {r.explained for r in got if r.component == c + 1}
        assert explained == pytest.approx(values[c] / trace, rel=1e-10)
        want = sorted(centred.astype(float) @ vectors[:, c] / math.sqrt(values[c]))
        mine = sorted(r.whitened for r in got if r.component == c + 1)
        flipped = sorted(-v for v in mine)
        assert np.allclose(mine, want, rtol=1e-8, atol=1e-9) or np.allclose(flipped, want, rtol=1e-8, atol=1e-9)


def test_whitened_equals_brute_force(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    compare(whitening.whitened(given.repartition(3)).collect(), given.collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [900, 30, 5, 1, 0.2]]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None, 1.0, 1.0, 1.0]), (62, [float("nan")] * 5), (63, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (64, []),
             (None, [1.0, 2.0, 3.0, 4.0, 5.0]), (5, [1.0, 2.0, 3.0, 4.0, 5.0]), (5, [1.0, 2.0, 3.0, 4.0, 5.0])]
    table = spark.createDataFrame([r + (1, 2, "n", 0.5) for r in rows], SCHEMA)
    compare(whitening.whitened(table).collect(), table.collect())
    assert whitening.whitened(table, components=2).where("component > 2").count() == 0
    assert whitening.whitened(table.where("vec_id >= 60")).where("vec_id > 5").count() == 0
    # nothing to fit, equal vectors alone: no component; rank one: one component
    assert whitening.whitened(table.where("false")).count() == whitening.whitened(table.where("vec_id = 60")).count() == 0
    assert whitening.whitened(table.where("vec_id is null or vec_id = 5").where("embedding[1] = 2")).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 1, 2, "n", 0.5) for i in range(9)], SCHEMA)
    compare(whitening.whitened(line).collect(), line.collect())
    with pytest.raises(Exception, match="differ in length"):
        whitening.whitened(line.union(table)).collect()


def test_large_deviations_are_exact(spark):
    rows = [(i, [(-1.0) ** i * 1e6, float(i)], 1, 2, "n", 0.5) for i in range(3000)]
    table = spark.createDataFrame(rows, SCHEMA)
    compare(whitening.whitened(table).collect(), table.collect())


@pytest.mark.parametrize("values", [[9, 9, 9, 4, 4, 1, 1e-3, 0, 0], [5, 5 * (1 + 1e-9), 3, 3 * (1 - 1e-13), 2, 1], [1e12, 1, 1e-2], [7.0]])
def test_counts_and_pairs(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values),) * 2))
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    exact = np.linalg.eigvalsh(matrix)[::-1]
    for shift in [*(exact[:-1] + exact[1:]) / 2, exact[0] * 2, -1.0]:
        if np.abs(exact - shift).min() > 1e-12 * exact[0]:
            assert whitening.count_above(matrix, shift) == (exact > shift).sum()
    got, axes = whitening.leading_eigenpairs(matrix, 8)
    assert np.allclose(got, exact[: len(got)], rtol=0, atol=1e-13 * exact[0] * len(values))
    assert len(got) >= sum(np.array(values) > 1e-10 * max(values)) or len(got) == 8
    assert np.allclose(axes.T @ axes, np.eye(len(got)), atol=1e-12)
    assert np.linalg.norm(matrix @ axes - axes * got) < 1e-13 * exact[0] * len(values) * 4
