"""Whitening against eigenvectors of the covariance, with bad rows, copies and equal eigenvalues."""

import numpy as np
import pytest

from textshield.llm import whitening
from textshield.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, key string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "k") for i, v in vectors], SCHEMA).repartition(3)


def grid(vectors):
    return np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000


def check(rows, x, components=8):
    """Rows of a table against the vectors ``x``, in order of their ids."""
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums) / n
    covariance = centred.T @ centred / n
    values = np.linalg.eigvalsh(covariance)[::-1]
    k = min(components, int((values > 1e-13 * values[0]).sum()))
    assert len(rows) == n * k
    white = np.array([r["whitened"] for r in rows]).reshape(n, k)
    deviation = ((n * x - sums).astype(object) ** 2).sum(1)
    assert [r["deviation"] for r in rows] == [d if d < 1 << 63 else None for d in deviation for _ in range(k)]
    assert [r["component"] for r in rows] == list(range(1, k + 1)) * n
    explained = np.array([r["explained"] for r in rows]).reshape(n, k)
    assert np.allclose(explained, values[:k] / values.sum(), rtol=1e-10)
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-8 and all(r["identity_error"] < 1e-8 for r in rows)
    # each component is a unit eigenvector: the values times the root are the rows on it
    directions = np.linalg.lstsq(centred, white * np.sqrt(values[:k]), rcond=None)[0]
    assert np.allclose(covariance @ directions, directions * values[:k], atol=1e-6 * values[0])


def ordered(frame):
    return frame.orderBy("vec_id", "component").collect()


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((300, 12)) @ rng.standard_normal((12, 12)) * 0.1).astype(np.float32).tolist()
    good = list(enumerate(vectors)) + [(400, vectors[0]), (401, vectors[0])]
    bad = [(500, None), (501, []), (502, [None] + vectors[0][1:]), (503, [float("nan")] * 12), (504, [float("inf")] * 12), (505, [1.0, 2.0])]
    check(ordered(whiten(table(spark, good + bad))), grid([v for _, v in good]))
    check(ordered(whiten(table(spark, good), components=3)), grid([v for _, v in good]), 3)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((100, 5)).astype(np.float32).tolist()
    monkeypatch.setattr(whitening, "BLOCK", 35)
    check(ordered(whiten(table(spark, list(enumerate(vectors))))), grid(vectors))


@pytest.mark.parametrize("dims", [3, 10])
def test_equal_eigenvalues_are_all_found(spark, dims):
    axes = np.concatenate([np.eye(dims), -np.eye(dims)]).tolist()
    check(ordered(whiten(table(spark, list(enumerate(axes))))), grid(axes))


def test_fewer_rows_than_dimensions(spark):
    vectors = np.random.default_rng(3).standard_normal((4, 9)).astype(np.float32).tolist()
    check(ordered(whiten(table(spark, list(enumerate(vectors))))), grid(vectors))


def test_large_entries_and_null_keys(spark):
    vectors = [[1e6, 0.0], [-1e6, 3.0], [5e5, -2.0]]
    rows = ordered(whiten(table(spark, [(None, vectors[0]), (1, vectors[1]), (2, vectors[2])])))
    check(rows, grid(vectors))
    assert rows[0]["vec_id"] is None


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        frame = whiten(table(spark, vectors))
        assert frame.count() == 0 and frame.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_left_and_right_vectors_are_orthogonal(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-500, 500, (60, 6))
    blocks = spark.createDataFrame([(bytearray(x[i : i + 20].astype(np.int64).tobytes()),) for i in range(0, 60, 20)], "block binary")
    rows = whitening.Rows(blocks, 6)
    right, small = whitening.bidiagonalise(rows)
    centred = x - x.mean(0)
    assert np.allclose(right.T @ right, np.eye(6)) and np.allclose(np.tril(small, -1), 0) and np.allclose(np.triu(small, 2), 0)
    left = centred @ right @ np.linalg.inv(small)
    assert np.allclose(left.T @ left, np.eye(6)) and np.allclose(left @ small, centred @ right)
