"""The bidiagonal solver against numpy's, and the registered query against its contract."""

import math
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from fonolytics.llm import whitening as w  # noqa: E402
from fonolytics.llm.queries import QUERIES  # noqa: E402

KINDS = {
    "plain": lambda a: a,
    "scales": lambda a: a * 10.0 ** (np.arange(a.shape[1]) % 9 - 4),
    "zero column": lambda a: np.hstack((a[:, :0], a * (np.arange(a.shape[1]) != 1))),
    "equal columns": lambda a: np.hstack((a[:, :1], a[:, :-1])),
    "whole numbers": np.round,
    "few rows": lambda a: a[:3],
    "identity": lambda a: np.eye(*a.shape),
    "one direction": lambda a: np.outer(a[:, 0], np.ones(a.shape[1])),
    "zeros": np.zeros_like,
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("d", [1, 2, 5, 17])
def test_components_equal_a_direct_decomposition(kind, d):
    rows = KINDS[kind](np.random.default_rng(d).normal(size=(40, d)))
    m = w.solve(w._reduced(rows), len(rows), np.zeros(d, object))
    want = np.linalg.svd(rows, compute_uv=False) ** 2
    k, v = len(m.variances), m.directions
    assert k == min(8, int((want > 1e-13 * max(want[0], 1e-300)).sum()))
    assert np.allclose(m.variances * len(rows), want[:k], rtol=1e-9, atol=1e-13 * want[0])
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-12)
    assert np.allclose(rows.T @ rows @ v, v * want[:k], atol=1e-11 * max(want[0], 1e-300))
    assert np.allclose(m.explained, want[:k] / max(want.sum(), 1e-300))


def test_small_values_keep_their_accuracy():
    # a graded bidiagonal matrix: the smallest value is 10^-24 of the largest when squared
    diagonal, upper = 10.0 ** -np.arange(0, 13, 1.0), 0.3 * 10.0 ** -np.arange(0.5, 12.5, 1.0)
    got = w.dqds(diagonal, upper)
    # the product of the squared values is that of the squared diagonal
    assert math.isclose(np.log(got).sum(), 2 * np.log(diagonal).sum(), rel_tol=1e-13)
    b = np.diag(diagonal) + np.diag(upper, 1)
    assert np.allclose(got[:4], (np.linalg.svd(b, compute_uv=False) ** 2)[:4], rtol=1e-13)


def test_bidiagonal_keeps_the_matrix():
    a = np.random.default_rng(2).normal(size=(9, 9))
    diagonal, upper, v = w.bidiagonal(a)
    b = np.diag(diagonal) + np.diag(upper, 1)
    assert np.allclose(v.T @ v, np.eye(9)) and np.allclose(v @ b.T @ b @ v.T, a.T @ a)


def contract(path):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(path).to_pylist()]
    rows = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x)]
    off = [[n * c - t for c, t in zip(r, s)] for r in x]
    a = np.array(off, float) / n
    e, vec = np.linalg.eigh(a.T @ a / n)
    e, vec = e[::-1], vec[:, ::-1]
    deviation = {rows[k][0]: sum(c * c for c in r) for k, r in enumerate(off)}
    return rows, n, e, a @ vec[:, :8] / np.sqrt(e[:8]), deviation


def test_query_equals_the_contract(spark):
    rows, n, e, white, deviation = contract("/root/testdata/sf0.001/embeddings.parquet")
    got = QUERIES["op13_dqds_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, c) for i, _ in rows for c in range(1, 9))
    at = {i: k for k, (i, _) in enumerate(rows)}
    made = np.zeros((n, 8))
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id] and 0 <= r.identity_error < 1e-9
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)
        made[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((made * white).sum(axis=0))
    assert np.allclose(made * sign, white, atol=1e-8)
    assert np.allclose(np.cov(made.T, bias=True), np.eye(8), atol=1e-9)


NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n long, whitened string")


def test_unusable_vectors_are_dropped(spark):
    good = [(i, [math.sin(i), math.cos(3 * i), float(i % 5)], 0, "x") for i in range(30)]
    bad = [(100, None, 0, "x"), (101, [1.0, None, 2.0], 0, "x"), (102, [1.0, NAN, 2.0], 0, "x"), (103, [1.0, INF, 2.0], 0, "x"),
           (104, [], 0, "x"), (105, [1.0, 2.0], 0, "x"), (106, [1e300, 1.0, 1.0], 0, "x")]
    more = [(None, [0.5, 0.5, 0.5], 0, "x"), (3, [math.sin(3), math.cos(9), 3.0], 0, "x")]  # no id; a repeated row
    got = w.whitened_components(frame(spark, good + bad + more).repartition(5)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in got if r.component == 1) == sorted([*range(30), 3, -1])
    assert {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {32}
    twice = [r for r in got if r.vec_id == 3 and r.component == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert got[0].identity_error < 1e-9


def test_tables_without_components(spark):
    for rows in ([], [(1, None, 0, "x")], [(1, [1.0, 2.0], 0, "x")], [(i, [1.0, 2.0], 0, "x") for i in range(9)]):
        df = w.whitened_components(frame(spark, rows))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_many_triangles_are_joined_in_rounds(spark):
    rows = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * k + k) for k in range(1, 7)]).alias("embedding"))
    one, many = w.fit(rows.coalesce(1)), w.fit(rows.repartition(40))
    assert one.n == many.n and one.sums.tolist() == many.sums.tolist()
    assert np.allclose(one.variances, many.variances, rtol=1e-12)
    assert np.allclose(np.abs((one.directions * many.directions).sum(axis=0)), 1, atol=1e-10)


def test_exact_numbers_beyond_a_long():
    whole = np.array([[100000.0 + 2**40, 100000.0], [100000.0, 100000.0]])
    n = 1 << 30
    sums = np.array([n * 100000, n * 100000 - n + 3], object)
    assert w._deviation(whole, n, sums).to_pylist() == [None, (n - 3) ** 2]
    assert np.allclose(w.centred(whole, n, sums), [[2**40, 1], [0, 1]], atol=1e-8)
