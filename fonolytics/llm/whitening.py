"""Whitening of embeddings by a bidiagonal singular value solver.

The centred rows are a tall matrix A; its right singular vectors and values
give the whitening without ever forming A'A, so small variances keep their
accuracy. Four steps:

1. Blockwise QR: each task reduces its rows, block by block, to one triangle R
   (the QR of the last triangle stacked on the next block); triangles are
   stacked and reduced again in groups until one is left. R'R = A'A.
2. `bidiagonal`: Householder reflections from both sides turn R into an upper
   bidiagonal B; the right ones are kept.
3. `dqds`: differential quotient-difference steps with shifts find the squared
   singular values of B, smallest first, each to high relative accuracy. The
   shift is Newton's lower bound 1 / sum(1 / d), which can't pass a value, or
   a greater one that showed not to (no d became negative).
4. `twisted_vectors`: for each wanted value a stationary (from above) and a
   progressive (from below) factorisation of B'B less that value are joined at
   the row where the twist is smallest; that gives the eigenvector by products
   only. The kept reflections carry it back to the dimensions.

Entries are turned into whole numbers (`to_whole`), so counts and sums are
exact and don't depend on the order of rows. The mean is subtracted as
(n*x - S) / n, from whole numbers.

What meets on the driver is d by d numbers (at most `FAN` triangles) and one
row of sums; rows are only read by the tasks that hold them, so neither a hot
value nor repeated vectors matter.

Results in special cases:
- null vectors and vectors with null or non-finite entries are dropped; so are
  vectors of another length than the most frequent one (ties: the longest).
- entries whose whole number would pass 2^52 (in size) count as not finite.
- a null id stays null; repeated rows are rows of the fit and of the result.
- directions without variance (below 1e-20 of the largest) are no components;
  a table of equal vectors has none, and so an empty result. Equal variances
  leave their directions open; any orthogonal ones are taken.
- `deviation` is null where it would not fit a long (from about 10^6 rows on,
  for entries as far apart as unit vectors' are).
- an empty table gives an empty result. Columns other than the id's and the
  vector's, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fonolytics.llm.store import written

SCALE, SHIFT = 1024, 100_000
# Numbers of one block of rows, triangles reduced at a time, and components.
BLOCK, FAN, COMPONENTS = 1 << 20, 16, 8
TINY = 1e-20


# -- the small problem: one triangle ------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor V of a square matrix: U' r V is upper bidiagonal."""
    a = np.array(r, float)
    d = a.shape[0]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        scale = np.abs(x).max(initial=0.0)
        if not scale or not np.abs(x[1:]).max(initial=0.0):
            return None
        u = x / scale
        u[0] += math.copysign(np.linalg.norm(u), u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflector(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < d - 2:
            u = reflector(a[k, k + 1 :])
            if u is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One dqds step: the transformed q and e, and the d of each row."""
    d = q[0] - shift
    qs, es, ds = [], [], [d]
    for k in range(len(e)):
        s = d + e[k]
        t = q[k + 1] / s if s else 0.0
        qs.append(s)
        es.append(e[k] * t)
        d = d * t - shift
        ds.append(d)
    return [*qs, d], es, ds


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling."""
    eps = np.finfo(float).eps
    out: list[float] = []
    work = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while work:
        q, e, sigma = work.pop()
        while q:
            if len(q) == 1:
                out.append(q.pop() + sigma)
                break
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= eps * eps * (sigma + min(q[k], q[k + 1]))), None)
            if cut == len(e) - 1:
                out.append(q.pop() + sigma)
                e.pop()
                continue
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # a step without shift gives d_k = 1 / (inverse of B B')_kk, and their sum Newton's bound
            qs, es, ds = _step(q, e, 0.0)
            least = min(ds)
            if least <= 0.0:
                q, e = qs, es  # a singular matrix: this step brings the zero to the end, the next one splits it off
                continue
            bound = (1.0 - 4 * eps * len(q)) / sum(1.0 / d for d in ds)
            # the smallest value lies between the bound and the least d: try shifts in between, from above
            near = ds[-1] * (1.0 - math.sqrt(es[-1] / qs[-2])) if es[-1] < qs[-2] else 0.0
            tries = [x for x in (near, (bound + 3 * least) / 4, (bound + least) / 2, (3 * bound + least) / 4) if x > bound]
            for shift in (*tries, bound, bound / 2, 0.0):
                moved = _step(q, e, shift)
                if min(moved[2]) >= 0.0:
                    break
            q, e, sigma = moved[0], moved[1], sigma + shift
    return np.sort(np.array(out))[::-1]


def _twisted(big: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of L D L' (D = `big`, L unit lower bidiagonal with `low`) at an eigenvalue."""
    n = len(big)
    eps = np.finfo(float).tiny / np.finfo(float).eps
    guard = lambda x: x if abs(x) > eps else math.copysign(eps, x)
    down, s = np.zeros(max(n - 1, 0)), np.zeros(n)  # stationary, from above
    s[0] = -value
    for k in range(n - 1):
        pivot = guard(s[k] + big[k])
        down[k] = big[k] * low[k] / pivot
        s[k + 1] = down[k] * low[k] * s[k] - value
    up, p = np.zeros(max(n - 1, 0)), np.zeros(n)  # progressive, from below
    p[n - 1] = big[n - 1] - value
    for k in range(n - 2, -1, -1):
        pivot = guard(big[k] * low[k] * low[k] + p[k + 1])
        t = big[k] / pivot
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    gamma = np.abs(s + p + value)
    best = int(np.argmin(np.where(np.isfinite(gamma), gamma, np.inf)))
    z = np.zeros(n)
    z[best] = 1.0
    for k in range(best - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(best, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def twisted_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Eigenvectors (columns) of B'B at the given eigenvalues (falling), for an upper bidiagonal B."""
    eps = np.finfo(float).eps
    n = len(diagonal)
    top = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    # a zero on the diagonal would divide; moved by less than rounding it changes no wanted direction
    a = np.where(np.abs(diagonal) < eps * top, eps * top, diagonal)
    edges = [0, *(np.flatnonzero(np.abs(upper) <= eps * top) + 1).tolist(), n]
    blocks = list(zip(edges, edges[1:]))
    # each value belongs to the block that has it; one that several have goes round
    left = [dqds(a[i:j], upper[i : j - 1]).tolist() for i, j in blocks] if len(blocks) > 1 else [values.tolist()]
    out = np.zeros((n, len(values)))
    for c, value in enumerate(values.tolist()):
        k = min((k for k in range(len(blocks)) if left[k]), key=lambda k: min(abs(x - value) for x in left[k]))
        near = min(left[k], key=lambda x: abs(x - value))
        left[k].remove(near)
        i, j = blocks[k]
        z = _twisted(a[i:j] ** 2, upper[i : j - 1] / a[i : j - 1], near)
        out[i:j, c] = z
    # vectors of close values are made orthogonal to each other
    for c in range(len(values)):
        for _ in range(2):
            for b in range(c):
                if values[b] - values[c] <= 1e-3 * values[b]:
                    out[:, c] -= out[:, b] * (out[:, b] @ out[:, c])
        size = np.linalg.norm(out[:, c])
        if size < 0.5:  # (nearly) the same direction twice: any other one of that value's space serves as well
            rest = np.eye(n) - out[:, :c] @ out[:, :c].T
            out[:, c] = rest[:, int(np.argmax(np.linalg.norm(rest, axis=0)))]
            size = np.linalg.norm(out[:, c])
        out[:, c] /= size
    return out


@dataclass(frozen=True)
class Whitening:
    """Mean (n, sums), directions (columns) and variances of the leading components; `explained`: their shares."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def solve(triangle: np.ndarray, n: int, sums: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """The leading components of n centred rows, given the triangle of their QR."""
    diagonal, upper, v = bidiagonal(triangle)
    values = dqds(diagonal, upper)
    total = float((triangle * triangle).sum())
    wanted = values[: min(components, len(values))]
    wanted = wanted[wanted > TINY * max(total, 0.0)] if total > 0 else wanted[:0]
    directions = v @ twisted_vectors(diagonal, upper, wanted) if len(wanted) else np.zeros((len(sums), 0))
    lead = np.abs(directions).argmax(axis=0)
    directions = directions * np.sign(directions[lead, np.arange(directions.shape[1])])
    return Whitening(n, sums, directions, wanted / n, wanted / total if len(wanted) else wanted)


# -- the large problem: rows ---------------------------------------------------


def to_whole(values: np.ndarray) -> np.ndarray:
    """Entries as whole numbers, by which sums are exact: floor(1024 c) + 100000."""
    return np.floor(values * SCALE) + SHIFT


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, whole entries as doubles) of the usable vectors, per length that occurs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for length in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == length)
        flat = column.take(pa.array(rows)).flatten()
        entries = np.asarray(pc.fill_null(flat.cast(pa.float64()), math.nan)).reshape(-1, length)
        whole = to_whole(entries)
        good = (np.abs(whole) < 2.0**52).all(axis=1)
        yield rows[good], whole[good]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for batch in batches:
        for rows, whole in _vectors(batch.column("vector")):
            if len(rows):
                kept = found.setdefault(whole.shape[1], [0, np.zeros(whole.shape[1], object)])
                kept[0] += len(rows)
                # 2^10 rows at a time stay below 2^62
                kept[1] += sum((whole[k : k + 1024].astype(np.int64).sum(axis=0).astype(object) for k in range(0, len(whole), 1024)), np.zeros(whole.shape[1], object))
    at = [(length, n, k, int(s)) for length, (n, sums) in found.items() for k, s in enumerate(sums.tolist())]
    cols = list(zip(*at)) if at else [(), (), (), ()]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38, 0)]
    cols[3] = [Decimal(x) for x in cols[3]]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["length", "n", "dim", "total"])


def _reduced(stack: np.ndarray) -> np.ndarray:
    """The triangle of a QR, padded to a square where there are fewer rows than columns."""
    r = np.linalg.qr(stack, mode="r")
    if r.shape[0] < r.shape[1]:
        r = np.vstack((r, np.zeros((r.shape[1] - r.shape[0], r.shape[1]))))
    return r


def centred(whole: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from n*x - S in whole numbers where these are exact."""
    if n * float(np.abs(whole).max(initial=0.0)) < 2.0**62 and max(map(abs, sums.tolist()), default=0) < 2**62:
        return (whole.astype(np.int64) * n - sums.astype(np.int64)) / n
    whole_mean, rest = zip(*(divmod(int(s), n) for s in sums.tolist()))
    return (whole - np.array(whole_mean, float)) - np.array([x / n for x in rest])


def _deviation(whole: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n*x - S)^2, exact; null where it doesn't fit a long."""
    size = n * centred(whole, n, sums)
    rough = (size * size).sum(axis=1)
    # rows whose sum may not fit, or numbers that may not, are summed in unbounded numbers
    far = (rough > 9e18) | (n * float(np.abs(whole).max(initial=0.0)) >= 2.0**62)
    exact, mask = np.zeros(len(whole), np.int64), np.zeros(len(whole), bool)
    near = np.flatnonzero(~far)
    if len(near):
        off = whole[near].astype(np.int64) * n - sums.astype(np.int64)
        exact[near] = np.einsum("ij,ij->i", off, off)
    for k in np.flatnonzero(far).tolist():
        total = sum((int(x) * n - int(s)) ** 2 for x, s in zip(whole[k].tolist(), sums.tolist()))
        mask[k] = total >= 1 << 63
        exact[k] = 0 if mask[k] else total
    return pa.array(exact, pa.int64(), mask=mask)


def _triangles(n: int, sums: np.ndarray):
    d = len(sums)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle, held, rows_held = np.zeros((0, d)), [], 0
        for batch in batches:
            for rows, whole in _vectors(batch.column("vector")):
                if whole.shape[1] != d or not len(rows):
                    continue
                held.append(centred(whole, n, sums))
                rows_held += len(rows)
                if rows_held * d >= BLOCK:
                    triangle, held, rows_held = _reduced(np.vstack([triangle, *held])), [], 0
        if held:
            triangle = _reduced(np.vstack([triangle, *held]))
        if len(triangle):
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([triangle.ravel().tolist()], pa.list_(pa.float64()))], ["part", "r"])

    return reduce_rows


def _joined(d: int):
    def join(key: tuple, table: pa.Table) -> pa.Table:
        triangle = np.zeros((0, d))
        for r in table.sort_by("part").column("r"):
            triangle = _reduced(np.vstack((triangle, np.asarray(r.values).reshape(d, d))))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([triangle.ravel().tolist()], pa.list_(pa.float64()))], ["part", "r"])

    return join


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Mean and leading components of all usable vectors; None if there are none."""
    rows = vectors.select(F.col(vector).cast("array<double>").alias("vector"))
    counted = rows.mapInArrow(_count, "length int, n long, dim int, total decimal(38,0)")
    sums = counted.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    # one row per length: the most frequent one has the model's d numbers
    lengths = sums.groupBy("length").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "total"))).alias("sums"))
    first = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if first is None:
        return None
    n, total = first.n, np.array([int(s.total) for s in first.sums], object)
    d = first.length
    kind = "part long, r array<double>"
    parts = written(rows.mapInArrow(_triangles(n, total), kind), "triangles")
    count = parts.count()
    while count > FAN:
        groups = -(-count // FAN)
        ranked = parts.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups)))
        parts = written(ranked.groupBy("g").applyInArrow(_joined(d), kind), "triangles")
        count = parts.count()
    triangle = np.zeros((0, d))
    for r in sorted(parts.collect(), key=lambda x: x.part):
        triangle = _reduced(np.vstack((triangle, np.array(r.r).reshape(d, d))))
    return solve(triangle, n, total, components)


def transform(vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, deviation and the whitened components (an array) of every usable vector."""
    d, scale = len(model.sums), model.directions / np.sqrt(model.variances)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, whole in _vectors(batch.column("vector")):
                if whole.shape[1] != d or not len(rows):
                    continue
                white = centred(whole, model.n, model.sums) @ scale
                k = white.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(white.ravel()))
                ids = batch.column("id").take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, _deviation(whole, model.n, model.sums), lists], ["id", "deviation", "whitened"])

    own = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(apply, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", vec_id)


def identity_error(white: DataFrame, components: int, column: str = "whitened") -> float:
    """Largest absolute entry of the whitened components' covariance less the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    sums = [F.covar_pop(F.col(column)[i], F.col(column)[j]) - F.lit(float(i == j)) for i, j in pairs]
    return float(white.agg(F.greatest(*map(F.abs, sums), F.lit(0.0)).alias("most")).first().most)


def whitened_components(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema[vec_id].dataType.simpleString()
    schema = f"{vec_id} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, vector, components)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    white = written(transform(vectors, model, vec_id, vector), "whitened")
    error = identity_error(white, len(model.variances))
    share = F.array(*[F.lit(float(x)) for x in model.explained])
    long = white.select(vec_id, "deviation", F.posexplode(F.arrays_zip("whitened", share.alias("explained"))).alias("at", "c"))
    return long.select(
        vec_id,
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
