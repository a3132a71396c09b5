"""Whitening of embeddings by the leading principal components, found by Jacobi-Davidson.

The covariance is never formed. What the solver needs are products V @ u for a few vectors u; each is one
Spark job over the fit list (centred rows times u, summed back over the rows), and only matrices as wide as a
vector and as high as the block of u's come to the driver. A step of the solver (block Jacobi-Davidson):

1. Rayleigh-Ritz in the search space: the small projected matrix gives the current pairs and residuals.
2. Pairs whose residual is at double precision, in order from the largest, are locked: the search space
   and all corrections stay orthogonal to them.
3. For the pairs still open, the projected correction equation (I - QQ')(V - e)(I - QQ') t = -r is solved
   roughly by MINRES, all pairs side by side, so that one job serves one inner iteration of them all.
4. The corrections are orthogonalised into the search space, which restarts from its best pairs when full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tables import kept, remove
from quarry.session import ensure_checkpoint_dir

#: Vectors of a stored block of the fit list.
BLOCK_ROWS = 8192
#: Residual, in units of rounding of the largest eigenvalue, at which a pair is done.
ROUNDINGS = 256
#: Inner MINRES iterations, outer steps before the solver gives up, and pairs corrected side by side beyond the wanted
#: ones: a job takes about as long for a few columns more, and the wanted pairs settle in fewer jobs.
INNER, OUTER, BESIDE = 6, 300, 8
_LIMIT = float(2 ** 62)
#: Bits of an integer that one row carries into a sum: 2 ** 23 rows can't overflow.
LIMB = 40


def integer_vectors(df: DataFrame, scale: int, vector: str, keep: list[str]) -> DataFrame:
    """The rows whose vector holds finite entries only: the ``keep`` columns and x = floor(scale * entry).
    An entry beyond 2 ** 62 is taken as that. Of vectors of several lengths, the most frequent length
    stays (the longer one of equally frequent ones)."""
    values = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = F.forall(values, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(values, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-_LIMIT)), F.lit(_LIMIT))).cast("long"))
    rows = df.where(F.col(vector).isNotNull() & fine & (F.size(vector) > 0)).select(*keep, x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows"))
    best = sizes.agg(F.max(F.struct("rows", "size"))["size"].alias("size")).first()["size"]  # one row
    return rows.where(F.size("x") == F.lit(best).cast("int"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as an integer matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x) -> one row per block: its vectors as little-endian 64-bit integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            m = _matrix(batch.column(0).slice(at, BLOCK_ROWS))
            yield pa.RecordBatch.from_arrays([pa.array([len(m)], pa.int64()), pa.array([m.astype("<i8").tobytes()], pa.binary())],
                                             ["n", "data"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield np.frombuffer(data, "<i8").reshape(n, -1)


class FitList:
    """The distinct vectors, stored in blocks, with their number, sums and the trace of their covariance."""

    def __init__(self, vectors: DataFrame):
        distinct = vectors.select("x").dropDuplicates(["x"])
        self.blocks, self.path = kept(distinct.mapInArrow(_store, "n long, data binary"))
        sums = self._summed(_column_sums)
        self.n = int(sums.get((0, -1), 0))
        self.dim = len(sums) - 1
        self.sums = [int(sums[0, j]) for j in range(self.dim)]

    def _summed(self, work: Callable) -> dict:
        """Sums over all blocks of what ``work`` makes of a partition's matrices: {(i, j): value}. A task adds
        its blocks up first, Spark adds the tasks'; what comes here is one matrix."""
        def run(batches):
            total = None
            for m in _matrices(batches):
                part = work(m)
                total = part if total is None else {k: total[k] + v for k, v in part.items()}
            rows = [r for (i, j), v in (total or {}).items() for r in _limbs(i, j, v)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                    pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["i", "j", "limb", "whole", "part"])

        parts = self.blocks.mapInArrow(run, "i int, j int, limb int, whole long, part double")
        out: dict = {}
        for r in parts.groupBy("i", "j", "limb").agg(F.sum("whole").alias("whole"), F.sum("part").alias("part")).collect():
            out[r.i, r.j] = out.get((r.i, r.j), 0) + ((r.whole << LIMB * r.limb) if r.limb >= 0 else r.part)
        return out

    def matrix(self, work: Callable, rows: int, columns: int) -> np.ndarray:
        """The same for one float matrix that ``work`` makes of a block."""
        def cells(m):
            part = work(m)
            return {(i, j): float(part[i, j]) for i in range(rows) for j in range(columns)}

        out = np.zeros((rows, columns))
        for (i, j), v in self._summed(cells).items():
            out[i, j] = v
        return out

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        """x -> x - S / n, rounded once."""
        return centring(self.n, self.sums)

    def product(self, u: np.ndarray) -> np.ndarray:
        """V @ u (dim x k), centred before multiplying: one pass over the fit list."""
        centre, n, u = self.centred(), self.n, np.array(u)

        def work(m):
            y = centre(m)
            return y.T @ (y @ u) / n

        return self.matrix(work, *u.shape)

    def trace(self) -> float:
        """Of the covariance, from integers."""
        n, sums = self.n, self.sums
        return self._summed(lambda m: {(0, 0): int(sum(_deviations(m, n, sums)))})[0, 0] / n ** 3


def _limbs(i: int, j: int, value: int | float) -> list[tuple]:
    """A sum as rows that Spark can add up: a float as it is (limb -1), an integer of any size in pieces of LIMB bits."""
    if not isinstance(value, int):
        return [(i, j, -1, 0, float(value))]
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value or not out:
        out.append((i, j, len(out), sign * (value & (1 << LIMB) - 1), 0.0))
        value >>= LIMB
    return out


def _column_sums(m: np.ndarray) -> dict:
    few = int(np.abs(m).max()) * len(m) < 2 ** 62
    sums = m.sum(axis=0) if few else m.astype(object).sum(axis=0)
    return {(0, -1): len(m)} | {(0, j): int(v) for j, v in enumerate(sums)}


def centring(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    small = max(map(abs, sums), default=0) < 2 ** 62
    whole = np.array([s // n for s in sums], np.int64 if small else object)
    rest = np.array([s % n / n for s in sums])
    return lambda m: (m - whole).astype(np.float64) - rest


def _deviations(m: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n * x - S) ** 2 of each row, exact."""
    top = n * int(np.abs(m).max()) + max(map(abs, sums)) if m.size else 0
    kind = np.int64 if top * top * m.shape[1] < 2 ** 63 else object
    y = m.astype(kind) * n - np.array(sums, kind)
    return [int(v) for v in (y * y).sum(axis=1)]


def _orthonormal(x: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """The columns of x made orthonormal to ``against`` and each other; those that vanish are left out."""
    base = np.concatenate([a for a in against if a.shape[1]], axis=1) if any(a.shape[1] for a in against) else x[:, :0]
    out = []
    for v in x.T:
        size = np.linalg.norm(v)
        if not np.isfinite(size) or size == 0:
            continue
        v, whole = v / size, np.concatenate([base, *[o[:, None] for o in out]], axis=1)
        for _ in range(3):
            v = v - whole @ (whole.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-13:
                break
            v = v / left
        else:
            out.append(v)
    return np.array(out).T if out else x[:, :0]


def _minres(product: Callable, right: np.ndarray, shifts: np.ndarray, q: np.ndarray, steps: int) -> np.ndarray:
    """Per column, MINRES for (I - qq')(V - shift)(I - qq') t = right; one product serves all columns."""
    def project(x):
        return x - q @ (q.T @ x)

    right = project(right)
    beta = np.linalg.norm(right, axis=0)
    k = right.shape[1]
    safe = np.where(beta > 0, beta, 1)
    v, before = right / safe, np.zeros_like(right)
    t, w, w_before = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    phi, cs, sn = beta.copy(), np.ones(k), np.zeros(k)
    cs_before, sn_before, b = np.ones(k), np.zeros(k), np.zeros(k)
    live = beta > 0
    start = beta.copy()
    for _ in range(steps):
        if not live.any():
            break
        a = np.zeros_like(v)
        a[:, live] = product(v[:, live])
        a = project(a - shifts * v) - b * before
        alpha = (v * a).sum(axis=0)
        a = a - alpha * v
        after = np.linalg.norm(a, axis=0)
        # the two rotations before, then the new one
        low = cs_before * b
        epsilon, delta = sn_before * b, cs * low + sn * alpha
        gamma_bar = cs * alpha - sn * low
        gamma = np.hypot(gamma_bar, after)
        gamma = np.where(gamma > 0, gamma, 1)
        cs_before, sn_before, cs, sn = cs, sn, gamma_bar / gamma, after / gamma
        w_before, w = w, (v - delta * w - epsilon * w_before) / gamma
        t = np.where(live, t + cs * phi * w, t)
        phi = -sn * phi
        ok = after > 1e-14 * np.abs(shifts).max(initial=1e-300)
        before, v = v, a / np.where(ok, after, 1)
        b = after
        live = live & ok & (np.abs(phi) > 1e-4 * start)
    return project(t)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, scale: float, seed: int = 7,
                    inner: int = INNER, roundings: float = ROUNDINGS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and unit eigenvectors of a symmetric, positive semidefinite
    operator of which only products are known; ``scale`` bounds its eigenvalues (the trace, for instance). Fewer come
    back if the others are zero to double precision."""
    most = min(dim, 5 * (wanted + BESIDE))
    done, values = np.zeros((dim, 0)), []
    space = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, wanted + 2 * BESIDE))))
    image = product(space)
    for _ in range(OUTER):
        small = space.T @ image
        e, s = np.linalg.eigh((small + small.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        need = min(wanted - len(values), len(e))
        x, ax = space @ s, image @ s
        r = ax - x * e
        r = r - done @ (done.T @ r)
        size = np.linalg.norm(r, axis=0)
        top = max([*values, *e, 0.0])
        fine = roundings * np.finfo(float).eps * top
        if top <= 4 * dim * np.finfo(float).eps * scale:
            break  # what is left is zero
        lock = 0
        while lock < need and size[lock] <= fine:
            lock += 1
        whole = len(values) + space.shape[1] >= dim  # the search space is all there is
        if whole:
            lock = need
        if lock:
            done = np.concatenate([done, x[:, :lock]], axis=1)
            values += [float(v) for v in e[:lock]]
            space, image = x[:, lock:], ax[:, lock:]
            e, r = e[lock:], r[:, lock:]
            if len(values) >= wanted or not space.shape[1] and whole:
                break
        else:
            space, image = x, ax
        need = min(wanted - len(values) + BESIDE, len(e))
        if space.shape[1] + need > most - len(values):
            keep = need + BESIDE
            space, image, e, r = space[:, :keep], image[:, :keep], e[:keep], r[:, :keep]
        # pairs next to each other are projected out together: nearly equal eigenvalues don't slow the inner solver down
        q = np.concatenate([done, space[:, :need]], axis=1)
        right = -r[:, :need] if need else np.zeros((dim, 0))
        t = _minres(product, right, e[:need], q, inner) if need else right
        fresh = _orthonormal(t, done, space)
        if not fresh.shape[1]:
            fresh = _orthonormal(np.random.default_rng(seed + len(values)).standard_normal((dim, 2)), done, space)
        if not fresh.shape[1]:
            fresh = space[:, :0]
        space = np.concatenate([space, fresh], axis=1)
        image = np.concatenate([image, product(fresh)], axis=1) if fresh.shape[1] else image
    else:
        raise RuntimeError("Jacobi-Davidson did not converge")
    keep = [i for i, v in enumerate(values) if v > 4 * dim * np.finfo(float).eps * scale]
    order = sorted(keep, key=lambda i: -values[i])
    return np.array([values[i] for i in order]), done[:, order]


def whiten(df: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row with a usable vector and component: vec_id, component (from 1, by falling eigenvalue), n (distinct
    vectors), deviation, whitened, explained, identity_error. x = floor(scale * entry) as integers; mean and
    covariance (divisor n) are those of the distinct x. ``deviation`` is the sum of (n * x - S) ** 2, exact, null if it
    is beyond 64 bits; ``whitened`` the centred x along the component over the square root of its eigenvalue;
    ``explained`` the eigenvalue's share of the trace; ``identity_error`` the largest absolute entry of the whitened
    fit list's covariance minus the identity.

    Null and empty vectors and vectors with a null or non-finite entry are left out; of several lengths, the most frequent
    is used. A null vec_id and repeated rows keep their rows. Components whose variance is zero have no rows, so one
    distinct vector alone, and an empty table, give none; vectors of fewer entries have fewer components.
    Equal eigenvalues: any basis of their space, the same for all rows. Other columns are not looked at.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    source = df.select(df[vec_id].cast("long").alias("vec_id"), df[vector].alias("_vector"))
    rows, _ = kept(integer_vectors(source, scale, "_vector", ["vec_id"]))
    fit = FitList(rows)
    trace = fit.trace() if fit.n else 0.0
    if not trace:
        remove(spark, fit.path)
        return spark.createDataFrame([], schema)
    values, vectors = jacobi_davidson(fit.product, fit.dim, min(components, fit.dim), trace)
    weights = vectors / np.sqrt(values)
    k, n, sums, centre = len(values), fit.n, fit.sums, fit.centred()
    mean = fit.matrix(lambda m: (centre(m) @ weights).sum(axis=0)[None] / n, 1, k)[0]

    def outer(m):
        w = centre(m) @ weights - mean
        return w.T @ w / n

    error = float(np.abs(fit.matrix(outer, k, k) - np.eye(k)).max())
    remove(spark, fit.path)
    shares = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                m = _matrix(batch.column(1))
                w = centre(m) @ weights
                deviation = [v if v < 2 ** 63 else None for v in _deviations(m, n, sums)]
                row = pa.array(np.repeat(np.arange(len(m)), k))
                some = len(m) * k
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                     pa.array(np.full(some, n, np.int64)), pa.array(deviation, pa.int64()).take(row), pa.array(w.ravel()),
                     pa.array(np.tile(shares, len(m))), pa.array(np.full(some, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
