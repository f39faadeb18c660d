"""K-means on lines, subspaces and scaled frames.

Five methods share one loop. A pass gives, for the current centres, the sum of the largest similarities,
the number of rows whose part changed since the centres before, and the sums that the update needs; the
labels themselves never leave the executors. The loop stops before an update where no part changed, the
objective rose by less than ``tol`` (or fell), or ``max_iter`` passes are done, so centres and parts match.

An empty cluster keeps its centre. Ties go to the lowest cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .families import squared
from .kernels import columns_of, kind_of, mapped, observations, release, size_of, summed

METHODS = ("diametrical", "hyperplane", "grassmann", "weighted_grassmann", "least_squares")


def similarities(x: np.ndarray, centres: np.ndarray, method: str) -> np.ndarray:
    """(n, K): squared inner product with a line, less the chordal distance to a subspace or scaled frame,
    less the squared distance to a point."""
    if method in ("diametrical", "hyperplane"):
        return np.abs(x @ centres.conj().T) ** 2
    if method == "least_squares":
        return -((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1))
    q = x.shape[2]
    wide = np.moveaxis(centres, 1, 0).reshape(x.shape[1], -1)  # one product for each column, with all centres' columns
    shared = sum((x[:, :, a] @ wide) ** 2 for a in range(q)).reshape(len(x), len(centres), -1).sum(2)
    if method == "grassmann":
        return -(2 * q - 2 * shared) / np.sqrt(2)
    weight = lambda a: ((a**2).sum(1) ** 2).sum(1)
    return -(weight(x)[:, None] + weight(centres) - 2 * shared) / np.sqrt(2)


def _gram(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sum of x x^H over rows; frames count all their columns, one after the other."""
    if x.ndim == 3:
        return sum(_gram(x[:, :, a], of) for a in range(x.shape[2]))
    rows = x[of]
    return rows.T @ (rows.conj() if np.iscomplexobj(rows) else rows)


@dataclass
class Clusters:
    method: str
    centres: np.ndarray
    objective: list[float] = field(default_factory=list)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add part int and sim double (the largest similarity)."""

        def work(x: np.ndarray, _: pa.RecordBatch) -> list[pa.Array]:
            s = similarities(x, self.centres, self.method)
            return [pa.array(s.argmax(1).astype(np.int32)), pa.array(s.max(1))]

        return mapped(df, work, "part int, sim double")

    def score(self, df: DataFrame) -> float:
        """The mean of the largest similarities."""
        got = summed(df, lambda x, _: {"s": np.array([similarities(x, self.centres, self.method).max(1).sum(), len(x)])}, {"s": (2,)})["s"]
        return float(got[0] / got[1])


def update(gram: np.ndarray, method: str, q: int) -> np.ndarray:
    """The centre of a cluster from the sum of x x^H of its rows."""
    values, vectors = np.linalg.eigh(gram)
    top = vectors[:, ::-1][:, :q]
    if method == "hyperplane":
        return top[:, 0]
    if method == "grassmann":
        return top
    scale = np.sqrt(np.clip(values[::-1][:q], 0, None))
    return top * np.sqrt(scale / scale.sum() * len(gram))


def pass_over(df: DataFrame, centres: np.ndarray, before: np.ndarray | None, method: str) -> dict[str, np.ndarray]:
    """The sums of one pass: obj, n, changed, size (of clusters) and the update's sums."""
    k, shape = len(centres), centres.shape[1:]
    full = method in ("hyperplane", "grassmann", "weighted_grassmann")
    wide = ("c_sum" if np.iscomplexobj(centres) else "sum") + ("_h" if full else "")

    def kernel(x: np.ndarray, _: pa.RecordBatch) -> dict[str, np.ndarray]:
        both = centres if before is None else np.concatenate([centres, before])
        if method == "diametrical":  # the rows are read twice: for products with all centres, old ones too, and for the sums
            y = x @ both.conj().T
            s = squared(y)
        else:
            s = similarities(x, both, method)
        s, last = s[:, :k], s[:, k:]
        part = s.argmax(1)
        changed = len(x) if before is None else (part != last.argmax(1)).sum()
        if method == "diametrical":
            weight = np.zeros((len(x), k), y.dtype)
            weight[np.arange(len(x)), part] = y[np.arange(len(x)), part].conj()
            sums = (x.T @ weight).T
        else:
            sums = np.stack([_gram(x, part == j) if full else x[part == j].sum(0) for j in range(k)])
        return {"scalars": np.array([s.max(1).sum(), len(x), changed], float), "size": np.bincount(part, minlength=k).astype(float), wide: sums}

    moment = (k, shape[0], shape[0]) if full else (k, *shape)
    got = summed(df, kernel, {"scalars": (3,), "size": (k,), wide: moment})
    return {"obj": got["scalars"][0], "n": got["scalars"][1], "changed": got["scalars"][2], "size": got["size"], "sum": got[wide]}


def _normal(c: np.ndarray) -> np.ndarray:
    return c / np.linalg.norm(c, axis=-1, keepdims=True)


def uniform_centres(df: DataFrame, k: int, method: str, seed: int) -> np.ndarray:
    """Uniform numbers, brought onto the method's space."""
    rng = np.random.default_rng(seed)
    shape, kind = size_of(df), kind_of(df)
    c = rng.uniform(size=(k, *shape))
    if kind == "complex":
        c = c + 1j * rng.uniform(size=c.shape)
    if kind != "frame":
        return c if method == "least_squares" else _normal(c)
    values, vectors = np.linalg.eigh(np.einsum("kpq,kpr->kqr", c, c))
    root = np.einsum("kqi,ki,kri->kqr", vectors, 1 / np.sqrt(values), vectors)
    c = np.einsum("kpq,kqr->kpr", c, root)
    return c * np.sqrt(shape[0] / shape[1]) if method == "weighted_grassmann" else c


def _distance(x: np.ndarray, centres: np.ndarray, method: str) -> np.ndarray:
    """To the closest centre, 0 at least. Of subspaces, for seeding, 2q less twice the norm of the shared part
    (``similarities`` take its square), by the root of 2."""
    s = similarities(x, centres, method).max(1)
    if method == "grassmann":
        q = x.shape[2]
        return np.clip((2 * q - 2 * np.sqrt(np.clip(q + s / np.sqrt(2), 0, None))) / np.sqrt(2), 0, None)
    return np.clip(1 - s if method in ("diametrical", "hyperplane") else -s, 0, None)


def spread_centres(df: DataFrame, k: int, method: str, seed: int = 0, farthest: bool = False, id_column: str = "obs_id") -> np.ndarray:
    """Centres among the rows: the first by chance (or the lowest id), each next with a chance in proportion
    to its distance to the closest so far, as the winner of a race of exponential times; with ``farthest``
    always the row that is farthest, of equal ones the lowest id."""
    kind, columns = kind_of(df), columns_of(df)
    spark, chosen = df.sparkSession, []
    number = F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5
    for j in range(k):
        if j == 0:
            first = df.orderBy(F.col(id_column) if farthest else number, id_column).select(*columns).limit(1)
        else:
            centres = np.stack(chosen)
            salt = F.xxhash64(F.col(id_column), F.lit(seed), F.lit(j))
            u = (F.pmod(salt, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

            def work(x: np.ndarray, _: pa.RecordBatch, centres: np.ndarray = centres) -> list[pa.Array]:
                return [pa.array(_distance(x, centres, method))]

            far = mapped(df.select(id_column, *columns), work, "distance double")
            rank = -F.col("distance") if farthest else F.when(F.col("distance") > 0, -F.log(u) / F.col("distance")).otherwise(float("inf"))
            first = far.orderBy(rank, id_column).select(*columns).limit(1)
        rows = first.toArrow().to_batches()
        rows = [b for b in rows if b.num_rows]
        if not rows:
            raise ValueError("no observations")
        chosen.append(observations(rows[0], kind, columns)[0])
    del spark
    return np.stack(chosen)


def fit(df: DataFrame, k: int, method: str = "diametrical", max_iter: int = 10_000, num_repl: int = 1, init: str | np.ndarray = "++", tol: float = 1e-10, seed: int = 0, id_column: str = "obs_id", flip: bool = True) -> Clusters:
    """The best of ``num_repl`` runs. ``flip``: least squares of real vectors see them with most places negative. init: ``++``, ``maxmin``, ``uniform``, ``hyperplane`` (a hyperplane run
    first; for diametrical) or the centres."""
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    if flip and method == "least_squares" and kind_of(df) == "real":
        df = df.withColumn("x", vec.flip_sign(F.col("x")))
    held = df.is_cached
    df = df.cache()
    best: Clusters | None = None
    try:
        for r in range(num_repl):
            if isinstance(init, np.ndarray):
                centres = init
            elif init == "uniform":
                centres = uniform_centres(df, k, method, seed + r)
            elif init == "hyperplane":
                centres = fit(df, k, "hyperplane", max_iter, 1, "++", tol, seed + r, id_column).centres
            else:
                centres = spread_centres(df, k, method, seed + r, init == "maxmin", id_column)
            run = Clusters(method, centres)
            before = None
            for step in range(max_iter + 1):
                got = pass_over(df, centres, before, method)
                run.objective.append(float(got["obj"] / got["n"]))
                if step and (got["changed"] == 0 or step >= max_iter or run.objective[-1] - run.objective[-2] < tol):
                    break
                before, centres = centres, centres.copy()
                for j in np.flatnonzero(got["size"]):
                    if method == "diametrical":
                        centres[j] = _normal(got["sum"][j])
                    elif method == "least_squares":
                        centres[j] = got["sum"][j] / got["size"][j]
                    else:
                        centres[j] = update(got["sum"][j], method, centres.shape[2] if centres.ndim == 3 else 1)
            run.centres = centres
            if best is None or run.objective[-1] > best.objective[-1]:
                best = run
    finally:
        if not held:
            release(df)
    return best


def geodesic(df: DataFrame, centre: np.ndarray) -> DataFrame:
    """Add geodesic double: the norm of the principal angles between frames and a centre."""

    def work(x: np.ndarray, _: pa.RecordBatch) -> list[pa.Array]:
        s = np.linalg.svd(np.einsum("npq,pr->nqr", x, centre), compute_uv=False)
        return [pa.array(np.sqrt((np.arccos(np.clip(s, -1, 1)) ** 2).sum(1)))]

    return mapped(df, work, "geodesic double")
