"""Mixtures by expectation-maximisation, one fused pass over the data an iteration.

The E-step's posteriors weigh the M-step's sums in the same batch and are never stored; the driver gets
the log-likelihood, the sums of the posteriors and K second moments, and finishes the parameters.
Stopping: after ``num_comparison`` passes, where among the last so many log-likelihoods the largest exceeds
the next different one by less than ``tol`` of its size, or the newest is the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kmeans
from .families import Family, Params, weights
from .kernels import Ask, Fit, Sums, alone, asked, columns_of, kind_of, mapped, observations, release, summed, together

#: Start -> K-means method; a name that ends in ++ takes the seeds as they are, and one may end in _seg.
STARTS = {"dc": "diametrical", "gc": "grassmann", "wgc": "weighted_grassmann", "ls": "least_squares"}


@dataclass
class Mixture:
    family: Family
    theta: Params
    curve: list[float] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        """Add loglik double and post array<double>."""

        def work(x: np.ndarray, _: pa.RecordBatch) -> list[pa.Array]:
            total, post = weights(self.family.log_pdf(x, self.theta) + np.log(self.theta["pi"]))
            flat = pa.array(post.reshape(-1))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * post.shape[1])
            return [pa.array(total), pa.ListArray.from_arrays(at, flat)]

        return mapped(df, work, "loglik double, post array<double>")

    def densities(self, df: DataFrame) -> DataFrame:
        """Add lp array<double>: the components' log densities without pi."""

        def work(x: np.ndarray, _: pa.RecordBatch) -> list[pa.Array]:
            d = self.family.log_pdf(x, self.theta)
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * d.shape[1]), pa.array(d.reshape(-1)))]

        return mapped(df, work, "lp array<double>")

    def loglik(self, df: DataFrame) -> float:
        got = summed(df, lambda x, _: {"s": np.array([weights(self.family.log_pdf(x, self.theta) + np.log(self.theta["pi"]))[0].sum()])}, {"s": (1,)})
        return float(got["s"][0])


def moment_name(family: Family) -> str:
    return "c_moment_h" if family.is_complex else "moment_h"


def validate(df: DataFrame, family: Family) -> None:
    """Raise where observations aren't on the family's space, or are real where it is complex."""
    if (kind_of(df) == "complex") != family.is_complex:
        raise ValueError("real family, complex observations, or the other way round")
    bad = int(summed(df, lambda x, _: {"bad": np.array([family.check(x)], float)}, {"bad": (1,)})["bad"][0])
    if bad:
        raise ValueError(f"{bad} observations are not normalised for {family.name}")


def em_ask(family: Family, outer: Params, inner: Params | None = None) -> Ask:
    """For loglik, weight (K) and moment (K, p, p) under the posteriors of ``outer``; forms by ``inner``."""
    k, p, name = len(outer["pi"]), family.p, moment_name(family)
    inner = outer if inner is None else inner

    def kernel(x: np.ndarray, _: pa.RecordBatch) -> dict[str, np.ndarray]:
        forms = family.forms(x, outer)
        total, post = weights(family.log_pdf(x, outer, forms) + np.log(outer["pi"]))
        return {"loglik": np.array([total.sum()]), "weight": post.sum(0), name: family.moments(x, post, inner, forms if inner is outer else None)}

    return Ask(kernel, {"loglik": (1,), "weight": (k,), name: (k, p, p)})


def em_sums(got: Sums, family: Family) -> Sums:
    return {"loglik": got["loglik"][0], "weight": got["weight"], "moment": got[moment_name(family)]}


def em_pass(df: DataFrame, family: Family, outer: Params, inner: Params | None = None) -> Sums:
    return em_sums(asked(df, [em_ask(family, outer, inner)])[0], family)


def part_moments(df: DataFrame, family: Family, parts: kmeans.Clusters) -> tuple[np.ndarray, np.ndarray]:
    """Second moments and sizes of a K-means partition. Frames clustered by their first column alone are
    still summed whole."""
    k, name = len(parts.centres), moment_name(family)

    def kernel(x: np.ndarray, _: pa.RecordBatch) -> dict[str, np.ndarray]:
        seen = x[:, :, 0] if x.ndim == 3 and parts.centres.ndim == 2 else x
        part = kmeans.similarities(seen, parts.centres, parts.method).argmax(1)
        return {"size": np.bincount(part, minlength=k).astype(float), name: family.moments(x, np.eye(k)[part], None)}

    got = summed(df, kernel, {"size": (k,), name: (k, family.p, family.p)})
    return got[name], got["size"]


def uniform_start(family: Family, k: int, seed: int) -> Fit:
    """Random parameters; the concentration of Watson components is fitted on all rows."""
    theta = family.uniform(k, seed)
    if family.name == "Watson":
        one = em_sums((yield em_ask(family, theta)), family)
        theta["kappa"] = np.full(k, float(family._watson(one["moment"].sum(0) / one["weight"].sum())["kappa"]))
    return theta


def start(df: DataFrame, family: Family, k: int, init: str, seed: int, id_column: str, tries: int = 10_001) -> Params:
    """Parameters to start from: ``uniform``; by the parts of K-means from seeds spread by distance: dc, gc, wgc,
    and ls (of the vectors as they are, tried again until the smallest part has a twentieth of the rows); by the
    parts of such seeds alone: dc++, gc++, wgc++; all with _seg too (the parts' own one-component fits)."""
    if init == "uniform":
        return alone(df, uniform_start(family, k, seed))
    name = init.removesuffix("_seg")
    method = STARTS.get(name.removesuffix("++"))
    if method is None:
        raise ValueError(f"no such start: {init}")
    seen = df
    if kind_of(df) == "frame" and method in ("diametrical", "least_squares"):
        seen = df.withColumnRenamed("u1", "x").select(id_column, "x")
    if name.endswith("++"):
        parts = kmeans.Clusters(method, kmeans.spread_centres(seen, k, method, seed, id_column=id_column))
        gram, size = part_moments(df, family, parts)
    else:
        for again in range(tries):
            parts = kmeans.fit(seen, k, method, init="++", max_iter=100_000, seed=seed + again * 1_000_003, id_column=id_column, flip=False)
            gram, size = part_moments(df, family, parts)
            if method != "least_squares" or size.min() >= 0.05 * size.sum():
                break
        else:
            raise ValueError("no start in which the smallest part has a twentieth of the rows")
    theta = family.from_parts(gram, size, parts.centres)
    if init.endswith("_seg"):
        pi = theta["pi"]
        theta = family.finish(gram, np.maximum(size, 1e-9), theta) | {"pi": pi}
    return theta


def growing(family: Family, theta: Params) -> Fit:
    """Widen M to the family's rank: what a ridge projection on M leaves of the posterior-weighted data gives the
    new columns."""
    have = theta["M"].shape[2]
    if have >= family.rank:
        return theta
    k, name = len(theta["pi"]), moment_name(family)

    def kernel(x: np.ndarray, _: pa.RecordBatch) -> dict[str, np.ndarray]:
        post = weights(family.log_pdf(x, theta) + np.log(theta["pi"]))[1]
        return {"weight": post.sum(0), name: family.moments(x, post**2, None)}

    got = yield Ask(kernel, {"weight": (k,), name: (k, family.p, family.p)})
    wide = []
    for j in range(k):
        m, ridge = theta["M"][j], float(theta["gamma"][j]) if "gamma" in theta else 1.0
        if "gamma" not in theta:  # to trace p, as the family's covariance is
            m = m * np.sqrt(1 / (1 + (np.abs(m) ** 2).sum() / family.p))
        rest = np.eye(family.p) - m @ np.linalg.solve(m.conj().T @ m + ridge * np.eye(have), m.conj().T)
        values, vectors = np.linalg.eigh(rest @ got[name][j] @ rest.conj().T)
        s = np.sqrt(np.clip(values[::-1], 0, None))
        new = family.rank - have
        noise = max(float(s[new:].mean()) if new < len(s) else 0.0, 1e-12)
        wide.append(np.concatenate([m, vectors[:, ::-1][:, :new] * np.sqrt(np.clip(s[:new] - noise, 0, None) / noise)], 1))
    return theta | {"M": np.stack(wide)}


def grow(df: DataFrame, family: Family, theta: Params) -> Params:
    return alone(df, growing(family, theta))


def stopped(curve: list[float], tol: float, num_comparison: int) -> bool:
    if len(curve) <= num_comparison:
        return False
    recent = curve[-num_comparison:]
    top = sorted(set(recent), reverse=True)
    close = len(top) < 2 or (top[0] - top[1]) / abs(top[0]) < tol
    return close or recent[-1] == min(recent)


def training(family: Family, theta: Params, tol: float = 1e-8, max_iter: int = 10_000, num_comparison: int = 10, inner_iter: int = 1) -> Fit:
    """Expectation-maximisation from parameters, of lower rank too; gives the best mixture of its passes."""
    if family.rank and "M" in theta:
        theta = yield from growing(family, theta)
    run, top = Mixture(family, theta), -np.inf
    for _ in range(max_iter):
        got = em_sums((yield em_ask(family, theta)), family)
        run.curve.append(float(got["loglik"]))
        if np.isnan(run.curve[-1]):
            raise FloatingPointError("the log-likelihood is not a number")
        if run.curve[-1] > top:
            top, run.theta = run.curve[-1], theta
        if stopped(run.curve, tol, num_comparison):
            break
        pi = got["weight"] / got["weight"].sum() if len(theta["pi"]) > 1 else theta["pi"]
        new = family.finish(got["moment"], got["weight"], theta)
        for _ in range(inner_iter - 1):
            if family.name not in ("ACG", "MACG"):
                break
            again = em_sums((yield em_ask(family, theta, new | {"pi": theta["pi"]})), family)
            new = family.finish(again["moment"], again["weight"], theta)
        theta = new | {"pi": pi}
    return run


def check_params(family: Family, k: int, theta: Params) -> None:
    """Raise where given parameters don't have the family's names, shapes or kind of numbers."""
    p = family.p
    names = {"mu", "kappa"} if family.name == "Watson" else {"Psi"} if not family.rank else {"M", "gamma"} if family.name in ("SingularWishart", "Normal") else {"M"}
    if missing := (names | {"pi"}) - set(theta):
        raise ValueError(f"{family.name} lacks the parameters {sorted(missing)}")
    shapes = {"pi": (k,), "mu": (k, p), "kappa": (k,), "gamma": (k,), "Psi": (k, p, p)}
    for name in sorted(names | {"pi"}):
        value = np.asarray(theta[name])
        if name == "M":
            if value.ndim != 3 or value.shape[:2] != (k, p) or not 0 < value.shape[2] <= family.rank:
                raise ValueError(f"M has shape {value.shape}, not ({k}, {p}, 1 to {family.rank})")
        elif value.shape != shapes[name]:
            raise ValueError(f"{name} has shape {value.shape}, not {shapes[name]}")
        if np.iscomplexobj(value) and (not family.is_complex or name in ("pi", "kappa", "gamma")):
            raise ValueError(f"{name} is complex")
    if abs(float(np.sum(theta["pi"])) - 1) > 1e-6 or np.min(theta["pi"]) < 0:
        raise ValueError("pi is no distribution")


def fit(df: DataFrame, family: Family, k: int, init: str | Params = "uniform", tol: float = 1e-8, max_iter: int = 10_000, num_repl: int = 1, num_comparison: int = 10, inner_iter: int = 1, seed: int = 0, id_column: str = "obs_id", train: Callable[[Params], Fit] | None = None) -> Mixture:
    """The best of ``num_repl`` runs by its best log-likelihood; they share their passes. ``init``: a start's name
    or parameters, of lower rank too. ``inner_iter``: passes with the same posteriors for ACG and MACG. ``train``: a
    fit from parameters in place of EM."""
    held = df.is_cached
    df = df.cache()
    try:
        validate(df, family)
        if isinstance(init, dict):
            check_params(family, k, init)
        starts = [dict(init) if isinstance(init, dict) else start(df, family, k, init, seed + r, id_column) for r in range(num_repl)]
        em = lambda theta: training(family, theta, tol, max_iter, num_comparison, inner_iter)
        runs = together(df, [(train or em)(theta) for theta in starts])
    finally:
        if not held:
            release(df)
    return max(runs, key=lambda m: max(m.curve, default=-np.inf))


def mean_logliks(df: DataFrame, models: list[Mixture], by: str) -> DataFrame:
    """model (its place in the list), ``by``, loglik: means by group under every model, in one pass over the rows."""
    kind, columns = kind_of(df), columns_of(df)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = observations(batch, kind, columns)
            groups = batch.column(by).dictionary_encode()
            of = np.asarray(groups.indices.fill_null(len(groups.dictionary)))
            n = len(groups.dictionary) + 1
            names = pa.concat_arrays([groups.dictionary, pa.nulls(1, groups.dictionary.type)])
            for i, m in enumerate(models):
                total = weights(m.family.log_pdf(x, m.theta) + np.log(m.theta["pi"]))[0]
                yield pa.record_batch([pa.array(np.full(n, i, np.int32)), names, pa.array(np.bincount(of, total, n)), pa.array(np.bincount(of, minlength=n))], names=["model", by, "s", "n"])

    sums = df.select(by, *columns).mapInArrow(each, f"model int, `{by}` {dict(df.dtypes)[by]}, s double, n long").where("n > 0")
    return sums.groupBy("model", by).agg((F.sum("s") / F.sum("n")).alias("loglik"))
