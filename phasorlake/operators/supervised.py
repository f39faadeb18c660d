"""Supervised baselines: logistic regression and support vector machines with stratified cross-validation.

Every candidate (penalty, and width of the radial kernel) on every fold is a fit that asks for its loss and gradient over
the rows that it learns from, and all of them share their passes over the data: nothing is collected, whatever the number
of rows, and the fit of the chosen candidate is one more of the same kind.

Columns are scaled by the mean and deviation of the rows that a fit learns from, classes weigh alike, an intercept isn't
penalised. Machines are one against one, by votes, of equal votes the lower class; their hinge is rounded over the last
ROUND of its margin, so that it has a gradient everywhere. The radial kernel goes by features at landmarks (``landmarks``):
exact where there are as many as different rows, with a known error beyond, and no kernel matrix over rows is formed.
Landmarks are picked from all rows that are learnt from, labels unseen; a fold's fit has the span of more rows than its
own, which leaves its optimum where it is."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, landmarks
from .kernels import Ask, Fit, Joint, Sums, mapped

ROUND = 0.05
#: Rows that are looked at together within a task.
ROWS = 4096
KINDS = ("logistic", "linear-svm", "rbf-svm")
_WIDE = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
PENALTIES = {"logistic": _WIDE, "linear-svm": _WIDE[:-1], "rbf-svm": (0.01, 0.1, 1.0, 10.0, 100.0)}
WIDTHS = ("scale", 0.001, 0.01, 0.1, 1.0)


def folded(df: DataFrame, n: int, id_column: str) -> DataFrame:
    """Add fold, by a digest of the id: of any class each fold gets about its share, without an order of the rows."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), F.col(id_column)), F.lit(n)).cast("int"))


def descent(x: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Where a function is smallest, by limited-memory quasi-Newton steps that each lower it. Yields the places whose
    value and gradient it wants."""
    value, slope = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        d, kept = -slope, []
        for s, y in reversed(steps):
            kept.append((s @ d) / (s @ y))
            d = d - kept[-1] * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        if slope @ d >= 0:
            d, steps = -slope, []
        length = 1.0 if steps else min(1.0, 1 / max(np.abs(slope).sum(), 1e-12))
        for _ in range(30):
            new, new_slope = yield x + length * d
            if new <= value + 1e-4 * length * (slope @ d):
                break
            length /= 2
        else:
            return x
        s, y = length * d, new_slope - slope
        if s @ y > 1e-10 * np.linalg.norm(s) * np.linalg.norm(y):
            steps = [*steps, (s, y)][-memory:]
        done = abs(value - new) <= tol * max(abs(value), abs(new), 1e-6)
        x, value, slope = x + s, new, new_slope
        if done:
            break
    return x


@dataclass
class Data:
    """What a first pass has found: by fold and class the counts, by fold the sums and sums of squares of columns."""

    classes: int
    count: np.ndarray
    total: np.ndarray
    square: np.ndarray

    def without(self, fold: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, 1 / deviation (1 of constants), and the classes' weights, of the rows outside of a fold."""
        keep = np.arange(len(self.count)) != (-1 if fold is None else fold)
        n = self.count[keep].sum()
        mean = self.total[keep].sum(0) / n
        var = np.maximum(self.square[keep].sum(0) / n - mean**2, 0)
        count = self.count[keep].sum(0)
        present = count > 0
        weight = np.where(present, n / (present.sum() * np.maximum(count, 1)), 0.0)
        # a variance that is nothing but rounding counts as none
        return mean, np.where(var > 1e-12 * (mean**2 + 1e-300), 1 / np.sqrt(np.where(var > 0, var, 1)), 1.0), weight


@dataclass
class Model:
    kind: str
    classes: int
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    features: landmarks.Features | None = None

    def wide(self, x: np.ndarray) -> np.ndarray:
        """Scaled columns, or the features of them, and the intercept's."""
        z = (x - self.mean) * self.scale
        return np.concatenate([z if self.features is None else self.features(z), np.ones((len(x), 1))], 1)

    def prob(self, x: np.ndarray) -> np.ndarray:
        """(n, classes): probabilities, of machines 1 for the class with the most votes."""
        return decided(self.kind, self.wide(x) @ self.beta, self.classes)


def decided(kind: str, m: np.ndarray, classes: int) -> np.ndarray:
    """(n, classes): what scores decide."""
    if kind == "logistic":
        e = np.exp(m - m.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)
    votes = np.zeros((len(m), classes))
    for i, (a, b) in enumerate(combinations(range(classes), 2)):
        votes[:, a] += m[:, i] > 0
        votes[:, b] += m[:, i] <= 0
    return np.eye(classes)[votes.argmax(1)]


def hinge(m: np.ndarray, sign: np.ndarray, weight: float, corner: float) -> tuple[float, np.ndarray]:
    """The weighted loss of the scores of rows of one class, and its gradient by them; ``sign``: its side in each machine."""
    short = 1 - sign * m
    bent = np.clip(short, 0, corner)
    return weight * float((bent**2 / (2 * corner) + np.maximum(short - corner, 0)).sum()), bent * (-weight / corner * sign)


def loss(kind: str, m: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, corner: float = ROUND) -> tuple[float, np.ndarray]:
    """The weighted loss of scores, and its gradient by them."""
    if kind == "logistic":
        top = m.max(1, keepdims=True)
        e = np.exp(m - top)
        total = e.sum(1, keepdims=True)
        value = float((weight * (top[:, 0] + np.log(total[:, 0]) - m[np.arange(len(m)), label])).sum())
        g = e / total
        g[np.arange(len(m)), label] -= 1
        return value, g * weight[:, None]
    pairs = np.array(list(combinations(range(classes), 2))).reshape(-1, 2)
    sign = (label[:, None] == pairs[:, 0]).astype(float) - (label[:, None] == pairs[:, 1])
    short = np.where(sign != 0, 1 - sign * m, 0.0)
    bent = np.clip(short, 0, corner)
    value = bent**2 / (2 * corner) + np.maximum(short - corner, 0)
    return float((weight[:, None] * value).sum()), -weight[:, None] * sign * bent / corner


@dataclass
class Space:
    """Where fits that leave out the same fold (none: None) look at rows: their scale, the classes' weights, and the kernel."""

    fold: int | None
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    features: landmarks.Features | None

    @property
    def width(self) -> int:
        return (len(self.mean) if self.features is None else self.features.width) + 1

    def on_columns(self, beta: np.ndarray) -> np.ndarray:
        """Coefficients of features as those of ``columns``."""
        return beta if self.features is None else np.concatenate([self.features.turn @ beta[:-1], beta[-1:]])

    def on_features(self, slope: np.ndarray) -> np.ndarray:
        return slope if self.features is None else np.concatenate([self.features.turn.T @ slope[:-1], slope[-1:]])


@dataclass
class Machines:
    """What the fits of all candidates and folds share: ``seen`` (mean, scale, landmarks, width of the kernel) by (gamma,
    fold). A pass works out a row's kernel once for each of them, whatever the penalties, and takes it past the fits without
    turning it: coefficients are turned instead. Machines of two classes see the rows of these classes alone."""

    kind: str
    classes: int
    label: str
    corner: float
    seen: Broadcast

    def columns(self, x: np.ndarray, key: tuple) -> np.ndarray:
        mean, scale, z, gamma = self.seen.value[key]
        x = (x - mean) * scale
        return np.concatenate([x if z is None else landmarks.radial(x, z, gamma), np.ones((len(x), 1))], 1)

    def split(self, batch: pa.RecordBatch, given: list[tuple]) -> tuple[np.ndarray, np.ndarray, dict[tuple, list[int]]]:
        """Labels, folds, and the places of fits by what they see."""
        alike: dict[tuple, list[int]] = {}
        for i, (key, *_) in enumerate(given):
            alike.setdefault(key, []).append(i)
        return np.asarray(batch.column(self.label)).astype(int), np.asarray(batch.column("fold")), alike

    def slopes(self, x: np.ndarray, batch: pa.RecordBatch, given: list[tuple]) -> list[Sums]:
        """value and slope of each fit; ``given``: what it sees, the classes' weights, its coefficients of columns."""
        label, fold, alike = self.split(batch, given)
        values, slopes = [0.0] * len(given), [np.zeros(beta.shape) for *_, beta in given]
        order = np.argsort(label, kind="stable")
        for key, fits in alike.items():
            kept = order if key[1] is None else order[fold[order] != key[1]]
            for start in range(0, len(kept), ROWS):
                at = kept[start : start + ROWS]
                wide, of, weight = self.columns(x[at], key), label[at], given[fits[0]][1]
                for c, rows, beta in self.parts(of, [given[i][2] for i in fits]):
                    m = (wide[rows] @ beta.reshape(beta.shape[0], -1)).reshape(-1, *beta.shape[1:])
                    g = np.empty_like(m)
                    for j, i in enumerate(fits):
                        value, g[:, j] = self.loss(m[:, j], of[rows], weight, c)
                        values[i] += value
                    back = (wide[rows].T @ g.reshape(len(g), -1)).reshape(beta.shape)
                    for j, i in enumerate(fits):
                        slopes[i][:, self.facing(c)] += back[:, j]
        return [{"value": np.array([v]), "slope": s} for v, s in zip(values, slopes, strict=True)]

    def facing(self, c: int | None) -> slice | np.ndarray:
        """The machines that a class has a side in."""
        return slice(None) if c is None else np.array([i for i, pair in enumerate(combinations(range(self.classes), 2)) if c in pair], int)

    def parts(self, of: np.ndarray, betas: list[np.ndarray]) -> Iterator[tuple[int | None, slice, np.ndarray]]:
        """Rows in the order of labels, as slices of one class (of all, for logistic), with (columns, fits, machines) of coefficients."""
        if self.kind == "logistic":
            yield None, slice(None), np.stack(betas, 1)
            return
        ends = np.searchsorted(of, np.arange(self.classes + 1))
        for c in range(self.classes):
            if ends[c] < ends[c + 1]:
                facing = self.facing(c)
                yield c, slice(ends[c], ends[c + 1]), np.stack([b[:, facing] for b in betas], 1)

    def loss(self, m: np.ndarray, label: np.ndarray, weight: np.ndarray, c: int | None) -> tuple[float, np.ndarray]:
        if c is None:
            return loss(self.kind, m, label, weight[label], self.classes, self.corner)
        return hinge(m, np.where(np.arange(self.classes) > c, 1.0, -1.0)[np.arange(self.classes) != c], weight[c], self.corner)

    def hits(self, x: np.ndarray, batch: pa.RecordBatch, given: list[tuple]) -> list[Sums]:
        """Right answers of each fit on the fold that it hasn't seen; ``given``: what it sees, its coefficients of columns."""
        label, fold, alike = self.split(batch, given)
        right = np.zeros((len(given), 1))
        for key, fits in alike.items():
            kept = np.flatnonzero(fold == key[1])
            for start in range(0, len(kept), ROWS):
                at = kept[start : start + ROWS]
                wide = self.columns(x[at], key)
                for i in fits:
                    right[i] += (decided(self.kind, wide @ given[i][1], self.classes).argmax(1) == label[at]).sum()
        return [{"right": r} for r in right]


def fitting(data: Data, kind: str, penalty: float, space: Space, key: tuple, kernel: Joint, max_iter: int, tol: float) -> Fit:
    """A model that learns from the rows outside of a fold: half the squared coefficients plus ``penalty`` times the
    sum of the losses is smallest."""
    columns = data.classes if kind == "logistic" else data.classes * (data.classes - 1) // 2
    shape = (space.width, columns)
    model = Model("logistic" if kind == "logistic" else "machine", data.classes, space.mean, space.scale, np.zeros(shape), space.features)
    per = 1 / (penalty * sum(data.count[f] @ space.weight for f in range(len(data.count)) if f != space.fold))
    walk = descent(np.zeros(shape[0] * shape[1]), max_iter, tol)
    at = next(walk)
    while True:
        beta = at.reshape(shape)
        turned = space.on_columns(beta)
        got = yield Ask(kernel, {"value": (1,), "slope": turned.shape}, (key, space.weight, turned))
        held = np.concatenate([beta[:-1], np.zeros((1, columns))])
        try:
            # divided by the penalty and the weights, so that steps are alike whatever they are
            at = walk.send((float(got["value"][0]) * per * penalty + per * (held**2).sum() / 2, (space.on_features(got["slope"]) * per * penalty + per * held).reshape(-1)))
        except StopIteration as end:
            model.beta = end.value.reshape(shape)
            return model


def described(rows: DataFrame, classes: int, n_folds: int, label: str, p: int) -> Data:
    def kernel(x: np.ndarray, batch: pa.RecordBatch) -> Sums:
        fold = np.eye(n_folds)[np.asarray(batch.column("fold"))]
        return {"count": fold.T @ np.eye(classes)[np.asarray(batch.column(label)).astype(int)], "total": fold.T @ x, "square": fold.T @ x**2}

    got = kernels.asked(rows, [Ask(kernel, {"count": (n_folds, classes), "total": (n_folds, p), "square": (n_folds, p)})], ("fold", label))[0]
    return Data(classes, got["count"], got["total"], got["square"])


def fit(train: DataFrame, kind: str, label: str = "truth", id_column: str = "obs_id", grid: tuple[float, ...] | None = None, gammas: tuple[float | str, ...] = WIDTHS, n_folds: int = 5, max_iter: int = 50, tol: float = 1e-6, width: int = 256, corner: float = ROUND) -> tuple[dict, Model]:
    """The best parameters (C, of the radial kernel gamma and its error with ``width`` landmarks at most; accuracy over the
    folds) and the model fitted with them on all rows. Of equal candidates the first counts. A gamma of ``scale`` is 1 / the number of columns."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    grid = grid or PENALTIES[kind]
    rows = folded(train.where(F.col(label).isNotNull()), n_folds, id_column).select(F.col(label).cast("int").alias(label), "fold", "x")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = (rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows).cache()  # few partitions: a small set
    try:
        ends = rows.agg(F.max(label).alias("top"), F.count("*").alias("n"), F.first(F.size("x")).alias("p")).first()
        if not ends["n"]:
            raise ValueError("no rows to learn from")
        data = described(rows, ends["top"] + 1, n_folds, label, ends["p"])
        maps: dict = {None: None}
        if kind == "rbf-svm":
            mean, scale, _ = data.without(None)
            maps = dict(zip(gammas, landmarks.pick(rows, [1 / ends["p"] if g == "scale" else float(g) for g in gammas], mean, scale, width), strict=True))
        sizes = data.count.sum(1)
        seen = [f for f in range(n_folds) if 0 < sizes[f] < ends["n"]]
        spaces: dict[tuple, Space] = {}
        for g, marks in maps.items():
            for f in (*seen, None):
                mean, scale, weight = data.without(f)
                spaces[g, f] = Space(f, mean, scale, weight, None if marks is None else marks.features(mean, scale))
        sent = rows.sparkSession.sparkContext.broadcast({k: (s.mean, s.scale, *((None, None) if s.features is None else (s.features.z, s.features.gamma))) for k, s in spaces.items()})
        machines = Machines(kind, data.classes, label, corner, sent)
        slopes, hits = machines.slopes, machines.hits  # one object each, by which the passes know alike fits
        best: dict = {"C": grid[0], "gamma": next(iter(maps)), "accuracy": None}
        if len(grid) * len(maps) > 1 and seen:
            every = [(g, c, f) for g in maps for c in grid for f in seen]
            models = kernels.together(rows, [fitting(data, kind, c, spaces[g, f], (g, f), slopes, max_iter, tol) for g, c, f in every], ("fold", label))
            got = kernels.asked(rows, [Ask(hits, {"right": (1,)}, ((g, f), spaces[g, f].on_columns(m.beta))) for m, (g, _, f) in zip(models, every, strict=True)], ("fold", label))
            right = np.array([g["right"][0] for g in got]).reshape(-1, len(seen))
            mean = np.round((right / sizes[seen]).mean(1), 9)
            g, c, _ = every[int(mean.argmax()) * len(seen)]
            best = {"C": c, "gamma": g, "accuracy": float(mean.max())}
        if kind == "rbf-svm":
            best["error"] = maps[best["gamma"]].error
        chosen = best["gamma"], None
        return best, kernels.together(rows, [fitting(data, kind, best["C"], spaces[chosen], chosen, slopes, max_iter, tol)], ("fold", label))[0]
    finally:
        kernels.release(rows)


def predict(df: DataFrame, model: Model) -> DataFrame:
    """Add pred int and prob array<double> (one-hot for the machines)."""

    def work(x: np.ndarray, _: pa.RecordBatch) -> list[pa.Array]:
        s = model.prob(x)
        return [pa.array(s.argmax(1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * s.shape[1]), pa.array(s.reshape(-1)))]

    return mapped(df, work, "pred int, prob array<double>")


def fit_predict(train: DataFrame, kind: str, test: DataFrame | None = None, label: str = "truth", id_column: str = "obs_id", **options) -> DataFrame:
    """id, label, pred, prob of ``test``, or of ``train`` itself."""
    _, model = fit(train, kind, label, id_column, **options)
    return predict(train if test is None else test, model).select(id_column, label, "pred", "prob")
