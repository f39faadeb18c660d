"""The radial kernel exp(-gamma |x - y|^2) by pivoted incomplete Cholesky, without a matrix over all rows.

Landmarks are picked in blocks. A pass finds the POOL different rows whose kernel the landmarks so far explain least (of
equal ones those of the smallest digest); of these the driver picks BLOCK at most, always the one that is explained least by
landmarks and picks. Each task keeps the best POOL rows of what it has read, tasks' rows meet in groups of GROUP tasks, level
by level, so no task holds more than GROUP pools; what is picked doesn't depend on partitions. Features of a row are the kernel's
values at the landmarks, turned so that inner products of features are the kernel: for landmarks exactly, for other rows up to
the largest residual that is left (Cauchy-Schwarz), which the last pass reports. With as many landmarks as there are
different rows the kernel is exact."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import observations

#: For each width: rows that a pass looks for, and that may be picked of them. Tasks whose rows meet in one.
POOL = 256
BLOCK = 64
GROUP = 32
#: Rows that are looked at together within a task.
ROWS = 2048
#: Residuals up to here count as none.
TOLERANCE = 1e-6
_SCHEMA = "g int, residual double, h long, x array<double>"


def radial(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    """(n, r): the kernel between rows."""
    return np.exp(-gamma * np.maximum((x**2).sum(1)[:, None] + (z**2).sum(1) - 2 * (x @ z.T), 0))


@dataclass
class Features:
    """Features of scaled rows, by scaled landmarks ``z``."""

    z: np.ndarray
    gamma: float
    turn: np.ndarray

    @property
    def width(self) -> int:
        return self.turn.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return radial(x, self.z, self.gamma) @ self.turn


@dataclass
class Landmarks:
    """Rows before they are scaled. ``error``: by how much features' products may miss the kernel of two rows."""

    rows: np.ndarray
    gamma: float
    error: float = 1.0

    def features(self, mean: np.ndarray, scale: np.ndarray) -> Features:
        z = (self.rows - mean) * scale
        value, vector = np.linalg.eigh(radial(z, z, self.gamma))
        keep = value > 1e-10 * value[-1]
        return Features(z, self.gamma, vector[:, keep] / np.sqrt(value[keep]))


def greedy(x: np.ndarray, features: Features | None, gamma: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of up to ``most`` rows, each the one of the largest residual after those before it (of ties the first), and
    these residuals."""
    known = np.zeros((len(x), 0)) if features is None else features(x)
    left = 1 - (known**2).sum(1)
    factor, picks, residuals = np.zeros((len(x), most)), [], []
    for i in range(min(most, len(x))):
        at = int(left.argmax())
        if left[at] <= TOLERANCE:
            break
        picks.append(at)
        residuals.append(left[at])
        column = radial(x, x[at : at + 1], gamma)[:, 0] - known @ known[at] - factor[:, :i] @ factor[at, :i]
        factor[:, i] = column / np.sqrt(left[at])
        left = left - factor[:, i] ** 2
        left[at] = 0
    return np.array(picks, int), np.array(residuals)


Rows = tuple[np.ndarray, np.ndarray, np.ndarray]


def _batches(found: dict[int, Rows]) -> Iterator[pa.RecordBatch]:
    for g, (residual, h, x) in found.items():
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
        yield pa.record_batch([pa.array(np.full(len(x), g, np.int32)), pa.array(residual), pa.array(h), lists], names=["g", "residual", "h", "x"])


def _worst(pool: Rows | None, more: Rows) -> Rows:
    """The POOL different rows of the largest residuals."""
    residual, h, x = more if pool is None else (np.concatenate(c) for c in zip(pool, more, strict=True))
    order = np.lexsort((h, -residual))
    order = order[np.append(True, np.diff(h[order]) != 0)][:POOL]
    return residual[order], h[order], x[order]


def _unexplained(rows: DataFrame, asks: dict[int, tuple[float, Features | None]], mean: np.ndarray, scale: np.ndarray, parts: int) -> DataFrame:
    """For each asked width of the kernel (gamma, and what its landmarks explain) the rows of the largest residuals."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Rows] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                x, h = observations(batch, "real", ["x"]), np.asarray(batch.column("h"))
                z = (x - mean) * scale
                for g, (_, features) in asks.items():
                    # nine digits, as the last ones depend on what else is in the batch
                    residual = np.ones(len(z)) if features is None else np.round(1 - (features(z) ** 2).sum(1), 9)
                    keep = residual > TOLERANCE
                    if keep.any():
                        found[g] = _worst(found.get(g), (residual[keep], h[keep], x[keep]))
        yield from _batches(found)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Rows] = {}
        for batch in batches:
            of, residual, h = (np.asarray(batch.column(c)) for c in ("g", "residual", "h"))
            x = observations(batch, "real", ["x"])
            for g in np.unique(of).tolist():
                found[g] = _worst(found.get(g), (residual[of == g], h[of == g], x[of == g]))
        yield from _batches(found)

    worst = rows.select(F.xxhash64("x").alias("h"), "x").mapInArrow(first, _SCHEMA)
    while parts > 1:
        parts = -(-parts // GROUP)
        to = F.pmod(F.spark_partition_id(), F.lit(parts))
        worst = worst.withColumn("to", to).repartition(parts, "to").drop("to").mapInArrow(merged, _SCHEMA)
    return worst


def pick(rows: DataFrame, gammas: list[float], mean: np.ndarray, scale: np.ndarray, width: int) -> list[Landmarks]:
    """Up to ``width`` landmarks of ``x`` (scaled by ``mean`` and ``scale``) for each gamma; passes are shared."""
    parts = rows.rdd.getNumPartitions()
    got = [np.zeros((0, len(mean))) for _ in gammas]
    errors = [1.0] * len(gammas)
    running = set(range(len(gammas)))
    while running:
        known = {i: Landmarks(got[i], gammas[i]).features(mean, scale) if len(got[i]) else None for i in sorted(running)}
        new: dict[int, list] = {}
        for r in _unexplained(rows, {i: (gammas[i], f) for i, f in known.items()}, mean, scale, parts).collect():
            new.setdefault(r["g"], []).append(r)
        for i, features in known.items():
            found = sorted(new.get(i, []), key=lambda r: (-r["residual"], r["h"]))
            errors[i] = found[0]["residual"] if found else 0.0
            if not found or len(got[i]) >= width:  # the pass after the last block tells what is left
                running.discard(i)
                continue
            x = np.array([r["x"] for r in found])
            at, _ = greedy((x - mean) * scale, features, gammas[i], min(BLOCK, width - len(got[i])))
            if len(at):
                got[i] = np.concatenate([got[i], x[at]])
            else:  # rounding alone lies between
                running.discard(i)
    return [Landmarks(x, g, e) for x, g, e in zip(got, gammas, errors, strict=True)]
