"""Zero-phase filters of series of any length, by pieces.

Samples are range-partitioned by series and time; a stretch of a series in a partition, of at most ``rows``
samples, is a piece. A recursive filter over a piece is linear in the state it starts from: what it ends in is
the state's image under a power of one small matrix, plus what it ends in from rest. So each piece is
summarised by a few numbers, the summaries of a series are chained, and the pieces are filtered again from
the states they really start in; forwards, then backwards. No task holds more of a series than a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters
from ..sources.scratch import kept
from .signal import SERIES

#: Samples of a piece.
ROWS = 65_536


class Recursive:
    """A digital filter of a numerator and a denominator; its state has one number for each delay."""

    def __init__(self, b: np.ndarray, a: np.ndarray):
        self.b, self.a = b, a
        n = len(a) - 1
        self.step = np.zeros((n, n))
        self.step[:, 0] = -a[1:]
        self.step[:-1, 1:] = np.eye(n - 1)
        self.push = b[1:] - a[1:] * b[0]
        #: After a long constant input of 1.
        self.steady = np.linalg.solve(np.eye(n) - self.step, self.push)

    def after(self, state: np.ndarray, n: int) -> np.ndarray:
        """The state that n samples of silence leave."""
        return np.linalg.matrix_power(self.step, n) @ state

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filtered samples and the state at their end. Strips of about sqrt(n) samples are filtered side by
        side from rest, their states are chained, and each strip gets the answer to its own start added. Powers of
        the state's matrix cost digits: values are right to about 1e-9 of the largest."""
        if not len(x):
            return x.copy(), state
        wide = int(np.ceil(np.sqrt(len(x))))
        strips = np.zeros((-(-len(x) // wide), wide))
        strips.reshape(-1)[: len(x)] = x
        z, y = np.zeros((len(strips), len(state))), np.empty_like(strips)
        answer, row = np.empty((wide, len(state))), np.eye(1, len(state))[0]
        for i in range(wide):
            v = strips[:, i]
            y[:, i] = self.b[0] * v + z[:, 0]
            z = z @ self.step.T + v[:, None] * self.push
            answer[i] = row
            row = row @ self.step
        jump, starts, s = np.linalg.matrix_power(self.step, wide), np.empty_like(z), state
        for i in range(len(strips)):
            starts[i] = s
            s = jump @ s + z[i]
        y += starts @ answer.T
        # the last strip may end early: its end state is that of the samples it has
        last, end = len(x) - wide * (len(strips) - 1), starts[-1]
        for v in strips[-1, :last]:
            end = self.step @ end + v * self.push
        return y.reshape(-1)[: len(x)], end


def before(head: np.ndarray, n: int, pad: int, turn: int) -> np.ndarray:
    """What goes before a series of n samples: ``pad`` of them reflected, and before these ``turn`` more, turned
    about the first. ``head``: the first pad + turn + 1 samples, or all."""
    at = lambda j: head[np.where(j < 0, -j, np.where(j > n - 1, 2 * (n - 1) - j, j))]
    near = at(np.arange(-pad, turn - pad + 1))
    return np.concatenate([2 * near[0] - near[turn:0:-1], at(np.arange(-pad, 0))])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """The sorted rows of a partition by series, at most ``rows`` at a time."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        codes = [np.asarray(batch.column(k).dictionary_encode().indices) for k in keys]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            series = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and series != last:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            last = series
            while a < b:
                if n == rows:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                step = min(b - a, rows - n)
                held.append(batch.slice(a, step))
                n, a = n + step, a + step
    if held:
        yield pa.Table.from_batches(held)


def _listed(values: list[np.ndarray]) -> pa.Array:
    return pa.array(values, pa.list_(pa.float64()))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return list(column.to_numpy(zero_copy_only=False))


def pieces(df: DataFrame, keys: list[str] = SERIES, rows: int = ROWS) -> DataFrame:
    """keys, at, n, ts, x of each piece, written out; ``at`` numbers them in order. Rows without a key, time or value
    are left out; times may have gaps, and equal ones go by value."""
    kinds = dict(df.dtypes)
    given = df.select(*keys, "t", F.col("value").cast("double").alias("value")).dropna()
    spread = given.repartitionByRange(*keys, "t").sortWithinPartitions(*keys, "t", "value")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, run in enumerate(_runs((b for b in batches if b.num_rows), keys, rows)):
            t, x = run.column("t").combine_chunks(), run.column("value").to_numpy()
            one = [run.column(k).slice(0, 1).combine_chunks() for k in keys]
            yield pa.record_batch([*one, pa.array([first + i]), pa.array([len(x)]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), t), _listed([x])], names=[*keys, "at", "n", "ts", "x"])

    return kept(spread.mapInArrow(each, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", at long, n long, ts array<{kinds['t']}>, x array<double>"), "pieces")


def filtered(df: DataFrame, b: np.ndarray, a: np.ndarray, keys: list[str] = SERIES, pad: int = 100, rows: int = ROWS) -> DataFrame:
    """keys, t, value of the filter run forwards and backwards over each series, with ``pad`` reflected samples a
    side (fewer where there are fewer). As with a whole series, one must be longer than three times the
    filter, reflections included."""
    f, turn = Recursive(b, a), 3 * max(len(a), len(b))
    reach, none = pad + turn + 1, np.zeros(len(a) - 1)
    cut, kinds = pieces(df, keys, rows), dict(df.dtypes)
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def from_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _arrays(batch.column("x"))
            made = [_listed([f.run(v, none)[1] for v in x]), _listed([v[:reach] for v in x]), _listed([v[-reach:] for v in x])]
            yield pa.record_batch([*(batch.column(k) for k in [*keys, "at", "n"]), *made], names=[*keys, "at", "n", "end", "head", "tail"])

    def forwards(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("at")
        n = int(pieces["n"].sum())
        wide = min(pad, n - 1)
        if n + 2 * wide <= turn:
            raise ValueError(f"a signal of more than {turn} samples is needed")
        left = before(_first(pieces["head"], reach), n, wide, turn)
        right = before(_first([v[::-1] for v in pieces["tail"][::-1]], reach), n, wide, turn)[::-1]
        state, enter = f.run(left, f.steady * left[0])[1], []
        for count, end in zip(pieces["n"], pieces["end"], strict=True):
            enter.append(state)
            state = f.after(state, count) + end
        once = f.run(right, state)[0]
        back = f.run(once[::-1], f.steady * once[-1])[1]
        return pieces[[*keys, "at"]].assign(enter=enter, back=[back] * len(pieces))

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [f.run(f.run(x, z)[0][::-1], none)[1] for x, z in zip(_arrays(batch.column("x")), _arrays(batch.column("enter")), strict=True)]
            yield pa.record_batch([*(batch.column(k) for k in [*keys, "at", "n", "enter", "back"]), _listed(ends)], names=[*keys, "at", "n", "enter", "back", "end"])

    def backwards(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("at", ascending=False)
        state, leave = pieces["back"].iloc[0], []
        for count, end in zip(pieces["n"], pieces["end"], strict=True):
            leave.append(state)
            state = f.after(state, count) + end
        return pieces[["at", "enter"]].assign(leave=leave)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(_arrays(batch.column(c)) for c in ("x", "enter", "leave")), strict=True)
            for i, (x, enter, leave) in enumerate(both):
                y = f.run(f.run(x, enter)[0][::-1], leave)[0][::-1]
                same = pa.array(np.full(len(y), i))
                yield pa.record_batch([*(batch.column(k).take(same) for k in keys), batch.column("ts")[i].values, pa.array(y)], names=[*keys, "t", "value"])

    ends = cut.select(*keys, "at", "n", "x").mapInArrow(from_rest, f"{named}, at long, n long, end array<double>, head array<double>, tail array<double>")
    starts = kept(ends.groupBy(*keys).applyInPandas(forwards, f"{named}, at long, enter array<double>, back array<double>"), "starts")
    half = cut.select(*keys, "at", "n", "x").join(starts.select("at", "enter", "back"), "at").mapInArrow(turned, f"{named}, at long, n long, enter array<double>, back array<double>, end array<double>")
    states = kept(half.groupBy(*keys).applyInPandas(backwards, "at long, enter array<double>, leave array<double>"), "states")
    return cut.join(states, "at").mapInArrow(samples, f"{named}, t {kinds['t']}, value double")


def _first(parts: list[np.ndarray], n: int) -> np.ndarray:
    """The first n values of parts in order."""
    got, count = [], 0
    for part in parts:
        got.append(part)
        count += len(part)
        if count >= n:
            break
    return np.concatenate(got)[:n]


def bandpass(df: DataFrame, keys: list[str] = SERIES, order: int = 2, low: float = 0.03, high: float = 0.07, step: float = 0.72, pad: int = 100, rows: int = ROWS) -> DataFrame:
    """``signal.bandpass`` of series of any length."""
    b, a = filters.butter_bandpass(order, low, high, 1 / step)
    return filtered(df, b, a, keys, pad, rows)
