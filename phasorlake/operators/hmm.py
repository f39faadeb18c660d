"""Hidden Markov models over sequences of observations: likelihood, most likely path, training.

Sequences are rows with ``seq_id`` and ``t``; lengths may differ. The initial distribution is ``delta``, the
transition matrix ``T`` (rows sum to 1).

Rows are range-partitioned by sequence and time, so partitions are of even size whatever the sequences' lengths, and a
partition's rows stream through in order. A sequence inside a partition is worked on at once. One that lies across
partitions, or is longer than ROWS, is a chain of pieces: a piece is summarised by its first row and a K x K matrix, the
product of its other rows' transitions (of sums of paths for likelihoods, of best paths for Viterbi); the products of a
sequence's pieces, in order, say what every piece starts from and what follows it, and each piece is then worked on
alone. No task holds more than a piece, or the summaries of one sequence, K x K numbers for each partition it crosses.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from . import gradient
from .families import Family, Params
from .kernels import Sums, columns_of, few, flat, kind_of, numbers_in, observations, shaped, totals
from .mixture import Mixture, moment_name, validate

#: Rows of a piece at most; rows whose matrices are multiplied at once.
ROWS, STRIP = 1 << 17, 1 << 10


def layout(n: int, lengths: int | list[int] = 0) -> list[int]:
    """The lengths of sequences that n rows in order are cut into: 0 one sequence, a number equal ones, a list
    as it is or, where its sum divides n, again and again."""
    if isinstance(lengths, int):
        lengths = [lengths or n]
    if sum(lengths) <= 0 or n % sum(lengths):
        raise ValueError(f"sequences of {lengths} don't make up {n} rows")
    return list(lengths) * (n // sum(lengths))


def sequenced(df: DataFrame, lengths: int | list[int] = 0, id_column: str = "obs_id") -> DataFrame:
    """Add seq_id and t to rows whose ids count from 0: each id falls into the period of the lengths. The last period
    may end early, with a sequence cut short or without its last ones."""
    period = [lengths or df.count()] if isinstance(lengths, int) else list(lengths)
    if sum(period) <= 0:
        raise ValueError(f"sequences of {lengths} hold no rows")
    starts = [sum(period[:i]) for i in range(len(period))]
    at = F.col(id_column) % sum(period)
    place = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= at)) - 1
    whole = F.floor(F.col(id_column) / sum(period)) * len(period)
    return df.withColumn("seq_id", (whole + place).cast("long")).withColumn("t", (at - F.get(F.array(*map(F.lit, starts)), place)).cast("long"))


# -- pieces ---------------------------------------------------------------------------------------


def in_order(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("seq_id", "t", *columns).repartitionByRange("seq_id", "t").sortWithinPartitions("seq_id", "t")


def runs(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[bool, int, pa.Table]]:
    """(whole, number, rows) of the sequences in a partition's rows, which come in order. Only the first and the last
    of a partition, and those cut at ``rows``, can be parts of longer ones: the others are whole."""
    held: list[pa.RecordBatch] = []
    n, number, cut = 0, TaskContext.get().partitionId() << 32, True

    for batch in batches:
        if not batch.num_rows:
            continue
        seq = batch.column("seq_id")
        if held and held[-1].column("seq_id")[-1].as_py() != seq[0].as_py():
            yield not cut, number, pa.Table.from_batches(held)
            held, n, number, cut = [], 0, number + 1, False
        code = np.asarray(seq.dictionary_encode(null_encoding="encode").indices)
        edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
        for a, b in zip(edges, edges[1:]):
            if a:
                yield not cut, number, pa.Table.from_batches(held)
                held, n, number, cut = [], 0, number + 1, False
            while a < b:
                if n == rows:
                    yield False, number, pa.Table.from_batches(held)
                    held, n, number, cut = [], 0, number + 1, True
                step = min(b - a, rows - n)
                held.append(batch.slice(a, step))
                n, a = n + step, a + step
    if held:
        yield False, number, pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat_ = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat_.reshape(len(column), -1)


def lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(a - top).sum(axis)) + np.squeeze(top, axis)


def times(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    """Products of (n, K, K) matrices, of sums of paths or of best paths."""
    both = a[..., :, :, None] + b[..., None, :, :]
    return both.max(-2) if best else lse(both, -2)


def chained(vector: np.ndarray, m: np.ndarray, best: bool) -> np.ndarray:
    both = vector[:, None] + m
    return both.max(0) if best else lse(both, 0)


def product(lp: np.ndarray, log_t: np.ndarray, best: bool) -> np.ndarray:
    """That of the transitions into each row; of no rows the unit."""
    with np.errstate(divide="ignore"):
        out = np.log(np.eye(len(log_t)))
    for a in range(0, len(lp), STRIP):
        m = log_t + lp[a : a + STRIP, None, :]
        while len(m) > 1:
            odd = m[-1:] if len(m) % 2 else m[:0]
            m = np.concatenate([times(m[0 : len(m) - len(m) % 2 : 2], m[1::2], best), odd])
        out = times(out, m[0], best)
    return out


def summary(lp: np.ndarray, log_t: np.ndarray, best: bool) -> bytes:
    """First row, and the product over the others."""
    return np.concatenate([lp[:1], product(lp[1:], log_t, best)]).tobytes()


def _summaries(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    rows = rows.sort_values("piece")
    flat_ = [np.frombuffer(s) for s in rows["summary"]]
    k = int((-1 + (1 + 4 * len(flat_[0])) ** 0.5) / 2)
    return rows, np.stack(flat_).reshape(len(rows), k + 1, k)


def entered(m: np.ndarray, before: np.ndarray | None, log_delta: np.ndarray, log_t: np.ndarray, best: bool) -> np.ndarray:
    """The scores of the states at a piece's first row: from the start of the sequence, or after ``before``."""
    return (log_delta if before is None else chained(before, log_t, best)) + m[0]


def logs(delta: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        return np.log(delta), np.log(t)


def _type(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


# -- likelihood, transitions, paths ---------------------------------------------------------------


def likelihoods(df: DataFrame, delta: np.ndarray, t: np.ndarray, rows: int = ROWS) -> DataFrame:
    """seq_id, n, loglik. ``df``: seq_id, t, lp array<double>."""
    log_delta, log_t = logs(delta, t)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, number, run in runs(batches, rows):
            lp = matrix(run.column("lp"))
            end = lse(chained(log_delta + lp[0], product(lp[1:], log_t, False), False), 0) if whole else None
            yield pa.record_batch([run.column("seq_id").slice(0, 1).combine_chunks(), pa.array([len(lp)]), pa.array([end], pa.float64()), pa.array([number]), pa.array([None if whole else summary(lp, log_t, False)], pa.binary())], names=["seq_id", "n", "loglik", "piece", "summary"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows, ms = _summaries(rows)
        before = None
        for m in ms:
            before = chained(entered(m, before, log_delta, log_t, False), m[1:], False)
        return pd.DataFrame({"seq_id": rows["seq_id"].iloc[:1].to_numpy(), "n": [int(rows["n"].sum())], "loglik": [float(lse(before, 0))]})

    out = f"seq_id {_type(df, 'seq_id')}, n long, loglik double"
    pieces = kept(in_order(df, "lp").mapInArrow(each, f"{out}, piece long, summary binary"), "likelihoods")
    cut = pieces.where("summary is not null").groupBy("seq_id").applyInPandas(join, out)
    return pieces.where("summary is null").select("seq_id", "n", "loglik").union(cut)


def transitions(df: DataFrame, k: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """T and delta from posteriors: products of neighbours summed over a sequence and divided by its length,
    averaged over sequences, rows to 1; delta is the mean of the first posteriors. ``df``: seq_id, t, post."""
    names = ["seq_id", "piece", "n", "first", "last", "pairs"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for whole, number, run in runs(batches, rows):
            p = matrix(run.column("post"))
            pairs = p[:-1].T @ p[1:]
            if whole:
                sums += np.concatenate([p[:1], pairs / len(p)])
            else:
                yield pa.record_batch([run.column("seq_id").slice(0, 1).combine_chunks(), pa.array([number]), pa.array([len(p)]), *(pa.array([v.tobytes()]) for v in (p[0], p[-1], pairs))], names=names)
        yield pa.record_batch([pa.nulls(1, seq_type), pa.array([-1]), pa.array([0]), *(pa.array([v], pa.binary()) for v in (None, None, sums.tobytes()))], names=names)

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        first, last = (np.stack([np.frombuffer(v) for v in rows[c]]) for c in ("first", "last"))
        pairs = sum(np.frombuffer(v).reshape(k, k) for v in rows["pairs"]) + last[:-1].T @ first[1:]
        return pd.DataFrame({"pairs": [np.concatenate([first[:1], pairs / rows["n"].sum()]).tobytes()]})

    ordered = in_order(df, "post")
    seq_type = df.select("seq_id").limit(0).toArrow().schema.field("seq_id").type
    pieces = kept(ordered.mapInArrow(each, f"seq_id {_type(df, 'seq_id')}, piece long, n long, first binary, last binary, pairs binary"), "transitions")
    every = pieces.where("piece < 0").select("pairs").union(pieces.where("piece >= 0").groupBy("seq_id").applyInPandas(join, "pairs binary"))

    def added(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        got = [np.frombuffer(v) for batch in batches for v in batch.column("pairs").to_pylist()]
        return np.sum(got, 0) if got else None

    sums = totals(every, added, k * (k + 1), False).reshape(k + 1, k)
    return sums[1:] / sums[1:].sum(1, keepdims=True), sums[0] / sums[0].sum()


def scores(lp: np.ndarray, first: np.ndarray, log_t: np.ndarray) -> np.ndarray:
    """Of the best path to each state at each row, from those of the first row."""
    out = np.empty_like(lp)
    out[0] = first
    for i in range(1, len(lp)):
        out[i] = (out[i - 1][:, None] + log_t).max(0) + lp[i]
    return out


def traced(score: np.ndarray, log_t: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The best paths back from the last row's states, lowest state first where equal."""
    path = np.empty((len(score), *np.shape(last)), np.int32)
    path[-1] = last
    back = (score[:-1, :, None] + log_t).argmax(1)
    for i in range(len(score) - 2, -1, -1):
        path[i] = back[i, path[i + 1]]
    return path


def viterbi(df: DataFrame, delta: np.ndarray, t: np.ndarray, rows: int = ROWS) -> DataFrame:
    """seq_id, t, state: the most likely path, lowest state first where equal. ``df``: seq_id, t, lp.

    Of a sequence in pieces, best scores go forwards through the summaries; each piece then says from which state
    before it each of its last states is reached; the last states follow backwards from the end."""
    log_delta, log_t = logs(delta, t)
    seq, at, k = _type(df, "seq_id"), _type(df, "t"), len(delta)
    names = ["seq_id", "ts", "states", "piece", "lp", "summary"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, number, run in runs(batches, rows):
            lp, ts = matrix(run.column("lp")), run.column("t").combine_chunks()
            states = None
            if whole:
                score = scores(lp, log_delta + lp[0], log_t)
                states = traced(score, log_t, score[-1].argmax())
            rest = [None, None] if whole else [lp.tobytes(), summary(lp, log_t, True)]
            yield pa.record_batch([run.column("seq_id").slice(0, 1).combine_chunks(), pa.ListArray.from_arrays(pa.array([0, len(ts)], pa.int32()), ts), pa.array([states], pa.list_(pa.int32())), pa.array([number]), *(pa.array([v], pa.binary()) for v in rest)], names=names)

    def forwards(rows: pd.DataFrame) -> pd.DataFrame:
        rows, ms = _summaries(rows)
        firsts, before = [], None
        for m in ms:
            firsts.append(entered(m, before, log_delta, log_t, True))
            before = chained(firsts[-1], m[1:], True)
        return pd.DataFrame({"of": rows["piece"], "first": [f.tobytes() for f in firsts]})

    def sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first_states, ends = [], []
            for raw, first in zip(batch.column("lp").to_pylist(), batch.column("first").to_pylist(), strict=True):
                score = scores(np.frombuffer(raw).reshape(-1, k), np.frombuffer(first), log_t)
                first_states.append(traced(score, log_t, np.arange(k))[0].tolist())
                ends.append(score[-1].tobytes())
            yield pa.record_batch([batch.column("seq_id"), batch.column("piece"), pa.array(first_states, pa.list_(pa.int32())), pa.array(ends, pa.binary())], names=["seq_id", "piece", "firsts", "end"])

    def backwards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece")
        ends, firsts = [np.frombuffer(e) for e in rows["end"]], rows["firsts"].tolist()
        last = [0] * len(rows)
        last[-1] = int(ends[-1].argmax())
        for i in range(len(rows) - 2, -1, -1):
            last[i] = int((ends[i] + log_t[:, firsts[i + 1][last[i + 1]]]).argmax())
        return pd.DataFrame({"of": rows["piece"], "last": last})

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for raw, first, last in zip(*(batch.column(c).to_pylist() for c in ("lp", "first", "last")), strict=True):
                score = scores(np.frombuffer(raw).reshape(-1, k), np.frombuffer(first), log_t)
                states.append(traced(score, log_t, last).tolist())
            yield pa.record_batch([batch.column("seq_id"), batch.column("ts"), pa.array(states, pa.list_(pa.int32()))], names=["seq_id", "ts", "states"])

    held = kept(in_order(df, "lp").mapInArrow(each, f"seq_id {seq}, ts array<{at}>, states array<int>, piece long, lp binary, summary binary"), "paths")
    cut = held.where("summary is not null")
    starts = kept(cut.select("seq_id", "piece", "summary").groupBy("seq_id").applyInPandas(forwards, "of long, first binary"), "path-starts")
    begun = cut.select("seq_id", "ts", "piece", "lp").join(starts, F.col("piece") == F.col("of")).drop("of")
    ends = begun.select("seq_id", "piece", "lp", "first").mapInArrow(sources, f"seq_id {seq}, piece long, firsts array<int>, end binary").groupBy("seq_id").applyInPandas(backwards, "of long, last int")
    rest = begun.join(ends, F.col("piece") == F.col("of")).select("seq_id", "ts", "lp", "first", "last").mapInArrow(paths, f"seq_id {seq}, ts array<{at}>, states array<int>")
    every = held.where("summary is null").select("seq_id", "ts", "states").union(rest)
    return every.select("seq_id", F.explode(F.arrays_zip("ts", "states")).alias("r")).select("seq_id", F.col("r.ts").alias("t"), F.col("r.states").alias("state"))


# -- training -------------------------------------------------------------------------------------


def smoothed(lp: np.ndarray, first: np.ndarray, log_t: np.ndarray, after: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """ln P, the states' posteriors, and the sum over time of the transitions' posteriors. ``first``: the logarithms
    of the states' weights before the first row's densities; ``after``: of what follows the last row."""
    n, k = lp.shape
    t = np.exp(log_t)
    top, most = lp.max(1, keepdims=True), first.max()
    b = np.exp(lp - top)
    alpha, scale = np.empty((n, k)), np.empty(n)
    a = np.exp(first - most) * b[0]
    for i in range(n):
        if i:
            a = (alpha[i - 1] @ t) * b[i]
        scale[i] = a.sum()
        alpha[i] = a / scale[i]
    beta = np.ones((n, k))
    if after is not None:
        beta[-1] = np.exp(after - after.max())
        beta[-1] /= alpha[-1] @ beta[-1]
    for i in range(n - 2, -1, -1):
        beta[i] = t @ (b[i + 1] * beta[i + 1]) / scale[i + 1]
    pairs = np.einsum("ni,ij,nj->ij", alpha[:-1], t, b[1:] * beta[1:] / scale[1:, None]) if n > 1 else np.zeros((k, k))
    return float(np.log(scale).sum() + top.sum() + most), alpha * beta, pairs


@dataclass
class Hmm:
    family: Family
    theta: Params
    delta: np.ndarray
    t: np.ndarray
    curve: list[float] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        """seq_id, n, loglik."""
        return likelihoods(Mixture(self.family, self.theta).densities(df), self.delta, self.t)

    def paths(self, df: DataFrame) -> DataFrame:
        return viterbi(Mixture(self.family, self.theta).densities(df), self.delta, self.t)


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(float).tobytes() if np.iscomplexobj(x) else np.ascontiguousarray(x, float).tobytes()


def _unpacked(raw: bytes, family: Family) -> np.ndarray:
    x = np.frombuffer(raw)
    return (x.view(complex) if family.is_complex else x).reshape(-1, *family.shape)


@dataclass
class State:
    """What a step of training asks the sums of."""

    family: Family
    theta: Params
    delta: np.ndarray
    t: np.ndarray


def _shapes(m: State) -> dict[str, tuple[int, ...]]:
    k, p = len(m.delta), m.family.p
    return {"loglik": (1,), "first": (k,), "pairs": (k, k), "weight": (k,), moment_name(m.family): (k, p, p)}


@dataclass
class Sequences:
    """Observations in order, cached: a row for each piece; ``part`` where a sequence has several."""

    pieces: DataFrame
    cut: bool

    def sums(self, models: list[State]) -> list[Sums]:
        """For each model loglik, first (states of the sequences' first rows), pairs (transitions), weight (states) and
        the family's moment, by forward and backward passes; all models in one pass over the pieces."""
        shapes = [_shapes(m) for m in models]
        log = [logs(m.delta, m.t) for m in models]

        def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = [[summary(m.family.log_pdf(_unpacked(raw, m.family), m.theta), log_t, False) for m, (_, log_t) in zip(models, log, strict=True)] for raw in batch.column("data").to_pylist()]
                yield pa.record_batch([batch.column("seq_id"), batch.column("piece"), pa.array(of, pa.list_(pa.binary()))], names=["seq_id", "piece", "summaries"])

        def around(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("piece")
            before, after = [[] for _ in range(len(rows))], [[] for _ in range(len(rows))]
            for i, (log_delta, log_t) in enumerate(log):
                _, ms = _summaries(pd.DataFrame({"piece": rows["piece"], "summary": [s[i] for s in rows["summaries"]]}))
                now = None
                for n, m in enumerate(ms):
                    before[n].append(None if now is None else now.tobytes())
                    now = chained(entered(m, now, log_delta, log_t, False), m[1:], False)
                    now = now - lse(now, 0)
                now = np.zeros(len(log_delta))
                for n in range(len(ms) - 1, -1, -1):
                    after[n].append(None if n == len(ms) - 1 else now.tobytes())
                    now = lse(log_t + (ms[n][0] + lse(ms[n][1:] + now, 1)), 1)
                    now = now - now.max()
            return pd.DataFrame({"of": rows["piece"], "before": before, "after": after})

        def one(m: State, log_delta: np.ndarray, log_t: np.ndarray, x: np.ndarray, before: bytes | None, after: bytes | None) -> Sums:
            lp = m.family.log_pdf(x, m.theta)
            enter = None if before is None else np.frombuffer(before)
            start = log_delta if enter is None else chained(enter, log_t, False)
            value, post, pairs = smoothed(lp, start, log_t, None if after is None else np.frombuffer(after))
            if enter is not None:  # the transition into the piece
                move = np.exp(enter)[:, None] * np.exp(log_t)
                into = move.sum(0)
                pairs = pairs + move / np.where(into > 0, into, 1) * post[0]
            first = post[0] if enter is None else np.zeros(len(log_delta))
            return {"loglik": np.array([value]), "first": first, "pairs": pairs, "weight": post.sum(0), moment_name(m.family): m.family.moments(x, post, m.theta)}

        def added(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            total = None
            for batch in batches:
                for raw, before, after in zip(*(batch.column(c).to_pylist() for c in ("data", "before", "after")), strict=True):
                    got = [flat(one(m, *log[i], _unpacked(raw, m.family), before and before[i], after and after[i]), shapes[i]) for i, m in enumerate(models)]
                    total = np.concatenate(got) if total is None else total + np.concatenate(got)
            return total

        none = F.lit(None).cast("array<binary>")
        rows = self.pieces.select("data", none.alias("before"), none.alias("after"))
        if self.cut:
            cut = self.pieces.where("part").select("seq_id", "piece", "data").mapInArrow(summaries, f"seq_id {_type(self.pieces, 'seq_id')}, piece long, summaries array<binary>")
            sides = cut.groupBy("seq_id").applyInPandas(around, "of long, before array<binary>, after array<binary>")
            rows = self.pieces.join(sides, F.col("piece") == F.col("of"), "left").select("data", "before", "after")
        sizes = [sum(numbers_in(n, s) for n, s in one.items()) for one in shapes]
        total = totals(rows, added, sum(sizes), few(self.pieces, sum(sizes)))
        return [shaped(v, one) for v, one in zip(np.split(total, np.cumsum(sizes)[:-1]), shapes, strict=True)]


def cut_up(df: DataFrame, rows: int = ROWS) -> Sequences:
    """Store a frame's observations (seq_id, t, the observation) in order; sequences that turn out to lie in one piece
    are whole."""
    kind, columns = kind_of(df), columns_of(df)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, number, run in runs(batches, rows):
            x = np.concatenate([observations(b, kind, columns) for b in run.to_batches() if b.num_rows])
            yield pa.record_batch([run.column("seq_id").slice(0, 1).combine_chunks(), pa.array([number]), pa.array([not whole]), pa.array([_packed(x)], pa.binary())], names=["seq_id", "piece", "part", "data"])

    held = kept(in_order(df, *columns).mapInArrow(each, f"seq_id {_type(df, 'seq_id')}, piece long, part boolean, data binary"), "sequences")
    several = held.where("part").groupBy("seq_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("seq_id").alias("s"))
    cut = several.limit(1).count() > 0
    if cut:
        pieces = held.join(several, F.col("seq_id").eqNullSafe(F.col("s")), "left").withColumn("part", F.col("s").isNotNull()).drop("s")
    else:
        pieces = held.withColumn("part", F.lit(False))
    return Sequences(pieces.cache(), cut)


#: Yields what it asks the sums of, is sent them, returns a model.
Training = Generator[State, Sums, Hmm]


def training(family: Family, theta: Params, delta: np.ndarray, t: np.ndarray, tol: float = 1e-8, max_iter: int = 100, num_comparison: int = 10, lr: float = 0.0, decrease_lr_on_plateau: bool = False) -> Training:
    """Baum-Welch from parameters, or with ``lr`` gradient steps of that rate, whose gradients are the same sums."""
    best = Hmm(family, theta, delta, t)
    curve: list[float] = []
    adam = gradient.Adam(lr)
    plateau = gradient.Plateau(adam, tol, num_comparison, decrease_lr_on_plateau)
    free = gradient.to_free(family, theta | {"pi": delta}) | {"T": gradient.logits(t)} if lr else {}
    for _ in range(max_iter):
        if lr:
            theta = gradient.to_natural(family, {n: v for n, v in free.items() if n != "T"})
            delta, t = theta["pi"], gradient.soft(free["T"])
        got = yield State(family, theta, delta, t)
        curve.append(float(got["loglik"][0]))
        if np.isnan(curve[-1]):
            raise FloatingPointError("the log-likelihood is not a number")
        if curve[-1] == max(curve):
            best = Hmm(family, theta, delta, t)
        if lr:
            up = gradient.emission(family, free, theta, got["weight"], got[moment_name(family)])
            up |= {"pi": got["first"] - got["first"].sum() * delta, "T": got["pairs"] - got["pairs"].sum(1, keepdims=True) * t}
            free = adam.step(free, up)
            if plateau.reached(curve):
                break
            continue
        recent = curve[-num_comparison:]
        if len(curve) > num_comparison and (max(recent) - sorted(recent)[-2]) / abs(max(recent)) < tol:
            break
        delta = got["first"] / got["first"].sum()
        t = got["pairs"] / np.maximum(got["pairs"].sum(1, keepdims=True), 1e-300)
        theta = family.finish(got[moment_name(family)], got["weight"], theta) | {"pi": got["weight"] / got["weight"].sum()}
    best.curve = curve
    return best


def trained(sequences: Sequences, fits: list[Training]) -> list[Hmm]:
    """Run fits with one pass for all that still ask."""
    results: list[Hmm | None] = [None] * len(fits)
    asks: dict[int, State] = {}

    def on(i: int, sums: Sums | None) -> None:
        try:
            asks[i] = fits[i].send(sums)
        except StopIteration as end:
            results[i] = end.value
            asks.pop(i, None)

    for i in range(len(fits)):
        on(i, None)
    while asks:
        served = list(asks)
        for i, sums in zip(served, sequences.sums([asks[i] for i in served]), strict=True):
            on(i, sums)
    return results


def fit_all(df: DataFrame, mixtures: list[Mixture], tol: float = 1e-8, max_iter: int = 100, num_comparison: int = 10, lr: list[float] | None = None, decrease_lr_on_plateau: bool = False, rows: int = ROWS) -> list[Hmm]:
    """A model from each mixture's parameters; all share their passes. ``lr``: each one's rate, 0 for Baum-Welch."""
    for m in mixtures:
        validate(df, m.family)
    starts = [transitions(m.score(df), len(m.theta["pi"]), rows) for m in mixtures]
    sequences = cut_up(df, rows)
    try:
        return trained(sequences, [training(m.family, m.theta, delta, t, tol, max_iter, num_comparison, rate, decrease_lr_on_plateau) for m, (t, delta), rate in zip(mixtures, starts, lr or [0.0] * len(mixtures), strict=True)])
    finally:
        sequences.pieces.unpersist()


def fit(df: DataFrame, mixture: Mixture, k: int, tol: float = 1e-8, max_iter: int = 100, num_comparison: int = 10, lr: float = 0.0, decrease_lr_on_plateau: bool = False, rows: int = ROWS) -> Hmm:
    """From a mixture's parameters by Baum-Welch, or with ``lr`` by gradient steps of that rate. ``df``: seq_id, t and
    the observation."""
    return fit_all(df, [mixture], tol, max_iter, num_comparison, [lr], decrease_lr_on_plateau, rows)[0]
