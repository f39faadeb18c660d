"""Hard negatives by dual-tree search over inner products.

Anchors are searched in blocks of bounded size against all rows. Each block is a tree: its anchors split by label, then
by halves along the direction in which they spread most, down to leaves; so is each batch of rows that a task reads.
A pair of nodes bounds all inner products between its members by those of the centres and the radii. Where the upper
end is below what every anchor of the node still needs, or the lower end above what any of them may take, the whole
group of anchors is done with the whole group of rows; other pairs are split, the larger node first, and pairs of leaves
are scored exactly, as whole numbers.

A search fills bands: each anchor has some, of lowest and highest score, and each band gets its best ``k`` rows of the
same or of another label. Positives are one open band of the own label; negatives a band for each positive. A task
raises a band's lowest score to that of its k-th best so far, and hands on k rows a band at most; Spark takes the best
k of all tasks'. Before rows are searched, the anchors themselves are, a hundredth of the work: what they give bounds the
k-th best of all rows from below, so tasks hand on little.

What passes the driver: one block of anchors at a time, its tree (a broadcast of BLOCK vectors at most) and its bands'
results, k a band. Rows never do, and results of a block are appended to a table.

Defined results: rows with a null id, label or vector or any null or non-finite component take no part; in vectors of
different lengths the missing components count as 0. Rows that share an id are rows of their own: each such anchor has
its own result, and all but the anchor itself can be its positives. Equal scores go by id; rows of equal id and score
are interchangeable. An empty table, or one without anchors, gives an empty result. Components beyond 2^24 after scaling
are an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .centroids import SCALE, products
from .common import dropped, on_batches, scratch, stored

#: Anchors of a block; rows of a leaf.
BLOCK, LEAF = 8_192, 128
LIMIT = 1 << 24
NONE = np.iinfo(np.int64).min // 4
_FOUND = "slot int, band int, score long, vec_id long, row long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def prepared(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row, vec_id, label, v (components as little-endian integers) of the rows that take part. ``row`` tells rows
    of one id apart."""
    kept = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    kept = kept.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))).withColumn("row", F.monotonically_increasing_id())

    def packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column("vector")
        x = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        if len(x) and np.abs(x).max() > LIMIT:
            raise ValueError(f"a component exceeds {LIMIT} after scaling")
        ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32) * 4
        data = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(ends), pa.py_buffer(x.astype("<i4").tobytes())])
        yield pa.record_batch([batch.column("row"), batch.column("vec_id"), batch.column("label"), data], names=["row", "vec_id", "label", "v"])

    return on_batches(kept, packed, "row long, vec_id long, label long, v binary")


def unpacked(vectors: list[bytes]) -> np.ndarray:
    """(n, longest) int32, shorter vectors filled up with zeros."""
    width = max(map(len, vectors), default=0)
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in vectors), "<i4").reshape(len(vectors), width // 4)


@dataclass
class Tree:
    """Nodes over rows in an order of their own: node i holds rows first[i] to last[i] of one label; ``left`` and
    ``right`` are 0 for a leaf. ``tops``: the node of each label."""

    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    tops: list[int]


def tree(x: np.ndarray, label: np.ndarray, leaf: int = LEAF) -> Tree:
    """Split by label, then along the direction from a far row to the row farthest from that."""
    order = np.argsort(label, kind="stable")
    y = x[order].astype(np.float64)
    kinds, starts = np.unique(label[order], return_index=True)
    nodes: list[list] = []
    stack = [(int(a), int(b), int(k), -1, 0) for a, b, k in zip(starts, [*starts[1:], len(x)], kinds, strict=True)]
    tops = []
    while stack:
        a, b, k, parent, side = stack.pop()
        here = y[a:b]
        centre = here.mean(0)
        off = here - centre
        apart = np.einsum("ij,ij->i", off, off)
        me = len(nodes)
        nodes.append([a, b, 0, 0, k, centre, float(np.sqrt(apart.max()))])
        if parent < 0:
            tops.append(me)
        else:
            nodes[parent][2 + side] = me
        if b - a > leaf:
            one = here[int(apart.argmax())]
            gap = here - one
            other = here[int(np.einsum("ij,ij->i", gap, gap).argmax())]
            along = here @ (other - one)
            near = along < (one + other) @ (other - one) / 2
            n = int(near.sum())
            # half-way between the two, or where that cuts off little (equal rows too), at the median
            if min(n, b - a - n) * 16 >= b - a:
                by = np.argsort(~near, kind="stable")
            else:
                n = (b - a) // 2
                by = np.argpartition(along, n)
            order[a:b], y[a:b] = order[a:b][by], here[by]
            stack += [(a, a + n, k, me, 0), (a + n, b, k, me, 1)]
    column = lambda i, kind: np.array([n[i] for n in nodes], kind)
    centre = np.stack([n[5] for n in nodes]) if nodes else np.zeros((0, x.shape[1]))
    return Tree(order, column(0, np.int64), column(1, np.int64), column(2, np.int64), column(3, np.int64), column(4, np.int64), centre, column(6, float), np.linalg.norm(centre, axis=1), tops)


def best(band: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each band: higher scores, then smaller ids."""
    by = np.lexsort((vec_id, -score, band))
    start = np.flatnonzero(np.r_[True, band[by][1:] != band[by][:-1]]) if len(by) else np.zeros(0, np.int64)
    rank = np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by))))
    return by[rank < k]


@dataclass
class Block:
    """Anchors in the order of their tree, and for each its bands (n, J): lowest and highest score wanted."""

    tree: Tree
    row: np.ndarray
    vec_id: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Search:
    """What a task has found for a block's bands."""

    def __init__(self, block: Block, own: bool, k: int):
        self.b, self.own, self.k = block, own, k
        self.bands = block.low.shape[1]
        self.low, self.high = block.low.copy(), block.high
        self.low_id = np.full(self.low.shape, np.iinfo(np.int64).max)  # a score at ``low`` counts up to this id
        # the first k so far of each band: score (NONE: nothing yet), id, row
        self.held = [np.full((*self.low.shape, k), NONE), *(np.zeros((*self.low.shape, k), np.int64) for _ in range(2))]
        self.scored = self.passed = 0

    def _bounds(self, t: Tree, a: int, c: int) -> tuple[float, float]:
        """Of the inner products between two nodes, widened by far more than rounding can be off."""
        s = self.b.tree
        n = min(s.centre.shape[1], t.centre.shape[1])
        middle = float(s.centre[a, :n] @ t.centre[c, :n])
        wide = s.norm[a] * t.radius[c] + t.norm[c] * s.radius[a] + s.radius[a] * t.radius[c]
        slack = 1e-9 * (s.norm[a] + s.radius[a]) * (t.norm[c] + t.radius[c]) + 1e-6
        return middle - wide - slack, middle + wide + slack

    def search(self, x: np.ndarray, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray) -> None:
        t, s = tree(x, label), self.b.tree
        x, row, vec_id = x[t.order], row[t.order], vec_id[t.order]
        stack: list[tuple[float, float, int, int]] = []

        def put(pairs: list[tuple[int, int]]) -> None:
            """The pair with the largest products is worked on first, so that later ones face higher bars."""
            stack.extend(sorted(((*self._bounds(t, a, c), a, c) for a, c in pairs), key=lambda p: p[1]))

        put([(a, c) for a in s.tops for c in t.tops if (s.label[a] == t.label[c]) == self.own])
        while stack:
            low, high, a, c = stack.pop()
            at = slice(s.first[a], s.last[a])
            if high < self.low[at].min() or low > self.high[at].max():
                self.passed += 1
                continue
            split_a, split_c = s.left[a] > 0, t.left[c] > 0
            if split_a and (not split_c or s.radius[a] >= t.radius[c]):
                put([(s.left[a], c), (s.right[a], c)])
            elif split_c:
                put([(a, t.left[c]), (a, t.right[c])])
            else:
                self._leaves(at, x[t.first[c] : t.last[c]], row[t.first[c] : t.last[c]], vec_id[t.first[c] : t.last[c]])

    def _leaves(self, at: slice, x: np.ndarray, row: np.ndarray, vec_id: np.ndarray) -> None:
        n = min(x.shape[1], self.b.x.shape[1])
        score = products(self.b.x[at, :n], x[:, :n])
        self.scored += 1
        fit = (score[:, None] <= self.high[at, :, None]) & ((score[:, None] > self.low[at, :, None]) | ((score[:, None] == self.low[at, :, None]) & (vec_id[None, None] < self.low_id[at, :, None])))
        if self.own:
            fit &= (self.b.row[at, None] != row[None])[:, None]
        i, j, c = np.nonzero(fit)
        if not len(i):
            return
        held = [h[at].reshape(-1, self.k) for h in self.held]
        band = np.unique(i * self.bands + j)
        old = np.nonzero(held[0][band] != NONE)
        all_ = [np.r_[band[old[0]], i * self.bands + j], *(np.r_[h[band][old], new] for h, new in zip(held, (score[i, c], vec_id[c], row[c]), strict=True))]
        keep = best(*all_[:3], self.k)
        of, *values = (v[keep] for v in all_)
        start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        place = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        for h, v in zip(held, values, strict=True):
            h[of, place] = v
        full = place == self.k - 1
        low, low_id = (v[at].reshape(-1) for v in (self.low, self.low_id))
        low[of[full]], low_id[of[full]] = values[0][full], values[1][full]

    def result(self) -> list[np.ndarray]:
        """slot, band, score, id, row of what is held."""
        slot, band, place = np.nonzero(self.held[0] != NONE)
        return [slot.astype(np.int32), band.astype(np.int32), *(h[slot, band, place] for h in self.held)]


def found(rows: DataFrame, block: Block, own: bool, k: int) -> dict[str, np.ndarray]:
    """slot, band, score, vec_id, row of the first k of each band over all rows, sorted so."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, own, k)
        for batch in batches:
            if batch.num_rows:
                search.search(unpacked(batch.column("v").to_pylist()), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label")))
        yield pa.record_batch([pa.array(v) for v in search.result()], names=["slot", "band", "score", "vec_id", "row"])

    first = Window.partitionBy("slot", "band").orderBy(F.desc("score"), "vec_id", "row")
    got = rows.mapInArrow(each, _FOUND).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n").toArrow()
    shared.destroy()
    out = {c: got.column(c).to_numpy() for c in ("slot", "band", "score", "vec_id", "row")}
    by = np.lexsort((out["row"], out["vec_id"], -out["score"], out["band"], out["slot"]))
    return {c: v[by] for c, v in out.items()}


def searched(rows: DataFrame, anchors: DataFrame, block: Block, own: bool, k: int) -> dict[str, np.ndarray]:
    """``found``, after the k-th best among the anchors has raised the bands' lowest scores."""
    few = found(anchors, block, own, k)
    band = few["slot"].astype(np.int64) * block.low.shape[1] + few["band"]
    full = np.flatnonzero(np.r_[band[1:] != band[:-1], True]) if len(band) else np.zeros(0, np.int64)
    full = full[np.diff(np.append(-1, full)) == k]
    low = block.low.copy()
    low.reshape(-1)[band[full]] = few["score"][full]
    return found(rows, Block(block.tree, block.row, block.vec_id, block.x, low, block.high), own, k)


def mined(block: Block, rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, share: tuple[int, int]) -> pa.Table:
    """The result rows of one block of anchors."""
    good = searched(rows, anchors, block, True, positives)
    n = len(block.row)
    # the j-th positive of each anchor has band j; bands without a positive want nothing
    new = np.flatnonzero(np.r_[True, good["slot"][1:] != good["slot"][:-1]]) if len(good["slot"]) else np.zeros(0, np.int64)
    at = np.arange(len(good["slot"])) - np.repeat(new, np.diff(np.append(new, len(good["slot"]))))
    low, high = np.full((n, positives), -NONE), np.full((n, positives), NONE)
    score, ids = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
    score[good["slot"], at], ids[good["slot"], at] = good["score"], good["vec_id"]
    least, most = (Fraction(v, 100) for v in share)
    low[good["slot"], at] = -(-least.numerator * good["score"] // least.denominator)
    high[good["slot"], at] = most.numerator * good["score"] // most.denominator
    empty = low > high
    low[empty], high[empty] = -NONE, NONE
    bad = searched(rows, anchors, Block(block.tree, block.row, block.vec_id, block.x, low, high), False, negatives)
    slot, band = bad["slot"].astype(np.int64), bad["band"].astype(np.int64)
    group = slot * positives + band
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group)))) + 1
    columns = [block.vec_id[slot], ids[slot, band], rank.astype(np.int32), bad["vec_id"], score[slot, band], bad["score"]]
    return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in _RESULT.split(", ")])


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), block_rows: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (an id divisible
    by ``every``) and each of its positives, the best rows of other labels whose score is between the two
    percentages of the positive's."""
    spark = embeddings.sparkSession
    rows = stored(prepared(embeddings), "negatives-rows")
    anchors = stored(rows.where(F.col("vec_id") % every == 0), "negatives-anchors")
    out, some = f"{scratch(spark)}/negatives-{uuid.uuid4().hex}", False
    for part in batched(anchors.toLocalIterator(), block_rows):
        x, label = unpacked([bytes(r["v"]) for r in part]), np.array([r["label"] for r in part])
        t = tree(x, label)
        n = len(part)
        block = Block(t, np.array([r["row"] for r in part])[t.order], np.array([r["vec_id"] for r in part])[t.order], x[t.order], np.full((n, 1), NONE), np.full((n, 1), -NONE))
        result = mined(block, rows, anchors, positives, negatives, share)
        spark.createDataFrame(result, _RESULT).write.mode("append").parquet(out)
        some = True
    dropped(anchors, rows)
    return spark.read.schema(_RESULT).parquet(out) if some else spark.createDataFrame([], _RESULT)
