"""Text quality by a byte-level convolutional network, in numpy.

A text is a row of bytes, padded with zeros to whole strides. Filters see WIDTH bytes at every STRIDE-th
byte, through a learned table of byte vectors. Overlapping chunks of 512 bytes, of which the next starts
after 384, cover the text; a chunk's value for a filter is its largest response, a text's features are the
largest and the mean of its chunks' values, and a logistic unit combines them.

Learning: whole texts of a bounded sample of labelled rows (``bound``, and BYTES in all: the sample is thinned by
digest where its texts are longer, and a text of more than a tenth of that is not learnt from), with Adam, on
the driver; the sample is the same size at every input size. The rarer class weighs more, by the root of the
classes' ratio. Scoring is a map over all documents in slices of bounded size.

Defined results: a null or empty text is one window of padding; repeated rows score alike; without
labelled rows of both classes the score is the share of the class seen, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .fitting import remainder, slices, training_rows

BOUND, BYTES = 2_500, 1 << 26
DIM, STRIDE, WIDTH, FILTERS = 6, 4, 8, 24
#: In strides: pooled blocks, blocks in a chunk, blocks from one chunk to the next.
BLOCK, CHUNK, HOP = 32, 4, 3
EPOCHS, GROUP, RATE = 6, 24, 4e-3


class Layout:
    """Where the texts of a slice lie in one padded byte array, and its windows, blocks and chunks."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        size = np.diff(at)
        self.windows = np.maximum(-(-size // STRIDE), 1)
        room = (self.windows + 1) * STRIDE
        begin = np.concatenate(([0], np.cumsum(room)))
        self.bytes = np.zeros(begin[-1], np.uint8)
        self.bytes[np.arange(len(raw)) + np.repeat(begin[:-1] - at[:-1], size)] = raw
        # a window for every stride of the array: the last of each text reaches into the next text, and is left out
        first = begin[:-1] // STRIDE
        blocks = -(-self.windows // BLOCK)
        self.first_block = np.concatenate(([0], np.cumsum(blocks)))
        within = np.arange(self.first_block[-1]) - np.repeat(self.first_block[:-1], blocks)
        self.block_at = np.repeat(first, blocks) + within * BLOCK
        self.block_end = np.minimum(self.block_at + BLOCK, np.repeat(first + self.windows, blocks))
        chunks = np.maximum(-(-(blocks - 1) // HOP), 1)
        self.first_chunk = np.concatenate(([0], np.cumsum(chunks)))
        k = np.arange(self.first_chunk[-1]) - np.repeat(self.first_chunk[:-1], chunks)
        low, high = np.repeat(self.first_block[:-1], chunks), np.repeat(self.first_block[1:] - 1, chunks)
        self.chunk_blocks = np.minimum(low[:, None] + (k * HOP)[:, None] + np.arange(CHUNK), high[:, None])


def responses(net: dict, lay: Layout) -> np.ndarray:
    """Each window's response to each filter."""
    e = net["bytes"][lay.bytes].reshape(-1)
    n = len(lay.bytes) // STRIDE - 1
    windows = np.lib.stride_tricks.as_strided(e, (n, WIDTH * DIM), (STRIDE * DIM * e.itemsize, e.itemsize))
    return windows @ net["filters"] + net["bias"]


def pooled(r: np.ndarray, lay: Layout) -> np.ndarray:
    """The chunks' largest responses."""
    bounds = np.stack([lay.block_at, lay.block_end], 1).reshape(-1)
    full = np.concatenate([r, np.full((1, r.shape[1]), -np.inf, r.dtype)])
    blocks = np.maximum.reduceat(full, bounds, axis=0)[::2]
    return blocks[lay.chunk_blocks].max(1)


def score_texts(net: dict, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    if "share" in net:
        return np.full(len(at) - 1, net["share"])
    lay = Layout(raw, at)
    chunks = np.maximum(pooled(responses(net, lay), lay), 0)
    starts, n = lay.first_chunk[:-1], np.diff(lay.first_chunk)[:, None]
    features = np.concatenate([np.maximum.reduceat(chunks, starts, axis=0), np.add.reduceat(chunks, starts, axis=0) / n], 1)
    return 1 / (1 + np.exp(-(features @ net["out"] + net["out_bias"]).astype(np.float64)[:, 0]))


def _gradients(net: dict, raw: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the mean weighted logistic loss; only the windows that are some chunk's largest take part."""
    lay = Layout(raw, at)
    r = responses(net, lay)
    top = pooled(r, lay)
    chunks = np.maximum(top, 0)
    starts, n = lay.first_chunk[:-1], np.diff(lay.first_chunk)
    peak = np.maximum.reduceat(chunks, starts, axis=0)
    features = np.concatenate([peak, np.add.reduceat(chunks, starts, axis=0) / n[:, None]], 1)
    z = (features @ net["out"] + net["out_bias"])[:, 0]
    d = ((1 / (1 + np.exp(-z)) - y) * weight / len(y)).astype(np.float32)
    grad = {"out": features.T @ d[:, None], "out_bias": d.sum(keepdims=True)}
    df = d[:, None] * net["out"].T
    doc = np.repeat(np.arange(len(n)), n)
    is_peak = chunks == peak[doc]
    share = np.add.reduceat(is_peak.astype(np.float32), starts, axis=0)
    dc = (df[doc, :FILTERS] * is_peak / share[doc] + df[doc, FILTERS:] / n[doc, None]) * (top > 0)
    # the window behind each chunk's value: the first that equals it
    w_grad, b_grad, e_grad = np.zeros_like(net["filters"]), np.zeros_like(net["bias"]), np.zeros_like(net["bytes"])
    offset = np.arange(WIDTH)
    for c, (blocks, g) in enumerate(zip(lay.chunk_blocks, dc, strict=True)):
        live = np.flatnonzero(g)
        if not len(live):
            continue
        lo, hi = lay.block_at[blocks[0]], lay.block_end[blocks[-1]]
        at_ = lo + r[lo:hi, live].argmax(0)
        seen = lay.bytes[at_[:, None] * STRIDE + offset]
        w_grad[:, live] += net["bytes"][seen].reshape(len(live), -1).T * g[live]
        b_grad[live] += g[live]
        np.add.at(e_grad, seen.reshape(-1), (net["filters"][:, live] * g[live]).T.reshape(-1, DIM))
    return grad | {"filters": w_grad, "bias": b_grad, "bytes": e_grad}


def fit_network(texts: list[bytes], y: np.ndarray, seed: int = 5) -> dict:
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, y.mean(), 1 - y.mean()) ** -0.5
    weight /= weight.mean()
    net = {"bytes": rng.normal(0, 0.5, (256, DIM)), "filters": rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)), "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, (2 * FILTERS, 1)), "out_bias": np.array([np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) / 2])}
    net = {k: v.astype(np.float32) for k, v in net.items()}
    first, second, t = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), GROUP):
            chosen = order[b : b + GROUP]
            part = [texts[i] for i in chosen]
            at = np.concatenate(([0], np.cumsum([len(p) for p in part])))
            g = _gradients(net, np.frombuffer(b"".join(part), np.uint8), at, y[chosen], weight[chosen])
            t += 1
            for k in net:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                rate = RATE * (0.5 if epoch >= EPOCHS // 2 else 1) * (0.3 if epoch == EPOCHS - 1 else 1)
                net[k] = (net[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return net


def fit(documents: DataFrame, labels: DataFrame, learn, bound: int = BOUND) -> dict:
    sample = training_rows(labels, "quality", learn, bound)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= BYTES // 10)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > BYTES:
        texts = texts.where(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1_000_000)) < int(1_000_000 * BYTES / size))
    rows = texts.orderBy("doc_id", "text").collect()
    y = np.array([r["y"] for r in rows], np.float32)
    if not 0 < y.sum() < len(y):
        return {"share": float(y.mean()) if len(y) else 0.0}
    return fit_network([r["text"].encode() for r in rows], y)


def score(df: DataFrame, net: dict) -> DataFrame:
    """Add ``score`` to a frame that has ``text``; an old column ``score`` is replaced."""
    given = [f for f in df.schema.fields if f.name != "score"]
    schema = type(df.schema)([*given]).add("score", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                s = score_texts(net, *text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, "score"])

    return df.select(*(f.name for f in given)).mapInArrow(each, schema)


def predictions(documents: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows whose remainder is ``held`` aren't learnt from."""
    net = fit(documents, labels, remainder(F.col("doc_id"), mod) != held, bound)
    scored = score(documents.select("doc_id", "text"), net)
    return scored.select("doc_id", (remainder(F.col("doc_id"), mod) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
