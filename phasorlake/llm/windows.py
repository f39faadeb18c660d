"""Repeated windows of words, found by difference-cover anchors.

Short runs of words are hashed only where their place in the document, modulo PERIOD, is in COVER. For any
two places some shift below PERIOD puts both in the cover, so two equal windows share an anchor at the same
distance from their starts. Anchors whose code occurs once are dropped; around the others every window is
hashed (two codes of 64 bits, from word codes of their own), and a window is repeated where a smaller
document holds it, or its own document does earlier. All this is judged on the input.

Documents of the same words are told apart first: all but the smallest are covered whole and need no
windows.

Defined results: a null or empty text has no words; a row with a null id loses nothing; rows that share an
id are documents of their own, of which none counts as earlier; very long texts are searched whole; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, dropped, on_batches, rolled, signed, stored, text_bytes
from .fitting import slices

#: A perfect difference set: every remainder modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and a code of both, which tells rows that share an id apart; equal rows have equal results."""
    return documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def _sequences(rows: DataFrame) -> DataFrame:
    """doc_id, row, n, sha: the number of words and the digest of the words joined by a space."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            n, sha = [], []
            for t in part.column("text").to_pylist():
                words = (t or "").encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.record_batch([part.column("doc_id"), part.column("row"), pa.array(n, pa.int64()), pa.array(sha)], names=["doc_id", "row", "n", "sha"])

    return on_batches(rows, work, "doc_id long, row long, n long, sha string")


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    span, cover = window - PERIOD + 1, np.isin(np.arange(PERIOD), COVER)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            w = Words(*text_bytes(part.column("text")))
            if len(w) < window:
                continue
            at = np.arange(len(w) - span + 1)
            place = at - w.first[w.row[at]]
            count = np.diff(w.first)[w.row[at]]
            at = at[cover[place % PERIOD] & (place + span <= count) & (count >= window)]
            row = w.row[at]
            yield pa.record_batch([pa.array(signed(rolled(w.code, span, 3)[at])), part.column("row").take(pa.array(row)), pa.array((at - w.first[row]).astype(np.int32))], names=["code", "row", "pos"])

    return on_batches(rows.select("row", "text"), work, "code long, row long, pos int")


def owners(column: pa.Array) -> np.ndarray:
    """The row of each value of a list column; null rows have none."""
    return np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    return column.flatten().to_numpy(), owners(column)


def _near(found: DataFrame, window: int) -> DataFrame:
    """hi, lo, doc_id, row, s of the windows around the given anchors, each window once in a document.
    ``found``: doc_id, row, text, anchors."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            w = Words(*text_bytes(part.column("text")), twice=True)
            pos, row = _flat(part.column("anchors"))
            if len(w) < window:
                continue
            edge = np.zeros(len(w) + 1, np.int32)
            at = w.first[row] + pos
            np.add.at(edge, np.maximum(at - PERIOD + 1, w.first[row]), 1)
            np.add.at(edge, at + 1, -1)
            at = np.flatnonzero(np.cumsum(edge)[: len(w) - window + 1] > 0)
            at = at[w.row[at] == w.row[at + window - 1]]
            hi, lo, row = rolled(w.code, window, 1)[at], rolled(w.other, window, 2)[at], w.row[at]
            keep = np.lexsort((at, lo, hi, row))
            keep = keep[~_again(row[keep], hi[keep], lo[keep])]
            ids = [part.column(c).take(pa.array(row[keep])) for c in ("doc_id", "row")]
            yield pa.record_batch([pa.array(signed(hi[keep])), pa.array(signed(lo[keep])), *ids, pa.array((at[keep] - w.first[row[keep]]).astype(np.int32))], names=["hi", "lo", "doc_id", "row", "s"])

    return on_batches(found.select("doc_id", "row", "text", "anchors"), work, "hi long, lo long, doc_id long, row long, s int")


def _again(*columns: np.ndarray) -> np.ndarray:
    """Whether a place has the values of the one before it, in all columns."""
    same = np.zeros(len(columns[0]), bool)
    same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return same


def _cut(found: DataFrame, window: int) -> DataFrame:
    """doc_id, row, n_removed, kept_sha256. ``found``: doc_id, row, text, starts (of windows that earlier
    documents hold); windows that the document itself holds earlier are added here."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            w = Words(*text_bytes(part.column("text")), twice=True)
            pos, row = _flat(part.column("starts"))
            edge = np.zeros(len(w) + window + 1, np.int32)
            hi, own = w.runs(window, 1)
            lo = rolled(w.other, window, 2)[own] if len(own) else own
            order = np.lexsort((own, lo, hi, w.row[own]))
            again = order[_again(w.row[own][order], hi[order], lo[order])]
            at = np.concatenate([w.first[row] + pos, own[again]])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            keep = np.cumsum(edge)[: len(w)] == 0
            removed = np.bincount(w.row[~keep], minlength=part.num_rows)
            sha = []
            for i, t in enumerate(part.column("text").to_pylist()):
                words = (t or "").encode().split()
                sha.append(hashlib.sha256(b" ".join(compress(words, keep[w.first[i] : w.first[i + 1]].tolist()))).hexdigest())
            yield pa.record_batch([part.column("doc_id"), part.column("row"), pa.array(removed.astype(np.int64)), pa.array(sha)], names=["doc_id", "row", "n_removed", "kept_sha256"])

    return on_batches(found.select("doc_id", "row", "text", "starts"), work, "doc_id long, row long, n_removed long, kept_sha256 string")


def _later(near: DataFrame) -> DataFrame:
    """doc_id, row, starts: each document's windows that a smaller document holds. The heads are written out, so
    that a window of very many documents is split over tasks in the join."""
    first = near.groupBy("hi", "lo").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("hi", "lo", "head")
    first = stored(first, "first")
    return near.join(first.hint("shuffle_hash"), ["hi", "lo"]).where("doc_id > head").groupBy("doc_id", "row").agg(F.collect_list("s").alias("starts"))


def remove_repeats(documents: DataFrame, window: int = 20, rounds: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document. Windows are compared in ``rounds``, each a
    share of the codes, so that only that share is on its way between tasks at once."""
    rows = keyed(documents)
    named = rows.where("doc_id is not null")
    seq = stored(_sequences(rows), "sequences")
    long = seq.where(F.col("n") >= window).where("doc_id is not null")
    # written out, so that the join that follows reads both sides anew and a large group of copies is split
    heads = stored(long.groupBy("sha").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("sha", "head"), "heads")
    copies = stored(long.join(heads.hint("merge"), "sha").where("doc_id > head").select("doc_id", "row").distinct(), "copies")
    anchors = stored(_anchors(named, window), "anchors")
    shared = stored(anchors.groupBy("code").agg(F.count("*").alias("m")).where("m > 1").select("code"), "shared")
    marked = anchors.join(shared.hint("shuffle_hash"), "code", "left_semi").groupBy("row").agg(F.collect_list("pos").alias("anchors"))
    marked = stored(marked.join(copies.select("row"), "row", "left_anti"), "marked")
    dropped(anchors, shared, heads)
    found = stored(named.join(marked.hint("shuffle_hash"), "row"), "found")
    dropped(marked)
    near = stored(_near(found, window), "windows")
    later = [stored(_later(near.where(F.pmod("hi", F.lit(rounds)) == r)), "later") for r in range(rounds)]
    dropped(near)
    starts = reduce(DataFrame.union, later).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = stored(_cut(found.select("doc_id", "row", "text").join(starts, ["doc_id", "row"], "left"), window).dropDuplicates(["doc_id", "row"]), "cut")
    dropped(found, *later)
    none = hashlib.sha256(b"").hexdigest()
    whole = F.col("whole").isNotNull()
    out = seq.join(cut, ["doc_id", "row"], "left").join(copies.withColumn("whole", F.lit(True)), ["doc_id", "row"], "left")
    return out.select("doc_id", F.col("n").alias("n_words"), F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(whole, F.lit(none)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
