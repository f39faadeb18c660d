"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, A-Z folded. Seeds, runs of LEAST words that a document shares with a
benchmark item, give candidate pairs: those whose seeds could cover the threshold share of the item. In a
candidate pair the longest common run of unmarked words is marked on both sides, again and again, down to LEAST
words; runs are found and measured by Karp-Rabin hashes, and compared as words before they are marked. Tiles don't
overlap and may stand in any order, so reordered passages count. An item is leaked where its tiles cover the threshold
share of its words.

A benchmark of up to ``bound`` seeds, checked first, is sent to the tasks, and documents are searched where
they lie. A larger one is joined: seeds of both sides meet by code, only candidate pairs meet as texts.

Defined results: null and empty texts, and items of fewer than LEAST words, match nothing; rows with a null
id are matched like others; repeated rows, of documents or items, give equal rows once; very long texts are
searched whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, on_batches, rolled, signed, stored, text_bytes
from .fitting import slices
from .toxicity import _BREAK

LEAST, SHARE = 4, 0.5
OUT = "doc_id long, item_id long, item_words long, matched_words long, n_tiles long, longest long, coverage double"
NAMES = [c.split()[0] for c in OUT.split(", ")]


def words_of(column: pa.Array) -> Words:
    return Words(*text_bytes(column), _BREAK, LOWER)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in doc, start in item, length) of the tiles, longest first; of equal ones that which starts
    first in the item, then in the document, is taken.

    Every common run of free words lies inside a maximal match of the whole texts. So these are found once and wait
    in order of length; where tiles have taken words of the longest one since, what they left of it goes back with
    its new length."""
    d, i, n = _matches(doc, item, least)
    order = np.lexsort((d, i, -n))
    waiting = list(zip((-n[order]).tolist(), i[order].tolist(), d[order].tolist(), strict=True))  # sorted, so a heap
    free_d, free_i, left = np.ones(len(doc), bool), np.ones(len(item), bool), len(item)
    found: list[tuple[int, int, int]] = []
    while waiting and left >= least:
        n, i, d = heappop(waiting)
        free = free_d[d : d - n] & free_i[i : i - n] & (doc[d : d - n] == item[i : i - n])
        if free.all():
            free_d[d : d - n] = free_i[i : i - n] = False
            left += n
            found.append((d, i, -n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], free, [False]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= least:
                heappush(waiting, (a - b, i + a, d + a))
    return found


def _matches(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in doc and item, and lengths, of all maximal common runs of ``least`` words or more. A match begins
    where seeds are equal and the words before differ, so of repeated words only the first places are looked at; it
    is measured by hashes of halving length."""
    none = np.zeros(0, np.int64)
    if min(len(doc), len(item)) < least:
        return none, none, none
    seed_d, seed_i = rolled(doc, least), rolled(item, least)
    kinds, of = np.unique(item, return_inverse=True)
    before_i = np.concatenate(([0], of[:-1] + 1))[: len(seed_i)]  # 0: nothing before
    at = np.searchsorted(kinds, doc)
    known = kinds[np.minimum(at, len(kinds) - 1)] == doc
    before_d = np.concatenate(([-1], np.where(known, at + 1, -1)[:-1]))[: len(seed_d)]
    by = np.lexsort((before_i, seed_i))
    codes, begin = np.unique(seed_i[by], return_index=True)
    end = np.append(begin[1:], len(by))
    slot = np.searchsorted(codes, seed_d)
    hit = np.flatnonzero((slot < len(codes)) & (codes[np.minimum(slot, len(codes) - 1)] == seed_d))
    slot = slot[hit]
    # the places of a seed are in order of the word before them: those with the document's own are passed over
    key = np.repeat(np.arange(len(codes)), end - begin) * (len(kinds) + 2) + before_i[by]
    own = slot * (len(kinds) + 2) + before_d[hit]
    low, high = begin[slot], end[slot]
    skip_from = np.where(before_d[hit] > 0, np.searchsorted(key, own, "left"), high)
    skip_to = np.where(before_d[hit] > 0, np.searchsorted(key, own, "right"), high)
    parts = []
    for a, b in ((low, skip_from), (skip_to, high)):
        n = b - a
        parts.append((np.repeat(hit, n), by[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]))
    d, i = (np.concatenate(v) for v in zip(*parts, strict=True))
    n = np.full(len(d), least, np.int64)
    size = 1 << max(min(len(item), len(doc)).bit_length() - 1, 0)
    while size and len(d):
        hash_d, hash_i = rolled(doc, size), rolled(item, size)
        go = np.flatnonzero((d + n < len(hash_d)) & (i + n < len(hash_i)))
        go = go[hash_d[(d + n)[go]] == hash_i[(i + n)[go]]]
        n[go] += size
        size //= 2
    return d, i, n


def _pair(doc: np.ndarray, item: np.ndarray, share: float) -> tuple | None:
    """item_words, matched_words, n_tiles, longest, coverage, where the tiles cover enough."""
    found = tiles(doc, item)
    matched = sum(n for _, _, n in found)
    if matched < share * len(item):
        return None
    return len(item), matched, len(found), max(n for _, _, n in found), matched / len(item)


def _seeds(texts: DataFrame, key: str) -> DataFrame:
    """code, id, pos of all runs of LEAST words."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            w = words_of(part.column("text"))
            code, at = w.runs(LEAST)
            row = w.row[at]
            yield pa.record_batch([pa.array(signed(code)), part.column(key).take(pa.array(row)), pa.array((at - w.first[row]).astype(np.int32)), pa.array(np.diff(w.first)[row].astype(np.int32))], names=["code", key, "pos", "n"])

    return on_batches(texts.select(key, "text"), work, f"code long, {key} long, pos int, n int")


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.float64() if n == "coverage" else pa.int64()) for n in NAMES]))


def _searcher(items: list[tuple[int, str]], share: float):
    """A function from texts to (row, item id, what the tiles cover) of every leak."""
    w = words_of(pa.array([t for _, t in items], pa.large_string()))
    code, at = w.runs(LEAST)
    order = np.argsort(code, kind="stable")
    code, at = code[order], at[order]
    of, pos = w.row[at], at - w.first[w.row[at]]
    length = np.diff(w.first)
    mask = np.uint64((1 << max(16, (8 * len(code)).bit_length())) - 1)
    maybe = np.zeros(int(mask) + 1, bool)
    maybe[code & mask] = True
    ids, bodies = [i for i, _ in items], [w.code[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]

    def search(texts: pa.Array) -> list[tuple]:
        d = words_of(texts)
        seen, where = d.runs(LEAST)
        hit = maybe[seen & mask]
        # a seed counts once in a text, however often it stands there
        seen, row = seen[hit], d.row[where[hit]]
        order = np.lexsort((seen, row))
        seen, row = seen[order], row[order]
        new = np.concatenate((np.ones(min(len(row), 1), bool), (seen[1:] != seen[:-1]) | (row[1:] != row[:-1])))
        seen, row = seen[new], row[new]
        low, high = np.searchsorted(code, seen, "left"), np.searchsorted(code, seen, "right")
        n = high - low
        place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, item, start = np.repeat(row, n), of[place], pos[place]
        # words of the item that some seed covers, at most
        wide = int(length.max(initial=0)) + 1
        covered = np.unique(((row * len(ids) + item) * wide + start)[:, None] + np.arange(LEAST))
        pair, words = np.unique(covered // wide, return_counts=True)
        found = []
        for p in pair[words >= share * length[pair % len(ids)]].tolist():
            r, i = divmod(p, len(ids))
            got = _pair(d.code[d.first[r] : d.first[r + 1]], bodies[i], share)
            if got:
                found.append((r, ids[i], *got))
        return found

    return search


def _by_copy(documents: DataFrame, items: list[tuple[int, str]], share: float) -> DataFrame:
    """Search the documents where they lie, with the items in every task."""
    search = _searcher(items, share)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            ids = part.column("doc_id")
            rows = [dict(zip(NAMES, (ids[r].as_py(), *rest), strict=True)) for r, *rest in search(part.column("text"))]
            if rows:
                yield _table(rows)

    return on_batches(documents.select("doc_id", "text"), work, OUT)


def _by_join(documents: DataFrame, items: DataFrame, share: float, with_text: bool = False) -> DataFrame:
    """Seeds meet by code; candidate pairs meet as texts. ``with_text``: the document's text is the last column."""
    mine, theirs = _seeds(documents, "doc_id").select("code", "doc_id").distinct(), stored(_seeds(items, "item_id"), "seeds")
    hits = mine.join(theirs, "code").select("doc_id", "item_id", "n", F.explode(F.sequence("pos", F.col("pos") + (LEAST - 1))).alias("p"))
    pairs = stored(hits.distinct().groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("m")).where(F.col("m") >= F.col("n") * share).select("doc_id", "item_id").distinct(), "candidates")
    both = pairs.join(items.select(F.col("item_id").alias("i"), F.col("text").alias("item_text")), F.col("item_id").eqNullSafe(F.col("i"))).drop("i")
    both = both.join(documents.select(F.col("doc_id").alias("d"), "text"), F.col("doc_id").eqNullSafe(F.col("d")))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            d, w = words_of(part.column("text")), words_of(part.column("item_text"))
            rows, at = [], []
            for r in range(part.num_rows):
                got = _pair(d.code[d.first[r] : d.first[r + 1]], w.code[w.first[r] : w.first[r + 1]], share)
                if got:
                    rows.append(dict(zip(NAMES, (part.column("doc_id")[r].as_py(), part.column("item_id")[r].as_py(), *got), strict=True)))
                    at.append(r)
            if rows:
                found = _table(rows)
                yield found.append_column("text", part.column("text").take(pa.array(at))) if with_text else found

    return on_batches(both.select("doc_id", "item_id", "text", "item_text"), work, f"{OUT}, text string" if with_text else OUT)


def _items(benchmark: DataFrame, bound: int) -> tuple[DataFrame, list[tuple[int, str]] | None]:
    """The items, and as a list too where they are few enough to be sent to the tasks."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    if size > bound:
        return items, None
    return items, sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, bound: int = 1_000_000) -> DataFrame:
    """doc_id, item_id and what the tiles cover, of every pair in which enough of the item is covered."""
    items, few = _items(benchmark, bound)
    if few is None:
        return _by_join(documents, items, share).distinct()
    if not few:
        return documents.sparkSession.createDataFrame([], OUT)
    return _by_copy(documents, few, share).distinct()


def without_leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE, bound: int = 1_000_000) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns."""
    items, few = _items(benchmark, bound)
    if few is None:
        # an id can be null or shared with a document that holds no item
        bad = _by_join(documents, items, share, with_text=True).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text") == F.col("_text"))
        return documents.join(bad.hint("shuffle_hash"), same, "left_anti")
    if not few:
        return documents
    search = _searcher(few, share)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            keep = np.ones(part.num_rows, bool)
            keep[[r for r, *_ in search(part.column("text"))]] = False
            yield part.filter(pa.array(keep))

    return on_batches(documents, work, documents.schema)
