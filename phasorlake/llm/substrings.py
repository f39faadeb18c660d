"""Byte strings that a smaller document holds, by suffix arrays over shards.

Texts are read once and kept in chunks of some megabytes; what tasks tell each other is packed, a row for
each chunk and shard.

The windows of WINDOW bytes of a document fall into runs that share the place of the smallest code of their
GRAM-byte strings (their minimizer, of equal ones the leftmost). Equal windows have equal minimizers at equal
distance, so a run's windows can only recur in runs of the same minimizer, and shards are dealt by it:

1. A chunk sends its minimizers with the number of its documents that hold each, and gets back which others
   hold too.
2. It sends the runs of those with their bytes (segments), equal ones once, for the smallest of its
   documents; larger documents of the chunk lose such a segment anyway. Where many documents hold a
   minimizer, its runs are split by the distance of their windows from it, and dealt by the bytes that all
   windows of a distance range share: the finest range is one window, so no shard holds an unbounded group.
3. A shard puts equal segments together (codes, then bytes): all but the smallest document's recur whole.
   The different segments of a key, whole keys at a time up to BLOCK bytes, are sorted by induced sorting;
   where neighbours in the suffix order have common prefixes of WINDOW or more they hold the same window,
   and the smallest document's stays.
4. The chunk cuts what it gets back.

A key's entries in a shard are one for each chunk at most that holds an equal segment, and no more different
ones than ``crowds`` and the bytes beside the shared ones allow.

Defined results: a null or empty text has 0 bytes; a row with a null id loses nothing and counts for no
other; rows that share an id are documents of their own, of which none is smaller than another; a document's
own repeats stay; very long texts are searched whole, a PIECE at a time; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE_CODES, dropped, mixed, on_batches, rolled, stored, tasks, text_bytes
from .fitting import slices
from .suffixes import common_prefixes, suffix_array

GRAM = 24
#: Bytes: of a chunk's texts, of the windows looked at together (and the bits of a place among them), of a
#: block that is sorted, of the texts whose minimizers meet in a shard.
CHUNK, PIECE, PLACE, BLOCK, SHARD = 1 << 22, 1 << 17, 18, 1 << 20, 1 << 26
#: Numbers of documents from which a minimizer's runs are split in 3, 9 and single windows.
CROWDS = (1 << 12, 1 << 16, 1 << 20)
SEGMENT = np.dtype([("key", "<u8"), ("lo", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("off", "<i4"), ("n", "<i4"), ("place", "<i4")])


def _pressed(raw) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _restored(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def chunks(documents: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, bytes, doc_id (list), ends (of the texts), text (all, compressed): every row of ``documents``, in
    rows of up to ``size`` bytes of text or one document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=size) if batch.num_rows else ():
                ids = part.column("doc_id")
                raw, at = text_bytes(part.column("text"))
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.record_batch([pa.array([k]), pa.array([len(raw)]), ids, pa.array([at.tobytes()]), pa.array([_pressed(raw.tobytes())])], names=["chunk", "bytes", "doc_id", "ends", "text"])
                k += 1

    return documents.select("doc_id", "text").mapInArrow(each, "chunk long, bytes long, doc_id array<long>, ends binary, text binary")


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """chunk, doc_id, the texts' bytes and where they begin and end."""
    for chunk, ids, ends, text in zip(*(batch.column(c) for c in ("chunk", "doc_id", "ends", "text")), strict=True):
        yield chunk.as_py(), ids.values, np.frombuffer(_restored(text.as_py()), np.uint8), np.frombuffer(ends.as_py(), np.int64)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(raw: np.ndarray, at: np.ndarray, window: int, live: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows that share a minimizer: first window (in the batch's bytes), number of windows, place
    of the minimizer, its code. ``live``: the rows that take part. The runs of a row end with each PIECE."""
    gram = min(GRAM, window)
    some = live & (np.diff(at) >= window)
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, at[:-1][some], 1)
    np.add.at(edge, at[1:][some] - window + 1, -1)
    inside = np.cumsum(edge, dtype=np.int8) > 0
    low_bits = np.uint64((1 << PLACE) - 1)
    found = []
    for lo in range(0, len(raw) - window + 1, PIECE):
        part = raw[lo : lo + PIECE + window - 1]
        code = rolled(_BYTE_CODES[part], gram, 5)
        key = _sliding_min(code & ~low_bits | np.arange(len(code), dtype=np.uint64), window - gram + 1)
        ok = inside[lo : lo + len(key)]
        new = ok.copy()
        new[1:] &= (key[1:] != key[:-1]) | ~ok[:-1]
        last = ok.copy()
        last[:-1] &= new[1:] | ~ok[1:]
        begin = np.flatnonzero(new)
        place = (key[begin] & low_bits).astype(np.int64)
        found.append((begin + lo, np.flatnonzero(last) - begin + 1, place + lo, code[place]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none, none.astype(np.uint64))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_STEP = 0xA24BAED4963EE407
_BACK = pow(_STEP, -1, 2**64)


def digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A code of each run of bytes: differences of running sums of weighted byte codes, brought to the run's
    own start. ``begin`` in order; the sums are taken a PIECE at a time."""
    out = np.empty(len(begin), np.uint64)
    weight = mixed(_BYTE_CODES)
    cuts = np.searchsorted(begin, np.arange(0, len(raw) + PIECE, PIECE))
    for k in np.flatnonzero(np.diff(cuts)):
        a, b, lo = begin[cuts[k] : cuts[k + 1]] - k * PIECE, end[cuts[k] : cuts[k + 1]] - k * PIECE, k * PIECE
        part = raw[lo : lo + int(b.max())]
        size = 1 << len(part).bit_length()
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weight[part] * _powers(_STEP, size)[: len(part)])])
        out[cuts[k] : cuts[k + 1]] = mixed((sums[b] - sums[a]) * _powers(_BACK, size)[a] + (b - a).astype(np.uint64))
    return out


def split(begin: np.ndarray, n: np.ndarray, place: np.ndarray, parts: int, width: int) -> tuple[np.ndarray, ...]:
    """Runs split by the distance of the minimizer from the window's start, in ``parts`` ranges of the ``width``
    possible ones: index of the run, number of the range, least and largest distance of the range, first
    window and number of windows."""
    of = np.arange(width) * parts // width
    edges = np.searchsorted(of, np.arange(parts + 1))
    most, least = place - begin, place - begin - n + 1
    high, low = of[most], of[least]
    count = high - low + 1
    run = np.repeat(np.arange(len(begin)), count)
    number = np.repeat(high, count) - (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    a, b = np.maximum(edges[number], least[run]), np.minimum(edges[number + 1] - 1, most[run])
    return run, number, edges[number], edges[number + 1] - 1, place[run] - b, b - a + 1


def _live(ids: pa.Array) -> np.ndarray:
    return ids.is_valid().to_numpy(zero_copy_only=False)


def _row_of(at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, begin, side="right") - 1


def _by_shard(codes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the codes by shard, the shards met, and where each begins in that order (and the end)."""
    shard = (codes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    met, first = np.unique(shard[order], return_index=True)
    return order, met, np.append(first, len(codes))


def _minimizers(texts: DataFrame, window: int, shards: int) -> DataFrame:
    """chunk, p, codes, docs: each chunk's different minimizers by shard, and how many documents (255 at most)
    hold each."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk, ids, raw, at in _opened(batch):
            begin, _, _, code = runs(raw, at, window, _live(ids))
            row = _row_of(at, begin)
            order = np.lexsort((row, code))
            code, row = code[order], row[order]
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            another = new.copy()
            another[1:] |= row[1:] != row[:-1]
            first = np.flatnonzero(new)
            docs = np.minimum(np.add.reduceat(another, first, dtype=np.int64), 255).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
            code = code[first]
            order, met, cut = _by_shard(code, shards)
            code, docs = code[order], docs[order]
            pieces = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
            yield pa.record_batch([pa.array([chunk] * len(met), pa.int64()), pa.array(met.astype(np.int32)), pieces(code), pieces(docs)], names=["chunk", "p", "codes", "docs"])

    return on_batches(texts.select("chunk", "doc_id", "ends", "text"), work, "chunk long, p int, codes binary, docs binary")


def _levels(codes: DataFrame, crowds: tuple[int, ...]) -> DataFrame:
    """chunk, p, levels: for each code that a chunk sent, 0 where one document alone holds it, else 1, and one
    more for each of ``crowds`` that the number of documents reaches."""

    def work(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x, "<u8") for x in table.column("codes").to_pylist()]
        code = np.concatenate(sent)
        docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.uint8)
        order = np.argsort(code)
        first = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
        total = np.add.reduceat(docs[order], first, dtype=np.int64)
        level = np.empty(len(code), np.uint8)
        level[order] = np.repeat(np.where(total < 2, 0, 1 + np.searchsorted(crowds, total, "right")), np.diff(np.append(first, len(code))))
        parts = np.split(level, np.cumsum([len(x) for x in sent])[:-1])
        return pa.table({"chunk": table.column("chunk"), "p": table.column("p"), "levels": pa.array([x.tobytes() for x in parts], pa.binary())})

    return codes.groupBy("p").applyInArrow(work, "chunk long, p int, levels binary")


def _segments(found: DataFrame, window: int, shards: int) -> DataFrame:
    """chunk, p, segments (SEGMENT fields), body (their bytes; both compressed), gone (row, begin, end of what
    recurs inside the chunk; on one row). ``found``: a chunk and its levels."""
    width = window - min(GRAM, window) + 1

    def one(ids: pa.Array, raw: np.ndarray, at: np.ndarray, levels: np.ndarray) -> tuple | None:
        begin, n, place, code = runs(raw, at, window, _live(ids))
        codes, of = np.unique(code, return_inverse=True)
        level = np.empty(len(codes), np.uint8)
        level[_by_shard(codes, shards)[0]] = levels
        level = level[of] if len(of) else level
        kinds = []
        for k in np.unique(level[level > 0]).tolist():
            some = level == k
            parts = (1, min(3, width), min(9, width), width)[k - 1]
            run, number, near, far, first, count = split(begin[some], n[some], place[some], parts, width)
            key, where = code[some][run], place[some][run]
            if parts > 1:
                order = np.argsort(where - near, kind="stable")
                shared = np.empty(len(run), np.uint64)
                shared[order] = digests(raw, (where - near)[order], (where - far + window)[order])
                key = mixed(shared + (number + 64 * k).astype(np.uint64))
            kinds.append((key, first, count, where - first if parts == 1 else np.full(len(run), -1)))
        if not kinds:
            return None
        key, begin, n, place = (np.concatenate(c) for c in zip(*kinds, strict=True))
        order = np.argsort(begin, kind="stable")
        key, begin, n, place = key[order], begin[order], n[order], place[order]
        seg = np.empty(len(key), SEGMENT)
        row = _row_of(at, begin)
        doc = ids.fill_null(0).to_numpy()[row]
        for name, value in zip(SEGMENT.names, (key, digests(raw, begin, begin + n + window - 1), doc, row, begin - at[row], n, place), strict=True):
            seg[name] = value
        shard = (key % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((seg["doc"], seg["lo"], key, shard))
        seg, shard, begin = seg[order], shard[order], begin[order]
        new = np.ones(len(seg), bool)
        new[1:] = (seg["key"][1:] != seg["key"][:-1]) | (seg["lo"][1:] != seg["lo"][:-1])
        view = memoryview(np.ascontiguousarray(raw))
        size = seg["n"] + window - 1
        for i in np.flatnonzero(~new).tolist():  # equal codes: equal bytes too
            a, b, k = int(begin[i - 1]), int(begin[i]), int(size[i])
            new[i] = size[i - 1] != k or bytes(view[a : a + k]) != bytes(view[b : b + k])
        least = seg["doc"][np.maximum.accumulate(np.where(new, np.arange(len(seg)), 0))]
        sent = seg["doc"] == least
        gone = seg[~sent]
        gone = np.stack([gone["row"], gone["off"], gone["off"] + gone["n"] + window - 1], 1).astype("<i4")
        return seg[sent], shard[sent], [view[a : a + k] for a, k in zip(begin[sent].tolist(), size[sent].tolist(), strict=True)], gone

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for (chunk, ids, raw, at), levels in zip(_opened(batch), batch.column("levels"), strict=True):
            got = one(ids, raw, at, np.frombuffer(b"".join(x["levels"].as_py() for x in levels), np.uint8))
            if got is None:
                continue
            seg, shard, bodies, gone = got
            met, first = np.unique(shard, return_index=True)
            cut = np.append(first, len(seg)).tolist()
            rows = [(_fields(seg[a:b]), _pressed(b"".join(bodies[a:b]))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([pa.array([chunk] * len(met), pa.int64()), pa.array(met.astype(np.int32)), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True)), pa.array([gone.tobytes()] + [b""] * (len(met) - 1), pa.binary())], names=["chunk", "p", "segments", "body", "gone"])

    return on_batches(found.select("chunk", "doc_id", "ends", "text", "levels"), work, "chunk long, p int, segments binary, body binary, gone binary")


def _fields(seg: np.ndarray) -> bytes:
    return _pressed(b"".join(seg[name].tobytes() for name in SEGMENT.names))


def _records(fields: bytes) -> np.ndarray:
    raw, at = _restored(fields), 0
    seg = np.empty(len(raw) // SEGMENT.itemsize, SEGMENT)
    for name in SEGMENT.names:
        kind = SEGMENT.fields[name][0]
        seg[name] = np.frombuffer(raw, kind, len(seg), at)
        at += len(seg) * kind.itemsize
    return seg


def recurring(pieces: list[bytes], owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start in it) of every window that a piece of a smaller owner holds too, in order."""
    size = np.array([len(p) + 1 for p in pieces])
    begin = np.cumsum(size) - size
    t = np.zeros(int(size.sum()) + 1, np.int64)
    t[:-1] = 1
    body = np.ones(len(t), bool)
    body[begin + size - 1] = False
    body[-1] = False
    t[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 2
    sa = suffix_array(t, 258)
    common = common_prefixes(t, sa)
    piece = np.append(np.repeat(np.arange(len(pieces)), size), len(pieces) - 1)
    room = np.append(np.repeat(begin + size - 1, size), 0) - np.arange(len(t))
    held = np.flatnonzero(room[sa] >= window)
    here, group = sa[held], np.cumsum(common[sa] < window)[held]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    if not len(here):
        return here, here
    least = np.repeat(np.minimum.reduceat(owner[piece[here]], first), np.diff(np.append(first, len(here))))
    hit = np.sort(here[least < owner[piece[here]]])
    return piece[hit], hit - begin[piece[hit]]


def _able(pieces: list[bytes], key: np.ndarray, n: np.ndarray, place: np.ndarray, window: int) -> np.ndarray:
    """Whether a segment can share a window with another of its key: one of the longer strings around the
    minimizer, which all windows of a distance range hold, is another's too. Split runs are taken as they are."""
    width = window - min(GRAM, window) + 1
    parts = min(3, width)
    whole = np.flatnonzero(place >= 0)
    able = place < 0
    size = np.array([len(p) for p in pieces])
    base = np.cumsum(size) - size
    at = base[whole]
    run, number, near, far, _, _ = split(at, n[whole], at + place[whole], parts, width)
    where = (at + place[whole])[run]
    order = np.argsort(where - near, kind="stable")
    code = np.empty(len(run), np.uint64)
    code[order] = digests(np.frombuffer(b"".join(pieces), np.uint8), (where - near)[order], (where - far + window)[order])
    code = mixed(code + key[whole][run] * np.uint64(2 * parts + 1) + number.astype(np.uint64))
    _, of, count = np.unique(code, return_inverse=True, return_counts=True)
    able[whole[run[count[of] > 1]]] = True
    return able


def _searched(segments: DataFrame, window: int) -> DataFrame:
    """chunk, gone: row, begin and end of all that recurs. ``segments``: chunk, p, segments, body, gone."""

    def work(table: pa.Table) -> pa.Table:
        sent = [_records(x) for x in table.column("segments").to_pylist()]
        seg, body = np.concatenate(sent), b"".join(map(_restored, table.column("body").to_pylist()))
        chunk = np.repeat(np.arange(len(sent)), [len(x) for x in sent])
        size = seg["n"].astype(np.int64) + window - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((seg["doc"], seg["lo"], seg["key"]))
        key, lo, doc = seg["key"][order], seg["lo"][order], seg["doc"][order]
        piece = lambda i: body[begin[i] : begin[i] + size[i]]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (lo[1:] != lo[:-1])
        for i in np.flatnonzero(~new).tolist():
            new[i] = piece(order[i - 1]) != piece(order[i])
        first = np.flatnonzero(new)
        kind = np.cumsum(new) - 1
        head, key = doc[first], key[first]
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        several = np.repeat(np.diff(edges) > 1, np.diff(edges))
        hits = [_block(b, key, head, order[first], piece, seg, window) for b in _blocks(np.flatnonzero(several), key, size[order[first]])]
        of, low, high = (np.concatenate(c) for c in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 3
        # the smallest document's own segments: what was hit in them; all others: whole
        mine = np.flatnonzero(doc == head[kind])
        a, b = np.searchsorted(of, kind[mine], "left"), np.searchsorted(of, kind[mine], "right")
        part = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
        whole, some = order[doc > head[kind]], order[np.repeat(mine, b - a)]
        at = np.concatenate([whole, some])
        start = np.concatenate([seg["off"][whole], seg["off"][some] + low[part]])
        stop = np.concatenate([seg["off"][whole] + size[whole], seg["off"][some] + high[part]])
        by = np.argsort(chunk[at], kind="stable")
        ranges = np.stack([seg["row"][at], start, stop], 1)[by].astype("<i4")
        cut = np.searchsorted(chunk[at][by], np.arange(len(sent) + 1))
        gone = [x + ranges[a:b].tobytes() for x, a, b in zip(table.column("gone").to_pylist(), cut[:-1], cut[1:], strict=True)]
        return pa.table({"chunk": table.column("chunk"), "gone": pa.array(gone, pa.binary())})

    return segments.groupBy("p").applyInArrow(work, "chunk long, gone binary")


def _blocks(some: np.ndarray, key: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Kinds in order, whole keys together, up to BLOCK bytes or one key."""
    if not len(some):
        return
    total = np.cumsum(size[some])
    ends = np.flatnonzero(np.append(key[some][1:] != key[some][:-1], True)) + 1
    a = 0
    while a < len(some):
        room = np.searchsorted(total[ends - 1], (total[a - 1] if a else 0) + BLOCK, "right")
        b = int(ends[max(room - 1, np.searchsorted(ends, a, "right"))])
        yield some[a:b]
        a = b


def _block(kinds: np.ndarray, key: np.ndarray, head: np.ndarray, entry: np.ndarray, piece, seg: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """kind, begin, end of the parts of segments that recur, in order of kind."""
    pieces = [piece(i) for i in entry[kinds].tolist()]
    able = np.flatnonzero(_able(pieces, key[kinds], seg["n"][entry[kinds]].astype(np.int64), seg["place"][entry[kinds]].astype(np.int64), window))
    if not len(able):
        return (np.zeros(0, np.int64),) * 3
    of, start = recurring([pieces[i] for i in able.tolist()], head[kinds[able]], window)
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (start[1:] != start[:-1] + 1)))[: len(of)]
    last = np.append(new[1:], True)[: len(of)]
    return kinds[able[of[new]]], start[new], start[last] + window


def _cut(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. ``found``: a chunk and lists of what is gone."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for (_, ids, raw, at), gone in zip(_opened(batch), batch.column("gone"), strict=True):
            row, begin, end = np.frombuffer(b"".join(x.as_py() for x in gone) if gone.is_valid else b"", "<i4").reshape(-1, 3).T.astype(np.int64)
            edge = np.bincount(at[row] + begin, minlength=len(raw) + 1) - np.bincount(at[row] + end, minlength=len(raw) + 1)
            out = np.cumsum(edge)[:-1] > 0
            total = np.concatenate(([0], np.cumsum(out)))
            start = out.copy()
            start[1:] &= ~out[:-1]
            first = at[:-1][at[:-1] < at[1:]]
            start[first] = out[first]
            spans = np.concatenate(([0], np.cumsum(start)))
            kept, place = raw[~out].tobytes(), at - total[at]
            sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            yield pa.record_batch([ids, *(pa.array(np.diff(x).astype(np.int64)) for x in (at, total[at], spans[at])), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return on_batches(found.select("chunk", "doc_id", "ends", "text", "gone"), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(documents: DataFrame, window: int = 50, crowds: tuple[int, ...] = CROWDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    texts = stored(chunks(documents), "chunks")
    held = texts.agg(F.sum("bytes")).first()[0] or 0
    shards = max(tasks(documents.sparkSession), -(-held // SHARD))
    levels = stored(_levels(_minimizers(texts, window, shards), crowds), "levels")
    of_chunk = levels.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("p", "levels"))).alias("levels"))
    segments = _segments(texts.join(of_chunk.hint("shuffle_hash"), "chunk"), window, shards)
    gone = stored(_searched(segments, window), "gone")
    dropped(levels)
    return _cut(texts.join(gone.groupBy("chunk").agg(F.collect_list("gone").alias("gone")).hint("shuffle_hash"), "chunk", "left"))
