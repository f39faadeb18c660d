"""Token counts of sections, by offsets.

A text is encoded once, whole. Byte-level tokens cover its bytes without gaps, so running sums of their
lengths are their spans, and each span is turned into code points: from the one in which its first byte
lies to the one in which its last byte lies. Sections are intervals of code points (here: lines, each with
its line end); spans and sections are joined as intervals, both being in order. A token that crosses a
boundary goes by rule: ``first``, to the section of its first code point, or ``most``, to that which holds
most of its code points, of equal ones the first.

The vocabulary is a file that every worker reads once; nothing is trained and special tokens are ordinary
text.

Defined results: a null or empty text has no tokens and no sections; repeated rows count alike; very long
texts are encoded whole, where LONG white space is a piece of its own as the split makes it (the split's own
search for it would need a stack as deep as it is long); other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import on_batches
from .fitting import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as PATTERN means it, from this length on.
LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder and the length in bytes of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    length[list(ranks.values())] = [len(t) for t in ranks]
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length


def encoded(text: str, encoding) -> list[int]:
    """The tokens of a text. Of white space in front of a word, all but the last character is one piece."""
    out, at = [], 0
    for m in LONG.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()]) + encoding._encode_single_piece(text[m.start() : stop])
        at = stop
    return out + encoding.encode_ordinary(text[at:])


def spans(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """First and last code point of each token."""
    encoding, length = encoder(path)
    sizes = length[np.array(encoded(text, encoding), np.int64)]
    end = np.cumsum(sizes)
    raw = np.frombuffer(text.encode(), np.uint8)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1
    return point[end - sizes], point[end - 1]


def lines(text: str) -> np.ndarray:
    """Where the lines of a text begin, and its end; a text that ends in a line end has no empty line after it."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(raw == 10) + 1
    return np.unique(np.concatenate(([0], ends, [len(raw)])))


def allocate(first: np.ndarray, last: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and the number of tokens that cross a boundary. ``bounds``: the sections'
    starts and the end of the last, in order."""
    a, b = np.searchsorted(bounds, first, "right") - 1, np.searchsorted(bounds, last, "right") - 1
    crossing = np.flatnonzero(a != b)
    chosen = a.copy()
    if rule == "most":
        for t in crossing:
            inner = np.clip(bounds[a[t] : b[t] + 2], first[t], last[t] + 1)
            chosen[t] = a[t] + int(np.diff(inner).argmax())
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(chosen, minlength=len(bounds) - 1), len(crossing)


def section_counts(documents: DataFrame, rule: str = "first", path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_chars, n_sections, n_crossing, most_tokens (of a section), section_tokens (each
    section's, comma-joined) of every document."""

    def counted(t: str | None) -> tuple:
        if not t:
            return 0, 0, 0, 0, 0, ""
        first, last = spans(t, path)
        bounds = lines(t)
        counts, crossing = allocate(first, last, bounds, rule)
        return len(first), int(bounds[-1]), len(counts), crossing, int(counts.max()), ",".join(map(str, counts.tolist()))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            columns = list(zip(*map(counted, part.column("text").to_pylist()), strict=True))
            yield pa.record_batch([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())], names=["doc_id", "n_tokens", "n_chars", "n_sections", "n_crossing", "most_tokens", "section_tokens"])

    return on_batches(documents.select("doc_id", "text"), work, "doc_id long, n_tokens long, n_chars long, n_sections long, n_crossing long, most_tokens long, section_tokens string")
