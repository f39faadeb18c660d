"""Texts as a media column: stored as lossless WebP, read back, and described.

A text's bytes, padded with 255 to a positive multiple of 576, are the 8-bit samples of grey images 576
wide, as many rows as there are; beyond 1820 rows (1 MB) further images follow in the same column. The stored
files are decoded again, and digests and the feature are taken from what was read back.

The feature compares the means of 64 equal parts of the samples with their neighbours' (the last with the
first): 64 bits as 16 hex digits, first part highest.

Defined results: a null or empty text is one row of padding; repeated rows give equal values; a text of any
length is stored whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from .common import on_batches
from .fitting import slices
from .webp import decode_all, encode_greys

WIDTH, ROWS, PARTS = 576, 1820, 64
TOGETHER = 1 << 25


def pack_all(texts: list[str | None]) -> list[list[bytes]]:
    """The files that hold each text."""
    images, ends = [], []
    for text in texts:
        raw = (text or "").encode()
        samples = np.full(max(1, -(-len(raw) // WIDTH)) * WIDTH, 255, np.uint8)
        samples[: len(raw)] = np.frombuffer(raw, np.uint8)
        rows = samples.reshape(-1, WIDTH)
        images += [rows[i : i + ROWS] for i in range(0, len(rows), ROWS)]
        ends.append(len(images))
    files = encode_greys(images)
    return [files[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def pack(text: str | None) -> list[bytes]:
    return pack_all([text])[0]


def unpack_all(rows: list[list[bytes]]) -> list[np.ndarray]:
    """The samples of each text's files."""
    greys = iter(decode_all([f for files in rows for f in files], grey=True))
    return [np.concatenate([next(greys).reshape(-1) for _ in files]) for files in rows]


def unpack(files: list[bytes]) -> np.ndarray:
    return unpack_all([files])[0]


def feature(samples: np.ndarray) -> str:
    sums = samples.reshape(PARTS, -1).sum(1, dtype=np.int64)
    return np.packbits(sums > np.roll(sums, -1)).tobytes().hex()


def together(media: pa.Array, n_bytes: pa.Array) -> Iterator[list[list[bytes]]]:
    """Rows' files that are read side by side: TOGETHER bytes of texts, or one row."""
    held = np.cumsum(np.asarray(n_bytes)) // TOGETHER
    for rows in np.split(np.arange(len(held)), np.flatnonzero(np.diff(held)) + 1):
        if len(rows):
            yield media.slice(int(rows[0]), len(rows)).to_pylist()


def stored_media(documents: DataFrame) -> DataFrame:
    """Replace ``text`` by n_bytes and media (array of files); other columns stay, but for those names."""
    given = [f for f in documents.schema.fields if f.name not in ("text", "n_bytes", "media")]
    schema = type(documents.schema)([*given]).add("n_bytes", "long").add("media", ArrayType(BinaryType()))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            texts = part.column("text").to_pylist()
            files = pack_all(texts)
            yield pa.record_batch([*(part.column(f.name) for f in given), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(files, pa.list_(pa.binary()))], names=[*(f.name for f in given), "n_bytes", "media"])

    return on_batches(documents.select(*(f.name for f in given), "text"), work, schema)


def described(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored files give: payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for files in together(batch.column("media"), batch.column("n_bytes")):
            for one, samples in zip(files, unpack_all(files), strict=True):
                payload, whole = samples.tobytes(), b"".join(one)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(whole), hashlib.sha256(whole).hexdigest(), feature(samples)))
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    return on_batches(media.select("doc_id", "n_bytes", F.col("media")), work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
