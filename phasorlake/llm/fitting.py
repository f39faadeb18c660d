"""Labelled samples, and batches of bounded size, for the operators that fit a classifier."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once in a task; a longer text is worked on alone.
SLICE_BYTES = 1 << 21


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def training_rows(labels: DataFrame, label: str, learn: Column, bound: int) -> DataFrame:
    """(doc_id, y, part) of the labelled rows that may be learnt from: all of them, or where there are
    more than ``bound``, a sample of about that many by a digest of the id. ``part`` is 0 to 99, also by
    digest. Rows without id or label are left out; an id that is labelled twice keeps its larger label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = rows.count()
    digest = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_000))
    return rows.where(digest < int(1_000_000 * min(1.0, bound / max(n, 1)))).select("doc_id", "y", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(100)).cast("int").alias("part"))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    yield batch.slice(begin)
