"""What the training-data operators share: tables, shared scratch folder, byte and word arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Java and RE2 class of the bytes that separate words.
WORD = r"[^\x20\x09-\x0D]+"


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in a session without one (tests, local mode), a new
    temporary folder, which is then set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared scratch folder as Parquet and read it again: later jobs start from
    the files, so a lost executor costs no upstream work, and the write's own shuffle files are dropped
    at its end."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- byte and word arrays -------------------------------------------------------------------------

_BYTE_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: multiply and shift, each step invertible."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


_PLACES: dict[int, np.ndarray] = {}


def _places(n: int, salt: int) -> np.ndarray:
    """A weight of each of the first n places in a word, without relation to each other; the table grows."""
    if len(_PLACES.get(salt, ())) < n:
        size = 1 << max(12, n.bit_length())
        _PLACES[salt] = mixed((np.arange(size, dtype=np.uint64) + np.uint64(1)) * _STEP + np.uint64(salt)) | np.uint64(1)
    return _PLACES[salt]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the n+1 places where its rows begin and end.
    A null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a batch of texts: where each begins and ends in the batch's bytes, the row it
    belongs to, a 64-bit code of its bytes (``twice``: ``other``, a second one with weights of its own), and
    ``first``: for each row the number of words before it."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, spaces: np.ndarray = SPACES, fold: np.ndarray | None = None, twice: bool = False):
        self.raw = raw
        solid = np.zeros(len(raw) + 1, bool)
        np.logical_not(spaces[raw], out=solid[:-1])
        start = solid[:-1].copy()
        start[1:] &= ~solid[:-2]
        begins = at[:-1][at[:-1] < at[1:]]
        start[begins] = solid[begins]
        self.start = np.flatnonzero(start)
        stop = np.zeros(len(raw) + 1, bool)
        stop[1:] = solid[:-1] & ~solid[1:]
        ends = at[1:][at[:-1] < at[1:]]
        stop[ends] = solid[ends - 1]
        self.stop = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.code = self.other = np.zeros(0, np.uint64)
        if len(self.start):
            codes = _BYTE_CODES if fold is None else _BYTE_CODES[fold]
            inside = np.flatnonzero(solid[:-1])
            length = self.stop - self.start
            bounds = np.cumsum(length) - length
            step = np.arange(len(inside)) - np.repeat(bounds, length)
            of = lambda salt: mixed(np.add.reduceat(codes[raw[inside]] * _places(int(length.max()), salt)[step], bounds) + length.astype(np.uint64))
            self.code = of(0)
            self.other = of(1) if twice else self.other

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all k consecutive words of a row, and the word that each begins at."""
        n = len(self.code)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return rolled(self.code, k, salt)[at], at

    def joined(self, at: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
        """Codes of the k words from each of these words on."""
        h = np.full(len(at), salt, np.uint64)
        step = np.uint64(int(_STEP) * (2 * salt + 1) % 2**64)
        for j in range(k):
            h = h * step + self.code[at + j]
        return mixed(h)


def rolled(code: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A code of each k consecutive values: blocks of 1, 2, 4 ... values are joined as k's bits ask."""
    step = int(_STEP) * (2 * salt + 1) % 2**64
    block, size, out, done, left = code, 1, None, 0, k
    while left:
        if left & 1:
            n = len(code) - done - size + 1
            out = block[:n] if out is None else out[:n] * np.uint64(pow(step, size, 2**64)) + block[done : done + n]
            done += size
        left >>= 1
        if left:
            block = block[:-size] * np.uint64(pow(step, size, 2**64)) + block[size:]
            size *= 2
    return mixed(out + np.uint64(salt))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def on_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Run ``work`` on each Arrow batch of each partition."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(each, schema)
