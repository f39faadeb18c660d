"""Volume files (NIfTI-1 and NIfTI-2, ``.nii`` or ``.nii.gz``) as a data source.

    spark.dataSource.register(Volumes)
    spark.read.format("volumes").option("frames", "10:200").load("/data/*.nii")

A row is a plane of a frame: path, t, z, values (array<double>, the first axis runs fastest, scaled by the header's slope and
intercept where the slope is not 0). The driver reads headers alone. A file is split by frames into tasks of about ``bytes``
bytes, and a task reads the bytes of its frames, a plane at a time; a compressed file is one task, read as a stream. Paths are
those of ``pyarrow.fs``: local, or with a scheme; a folder stands for the volume files in it. ``frames`` (first:last, the last
one excluded, either may be left out) is applied before anything is read. Files without frames give no rows; what is no volume
file, is cut short, or has a type of number outside of TYPES raises ValueError."""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values of the format: codes of number types
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
_SCHEMA = "path string, t int, z int, values array<double>"


@dataclass
class Header:
    shape: tuple[int, int, int, int]
    dtype: np.dtype
    start: int
    slope: float
    intercept: float

    @property
    def plane(self) -> int:
        return self.shape[0] * self.shape[1] * self.dtype.itemsize


def header(raw: bytes, path: str = "") -> Header:
    """Of the first 540 bytes of a file."""
    for order in "<>":
        size = struct.unpack_from(order + "i", raw)[0] if len(raw) >= 348 else 0
        if size == 348 and raw[344:347] == b"n+1":
            dim = struct.unpack_from(order + "8h", raw, 40)
            code, start = struct.unpack_from(order + "h", raw, 70)[0], struct.unpack_from(order + "f", raw, 108)[0]
            slope, intercept = struct.unpack_from(order + "2f", raw, 112)
        elif size == 540 and len(raw) >= 540 and raw[4:7] == b"n+2":
            dim = struct.unpack_from(order + "8q", raw, 16)
            code, start = struct.unpack_from(order + "h", raw, 12)[0], struct.unpack_from(order + "q", raw, 168)[0]
            slope, intercept = struct.unpack_from(order + "2d", raw, 176)
        else:
            continue
        if code not in TYPES or not 1 <= dim[0] <= 7 or min(dim[1 : dim[0] + 1]) < 0:
            raise ValueError(f"cannot read numbers of type {code}, {dim}: {path}")
        size_of = [*dim[1 : dim[0] + 1], 1, 1, 1][: max(4, dim[0])]
        # axes beyond the fourth count as more frames
        shape = (*size_of[:3], int(np.prod(size_of[3:])))
        return Header(shape, np.dtype(order + TYPES[code]), int(start), slope, intercept)
    raise ValueError(f"no volume file: {path}")


class _Stream:
    """Bytes of a file in order, unpacked where it is compressed (one member after the other)."""

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.file, self.packed, self.rest = system.open_input_stream(path, compression=None), path.endswith(".gz"), b""
        self.unpack = zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        if not self.packed:
            return self.file.read(n)
        out = []
        while n:
            got = self.unpack.decompress(self.rest, n)
            self.rest = self.unpack.unconsumed_tail or self.unpack.unused_data
            out.append(got)
            n -= len(got)
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            if not self.rest and n:
                self.rest = self.file.read(1 << 20)
                if not self.rest:
                    break
        return b"".join(out)

    def skip(self, n: int) -> None:
        while n > 0:
            got = len(self.read(min(n, 1 << 20)))
            if not got:
                return
            n -= got


class Frames(InputPartition):
    def __init__(self, path: str, of: Header, first: int, last: int) -> None:
        self.path, self.of, self.first, self.last = path, of, first, last


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("bytes", 64 << 20))
        first, _, last = options.get("frames", ":").partition(":")
        self.first, self.last = int(first or 0), int(last) if last else None

    def files(self) -> list[str]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        prefix = self.path[: len(self.path) - len(path)] if "://" in self.path else ""
        info = None if "*" in path else system.get_file_info(path)
        if info is not None and info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info is not None and info.type == fs.FileType.File:
            return [self.path]
        folder, _, pattern = (path, "", "*") if info is not None else path.rpartition("/")
        held = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]
        return sorted(prefix + p for p in held if p.endswith((".nii", ".nii.gz")) and fnmatch.fnmatchcase(p.rpartition("/")[2], pattern))

    def partitions(self) -> list[Frames]:
        parts = []
        for path in self.files():
            of = header(_open(path).read(540), path)
            first, last = max(self.first, 0), min(of.shape[3], of.shape[3] if self.last is None else self.last)
            step = last - first if path.endswith(".gz") else max(1, self.bytes // max(1, of.plane * of.shape[2]))
            parts += [Frames(path, of, t, min(t + step, last)) for t in range(first, last, max(step, 1))]
        return parts or [Frames("", Header((0, 0, 0, 0), np.dtype("u1"), 0, 0.0, 0.0), 0, 0)]

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        of = part.of
        if part.first >= part.last or not of.plane:
            return
        at = of.start + part.first * of.shape[2] * of.plane
        if part.path.endswith(".gz"):
            source = _open(part.path)
            source.skip(at)
        else:
            system, path = _where(part.path)
            source = system.open_input_file(path)
            source.seek(at)
        for t in range(part.first, part.last):
            for z in range(of.shape[2]):
                raw = source.read(of.plane)
                if len(raw) < of.plane:
                    raise ValueError(f"cut short: {part.path}")
                values = np.frombuffer(raw, of.dtype).astype(np.float64)
                if of.slope and np.isfinite(of.slope):
                    values = values * of.slope + of.intercept
                lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
                yield pa.record_batch([pa.array([part.path]), pa.array([t], pa.int32()), pa.array([z], pa.int32()), lists], names=["path", "t", "z", "values"])


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str) -> _Stream:
    return _Stream(*_where(path))


class Volumes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_volumes(spark: SparkSession, path: str, frames: str = ":", size: int = 64 << 20) -> DataFrame:
    """path, t, z, values of the files; tasks of about ``size`` bytes."""
    spark.dataSource.register(Volumes)
    return spark.read.format("volumes").option("frames", frames).option("bytes", str(size)).load(path)


def channels(volumes: DataFrame) -> DataFrame:
    """path, t, channel (places of a frame numbered with the first axis fastest), value: what parcels and regressions take."""
    rows = volumes.select("path", "t", "z", F.posexplode("values").alias("place", "value"), F.size("values").alias("n"))
    return rows.select("path", "t", (F.col("z").cast("long") * F.col("n") + F.col("place")).alias("channel"), "value")
