"""One pass over observations: Arrow batches to numpy, sums by partition, sums of sums in Spark; where all partitions'
sums are few numbers, as small fits have, the driver adds them up itself.

A cached frame is kept once more as serialised batches, so that the passes of a fit read blocks of bytes and neither
plan a query nor turn rows into arrays again. Partitions' sums are added in the order of the partitions.

Observations are rows with ``x`` array<double> (real), ``x`` struct<re, im> of arrays (complex) or ``u1``,
``u2`` ... array<double> (frames). What a fit needs from the data are sums; a pass yields one row for each
number of a partition's sums, and Spark adds them up, so the driver gets the sums alone, whatever the
number of rows or partitions.

A fit is a generator: it yields an ``Ask`` for sums and is sent them. ``together`` runs many fits over the same
rows, restarts or models of any order, with one pass for all that still ask: a fit that ends leaves the pass."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that the driver takes from all partitions of a pass to add up; where they would be more, Spark does.
FEW = 1 << 13
#: Partitions' sums that meet in one task, numbers of a piece of them, and partitions of blocks for each core.
MEET, PIECE, SPREAD = 64, 1 << 17, 4
#: Bytes of blocks that are worth a task of their own, and numbers that the driver takes from all such tasks.
WORTH, TAKEN = 1 << 22, 1 << 15
#: Numbers that a pass sums up in each task; fits beyond wait for their turn.
WIDE = 1 << 24
Kernel = Callable[[np.ndarray, pa.RecordBatch], dict[str, np.ndarray]]
Joint = Callable[[np.ndarray, pa.RecordBatch, list[Any]], list[dict[str, np.ndarray]]]


def numbers_in(name: str, shape: tuple[int, ...]) -> int:
    cells = int(np.prod(shape[:-2])) * shape[-1] * (shape[-1] + 1) // 2 if name.endswith("_h") else int(np.prod(shape))
    return cells * (2 if name.startswith("c_") else 1)


@dataclass
class Ask:
    """The sums over all rows of what ``kernel`` gives for a batch: arrays of the shapes; complex ones under
    names that begin with ``c_``. Of Hermitian matrices, under names that end in ``_h``, one triangle is summed.
    Asks with ``given`` and the same kernel are answered together: it takes a batch and the list of what is given, and
    gives the list of their arrays."""

    kernel: Kernel | Joint
    shapes: dict[str, tuple[int, ...]]
    given: Any = None

    @property
    def size(self) -> int:
        return sum(numbers_in(n, s) for n, s in self.shapes.items())


Sums = dict[str, np.ndarray]
Fit = Generator[Ask, Sums, Any]


def kind_of(df: DataFrame) -> str:
    names = df.columns
    if "u1" in names:
        return "frame"
    return "complex" if df.schema["x"].dataType.typeName() == "struct" else "real"


def columns_of(df: DataFrame) -> list[str]:
    """The columns that hold the observation."""
    if kind_of(df) != "frame":
        return ["x"]
    q = 1
    while f"u{q + 1}" in df.columns:
        q += 1
    return [f"u{i + 1}" for i in range(q)]


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def observations(batch: pa.RecordBatch, kind: str, columns: list[str]) -> np.ndarray:
    """(n, p) real or complex, or (n, p, q)."""
    if kind == "frame":
        return np.moveaxis(np.stack([_matrix(batch.column(c)) for c in columns]), 0, 2)  # each column in one piece
    x = batch.column("x")
    if kind == "complex":
        if pa.types.is_fixed_size_list(x.type):  # a block's
            return _matrix(x).view(complex)
        return _matrix(x.field("re")) + 1j * _matrix(x.field("im"))
    return _matrix(x)


def few(df: DataFrame, numbers: int) -> bool:
    """Whether the frame is cached (so that asking for its partitions costs no work) and ``numbers`` from each are no
    more than FEW in all."""
    if not df.is_cached:
        return False
    if not hasattr(df, "_partitions"):
        df._partitions = df.rdd.getNumPartitions()
    return df._partitions * numbers <= FEW


def totals(df: DataFrame, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], numbers: int, driver: bool) -> np.ndarray:
    """The sum over partitions of what ``sums`` gives for each: ``numbers`` doubles, or None."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sums(batches)
        if every is not None:
            yield pa.record_batch([pa.array([every.tobytes()])], names=["sums"])

    def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = sums(batches)
        if every is not None:
            yield pa.record_batch([pa.array(np.arange(len(every))), pa.array(every)], names=["place", "value"])

    total = np.zeros(numbers)
    if driver:
        for part in df.mapInArrow(whole, "sums binary").toArrow().column("sums").to_pylist():
            total += np.frombuffer(part)
    else:
        got = df.mapInArrow(by_place, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        total[got["place"].to_numpy(int)] = got["value"].to_numpy()
    return total


def flat(sums: Sums, shapes: dict[str, tuple[int, ...]]) -> np.ndarray:
    """One array of doubles; the parts of complex numbers one after the other."""
    out = []
    for name in sorted(shapes):
        value = np.asarray(sums[name])
        if name.endswith("_h"):
            value = value[(..., *np.triu_indices(value.shape[-1]))]
        value = np.ascontiguousarray(value.reshape(-1), complex if name.startswith("c_") else float)
        out.append(value.view(float))
    return np.concatenate(out)


def shaped(values: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> Sums:
    out, at = {}, 0
    for name in sorted(shapes):
        n, shape = numbers_in(name, shapes[name]), shapes[name]
        part = values[at : at + n]
        part = part.view(complex) if name.startswith("c_") else part
        if name.endswith("_h"):
            whole, (i, j) = np.zeros(shape, part.dtype), np.triu_indices(shape[-1])
            cells = part.reshape(*shape[:-2], len(i))
            whole[..., j, i] = cells.conj()
            whole[..., i, j] = cells
            out[name] = whole
        else:
            out[name] = part.reshape(shape)
        at += n
    return out


def side_by_side(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch with complex observations as lists of their real and imaginary parts in turn, which are read in place."""
    x = observations(batch, "complex", ["x"])
    cells = pa.FixedSizeListArray.from_arrays(pa.array(x.view(float).reshape(-1)), 2 * x.shape[1])
    return batch.set_column(batch.schema.get_field_index("x"), "x", cells)


def serialised(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as the bytes of one cell."""
    for batch in batches:
        if batch.num_rows:
            if "x" in batch.schema.names and pa.types.is_struct(batch.schema.field("x").type):
                batch = side_by_side(batch)
            yield pa.record_batch([pa.array([serialised(batch)], pa.binary())], names=["block"])


def blocks_of(df: DataFrame, columns: tuple[str, ...]) -> RDD:
    """Columns of a cached frame as serialised batches, kept until ``release`` or as long as the frame."""
    held = df.__dict__.setdefault("_blocks", {})
    if columns not in held:
        rows = df.select(*columns).mapInArrow(packed, "block binary").rdd
        most = SPREAD * df.sparkSession.sparkContext.defaultParallelism
        rows = rows.coalesce(most) if rows.getNumPartitions() > most else rows
        held[columns] = rows.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    return held[columns]


def joined(cells: Iterator[bytes]) -> Iterator[bytes]:
    """Serialised batches as fewer ones, of WORTH bytes or one batch more."""
    held, size = [], 0
    for cell in cells:
        held.append(pa.ipc.open_stream(cell).read_next_batch())
        size += len(cell)
        if size >= WORTH:
            yield serialised(pa.concat_batches(held))
            held, size = [], 0
    if held:
        yield serialised(pa.concat_batches(held))


def gathered(df: DataFrame, columns: tuple[str, ...], numbers: int) -> tuple[RDD, bool]:
    """``blocks_of``, and whether the driver adds up the ``numbers`` of each partition itself. Where it can't, as partitions are
    many, but blocks are small, they are kept once more in so few partitions that it can: a pass is one stage of few tasks then."""
    blocks = blocks_of(df, columns)
    n = blocks.getNumPartitions()
    if n == 1 or n * numbers <= FEW:
        return blocks, True
    if numbers > TAKEN:
        return blocks, False
    held = df.__dict__.setdefault("_gathered", {})
    if columns not in held:
        size = sum(df.sparkSession.sparkContext.runJob(blocks, lambda cells: [sum(map(len, cells))]))
        tasks = max(1, -(-size // WORTH))
        held[columns] = blocks.coalesce(tasks).mapPartitions(joined).persist(StorageLevel.MEMORY_AND_DISK) if tasks < n else None
    small = held[columns]
    if small is not None and small.getNumPartitions() * numbers <= TAKEN:
        return small, True
    return blocks, False


def release(df: DataFrame) -> None:
    """Unpersist a frame and its blocks."""
    for name in ("_gathered", "_blocks"):
        for blocks in df.__dict__.pop(name, {}).values():
            if blocks is not None:
                blocks.unpersist()
    df.unpersist()


def met(parts: RDD, n: int, numbers: int) -> RDD:
    """(0, piece), bytes: the sums of ``n`` partitions' sums (at, bytes). In a task MEET of them meet at most, and they
    are cut into pieces, so a task adds up no more than MEET pieces at a time."""
    cuts, wide = -(-numbers // PIECE), PIECE * 8
    items = parts.flatMap(lambda part: (((part[0], c), part[1][c * wide : (c + 1) * wide]) for c in range(cuts)))

    def added(keyed: Iterator[tuple[tuple[int, int], tuple[int, bytes]]]) -> Iterator[tuple[tuple[int, int], bytes]]:
        groups: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        for key, item in keyed:
            groups.setdefault(key, []).append(item)
        for key, group in groups.items():
            total = 0
            for _, raw in sorted(group):
                total = total + np.frombuffer(raw)
            yield key, total.tobytes()

    while n > 1:
        n = -(-n // MEET)
        keyed = items.map(lambda item: ((item[0][0] // MEET, item[0][1]), (item[0][0], item[1])))
        items = keyed.partitionBy(n * cuts, lambda key: key[0] * cuts + key[1]).mapPartitions(added)
    return items


def of_blocks(blocks: RDD, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], numbers: int, driver: bool) -> np.ndarray:
    """``totals`` of serialised batches."""

    def part(at: int, cells: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
        every = sums(pa.ipc.open_stream(cell).read_next_batch() for cell in cells)
        if every is not None:
            yield at, every.tobytes()

    n, total = blocks.getNumPartitions(), np.zeros(numbers)
    parts = blocks.mapPartitionsWithIndex(part)
    if driver:
        for _, raw in sorted(parts.collect()):
            total += np.frombuffer(raw)
        return total
    for (_, piece), raw in met(parts, n, numbers).collect():
        total[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(raw)
    return total


def answers(asks: list[Ask], x: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
    """The flat sums of each ask for a batch."""
    out: list[Any] = [None if a.given is not None else flat(a.kernel(x, batch), a.shapes) for a in asks]
    alike: dict[int, list[int]] = {}
    for i, a in enumerate(asks):
        if a.given is not None:
            alike.setdefault(id(a.kernel), []).append(i)
    for places in alike.values():
        for i, sums in zip(places, asks[places[0]].kernel(x, batch, [asks[i].given for i in places]), strict=True):
            out[i] = flat(sums, asks[i].shapes)
    return out


def asked(df: DataFrame, asks: list[Ask], extra: tuple[str, ...] = ()) -> list[Sums]:
    """The sums that each asks for, in one pass. ``extra``: columns that kernels read from the batch."""
    kind, columns = kind_of(df), columns_of(df)
    ends = np.cumsum([a.size for a in asks])

    def sums_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = observations(batch, kind, columns)
                got = np.concatenate(answers(asks, x, batch))
                total = got if total is None else total + got
        return total

    if df.is_cached:
        blocks, driver = gathered(df, (*columns, *extra), int(ends[-1]))
        total = of_blocks(blocks, sums_of, int(ends[-1]), driver)
    else:
        total = totals(df.select(*columns, *extra), sums_of, int(ends[-1]), False)
    return [shaped(v, a.shapes) for v, a in zip(np.split(total, ends[:-1]), asks, strict=True)]


def summed(df: DataFrame, kernel: Kernel, shapes: dict[str, tuple[int, ...]]) -> Sums:
    return asked(df, [Ask(kernel, shapes)])[0]


def together(df: DataFrame, fits: list[Fit], extra: tuple[str, ...] = ()) -> list[Any]:
    """What each fit returns. In every pass those that still run are served, the first ones of them up to WIDE
    numbers; a fit that runs has its turn in every pass until it ends."""
    results: list[Any] = [None] * len(fits)
    asks: dict[int, Ask] = {}

    def on(i: int, sums: Sums | None) -> None:
        try:
            asks[i] = fits[i].send(sums)
        except StopIteration as end:
            results[i] = end.value
            asks.pop(i, None)

    waiting = list(range(len(fits)))
    while waiting or asks:
        while waiting and (not asks or sum(a.size for a in asks.values()) * (len(asks) + 1) <= WIDE * len(asks)):
            on(waiting.pop(0), None)
        if asks:
            served = list(asks)
            for i, sums in zip(served, asked(df, [asks[i] for i in served], extra), strict=True):
                on(i, sums)
    return results


def alone(df: DataFrame, fit: Fit) -> Any:
    return together(df, [fit])[0]


def mapped(df: DataFrame, work: Callable[[np.ndarray, pa.RecordBatch], list[pa.Array]], added: str) -> DataFrame:
    """Add columns that ``work`` computes from a batch. ``added``: their schema; old columns of those names go."""
    kind, columns = kind_of(df), columns_of(df)
    new = df.sparkSession.createDataFrame([], added).schema
    given = [f for f in df.schema.fields if f.name not in new.names]
    schema = type(df.schema)([*given, *new.fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in given), *work(observations(batch, kind, columns), batch)], names=schema.names)

    return df.mapInArrow(each, schema)


def size_of(df: DataFrame) -> tuple[int, ...]:
    """(p,) or (p, q) of the observations."""
    columns = columns_of(df)
    first = df.select(F.size(F.col("x.re") if kind_of(df) == "complex" else F.col(columns[0])).alias("p")).first()
    if first is None:
        raise ValueError("no observations")
    return (first["p"], len(columns)) if kind_of(df) == "frame" else (first["p"],)
