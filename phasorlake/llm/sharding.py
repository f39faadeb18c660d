"""Shards by jump consistent hashing, in DataFrame operations only.

A key jumps from shard to shard: each jump's target is drawn from the key's own sequence of random numbers, and
the last target below the number of shards is its shard. No table of the ring is kept, and when shards are
appended a key either stays or jumps into one of the new ones, so only the necessary fraction moves.

The sequence is the published one: a 64-bit linear congruence, here in two halves of 32 bits, so that no product
leaves a long. A key makes ln(shards) jumps on average and ``shards`` at most; 64 are taken in one fold, a second
fold takes what may be left for the rare key with more.

Numbers within a shard (``slot``) are positions in the order of the rows: rows are range-partitioned by that order,
with a number of their own at its end, so that rows of one key, or equal rows, spread over partitions like any
others; what precedes a partition in its shard comes from a table of one row a partition and shard.

Defined results: a null key is shared like key 0; a null text has no bytes, so size 1 and crc 0; rows that share a
key get one shard and neighbouring slots; equal rows have a slot each; empty tables give empty results; other columns
are carried along unchanged, but for names that begin with ``_shard`` and those of the added columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The multiplier of the published sequence (its increment is 1), in 16-bit parts, lowest first.
FACTOR = 2862933555777941757
_PARTS = [(FACTOR >> (16 * i)) & 0xFFFF for i in range(4)]
_HALF = 0xFFFFFFFF
FOLD = 64


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of (high * 2^32 + low) * FACTOR + 1, modulo 2^64."""
    m0, m1, m2, m3 = (F.lit(p).cast("long") for p in _PARTS)
    first = low * m0 + 1
    second = low * m1 + F.shiftrightunsigned(first, 16)
    lower = F.shiftleft(second.bitwiseAND(0xFFFF), 16).bitwiseOR(first.bitwiseAND(0xFFFF))
    across = low * m2 + F.shiftleft((low * m3).bitwiseAND(0xFFFF), 16) + high * m0 + F.shiftleft((high * m1).bitwiseAND(0xFFFF), 16)
    return (F.shiftrightunsigned(second, 16) + across).bitwiseAND(_HALF), lower


def jumps(key: Column, shards: int) -> Column:
    """struct(at, to) of a long key: its shard among ``shards``, and the target of the jump that would leave them."""
    if shards < 1:
        raise ValueError("there must be a shard")
    state = lambda h, l, at, to: F.struct(h.cast("long").alias("h"), l.cast("long").alias("l"), at.cast("long").alias("at"), to.cast("long").alias("to"))  # noqa: E731, E741

    def jump(s: Column, _: Column) -> Column:
        high, low = _next(s["h"], s["l"])
        draw = F.lit(float(1 << 31)) / (F.shiftrightunsigned(high, 1) + 1).cast("double")
        return F.when(s["to"] < shards, state(high, low, s["to"], F.floor((s["to"] + 1).cast("double") * draw))).otherwise(s)

    many = lambda start, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, jump)
    id_ = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    end = many(state(F.shiftrightunsigned(id_, 32), id_.bitwiseAND(_HALF), F.lit(-1), F.lit(0)), min(shards, FOLD))
    if shards > FOLD:
        end = F.when(end["to"] >= shards, end).otherwise(many(end, shards - FOLD))
    return F.struct(end["at"].alias("at"), end["to"].alias("to"))


def placed(df: DataFrame, key: Column, shards: int = 8) -> DataFrame:
    """Add shard, and grown_shard: the shard where there is one more, which takes a row into itself or leaves it."""
    out = df.drop("shard", "grown_shard").withColumn("_shard_jump", jumps(key, shards))
    at, to = F.col("_shard_jump.at"), F.col("_shard_jump.to")
    return out.withColumn("shard", at.cast("int")).withColumn("grown_shard", F.when(to == shards, shards).otherwise(at).cast("int")).drop("_shard_jump")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Add slot to rows with a shard: 0, 1 ... in each shard, by ``order`` (nulls first); equal rows in any order.

    Rows are written out once with numbers of their own and once in order, so that every later job, and one that runs
    again after a loss, sees the same numbers."""
    given = df.drop("slot")
    rows = stored(given.withColumn("_shard_row", F.monotonically_increasing_id()), "shard-rows")
    by = ["shard", *order, "_shard_row"]
    held = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_shard_row").withColumn("_shard_at", F.monotonically_increasing_id()), "shard-order")
    held = held.withColumn("_shard_part", F.shiftrightunsigned("_shard_at", 33))
    # a row for each partition and the shards in it, of which all but the first and last lie in one partition
    parts = held.groupBy(F.col("shard").alias("_shard_s"), F.col("_shard_part").alias("_shard_p")).agg(F.min("_shard_at").alias("_shard_from"), F.count("*").alias("_shard_n"))
    sooner = Window.partitionBy("_shard_s").orderBy("_shard_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_shard_before", F.coalesce(F.sum("_shard_n").over(sooner), F.lit(0)))
    out = held.join(F.broadcast(parts), (F.col("shard") == F.col("_shard_s")) & (F.col("_shard_part") == F.col("_shard_p")))
    return out.withColumn("slot", F.col("_shard_before") + F.col("_shard_at") - F.col("_shard_from")).select(*given.columns, "slot")


def write(df: DataFrame, path: str, shards: int = 8, key: str = "doc_id", rows_a_file: int = 1_000_000) -> None:
    """Write whole rows as Parquet, a folder for each shard. A shard's rows go to many tasks, so no task holds one."""
    own = F.pmod(F.monotonically_increasing_id(), F.lit(97))
    out = placed(df, F.col(key), shards).withColumn("_shard_slice", own).repartition("shard", "_shard_slice").drop("_shard_slice")
    out.write.partitionBy("shard").option("maxRecordsPerFile", rows_a_file).parquet(path)


def sharded_documents(documents: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = documents.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = numbered(placed(narrow, F.col("doc_id"), shards), ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
