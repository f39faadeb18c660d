"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a queue of shuffled documents. A document's virtual finish time is the number of its
source's words up to and including it, divided by the source's target; a source whose target is above
its size is read again, up to ``repeats`` times, with later finish times. All queues are served in order
of finish time until the budget (the size of all documents) is used up, so every source has then had
about its target.

The cumulative sums are taken in slices of the shuffled order, and those of the slices in groups of slices, so
no source, however large, meets in one task; the final cut is found in one slice of the finish times.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own, last
in order; rows of equal finish time are served together; repeated rows are documents of their own, served
in the same place, and all rows with a null id have one place; empty tables give empty results; other
columns are carried along unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: int) -> Column:
    """A document's place in the shuffled order: 60 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3) -> DataFrame:
    """(source, source_size) -> source, source_size, target: the weights' shares of the total, where no
    target exceeds ``repeats`` times its source and the excess goes to the others by weight.

    A source is full when its limit per unit of weight is under what is left for it and for all with a
    larger limit; those come first in order of limit, so running sums give the common level.
    One row for each source: the ordering windows run over that small table."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = reduce(lambda so_far, i: so_far.when(F.col("_rank") % len(weights) == i, weights[i]), range(1, len(weights)), F.when(F.col("_rank") % len(weights) == 0, weights[0]))
    t = totals.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * repeats)
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    open_w = F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    t = t.withColumn("_level", left.cast("double") / open_w)
    t = t.withColumn("_full", F.col("_cap").cast("double") <= F.col("_level") * F.col("_w"))
    common = F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("_w")).alias("a"), F.col("_rank").alias("b"), F.col("_level").alias("level")))).over(every)["level"]
    return t.select("source", "source_size", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(common * F.col("_w")).alias("target"))


def with_before(df: DataFrame, keys: list[str], at: str, value: str, out: str, group: int = 1_000) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same keys with a smaller ``at``. Groups of ``at`` are
    summed first, so one task sees a ``group``-th of the rows at most, or the rows of one group."""
    grouped = df.withColumn("_mix_g", F.floor(F.col(at) / group))
    totals = grouped.groupBy(*keys, "_mix_g").agg(F.sum(value).alias("_mix_t"))
    sooner = lambda *by: F.coalesce(F.sum("_mix_t" if by[-1] == "_mix_g" else value).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*(F.col(k).alias(f"_mix_of_{k}") for k in keys), F.col("_mix_g").alias("_mix_og"), sooner(*keys, "_mix_g").alias("_mix_t"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_mix_of_{k}")) for k in keys), F.col("_mix_g") == F.col("_mix_og"))
    inner = grouped.withColumn(out, sooner(*keys, "_mix_g", at))
    return inner.join(totals, same).withColumn(out, F.col(out) + F.col("_mix_t")).select(*df.columns, out)


def mix(sized: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, repeats: int = 3, slice_rows: int = 3_000, narrow: DataFrame | None = None) -> DataFrame:
    """Add source_size, target and taken to ``sized`` (doc_id, source, size and any other columns but
    those that begin with ``_mix``). ``narrow``: the same rows with those three columns alone, where they
    are stored already."""
    narrow = sized.select("doc_id", "source", "size") if narrow is None else narrow
    slices = max(1, -(-narrow.count() // slice_rows))
    width = F.lit((1 << 60) // slices + 1)

    def sliced(df: DataFrame) -> DataFrame:
        return df.withColumn("_mix_h", place(F.col("doc_id"), seed)).withColumn("_mix_b", F.floor(F.col("_mix_h") / width).cast("long"))

    parts = stored(sliced(narrow).groupBy("source", "_mix_b").agg(F.sum("size").alias("_mix_n")), "mix-slices")
    plan = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    offsets = stored(with_before(parts, ["source"], "_mix_b", "_mix_n", "_mix_off").join(plan.withColumnRenamed("source", "_mix_s"), F.col("source").eqNullSafe(F.col("_mix_s"))).select(F.col("source").alias("_mix_s"), F.col("_mix_b").alias("_mix_sb"), "_mix_off", "source_size", "target"), "mix-offsets")

    def timed(df: DataFrame) -> DataFrame:
        """Virtual finish time of the first pass, and the time that a whole pass takes."""
        in_slice = Window.partitionBy("source", "_mix_b").orderBy("_mix_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        d = sliced(df).withColumn("_mix_c", F.sum("size").over(in_slice))
        d = d.join(offsets, F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_b") == F.col("_mix_sb")))
        served = F.col("target") > 0
        return d.withColumn("_mix_v", F.when(served, (F.col("_mix_off") + F.col("_mix_c")).cast("double") / F.col("target"))).withColumn("_mix_p", F.when(served, F.col("source_size").cast("double") / F.col("target")))

    times = F.array(*(F.col("_mix_v") + F.col("_mix_p") * i for i in range(repeats)))
    events = timed(narrow).where("size > 0").select("size", F.explode(times).alias("v")).withColumn("slot", F.floor(F.least(F.col("v"), F.lit(float(4 * repeats))) * slices).cast("long"))
    slots = with_before(stored(events.groupBy("slot").agg(F.sum("size").alias("n")), "mix-slots"), [], "slot", "n", "before")
    budget = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    # the slot in which the budget runs out: only its events need their exact order
    last = slots.crossJoin(F.broadcast(budget)).where("before < budget and before + n >= budget").select(F.col("slot").alias("last"), "before", "budget")
    in_order = Window.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = events.join(F.broadcast(last), F.col("slot") == F.col("last"))
    cut = edge.groupBy("v", "before", "budget").agg(F.sum("size").alias("n")).withColumn("upto", F.col("before") + F.sum("n").over(in_order)).agg(F.min(F.when(F.col("upto") >= F.col("budget"), F.col("v"))).alias("_mix_cut"))
    out = timed(sized).crossJoin(F.broadcast(cut))
    passes = reduce(lambda a, b: a + b, (F.when(F.col("_mix_v") + F.col("_mix_p") * i <= F.col("_mix_cut"), 1).otherwise(0) for i in range(repeats)))
    return out.withColumn("taken", (F.col("size") * passes).cast("long")).drop("_mix_h", "_mix_b", "_mix_c", "_mix_s", "_mix_sb", "_mix_off", "_mix_v", "_mix_p", "_mix_cut")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = stored(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")
