"""Scoring a stream of observations with fixed parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..operators.mixture import Mixture


def scored(stream: DataFrame, model: Mixture) -> DataFrame:
    """loglik, post and part of each row, as it comes: the kernels work on Arrow batches, without state."""
    return model.score(stream).withColumn("part", vec.argmax(F.col("post")))


def windowed_counts(scores: DataFrame, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, part, n, loglik (mean): rows later than the watermark are left out."""
    return scores.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), "part").agg(F.count("*").alias("n"), F.avg("loglik").alias("loglik"))
