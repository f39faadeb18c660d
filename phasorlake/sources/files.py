"""Files: number matrices, event lists, observations by task, parameters, posteriors, results."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """t, channel, value of comma-separated matrix files, one line for each t from 0 on in each file; blank lines
    don't count. Lines are numbered within the blocks that Spark reads, and blocks start from the count of those
    before them in their file."""
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select("value", *at, F.monotonically_increasing_id().alias("id")).where(F.trim("value") != "")
    block = ["file_path", "file_block_start"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = lines.groupBy(*block).agg(F.count("*").alias("n")).select(*block, before.alias("before"))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("id")) - 1
    numbered = lines.withColumn("place", place).join(F.broadcast(starts), block).select((F.col("before") + F.col("place")).alias("t"), "value")
    return numbered.select("t", F.posexplode(F.split("value", ",")).alias("channel", "v")).select("t", "channel", F.trim("v").cast("double").alias("value"))


def write_matrix(df: DataFrame, path: str) -> None:
    """t, channel, value as comma-separated lines in order of t, columns in order of channel."""
    wide = df.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("channel", "value"))).alias("r"))
    line = F.array_join(F.transform("r", lambda c: c["value"].cast("string")), ",")
    wide.select("t", line.alias("value")).orderBy("t").select("value").write.mode("overwrite").text(path)


def interleaved(matrix: DataFrame) -> DataFrame:
    """A matrix that holds two vectors for each time on alternate lines: t, channel, first, second."""
    pick = lambda k, name: matrix.where(F.col("t") % 2 == k).select(F.floor(F.col("t") / 2).alias("t"), "channel", F.col("value").alias(name))
    return pick(0, "first").join(pick(1, "second"), ["t", "channel"])


# fixed values: event lists of each task that count as its conditions
CONDITIONS = {
    "EMOTION": ("fear", "neut"),
    "GAMBLING": ("loss", "win"),
    "LANGUAGE": ("math", "story"),
    "MOTOR": ("lf", "lh", "rf", "rh", "t"),
    "RELATIONAL": ("relation", "match"),
    "SOCIAL": ("mental", "rnd"),
    "WM": ("0bk_body", "0bk_faces", "0bk_places", "0bk_tools", "2bk_body", "2bk_faces", "2bk_places", "2bk_tools"),
}


def _events(lines: DataFrame, *more: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = lines.select(*more, *(F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("onset", "duration", "amplitude"))))
    return rows.where("onset is not null and duration is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """onset, duration, amplitude of event lists; separated by blanks or commas, other lines are left out."""
    return _events(spark.read.text(path))


def find_events(spark: SparkSession, root: str, conditions: dict[str, tuple[str, ...]] = CONDITIONS, template: str = "{subject}/EVs/{task}/{condition}.txt") -> DataFrame:
    """The event lists below ``root`` that are a task's conditions: what the template names, then onset, duration, amplitude.
    A name in braces stands for a part of the path without a slash, * for any; other files aren't opened, as the condition is
    on paths alone. A task or condition without a file gives no rows, a root without any file an AnalysisException."""
    names = re.findall(r"{(\w+)}", template)
    parts = re.split(r"{\w+}", template)
    pattern = "([^/]+)".join(re.escape(p).replace(r"\*", "[^/]*") for p in parts) + "$"
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    found = {n: F.regexp_extract(path, "/" + pattern, i + 1) for i, n in enumerate(names)}
    wanted = F.concat(found["task"], F.lit("/"), found["condition"]).isin([f"{t}/{c}" for t, every in conditions.items() for c in every])
    lines = spark.read.text(f"{root}/{'*'.join(parts)}").where(wanted)
    return _events(lines.select("value", *(c.alias(n) for n, c in found.items())), *names)


def write_observations(df: DataFrame, path: str, by: tuple[str, ...] = ("split", "task")) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def unfinished(results: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``wanted`` (a sweep's settings) that no result has yet: where a sweep goes on."""
    return wanted.join(results.select(*keys).distinct(), keys, "left_anti")


def write_posterior(df: DataFrame, path: str, id_column: str = "obs_id") -> None:
    """obs_id, k, prob of scored rows."""
    df.select(id_column, F.posexplode("post").alias("k", "prob")).write.mode("overwrite").parquet(path)


def read_posterior(spark: SparkSession, path: str, id_column: str = "obs_id") -> DataFrame:
    """obs_id, post."""
    rows = spark.read.parquet(path).groupBy(id_column).agg(F.sort_array(F.collect_list(F.struct("k", "prob"))).alias("p"))
    return rows.select(id_column, F.transform("p", lambda c: c["prob"]).alias("post"))


PARAMS = "name string, place array<int>, re double, im double"


def params_table(spark: SparkSession, theta: dict[str, np.ndarray]) -> DataFrame:
    """Parameters as rows: name, place, re, im."""
    rows = [(n, [int(i) for i in at], float(np.real(v)), float(np.imag(v))) for n, a in theta.items() for at, v in np.ndenumerate(np.asarray(a))]
    return spark.createDataFrame(rows, PARAMS)


def params_from(df: DataFrame) -> dict[str, np.ndarray]:
    """The parameters of such rows; real where no imaginary part is other than 0."""
    got: dict[str, dict] = {}
    for r in df.collect():
        got.setdefault(r["name"], {})[tuple(r["place"])] = complex(r["re"], r["im"])
    out = {}
    for name, cells in got.items():
        a = np.zeros(tuple(np.max(list(cells), axis=0) + 1), complex)
        for at, v in cells.items():
            a[at] = v
        out[name] = a if np.any(a.imag) else a.real
    return out


def lower_rank(ranks: list[int], rank: int) -> int | None:
    """The highest rank below ``rank`` of those already fitted."""
    return max((r for r in ranks if r < rank), default=None)
