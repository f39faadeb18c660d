"""The library's own inputs made from the tables: observations, series, posteriors, sequences, results. Each
has its SQL, so that queries and their SQL start from the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec

STEP = 0.72


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places; adding 0 makes -0 a 0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, truth, x (64 numbers of unit length)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs_id"), F.col("label").cast("int").alias("truth"), vec.doubles(F.col("embedding")).alias("y"))
    return e.select("obs_id", "truth", vec.divided("y", F.sqrt(vec.norm2(F.col("y")))).alias("x"))


OBSERVATIONS = "obs AS (SELECT vec_id AS obs_id, label::INT AS truth, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda u: u * u)))) AS x FROM embeddings)"


def complex_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, truth, x struct<re, im> of 32 complex numbers, of unit length."""
    x = F.col("x")
    return observations(spark, sf_dir).select("obs_id", "truth", F.struct(vec.even_places(x).alias("re"), vec.odd_places(x).alias("im")).alias("x"))


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, truth, theta (64 phases)."""
    return observations(spark, sf_dir).select("obs_id", "truth", F.transform("x", lambda v: v * (4 * math.pi)).alias("theta"))


PHASES = OBSERVATIONS + ", ph AS (SELECT obs_id, list_transform(x, lambda v: v * (4 * pi())) AS theta FROM obs)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, session, t, channel, value."""
    o = observations(spark, sf_dir)
    return o.select(F.col("truth").alias("subject"), (F.col("obs_id") % 2).alias("session"), F.col("obs_id").alias("t"), F.posexplode("x").alias("channel", "value"))


SERIES = OBSERVATIONS + ", series AS (SELECT truth AS subject, obs_id % 2 AS session, obs_id AS t, unnest(range(len(x))) AS channel, unnest(x) AS value FROM obs)"


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, truth (0 to 3), subject, position, post (squares of the sums of 16 places each, to sum 1) and
    other (the same of another cut)."""
    o = observations(spark, sf_dir)
    x = F.col("x")
    cut = lambda rest: F.array(*(F.pow(vec.total(F.filter(x, (lambda k: lambda _, i: rest(i) == k)(k))), F.lit(2.0)) for k in range(4)))
    a = o.select("obs_id", (F.col("truth") % 4).alias("truth"), (F.col("obs_id") % 7).alias("subject"), F.floor(F.col("obs_id") / 7).alias("position"), cut(lambda i: i % 4).alias("a"), cut(lambda i: F.floor(i / 16)).alias("b"))
    part = lambda c: vec.divided(c, vec.total(F.col(c)))
    return a.select("obs_id", "truth", "subject", "position", part("a").alias("post"), part("b").alias("other"))


def _cut_sql(rest: str) -> str:
    sums = ", ".join(f"pow(list_sum(list_filter(x, lambda v, i: {rest} = {k})), 2)" for k in range(4))
    return f"[{sums}]"


POSTERIORS = OBSERVATIONS + f""", sq AS (SELECT obs_id, truth % 4 AS truth, obs_id % 7 AS subject, (obs_id // 7)::BIGINT AS position, {_cut_sql("(i - 1) % 4")} AS a, {_cut_sql("(i - 1) // 16")} AS b FROM obs),
post AS (SELECT obs_id, truth, subject, position, list_transform(a, lambda v: v / list_sum(a)) AS post, list_transform(b, lambda v: v / list_sum(b)) AS other FROM sq),
long AS (SELECT obs_id, truth, subject, position, unnest(range(4)) AS k, unnest(post) AS p FROM post),
part AS (SELECT obs_id, truth, subject, position, list_position(post, list_max(post)) - 1 AS part, list_position(other, list_max(other)) - 1 AS part2 FROM post)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posteriors with part and part2, their largest components."""
    return posteriors(spark, sf_dir).withColumn("part", vec.argmax(F.col("post"))).withColumn("part2", vec.argmax(F.col("other")))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, t, post, lp: events of a user in order, with made-up state weights."""
    i = F.col("event_id")
    p = (i * 37 % 101) / 101
    lp = F.array(-(i % 7).cast("double") / 3, -(i % 5).cast("double") / 2)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq_id"), i.alias("t"), F.array(p, 1 - p).alias("post"), lp.alias("lp"))


SEQUENCES = "seq AS (SELECT user_id AS seq_id, event_id AS t, (event_id * 37 % 101)::DOUBLE / 101 AS p, -(event_id % 7)::DOUBLE / 3 AS a, -(event_id % 5)::DOUBLE / 2 AS b FROM events)"


def stimuli(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events (subject, task, condition, onset, duration) and the scans' volumes (subject, task, t, value)."""
    e = table(spark, sf_dir, "events")
    given = e.select(F.col("user_id").alias("subject"), F.col("event_type").alias("task"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("condition"), ((F.col("event_id") * 7 % 1500).cast("double") / 10).alias("onset"), (F.col("event_id") % 5 + 1).cast("double").alias("duration"))
    scans = given.select("subject", "task").distinct().select("subject", "task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("t"))
    return given, scans.withColumn("value", F.col("t") * 0.5 + F.col("subject"))


STIMULI = """ev AS (SELECT user_id AS subject, event_type AS task, 'c' || (event_id % 3) AS condition, (event_id * 7 % 1500)::DOUBLE / 10 AS onset, (event_id % 5 + 1)::DOUBLE AS duration FROM events),
scan AS (SELECT subject, task, unnest(range(200)) AS t FROM (SELECT DISTINCT subject, task FROM ev))"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep's results: modelname, K, rank, inner, subject, loglik, nmi."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("modelname"), F.col("l_linenumber").cast("long").alias("K"), (F.col("l_partkey") % 3).alias("rank"), (F.col("l_suppkey") % 5).alias("inner"), F.col("l_orderkey").alias("subject"), F.col("l_extendedprice").cast("double").alias("loglik"), F.col("l_discount").cast("double").alias("nmi"))


RESULTS = 'res AS (SELECT l_returnflag AS modelname, l_linenumber::BIGINT AS "K", l_partkey % 3 AS rank, l_suppkey % 5 AS "inner", l_orderkey AS subject, l_extendedprice::DOUBLE AS loglik, l_discount::DOUBLE AS nmi FROM lineitem)'
