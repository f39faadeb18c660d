"""Partitions held against each other and against a truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.special import assignment
from .families import Params, covariance


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n of the pairs that occur."""
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def _information(cells: DataFrame, a: str, b: str, n: str) -> DataFrame:
    """mi: mutual information of a weighted table of two labels; cells of weight 0 don't count."""
    total = F.sum(n).over(Window.partitionBy())
    joint = F.col(n) / total
    apart = (F.sum(n).over(Window.partitionBy(a)) / total) * (F.sum(n).over(Window.partitionBy(b)) / total)
    return cells.where(F.col(n) > 0).select((joint * F.log(joint / apart)).alias("v")).agg(F.sum("v").alias("mi"))


def nmi(df: DataFrame, a: str, b: str) -> DataFrame:
    """mi, nmi of two hard partitions: twice the mutual information by the sum of those with themselves."""
    cells = contingency(df, a, b)
    own = lambda c, name: _information(df.groupBy(F.col(c).alias("x"), F.col(c).alias("y")).agg(F.count("*").alias("n")), "x", "y", "n").withColumnRenamed("mi", name)
    both = _information(cells, a, b, "n").crossJoin(own(a, "ma")).crossJoin(own(b, "mb"))
    return both.select("mi", (2 * F.col("mi") / (F.col("ma") + F.col("mb"))).alias("nmi"))


def _soft_cells(df: DataFrame, a: str, b: str) -> DataFrame:
    """i, j, n: sums of products of two posterior columns."""
    pairs = df.select(F.posexplode(a).alias("i", "pa"), F.col(b).alias("pb")).select("i", "pa", F.posexplode("pb").alias("j", "pb"))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("pa") * F.col("pb")).alias("n"))


def nmi_soft(df: DataFrame, a: str, b: str) -> DataFrame:
    """mi, nmi of two posterior columns, by the same formula."""
    mi = lambda x, y, name: _information(_soft_cells(df, x, y), "i", "j", "n").withColumnRenamed("mi", name)
    both = mi(a, b, "mi").crossJoin(mi(a, a, "ma")).crossJoin(mi(b, b, "mb"))
    return both.select("mi", (2 * F.col("mi") / (F.col("ma") + F.col("mb"))).alias("nmi"))


def nmi_by(df: DataFrame, keys: list[str], truth: str, post: str) -> DataFrame:
    """keys, mi, nmi of a label and a posterior column within each group: the label counts as a posterior of 0
    and 1. Cells are summed by (keys, label, component) and (keys, component, component)."""
    long = df.select(*keys, F.col(truth).alias("_t"), F.posexplode(post).alias("i", "p"), F.col(post).alias("_q"))
    mixed = long.groupBy(*keys, F.col("_t").cast("long").alias("x"), F.col("i").cast("long").alias("y")).agg(F.sum("p").alias("n"))
    soft = long.select(*keys, F.col("i").cast("long").alias("x"), "p", F.posexplode("_q").alias("y", "q")).groupBy(*keys, "x", F.col("y").cast("long").alias("y")).agg(F.sum(F.col("p") * F.col("q")).alias("n"))
    hard = df.groupBy(*keys, F.col(truth).cast("long").alias("x"), F.col(truth).cast("long").alias("y")).agg(F.count("*").cast("double").alias("n"))

    def information(cells: DataFrame, name: str) -> DataFrame:
        share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
        side = lambda c: F.sum("n").over(Window.partitionBy(*keys, c)) / F.sum("n").over(Window.partitionBy(*keys))
        return cells.where("n > 0").select(*keys, (share * F.log(share / (side("x") * side("y")))).alias("v")).groupBy(*keys).agg(F.sum("v").alias(name))

    parts = [information(mixed, "mi"), information(soft, "mp"), information(hard, "mt")]
    both = parts[0].join(parts[1], keys).join(parts[2], keys) if keys else parts[0].crossJoin(parts[1]).crossJoin(parts[2])
    return both.select(*keys, "mi", (2 * F.col("mi") / (F.col("mp") + F.col("mt"))).alias("nmi"))


def window_truth(t: Column, k: int, length: int = 1200) -> Column:
    """The block that a time belongs to: k equal blocks of a scan."""
    return F.floor(t / (length / k)).cast("int")


def entropies(df: DataFrame, keys: list[str], post: str = "post") -> DataFrame:
    """keys, entropy (sum over rows and components) and entropy_pi (of the mean posterior)."""
    long = df.select(*keys, F.posexplode(post).alias("k", "p"))
    by_k = long.groupBy(*keys, "k").agg(F.sum(vec.entropy(F.col("p"))).alias("h"), F.avg("p").alias("m"))
    return by_k.groupBy(*keys).agg(F.sum("h").alias("entropy"), F.sum(vec.entropy(F.col("m"))).alias("entropy_pi"))


def mean_loglik(df: DataFrame, keys: list[str], value: str = "loglik", length: str | None = None) -> DataFrame:
    """keys, loglik: the mean by group; of sequences, each divided by its length first."""
    v = F.col(value) / F.col(length) if length else F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("loglik"))


def match(df: DataFrame, k: int, truth: str = "truth", subject: str = "subject", post: str = "post") -> np.ndarray:
    """The component of each true class: mean posteriors within a subject and class, averaged over subjects,
    assigned so that their sum is largest. The driver gets k x k numbers."""
    long = df.select(subject, truth, F.posexplode(post).alias("k", "p"))
    mean = long.groupBy(subject, truth, "k").agg(F.avg("p").alias("m")).groupBy(truth, "k").agg(F.avg("m").alias("m")).collect()
    table = np.zeros((k, k))
    for r in mean:
        table[r[truth], r["k"]] = r["m"]
    return assignment(-table)


def reordered(df: DataFrame, order: np.ndarray, post: str = "post") -> DataFrame:
    """Posteriors with their components in the order of the classes."""
    return df.withColumn(post, F.array(*(F.get(post, F.lit(int(j))) for j in order)))


def accuracy(df: DataFrame, keys: list[str], truth: str = "truth", pred: str = "part") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(pred) == F.col(truth)).cast("double")).alias("accuracy"))


def average_posterior(df: DataFrame, position: list[str], post: str = "post") -> DataFrame:
    """position, k, p: the mean over everything else (subjects)."""
    return df.select(*position, F.posexplode(post).alias("k", "p")).groupBy(*position, "k").agg(F.avg("p").alias("p"))


def largest(long: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part: the component with the largest p, the lowest of equal ones."""
    return long.groupBy(*keys).agg(F.max_by("k", F.struct("p", -F.col("k"))).alias("part"))


def posterior_to_accuracy(train: DataFrame, test: DataFrame, k: int, position: list[str], truth: str = "truth") -> dict[str, float]:
    """Train posteriors averaged by position give the match of components to classes; test accuracy of
    single rows, and of the positions' mean posterior."""
    hits = largest(average_posterior(train, [*position, truth]), [*position, truth]).groupBy(truth, "part").agg(F.count("*").alias("n")).collect()
    table = np.zeros((k, k))
    for r in hits:
        table[r[truth], r["part"]] = r["n"]
    order = assignment(-table / np.maximum(table.sum(1, keepdims=True), 1))
    named = F.create_map(*(F.lit(int(v)) for c, j in enumerate(order) for v in (j, c)))
    rows = test.withColumn("part", named[vec.argmax(F.col("post"))])
    single = accuracy(rows, [], truth).first()["accuracy"]
    mean = largest(average_posterior(test, [*position, truth]), [*position, truth]).withColumn("part", named[F.col("part")])
    return {"accuracy": single, "ensemble_accuracy": accuracy(mean, [], truth).first()["accuracy"]}


def confusion(df: DataFrame, truth: str = "truth", pred: str = "part") -> DataFrame:
    """truth, pred, n, share (of the true class)."""
    return contingency(df, truth, pred).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def reproducibility(df: DataFrame, run: str = "inner", row: str = "obs_id", part: str = "part") -> DataFrame:
    """Each pair of runs and the nmi of their partitions: runs meet by row, and by order of their names."""
    a, b = df.select(row, F.col(run).alias("inner1"), F.col(part).alias("a")), df.select(row, F.col(run).alias("inner2"), F.col(part).alias("b"))
    cells = a.join(b, row).where("inner1 < inner2").groupBy("inner1", "inner2", "a", "b").agg(F.count("*").alias("n"))
    both, pair = [], ["inner1", "inner2"]
    for x, y in (("a", "b"), ("a", "a"), ("b", "b")):
        c = cells.groupBy(*pair, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.sum("n").alias("n"))
        total = F.sum("n").over(Window.partitionBy(*pair))
        joint = F.col("n") / total
        apart = (F.sum("n").over(Window.partitionBy(*pair, "x")) / total) * (F.sum("n").over(Window.partitionBy(*pair, "y")) / total)
        both.append(c.select(*pair, (joint * F.log(joint / apart)).alias("v")).groupBy(*pair).agg(F.sum("v").alias(f"m_{x}{y}")))
    out = both[0].join(both[1], pair).join(both[2], pair)
    return out.select(*pair, (2 * F.col("m_ab") / (F.col("m_aa") + F.col("m_bb"))).alias("nmi"))


def covariances(spark, theta: Params) -> DataFrame:
    """k, i, j, re, im of the components' covariances; of Watson the axis times itself by the root of its
    concentration."""
    rows = []
    for k in range(len(theta["pi"])):
        if "mu" in theta:
            c = np.outer(theta["mu"][k], theta["mu"][k].conj()) * np.sqrt(abs(float(theta["kappa"][k])))
        else:
            c = covariance(theta, k)
        rows += [(k, i, j, float(c[i, j].real), float(c[i, j].imag)) for i in range(len(c)) for j in range(len(c))]
    return spark.createDataFrame(rows, "k int, i int, j int, re double, im double")
