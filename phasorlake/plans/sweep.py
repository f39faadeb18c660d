"""Sweeps over model order, and the choice of the best runs from their results.

Results are rows (modelname, K, rank, inner, Set, Subject, loglik, NMI, ...). Choices compare means rounded
to nine places and go to the lowest candidate of equal ones, so that reruns agree whatever the order of
summation.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import evaluate, kernels, kmeans, mixture
from . import engine


def _top(df: DataFrame, keys: list[str], value: str, of: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), of)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_inner(results: DataFrame, keys: list[str], value: str = "loglik") -> DataFrame:
    """keys, inner: the restart with the largest mean."""
    mean = results.groupBy(*keys, "inner").agg(F.round(F.avg(value), 9).alias("_m"))
    return _top(mean, keys, "_m", "inner").select(*keys, "inner")


def best_rank(results: DataFrame, keys: list[str], value: str = "nmi") -> DataFrame:
    """keys, rank, inner: the rank with the largest mean, then its best restart."""
    by_rank = results.groupBy(*keys, "rank").agg(F.round(F.avg(value), 9).alias("_m"))
    rank = _top(by_rank, keys, "_m", "rank").select(*keys, "rank")
    return best_inner(results.join(rank, [*keys, "rank"], "left_semi"), [*keys, "rank"], value).select(*keys, "rank", "inner")


def best_order(results: DataFrame, model: str, order: str, value: str) -> DataFrame:
    """model, order, value: the model order with the largest mean."""
    mean = results.groupBy(model, order).agg(F.avg(value).alias(value)).withColumn("_m", F.round(value, 9))
    return _top(mean, [model], "_m", order).select(model, order, value)


def mean_and_error(results: DataFrame, keys: list[str], value: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(value).alias("mean"), vec.standard_error(F.col(value)).alias("se"))


def labelled(results: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Replace values of a column by their labels; others stay."""
    return results.na.replace(names, subset=[column])


def collected(parts: list[DataFrame]) -> DataFrame:
    """Results of several sweeps in one frame; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rank_sweep(sets: dict[str, DataFrame], modelname: str, ks: int | tuple[int, ...], ranks: tuple[int, ...], inner: int = 1, subject: str = "subject", **options) -> DataFrame:
    """Fit each order and rank on the set ``train``, ``inner`` times, each rank from the parameters of the next lower
    one, and give each set's mean log-likelihood by subject.

    Every order and restart is a chain of fits, and all chains share their passes over the data, each at the rank that
    it has reached; what has stopped leaves the pass. All models are then scored in one pass over each set."""
    orders = (ks,) if isinstance(ks, int) else ks
    o = engine.Options(**options)
    families = {rank: engine.family_of(sets["train"], modelname, rank, o) for rank in sorted(ranks)}

    def chain(k: int, run: int) -> kernels.Fit:
        theta, out = None, []
        for rank, family in families.items():
            start = theta if theta is not None else (yield from mixture.uniform_start(family, k, run))
            model = yield from engine.trainer(family, o)(start)
            theta = model.theta
            out.append((k, rank, run, model))
        return out

    train = sets["train"].select(*kernels.columns_of(sets["train"])).cache()
    try:
        mixture.validate(train, next(iter(families.values())))
        fitted = [m for chain_ in kernels.together(train, [chain(k, run) for k in orders for run in range(inner)]) for m in chain_]
    finally:
        kernels.release(train)
    names = sets["train"].sparkSession.createDataFrame([(i, modelname, k, str(rank), run) for i, (k, rank, run, _) in enumerate(fitted)], "model int, modelname string, K int, rank string, inner int")
    rows = []
    for name, df in sets.items():
        scored = mixture.mean_logliks(df, [m for *_, m in fitted], subject).join(F.broadcast(names), "model")
        rows.append(scored.select("modelname", "K", "rank", "inner", F.lit(name).alias("Set"), F.col(subject).alias("Subject"), F.round("loglik", 4).alias("loglik")))
    return collected(rows)


def posterior_rows(model, df: DataFrame) -> DataFrame:
    """Rows with loglik and post: of clusters the similarity and the part as a posterior of 0 and 1."""
    scored = engine.score(df, model)
    if isinstance(model, kmeans.Clusters):
        return scored.withColumnRenamed("sim", "loglik").withColumn("post", vec.one_hot(F.col("part"), len(model.centres)))
    return scored


def run(sets: dict[str, DataFrame], modelname: str, k: int, rank: int | str = 0, inner: int = 0, truth: str = "truth", subject: str = "subject", **options) -> tuple[object, DataFrame]:
    """Fit on the set ``train``, score every set: the model, and rows modelname, K, rank, inner, Set, Subject,
    loglik, NMI (of posteriors and truth), entropy, entropy_pi, accuracy (of rows, after matching components to
    classes on the train set)."""
    model = engine.train(sets["train"], k, modelname, rank=rank, seed=inner, **options)
    rows = {name: posterior_rows(model, df) for name, df in sets.items()}
    classes = int(sets["train"].agg(F.max(truth)).first()[0]) + 1
    order = evaluate.match(rows["train"].withColumn("post", padded(F.col("post"), max(k, classes))), max(k, classes), truth, subject)
    named = F.create_map(*(F.lit(int(v)) for c, j in enumerate(order) for v in (j, c)))
    out = []
    for name, df in rows.items():
        mean = df.groupBy(subject).agg(F.avg("loglik").alias("loglik"), F.avg((named[vec.argmax(F.col("post"))] == F.col(truth)).cast("double")).alias("accuracy"))
        info = evaluate.nmi_by(df, [subject], truth, "post")
        got = mean.join(info, subject).join(evaluate.entropies(df, [subject]), subject)
        labels = [F.lit(v).alias(n) for n, v in (("modelname", modelname), ("K", k), ("rank", str(rank)), ("inner", inner), ("Set", name))]
        out.append(got.select(*labels, F.col(subject).alias("Subject"), "loglik", F.col("nmi").alias("NMI"), "entropy", "entropy_pi", "accuracy"))
    return model, collected(out)


def padded(post, k: int):
    """A posterior with zeros up to k components."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.coalesce(F.get(post, j), F.lit(0.0)))


def cluster_sweep(df: DataFrame, modelname: str, k: int, inits: tuple[str, ...] = ("++", "uniform"), inner: int = 100, truth: str = "truth") -> DataFrame:
    """modelname, K, init_method, inner, objective, NMI of each restart of each start."""
    out = []
    for init in inits:
        for r in range(inner):
            model = engine.train(df, k, modelname, init=init, seed=r)
            info = evaluate.nmi(model.assign(df), "part", truth)
            out.append(info.select(F.lit(modelname).alias("modelname"), F.lit(k).alias("K"), F.lit(init).alias("init_method"), F.lit(r).alias("inner"), F.lit(model.objective[-1]).alias("objective"), F.col("nmi").alias("NMI")))
    return collected(out)


def noise_sweep(make, levels: tuple[float, ...], modelname: str, k: int, repeats: int = 5, **options) -> DataFrame:
    """level, noise, repeat, Set, NMI: a model fitted and scored at each noise level. ``make``: a function of
    (noise, seed) that gives a set with truth and the observation."""
    out = []
    for level, noise in enumerate(levels):
        for r in range(repeats):
            sets = {"train": make(noise, 2 * r), "test": make(noise, 2 * r + 1)}
            model = engine.train(sets["train"], k, modelname, seed=r, **options)
            for name, df in sets.items():
                info = evaluate.nmi_by(posterior_rows(model, df), [], "truth", "post")
                out.append(info.select(F.lit(level).alias("level"), F.lit(float(noise)).alias("noise"), F.lit(r).alias("repeat"), F.lit(name).alias("Set"), F.col("nmi").alias("NMI")))
    return collected(out)


def sphere_grid(spark, n: int) -> DataFrame:
    """i, j, x: the midpoints of a grid of n by n steps of the two angles on the unit sphere."""
    theta, phi = (F.col("j") + 0.5) / n * F.lit(2 * math.pi), (F.col("i") + 0.5) / n * F.lit(math.pi)
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    return cells.select("i", "j", F.array(F.sin(phi) * F.cos(theta), F.sin(phi) * F.sin(theta), F.cos(phi)).alias("x"))


def grid_density(model, grid: DataFrame, threshold: float = 0.95) -> DataFrame:
    """i, j, k, density (ln of the weighted component, from 0 to 1 over its grid), inside (above the threshold)."""
    pi = F.array(*(F.lit(float(v)) for v in model.theta["pi"]))
    lp = model.densities(grid).select("i", "j", F.posexplode("lp").alias("k", "lp"))
    lp = lp.select("i", "j", "k", (F.col("lp") + F.log(F.get(pi, F.col("k")))).alias("lp"))
    ends = lp.groupBy("k").agg(F.min("lp").alias("low"), F.max("lp").alias("high"))
    value = (F.col("lp") - F.col("low")) / (F.col("high") - F.col("low"))
    return lp.join(F.broadcast(ends), "k").select("i", "j", "k", value.alias("density"), (value > threshold).alias("inside"))
