"""Runs on phase-controlled scans: one is fitted, two others test, against the known windows.

A sweep is a table of settings: how a fit starts (``experiment``), rank, rate of the gradient steps (0: EM), restart,
and whether a hidden Markov model follows. The mixtures of a restart share their passes over the data, and all of them
are scored in one pass over each scan. Results are rows; with a ``path`` those of a restart are stored when it ends,
with the parameters that later ranks start from, and a sweep that begins again only does what is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hmm, kernels, mixture
from ..operators.families import Params
from ..operators.mixture import Mixture, weights
from ..sources import files
from . import engine

#: Start of a model's fits: by random parameters, K-means, K-means and fits of its parts, or the last with each rank
#: from the parameters of the next lower one.
EXPERIMENTS = ("random", "Kmeans", "Kmeansseg", "ALL")
SETS = ("train", "test1", "test2")
KEYS = ["modelname", "experiment", "rank", "LR", "inner", "HMM"]
RESULT = "modelname string, experiment string, init_method string, LR double, HMM boolean, K int, p int, rank int, inner int, iter int, " + ", ".join(f"{s}_{v} double" for v in ("loglik", "NMI") for s in SETS)


@dataclass(frozen=True)
class Setting:
    modelname: str
    experiment: str
    rank: int
    LR: float
    inner: int
    HMM: bool


def scan_slices(df: DataFrame, rows: int = 1200, id_column: str = "obs_id") -> dict[str, DataFrame]:
    """The first three stretches of ``rows`` ids as train, test1 and test2, each with seq_id and t; ranges of ids, so
    that files are pruned by their statistics."""
    at = F.col(id_column)
    parts = {name: df.where((at >= i * rows) & (at < (i + 1) * rows)) for i, name in enumerate(SETS)}
    return {name: part.withColumn("seq_id", F.lit(i).cast("long")).withColumn("t", at - i * rows) for i, (name, part) in enumerate(parts.items())}


def start_of(modelname: str, experiment: str) -> str:
    if experiment == "random":
        return "uniform"
    family = engine.MIXTURES[modelname][0]
    base = {"Watson": "dc", "ACG": "dc", "MACG": "gc", "SingularWishart": "wgc", "Normal": "ls"}[family]
    return base if experiment == "Kmeans" else f"{base}_seg"


def settings(modelname: str, experiments: tuple[str, ...], ranks: tuple[int, ...], rates: tuple[float, ...], inner: int, with_hmm: bool = True) -> list[Setting]:
    """All runs; Watson models have no ranks, and hidden Markov models follow gradient steps only."""
    watson = engine.MIXTURES[modelname][0] == "Watson"
    every = []
    for e in experiments:
        if e not in EXPERIMENTS:
            raise ValueError(f"no such experiment: {e}")
        if watson and e == "ALL":
            continue
        for rank in sorted(ranks)[:1] if watson else sorted(ranks):
            every += [Setting(modelname, e, rank, lr, r, h) for r in range(inner) for lr in rates for h in ((False, True) if lr and with_hmm else (False,))]
    return every


def information(joint: np.ndarray) -> float:
    p = joint / joint.sum()
    both = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log(p[p > 0] / both[p > 0])).sum())


def normalised(joint: np.ndarray, own: np.ndarray, truth: np.ndarray) -> float:
    total = information(own) + information(np.diag(truth))
    return 2 * information(joint) / total if total > 0 else 0.0


def scored(df: DataFrame, models: list[Mixture], classes: int, truth: str = "truth") -> list[tuple[float, float]]:
    """(log-likelihood, NMI of posteriors and truth) of each model, all in one pass."""

    def ask(m: Mixture) -> kernels.Ask:
        k = len(m.theta["pi"])

        def kernel(x, batch) -> kernels.Sums:
            total, post = weights(m.family.log_pdf(x, m.theta) + np.log(m.theta["pi"]))
            z = np.eye(classes)[np.asarray(batch.column(truth))]
            return {"loglik": np.array([total.sum()]), "joint": post.T @ z, "own": post.T @ post, "truth": z.sum(0)}

        return kernels.Ask(kernel, {"loglik": (1,), "joint": (k, classes), "own": (k, k), "truth": (classes,)})

    got = kernels.asked(df, [ask(m) for m in models], (truth,)) if models else []
    return [(float(g["loglik"][0]), normalised(g["joint"], g["own"], g["truth"])) for g in got]


def scored_paths(df: DataFrame, model: hmm.Hmm, classes: int, truth: str = "truth") -> tuple[float, float]:
    """Of a hidden Markov model: log-likelihood, NMI of its paths and truth."""
    k = len(model.delta)
    cells = model.paths(df).join(df.select("seq_id", "t", truth), ["seq_id", "t"]).groupBy("state", truth).count().collect()
    joint = np.zeros((k, classes))
    for r in cells:
        joint[r["state"], r[truth]] = r["count"]
    return float(model.score(df).agg(F.sum("loglik")).first()[0]), normalised(joint, np.diag(joint.sum(1)), joint.sum(0))


def run(sets: dict[str, DataFrame], setting: Setting, k: int, params: Params | None = None, truth: str = "truth", **options) -> tuple[object, dict]:
    """One setting: the model, and its row. ``params``: what it starts from, in place of the experiment's start."""
    model = engine.train(sets["train"], k, setting.modelname, rank=setting.rank, init=start_of(setting.modelname, setting.experiment), params=params, is_hmm=setting.HMM, seed=setting.inner, LR=setting.LR, **options)
    score = scored_paths if setting.HMM else lambda df, m, c: scored(df, [m], c, truth)[0]
    classes = int(sets["train"].agg(F.max(truth)).first()[0]) + 1
    return model, _row(setting, k, model, {name: score(df, model, classes) for name, df in sets.items()}, params is not None)


def _row(s: Setting, k: int, model, values: dict[str, tuple[float, float]], given: bool) -> dict:
    init = "no" if given or s.HMM else start_of(s.modelname, s.experiment)
    row = {"modelname": s.modelname, "experiment": s.experiment, "init_method": init, "LR": s.LR, "HMM": s.HMM, "K": k, "p": model.family.p, "rank": s.rank, "inner": s.inner, "iter": len(model.curve)}
    return row | {f"{name}_loglik": v[0] for name, v in values.items()} | {"train_loglik": float(model.curve[-1])} | {f"{name}_NMI": v[1] for name, v in values.items()}


def sweep(sets: dict[str, DataFrame], modelname: str, k: int = 5, experiments: tuple[str, ...] = EXPERIMENTS, ranks: tuple[int, ...] = (1, 5, 10, 25, 50), rates: tuple[float, ...] = (0.0, 0.1), inner: int = 10, path: str | None = None, with_hmm: bool = True, id_column: str = "obs_id", **options) -> DataFrame:
    """The rows of all settings. ``path``: a folder of results and parameters to go on from."""
    spark = sets["train"].sparkSession
    o = engine.Options(**({"tol": 1e-12} | options))
    every = settings(modelname, experiments, ranks, rates, inner, with_hmm)
    done = _stored(spark, f"{path}/results", RESULT) if path else None
    if done is not None:
        table = spark.createDataFrame([astuple(s) for s in every], "modelname string, experiment string, rank int, LR double, inner int, HMM boolean")
        left = {Setting(*(r[c] for c in Setting.__dataclass_fields__)) for r in files.unfinished(done, table, KEYS).collect()}
        every = [s for s in every if s in left]
    rows: list[dict] = []
    held = {name: df.cache() for name, df in sets.items()}
    try:
        classes = int(held["train"].agg(F.max("truth")).first()[0]) + 1
        for r in sorted({s.inner for s in every}):
            new = list(_restart(held, [s for s in every if s.inner == r], min(ranks), k, classes, o, path, id_column))
            rows += new
            if path:
                files.append_results(spark.createDataFrame([tuple(x[c] for c in _names()) for x in new], RESULT), f"{path}/results")
    finally:
        for df in held.values():
            kernels.release(df)
    if path:
        return spark.read.schema(RESULT).parquet(f"{path}/results")
    return spark.createDataFrame([tuple(x[c] for c in _names()) for x in rows], RESULT)


def _names() -> list[str]:
    return [c.split()[0] for c in RESULT.split(", ")]


def _stored(spark, path: str, schema: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def _restart(sets: dict[str, DataFrame], wanted: list[Setting], lowest: int, k: int, classes: int, o: engine.Options, path: str | None, id_column: str) -> Iterator[dict]:
    """The rows of one restart's settings: mixtures together, then what follows them."""
    train, spark = sets["train"], sets["train"].sparkSession
    # a hidden Markov model whose mixture is stored already still needs that mixture
    mixtures = sorted({Setting(s.modelname, s.experiment, s.rank, s.LR, s.inner, False) for s in wanted}, key=lambda s: s.rank)
    chains: dict[tuple, list[Setting]] = {}
    for s in mixtures:
        chains.setdefault((s.experiment, s.LR) if s.experiment == "ALL" else (s.experiment, s.LR, s.rank), []).append(s)
    families = {s.rank: engine.family_of(train, s.modelname, s.rank, _tied(s, o)) for s in mixtures}
    mixture.validate(train, next(iter(families.values())))
    starts: dict[tuple, Params] = {}
    given: set[Setting] = set()

    def chain(members: list[Setting]) -> kernels.Fit:
        theta, out = None, []
        for s in members:
            if theta is None and s.experiment == "ALL" and path and s.rank > lowest:
                theta = _params(spark, path, s)
            if theta is not None:
                given.add(s)
            options = engine.replace(_tied(s, o), LR=s.LR)
            model = yield from engine.trainer(families[s.rank], options)(starts[s.experiment, s.rank] if theta is None else theta)
            out.append((s, model))
            theta = model.theta if s.experiment == "ALL" else None
        return out

    for members in chains.values():  # starts that look at the data make passes of their own; rates share them
        for s in members if members[0].experiment != "ALL" else members[:1]:
            if (s.experiment, s.rank) not in starts:
                starts[s.experiment, s.rank] = mixture.start(train, families[s.rank], k, start_of(s.modelname, s.experiment), s.inner, id_column)
    fitted = [pair for got in kernels.together(train, [chain(m) for m in chains.values()]) for pair in got]
    values = {name: scored(df, [m for _, m in fitted], classes) for name, df in sets.items()}
    follows = [(Setting(s.modelname, s.experiment, s.rank, s.LR, s.inner, True), model) for s, model in fitted]
    follows = [(s, model) for s, model in follows if s in wanted]
    if follows:
        models = hmm.fit_all(train, [m for _, m in follows], o.tol, o.max_iter, o.num_comparison, [s.LR for s, _ in follows], o.decrease_lr_on_plateau)
        for (s, _), model in zip(follows, models, strict=True):
            yield _row(s, k, model, {name: scored_paths(df, model, classes) for name, df in sets.items()}, True)
    for i, (s, model) in enumerate(fitted):
        if s in wanted:
            if path and s.experiment == "ALL":
                table = files.params_table(spark, model.theta).withColumn("of", F.lit(_key(s)))
                files.append_results(table, f"{path}/params")
            yield _row(s, k, model, {name: v[i] for name, v in values.items()}, s in given)


def _tied(s: Setting, o: engine.Options) -> engine.Options:
    """K-means starts of scaled families have one noise level for all components."""
    tied = s.experiment in ("Kmeans", "Kmeansseg") and engine.MIXTURES[s.modelname][0] in ("SingularWishart", "Normal")
    return engine.replace(o, force_gamma_same=True) if tied else o


def _key(s: Setting) -> str:
    return f"{s.modelname}_rank{s.rank}_LR{s.LR}_inner{s.inner}"


def _params(spark, path: str, s: Setting) -> Params | None:
    """The stored parameters of the next lower rank."""
    held = _stored(spark, f"{path}/params", f"{files.PARAMS}, of string")
    if held is None:
        return None
    ranks = [int(r["of"].split("_rank")[1].split("_")[0]) for r in held.where(F.col("of").startswith(f"{s.modelname}_rank") & F.col("of").endswith(f"_LR{s.LR}_inner{s.inner}")).select("of").distinct().collect()]
    low = files.lower_rank(ranks, s.rank)
    if low is None:
        return None
    lower = Setting(s.modelname, s.experiment, low, s.LR, s.inner, False)
    return files.params_from(held.where(F.col("of") == _key(lower)))
