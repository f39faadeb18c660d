"""Train and score by model name, with the usual defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..operators import gradient, hmm, kmeans, mixture
from ..operators.families import Family, Params
from ..operators.kernels import Fit, size_of

#: Model name -> family and whether it is complex.
MIXTURES = {
    "Watson": ("Watson", False), "Complex_Watson": ("Watson", True), "ACG": ("ACG", False), "Complex_ACG": ("ACG", True), "MACG": ("MACG", False),
    "SingularWishart": ("SingularWishart", False), "Normal": ("Normal", False), "Complex_Normal": ("Normal", True),
}
CLUSTERS = {"diametrical": "diametrical", "complex_diametrical": "diametrical", "grassmann": "grassmann", "weighted_grassmann": "weighted_grassmann", "least_squares": "least_squares"}
HYPERPLANE = "projective_hyperplane"


@dataclass(frozen=True)
class Options:
    """``LR`` above 0 trains by gradient steps of that rate; ``decrease_lr_on_plateau`` cuts it to a tenth once before
    they end. ``threads`` is taken and has no meaning here: executors' cores do the work."""

    tol: float = 1e-10
    max_iter: int = 100_000
    num_repl: int = 1
    num_comparison: int = 50
    force_gamma_same: bool = False
    LR: float = 0.0
    decrease_lr_on_plateau: bool = False
    threads: int = 8


def rank_of(rank: int | str, p: int) -> int:
    """fullrank is 0, lowrank the dimension."""
    return {"fullrank": 0, "lowrank": p}[rank] if isinstance(rank, str) else int(rank)


def family_of(df: DataFrame, modelname: str, rank: int | str, o: Options) -> Family:
    if modelname not in MIXTURES:
        raise ValueError(f"no such model: {modelname}")
    name, is_complex = MIXTURES[modelname]
    shape = size_of(df)
    return Family(name, shape, is_complex, 0 if name == "Watson" else rank_of(rank, shape[0]), o.force_gamma_same)


def trainer(family: Family, o: Options) -> Callable[[Params], Fit]:
    """Fits from parameters by the options: EM, or gradient steps where there is a rate."""
    if o.LR:
        return lambda theta: gradient.training(family, theta, o.LR, o.tol, o.max_iter, o.num_comparison, o.decrease_lr_on_plateau)
    return lambda theta: mixture.training(family, theta, o.tol, o.max_iter, o.num_comparison)


def train(df: DataFrame, k: int, modelname: str, rank: int | str = 0, init: str = "uniform", params: dict | None = None, is_hmm: bool = False, seed: int = 0, id_column: str = "obs_id", **options):
    """A fitted Clusters, Mixture or Hmm. ``params`` start a mixture from given parameters, of lower rank too;
    an Hmm (``df`` with seq_id and t) starts from a mixture fitted by EM."""
    o = Options(**options)
    method = "hyperplane" if modelname == HYPERPLANE else CLUSTERS.get(modelname)
    if method:
        return kmeans.fit(df, k, method, o.max_iter, o.num_repl, init, o.tol, seed, id_column)
    family = family_of(df, modelname, rank, o)
    em = replace(o, LR=0.0) if is_hmm else o
    fitted = mixture.fit(df, family, k, params if params is not None else init, o.tol, o.max_iter, o.num_repl, o.num_comparison, seed=seed, id_column=id_column, train=trainer(family, em))
    if not is_hmm:
        return fitted
    return hmm.fit(df, fitted, k, o.tol, o.max_iter if o.LR else min(o.max_iter, 1_000), o.num_comparison, o.LR, o.decrease_lr_on_plateau)


def score(df: DataFrame, model) -> DataFrame:
    """Rows with loglik and post; of clusters part and sim; of an Hmm one row for each sequence."""
    return model.assign(df) if isinstance(model, kmeans.Clusters) else model.score(df)
