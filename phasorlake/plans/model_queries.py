"""Queries of clustering, mixtures, hidden Markov models, evaluation, tests and sweeps, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import evaluate, gradient, hmm, kmeans, mixture, signal, stats, supervised
from ..operators.families import Family
from . import engine, phase_runs, sweep
from . import fixtures as fx
from .fixtures import rounded

QUERIES: dict = {}
ORACLE_SQL: dict = {}
R = fx.r


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- clustering -----------------------------------------------------------------------------------


def first_of_each(df: DataFrame) -> np.ndarray:
    """The row with the smallest id of each of the ten labels, as centres."""
    rows = df.groupBy("truth").agg(F.min_by("x", "obs_id").alias("x")).orderBy("truth").collect()
    return np.array([r["x"] for r in rows])


_CENTRES = fx.OBSERVATIONS + """, cen AS (SELECT row_number() OVER (ORDER BY truth) - 1 AS k, arg_min(x, obs_id) AS c FROM obs GROUP BY truth),
sim AS (SELECT obs_id, truth, k, pow(list_dot_product(x, c), 2) AS s FROM obs, cen)"""


@query(f"""WITH {_CENTRES}, top AS (SELECT obs_id, k, s, row_number() OVER (PARTITION BY obs_id ORDER BY s DESC, k) AS n FROM sim) SELECT obs_id, k::INT AS part, {R("s")} AS sim FROM top WHERE n = 1""")
def k9_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return rounded(kmeans.Clusters("diametrical", first_of_each(o)).assign(o).select("obs_id", "part", "sim"))


@query(f"WITH {fx.POSTERIORS}, l AS (SELECT obs_id, part, unnest(range(4)) AS i FROM part) SELECT obs_id, i, CASE WHEN part = i THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM l")
def k10_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.parts(spark, sf_dir)
    return p.select("obs_id", F.posexplode(vec.one_hot(F.col("part"), 4)).alias("i", "value"))


def frames(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    f = signal.coherence_frames(fx.phases(spark, sf_dir))
    return (signal.scaled_frames(f) if scaled else f).select("obs_id", "truth", "u1", "u2")


def _clustered(df: DataFrame, method: str, init: str = "maxmin") -> DataFrame:
    return rounded(kmeans.fit(df, 5, method, init=init).assign(df).select("obs_id", "truth", "part", "sim"))


def _farthest(k: int) -> str:
    """far0, far1 ...: rows with their distance to the closest centre so far, and the centres c0, c1 ..."""
    steps = ["far0 AS (SELECT obs_id, x, 1.0::DOUBLE AS d FROM obs), c0 AS (SELECT x AS c FROM far0 ORDER BY obs_id LIMIT 1)"]
    for j in range(1, k):
        steps.append(f"far{j} AS (SELECT obs_id, x, least({'d' if j > 1 else '1e300'}, greatest(1 - pow(list_dot_product(x, c), 2), 0)) AS d FROM far{j - 1}, c{j - 1}), c{j} AS (SELECT x AS c FROM far{j} ORDER BY d DESC, obs_id LIMIT 1)")
    return ", ".join(steps)


@query(f"WITH {fx.OBSERVATIONS}, {_farthest(5)}, cen AS ({' UNION ALL '.join(f'SELECT {j} AS k, c FROM c{j}' for j in range(5))}) SELECT k, i, {R('v')} AS value FROM (SELECT k, unnest(range(64)) AS i, unnest(c) AS v FROM cen)")
def k1_spread_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kmeans.spread_centres(fx.observations(spark, sf_dir), 5, "diametrical", farthest=True)
    return rounded(spark.createDataFrame([(k, i, float(v)) for k, row in enumerate(c) for i, v in enumerate(row)], "k int, i int, value double"))


# one pass from given centres: parts, the centres of their rows, and the parts by those

_TOP = "row_number() OVER (PARTITION BY obs_id ORDER BY s DESC, k) AS n"
_PARTED = f"{_CENTRES}, own AS (SELECT obs_id, k FROM (SELECT obs_id, k, {_TOP} FROM sim) WHERE n = 1)"
_BY_NEW = f"SELECT obs_id, k::INT AS part, {R('s')} AS sim FROM (SELECT obs_id, k, s, {_TOP} FROM again) WHERE n = 1"
_SUMMED = "new AS (SELECT k, list(v ORDER BY i) AS c FROM (SELECT k, i, sum(v) AS v FROM (SELECT k, unnest(range(len(x))) AS i, unnest(x) AS v FROM wx) GROUP BY k, i) GROUP BY k)"


def _stepped(df: DataFrame, method: str, centres: np.ndarray) -> DataFrame:
    return rounded(kmeans.fit(df, len(centres), method, max_iter=1, init=centres).assign(df).select("obs_id", "part", "sim"))


@query(f"""WITH {_PARTED}, wx AS (SELECT own.k, list_transform(x, lambda v: v * list_dot_product(x, c)) AS x FROM own JOIN obs USING (obs_id) JOIN cen ON cen.k = own.k), {_SUMMED},
again AS (SELECT obs_id, k, pow(list_dot_product(x, c), 2) / list_dot_product(c, c) AS s FROM obs, new) {_BY_NEW}""")
def k2_diametrical_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return _stepped(o, "diametrical", first_of_each(o))


def _powers(name: str, of: str, times: int = 13) -> str:
    """A matrix (k, m: list of rows) brought to a high power by squaring, so that its rows point along its
    leading eigenvector: name (k, v)."""
    steps = [f"{name}0 AS (SELECT k, m FROM {of})"]
    for j in range(times):
        steps.append(f"{name}{j}t AS (SELECT k, m, list_sum(list_transform(m, lambda a: list_dot_product(a, a))) AS f FROM {name}{j}), {name}{j + 1} AS (SELECT k, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / f)) AS m FROM {name}{j}t)")
    last = f"{name}{times}"
    longest = f"list_sort(list_transform(m, lambda a: {{'n': list_dot_product(a, a), 'a': a}}))[-1]"
    steps.append(f"{name} AS (SELECT k, list_transform(e.a, lambda u: u / sqrt(e.n)) AS v FROM (SELECT k, {longest} AS e FROM {last}))")
    return ", ".join(steps)


_GRAM = "cell AS (SELECT k, i, j, sum(a * b) AS v FROM (SELECT k, i, a, unnest(range(64)) AS j, unnest(x) AS b FROM (SELECT k, x, unnest(range(64)) AS i, unnest(x) AS a FROM wx)) GROUP BY k, i, j), line AS (SELECT k, i, list(v ORDER BY j) AS r FROM cell GROUP BY k, i), gram AS (SELECT k, list(r ORDER BY i) AS m FROM line GROUP BY k)"


@query(f"""WITH {_PARTED}, wx AS (SELECT k, x FROM own JOIN obs USING (obs_id)), {_GRAM}, {_powers("lead", "gram")},
again AS (SELECT obs_id, k, pow(list_dot_product(x, v), 2) AS s FROM obs, lead) {_BY_NEW}""")
def k3_hyperplane_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return _stepped(o, "hyperplane", first_of_each(o))


_FLIPPED = "flip AS (SELECT obs_id, list_transform(x, lambda v: v * sg) AS x FROM (SELECT obs_id, x, CASE WHEN len(list_filter(x, lambda v: v > 0)) > len(x) / 2 THEN -1 ELSE 1 END AS sg FROM obs))"
_APART = "2 * list_dot_product(x, c) - list_dot_product(x, x) - list_dot_product(c, c)"


@query(f"""WITH {_CENTRES}, {_FLIPPED}, near AS (SELECT obs_id, x, k, {_APART} AS s FROM flip, cen), own AS (SELECT obs_id, x, k FROM (SELECT obs_id, x, k, {_TOP} FROM near) WHERE n = 1),
size AS (SELECT k, count(*) AS m FROM own GROUP BY k), wx AS (SELECT own.k, list_transform(x, lambda v: v / m) AS x FROM own JOIN size ON size.k = own.k), {_SUMMED},
every AS (SELECT cen.k, coalesce(new.c, cen.c) AS c FROM cen LEFT JOIN new ON cen.k = new.k), again AS (SELECT obs_id, k, {_APART} AS s FROM flip, every) {_BY_NEW}""")
def k6_least_squares_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    flipped = o.withColumn("x", vec.flip_sign(F.col("x")))
    return rounded(kmeans.fit(o, 10, "least_squares", max_iter=1, init=first_of_each(o)).assign(flipped).select("obs_id", "part", "sim"))


def first_frames(df: DataFrame) -> np.ndarray:
    rows = df.groupBy("truth").agg(F.min_by(F.struct("u1", "u2"), "obs_id").alias("u")).orderBy("truth").collect()
    return np.stack([np.stack([r["u"]["u1"], r["u"]["u2"]], 1) for r in rows])


def _frame_sql(scaled: bool) -> str:
    """fr (obs_id, truth, u1, u2) and first (k, c1, c2), the first frame of each label."""
    by = lambda v: "" if scaled else f" / sqrt({v})"
    return fx.PHASES + f""", z AS (SELECT obs_id, theta, len(theta) AS n, list_sum(list_transform(theta, lambda v: cos(v * 2))) AS c, list_sum(list_transform(theta, lambda v: sin(v * 2))) AS s FROM ph),
lam AS (SELECT obs_id, theta, (n + sqrt(c * c + s * s)) / 2 AS l1, (n - sqrt(c * c + s * s)) / 2 AS l2, atan2(s, c) / 2 AS h FROM z),
fr AS (SELECT obs_id, truth, l1, l2, list_transform(theta, lambda v: cos(v - h){by("l1")}) AS u1, list_transform(theta, lambda v: sin(v - h){by("l2")}) AS u2 FROM lam JOIN obs USING (obs_id)),
first AS (SELECT row_number() OVER (ORDER BY truth) - 1 AS k, arg_min(u1, obs_id) AS c1, arg_min(u2, obs_id) AS c2 FROM fr GROUP BY truth)"""


_SQUARES = "pow(list_dot_product(u1, c1), 2) + pow(list_dot_product(u1, c2), 2) + pow(list_dot_product(u2, c1), 2) + pow(list_dot_product(u2, c2), 2)"
_CHORD = f"-(4 - 2 * ({_SQUARES})) / sqrt(2.0::DOUBLE)"
_Q = lambda a, b: f"pow(list_dot_product({a}, {a}), 2) + pow(list_dot_product({b}, {b}), 2)"
_WEIGHTED = f"-({_Q('u1', 'u2')} + {_Q('c1', 'c2')} - 2 * ({_SQUARES})) / sqrt(2.0::DOUBLE)"


def _frame_assign(scaled: bool, sim: str) -> str:
    return f"WITH {_frame_sql(scaled)}, sim AS (SELECT obs_id, k, {sim} AS s FROM fr, first) SELECT obs_id, k::INT AS part, {R('s')} AS sim FROM (SELECT obs_id, k, s, {_TOP} FROM sim) WHERE n = 1"


@query(_frame_assign(False, _CHORD))
def k4_grassmann_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return rounded(kmeans.Clusters("grassmann", first_frames(f)).assign(f).select("obs_id", "part", "sim"))


@query(_frame_assign(True, _WEIGHTED))
def k5_weighted_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir, scaled=True)
    return rounded(kmeans.Clusters("weighted_grassmann", first_frames(f)).assign(f).select("obs_id", "part", "sim"))


_COMPLEX = fx.OBSERVATIONS + """, cx AS (SELECT obs_id, truth, list_filter(x, lambda v, i: i % 2 = 1) AS re, list_filter(x, lambda v, i: i % 2 = 0) AS im FROM obs),
ccen AS (SELECT row_number() OVER (ORDER BY truth) - 1 AS k, arg_min(re, obs_id) AS a, arg_min(im, obs_id) AS b FROM cx GROUP BY truth),
csim AS (SELECT obs_id, k, pow(list_dot_product(re, a) + list_dot_product(im, b), 2) + pow(list_dot_product(im, a) - list_dot_product(re, b), 2) AS s FROM cx, ccen)"""


def first_complex(df: DataFrame) -> np.ndarray:
    rows = df.groupBy("truth").agg(F.min_by("x", "obs_id").alias("x")).orderBy("truth").collect()
    return np.array([np.array(r["x"]["re"]) + 1j * np.array(r["x"]["im"]) for r in rows])


@query(f"WITH {_COMPLEX} SELECT obs_id, k::INT AS part, {R('s')} AS sim FROM (SELECT obs_id, k, s, {_TOP} FROM csim) WHERE n = 1")
def k2_complex_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.complex_observations(spark, sf_dir)
    return rounded(kmeans.Clusters("diametrical", first_complex(c)).assign(c).select("obs_id", "part", "sim"))


@query()
def k2_diametrical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(fx.observations(spark, sf_dir), "diametrical")


@query()
def k2_complex_diametrical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(fx.complex_observations(spark, sf_dir), "diametrical")


@query()
def k3_hyperplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(fx.observations(spark, sf_dir), "hyperplane")


@query()
def k4_grassmann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(frames(spark, sf_dir), "grassmann")


@query()
def k5_weighted_grassmann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(frames(spark, sf_dir, scaled=True), "weighted_grassmann")


@query()
def k6_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(fx.observations(spark, sf_dir), "least_squares")


@query()
def k7_uniform_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(fx.observations(spark, sf_dir), "diametrical", "uniform")


@query()
def k8_hyperplane_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(fx.observations(spark, sf_dir), "diametrical", "hyperplane")


_G = {"a": "list_dot_product(u1, c1)", "b": "list_dot_product(u1, c2)", "c": "list_dot_product(u2, c1)", "d": "list_dot_product(u2, c2)"}


@query(f"""WITH {_frame_sql(False)}, one AS (SELECT u1 AS c1, u2 AS c2 FROM fr ORDER BY obs_id LIMIT 1), g AS (SELECT obs_id, {", ".join(f"{v} AS {k}" for k, v in _G.items())} FROM fr, one),
t AS (SELECT obs_id, a * a + b * b + c * c + d * d AS tr, a * d - b * c AS det FROM g), e AS (SELECT obs_id, sqrt(tr + 2 * abs(det)) AS p, sqrt(greatest(tr - 2 * abs(det), 0)) AS m FROM t)
SELECT obs_id, {R("sqrt(pow(acos(least(greatest((p + m) / 2, -1), 1)), 2) + pow(acos(least(greatest((p - m) / 2, -1), 1)), 2))", 5)} AS geodesic FROM e""")
def k11_geodesic(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    first = f.orderBy("obs_id").select("u1", "u2").first()
    return rounded(kmeans.geodesic(f, np.stack([first["u1"], first["u2"]], 1)).select("obs_id", "geodesic"), 5)


# -- mixtures -------------------------------------------------------------------------------------

_KAPPA = [5.0 + k for k in range(10)]


def _sphere(p: int, is_complex: bool = False) -> str:
    """ln of 1 / area of the sphere, in SQL."""
    c = p if is_complex else p / 2
    return f"(lgamma({c}::DOUBLE) - ln(2.0::DOUBLE) - {c}::DOUBLE * ln(pi()))"


def _kummer(a: float, c: float, x: str) -> str:
    """ln 1F1(a; c; x) of a positive x, by the terms of its series, in SQL."""
    return f"ln(list_sum(list_transform(range(300), lambda j: exp(lgamma({a}::DOUBLE + j) - lgamma({a}::DOUBLE) - lgamma({c}::DOUBLE + j) + lgamma({c}::DOUBLE) + j * ln({x}) - lgamma(j + 1.0::DOUBLE)))))"


_CON = lambda p, a, c, is_complex: f"con AS MATERIALIZED (SELECT k, k + 5.0::DOUBLE AS kappa, {_sphere(p, is_complex)} - {_kummer(a, c, '(k + 5.0::DOUBLE)')} AS con FROM range(10) AS x(k))"


def watson(o: DataFrame) -> mixture.Mixture:
    return mixture.Mixture(Family("Watson", (64,)), {"pi": np.full(10, 0.1), "mu": first_of_each(o), "kappa": np.array(_KAPPA)})


_WATSON = _CENTRES + f", {_CON(64, 0.5, 32.0, False)}, lp AS (SELECT obs_id, k, con + kappa * s AS lp FROM sim JOIN con USING (k)), tot AS (SELECT obs_id, max(lp) AS m FROM lp GROUP BY ALL), ll AS (SELECT obs_id, any_value(m) + ln(sum(exp(lp - m)) / 10) AS loglik FROM lp JOIN tot USING (obs_id) GROUP BY obs_id)"


@query(f"WITH {_WATSON} SELECT obs_id, k AS i, {R('lp')} AS value FROM lp")
def d1_watson_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return rounded(watson(o).densities(o).select("obs_id", F.posexplode("lp").alias("i", "value")))


@query(f"WITH {_WATSON} SELECT obs_id, {R('loglik')} AS loglik FROM ll")
def d10_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return rounded(watson(o).score(o).select("obs_id", "loglik"))


@query(f"WITH {_WATSON} SELECT obs_id, k AS i, {R('exp(lp - loglik) / 10')} AS p FROM lp JOIN ll USING (obs_id)")
def d11_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return rounded(watson(o).score(o).select("obs_id", F.posexplode("post").alias("i", "p")))


@query(f"WITH {fx.OBSERVATIONS}, s AS (SELECT obs_id, list_dot_product(x, x) AS q, unnest([0, 1, 2]) AS k FROM obs) SELECT obs_id, k AS i, {R('-32 * ln(2 * pi()) - 32 * ln(1 + k / 10.0::DOUBLE) - q / (1 + k / 10.0::DOUBLE) / 2')} AS value FROM s")
def d9_normal_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    psi = np.stack([np.eye(64) * (1 + k / 10) for k in range(3)])
    m = mixture.Mixture(Family("Normal", (64,)), {"pi": np.full(3, 1 / 3), "Psi": psi})
    return rounded(m.densities(o).select("obs_id", F.posexplode("lp").alias("i", "value")))


# covariances I (or gamma I) plus b times a vector with itself: determinant and form are known in closed form

_B = [1.0 + k for k in range(10)]
_b = "(k + 1.0::DOUBLE)"


def _spikes(centres: np.ndarray, low: bool) -> dict[str, np.ndarray]:
    b = np.array(_B)[: len(centres)]
    pi = np.full(len(b), 1 / len(b))
    if low:
        return {"pi": pi, "M": (centres * np.sqrt(b)[:, None])[:, :, None]}
    return {"pi": pi, "Psi": np.eye(centres.shape[1]) + b[:, None, None] * np.einsum("kp,kr->kpr", centres, centres.conj())}


def _values(df: DataFrame, family: Family, theta: dict) -> DataFrame:
    return rounded(mixture.Mixture(family, theta).densities(df).select("obs_id", F.posexplode("lp").alias("i", "value")))


_ACG = f"{_sphere(64)} - 0.5 * ln(1 + {_b}) - 32 * ln(1 - {_b} / (1 + {_b}) * s)"
_CACG = f"{_sphere(32, True)} - ln(1 + {_b}) - 32 * ln(1 - {_b} / (1 + {_b}) * s)"


@query(f"WITH {_CENTRES} SELECT obs_id, k AS i, {R(_ACG)} AS value FROM sim")
def d2_acg_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return _values(o, Family("ACG", (64,)), _spikes(first_of_each(o), False))


@query(f"WITH {_CENTRES} SELECT obs_id, k AS i, {R(_ACG)} AS value FROM sim")
def d3_acg_lowrank_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return _values(o, Family("ACG", (64,), rank=1), _spikes(first_of_each(o), True))


@query(f"WITH {_COMPLEX}, {_CON(32, 1.0, 32.0, True)} SELECT obs_id, k AS i, {R('con + kappa * s')} AS value FROM csim JOIN con USING (k)")
def d1_complex_watson_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.complex_observations(spark, sf_dir)
    return _values(c, Family("Watson", (32,), True), {"pi": np.full(10, 0.1), "mu": first_complex(c), "kappa": np.array(_KAPPA)})


@query(f"WITH {_COMPLEX} SELECT obs_id, k AS i, {R(_CACG)} AS value FROM csim")
def d2_complex_acg_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.complex_observations(spark, sf_dir)
    return _values(c, Family("ACG", (32,), True), _spikes(first_complex(c), False))


_NORMAL = lambda p, a, s: f"-{p} * {a} * ln(pi() / {a}) - {a} * ({p - 1} * ln(2.0::DOUBLE) + ln(2 + {_b})) - {a} * (list_dot_product(x, x) - {_b} / (2 + {_b}) * {s}) / 2"


@query(f"WITH {_CENTRES} SELECT sim.obs_id, k AS i, {R(_NORMAL(64, '0.5::DOUBLE', 's'))} AS value FROM sim JOIN obs USING (obs_id)")
def d8_normal_lowrank_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return _values(o, Family("Normal", (64,), rank=1), _spikes(first_of_each(o), True) | {"gamma": np.full(10, 2.0)})


@query(f"WITH {_COMPLEX} SELECT csim.obs_id, k AS i, {R(_NORMAL(32, '1.0::DOUBLE', 's'))} AS value FROM csim JOIN obs USING (obs_id)")
def d8_complex_normal_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.complex_observations(spark, sf_dir)
    return _values(c, Family("Normal", (32,), True, rank=1), _spikes(first_complex(c), True) | {"gamma": np.full(10, 2.0)})


_AXIS = "list_transform(c1, lambda v: v / sqrt(list_dot_product(c1, c1)))"
_ON_AXIS = lambda scaled: f"{_frame_sql(scaled)}, ax AS (SELECT k, {_AXIS} AS c FROM first), w AS (SELECT obs_id, k, u1, u2, l1, l2, list_dot_product(u1, c) AS a, list_dot_product(u2, c) AS b FROM fr, ax)"
_MACG = f"-ln(1 + {_b}) - 32 * ln(1 - {_b} / (1 + {_b}) * (a * a + b * b))"


def _axes(df: DataFrame) -> np.ndarray:
    c = first_frames(df)[:, :, 0]
    return c / np.linalg.norm(c, axis=1, keepdims=True)


@query(f"WITH {_ON_AXIS(False)} SELECT obs_id, k AS i, {R(_MACG)} AS value FROM w")
def d4_macg_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return _values(f, Family("MACG", (64, 2)), _spikes(_axes(f), False))


@query(f"WITH {_ON_AXIS(False)} SELECT obs_id, k AS i, {R(_MACG)} AS value FROM w")
def d5_macg_lowrank_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return _values(f, Family("MACG", (64, 2), rank=1), _spikes(_axes(f), True))


_HEAD = "-31.5::DOUBLE * ln(pow(u1[1] * u2[2] - u1[2] * u2[1], 2))"
# q (q - p) / 2 ln pi - p q / 2 ln 2, less q (q - 1) / 4 ln pi and the gammas of q and q - 1/2
_NORMALISER = "(-62 * ln(pi()) - 64 * ln(2.0::DOUBLE) - ln(pi()) / 2 - lgamma(2.0::DOUBLE) - lgamma(1.5::DOUBLE))"
_WISHART = lambda g, head=_HEAD: f"{_NORMALISER} - (63 * ln({g}::DOUBLE) + ln({g} + {_b})) - (l1 + l2 - {_b} / ({g} + {_b}) * (a * a + b * b)) / {g} / 2 + {head}"


@query(f"WITH {_ON_AXIS(True)} SELECT obs_id, k AS i, {R(_WISHART(2.0), 5)} AS value FROM w")
def d6_wishart_lowrank_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir, scaled=True)
    m = mixture.Mixture(Family("SingularWishart", (64, 2), rank=1), _spikes(_axes(f), True) | {"gamma": np.full(10, 2.0)})
    return rounded(m.densities(f).select("obs_id", F.posexplode("lp").alias("i", "value")), 5)


@query(f"WITH {_ON_AXIS(True)} SELECT obs_id, k AS i, {R(_WISHART(1.0, '0'), 5)} AS value FROM w")
def d7_wishart_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir, scaled=True)
    m = mixture.Mixture(Family("SingularWishart", (64, 2)), _spikes(_axes(f), False))
    return rounded(m.densities(f).select("obs_id", F.posexplode("lp").alias("i", "value")), 5)


@query(f"WITH {_WATSON} SELECT count(*) AS n, {R('sum(loglik)', 4)} AS loglik FROM ll")
def d13_total_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return rounded(spark.createDataFrame([(o.count(), watson(o).loglik(o))], "n long, loglik double"), 4)


# one pass of expectation-maximisation from given parameters

_POST = lambda lp, src: f"lp AS MATERIALIZED (SELECT obs_id, k, {lp} AS lp FROM {src}), mx AS (SELECT obs_id, max(lp) AS m FROM lp GROUP BY obs_id), pw AS (SELECT obs_id, k, exp(lp - m) / sum(exp(lp - m)) OVER (PARTITION BY obs_id) AS p FROM lp JOIN mx USING (obs_id))"
_MOMENT = "cell AS (SELECT k, i, j, sum(w * a * b) AS v FROM (SELECT k, w, i, a, unnest(range(64)) AS j, unnest(x) AS b FROM (SELECT k, w, x, unnest(range(64)) AS i, unnest(x) AS a FROM wx)) GROUP BY k, i, j)"


def _one_pass(df: DataFrame, family: Family, theta: dict) -> tuple[np.ndarray, np.ndarray]:
    got = mixture.em_pass(df, family, theta)
    return got["weight"] / got["weight"].sum(), family.finish(got["moment"], got["weight"], theta)["Psi"]


def _cells(spark: SparkSession, psi: np.ndarray) -> DataFrame:
    return rounded(spark.createDataFrame([(k, i, j, float(m[i, j])) for k, m in enumerate(psi) for i in range(len(m)) for j in range(len(m))], "k int, i int, j int, value double"))


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    o = fx.observations(spark, sf_dir)
    return o, _spikes(first_of_each(o)[:3], False)


_POST3 = _CENTRES + ", " + _POST(_ACG, "sim WHERE k < 3")


@query(f"WITH {_POST3} SELECT k::INT AS k, {R('avg(p)')} AS pi FROM pw GROUP BY k")
def m1_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pi, _ = _one_pass(*(lambda o, t: (o, Family("ACG", (64,)), t))(*_three(spark, sf_dir)))
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(pi)], "k int, pi double"))


@query(f"""WITH {_POST3}, wx AS (SELECT pw.k, p / (1 - (pw.k + 1.0::DOUBLE) / (pw.k + 2.0::DOUBLE) * s) AS w, x FROM pw JOIN sim ON sim.obs_id = pw.obs_id AND sim.k = pw.k JOIN obs ON obs.obs_id = pw.obs_id), {_MOMENT},
t AS (SELECT k, sum(v) AS t FROM cell WHERE i = j GROUP BY k) SELECT cell.k::INT AS k, i, j, {R("v * 64 / t")} AS value FROM cell JOIN t ON t.k = cell.k""")
def m5_acg_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, theta = _three(spark, sf_dir)
    return _cells(spark, _one_pass(o, Family("ACG", (64,)), theta)[1])


_FPOST = lambda scaled, lp: f"{_ON_AXIS(scaled)}, {_POST(lp, 'w WHERE k < 3')}, pk AS (SELECT k, sum(p) AS t FROM pw GROUP BY k), j AS (SELECT pw.k, p, t, u1, u2, a, b FROM pw JOIN w ON w.obs_id = pw.obs_id AND w.k = pw.k JOIN pk ON pk.k = pw.k)"


@query(f"""WITH {_FPOST(False, _MACG)}, inv AS (SELECT *, {_b} / (1 + {_b}) / (1 - {_b} / (1 + {_b}) * (a * a + b * b)) AS g FROM j),
wx AS (SELECT k, p AS w, u1 AS x FROM inv UNION ALL SELECT k, p, u2 FROM inv UNION ALL SELECT k, p * g, list_transform(list_zip(u1, u2), lambda z: z[1] * a + z[2] * b) FROM inv), {_MOMENT},
t AS (SELECT k, sum(v) AS t FROM cell WHERE i = j GROUP BY k) SELECT cell.k::INT AS k, i, j, {R("v * 64 / t")} AS value FROM cell JOIN t ON t.k = cell.k""")
def m7_macg_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return _cells(spark, _one_pass(f, Family("MACG", (64, 2)), _spikes(_axes(f)[:3], False))[1])


@query(f"WITH {_FPOST(True, _WISHART(1.0, '0'))}, wx AS (SELECT k, p / t / 2 AS w, u1 AS x FROM j UNION ALL SELECT k, p / t / 2, u2 FROM j), {_MOMENT} SELECT k::INT AS k, i, j, {R('v')} AS value FROM cell")
def m9_wishart_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir, scaled=True)
    return _cells(spark, _one_pass(f, Family("SingularWishart", (64, 2)), _spikes(_axes(f)[:3], False))[1])


@query(f"""WITH {_CENTRES}, {_POST(f"-0.5::DOUBLE * ln(1 + {_b}) + {_b} / (1 + {_b}) * s / 2", "sim WHERE k < 3")}, pk AS (SELECT k, sum(p) AS t FROM pw GROUP BY k),
wx AS (SELECT pw.k, p / t AS w, x FROM pw JOIN pk ON pk.k = pw.k JOIN obs USING (obs_id)), {_MOMENT} SELECT k::INT AS k, i, j, {R('v')} AS value FROM cell""")
def m11_normal_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, theta = _three(spark, sf_dir)
    return _cells(spark, _one_pass(o, Family("Normal", (64,)), theta)[1])


@query(f"""WITH {_POST3}, d AS (SELECT pw.k, p / (1 - {_b.replace("k", "pw.k")} / (1 + {_b.replace("k", "pw.k")}) * s) * list_dot_product(x, c) AS w, p, x FROM pw JOIN sim ON sim.obs_id = pw.obs_id AND sim.k = pw.k JOIN obs ON obs.obs_id = pw.obs_id JOIN cen ON cen.k = pw.k),
v AS (SELECT k, i, sum(w * y) * sqrt({_b}) / (1 + {_b}) AS v, sum(p) AS weight FROM (SELECT k, w, p, unnest(range(64)) AS i, unnest(x) AS y FROM d) GROUP BY k, i), c AS (SELECT k, unnest(range(64)) AS i, unnest(c) AS c FROM cen WHERE k < 3),
along AS (SELECT k, sum(v * c) AS a FROM v JOIN c USING (k, i) GROUP BY k),
g AS (SELECT k, i, sqrt({_b}) * c AS m, 2 * (-0.5 * weight * sqrt({_b}) * c / (1 + {_b}) + 32 * (v - c * {_b} * a / (1 + {_b}))) AS g FROM v JOIN c USING (k, i) JOIN along USING (k)),
f AS (SELECT k, -1 AS i, ln(1 / 3.0::DOUBLE) AS m, weight - sum(weight) OVER () / 3 AS g FROM (SELECT k, any_value(weight) AS weight FROM v GROUP BY k)), every AS (FROM g UNION ALL FROM f)
SELECT k::INT AS k, i::INT AS i, {R("g")} AS gradient, {R("m + 0.1 * g / (abs(g) + 1e-8)")} AS moved FROM every""")
def l2_gradient_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradients of three low-rank components and (i = -1) of the logarithms of pi, and the first step at rate 0.1."""
    o = fx.observations(spark, sf_dir)
    family, theta = Family("ACG", (64,), rank=1), _spikes(first_of_each(o)[:3], True)
    got, free = mixture.em_pass(o, family, theta), gradient.to_free(family, theta)
    up = gradient.emission(family, free, theta, got["weight"], got["moment"]) | {"pi": got["weight"] - got["weight"].sum() * theta["pi"]}
    moved = gradient.Adam(0.1).step(free, up)
    rows = [(k, i, float(up["M"][k, i, 0]), float(moved["M"][k, i, 0])) for k in range(3) for i in range(64)]
    rows += [(k, -1, float(up["pi"][k]), float(moved["pi"][k])) for k in range(3)]
    return rounded(spark.createDataFrame(rows, "k int, i int, gradient double, moved double"))


@query()
def l2_gradient_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture trained by gradient steps with a cut of the rate, two restarts in the same passes."""
    o = fx.observations(spark, sf_dir)
    m = engine.train(o, 2, "ACG", rank=2, LR=0.1, decrease_lr_on_plateau=True, num_repl=2, tol=1e-5)
    return rounded(m.score(o).select("obs_id", "truth", "loglik", vec.argmax(F.col("post")).alias("part")), 4)


def _fitted(df: DataFrame, family: Family, k: int = 3, init: str = "uniform") -> DataFrame:
    m = mixture.fit(df, family, k, init)
    return rounded(m.score(df).select("obs_id", "truth", "loglik", vec.argmax(F.col("post")).alias("part")), 4)


def _fit_query(name: str, make, init: str = "uniform"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, family = make(spark, sf_dir)
        return _fitted(df, family, init=init)

    run.__name__ = name
    QUERIES[name] = run


_real = fx.observations
_complex = fx.complex_observations
_fit_query("m2_watson_fit", lambda s, d: (_real(s, d), Family("Watson", (64,))), "dc++")
_fit_query("m2_complex_watson_fit", lambda s, d: (_complex(s, d), Family("Watson", (32,), True)), "dc")
_fit_query("m4_acg_lowrank_fit", lambda s, d: (_real(s, d), Family("ACG", (64,), rank=5)), "dc++_seg")
_fit_query("m5_acg_fit", lambda s, d: (_real(s, d), Family("ACG", (64,))))
_fit_query("m4_complex_acg_fit", lambda s, d: (_complex(s, d), Family("ACG", (32,), True, rank=4)))
_fit_query("m6_macg_lowrank_fit", lambda s, d: (frames(s, d), Family("MACG", (64, 2), rank=4)), "gc++")
_fit_query("m7_macg_fit", lambda s, d: (frames(s, d), Family("MACG", (64, 2))))
_fit_query("m8_wishart_lowrank_fit", lambda s, d: (frames(s, d, True), Family("SingularWishart", (64, 2), rank=4)), "wgc++")
_fit_query("m9_wishart_fit", lambda s, d: (frames(s, d, True), Family("SingularWishart", (64, 2))))
_fit_query("m10_normal_lowrank_fit", lambda s, d: (_real(s, d), Family("Normal", (64,), rank=5, tied_gamma=True)), "ls")
_fit_query("m11_complex_normal_fit", lambda s, d: (_complex(s, d), Family("Normal", (32,), True)))


@query()
def i8_rank_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank-2 fit, widened to rank 4 and fitted on."""
    o = fx.observations(spark, sf_dir)
    small = mixture.fit(o, Family("ACG", (64,), rank=2), 2, "uniform")
    wide = mixture.fit(o, Family("ACG", (64,), rank=4), 2, small.theta)
    return rounded(wide.score(o).select("obs_id", "loglik"), 4)


# -- hidden Markov models -------------------------------------------------------------------------

_T, _DELTA = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.6, 0.4])
_lse = lambda a, b: f"(greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))))"


@query(f"""WITH {fx.SEQUENCES}, n AS (SELECT seq_id, p, lead(p) OVER (PARTITION BY seq_id ORDER BY t) AS q, count(*) OVER (PARTITION BY seq_id) AS n FROM seq),
s AS (SELECT sum(p * q / n) AS a, sum(p * (1 - q) / n) AS b, sum((1 - p) * q / n) AS c, sum((1 - p) * (1 - q) / n) AS d FROM n)
SELECT 0 AS i, 0 AS j, {R("a / (a + b)")} AS value FROM s UNION ALL SELECT 0, 1, {R("b / (a + b)")} FROM s UNION ALL SELECT 1, 0, {R("c / (c + d)")} FROM s UNION ALL SELECT 1, 1, {R("d / (c + d)")} FROM s""")
def h2_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = hmm.transitions(fx.sequences(spark, sf_dir), 2)
    return rounded(spark.createDataFrame([(i, j, float(t[i, j])) for i in range(2) for j in range(2)], "i int, j int, value double"))


@query(f"""WITH RECURSIVE {fx.SEQUENCES}, o AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY t) AS n FROM seq),
f AS (SELECT seq_id, n, ln(0.6::DOUBLE) + a AS x, ln(0.4::DOUBLE) + b AS y FROM o WHERE n = 1
 UNION ALL SELECT o.seq_id, o.n, o.a + {_lse("f.x + ln(0.9::DOUBLE)", "f.y + ln(0.2::DOUBLE)")}, o.b + {_lse("f.x + ln(0.1::DOUBLE)", "f.y + ln(0.8::DOUBLE)")} FROM f JOIN o ON o.seq_id = f.seq_id AND o.n = f.n + 1)
SELECT seq_id, max(n) AS n, {R(f"arg_max({_lse('x', 'y')}, n)")} AS loglik FROM f GROUP BY seq_id""")
def h3_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hmm.likelihoods(fx.sequences(spark, sf_dir), _DELTA, _T))


_ONE = fx.SEQUENCES.replace("seq AS (", "each_ AS (") + ", seq AS (SELECT 0::BIGINT AS seq_id, t, p, a, b FROM each_)"


def one_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sequences(spark, sf_dir).withColumn("seq_id", F.lit(0).cast("long"))


@query(ORACLE_SQL["h3_forward"].replace(fx.SEQUENCES, _ONE))
def h3_one_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as one sequence, in pieces of 1,000."""
    return rounded(hmm.likelihoods(one_sequence(spark, sf_dir), _DELTA, _T, rows=1_000))


def _viterbi(last: str) -> str:
    """path (seq_id, n, t, state): scores forwards with the better state before each, then back from the end."""
    go = lambda a, b: f"CASE WHEN f.x + ln({a}::DOUBLE) >= f.y + ln({b}::DOUBLE) THEN"
    return f"""WITH RECURSIVE {fx.SEQUENCES}, o AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY t) AS n FROM seq),
f AS (SELECT seq_id, n, ln(0.6::DOUBLE) + a AS x, ln(0.4::DOUBLE) + b AS y, 0 AS px, 0 AS py FROM o WHERE n = 1
 UNION ALL SELECT o.seq_id, o.n, o.a + greatest(f.x + ln(0.9::DOUBLE), f.y + ln(0.2::DOUBLE)), o.b + greatest(f.x + ln(0.1::DOUBLE), f.y + ln(0.8::DOUBLE)), {go(0.9, 0.2)} 0 ELSE 1 END, {go(0.1, 0.8)} 0 ELSE 1 END FROM f JOIN o ON o.seq_id = f.seq_id AND o.n = f.n + 1),
ends AS (SELECT seq_id, max(n) AS n FROM f GROUP BY seq_id),
path AS (SELECT f.seq_id, f.n, CASE WHEN f.x >= f.y THEN 0 ELSE 1 END AS state FROM f JOIN ends ON ends.seq_id = f.seq_id AND ends.n = f.n
 UNION ALL SELECT f.seq_id, f.n - 1, CASE WHEN path.state = 0 THEN f.px ELSE f.py END FROM path JOIN f ON f.seq_id = path.seq_id AND f.n = path.n WHERE f.n > 1)
{last} FROM path JOIN o ON o.seq_id = path.seq_id AND o.n = path.n"""


@query(_viterbi("SELECT o.seq_id, o.t, state::INT AS state"))
def h6_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.viterbi(fx.sequences(spark, sf_dir), _DELTA, _T)


@query(ORACLE_SQL["h6_viterbi"].replace(fx.SEQUENCES, _ONE))
def h6_one_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.viterbi(one_sequence(spark, sf_dir), _DELTA, _T, rows=1_000)


@query(f"SELECT seq_id, t, i, CASE WHEN state = i THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM (SELECT *, unnest([0, 1]) AS i FROM ({_viterbi('SELECT o.seq_id, o.t, state')}))")
def h7_path_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = hmm.viterbi(fx.sequences(spark, sf_dir), _DELTA, _T)
    return path.select("seq_id", "t", F.posexplode(vec.one_hot(F.col("state"), 2)).alias("i", "value"))


@query()
def h8_hmm_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal states on embeddings in sequences of 50: likelihood by sequence."""
    o = fx.observations(spark, sf_dir).select(F.floor(F.col("obs_id") / 50).alias("seq_id"), F.col("obs_id").alias("t"), "obs_id", "x")
    start = mixture.fit(o, Family("Normal", (64,), rank=2), 2)
    return rounded(hmm.fit(o, start, 2).score(o), 4)


# -- evaluation -----------------------------------------------------------------------------------


def _mi(cells: str, a: str, b: str) -> str:
    return f"(SELECT sum(w / t * ln(w / t / (wa / t * (wb / t)))) FROM (SELECT w, sum(w) OVER () AS t, sum(w) OVER (PARTITION BY {a}) AS wa, sum(w) OVER (PARTITION BY {b}) AS wb FROM ({cells})) WHERE w > 0)"


_hard = lambda a, b: _mi(f"SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS w FROM part GROUP BY ALL", "a", "b")
_soft = lambda a, b: _mi(f"SELECT i, j, sum(p * q) AS w FROM (SELECT i, p, unnest([0, 1, 2, 3]) AS j, unnest(q) AS q FROM (SELECT unnest([0, 1, 2, 3]) AS i, unnest({a}) AS p, {b} AS q FROM post)) GROUP BY ALL", "i", "j")


@query(f"WITH {fx.POSTERIORS} SELECT {R(_hard('part', 'part2'))} AS mi, {R('2 * ' + _hard('part', 'part2') + ' / (' + _hard('part', 'part') + ' + ' + _hard('part2', 'part2') + ')')} AS nmi")
def e1_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.nmi(fx.parts(spark, sf_dir), "part", "part2"))


@query(f"WITH {fx.POSTERIORS} SELECT {R(_soft('post', 'other'))} AS mi, {R('2 * ' + _soft('post', 'other') + ' / (' + _soft('post', 'post') + ' + ' + _soft('other', 'other') + ')')} AS nmi")
def e2_soft_nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.nmi_soft(fx.posteriors(spark, sf_dir), "post", "other"))


@query("SELECT event_id, floor((event_id % 1200) / 240.0)::INT AS k FROM events")
def e3_window_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", evaluate.window_truth(F.col("event_id") % 1200, 5).alias("k"))


@query(f"""WITH {fx.POSTERIORS}, k AS (SELECT subject, k, sum(-p * ln(p + 1e-10)) AS h, avg(p) AS m FROM long GROUP BY ALL) SELECT subject, {R("sum(h)")} AS entropy, {R("sum(-m * ln(m + 1e-10))")} AS entropy_pi FROM k GROUP BY subject""")
def e4_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.entropies(fx.posteriors(spark, sf_dir), ["subject"]))


@query(f"WITH {_WATSON} SELECT obs_id % 7 AS subject, {R('avg(loglik)')} AS loglik FROM ll GROUP BY 1")
def e5_mean_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir)
    return rounded(evaluate.mean_loglik(watson(o).score(o).withColumn("subject", F.col("obs_id") % 7), ["subject"]))


_PERM = "SELECT a, b, c, d FROM (SELECT unnest(range(4)) AS a), (SELECT unnest(range(4)) AS b), (SELECT unnest(range(4)) AS c), (SELECT unnest(range(4)) AS d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d"
_BEST = f"tab AS (SELECT t, k, coalesce(m, 0) AS m FROM (SELECT unnest(range(4)) AS t), (SELECT unnest(range(4)) AS k) LEFT JOIN raw ON raw.truth = t AND raw.part = k), won AS (SELECT a, b, c, d FROM (SELECT * FROM ({_PERM})) AS p JOIN tab x ON x.t = 0 AND x.k = a JOIN tab y ON y.t = 1 AND y.k = b JOIN tab z ON z.t = 2 AND z.k = c JOIN tab w ON w.t = 3 AND w.k = d ORDER BY x.m + y.m + z.m + w.m DESC LIMIT 1), map AS (SELECT unnest([0, 1, 2, 3]) AS truth, unnest([a, b, c, d]) AS component FROM won)"


@query(f"WITH {fx.POSTERIORS}, raw AS (SELECT truth, k AS part, avg(m) AS m FROM (SELECT subject, truth, k, avg(p) AS m FROM long GROUP BY ALL) GROUP BY ALL), {_BEST} SELECT truth::INT AS truth, component::INT AS component FROM map")
def e6_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = evaluate.match(fx.posteriors(spark, sf_dir), 4)
    return spark.createDataFrame([(c, int(j)) for c, j in enumerate(order)], "truth int, component int")


@query(f"WITH {fx.POSTERIORS} SELECT subject, {R('avg(CASE WHEN part = truth THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM part GROUP BY subject")
def e7_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.accuracy(fx.parts(spark, sf_dir), ["subject"]))


_LARGEST = lambda where: f"SELECT truth, position, arg_max(k, [p, -k]) AS part FROM (SELECT truth, position, k, avg(p) AS p FROM long WHERE {where} GROUP BY ALL) GROUP BY ALL"


@query(f"""WITH {fx.POSTERIORS}, cnt AS (SELECT truth, part, count(*) AS n FROM ({_LARGEST("subject < 4")}) GROUP BY ALL), raw AS (SELECT truth, part, n / sum(n) OVER (PARTITION BY truth) AS m FROM cnt), {_BEST}
SELECT 'accuracy' AS name, {R("avg(CASE WHEN map.truth = part.truth THEN 1.0 ELSE 0.0 END)")} AS value FROM part JOIN map ON map.component = part.part WHERE subject >= 4
UNION ALL SELECT 'ensemble_accuracy', {R("avg(CASE WHEN map.truth = e.truth THEN 1.0 ELSE 0.0 END)")} FROM ({_LARGEST("subject >= 4")}) e JOIN map ON map.component = e.part""")
def e8_posterior_to_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.posteriors(spark, sf_dir)
    got = evaluate.posterior_to_accuracy(p.where("subject < 4"), p.where("subject >= 4"), 4, ["position"])
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in got.items()], "name string, value double"))


@query(f"WITH {fx.POSTERIORS}, c AS (SELECT truth, part, count(*) AS n FROM part GROUP BY ALL) SELECT truth, part, n, {R('n / sum(n) OVER (PARTITION BY truth)')} AS share FROM c")
def e9_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.confusion(fx.parts(spark, sf_dir)))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.parts(spark, sf_dir)
    one = lambda k, c: p.select(F.lit(k).alias("inner"), "obs_id", c.alias("part"))
    return one(0, F.col("part")).union(one(1, F.col("part2"))).union(one(2, F.col("truth")))


_pair = lambda a, b, i, j: f"SELECT {i} AS inner1, {j} AS inner2, {R('2 * ' + _hard(a, b) + ' / (' + _hard(a, a) + ' + ' + _hard(b, b) + ')')} AS nmi"


@query(f"WITH {fx.POSTERIORS} {_pair('part', 'part2', 0, 1)} UNION ALL {_pair('part', 'truth', 0, 2)} UNION ALL {_pair('part2', 'truth', 1, 2)}")
def e10_reproducibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.reproducibility(_runs(spark, sf_dir)))


@query(f"WITH {fx.POSTERIORS} SELECT truth, position, k, {R('avg(p)')} AS p FROM long GROUP BY ALL")
def e11_average_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.average_posterior(fx.posteriors(spark, sf_dir), ["truth", "position"]))


@query(f"WITH {_CENTRES} SELECT k, i, j, {R('a * b * sqrt(5.0::DOUBLE + k)')} AS re, 0.0::DOUBLE AS im FROM (SELECT k, i, a, unnest(range(64)) AS j, unnest(c) AS b FROM (SELECT k, c, unnest(range(64)) AS i, unnest(c) AS a FROM cen))")
def e12_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.covariances(spark, watson(fx.observations(spark, sf_dir)).theta))


# -- tests ----------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT l_quantity::DOUBLE - 25 AS x, l_discount::DOUBLE * 500 - l_tax::DOUBLE * 600 AS y FROM lineitem), s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM d),
t AS (SELECT n, n * (b * mx * mx - 2 * c * mx * my + a * my * my) / (a * b - c * c) AS t2 FROM s), f AS (SELECT n, t2, (n - 2) / (2 * (n - 1)) * t2 AS f FROM t)
SELECT n, {R("t2", 3)} AS t2, {R("f", 3)} AS f, {R("pow(1 + 2 * f / (n - 2), -(n - 2) / 2)", 3)} AS p FROM f""")
def t1_hotelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda name: F.col(name).cast("double")
    return rounded(stats.hotelling(fx.table(spark, sf_dir, "lineitem"), c("l_quantity") - 25, c("l_discount") * 500 - c("l_tax") * 600), 3)


def _one_row(spark: SparkSession, got: dict) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in got.values())], ", ".join(f"{k} double" for k in got))


# both tails of a normal distribution, by the series of the error function whose terms are all positive; of
# a t distribution with many degrees beyond 8, where nothing is left of six digits
_ERF = lambda x: f"2 / sqrt(pi()) * exp(-pow({x}, 2)) * list_sum(list_transform(range(400), lambda i: exp((2 * i + 1) * ln({x}) + 2 * i * ln(2.0::DOUBLE) + lgamma(i + 1) - lgamma(2 * i + 2))))"
_TAIL = "CASE WHEN abs(t) > 8 AND n > 100 THEN 0.0::DOUBLE END"


@query(f"""WITH {fx.RESULTS}, d AS (SELECT count(*)::DOUBLE AS n, avg(d) AS m, stddev_samp(d) AS s FROM (SELECT nmi - "K" / 70.0::DOUBLE AS d FROM res)), t AS (SELECT n, m / (s / sqrt(n)) AS t FROM d) SELECT n, {R("t")} AS t, {_TAIL} AS p FROM t""")
def t3_paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_one_row(spark, stats.paired_t(fx.results(spark, sf_dir).withColumn("other", F.col("K") / 70), "nmi", "other", 3)))


@query("""WITH d AS (SELECT l_quantity::DOUBLE - l_discount::DOUBLE * 500 AS d FROM lineitem), n AS (SELECT d, (rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0)::DOUBLE AS r FROM d WHERE d <> 0)
SELECT count(*)::BIGINT AS n, coalesce(sum(r) FILTER (d > 0), 0) AS plus, coalesce(sum(r) FILTER (d < 0), 0) AS minus FROM n""")
def t4_signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem")
    ranked = stats.ranked_differences(li, F.col("l_quantity").cast("double") - F.col("l_discount").cast("double") * 500)
    side = lambda c: F.sum(F.when(c, F.col("r")).otherwise(0.0))
    return ranked.agg(F.count("*").alias("n"), side(F.col("d") > 0).alias("plus"), side(F.col("d") < 0).alias("minus"))


@query(f"""WITH d AS (SELECT l_quantity::DOUBLE - l_discount::DOUBLE * 500 AS d FROM lineitem), c AS (SELECT d, count(*) OVER (PARTITION BY abs(d)) AS c, rank() OVER (ORDER BY abs(d)) AS r FROM d WHERE d <> 0),
s AS (SELECT count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r + (c - 1) / 2.0::DOUBLE ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN r + (c - 1) / 2.0::DOUBLE ELSE 0 END) AS minus, sum(c::DOUBLE * c - 1) AS ties FROM c),
z AS (SELECT *, (least(plus, minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s) SELECT n, plus, minus, {R("z")} AS z, {R(f"CASE WHEN abs(z) > 8 THEN 0 ELSE 1 - {_ERF('(abs(z) / sqrt(2.0::DOUBLE))')} END")} AS p FROM z""")
def t4_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = fx.table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_discount").cast("double") * 500).alias("b"))
    return rounded(_one_row(spark, stats.wilcoxon(li, "a", "b")))


_TWELVE = fx.OBSERVATIONS + """, pair AS (SELECT obs_id % 12 AS g, avg(x[1]) AS a, avg(x[2] + 0.02::DOUBLE) AS b FROM obs GROUP BY ALL), dif AS (SELECT a - b AS d FROM pair)"""


def _twelve(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return fx.observations(spark, sf_dir).groupBy((F.col("obs_id") % 12).alias("g")).agg(F.avg(x[0]).alias("a"), F.avg(x[1] + 0.02).alias("b"))


# every choice of signs of twelve ranks
@query(f"""WITH {_TWELVE}, r AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS r FROM dif), s AS (SELECT count(*) AS n, sum(r) FILTER (d > 0) AS plus, sum(r) FILTER (d < 0) AS minus FROM r),
signs AS (SELECT (SELECT sum(r * ((c >> (r - 1)) & 1)) FROM r) AS w FROM range(4096) AS x(c))
SELECT n::DOUBLE AS n, coalesce(plus, 0)::DOUBLE AS plus, coalesce(minus, 0)::DOUBLE AS minus, {R("(least(coalesce(plus, 0), coalesce(minus, 0)) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE)")} AS z,
{R("least(1, 2 * (SELECT count(*) FROM signs WHERE w <= least(coalesce(plus, 0), coalesce(minus, 0))) / 4096.0::DOUBLE)")} AS p FROM s""")
def t4_exact_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of copied rows are equal up to the order of their sums: whether they tie must not decide the distribution."""
    return rounded(_one_row(spark, stats.wilcoxon(_twelve(spark, sf_dir), "a", "b", method="exact")))


# both tails of a t distribution with eleven degrees, a finite sum in the cosine of an angle
@query(f"""WITH {_TWELVE}, t AS (SELECT count(*)::DOUBLE AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM dif), h AS (SELECT *, atan(abs(t) / sqrt(11.0::DOUBLE)) AS h FROM t)
SELECT n, {R("t")} AS t, {R("least(1, 3 * (1 - 2 / pi() * (h + sin(h) * (cos(h) + 2 / 3.0::DOUBLE * pow(cos(h), 3) + 8 / 15.0::DOUBLE * pow(cos(h), 5) + 16 / 35.0::DOUBLE * pow(cos(h), 7) + 128 / 315.0::DOUBLE * pow(cos(h), 9)))))")} AS p FROM h""")
def t3_few_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_one_row(spark, stats.paired_t(_twelve(spark, sf_dir), "a", "b", 3)))


@query()
def t5_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.permutation_blocks(spark, signal.mean_coherence(fx.observations(spark, sf_dir)), np.arange(64) % 4))


# -- supervised models and sweeps -----------------------------------------------------------------


def _held_out(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Four fifths of the rows are learnt from, with the choice of parameters over their folds; all are predicted."""
    o = fx.observations(spark, sf_dir)
    held = F.col("obs_id") % 5 == 0
    return supervised.fit_predict(o.where(~held), kind, o).withColumn("held_out", held)


@query()
def c1_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out(spark, sf_dir, "logistic")


@query()
def c2_linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out(spark, sf_dir, "linear-svm")


@query()
def c3_rbf_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_out(spark, sf_dir, "rbf-svm")


_MEANS = fx.RESULTS + ', m AS (SELECT modelname, "K", rank, "inner", avg(loglik) AS loglik, avg(nmi) AS nmi FROM res GROUP BY ALL)'


@query(f'WITH {_MEANS} SELECT modelname, "K", rank, arg_max("inner", loglik) AS "inner" FROM m GROUP BY modelname, "K", rank')
def c10_best_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.best_inner(fx.results(spark, sf_dir), ["modelname", "K", "rank"], "loglik")


@query(f"""WITH {_MEANS}, b AS (SELECT modelname, "K", rank, row_number() OVER (PARTITION BY modelname, "K" ORDER BY round(avg(nmi), 9) DESC, rank) AS n FROM res GROUP BY modelname, "K", rank),
i AS (SELECT m.*, row_number() OVER (PARTITION BY modelname, "K" ORDER BY round(nmi, 9) DESC, "inner") AS n FROM m JOIN (SELECT modelname, "K", rank FROM b WHERE n = 1) USING (modelname, "K", rank)) SELECT modelname, "K", rank, "inner" FROM i WHERE n = 1""")
def c11_best_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.best_rank(fx.results(spark, sf_dir), ["modelname", "K"], "nmi")


@query(f'WITH {fx.RESULTS}, m AS (SELECT modelname, "K", avg(loglik) AS loglik FROM res GROUP BY ALL) SELECT modelname, arg_max("K", loglik) AS "K", {R("max(loglik)", 4)} AS loglik FROM m GROUP BY modelname')
def c13_best_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sweep.best_order(fx.results(spark, sf_dir), "modelname", "K", "loglik"), 4)


@query(f'WITH {fx.RESULTS} SELECT "K", max(loglik) AS loglik, max(nmi) AS nmi FROM res GROUP BY "K"')
def c14_group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.results(spark, sf_dir).groupBy("K").agg(F.max("loglik").alias("loglik"), F.max("nmi").alias("nmi"))


@query(f'WITH {fx.RESULTS} SELECT modelname, rank, {R("avg(nmi)")} AS mean, {R("stddev_samp(nmi) / sqrt(count(nmi))", 9)} AS se FROM res GROUP BY modelname, rank')
def c15_mean_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sweep.mean_and_error(fx.results(spark, sf_dir), ["modelname", "rank"], "nmi")
    return got.select("modelname", "rank", (F.round("mean", 6) + 0.0).alias("mean"), (F.round("se", 9) + 0.0).alias("se"))


@query()
def c5_rank_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir).withColumn("subject", F.col("obs_id") % 7)
    return sweep.rank_sweep({"train": o}, "ACG", (2, 3), (1, 5, 10, 25, 50), inner=10, tol=1e-7, num_comparison=10)


@query("""SELECT vec_id AS obs_id, (vec_id // 50) * 3 + CASE WHEN vec_id % 50 < 10 THEN 0 WHEN vec_id % 50 < 30 THEN 1 ELSE 2 END AS seq_id, vec_id % 50 - CASE WHEN vec_id % 50 < 10 THEN 0 WHEN vec_id % 50 < 30 THEN 10 ELSE 30 END AS t FROM embeddings""")
def h1_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.sequenced(fx.observations(spark, sf_dir).select("obs_id"), [10, 20, 20])


@query(f"""WITH {fx.RESULTS} SELECT CASE modelname WHEN 'A' THEN 'first' WHEN 'N' THEN 'second' ELSE modelname END AS modelname, count(*) AS n FROM res GROUP BY 1 UNION ALL SELECT 'other', count(*) FROM (SELECT DISTINCT "K" FROM res)""")
def c12_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    res = fx.results(spark, sf_dir)
    named = sweep.labelled(res, "modelname", {"A": "first", "N": "second"}).groupBy("modelname").agg(F.count("*").alias("n"))
    other = res.select("K").distinct().agg(F.count("*").alias("n")).withColumn("modelname", F.lit("other"))
    return sweep.collected([named, other]).select("modelname", "n")


_GRID = "g AS (SELECT id // 40 AS i, id % 40 AS j, (id // 40 + 0.5::DOUBLE) / 40 * pi() AS f, (id % 40 + 0.5::DOUBLE) / 40 * 2 * pi() AS h FROM range(1600) AS x(id))"
_MU = "mu AS (SELECT truth % 2 AS k, arg_min(x[1:3], obs_id) AS m, count(*) / (SELECT count(*) FROM obs)::DOUBLE AS pi FROM obs GROUP BY ALL)"


@query(f"""WITH {fx.OBSERVATIONS}, {_MU}, {_GRID}, on_ AS (SELECT i, j, k, pi, pow(m[1] * sin(f) * cos(h) + m[2] * sin(f) * sin(h) + m[3] * cos(f), 2) / list_dot_product(m, m) AS s FROM g, mu),
lp AS (SELECT i, j, k, ln(pi) + {_sphere(3)} + CASE WHEN k = 0 THEN 4 * s - {_kummer(0.5, 1.5, "4.0::DOUBLE")} ELSE -2 * s + 2 - {_kummer(1.0, 1.5, "2.0::DOUBLE")} END AS lp FROM on_),
s AS (SELECT *, (lp - min(lp) OVER (PARTITION BY k)) / (max(lp) OVER (PARTITION BY k) - min(lp) OVER (PARTITION BY k)) AS d FROM lp) SELECT i, j, k::INT AS k, {R("d")} AS density, d > 0.95 AS inside FROM s""")
def c17_density_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two components along the first three places of the first row of two classes, weighted by the classes' sizes."""
    o = fx.observations(spark, sf_dir)
    rows = o.groupBy((F.col("truth") % 2).alias("k")).agg(F.min_by(F.slice("x", 1, 3), "obs_id").alias("m"), F.count("*").alias("n")).orderBy("k").collect()
    mu, n = np.array([r["m"] for r in rows]), np.array([r["n"] for r in rows])
    m = mixture.Mixture(Family("Watson", (3,)), {"pi": n / n.sum(), "mu": mu / np.linalg.norm(mu, axis=1, keepdims=True), "kappa": np.array([4.0, -2.0])})
    return rounded(sweep.grid_density(m, sweep.sphere_grid(spark, 40)))


_POSTBY = fx.POSTERIORS + """, mixed AS (SELECT subject, truth AS x, k AS y, sum(p) AS n FROM long GROUP BY ALL), soft AS (SELECT a.subject, a.k AS x, b.k AS y, sum(a.p * b.p) AS n FROM long a JOIN long b USING (obs_id) GROUP BY ALL), hard AS (SELECT subject, truth AS x, truth AS y, count(*)::DOUBLE AS n FROM post GROUP BY ALL)"""
_INFO = lambda cells: f"SELECT subject, sum(s * ln(s / (a * b))) AS v FROM (SELECT subject, n / sum(n) OVER (PARTITION BY subject) AS s, sum(n) OVER (PARTITION BY subject, x) / sum(n) OVER (PARTITION BY subject) AS a, sum(n) OVER (PARTITION BY subject, y) / sum(n) OVER (PARTITION BY subject) AS b FROM {cells} WHERE n > 0) GROUP BY subject"


@query(f"WITH {_POSTBY} SELECT m.subject, {R('m.v')} AS mi, {R('2 * m.v / (p.v + t.v)')} AS nmi FROM ({_INFO('mixed')}) m JOIN ({_INFO('soft')}) p USING (subject) JOIN ({_INFO('hard')}) t USING (subject)")
def e2_nmi_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.nmi_by(fx.posteriors(spark, sf_dir), ["subject"], "truth", "post"))


@query()
def e13_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model fitted on half of the rows and scored on both halves, by subject."""
    o = fx.observations(spark, sf_dir).withColumn("truth", F.col("truth") % 4).withColumn("subject", F.col("obs_id") % 7)
    halves = {name: o.where(F.col("obs_id") % 2 == k) for k, name in enumerate(("train", "test1"))}
    return rounded(sweep.run(halves, "ACG", 4, rank=2)[1], 4)


@query()
def c7_phase_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase-controlled scans made from the embeddings, a model fitted on the first by EM and by gradient steps, 60
    passes at most, from random starts."""
    o = fx.observations(spark, sf_dir).withColumn("scan", F.col("obs_id") % 3).withColumn("t", F.floor(F.col("obs_id") / 3))
    n = o.groupBy("scan").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    long = o.select("scan", "t", F.posexplode("x").alias("channel", "value"))
    made = signal.phase_controlled(long, 5, keys=["scan", "channel"])
    phases = signal.gathered(signal.analytic_phase(made, ["scan", "channel"], 10), ["scan", "t"], "theta", "theta")
    x = signal.features_for(phases, "ACG", ["scan", "t"]).withColumn("obs_id", F.col("scan") * n + F.col("t"))
    x = x.withColumn("truth", F.least(F.floor(F.col("t") * 5 / n), F.lit(4)).cast("int")).select("obs_id", "truth", "x").cache()
    out = phase_runs.sweep(phase_runs.scan_slices(x, n), "ACG", 5, ("random",), (1, 5), (0.0, 0.1), 1, with_hmm=False, tol=1e-4, num_comparison=10, max_iter=60)
    x.unpersist()
    return rounded(out, 4)
