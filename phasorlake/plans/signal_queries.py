"""Queries of signal preparation, feature construction and data-set assembly, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import long_series, signal
from ..sources import files, scratch
from . import fixtures as fx
from .fixtures import rounded, series, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def long(df: DataFrame, keys: list[str], **arrays) -> DataFrame:
    """keys, i and one column for each array column: equal places side by side."""
    z = df.select(*keys, F.posexplode(F.arrays_zip(*(c.alias(n) for n, c in arrays.items()))).alias("i", "_z"))
    return z.select(*keys, "i", *(F.col("_z")[n].alias(n) for n in arrays))


R = fx.r
KEYS = "subject, session, t, channel"


@query(f"""WITH {fx.SERIES}, w AS (SELECT *, avg(value) OVER w AS m, avg(t) OVER w AS mt, covar_pop(value, t) OVER w / var_pop(t) OVER w AS b FROM series WINDOW w AS (PARTITION BY subject, session, channel))
SELECT {KEYS}, {R("value - m - coalesce(b, 0) * (t - mt)")} AS value FROM w""")
def p1_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.detrend(series(spark, sf_dir)))


@query(f"WITH {fx.SERIES} SELECT {KEYS}, {R('value - avg(value) OVER (PARTITION BY subject, session, channel)')} AS value FROM series")
def p2_demean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.demean(series(spark, sf_dir)))


@query(f"""WITH {fx.SERIES}, g AS (SELECT *, avg(value) OVER (PARTITION BY subject, session, t) AS g FROM series)
SELECT {KEYS}, {R("value - g * sum(value * g) OVER w / sum(g * g) OVER w")} AS value FROM g WINDOW w AS (PARTITION BY subject, session, channel)""")
def p3_global_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.regress_global(series(spark, sf_dir)))


@query(f"""WITH {fx.SERIES}, r AS (SELECT *, sin(t / 10.0::DOUBLE) AS a, cos(t / 7.0::DOUBLE) AS b FROM series),
z AS (SELECT {KEYS}, value, (a - avg(a) OVER w) / stddev_samp(a) OVER w AS a, (b - avg(b) OVER w) / stddev_samp(b) OVER w AS b FROM r WINDOW w AS (PARTITION BY subject, session, channel)),
s AS (SELECT *, sum(a * a) OVER w AS aa, sum(b * b) OVER w AS bb, sum(a * b) OVER w AS ab, sum(a * value) OVER w AS ay, sum(b * value) OVER w AS zy FROM z WINDOW w AS (PARTITION BY subject, session, channel))
SELECT {KEYS}, {R("value - a * (ay * bb - zy * ab) / (aa * bb - ab * ab) - b * (zy * aa - ay * ab) / (aa * bb - ab * ab)")} AS value FROM s""")
def p4_nuisance_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    nuisance = s.select("subject", "session", "t").distinct().withColumn("r", F.array(F.sin(F.col("t") / 10), F.cos(F.col("t") / 7)))
    return rounded(signal.regress_nuisance(s, nuisance))


@query(f"WITH {fx.SERIES} SELECT subject, session, t, {R('avg(value)')} AS value FROM series WHERE channel % 3 = 0 GROUP BY ALL")
def p5_mask_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = spark.range(64).where("id % 3 = 0").select(F.col("id").cast("int").alias("channel"))
    return rounded(signal.mask_mean(series(spark, sf_dir), mask))


@query(f"WITH {fx.SERIES} SELECT subject, session, t, channel % 8 AS roi, {R('avg(value)')} AS value FROM series GROUP BY ALL")
def p6_parcellate(spark: SparkSession, sf_dir: str) -> DataFrame:
    atlas = spark.range(64).select(F.col("id").cast("int").alias("channel"), (F.col("id") % 8).alias("roi"))
    return rounded(signal.parcellate(series(spark, sf_dir), atlas))


#: The second-order band-pass by the bilinear map, its numerator being g (1, 0, -2, 0, 1), and one sample after another
#: through it, forwards and backwards. A constant input leaves the state g (-1, -1, 1, 1).
_WARP = lambda f: f"2 / 0.72::DOUBLE * tan(pi() * {f} * 0.72::DOUBLE)"
_PASS = lambda name, source: f"""{name} AS (SELECT id, 0 AS k, -g * e[1] AS z1, -g * e[1] AS z2, g * e[1] AS z3, g * e[1] AS z4, 0.0::DOUBLE AS y FROM {source}, coef
 UNION ALL SELECT s.id, k + 1, z2 - a1 * (g * e[k + 1] + z1), z3 - 2 * g * e[k + 1] - a2 * (g * e[k + 1] + z1), z4 - a3 * (g * e[k + 1] + z1), g * e[k + 1] - a4 * (g * e[k + 1] + z1), g * e[k + 1] + z1 FROM {name} JOIN {source} s USING (id), coef WHERE k < len(e))"""  # noqa: E731
_BANDPASS = f"""WITH RECURSIVE {fx.SERIES}, w AS (SELECT {_WARP("0.07")} - {_WARP("0.03")} AS w, ({_WARP("0.07")}) * ({_WARP("0.03")}) AS q, 2 / 0.72::DOUBLE AS c),
terms AS (SELECT c ** 4 AS t4, sqrt(2) * w * c ** 3 AS t3, (2 * q + w * w) * c * c AS t2, sqrt(2) * w * q * c AS t1, q * q AS t0, w * w * c * c AS top FROM w),
coef AS (SELECT top / (t4 + t3 + t2 + t1 + t0) AS g, (-4 * t4 - 2 * t3 + 2 * t1 + 4 * t0) / (t4 + t3 + t2 + t1 + t0) AS a1, (6 * t4 - 2 * t2 + 6 * t0) / (t4 + t3 + t2 + t1 + t0) AS a2,
 (-4 * t4 + 2 * t3 - 2 * t1 + 4 * t0) / (t4 + t3 + t2 + t1 + t0) AS a3, (t4 - t3 + t2 - t1 + t0) / (t4 + t3 + t2 + t1 + t0) AS a4 FROM terms),
x AS (SELECT subject, session, channel, list(value ORDER BY t) AS x, list(t ORDER BY t) AS ts, count(*) AS n, least(100, count(*) - 1) AS p FROM series GROUP BY ALL),
r AS (SELECT row_number() OVER () AS id, subject, session, channel, ts, n, p, list_transform(range(-p, n + p), lambda j: x[(CASE WHEN j < 0 THEN -j WHEN j > n - 1 THEN 2 * (n - 1) - j ELSE j END) + 1]) AS y FROM x),
e AS (SELECT id, list_concat(list_concat(list_transform(range(15), lambda j: 2 * y[1] - y[16 - j]), y), list_transform(range(15), lambda j: 2 * y[len(y)] - y[len(y) - 1 - j])) AS e FROM r),
{_PASS("once", "e")}, back AS (SELECT id, list(y ORDER BY k DESC) AS e FROM once WHERE k > 0 GROUP BY id),
{_PASS("twice", "back")}, done AS (SELECT id, list(y ORDER BY k DESC) AS y FROM twice WHERE k > 0 GROUP BY id),
flat AS (SELECT subject, session, channel, unnest(ts) AS t, unnest(done.y[16 + p : 15 + p + n]) AS value FROM r JOIN done USING (id))
SELECT {KEYS}, {R("value")} AS value FROM flat"""


@query(_BANDPASS)
def p8_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.bandpass(series(spark, sf_dir)))


@query(_BANDPASS)
def p8_long_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of series cut into pieces."""
    return rounded(long_series.bandpass(series(spark, sf_dir)))


@query(f"""WITH {fx.SERIES}, o AS (SELECT *, value - avg(value) OVER w AS x, row_number() OVER (w ORDER BY t) AS i, count(*) OVER w AS n FROM series WINDOW w AS (PARTITION BY subject, session, channel)),
h AS (SELECT a.subject, a.session, a.t, a.channel, any_value(a.x) AS re, sum(CASE WHEN a.i = b.i THEN 0 ELSE b.x * (cos(pi() * (a.i - b.i) / a.n) - cos(pi() * (a.i - b.i)) * CASE WHEN a.n % 2 = 0 THEN cos(pi() * (a.i - b.i) / a.n) ELSE 1 END) / sin(pi() * (a.i - b.i) / a.n) / a.n END) AS im
 FROM o a JOIN o b ON a.subject = b.subject AND a.session = b.session AND a.channel = b.channel GROUP BY a.subject, a.session, a.t, a.channel)
SELECT {KEYS}, {R("atan2(im, re)")} AS theta, {R("sqrt(re * re + im * im)")} AS amp FROM h""")
def p9_analytic_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.analytic_phase(series(spark, sf_dir)))


@query(f"WITH {fx.PHASES}, l AS (SELECT obs_id, len(theta) AS n, unnest(range(len(theta))) AS i, unnest(theta) AS v FROM ph) SELECT obs_id, i, {R('cos(v) / sqrt(n)')} AS re, {R('sin(v) / sqrt(n)')} AS im FROM l")
def p10_phase_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.phases(spark, sf_dir).select("obs_id", signal.phase_vector(F.col("theta")).alias("x"))
    return rounded(long(x, ["obs_id"], re=F.col("x.re"), im=F.col("x.im")))


_LAM = """z AS (SELECT *, len(theta) AS n, list_sum(list_transform(theta, lambda v: cos(v * 2))) AS c, list_sum(list_transform(theta, lambda v: sin(v * 2))) AS s FROM ph),
lam AS (SELECT obs_id, (n + sqrt(c * c + s * s)) / 2 AS l1, (n - sqrt(c * c + s * s)) / 2 AS l2, atan2(s, c) / 2 AS h, unnest(range(n)) AS i, unnest(theta) AS v FROM z)"""
_FRAMES = f"{fx.PHASES}, {_LAM}"


@query(f"WITH {_FRAMES} SELECT obs_id, i, {R('l1')} AS l1, {R('l2')} AS l2, {R('cos(v - h) / sqrt(l1)')} AS u1, {R('sin(v - h) / sqrt(l2)')} AS u2 FROM lam")
def p11_coherence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = signal.coherence_frames(fx.phases(spark, sf_dir))
    return rounded(long(f, ["obs_id", "l1", "l2"], u1=F.col("u1"), u2=F.col("u2")))


@query(f"WITH {_FRAMES} SELECT obs_id, i, {R('cos(v - h)')} AS u1, {R('sin(v - h)')} AS u2 FROM lam")
def p12_scaled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = signal.scaled_frames(signal.coherence_frames(fx.phases(spark, sf_dir)))
    return rounded(long(f, ["obs_id"], u1=F.col("u1"), u2=F.col("u2")))


@query()
def p14_randomise_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.randomise_phase(series(spark, sf_dir)))


@query()
def p15_phase_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.phase_controlled(series(spark, sf_dir)))


_U = lambda salt: f"((('0x' || substr(md5(id || ':0:{salt}'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"
_CIRCLE = lambda truth, other: f"CASE WHEN truth = {truth} THEN sin(angle) ELSE {other} END"
_NOISE = lambda salt: f"sqrt(-2 * ln({_U(salt)})) * cos(2 * pi() * {_U(salt + 1)}) * 0.025::DOUBLE"


_TWO = fx.PHASES + """, two AS (SELECT obs_id AS id, truth % 2 AS truth, theta FROM ph JOIN obs USING (obs_id)), cen AS (SELECT truth, arg_min(theta[1:3], id) AS c FROM two GROUP BY truth)"""


@query(f"""WITH {_TWO.replace("ph AS", "given AS").replace("FROM ph", "FROM given")}, ph AS (SELECT id AS obs_id, two.truth, list_transform([0, 1, 2], lambda i: c[i + 1] + ([{_U(0)}, {_U(1)}, {_U(2)}][i + 1] - 0.5) * 0.5) AS theta FROM two JOIN cen ON cen.truth = two.truth),
{_LAM} SELECT obs_id, truth::INT AS truth, i, {R('v')} AS theta, {R('l1')} AS l1, {R('cos(v - h) / sqrt(l1)')} AS u1, {R('sin(v - h) / sqrt(l2)')} AS u2 FROM lam JOIN two ON two.id = lam.obs_id""")
def p16_noisy_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases around those of the first row of each of two classes."""
    p = fx.phases(spark, sf_dir).withColumn("truth", (F.col("truth") % 2).cast("int"))
    centres = [list(r["c"]) for r in p.groupBy("truth").agg(F.min_by(F.slice("theta", 1, 3), "obs_id").alias("c")).orderBy("truth").collect()]
    f = signal.coherence_frames(signal.noisy(p.select("obs_id", "truth"), centres, 0.5))
    return rounded(long(f, ["obs_id", "truth", "l1"], theta=F.col("theta"), u1=F.col("u1"), u2=F.col("u2")))


@query(f"""WITH c AS (SELECT vec_id AS id, label % 2 AS truth, 2 * pi() * {_U(0).replace("id ||", "vec_id ||")} AS angle FROM embeddings), y AS (SELECT id, truth, [cos(angle) + {_NOISE(1)}, {_CIRCLE(0, "0.0")} + {_NOISE(3)}, {_CIRCLE(1, "0.0")} + {_NOISE(5)}] AS y FROM c)
SELECT id AS obs_id, truth::INT AS truth, unnest([0, 1, 2]) AS i, {R("unnest(y) / sqrt(list_dot_product(y, y))")} AS value FROM y""")
def p17_great_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.observations(spark, sf_dir).select("obs_id", (F.col("truth") % 2).cast("int").alias("truth"))
    return rounded(signal.on_circles(rows).select("obs_id", "truth", F.posexplode("x").alias("i", "value")))


_TASKS = ", ".join(f"('{t}', {n}, {s})" for t, n, s in signal.TASKS)


@query(f"SELECT n_nationkey AS subject, task, t FROM nation, (SELECT task, skip, unnest(range(n_vols)) AS t FROM (VALUES {_TASKS}) AS v(task, n_vols, skip)) WHERE t >= skip")
def p18_drop_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = signal.task_table(spark)
    volumes = tasks.select("task", F.explode(F.sequence(F.lit(0), F.col("n_vols") - 1)).alias("t"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject")).crossJoin(F.broadcast(volumes))
    return signal.drop_initial(rows, tasks).select("subject", "task", "t")


@query("SELECT s_suppkey AS subject, s_nationkey AS nation, CASE WHEN s_suppkey >= 60 THEN 'test' ELSE 'train' END AS split FROM supplier")
def p19_split_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"), F.col("s_nationkey").alias("nation"))
    return signal.split_subjects(s, s.select("subject", F.col("subject").alias("split_order")), 60)


@query(f"""WITH u AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_nationkey <> 7), o AS (SELECT id, row_number() OVER (ORDER BY {_U(16)}, id) - 1 AS split_order FROM u)
SELECT id AS subject, split_order, CASE WHEN split_order >= 203 THEN 'test' ELSE 'train' END AS split FROM o""")
def s16_subject_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a seeded order, without those of a nation; the first 203 train."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), "c_nationkey")
    order = signal.subject_order(c, c.where("c_nationkey = 7"))
    return order.withColumn("split", F.when(F.col("split_order") >= 203, "test").otherwise("train"))


@query(f"""WITH {fx.SERIES}, d AS (SELECT DISTINCT subject, session, t, subject AS id FROM series) SELECT subject, session, t, CASE WHEN subject >= 6 THEN 'test2' WHEN (CASE WHEN {_U(0)} < 0.5 THEN 0 ELSE 1 END) = session THEN 'train' ELSE 'test1' END AS split FROM d""")
def p20_split_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).select("subject", "session", "t").distinct()
    return signal.split_sessions(s, s.select("subject").where("subject < 6"))


@query(f"""WITH z AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS value, avg(l_quantity::DOUBLE) OVER w AS m, stddev_pop(l_quantity::DOUBLE) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus, l_linenumber))
SELECT l_orderkey, l_linenumber, {R("(value - m) / CASE WHEN s = 0 THEN 1 ELSE s END")} AS value FROM z""")
def p22_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("double").alias("value"))
    return rounded(signal.standardise(li, ["l_returnflag", "l_linestatus", "l_linenumber"]).select("l_orderkey", "l_linenumber", "value"))


@query(f"""WITH {fx.SERIES} SELECT a.subject, a.channel AS i, b.channel AS j, {R("covar_samp(a.value, b.value)")} AS cov FROM series a JOIN series b ON a.t = b.t AND a.channel < b.channel GROUP BY ALL""")
def p23_upper_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(signal.upper_covariance(fx.observations(spark, sf_dir).withColumnRenamed("truth", "subject"), ["subject"]))


@query(f"""WITH {fx.STIMULI}, v AS (SELECT *, greatest(floor(onset / {fx.STEP}::DOUBLE), 0)::BIGINT AS first FROM ev), o AS (SELECT *, unnest(range(5)) AS "offset" FROM v WHERE first < 200 AND first + 5 <= 200)
SELECT subject, task, condition, {R("onset")} AS onset, "offset", first + "offset" AS t, {R('(first + "offset") * 0.5::DOUBLE + subject')} AS value FROM o""")
def p24_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, scans = fx.stimuli(spark, sf_dir)
    return rounded(signal.event_windows(scans, events, 5, fx.STEP))


@query(f"""WITH {fx.STIMULI}, m AS (SELECT DISTINCT subject, task, unnest(range((floor(onset / {fx.STEP}::DOUBLE) + 1)::BIGINT, (floor((onset + duration) / {fx.STEP}::DOUBLE) + 1)::BIGINT)) AS t FROM ev)
SELECT s.subject, s.task, s.t, CASE WHEN m.t IS NULL THEN 0 ELSE 1 END AS active FROM scan s LEFT JOIN m USING (subject, task, t)""")
def p25_task_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, scans = fx.stimuli(spark, sf_dir)
    return signal.task_vector(scans, events, fx.STEP)


_PARTS = fx.OBSERVATIONS + ", c AS (SELECT obs_id, unnest(range(len(x) // 2)) AS i, unnest(list_filter(x, lambda v, i: i % 2 = 1)) AS re, unnest(list_filter(x, lambda v, i: i % 2 = 0)) AS im FROM obs)"


@query(f"""WITH {_PARTS} SELECT obs_id, 'split' AS mode, i, {R("re")} AS value FROM c UNION ALL SELECT obs_id, 'split', i + 32, {R("im")} FROM c UNION ALL SELECT obs_id, 'magphase', i, {R("sqrt(re * re + im * im)")} FROM c
UNION ALL SELECT obs_id, m, i + o, {R("cos(atan2(im, re))")} FROM c, (VALUES ('magphase', 32), ('cos_sin_phase', 0)) AS v(m, o) UNION ALL SELECT obs_id, m, i + o, {R("sin(atan2(im, re))")} FROM c, (VALUES ('magphase', 64), ('cos_sin_phase', 32)) AS v(m, o)""")
def p26_real_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.complex_observations(spark, sf_dir)
    one = lambda mode: c.select("obs_id", F.lit(mode).alias("mode"), F.posexplode(signal.real_features(F.col("x"), mode)).alias("i", "value"))
    return rounded(one("split").union(one("magphase")).union(one("cos_sin_phase")))


@query(f"""WITH {fx.OBSERVATIONS}, f AS (SELECT obs_id, CASE WHEN len(list_filter(x, lambda v: v > 0)) > len(x) / 2 THEN -1 ELSE 1 END AS s, unnest(range(len(x))) AS i, unnest(x) AS v FROM obs) SELECT obs_id, i, {R("v * s")} AS value FROM f""")
def p27_flip_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fx.observations(spark, sf_dir).select("obs_id", F.posexplode(vec.flip_sign(F.col("x"))).alias("i", "value")))


_COHERENCE = fx.SERIES + ", g AS (SELECT a.channel AS i, b.channel AS j, avg(a.value * b.value) AS value FROM series a JOIN series b ON a.t = b.t GROUP BY ALL)"


def _matrix(spark: SparkSession, m) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(m.tolist()) for j, v in enumerate(row)], "i long, j long, value double")


@query(f"WITH {_COHERENCE} SELECT i, j, {R('value')} AS value FROM g")
def p28_mean_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_matrix(spark, signal.mean_coherence(fx.observations(spark, sf_dir))))


@query()
def p29_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    share, _ = signal.explained(fx.observations(spark, sf_dir))
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(share)], "component int, share double")


@query(f"WITH {_COHERENCE} SELECT i % 8 AS a, j % 8 AS b, {R('avg(value)')} AS value FROM g GROUP BY ALL")
def p30_block_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    networks = spark.range(64).select(F.col("id").alias("roi"), (F.col("id") % 8).alias("network"))
    return rounded(signal.block_means(_matrix(spark, signal.mean_coherence(fx.observations(spark, sf_dir))), networks))


@query(f"""WITH {fx.STIMULI} SELECT task, condition, {R("onset")} AS onset, {R("duration")} AS duration, subject::DOUBLE AS amplitude FROM ev
WHERE (task = 'click' AND condition IN ('c0', 'c2')) OR (task = 'purchase' AND condition = 'c1')""")
def s12_event_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lists are written by task and condition, and those of some tasks' conditions found again."""
    events, _ = fx.stimuli(spark, sf_dir)
    where = f"{scratch.folder(spark)}/events-{uuid.uuid4().hex}"
    events.select("task", "condition", F.concat_ws(" ", "onset", "duration", "subject").alias("value")).write.partitionBy("task", "condition").text(where)
    return rounded(files.find_events(spark, where, {"click": ("c0", "c2"), "purchase": ("c1", "none")}, "task={task}/condition={condition}/*"))
