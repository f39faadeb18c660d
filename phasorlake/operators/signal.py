"""From multichannel series to observations.

Series are long: ``subject, session, t, channel, value`` (names are parameters where they differ). What one
row, one group or one window can say is said in columns; filters and regressions work on one channel's or
one session's samples in an Arrow batch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters, vec
from .kernels import summed

SERIES = ["subject", "session", "channel"]


def detrend(df: DataFrame, keys: list[str] = SERIES, t: str = "t", value: str = "value") -> DataFrame:
    """Less the least-squares line of each channel."""
    w = Window.partitionBy(*keys)
    x, y = F.col(t).cast("double"), F.col(value)
    slope = F.covar_pop(x, y).over(w) / F.var_pop(x).over(w)
    return df.withColumn(value, y - F.avg(y).over(w) - F.coalesce(slope, F.lit(0.0)) * (x - F.avg(x).over(w)))


def demean(df: DataFrame, keys: list[str] = SERIES, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def regress_global(df: DataFrame, scan: tuple[str, ...] = ("subject", "session"), t: str = "t", channel: str = "channel", value: str = "value") -> DataFrame:
    """Less the part of each channel that goes with the mean of all channels, without intercept."""
    g = F.avg(value).over(Window.partitionBy(*scan, t))
    w = Window.partitionBy(*scan, channel)
    with_g = df.withColumn("_g", g)
    share = F.sum(F.col(value) * F.col("_g")).over(w) / F.sum(F.col("_g") * F.col("_g")).over(w)
    return with_g.withColumn(value, F.col(value) - F.col("_g") * share).drop("_g")


def regress_nuisance(df: DataFrame, nuisance: DataFrame, scan: tuple[str, ...] = ("subject", "session")) -> DataFrame:
    """Less what z-scored nuisance series explain. ``nuisance``: scan, t, r array<double>."""
    both = df.join(nuisance, [*scan, "t"])
    kinds = dict(df.dtypes)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot(index="t", columns="channel", values="value").sort_index()
        r = np.stack(rows.drop_duplicates("t").sort_values("t")["r"].to_numpy())
        sd = r.std(0, ddof=1)
        r = (r - r.mean(0)) / np.where(sd == 0, 1, sd)
        y = wide.to_numpy()
        left = pd.DataFrame(y - r @ np.linalg.lstsq(r, y, rcond=None)[0], index=wide.index, columns=wide.columns).stack().rename("value").reset_index()
        for c in scan:
            left[c] = rows[c].iloc[0]
        return left[[*scan, "t", "channel", "value"]]

    return both.groupBy(*scan).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (*scan, "t", "channel")) + ", value double")


def mask_mean(df: DataFrame, mask: DataFrame, keys: tuple[str, ...] = ("subject", "session", "t")) -> DataFrame:
    """Mean by time of the channels in ``mask`` (channel)."""
    return df.join(F.broadcast(mask.select("channel").distinct()), "channel", "left_semi").groupBy(*keys).agg(F.avg("value").alias("value"))


def parcellate(df: DataFrame, atlas: DataFrame, keys: tuple[str, ...] = ("subject", "session", "t")) -> DataFrame:
    """Mean by region. ``atlas``: channel, roi; a table of one row for each channel."""
    return df.join(atlas, "channel").groupBy(*keys, "roi").agg(F.avg("value").alias("value"))


def _by_channel(df: DataFrame, keys: list[str], work, added: str) -> DataFrame:
    kinds = dict(df.dtypes)
    names = [c.strip().split()[0] for c in added.split(",")]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        out = rows[[*keys, "t"]].copy()
        for name, v in zip(names, work(rows["value"].to_numpy()), strict=True):
            out[name] = v
        return out

    return df.select(*keys, "t", "value").groupBy(*keys).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "t")) + f", {added}")


def bandpass(df: DataFrame, keys: list[str] = SERIES, order: int = 2, low: float = 0.03, high: float = 0.07, step: float = 0.72, pad: int = 100) -> DataFrame:
    """Zero-phase Butterworth of each channel; ``pad`` reflected samples a side are filtered too and cut off."""
    b, a = filters.butter_bandpass(order, low, high, 1 / step)

    def work(x: np.ndarray) -> list[np.ndarray]:
        n = min(pad, len(x) - 1)
        y = filters.filtfilt(b, a, filters.reflected(x, n))
        return [y[n : n + len(x)]]

    return _by_channel(df, keys, work, "value double")


def analytic_phase(df: DataFrame, keys: list[str] = SERIES, pad: int = 0) -> DataFrame:
    """theta and amp of the demeaned channel's analytic signal."""

    def work(x: np.ndarray) -> list[np.ndarray]:
        n = min(pad, len(x) - 1)
        z = filters.analytic(filters.reflected(x, n) - x.mean())[n : n + len(x)]
        return [np.angle(z), np.abs(z)]

    return _by_channel(df, keys, work, "theta double, amp double")


def randomise_phase(df: DataFrame, keys: list[str] = SERIES, seed: int = 0) -> DataFrame:
    """The same spectrum with a random phase for each frequency, seeded by channel."""
    kinds = dict(df.dtypes)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        rng = np.random.default_rng([seed, *(zlib.crc32(str(rows[k].iloc[0]).encode()) for k in keys)])
        f = np.fft.fft(rows["value"].to_numpy())
        return rows[[*keys, "t"]].assign(value=np.abs(np.fft.ifft(f * np.exp(1j * rng.uniform(0, 2 * np.pi, len(f))))))

    return df.select(*keys, "t", "value").groupBy(*keys).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "t")) + ", value double")


# -- phases to observations -----------------------------------------------------------------------


def phase_vector(theta: Column) -> Column:
    """e^(i theta) / sqrt(p) as struct<re, im>."""
    root = F.sqrt(F.size(theta))
    return F.struct(F.transform(theta, lambda v: F.cos(v) / root).alias("re"), F.transform(theta, lambda v: F.sin(v) / root).alias("im"))


def coherence_frames(df: DataFrame, theta: str = "theta") -> DataFrame:
    """Add l1, l2, u1, u2: eigenvalues and eigenvectors of cos(theta_i - theta_j), which has rank 2, in closed
    form. With z the sum of e^(2i theta): l = (p +- |z|) / 2, and the eigenvectors are the cosine and sine of
    theta less half the angle of z, scaled; their sign is that of this formula."""
    c, s = vec.total(F.transform(theta, lambda v: F.cos(v * 2))), vec.total(F.transform(theta, lambda v: F.sin(v * 2)))
    df = df.withColumn("_c", c).withColumn("_s", s)
    size = F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s"))
    df = df.withColumn("l1", (F.size(theta) + size) / 2).withColumn("l2", (F.size(theta) - size) / 2).withColumn("_h", F.atan2("_s", "_c") / 2)
    return df.withColumn("u1", F.transform(theta, lambda v: F.cos(v - F.col("_h")) / F.sqrt("l1"))).withColumn("u2", F.transform(theta, lambda v: F.sin(v - F.col("_h")) / F.sqrt("l2"))).drop("_c", "_s", "_h")


def scaled_frames(df: DataFrame) -> DataFrame:
    """u1, u2 times the roots of their eigenvalues: squared column norms sum to p."""
    scale = lambda u, lam: F.transform(u, lambda v: v * F.sqrt(lam))
    return df.withColumn("u1", scale(F.col("u1"), F.col("l1"))).withColumn("u2", scale(F.col("u2"), F.col("l2")))


def amplitude_vector(x: Column, amp: Column) -> Column:
    """A complex phase vector times amplitudes."""
    return F.struct(F.zip_with(x["re"], amp, lambda a, b: a * b).alias("re"), F.zip_with(x["im"], amp, lambda a, b: a * b).alias("im"))


FEATURES = {
    "Complex_Watson": "phase", "Complex_ACG": "phase", "complex_diametrical": "phase", "Watson": "lead", "ACG": "lead", "least_squares": "lead", "diametrical": "lead", "MACG": "frame", "grassmann": "frame",
    "SingularWishart": "scaled", "weighted_grassmann": "scaled", "Complex_Normal": "amplitude", "Normal": "series", "linear-svm": "series", "rbf-svm": "series", "logistic": "series",
}


def features_for(df: DataFrame, model: str, keys: list[str]) -> DataFrame:
    """keys and the observation that a model takes. ``df``: keys, theta, amp, ts (arrays over channels)."""
    kind = FEATURES[model]
    if kind == "phase":
        return df.select(*keys, phase_vector(F.col("theta")).alias("x"))
    if kind == "amplitude":
        return df.select(*keys, amplitude_vector(phase_vector(F.col("theta")), F.col("amp")).alias("x"))
    if kind == "series":
        return df.select(*keys, F.col("ts").alias("x"))
    frames = coherence_frames(df.select(*keys, "theta"))
    if kind == "lead":
        return frames.select(*keys, F.col("u1").alias("x"))
    return (scaled_frames(frames) if kind == "scaled" else frames).select(*keys, "u1", "u2", "l1", "l2")


def gathered(df: DataFrame, keys: list[str], value: str, name: str, channel: str = "channel") -> DataFrame:
    """Long to one array over channels, in their order."""
    return df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(channel, value))), lambda s: s[value]).alias(name))


def real_features(x: Column, mode: str) -> Column:
    """A complex vector as real features: split, magphase or cos_sin_phase."""
    size = lambda r, i: F.sqrt(r * r + i * i)
    part = lambda f: F.zip_with(x["re"], x["im"], f)
    cos, sin = part(lambda r, i: F.cos(F.atan2(i, r))), part(lambda r, i: F.sin(F.atan2(i, r)))
    if mode == "split":
        return F.concat(x["re"], x["im"])
    if mode == "magphase":
        return F.concat(part(size), cos, sin)
    if mode == "cos_sin_phase":
        return F.concat(cos, sin)
    raise ValueError(f"no such mode: {mode}")


# -- data sets ------------------------------------------------------------------------------------

#: Fixed values of the task data set: volumes and initial volumes left out.
TASKS = (("EMOTION", 176, 15), ("GAMBLING", 253, 11), ("LANGUAGE", 316, 0), ("MOTOR", 284, 11), ("RELATIONAL", 232, 11), ("SOCIAL", 274, 11), ("WM", 405, 11))


def task_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, n, s, i) for i, (t, n, s) in enumerate(TASKS)], "task string, n_vols int, skip int, ord int")


def drop_initial(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows from each task's first kept volume on. ``tasks`` has one row for each task."""
    return df.join(tasks.select("task", "skip"), "task").where("t >= skip").drop("skip")


def subject_order(subjects: DataFrame, excluded: DataFrame | None = None, seed: int = 0, rows: int = 1_000_000) -> DataFrame:
    """subject, split_order: the subjects that aren't excluded, each once, numbered without gaps in an order that ``seed``
    draws. Digests give each subject a number between 0 and 1; stretches of these numbers, of about ``rows`` subjects,
    are sorted side by side and start from the count of those before, so sizes of splits are exact and no task sorts
    the whole. Equal digests go by subject; nulls are left out."""
    names = subjects.select("subject").where("subject is not null").distinct()
    if excluded is not None:
        names = names.join(excluded.select("subject"), "subject", "left_anti")
    stretches = names.count() // rows + 1
    drawn = names.withColumn("_u", _uniform(F.col("subject"), seed, 16)).withColumn("_s", F.floor(F.col("_u") * stretches))
    sizes = drawn.groupBy("_s").agg(F.count("*").alias("_n"))
    starts = sizes.select("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy("_u", "subject")) - 1
    return drawn.withColumn("_place", place).join(starts, "_s").select("subject", (F.col("_before") + F.col("_place")).alias("split_order"))


def split_subjects(df: DataFrame, subjects: DataFrame, train: int, fold: int | None = None) -> DataFrame:
    """Add split by the subjects' order: the first ``train`` train, or with ``fold`` the fold of a fifth tests."""
    n = subjects.count()
    if fold is None:
        test = F.col("split_order") >= train
    else:
        wide = n - train
        test = F.col("split_order").between(fold * wide, min((fold + 1) * wide, n) - 1)
    return df.join(subjects.select("subject", "split_order"), "subject").withColumn("split", F.when(test, "test").otherwise("train")).drop("split_order")


def split_sessions(df: DataFrame, train_subjects: DataFrame) -> DataFrame:
    """Add split: of a train subject one session trains and the other is test1, by digest; others are test2."""
    marked = df.join(train_subjects.select("subject").distinct().withColumn("_own", F.lit(True)), "subject", "left")
    first = F.when(_uniform(F.col("subject"), 0, 0) < 0.5, 0).otherwise(1) == F.col("session") % 2
    return marked.withColumn("split", F.when(F.col("_own").isNull(), "test2").when(first, "train").otherwise("test1")).drop("_own")


def standardise(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """z-scores with the population's deviation; a constant is divided by 1."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.when(sd == 0, 1.0).otherwise(sd))


def upper_covariance(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """keys, i, j (i < j), cov: the sample covariance of array columns. A batch gives each of its groups' count,
    means and co-moments about them; those meet by (keys, i, j)."""

    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table({k: batch.column(k) for k in keys}).append_column("_at", pa.array(np.arange(batch.num_rows)))
            values = np.stack(batch.column(x).to_numpy(zero_copy_only=False))
            i, j = np.triu_indices(values.shape[1], 1)
            for group in rows.group_by(keys).aggregate([("_at", "list")]).to_pylist():
                v = values[group["_at_list"]]
                m = v.mean(0)
                c = (v - m).T @ (v - m)
                same = [pa.array([group[k]] * len(i), batch.schema.field(k).type) for k in keys]
                yield pa.record_batch([*same, pa.array(i), pa.array(j), pa.array(np.full(len(i), float(len(v)))), pa.array(m[i]), pa.array(m[j]), pa.array(c[i, j])], names=[*keys, "i", "j", "n", "a", "b", "c"])

    kinds = dict(df.dtypes)
    parts = df.select(*keys, x).mapInArrow(each, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i long, j long, n double, a double, b double, c double")
    total = lambda e: F.sum(e)
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    got = parts.groupBy(*keys, "i", "j").agg(total(n).alias("n"), total(n * a).alias("sa"), total(n * b).alias("sb"), total(n * a * b).alias("ab"), total("c").alias("c"))
    return got.select(*keys, "i", "j", F.when(F.col("n") > 1, (F.col("c") + F.col("ab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def event_windows(series: DataFrame, events: DataFrame, n: int, step: float = 0.72, from_end: bool = False, keys: tuple[str, ...] = ("subject", "task")) -> DataFrame:
    """The first ``n`` volumes after each event: volume floor(onset / step) and on; negative ones count as 0, events
    whose window leaves the scan are left out, overlaps repeat. Events become rows for each volume and meet
    the series by equality. ``from_end``: onsets are one step earlier. Series and lengths grow with the scans, and how far
    rows are exploded can't be told from a plan, so the joins are merges, never broadcasts."""
    onset = F.col("onset") - (step if from_end else 0.0)
    length = series.groupBy(*keys).agg((F.max("t") + 1).alias("_len"))
    first = F.greatest(F.floor(onset / step), F.lit(0)).cast("long")
    rows = events.hint("merge").join(length.hint("merge"), list(keys)).withColumn("_first", first).where((F.col("_first") < F.col("_len")) & (F.col("_first") + n <= F.col("_len")))
    rows = rows.select(*keys, "condition", "onset", F.posexplode(F.sequence("_first", F.col("_first") + (n - 1))).alias("offset", "t"))
    return rows.hint("merge").join(series.hint("merge"), [*keys, "t"])


def task_vector(times: DataFrame, events: DataFrame, step: float = 0.72, keys: tuple[str, ...] = ("subject", "task")) -> DataFrame:
    """keys, t, active: 1 inside an event, from floor(onset / step) + 1 to floor((onset + duration) / step)."""
    last = F.floor((F.col("onset") + F.col("duration")) / step).cast("long")
    inside = events.select(*keys, (F.floor(F.col("onset") / step) + 1).cast("long").alias("_a"), last.alias("_b")).where("_a <= _b")
    marks = inside.select(*keys, F.explode(F.sequence("_a", "_b")).alias("t")).distinct().withColumn("active", F.lit(1))
    return times.select(*keys, F.col("t").cast("long").alias("t")).hint("merge").join(marks.hint("merge"), [*keys, "t"], "left").withColumn("active", F.coalesce("active", F.lit(0)))


def mean_coherence(df: DataFrame) -> np.ndarray:
    """The mean of x x^H."""
    from .kernels import kind_of, size_of

    p, name = size_of(df)[0], "c_g" if kind_of(df) == "complex" else "g"

    def kernel(x: np.ndarray, _) -> dict[str, np.ndarray]:
        rows = x if x.ndim == 2 else np.moveaxis(x, 2, 1).reshape(-1, x.shape[1])
        return {name: rows.T @ rows.conj(), "n": np.array([float(len(x))])}

    got = summed(df, kernel, {name: (p, p), "n": (1,)})
    return got[name] / got["n"][0]


def explained(df: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Cumulative share of the squared singular values in percent, and the first place above 95 and 99."""
    values = np.clip(np.linalg.eigvalsh(mean_coherence(df))[::-1], 0, None)
    share = np.cumsum(values) / values.sum() * 100
    return share, {c: int(np.argmax(share > c)) for c in (95, 99)}


def block_means(cells: DataFrame, networks: DataFrame) -> DataFrame:
    """a, b, value: the mean of a matrix (i, j, value) over blocks of networks (roi, network), symmetrised."""
    a, b = networks.select(F.col("roi").alias("i"), F.col("network").alias("a")), networks.select(F.col("roi").alias("j"), F.col("network").alias("b"))
    one = cells.join(a, "i").join(b, "j").groupBy("a", "b").agg(F.avg("value").alias("value"))
    turned = one.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("value").alias("other"))
    return one.join(turned, ["a", "b"], "left").select("a", "b", ((F.col("value") + F.coalesce("other", "value")) / 2).alias("value"))


# -- made-up data ---------------------------------------------------------------------------------


def _uniform(column: Column, seed: int, salt: int) -> Column:
    """Between 0 and 1, from 52 bits of a digest of the value: the same on every run and in other engines."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", column.cast("string"), F.lit(f"{seed}:{salt}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def noisy_phases(spark: SparkSession, centres: list[list[float]], n: int, noise: float, seed: int = 0) -> DataFrame:
    """obs_id, truth, theta: ``n`` rows for each centre of phases, with uniform noise of total width ``noise``."""
    rows = spark.range(n * len(centres)).select(F.col("id").alias("obs_id"), F.floor(F.col("id") / n).cast("int").alias("truth"))
    return noisy(rows, centres, noise, seed)


def noisy(rows: DataFrame, centres: list[list[float]], noise: float, seed: int = 0) -> DataFrame:
    """obs_id, truth, theta of rows with obs_id and truth, the number of their centre."""
    p = len(centres[0])
    table = F.array(*(vec.literal(c) for c in centres))
    noisy = [F.get(F.get(table, F.col("truth")), F.lit(i)) + (_uniform(F.col("obs_id"), seed, i) - 0.5) * noise for i in range(p)]
    return rows.select("obs_id", "truth", F.array(*noisy).alias("theta"))


def great_circles(spark: SparkSession, n: int, scale: float = 0.1, seed: int = 0) -> DataFrame:
    """obs_id, truth, x: two noisy great circles on the sphere, to unit length."""
    rows = spark.range(2 * n).select(F.col("id").alias("obs_id"), F.floor(F.col("id") / n).cast("int").alias("truth"))
    return on_circles(rows, scale, seed)


def on_circles(rows: DataFrame, scale: float = 0.1, seed: int = 0) -> DataFrame:
    """obs_id, truth, x of rows with obs_id and truth, 0 or 1 for the circle."""
    u = lambda s: _uniform(F.col("obs_id"), seed, s)
    normal = lambda s: F.sqrt(-2 * F.log(u(s))) * F.cos(2 * np.pi * u(s + 1)) * (scale / 4)
    angle = 2 * np.pi * u(0)
    on = [F.cos(angle), F.when(F.col("truth") == 0, F.sin(angle)).otherwise(0.0), F.when(F.col("truth") == 0, 0.0).otherwise(F.sin(angle))]
    rows = rows.withColumn("y", F.array(*(v + normal(2 * i + 1) for i, v in enumerate(on))))
    return rows.select("obs_id", "truth", F.transform("y", lambda v: v / F.sqrt(vec.norm2(F.col("y")))).alias("x"))


def phase_controlled(df: DataFrame, k: int = 5, seed: int = 0, keys: list[str] = SERIES, pad: int = 10) -> DataFrame:
    """Series whose channels are coherent in one of k windows each. The channels, in order, fall into k blocks
    of equal width, the last one with the rest. In window w every frequency of a channel of block w gets the
    channel's own phase, one for all scans; other channels get a random phase for each frequency.
    Magnitudes are kept, ``pad`` samples a side are reflected through the end points and cut off again, and
    each channel of a scan is demeaned as a whole. Random numbers follow from ``seed`` and the keys."""
    kinds = dict(df.dtypes)
    n_channels = int(df.agg(F.max("channel")).first()[0] or 0) + 1
    scan = [c for c in keys if c != "channel"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        channel, x = int(rows["channel"].iloc[0]), rows["value"].to_numpy()
        y = controlled(x, channel, n_channels, k, seed, zlib.crc32(repr([rows[c].iloc[0] for c in scan]).encode()), pad)
        return rows[[*keys, "t"]].assign(value=y)

    return df.select(*keys, "t", "value").groupBy(*keys).applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "t")) + ", value double")


def controlled(x: np.ndarray, channel: int, n_channels: int, k: int, seed: int, scan: int, pad: int = 10) -> np.ndarray:
    """One channel of ``phase_controlled``."""
    block = min(channel // max(n_channels // k, 1), k - 1)
    shift = np.random.default_rng([seed, channel]).uniform(-np.pi, np.pi)
    cuts = np.linspace(0, len(x), k + 1).astype(int)
    out = np.empty(len(x))
    for w, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        wide = min(pad, b - a - 1)
        f = np.fft.fft(np.pad(x[a:b], wide, mode="reflect", reflect_type="odd"))
        at = np.fft.fftfreq(len(f))
        if block == w:
            phase = np.where(at >= 0, shift, -shift)
        else:
            drawn = np.random.default_rng([seed, scan, w, channel]).uniform(-np.pi, np.pi, len(f) // 2 + 1)
            phase = np.sign(at + (at == 0)) * drawn[np.rint(np.abs(at) * len(f)).astype(int)]
        out[a:b] = np.fft.ifft(np.abs(f) * np.exp(1j * phase)).real[wide : wide + b - a]
    return out - out.mean()
