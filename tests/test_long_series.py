"""Filters of series in pieces against those of whole series; subjects in a seeded order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasorlake.functions import filters
from phasorlake.operators import long_series, signal

B, A = filters.butter_bandpass(2, 0.03, 0.07, 1 / 0.72)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 1000])
def test_strips_equal_one_sample_after_another(n):
    rng = np.random.default_rng(n)
    f, x, z = long_series.Recursive(B, A), rng.normal(size=n), rng.normal(size=4)
    y, end = f.run(x, z)
    # powers of the state's matrix cost digits: the strips are within 3e-10 of the largest value, against extended precision
    whole = filters._run(B, A, np.concatenate([x, np.zeros(50)]), z)
    near = 1e-9 * np.abs(whole).max()
    np.testing.assert_allclose(y, whole[:n], rtol=0, atol=near)
    np.testing.assert_allclose(f.run(np.zeros(50), end)[0], whole[n:], rtol=0, atol=near)
    np.testing.assert_allclose(f.after(z, n), f.run(np.zeros(n), z)[1], rtol=0, atol=near)


@pytest.mark.parametrize(("n", "pad"), [(1000, 100), (60, 100), (20, 100), (9, 100), (40, 0)])
def test_what_goes_before_equals_padding(n, pad):
    x, turn = np.random.default_rng(n).normal(size=n), 15
    wide = min(pad, n - 1)
    if n + 2 * wide <= turn:
        wide = turn
    y = filters.reflected(x, wide)
    np.testing.assert_array_equal(long_series.before(x[: wide + turn + 1], n, wide, turn), np.concatenate([2 * y[0] - y[turn:0:-1], y[:wide]]))


def test_pieces_equal_the_whole(spark):
    rng = np.random.default_rng(8)
    lengths = {("a", 0): 5_000, ("a", 1): 131, ("b", 0): 30, ("b", 1): 700}
    rows = [(s, c, int(t), float(v)) for (s, c), n in lengths.items() for t, v in zip(np.cumsum(rng.integers(1, 4, n)), rng.normal(size=n), strict=True)]
    df = spark.createDataFrame([*rows, ("a", 0, None, 1.0), ("a", 0, 7, None), (None, 0, 7, 1.0)], "subject string, channel int, t long, value double").withColumn("at", F.lit(1)).repartition(5)
    keys = ["subject", "channel"]
    cut = long_series.pieces(df, keys, 64)
    assert cut.agg(F.max("n")).first()[0] <= 64 and cut.agg(F.sum("n")).first()[0] == len(rows)
    got = long_series.bandpass(df, keys, rows=64).toPandas()
    assert list(got.columns) == [*keys, "t", "value"] and len(got) == len(rows)
    for (s, c), n in lengths.items():
        mine = [r for r in rows if r[:2] == (s, c)]
        wide = min(100, n - 1)
        y = filters.filtfilt(B, A, filters.reflected(np.array([r[3] for r in mine]), wide))[wide : wide + n]
        one = got[(got["subject"] == s) & (got["channel"] == c)].sort_values("t")
        assert one["t"].tolist() == [r[2] for r in mine]
        np.testing.assert_allclose(one["value"], y, atol=1e-9)


def test_no_rows_and_too_few(spark):
    schema = "subject long, session long, channel long, t long, value double"
    assert long_series.bandpass(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="more than 15 samples"):
        long_series.bandpass(spark.createDataFrame([(1, 1, 1, t, 1.0) for t in range(5)], schema)).count()


@pytest.mark.parametrize("rows", [7, 1_000])
def test_subjects_have_an_order_without_gaps(spark, rows):
    given = spark.createDataFrame([(i % 90,) for i in range(150)] + [(None,)], "subject long")
    order = signal.subject_order(given, given.where("subject = 13"), seed=3, rows=rows).orderBy("split_order").collect()
    assert [r["split_order"] for r in order] == list(range(89))
    assert sorted(r["subject"] for r in order) == [i for i in range(90) if i != 13]
    # stretches of any size give one order, another seed another one
    first = signal.subject_order(given, given.where("subject = 13"), seed=3).orderBy("split_order").collect()
    other = signal.subject_order(given, given.where("subject = 13"), seed=4).orderBy("split_order").collect()
    assert order == first and order != other
