import inspect
import itertools
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from phasorlake.functions import filters, special
from phasorlake.operators import hmm, kmeans, mixture, signal, stats, supervised
from phasorlake.operators.families import Family
from phasorlake.plans import engine, fixtures, registry, sweep
from phasorlake.sources import files


def test_kummer_for_negative_arguments():
    assert special.log_kummer(0.5, 1.5, -3.0) == pytest.approx(-3 + special.log_kummer(1.0, 1.5, 3.0))
    assert special.kummer_ratio(0.5, 2.0, special.solve_kummer(0.5, 2.0, 0.4)) == pytest.approx(0.4)


def test_assignment_is_the_cheapest():
    cost = np.random.default_rng(0).normal(size=(5, 5))
    best = min(sum(cost[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
    assert cost[range(5), special.assignment(cost)].sum() == pytest.approx(best)


@pytest.mark.parametrize("name", ["ACG", "Normal"])
def test_low_rank_density_equals_full(name):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 6))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if name == "ACG" else x
    m = rng.normal(size=(1, 6, 2))
    low = Family(name, (6,), rank=2).log_pdf(x, {"pi": np.ones(1), "M": m} | ({"gamma": np.ones(1)} if name == "Normal" else {}))
    full = Family(name, (6,)).log_pdf(x, {"pi": np.ones(1), "Psi": np.eye(6)[None] + m[0] @ m[0].T})
    np.testing.assert_allclose(low, full)


@pytest.fixture(scope="module")
def frames(spark):
    return signal.coherence_frames(signal.noisy_phases(spark, [[0.0, 2.0, 4.0], [0.0, 1.0, 5.0]], 100, 0.3)).cache()


@pytest.mark.parametrize("name", ["Watson", "ACG", "MACG", "SingularWishart"])
def test_em_never_lowers_the_likelihood(frames, name):
    df = signal.scaled_frames(frames) if name == "SingularWishart" else frames
    df = df.select("obs_id", F.col("u1").alias("x")) if name in ("Watson", "ACG") else df.select("obs_id", "u1", "u2")
    shape = (3, 2) if name in ("MACG", "SingularWishart") else (3,)
    curve = mixture.fit(df, Family(name, shape), 2, max_iter=6).curve
    assert all(b >= a - 1e-7 * abs(a) for a, b in zip(curve, curve[1:]))


def test_clusters_find_the_truth(frames):
    got = kmeans.fit(frames.select("obs_id", "truth", "u1", "u2"), 2, "grassmann", init="maxmin").assign(frames)
    table = {(r["truth"], r["part"]): r["count"] for r in got.groupBy("truth", "part").count().collect()}
    assert max(table.get((0, 0), 0) + table.get((1, 1), 0), table.get((0, 1), 0) + table.get((1, 0), 0)) >= 190


def test_viterbi_and_forward_equal_all_paths(spark):
    lp = np.log(np.random.default_rng(2).uniform(0.1, 1, (5, 2)))
    t, d = np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.6, 0.4])
    df = spark.createDataFrame([(0, i, row.tolist()) for i, row in enumerate(lp)], "seq_id int, t int, lp array<double>")
    score = {p: math.log(d[p[0]]) + sum(lp[i, s] for i, s in enumerate(p)) + sum(math.log(t[a, b]) for a, b in zip(p, p[1:])) for p in itertools.product((0, 1), repeat=5)}
    assert hmm.likelihoods(df, d, t).first()["loglik"] == pytest.approx(np.logaddexp.reduce(list(score.values())))
    assert tuple(r["state"] for r in hmm.viterbi(df, d, t).orderBy("t").collect()) == max(score, key=score.get)


def test_parameters_survive_their_table(spark, frames):
    model = engine.train(frames.select("obs_id", F.col("u1").alias("x")), 2, "ACG", rank=1, max_iter=3)
    again = files.params_from(files.params_table(spark, model.theta))
    for name, value in model.theta.items():
        np.testing.assert_allclose(again[name], value)
    assert files.lower_rank([1, 5, 10], 10) == 5


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\n3,4\n5,6\n7,8\n")
    m = files.read_matrix(spark, str(tmp_path / "m.csv"))
    assert sorted((r.t, r.channel, r.value) for r in m.collect())[:3] == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)]
    assert files.interleaved(m).orderBy("t", "channel").first()[:] == (0, 0, 1.0, 3.0)
    (tmp_path / "e.txt").write_text("1.5 2 1\n3,4,1\nonset duration amplitude\n")
    assert sorted(r.onset for r in files.read_events(spark, str(tmp_path / "e.txt")).collect()) == [1.5, 3.0]


@pytest.mark.parametrize(("name", "candidates"), [("c1_logistic", 7), ("c2_linear_svm", 6), ("c3_rbf_svm", 25)])
def test_supervised_queries_choose_over_folds(spark, monkeypatch, name, candidates):
    seen = []

    def noted(rows, fits, extra, f=supervised.kernels.together):
        seen.append(len(fits))
        return f(rows, fits, extra)

    monkeypatch.setattr(supervised.kernels, "together", noted)
    monkeypatch.setattr(supervised, "descent", lambda x, max_iter, tol, f=supervised.descent: f(x, 2, tol))
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) == 500 and got["held_out"].sum() == 100 and seen == [5 * candidates, 1]


def _classes(n=300, p=4, seed=3):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 3, n)
    return truth, rng.normal(size=(n, p)) + 2.5 * np.eye(3, p)[truth]


def _objective(kind, model, x, truth, penalty):
    """Half the squared coefficients plus the penalty times the loss, row by row; hinges rounded at their corner."""
    count = np.bincount(truth)
    total = (model.beta[:-1] ** 2).sum() / 2
    for m, y in zip(model.wide(x) @ model.beta, truth):
        w = len(truth) / (len(count) * count[y])
        if kind == "logistic":
            total += penalty * w * (np.log(np.exp(m - m.max()).sum()) + m.max() - m[y])
            continue
        for i, (a, b) in enumerate(itertools.combinations(range(len(count)), 2)):
            if y in (a, b):
                short = 1 - m[i] * (1 if y == a else -1)
                total += penalty * w * (0 if short < 0 else short**2 / 0.1 if short < 0.05 else short - 0.025)
    return total


@pytest.mark.parametrize("kind", supervised.KINDS)
def test_supervised_fits_reach_their_optimum(spark, kind):
    truth, x = _classes(120)
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(truth, x))], "obs_id long, truth int, x array<double>")
    options = {"gammas": ("scale",), "width": 12} if kind == "rbf-svm" else {}
    chosen, model = supervised.fit(df.repartition(7), kind, grid=(0.3,), max_iter=500, tol=1e-10, **options)
    assert chosen["C"] == 0.3
    low = _objective(kind, model, x, truth, 0.3)
    rng = np.random.default_rng(0)
    for _ in range(60):  # no step in any direction goes lower
        step = rng.normal(size=model.beta.shape) * rng.choice([1e-1, 1e-2, 1e-3])
        other = supervised.Model(model.kind, 3, model.mean, model.scale, model.beta + step, model.features)
        assert _objective(kind, other, x, truth, 0.3) > low - 1e-6 * low
    _, again = supervised.fit(df.coalesce(1), kind, grid=(0.3,), max_iter=500, tol=1e-10, **options)
    np.testing.assert_allclose(model.prob(x), again.prob(x), atol=1e-3)
    if kind != "rbf-svm":
        np.testing.assert_allclose(model.mean, x.mean(0))
        np.testing.assert_allclose(model.scale, 1 / x.std(0))


@pytest.mark.parametrize("kind", supervised.KINDS)
def test_cross_validation_over_the_whole_grid(spark, kind):
    truth, x = _classes()
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(truth, x))], "obs_id long, truth int, x array<double>")
    train, test = df.where("obs_id < 200"), df.where("obs_id >= 200")
    options = {"width": 24, "max_iter": 15} if kind == "rbf-svm" else {"max_iter": 30}
    chosen, model = supervised.fit(train, kind, **options)
    assert chosen["C"] in supervised.PENALTIES[kind] and chosen["accuracy"] > 0.85
    # the accuracy of the chosen candidate, one fold after the other
    fold = {r["obs_id"]: r["fold"] for r in supervised.folded(train, 5, "obs_id").collect()}
    right = []
    for f in range(5):
        learn = train.join(spark.createDataFrame([(i, v) for i, v in fold.items()], "obs_id long, f int"), "obs_id")
        _, one = supervised.fit(learn.where(F.col("f") != f), kind, grid=(chosen["C"],), gammas=(chosen["gamma"],), **options)
        held = [i for i, v in fold.items() if v == f]
        right.append(np.mean(one.prob(x[held]).argmax(1) == truth[held]))
    assert np.mean(right) == pytest.approx(chosen["accuracy"], abs=0.011)
    got = supervised.predict(test, model).collect()
    assert np.mean([r["pred"] == r["truth"] for r in got]) > 0.85 and all(abs(sum(r["prob"]) - 1) < 1e-9 for r in got)


def test_odd_training_sets(spark):
    schema = "obs_id long, truth int, x array<double>"
    one = spark.createDataFrame([(i, 1, [1.0, 2.0]) for i in range(6)] + [(9, None, [0.0, 0.0])], schema)
    for kind in supervised.KINDS:  # one class, constant columns, a row without a label
        assert {r["pred"] for r in supervised.fit_predict(one, kind, max_iter=3).collect()} == {1}
    with pytest.raises(ValueError):
        supervised.fit(spark.createDataFrame([], schema), "logistic")


@pytest.mark.parametrize(("name", "fits"), [("k2_diametrical", 1), ("m10_normal_lowrank_fit", 2), ("i8_rank_growth", 2), ("h8_hmm_fit", 2)])
def test_registered_fits_run_to_their_stopping_rule(spark, monkeypatch, name, fits):
    seen = []
    for module in (kmeans, mixture, hmm):

        def short(*args, fit=module.fit, **options):
            given = inspect.signature(fit).bind(*args, **options)
            given.apply_defaults()
            # of starts by K-means the limit is the start's own
            seen.append((fit.__module__, given.arguments["max_iter"], given.arguments.get("num_comparison", 0)))
            return fit(*given.args[: list(given.arguments).index("max_iter")], max_iter=1)

        monkeypatch.setattr(module, "fit", short)
    registry.QUERIES[name](spark, SF)
    assert len(seen) >= fits
    assert all(limit >= 100 and limit > passes for _, limit, passes in seen)


def test_permutations_and_ranks_are_the_surveyed(spark, monkeypatch):
    seen = {}
    for module, attr in ((stats, "permutation_blocks"), (sweep, "rank_sweep")):

        def noted(*args, f=getattr(module, attr), **options):
            given = inspect.signature(f).bind(*args, **options)
            given.apply_defaults()
            seen.update(given.arguments)
            return spark.range(1)

        monkeypatch.setattr(module, attr, noted)
    for name in ("t5_permutation", "c5_rank_sweep"):
        registry.QUERIES[name](spark, SF)
    # rank 100 does not exist on 64 places
    assert (seen["n"], seen["ranks"], seen["inner"]) == (1000, (1, 5, 10, 25, 50), 10)


def test_wilcoxon_equals_brute_force(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("double(l_quantity) AS a", "double(l_discount) * 500 AS b").toPandas()
    d = (li["a"] - li["b"])[lambda v: v != 0].to_numpy()
    size, place, count = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    n, plus, minus = len(d), rank[d > 0].sum(), rank[d < 0].sum()
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (count**3 - count).sum() / 48)
    z = (min(plus, minus) - n * (n + 1) / 4) / spread
    got = registry.QUERIES["t4_wilcoxon"](spark, SF).first()
    assert (got["n"], got["plus"], got["minus"]) == (n, plus, minus)
    assert (got["z"], got["p"]) == pytest.approx((z, math.erfc(abs(z) / math.sqrt(2))), abs=1e-5)


def test_bandpass_equals_convolution_and_passes_its_band():
    b, a = filters.butter_bandpass(2, 0.03, 0.07, 1 / 0.72)
    gain = lambda f: abs(np.polyval(b[::-1], z := np.exp(-2j * np.pi * f * 0.72)) / np.polyval(a[::-1], z))
    assert gain(np.sqrt(0.03 * 0.07)) == pytest.approx(1, abs=0.02) and gain(0.03) == pytest.approx(0.5**0.5, abs=1e-6) and gain(0.07) == pytest.approx(0.5**0.5, abs=1e-6)
    assert gain(0.005) < 0.05 and gain(0.4) < 0.05
    x = np.random.default_rng(4).normal(size=300)
    # the filter's answer to one impulse, folded with the signal, from rest
    impulse = filters._run(b, a, np.eye(1, 300)[0], np.zeros(len(a) - 1))
    np.testing.assert_allclose(filters._run(b, a, x, np.zeros(len(a) - 1)), np.convolve(impulse, x)[:300], atol=1e-10)
    np.testing.assert_allclose(filters.filtfilt(b, a, x), filters.filtfilt(b, a, x[::-1])[::-1], atol=0.2)
    assert filters.reflected(np.arange(5.0), 2).tolist() == [2, 1, 0, 1, 2, 3, 4, 3, 2]


def test_signal_queries_without_sql_equal_numpy(spark):
    rows = fixtures.series(spark, SF).where("subject = 3 and session = 1").toPandas()
    wide = rows.pivot(index="t", columns="channel", values="value").sort_index()
    pick = lambda name: registry.QUERIES[name](spark, SF).where("subject = 3 and session = 1").toPandas().pivot(index="t", columns="channel", values="value").sort_index().to_numpy()
    b, a = filters.butter_bandpass(2, 0.03, 0.07, 1 / 0.72)
    n = min(100, len(wide) - 1)
    expected = np.stack([filters.filtfilt(b, a, np.pad(c, n, mode="reflect"))[n : n + len(c)] for c in wide.to_numpy().T], 1)
    np.testing.assert_allclose(pick("p8_bandpass"), expected, atol=1e-6)
    # another phase for each frequency keeps the energy
    np.testing.assert_allclose((pick("p14_randomise_phase") ** 2).sum(0), (wide.to_numpy() ** 2).sum(0), rtol=1e-3)
    made = pick("p15_phase_controlled")
    np.testing.assert_allclose(made.mean(0), 0, atol=1e-5)
    x = np.array([r["x"] for r in fixtures.observations(spark, SF).select("x").collect()])
    s = np.linalg.svd(x, compute_uv=False) ** 2
    got = registry.QUERIES["p29_explained"](spark, SF).orderBy("component").toPandas()["share"].to_numpy()
    np.testing.assert_allclose(got, np.cumsum(s) / s.sum() * 100)


def test_channels_of_a_window_share_their_phases():
    t = np.arange(1200)
    x = [np.sin(t / 9 + c) + 0.3 * np.cos(t / 23 * (c % 3 + 1)) for c in range(20)]
    y = np.array([signal.controlled(v, c, 20, 5, 0, 7) for c, v in enumerate(x)])
    again = np.array([signal.controlled(v, c, 20, 5, 0, 8) for c, v in enumerate(x)])
    # blocks of four channels; in its own window a channel is the same in every scan, elsewhere it isn't
    for c in range(20):
        own = slice(240 * (c // 4), 240 * (c // 4 + 1))
        differ = np.abs((y[c] - y[c].mean()) - (again[c] - again[c].mean()))
        assert np.ptp(y[c][own] - again[c][own]) < 1e-9 and np.median(differ) > 1e-3


def test_sweeps_give_their_rows(spark):
    make = lambda noise, seed: signal.coherence_frames(signal.noisy_phases(spark, [[0.0, 2.0, 4.0], [0.0, 1.0, 5.0]], 60, noise, seed)).select("obs_id", "truth", "u1", "u2")
    rows = sweep.noise_sweep(make, (0.2, 3.0), "MACG", 2, repeats=1, init="gc").toPandas()
    assert len(rows) == 4 and rows.query("level == 0")["NMI"].min() > 0.8 > rows.query("level == 1")["NMI"].max()
    rows = sweep.cluster_sweep(make(0.2, 0), "grassmann", 2, inner=2).toPandas()
    assert len(rows) == 4 and rows["NMI"].max() > 0.9
    sets = {name: make(0.2, k).withColumn("subject", F.col("obs_id") % 3) for k, name in enumerate(("train", "test1"))}
    rows = sweep.run(sets, "MACG", 2, init="gc")[1].toPandas()
    assert len(rows) == 6 and rows["accuracy"].min() > 0.9 and rows["NMI"].min() > 0.6


def test_layouts():
    assert hmm.layout(12) == [12] and hmm.layout(12, 4) == [4, 4, 4] and hmm.layout(12, [1, 5]) == [1, 5, 1, 5]
    with pytest.raises(ValueError):
        hmm.layout(12, 5)


def test_matrices_results_and_posteriors_survive_their_files(spark, tmp_path):
    cells = spark.createDataFrame([(t, c, t * 10.5 + c) for t in range(300) for c in range(3)], "t long, channel int, value double")
    files.write_matrix(cells, str(tmp_path / "out"))
    rows = lambda df: sorted(map(tuple, df.select("t", "channel", "value").collect()))
    (tmp_path / "one.csv").write_text("\n".join(",".join(str(t * 10.5 + c) for c in range(3)) for t in range(300)) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert rows(files.read_matrix(spark, str(tmp_path / "one.csv"))) == rows(cells)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == sorted((tmp_path / "one.csv").read_text().split())
    posts = spark.createDataFrame([(i, [0.1 * i, 1 - 0.1 * i]) for i in range(5)], "obs_id long, post array<double>")
    files.write_posterior(posts, str(tmp_path / "post"))
    assert sorted(map(tuple, files.read_posterior(spark, str(tmp_path / "post")).collect())) == sorted(map(tuple, posts.collect()))
    done = spark.createDataFrame([(1, 0), (1, 1), (5, 0)], "rank int, inner int")
    files.append_results(done, str(tmp_path / "res"))
    wanted = spark.createDataFrame([(r, i) for r in (1, 5) for i in (0, 1)], "rank int, inner int")
    assert [tuple(r) for r in files.unfinished(spark.read.parquet(str(tmp_path / "res")), wanted, ["rank", "inner"]).collect()] == [(5, 1)]
