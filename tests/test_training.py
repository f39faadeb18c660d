"""Fits that share passes, gradient training, sequences in pieces."""

import itertools
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from phasorlake.operators import gradient, hmm, kernels, mixture
from phasorlake.operators.families import Family
from phasorlake.plans import engine, fixtures, sweep


def local(fit, x):
    """Run a fit on one array, without Spark."""
    sums = None
    while True:
        try:
            ask = fit.send(sums)
        except StopIteration as end:
            return end.value
        sums = ask.kernel(x, None)


def loglik(family, theta, x):
    return float(mixture.weights(family.log_pdf(x, theta) + np.log(theta["pi"]))[0].sum())


def _data(name, rng, n=40, p=5):
    if name in ("MACG", "SingularWishart"):
        x = np.linalg.qr(rng.normal(size=(n, p, 2)))[0]
        return x * np.sqrt(p / 2) if name == "SingularWishart" else x
    x = rng.normal(size=(n, p)) + (1j * rng.normal(size=(n, p)) if name.startswith("Complex") else 0)
    return x if name.endswith("Normal") else x / np.linalg.norm(x, axis=1, keepdims=True)


FAMILIES = ["Watson", "Complex_Watson", "ACG", "Complex_ACG", "MACG", "SingularWishart", "Normal", "Complex_Normal"]


def _family(name, rank=2, tied=False):
    base, is_complex = engine.MIXTURES[name]
    return Family(base, (5, 2) if base in ("MACG", "SingularWishart") else (5,), is_complex, 0 if base == "Watson" else rank, tied)


@pytest.mark.parametrize("tied", [False, True])
@pytest.mark.parametrize("name", FAMILIES)
def test_gradients_equal_finite_differences(name, tied):
    rng = np.random.default_rng(1)
    family, x = _family(name, tied=tied), _data(name, rng)
    theta = family.uniform(3, 4) | {"pi": np.array([0.2, 0.5, 0.3])}
    if name.endswith("Watson"):
        theta["kappa"] = np.array([3.0, -2.0, 0.7])
    if "gamma" in theta and not tied:
        theta["gamma"] = np.array([0.4, 1.0, 2.5])
    free = gradient.to_free(family, theta)
    if "mu" in free:
        free["mu"] = free["mu"] * 1.7  # its length is free
    got = mixture.em_sums(mixture.em_ask(family, theta).kernel(x, None), family)
    up = gradient.emission(family, free, theta, got["weight"], got["moment"]) | {"pi": got["weight"] - len(x) * theta["pi"]}
    at = lambda f: loglik(family, gradient.to_natural(family, f), x)
    for key, value in free.items():
        flat = np.ascontiguousarray(value).view(float).reshape(-1)
        expected = []
        for i in range(len(flat)):
            ends = []
            for h in (1e-6, -1e-6):
                moved = flat.copy()
                moved[i] += h
                ends.append(at(free | {key: moved.view(value.dtype).reshape(value.shape)}))
            expected.append((ends[0] - ends[1]) / 2e-6)
        np.testing.assert_allclose(np.ascontiguousarray(up[key], value.dtype).view(float).reshape(-1), expected, rtol=2e-5, atol=2e-5, err_msg=key)


def test_softplus_turns_round():
    v = np.array([1e-9, 0.3, 1.0, 50.0])
    np.testing.assert_allclose(gradient.softplus(gradient.unsoftplus(v)), v)


@pytest.mark.parametrize("name", ["ACG", "Normal", "Watson", "MACG"])
def test_gradient_steps_reach_the_optimum_of_em(name):
    rng = np.random.default_rng(7)
    family, x = _family(name, 1), _data(name, rng, 300)
    # two clear groups
    if x.ndim == 2:
        x[:150, 0] += 3
        x[150:, 1] += 3
        x = x if name == "Normal" else x / np.linalg.norm(x, axis=1, keepdims=True)
    else:
        raw = rng.normal(size=x.shape)
        raw[:150, 0, 0] += 5
        raw[150:, 1, 0] += 5
        x = np.linalg.qr(raw)[0]
    theta = family.uniform(2, 0)
    em = local(mixture.training(family, theta, 1e-12, 5_000, 10), x)
    run = local(gradient.training(family, em.theta | {"pi": np.array([0.4, 0.6])}, 0.05, 1e-10, 5_000, 50, True), x)
    assert max(run.curve) >= max(em.curve) - 1e-4 * abs(max(em.curve)) and loglik(family, run.theta, x) == pytest.approx(max(run.curve))
    far = local(gradient.training(family, theta, 0.1, 1e-9, 5_000, 50, True), x)
    assert max(far.curve) >= max(em.curve) - 1e-3 * abs(max(em.curve))


def test_training_by_rate_reaches_em_on_embeddings(spark):
    o = fixtures.observations(spark, SF)
    em = engine.train(o, 2, "ACG", rank=2, seed=3)
    steps = engine.train(o, 2, "ACG", rank=2, params=em.theta | {"M": em.theta["M"] * 0.9, "pi": np.array([0.5, 0.5])}, LR=0.1, decrease_lr_on_plateau=True, tol=1e-9)
    assert abs(max(steps.curve) - max(em.curve)) < 1e-4 * abs(max(em.curve))
    assert steps.curve[0] < max(steps.curve) and steps.loglik(o) == pytest.approx(max(steps.curve))


def test_the_rate_is_cut_once():
    adam = gradient.Adam(0.1)
    plateau = gradient.Plateau(adam, 1e-3, 3, True)
    assert not plateau.reached([1.0, 2.0, 3.0]) and not plateau.reached([1.0, 2.0, 3.0, 3.0001]) and adam.lr == pytest.approx(0.01)
    assert plateau.reached([1.0, 2.0, 3.0, 3.0001]) and not gradient.Plateau(adam, 1e-3, 2, False).reached([1.0, 2.0, 4.0])
    assert gradient.Plateau(adam, 1e-3, 2, False).reached([1.0, 4.0, 2.0])


def test_full_rank_has_no_gradient_training(spark):
    with pytest.raises(ValueError, match="low-rank"):
        engine.train(fixtures.observations(spark, SF), 2, "ACG", LR=0.1)


# -- fits that share passes -----------------------------------------------------------------------


def test_restarts_together_equal_one_by_one(spark):
    o = fixtures.observations(spark, SF).cache()
    family = Family("ACG", (64,), rank=2)
    one = [mixture.fit(o, family, 2, "uniform", 1e-7, seed=s) for s in range(3)]
    best = mixture.fit(o, family, 2, "uniform", 1e-7, num_repl=3)
    assert max(best.curve) == pytest.approx(max(max(m.curve) for m in one), rel=1e-9)
    assert best.curve == pytest.approx(max(one, key=lambda m: max(m.curve)).curve, rel=1e-9)
    o.unpersist()


def test_stopped_fits_leave_the_pass(spark, monkeypatch):
    df = spark.createDataFrame([([float(i), 1.0],) for i in range(20)], "x array<double>").repartition(3).cache()

    def counts(n):
        seen = []
        for _ in range(n):
            got = yield kernels.Ask(lambda x, _: {"n": np.array([len(x)]), "c_s": x.sum(0) * 1j}, {"n": (1,), "c_s": (2,)})
            seen.append((got["n"][0], got["c_s"].tolist()))
        return seen

    passes, asked = [], kernels.asked
    monkeypatch.setattr(kernels, "asked", lambda df, asks, extra: passes.append(len(asks)) or asked(df, asks, extra))
    expected = (20.0, [190j, 20j])
    assert kernels.together(df, [counts(1), counts(3), counts(0), counts(2)]) == [[expected], [expected] * 3, [], [expected] * 2]
    assert passes == [3, 2, 1]
    passes.clear()
    monkeypatch.setattr(kernels, "WIDE", 6)
    assert kernels.together(df, [counts(2), counts(1)]) == [[expected] * 2, [expected]] and passes == [1, 1, 1]
    # whether the driver or Spark adds up
    monkeypatch.setattr(kernels, "FEW", 0)
    assert kernels.together(df, [counts(1)]) == [[expected]]
    df.unpersist()


def test_rank_sweep_equals_fits_one_by_one(spark):
    x = np.random.default_rng(4).normal(size=(240, 6))
    x[::2, :2] *= 4
    x[1::2, 2:4] *= 4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = spark.createDataFrame([(i, i // 5 % 3, v.tolist()) for i, v in enumerate(x)], "obs_id long, subject long, x array<double>")
    sets = {"train": o.where("obs_id < 160"), "test": o.where("obs_id >= 160")}
    options = {"tol": 1e-9, "num_comparison": 10}
    got = {tuple(r)[:-1]: r["loglik"] for r in sweep.rank_sweep(sets, "ACG", (1, 2), (1, 3), inner=2, **options).collect()}
    assert len(got) == 2 * 2 * 2 * 2 * 3
    for k, run in itertools.product((1, 2), (0, 1)):
        model = None
        for rank in (1, 3):
            model = engine.train(sets["train"], k, "ACG", rank=rank, params=model.theta if model else None, seed=run, **options)
            for name, df in sets.items():
                for r in model.score(df).groupBy("subject").agg(F.avg("loglik").alias("l")).collect():
                    assert got["ACG", k, str(rank), run, name, r["subject"]] == pytest.approx(r["l"], abs=1e-4)


def test_given_parameters_are_checked():
    family = Family("Normal", (4,), rank=2)
    good = family.uniform(2, 0)
    mixture.check_params(family, 2, good)
    mixture.check_params(family, 2, good | {"M": good["M"][:, :, :1]})
    for bad in ({"M": good["M"][:1]}, {"M": np.ones((2, 4, 3))}, {"gamma": np.ones(3)}, {"pi": np.array([0.5, 0.6])}, {"M": good["M"] * 1j}):
        with pytest.raises(ValueError):
            mixture.check_params(family, 2, good | bad)
    with pytest.raises(ValueError, match="lacks"):
        mixture.check_params(family, 2, {"pi": good["pi"], "M": good["M"]})


# -- sequences in pieces --------------------------------------------------------------------------

T, DELTA = np.array([[0.8, 0.15, 0.05], [0.2, 0.5, 0.3], [0.0, 0.4, 0.6]]), np.array([0.5, 0.5, 0.0])


@pytest.fixture(scope="module")
def densities(spark):
    """One long sequence and many short ones, with many equal values."""
    rng = np.random.default_rng(8)
    rows = [(s, 10 * i, np.round(rng.normal(size=3), 1).tolist()) for s, n in ((7, 400), *((s, s % 5 + 1) for s in range(8, 60))) for i in range(n)]
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "seq_id int, t long, lp array<double>").cache()


def _plain_forward(lp):
    with np.errstate(divide="ignore"):
        a = np.log(DELTA) + lp[0]
        for row in lp[1:]:
            a = np.logaddexp.reduce(a[:, None] + np.log(T), axis=0) + row
    return np.logaddexp.reduce(a)


def _plain_path(lp):
    with np.errstate(divide="ignore"):
        score, back = np.log(DELTA) + lp[0], []
        for row in lp[1:]:
            step = score[:, None] + np.log(T)
            back.append(step.argmax(0))
            score = step.max(0) + row
    path = [int(score.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def _by_sequence(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["seq_id"], r["t"])):
        out.setdefault(r["seq_id"], []).append(r["lp"])
    return {s: np.array(v) for s, v in out.items()}


@pytest.mark.parametrize("rows", [1, 3, 64, hmm.ROWS])
def test_cut_sequences_have_the_same_likelihoods_and_paths(spark, densities, rows):
    plain = _by_sequence(densities)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # four ranges, so the long one is cut
    try:
        got = {r["seq_id"]: (r["n"], r["loglik"]) for r in hmm.likelihoods(densities, DELTA, T, rows).collect()}
        paths = hmm.viterbi(densities, DELTA, T, rows).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {s: n for s, (n, _) in got.items()} == {s: len(lp) for s, lp in plain.items()}
    for s, lp in plain.items():
        assert got[s][1] == pytest.approx(_plain_forward(lp), rel=1e-12)
    found = {}
    for r in sorted(paths, key=lambda r: (r["seq_id"], r["t"])):
        found.setdefault(r["seq_id"], []).append(r["state"])
    assert found == {s: _plain_path(lp) for s, lp in plain.items()}


@pytest.mark.parametrize("rows", [1, 5, hmm.ROWS])
def test_cut_sequences_have_the_same_transitions(spark, densities, rows):
    df = densities.withColumn("post", F.transform("lp", lambda v: F.exp(v) / F.exp(F.col("lp")[0]) / 3))
    sums, first, n = np.zeros((3, 3)), np.zeros(3), 0
    for lp in _by_sequence(densities).values():
        p = np.exp(lp - lp[:, :1]) / 3
        sums += sum((np.outer(a, b) for a, b in zip(p, p[1:])), np.zeros((3, 3))) / len(p)
        first, n = first + p[0], n + 1
    t, delta = hmm.transitions(df, 3, rows)
    np.testing.assert_allclose(t, sums / sums.sum(1, keepdims=True))
    np.testing.assert_allclose(delta, first / first.sum())


def test_no_rows_give_no_sequences(spark, densities):
    none = densities.where("seq_id < 0")
    assert hmm.likelihoods(none, DELTA, T).collect() == [] and hmm.viterbi(none, DELTA, T).collect() == []


@pytest.fixture(scope="module")
def switching(spark):
    rng = np.random.default_rng(9)
    state, rows = 0, []
    for i in range(240):
        state = state if rng.uniform() < 0.9 else 1 - state
        x = rng.normal(size=3) + np.array([2.5, 0, 0]) * (1 if state else -1) * rng.choice([-1, 1])
        x[state] *= 3
        rows.append((i, 0 if i < 200 else 1 + i // 20, i, (x / np.linalg.norm(x)).tolist()))
    return spark.createDataFrame(rows, "obs_id long, seq_id long, t long, x array<double>").cache()


def test_training_in_pieces_equals_training_whole(switching):
    family = Family("ACG", (3,), rank=1)
    start = mixture.fit(switching, family, 2, "dc", 1e-6)
    whole = hmm.fit(switching, start, 2, max_iter=12)
    assert all(b >= a - 1e-7 * abs(a) for a, b in zip(whole.curve, whole.curve[1:]))
    for rows in (1, 17):
        cut = hmm.fit(switching, start, 2, max_iter=12, rows=rows)
        np.testing.assert_allclose(cut.curve, whole.curve)
        np.testing.assert_allclose(cut.t, whole.t)
        np.testing.assert_allclose(cut.delta, whole.delta)
    total = whole.score(switching).agg(F.sum("loglik")).first()[0]
    assert total == pytest.approx(max(whole.curve))


def test_gradient_training_of_sequences(switching):
    family = Family("ACG", (3,), rank=1)
    start = mixture.fit(switching, family, 2, "dc", 1e-6)
    em = hmm.fit(switching, start, 2, 1e-10, 300, 10)
    steps = hmm.fit(switching, start, 2, 1e-8, 400, 50, 0.05, True)
    assert max(steps.curve) >= max(em.curve) - 2e-3 * abs(max(em.curve))
    assert steps.t.sum(1) == pytest.approx([1, 1]) and math.isclose(steps.delta.sum(), 1)


def test_sequence_gradients_equal_finite_differences(spark, switching):
    family = Family("ACG", (3,), rank=1)
    df = switching.where("t >= 180 and t < 225")
    theta, delta, t = family.uniform(2, 1), np.array([0.3, 0.7]), np.array([[0.7, 0.3], [0.4, 0.6]])
    x = {}
    for r in df.orderBy("seq_id", "t").collect():
        x.setdefault(r["seq_id"], []).append(r["x"])

    def at(delta, t):
        out = 0.0
        for rows in x.values():
            lp = family.log_pdf(np.array(rows), theta)
            a = np.log(delta) + lp[0]
            for row in lp[1:]:
                a = np.logaddexp.reduce(a[:, None] + np.log(t), axis=0) + row
            out += np.logaddexp.reduce(a)
        return out

    got = hmm.cut_up(df, 6).sums([hmm.State(family, theta, np.array([0.5, 0.5]), t), hmm.State(family, theta, delta, t)])[1]
    assert got["loglik"][0] == pytest.approx(at(delta, t))
    up_t, up_d = got["pairs"] - got["pairs"].sum(1, keepdims=True) * t, got["first"] - got["first"].sum() * delta
    for i in range(2):
        for j in range(2):
            move = np.eye(2)[i][:, None] * np.eye(2)[j] * 1e-6
            slope = (at(delta, gradient.soft(np.log(t) + move)) - at(delta, gradient.soft(np.log(t) - move))) / 2e-6
            assert up_t[i, j] == pytest.approx(slope, abs=1e-4)
        slope = (at(gradient.soft(np.log(delta) + np.eye(2)[i] * 1e-6), t) - at(gradient.soft(np.log(delta) - np.eye(2)[i] * 1e-6), t)) / 2e-6
        assert up_d[i] == pytest.approx(slope, abs=1e-4)
