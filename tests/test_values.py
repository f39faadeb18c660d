"""Updates, starts and constants against their definitions, by numpy on small arrays."""

import math

import numpy as np
import pytest
from test_training import _data, _family, local

from phasorlake.functions import special
from phasorlake.operators import gradient, kmeans, mixture
from phasorlake.operators.families import Family, low_rank, seeded_low_rank

LOW = ["ACG", "Complex_ACG", "MACG", "SingularWishart", "Normal", "Complex_Normal", "Watson", "Complex_Watson"]


def _grouped(name, n=400, seed=2):
    """Rows that spread along another direction in each half."""
    rng = np.random.default_rng(seed)
    x = _data("Normal" if not name.startswith("Complex") else "Complex_Normal", rng, n)
    if name in ("MACG", "SingularWishart"):
        x = rng.normal(size=(n, 5, 2))
    x[: n // 2, 0] *= 4
    x[n // 2 :, 1] *= 4
    if name in ("MACG", "SingularWishart"):
        x = np.linalg.qr(x)[0]
        return x * np.sqrt(5 / 2) if name == "SingularWishart" else x
    return x if name.endswith("Normal") else x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("name", LOW)
def test_fits_end_where_the_gradient_is_zero(name):
    family, x = _family(name, 1), _grouped(name)
    start = family.uniform(2, 1)
    if "Watson" in name:
        start["kappa"] = np.array([2.0, 2.0])
    model = local(mixture.training(family, start, 1e-15, 4_000, 40), x)
    got = mixture.em_sums(mixture.em_ask(family, model.theta).kernel(x, None), family)
    free = gradient.to_free(family, model.theta)
    for key, value in gradient.emission(family, free, model.theta, got["weight"], got["moment"]).items():
        assert np.abs(value).max() < 2e-3 * len(x), (key, value)
    np.testing.assert_allclose(got["weight"] / len(x), model.theta["pi"], atol=1e-4)


@pytest.mark.parametrize("name", ["SingularWishart", "Normal", "Complex_Normal"])
def test_low_rank_step_solves_its_equations(name):
    """M and gamma of one update reproduce themselves through S M D^-1 and the trace of what M leaves of S."""
    family, x = _family(name, 2), _grouped(name)
    beta = np.random.default_rng(1).dirichlet([1, 1], len(x))
    q = family.q
    theta = family.finish(family.moments(x, beta, None), beta.sum(0), None)
    for k in range(2):
        flat = x if x.ndim == 2 else np.concatenate([x[:, :, 0], x[:, :, 1]])
        weight = beta[:, k] if x.ndim == 2 else np.tile(beta[:, k], 2)
        s = (flat * weight[:, None]).T @ flat.conj()
        m, gamma = theta["M"][k] / np.sqrt(theta["gamma"][k]), float(theta["gamma"][k])
        d = np.linalg.inv(np.eye(2) + m.conj().T @ m)
        np.testing.assert_allclose(s @ m @ d / (gamma * q * beta[:, k].sum()), m, atol=1e-8)
        rest = (np.trace(s) - np.trace(m @ d @ m.conj().T @ s)).real / (5 * q * beta[:, k].sum())
        assert rest == pytest.approx(gamma)


@pytest.mark.parametrize("kappa", [-30.0, -1.5, 0.4, 8.0, 60.0])
def test_watson_step_finds_direction_and_concentration(kappa):
    family = Family("Watson", (4,))
    ratio = special.kummer_ratio(0.5, 2.0, kappa)
    axis = np.array([0.6, 0.8, 0, 0])
    moment = ratio * np.outer(axis, axis) + (1 - ratio) / 3 * (np.eye(4) - np.outer(axis, axis))
    got = family.finish(moment[None] * 50, np.array([50.0]), None)
    assert float(got["kappa"][0]) == pytest.approx(kappa, rel=1e-5) and abs(got["mu"][0] @ axis) == pytest.approx(1)


@pytest.mark.parametrize(("a", "c", "x"), [(0.5, 2.0, 3.0), (0.5, 32.0, 40.0), (1.0, 5.0, -7.0), (0.5, 1.5, 0.01)])
def test_kummer_equals_its_integral(a, c, x):
    """Gamma(c) / (Gamma(a) Gamma(c-a)) times the integral of e^(xt) t^(a-1) (1-t)^(c-a-1), with t = sin^2."""
    h = (np.arange(400_000) + 0.5) / 400_000 * np.pi / 2
    s, o = np.sin(h) ** 2, np.cos(h) ** 2
    f = np.exp(x * s) * s ** (a - 0.5) * o ** (c - a - 0.5) * 2
    value = math.log(f.mean() * np.pi / 2) + math.lgamma(c) - math.lgamma(a) - math.lgamma(c - a)
    assert special.log_kummer(a, c, x) == pytest.approx(value, abs=1e-8)


def test_watson_density_integrates_to_one_over_lines():
    family = Family("Watson", (3,))
    theta = {"pi": np.ones(1), "mu": np.array([[0.0, 0, 1]]), "kappa": np.array([5.0])}
    z = (np.arange(20_000) + 0.5) / 10_000 - 1  # equal areas of the sphere
    x = np.stack([np.sqrt(1 - z**2), 0 * z, z], 1)
    assert np.exp(family.log_pdf(x, theta)).mean() * 4 * np.pi == pytest.approx(1, rel=1e-5)


def test_wishart_constant_is_its_sum():
    p, q = 5, 2
    inner = q * (q - 1) / 4 * math.log(math.pi) + math.lgamma(2) + math.lgamma(1.5)
    assert Family("SingularWishart", (p, q)).wishart_constant() == pytest.approx(-3 * math.log(math.pi) - 5 * math.log(2) - inner)


def test_low_rank_starts_equal_singular_values():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6)) * np.array([5, 3, 1, 1, 1, 1])
    u, s, _ = np.linalg.svd(x.T, full_matrices=False)
    m, gamma = seeded_low_rank(x.T @ x, 60, 2)
    noise = s[2:].mean()
    np.testing.assert_allclose(np.abs(m), np.abs(u[:, :2] * np.sqrt((s[:2] - noise) / noise)), rtol=1e-6)
    assert gamma == pytest.approx(noise / 60)
    full, one = seeded_low_rank(x.T @ x, 60, 6)
    np.testing.assert_allclose(full @ full.T, (u * s) @ u.T, atol=1e-6)
    assert one == 1.0
    m, gamma = low_rank(x.T @ x / 60, 2)
    values = s**2 / 60
    assert gamma == pytest.approx(values[2:].mean())
    np.testing.assert_allclose(np.linalg.eigvalsh(m @ m.T)[-2:], (values[:2] - gamma)[::-1], rtol=1e-8)


@pytest.mark.parametrize("name", ["ACG", "Normal", "MACG", "Complex_ACG"])
def test_growth_equals_the_residuals_singular_vectors(name):
    family, x = _family(name, 3), _grouped(name)
    theta = _family(name, 1).uniform(2, 0)
    wide = local(mixture.growing(family, theta), x)["M"]
    post = mixture.weights(family.log_pdf(x, theta) + np.log(theta["pi"]))[1]
    for k in range(2):
        m, ridge = theta["M"][k], 1.0
        if "gamma" not in theta:
            m = m * np.sqrt(1 / (1 + (np.abs(m) ** 2).sum() / 5))
        rows = x if x.ndim == 2 else np.concatenate([x[:, :, 0], x[:, :, 1]])
        beta = post[:, k] if x.ndim == 2 else np.tile(post[:, k], 2)
        data = (rows * beta[:, None]).T
        left = data - m @ np.linalg.solve(m.conj().T @ m + ridge * np.eye(1), m.conj().T @ data)
        u, s, _ = np.linalg.svd(left, full_matrices=False)
        noise = s[2:].mean()
        np.testing.assert_allclose(wide[k][:, :1], m)
        np.testing.assert_allclose(np.abs(wide[k][:, 1:].conj().T @ u[:, :2]), np.diag(np.sqrt((s[:2] - noise) / noise)), atol=1e-5)


def test_full_rank_start_has_its_centroid_and_trace():
    family = Family("ACG", (4,))
    centres = np.eye(4)[:2]
    theta = family.from_parts(np.stack([np.eye(4)] * 2), np.array([30.0, 10.0]), centres)
    np.testing.assert_allclose(theta["pi"], [0.75, 0.25])
    for k in range(2):
        np.testing.assert_allclose(theta["Psi"][k], (np.outer(centres[k], centres[k]) + np.eye(4)) * 4 / 5)


@pytest.mark.parametrize("method", ["hyperplane", "grassmann", "weighted_grassmann"])
def test_centres_equal_stacked_singular_vectors(method):
    rng = np.random.default_rng(4)
    rows = np.linalg.qr(rng.normal(size=(30, 6, 2)) + 3 * np.eye(6)[:, :2])[0]
    stacked = np.concatenate(list(rows), 1) if method != "hyperplane" else rows[:, :, 0].T
    u, s, _ = np.linalg.svd(stacked, full_matrices=False)
    got = kmeans.update(stacked @ stacked.T, method, 2)
    if method == "hyperplane":
        assert abs(got @ u[:, 0]) == pytest.approx(1)
        return
    expected = u[:, :2] if method == "grassmann" else u[:, :2] * np.sqrt(s[:2] / s[:2].sum() * 6)
    np.testing.assert_allclose(np.abs(got.T @ u[:, :2]), np.abs(expected.T @ u[:, :2]), atol=1e-7)


def test_seeds_go_by_distance(spark):
    """Rows at no distance from the centres so far are never taken; others in proportion to theirs."""
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40 + i, [0.0, 1.0]) for i in range(2)] + [(50, [math.sqrt(0.5), math.sqrt(0.5)])]
    df = spark.createDataFrame(rows, "obs_id long, x array<double>").coalesce(1).cache()
    second = []
    for seed in range(24):
        c = kmeans.spread_centres(df, 2, "diametrical", seed)
        assert abs(c[0] @ c[1]) < 0.999
        if abs(c[0][0]) > 0.999:
            second.append(abs(c[1][1]) > 0.999)
    # two rows at distance 1 against one at a half: four of five
    assert 0.5 < np.mean(second) <= 1.0
