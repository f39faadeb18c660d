import itertools

import numpy as np
import pytest

from phasorlake.operators import landmarks, supervised


def _frame(spark, truth, x):
    return spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(truth, x))], "obs_id long, truth int, x array<double>")


def _exact(kernel, y, most, steps=200_000, tol=1e-6):
    """Dual of a machine with an intercept: pairs of the worst violation, one after the other."""
    a, slope = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        up = ((y > 0) & (a < most - 1e-12)) | ((y < 0) & (a > 1e-12))
        low = ((y > 0) & (a > 1e-12)) | ((y < 0) & (a < most - 1e-12))
        s = -y * slope
        i, j = np.where(up, s, -np.inf).argmax(), np.where(low, s, np.inf).argmin()
        if s[i] - s[j] < tol:
            break
        step = (s[i] - s[j]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min(step, most[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else most[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        slope += y * (kernel[:, i] - kernel[:, j]) * step
    s = -y * slope
    return a * y, (s[i] + s[j]) / 2


def test_predictions_equal_an_exact_solver(spark):
    """500 rows learnt from, 300 held out; three classes that overlap."""
    rng = np.random.default_rng(8)
    truth = rng.integers(0, 3, 800)
    x = rng.normal(size=(800, 5)) + 1.6 * np.eye(3, 5)[truth] * rng.choice([-1, 1], 800)[:, None]
    learn = np.arange(800) < 500
    got, model = supervised.fit(_frame(spark, truth[learn], x[learn]), "rbf-svm", grid=(1.0,), gammas=("scale",), width=500, max_iter=250, tol=1e-10, corner=0.004)
    assert got["error"] <= landmarks.TOLERANCE
    mean, sd = x[learn].mean(0), x[learn].std(0)
    z = (x - mean) / sd
    kernel = np.exp(-0.2 * ((z[:, None] - z[None]) ** 2).sum(2))
    count = np.bincount(truth[learn])
    votes, scores = np.zeros((800, 3)), []
    for a, b in itertools.combinations(range(3), 2):
        at = np.flatnonzero(learn & ((truth == a) | (truth == b)))
        y = np.where(truth[at] == a, 1.0, -1.0)
        coef, intercept = _exact(kernel[np.ix_(at, at)], y, 500 / (3 * count[truth[at]]))
        scores.append(kernel[:, at] @ coef + intercept)
        votes[:, a] += scores[-1] > 0
        votes[:, b] += scores[-1] <= 0
    np.testing.assert_allclose(model.wide(x) @ model.beta, np.stack(scores, 1), atol=0.02)
    clear = np.abs(np.stack(scores, 1)).min(1) > 0.02
    equal = model.prob(x).argmax(1) == votes.argmax(1)
    assert equal[clear].all() and equal[~learn].mean() >= 0.99
    assert (model.prob(x).argmax(1) == truth)[~learn].mean() > 0.5


def test_landmarks_explain_the_kernel(spark):
    """A third of the rows alike: no row twice, the error as reported and near one row after the other's, the same landmarks
    whatever the partitions."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3))
    x[::3] = x[0]
    df = _frame(spark, np.zeros(900), x)
    mean, scale = x.mean(0), 1 / x.std(0)
    z = (x - mean) * scale
    gammas = [0.05, 0.5]
    several = [landmarks.pick(df.repartition(n), gammas, mean, scale, 80) for n in (1, 5, 70)]
    for marks, gamma in zip(several[0], gammas):
        assert len(marks.rows) <= 80 and len(np.unique(marks.rows, axis=0)) == len(marks.rows)
        phi = marks.features(mean, scale)(z)
        kernel = landmarks.radial(z, z, gamma)
        assert np.abs(kernel - phi @ phi.T).max() <= marks.error + 1e-6
        assert (1 - (phi**2).sum(1)).max() == pytest.approx(marks.error, abs=2e-6)
        _, residual = landmarks.greedy(z, None, gamma, 80)
        assert marks.error <= max(10 * residual[-1], 2e-6)
    for other in several[1:]:
        for a, b in zip(several[0], other):
            np.testing.assert_array_equal(a.rows, b.rows)
    every = landmarks.pick(df, [2.0], mean, scale, 1000)[0]
    left = np.linalg.eigvalsh(landmarks.radial(z, z, 2.0)).max() * 1e-9
    assert every.error <= landmarks.TOLERANCE + left and len(every.rows) <= 601
