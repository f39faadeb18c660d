"""Runs on phase-controlled scans, small-sample tests."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasorlake.functions import special
from phasorlake.operators import hmm, stats
from phasorlake.plans import phase_runs


@pytest.fixture(scope="module")
def scans(spark):
    """Three scans of 60 rows, three windows each, a direction of its own in every window."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(180, 4))
    x[np.arange(180), np.arange(180) % 60 // 20] += 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, i % 60 // 20, v.tolist()) for i, v in enumerate(x)], "obs_id long, truth int, x array<double>")
    return phase_runs.scan_slices(df, 60)


OPTIONS = {"tol": 1e-4, "num_comparison": 5, "max_iter": 40}


def _rows(df):
    return {tuple(r[c] for c in phase_runs.KEYS): r for r in df.collect()}


def test_scans_are_stretches_of_ids(scans):
    for i, name in enumerate(phase_runs.SETS):
        got = scans[name].agg(F.min("obs_id"), F.max("obs_id"), F.min("t"), F.max("t"), F.max("seq_id"), F.count("*")).first()
        assert tuple(got) == (60 * i, 60 * i + 59, 0, 59, i, 60)
    plan = scans["test1"]._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 60" in plan and "< 120" in plan


def test_settings_are_the_surveyed():
    every = phase_runs.settings("ACG", phase_runs.EXPERIMENTS, (1, 5), (0.0, 0.1), 2)
    assert len(every) == 4 * 2 * 2 * 3 and sum(s.HMM for s in every) == 16 and all(s.LR for s in every if s.HMM)
    assert {s.experiment for s in phase_runs.settings("Watson", phase_runs.EXPERIMENTS, (1, 5), (0.0,), 1)} == {"random", "Kmeans", "Kmeansseg"}
    assert phase_runs.start_of("SingularWishart", "ALL") == "wgc_seg" and phase_runs.start_of("Complex_Normal", "Kmeans") == "ls"
    with pytest.raises(ValueError):
        phase_runs.settings("ACG", ("other",), (1,), (0.0,), 1)


def test_a_sweep_equals_its_runs(scans):
    got = _rows(phase_runs.sweep(scans, "ACG", 3, ("Kmeans", "ALL"), (1, 2), (0.0, 0.1), 1, **OPTIONS))
    assert len(got) == 2 * 2 * 3
    assert got["ACG", "Kmeans", 1, 0.0, 0, False]["test2_NMI"] > 0.5
    models = {}
    for s in phase_runs.settings("ACG", ("Kmeans", "ALL"), (1, 2), (0.0, 0.1), 1, with_hmm=False):
        before = models.get((s.LR, 1)) if s.experiment == "ALL" and s.rank == 2 else None
        model, row = phase_runs.run(scans, s, 3, before and before.theta, **OPTIONS)
        if s.experiment == "ALL":
            models[s.LR, s.rank] = model
        for name, value in row.items():
            found = got[tuple(getattr(s, c) for c in phase_runs.KEYS)][name]
            assert found == pytest.approx(value, rel=1e-3, abs=1e-6) if isinstance(value, float) else found == value, (s, name)
    chained = got["ACG", "ALL", 1, 0.1, 0, True]
    alone = hmm.fit(scans["train"], models[0.1, 1], 3, 1e-4, 40, 5, 0.1)
    assert chained["init_method"] == "no" and chained["train_loglik"] == pytest.approx(alone.curve[-1], rel=1e-3)
    for name, df in scans.items():
        loglik, nmi = phase_runs.scored_paths(df, alone, 3)
        assert chained[f"{name}_NMI"] == pytest.approx(nmi, abs=1e-3) and (name == "train" or chained[f"{name}_loglik"] == pytest.approx(loglik, rel=1e-3))
    # windows last, so neighbours tell more than a row alone
    assert chained["test1_loglik"] > got["ACG", "ALL", 1, 0.1, 0, False]["test1_loglik"]


def test_a_resumed_sweep_equals_a_whole_one(scans, tmp_path):
    args = (scans, "ACG", 3, ("Kmeans", "ALL"))
    whole = _rows(phase_runs.sweep(*args, (1, 2), (0.0,), 2, **OPTIONS))
    path = str(tmp_path / "runs")
    phase_runs.sweep(*args, (1,), (0.0,), 1, path, **OPTIONS)
    first = _rows(phase_runs.sweep(*args, (1, 2), (0.0,), 2, path, **OPTIONS))
    again = _rows(phase_runs.sweep(*args, (1, 2), (0.0,), 2, path, **OPTIONS))
    assert first.keys() == whole.keys() and first == again
    for key, row in whole.items():
        for name, value in row.asDict().items():
            assert first[key][name] == pytest.approx(value, rel=1e-3, abs=1e-6) if isinstance(value, float) else first[key][name] == value, (key, name)


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_signed_rank_distribution_counts_all_signs(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    for w in range(n * (n + 1) // 4 + 1):
        assert special.signed_rank_two_sided(n, w) == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / 2**n))


def test_wilcoxon_chooses_its_distribution(spark):
    pairs = lambda d: spark.createDataFrame([(float(v), 0.0) for v in d], "a double, b double")
    whole = stats.wilcoxon(pairs([1, 2, 3, 4, 5, -6, 7, 8]), "a", "b")
    assert (whole["plus"], whole["minus"], whole["p"]) == (30, 6, pytest.approx(special.signed_rank_two_sided(8, 6)))
    for other in ([1, 2, 3, 4, 5, -6, 7, 7], [1, 2, 3, 4, 5, -6, 7, 8, 0], range(1, 60)):  # equal sizes, a zero, many
        got = stats.wilcoxon(pairs(other), "a", "b")
        assert got["p"] == pytest.approx(special.normal_two_sided(got["z"]))
    assert stats.wilcoxon(pairs(range(1, 60)), "a", "b", method="exact")["p"] == pytest.approx(2 / 2**59)
    assert stats.wilcoxon(pairs([0, 0]), "a", "b")["p"] == 1 and stats.wilcoxon(pairs([]), "a", "b")["n"] == 0


def test_exact_wilcoxon_of_copied_rows_equals_its_sql(spark, duck, tmp_path):
    """Vectors that come twice, six places apart, so that groups' differences are equal."""
    from phasorlake.plans import registry

    duck.execute(f"copy (select vec_id, (select embedding from embeddings o where o.vec_id = e.vec_id % 6) as embedding, label from embeddings e where vec_id < 12) to '{tmp_path}/embeddings.parquet' (format parquet)")
    got = registry.QUERIES["t4_exact_wilcoxon"](spark, str(tmp_path)).first()
    sql = registry.ORACLE_SQL["t4_exact_wilcoxon"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet'")
    assert tuple(got) == pytest.approx(duck.execute(sql).fetchone(), abs=1e-9)
