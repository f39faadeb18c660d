from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark import RDD

from phasorlake.operators import kernels, kmeans, landmarks, mixture, supervised
from phasorlake.operators.families import Family
from phasorlake.plans import fixtures


def test_sums_of_a_cached_frame_meet_before_the_driver(spark, monkeypatch):
    def whole(x, _):
        return {"gram_h": np.stack([x.T @ x, 2 * x.T @ x]), "n": np.array([float(len(x))]), "c_one_h": (x.T @ x * (1 + 0j))[None]}

    rows = np.random.default_rng(0).normal(size=(60, 5))
    ask = kernels.Ask(whole, {"gram_h": (2, 5, 5), "n": (1,), "c_one_h": (1, 5, 5)})
    assert ask.size == 2 * 15 + 1 + 2 * 15
    seen, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    for few, meet, piece in ((1 << 13, 64, 1 << 17), (0, 64, 1 << 17), (0, 2, 7)):
        for name, value in (("FEW", few), ("MEET", meet), ("PIECE", piece)):
            monkeypatch.setattr(kernels, name, value)
        df = spark.createDataFrame([(v.tolist(),) for v in rows], "x array<double>").repartition(9).cache()
        seen.clear()
        got = kernels.asked(df, [ask])[0]
        assert np.allclose(got["gram_h"], np.stack([rows.T @ rows, 2 * rows.T @ rows])) and got["n"] == 60
        assert np.allclose(got["c_one_h"], rows.T @ rows)
        numbers = sum(len(raw) // 8 for part in seen for _, raw in part)
        assert numbers == ask.size * (9 if few else 1)
        again = kernels.asked(df, [ask])[0]
        assert all((again[k] == got[k]).all() for k in got)  # the order of the sums is fixed
        kernels.release(df)
        assert not df.is_cached and "_blocks" not in df.__dict__


@pytest.mark.parametrize("name,theta", [("MACG", "M"), ("MACG", "Psi"), ("SingularWishart", "Psi")])
def test_frames_forms_and_moments(name, theta):
    rng = np.random.default_rng(1)
    x, beta = rng.normal(size=(7, 6, 2)), rng.uniform(size=(7, 2))
    m = rng.normal(size=(2, 6, 3))
    cov = np.eye(6) + np.einsum("kpr,ksr->kps", m, m)
    family = Family(name, (6, 2), rank=3 if theta == "M" else 0)
    params = {"pi": np.full(2, 0.5), theta: m if theta == "M" else cov}
    forms = family.forms(x, params)
    for k in range(2):
        form = np.einsum("npq,pr,nrs->nqs", x, np.linalg.inv(cov[k]), x)
        assert np.allclose(forms[k][0], form) and forms[k][1] == pytest.approx(np.linalg.slogdet(cov[k])[1])
        left = np.einsum("npq,nqs->nps", x, np.linalg.inv(form)) if name == "MACG" else x
        expected = np.einsum("n,npq,nrq->pr", beta[:, k], left, x)
        assert np.allclose(family.moments(x, beta, params, forms)[k], expected) and np.allclose(family.moments(x, beta, params)[k], expected)


def test_a_fit_sends_few_numbers_to_the_driver(spark, monkeypatch):
    seen, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: seen.append(collect(self)) or seen[-1])
    o = fixtures.observations(spark, SF).repartition(6)
    fitted = mixture.fit(o, Family("ACG", (64,)), 3, max_iter=4, num_comparison=50)
    assert len(fitted.curve) == 4
    assert max(sum(len(raw) // 8 for _, raw in part) for part in seen) == 3 * 64 * 65 // 2 + 3 + 1  # once, not by partition


@pytest.mark.parametrize("is_complex", [False, True])
def test_a_pass_over_lines_reads_the_rows_for_all_centres_at_once(spark, is_complex, monkeypatch):
    rng = np.random.default_rng(3)
    draw = lambda n: kmeans._normal(rng.normal(size=(n, 5)) + (1j * rng.normal(size=(n, 5)) if is_complex else 0))
    x, centres, before = draw(60), draw(4), draw(4)
    cells = [((v.real.tolist(), v.imag.tolist()),) if is_complex else (v.tolist(),) for v in x]
    df = spark.createDataFrame(cells, "x struct<re: array<double>, im: array<double>>" if is_complex else "x array<double>")
    parts = [(np.abs(x @ c.conj().T) ** 2).argmax(1) for c in (centres, before)]
    sums = np.stack([x[parts[0] == j].T @ (x[parts[0] == j].conj() @ centres[j]) for j in range(4)])
    monkeypatch.setattr(kmeans, "similarities", None)  # one product gives both centres' parts
    got = kmeans.pass_over(df, centres, before, "diametrical")
    assert np.allclose(got["sum"], sums) and got["n"] == 60 and got["changed"] == (parts[0] != parts[1]).sum()
    assert np.isclose(got["obj"], (np.abs(x @ centres.conj().T) ** 2).max(1).sum()) and (got["size"] == np.bincount(parts[0], minlength=4)).all()


@pytest.mark.parametrize("method", ["grassmann", "weighted_grassmann", "hyperplane"])
def test_a_pass_with_moments_compares_the_rows_with_all_centres_at_once(method, monkeypatch):
    rng = np.random.default_rng(4)
    shape = (5,) if method == "hyperplane" else (5, 2)
    draw = lambda n: kmeans._normal(rng.normal(size=(n, 5))) if method == "hyperplane" else np.linalg.qr(rng.normal(size=(n, *shape)))[0]
    x, centres, before = draw(60), draw(4), draw(4)
    parts = [kmeans.similarities(x, c, method).argmax(1) for c in (centres, before)]
    frames = x.reshape(60, 5, -1)
    shared = np.array([[(np.array(f.T @ c) ** 2).sum() for c in centres.reshape(4, 5, -1)] for f in frames])
    if method == "hyperplane":
        assert np.allclose(kmeans.similarities(x, centres, method), shared)
    else:
        assert np.allclose(kmeans.similarities(x, centres, method), -(4 - 2 * shared) / np.sqrt(2))
    seen, real = [], kmeans.similarities
    monkeypatch.setattr(kmeans, "similarities", lambda x, c, m: seen.append(len(c)) or real(x, c, m))

    def summed(_, kernel, shapes):
        assert set(shapes) == {"scalars", "size", "sum_h"}
        return kernel(x, None)

    monkeypatch.setattr(kmeans, "summed", summed)
    got = kmeans.pass_over(None, centres, before, method)
    assert seen == [8]
    expected = [sum(np.outer(c, c) for f in frames[parts[0] == j] for c in f.T) for j in range(4)]
    assert np.allclose(got["sum"], np.stack([e if np.ndim(e) else np.zeros((5, 5)) for e in expected]))
    assert got["changed"] == (parts[0] != parts[1]).sum() and (got["size"] == np.bincount(parts[0], minlength=4)).all()


@pytest.mark.parametrize("kind", ["logistic", "linear-svm", "rbf-svm"])
def test_a_pass_works_out_the_kernel_once_for_all_penalties(kind, monkeypatch):
    rng = np.random.default_rng(5)
    x, label, fold = rng.normal(size=(90, 6)), rng.integers(0, 4, 90), rng.integers(0, 3, 90)
    batch = pa.record_batch([pa.array(label), pa.array(fold)], names=["truth", "fold"])
    one = lambda at, n: np.eye(n)[at]
    data = supervised.Data(4, one(fold, 3).T @ one(label, 4), one(fold, 3).T @ x, one(fold, 3).T @ x**2)
    marks = landmarks.Landmarks(x[:8], 0.1) if kind == "rbf-svm" else None
    spaces = {(0.1, f): supervised.Space(f, *(d := data.without(f)), None if marks is None else marks.features(*d[:2])) for f in (0, 1, None)}
    sent = SimpleNamespace(value={k: (s.mean, s.scale, *((None, None) if marks is None else (s.features.z, 0.1))) for k, s in spaces.items()})
    machines = supervised.Machines(kind, 4, "truth", 0.05, sent)
    seen, radial = [], landmarks.radial
    monkeypatch.setattr(landmarks, "radial", lambda *a: seen.append(len(a[0])) or radial(*a))
    slopes, betas = machines.slopes, [rng.normal(size=(spaces[0.1, None].width, 4 if kind == "logistic" else 6)) for _ in range(6)]
    keys = [(0.1, f) for f in (0, 1, None) for _ in range(2)]
    asks = [kernels.Ask(slopes, {"value": (1,), "slope": b.shape}, (k, spaces[k].weight, spaces[k].on_columns(b))) for k, b in zip(keys, betas, strict=True)]
    got = [kernels.shaped(v, a.shapes) for v, a in zip(kernels.answers(asks, x, batch), asks, strict=True)]
    assert len(seen) == (3 if marks else 0)
    rights = machines.hits(x, batch, [(k, spaces[k].on_columns(b)) for k, b in zip(keys[:4], betas, strict=False)])
    for i, (key, beta) in enumerate(zip(keys, betas, strict=True)):
        s, keep = spaces[key], fold != (-1 if key[1] is None else key[1])
        model = supervised.Model("logistic" if kind == "logistic" else "machine", 4, s.mean, s.scale, beta, s.features)
        z = model.wide(x[keep])
        value, g = supervised.loss(kind, z @ beta, label[keep], s.weight[label[keep]], 4)
        assert np.isclose(got[i]["value"][0], value) and np.allclose(s.on_features(got[i]["slope"]), z.T @ g)
        if i < 4:
            assert rights[i]["right"][0] == (model.prob(x[~keep]).argmax(1) == label[~keep]).sum()


def test_complex_blocks_are_read_in_place(spark):
    df = fixtures.complex_observations(spark, SF).cache()
    x = kernels.observations(df.select("x").toArrow().to_batches()[0], "complex", ["x"])
    blocks = [pa.ipc.open_stream(b).read_next_batch() for b in kernels.blocks_of(df, ("x",)).collect()]
    seen = [kernels.observations(b, "complex", ["x"]) for b in blocks]
    assert all(np.shares_memory(s, b.column("x").flatten().to_numpy()) for s, b in zip(seen, blocks, strict=True))
    assert (seen[0][: len(x)] == x[: len(seen[0])]).all() and sum(map(len, seen)) == df.count()
    kernels.release(df)


@pytest.mark.parametrize("is_complex", [False, True])
def test_moments_are_hermitian_to_the_last_bit(is_complex):
    """One symmetric product of real numbers gives them, of rows that are views too."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 7)) + (1j * rng.normal(size=(90, 7)) if is_complex else 0)
    beta = rng.uniform(size=(90, 2)) * (np.arange(90) % 3 > 0)[:, None]
    for rows in (x, x[::2], np.asfortranarray(x)):
        b = beta[: len(rows)]
        got = Family("Normal", (7,), is_complex).moments(rows, b, None)
        assert np.allclose(got, np.stack([(rows * b[:, [k]]).T @ rows.conj() for k in (0, 1)]))
        assert (got == got.conj().transpose(0, 2, 1)).all()


def test_small_blocks_make_a_pass_of_one_stage(spark, monkeypatch):
    """Partitions' sums that are too many for the driver don't meet in tasks where few tasks can read all blocks."""
    rows = np.random.default_rng(6).normal(size=(90, 5))
    ask = kernels.Ask(lambda x, _: {"gram_h": (x.T @ x)[None], "n": np.array([float(len(x))])}, {"gram_h": (1, 5, 5), "n": (1,)})
    seen, collect = [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: seen.append((self.getNumPartitions(), collect(self))) or seen[-1][1])
    monkeypatch.setattr(kernels, "FEW", 0)
    for worth, taken, tasks in ((1 << 22, 1 << 15, 1), (3_000, 1 << 15, 3), (3_000, 2 * ask.size, None), (1, 1 << 15, None)):
        monkeypatch.setattr(kernels, "WORTH", worth)
        monkeypatch.setattr(kernels, "TAKEN", taken)
        df = spark.createDataFrame([(v.tolist(),) for v in rows], "x array<double>").repartition(9).cache()
        with monkeypatch.context() as m:
            if tasks:
                m.setattr(RDD, "partitionBy", None)  # a second stage
            seen.clear()
            for _ in range(2):
                got = kernels.asked(df, [ask])[0]
                assert np.allclose(got["gram_h"], rows.T @ rows) and got["n"] == 90
        assert [n for n, _ in seen] == [tasks or 1] * 2
        assert all(sum(len(raw) // 8 for _, raw in parts) == ask.size * (tasks or 1) for _, parts in seen)
        kernels.release(df)
        assert not df.is_cached and not {"_blocks", "_gathered"} & set(df.__dict__)


def test_joined_blocks_hold_all_rows_in_their_order(monkeypatch):
    monkeypatch.setattr(kernels, "WORTH", 1_000)
    batches = [pa.record_batch([pa.array([[float(i), 1.0]] * (1 + i % 3)), pa.array([i] * (1 + i % 3))], names=["x", "truth"]) for i in range(9)]
    cells = [kernels.serialised(b) for b in batches]
    blocks = [pa.ipc.open_stream(c).read_next_batch() for c in kernels.joined(iter(cells))]
    assert 1 < len(blocks) < len(batches) and list(kernels.joined(iter([]))) == []
    assert [r for b in blocks for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("name,rank", [("MACG", 0), ("MACG", 2), ("SingularWishart", 0)])
def test_moments_of_frames_are_symmetric_to_the_last_bit(name, rank):
    rng = np.random.default_rng(8)
    x, beta = rng.normal(size=(90, 7, 3)), rng.uniform(size=(90, 2)) * (np.arange(90) % 3 > 0)[:, None]
    family = Family(name, (7, 3), rank=rank)
    theta = family.uniform(2, 0)
    got = family.moments(x, beta, theta)
    left = [x @ np.linalg.inv(family.form(x, theta, k)[0]) if name == "MACG" else x for k in (0, 1)]
    assert np.allclose(got, np.stack([np.einsum("n,npa,nqa->pq", beta[:, k], left[k], x) for k in (0, 1)]))
    assert (got == got.transpose(0, 2, 1)).all()
    form = np.linalg.inv(np.eye(3) - 0.5 * np.ones((3, 3)))  # not definite, as rounding may leave one
    got = family.moments(x, beta, theta, [(np.repeat(form[None], 90, 0), 0.0)] * 2)
    expected = np.einsum("nk,npa,ab,nqb->kpq", beta, x, np.linalg.inv(form) if name == "MACG" else np.eye(3), x)
    assert np.allclose(got, expected)
