"""Clustering, sharding and hard negatives against plain loops, on tables with every odd row."""

import hashlib
import zlib

import numpy as np
import pytest

from phasorlake.llm import centroids, negatives, sharding

WIDE = 6
SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, row int, slot int"


def _odd_vectors(n=260, seed=5):
    """Clumps with many equal vectors, ties, repeated ids, and rows that take no part."""
    rng = np.random.default_rng(seed)
    hubs = rng.normal(size=(5, WIDE))
    rows = [(int(i), [float(v) for v in np.round(hubs[i % 5] + rng.normal(size=WIDE) * 0.2, 2)], int(i % 10)) for i in range(n)]
    rows += [(1000 + i, [0.5] * WIDE, int(i % 3)) for i in range(70)]  # one vector, many rows
    rows += [(100, [0.25] * WIDE, 3), (100, [0.25] * WIDE, 3), (7, [0.5] * WIDE, 9), (-200, [-0.4] * WIDE, 4), (0, [0.0] * WIDE, 1), (300, [0.0] * WIDE, 2)]
    rows += [(None, [0.1] * WIDE, 1), (200, None, 1), (201, [float("nan")] * WIDE, 1), (202, [float("inf")] * WIDE, 2), (203, [None] * WIDE, 2), (204, [0.3] * WIDE, None), (205, [], 5), (400, [0.6] * 4, 5)]
    return [(*r, "x", 1, None) for r in rows]


def _plain_clusters(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows if v is not None and len(v) == WIDE and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        got = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), g in zip(kept, got) if g == j]
            centres[j] = [sum(x) // len(mine) for x in zip(*mine)] if mine else centres[j]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    by = {j: sum(d for _, c, d in out if c == j) for j in range(len(centres))}
    return sorted((str(i), c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out)


@pytest.mark.parametrize(("k", "rounds"), [(12, 5), (3, 2), (1, 1), (40, 3)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rows = _odd_vectors()
    got = centroids.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3), k, rounds, size=WIDE).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == _plain_clusters(rows, k, rounds)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = _odd_vectors(n=4)[:4]
    got = centroids.clusters(spark.createDataFrame(rows, SCHEMA), 40, 5, size=WIDE).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == _plain_clusters(rows, 40, 5)
    assert centroids.clusters(spark.createDataFrame([], SCHEMA), size=WIDE).collect() == []


def test_scan_finds_the_nearest_from_any_start():
    rng = np.random.default_rng(1)
    for big in (20, 1 << 24):  # products below and above what doubles hold exactly
        x, c = rng.integers(-big, big, (300, 8)), rng.integers(-big, big, (17, 8))
        c[5] = c[11]
        x[:40] = c[rng.integers(0, 17, 40)]
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        for last in (np.zeros(300, np.int32), rng.integers(0, 17, 300)):
            cluster, distance = centroids.scan(x, c, last)
            assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all()


def test_ties_at_twice_the_distance_go_to_the_smaller_number():
    cluster, distance = centroids.scan(np.array([[0, 0]]), np.array([[3, 0], [-3, 0]]), np.array([1]))
    assert (cluster[0], distance[0]) == (0, 9)


def test_scan_leaves_far_centroids_out(monkeypatch):
    seen, products = [], centroids.products
    monkeypatch.setattr(centroids, "products", lambda x, c: seen.append(len(x) * len(c)) or products(x, c))
    c = np.arange(40)[:, None] * 1000 * np.ones((1, 4), int)
    centroids.scan(c.repeat(50, 0) + 1, c, np.arange(40).repeat(50))
    assert sum(seen) <= 40 * 40 + 2000  # the centroids' own distances, and one distance a vector


def _jump(key, shards):
    key %= 1 << 64
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jumps_equal_the_published_ones(spark):
    keys = [0, 1, 42, 256, 0xDEAD10CC, -1, -(1 << 63), (1 << 63) - 1, *range(1000, 1300)]
    for shards in (1, 2, 8, 57, 64, 65, 666, 1024):
        got = {r["k"]: r["s"] for r in sharding.placed(spark.createDataFrame([(k,) for k in keys], "k long"), sharding.F.col("k"), shards).select("k", sharding.F.col("shard").alias("s")).collect()}
        assert got == {k: _jump(k, shards) for k in keys}, shards
    assert (_jump(1, 1), _jump(42, 57), _jump(0xDEAD10CC, 666), _jump(256, 1024)) == (0, 43, 361, 520)


@pytest.mark.parametrize("shards", [1, 8, 70])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    got = sharding.placed(spark.range(3000), sharding.F.col("id"), shards).collect()
    assert all(r["grown_shard"] == _jump(r["id"], shards + 1) and r["grown_shard"] in (r["shard"], shards) for r in got)
    moved = sum(r["grown_shard"] != r["shard"] for r in got)
    assert abs(moved - 3000 / (shards + 1)) < 5 * (3000 / (shards + 1)) ** 0.5 + 1


DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, _shard_n int"


def test_shards_of_odd_rows(spark):
    texts = [None, "", "ab", "né €", "x" * 300_000, "same", "same"]
    rows = [(i, texts[i % 7], "en", "s", 1, "old", 2) for i in range(200)] + [(5, "hot", "en", "s", 1, None, 2)] * 400 + [(None, "a", None, None, None, None, None), (None, None, None, None, None, None, None)]
    got = sharding.sharded_documents(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    expected = {}
    for r in rows:
        raw = (r[1] or "").encode()
        expected.setdefault(_jump(r[0] or 0, 8), []).append((-1 << 70 if r[0] is None else r[0], len(raw) + 1, zlib.crc32(raw), _jump(r[0] or 0, 9)))
    found = {}
    for r in got:
        assert r["law"] == "key"
        found.setdefault(r["shard"], []).append((r["slot"], -1 << 70 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["grown_shard"]))
    assert {s: sorted(v) for s, v in found.items()} == {s: [(i, *x) for i, x in enumerate(sorted(v))] for s, v in expected.items()}
    assert sharding.sharded_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_numbers_spread_one_key_over_partitions(spark):
    rows = sharding.placed(spark.range(20_000).selectExpr("id % 3 as doc_id"), sharding.F.col("doc_id"))
    held = sharding.numbered(rows, ["doc_id"])
    counts = held.groupBy("shard").agg(sharding.F.count("*").alias("n"), sharding.F.countDistinct("slot").alias("d"), sharding.F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in counts) and sum(r["n"] for r in counts) == 20_000


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = spark.range(500).selectExpr("id as doc_id", "concat('t', id) as text")
    sharding.write(docs, str(tmp_path / "s"), 8)
    got = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r["doc_id"], r["text"], r["shard"]) for r in got) == [(i, f"t{i}", _jump(i, 8)) for i in range(500)]


def _plain_negatives(rows, every=100, positives=5, k=10):
    fit = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]) for i, v, label, *_ in rows if i is not None and label is not None and fit(v)]
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, m != label) for j, m, w in kept]
        for p, pid, _ in sorted(s for m, s in enumerate(score) if m != n and not s[2])[:positives]:
            good = sorted(s for s in score if s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:k]
            out += [(i, pid, r + 1, nid, -p, -s) for r, (s, nid, _) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize(("every", "block"), [(100, 8192), (4, 8192), (2, 23), (1, 60)])
def test_hard_negatives_equal_brute_force(spark, every, block):
    rows = _odd_vectors()
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), every, block_rows=block).collect()
    assert sorted(map(tuple, got)) == _plain_negatives(rows, every)


def test_hard_negatives_of_no_rows_and_no_anchors(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, [0.5], 1, None, None, None)], SCHEMA)).collect() == []


def test_node_pairs_prune_groups_and_miss_nothing():
    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(12, 16)) * 300
    x = (hubs[np.repeat(np.arange(12), 500)] + rng.normal(size=(6000, 16)) * 5).astype(np.int32)
    label, ids = np.repeat(np.arange(12) % 2, 500), np.arange(6000)
    t = negatives.tree(x[::10], label[::10], 16)
    open_ = np.full((600, 1), negatives.NONE)
    block = negatives.Block(t, ids[::10][t.order], ids[::10][t.order], x[::10][t.order], open_, -open_)
    search = negatives.Search(block, False, 10)
    for part in range(3):
        search.search(x[part::3], ids[part::3], ids[part::3], label[part::3])
    score = x[::10].astype(int) @ x.T.astype(int)
    for n, row in enumerate(block.row):
        other = np.flatnonzero(label != label[row])
        best = other[np.lexsort((other, -score[row // 10, other]))][:10]
        assert search.held[1][n, 0].tolist() == best.tolist()
    kinds = lambda tree: np.bincount(tree.label[tree.left == 0], minlength=2)
    pairs = sum(int(kinds(t) @ kinds(negatives.tree(x[part::3], label[part::3]))[::-1]) for part in range(3))
    assert search.passed and search.scored < 0.5 * pairs


def test_every_row_is_in_one_leaf():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-9, 9, (500, 3)), np.ones((700, 3), int)])
    t = negatives.tree(x, rng.integers(0, 3, 1200), 50)
    leaf = [(a, b) for a, b, c in zip(t.first, t.last, t.left) if c == 0]
    assert sorted(i for a, b in leaf for i in range(a, b)) == list(range(1200)) and sorted(t.order) == list(range(1200))
    assert all(b - a <= 50 for a, b in leaf)
    for a, b, c, r in zip(t.first, t.last, t.centre, t.radius):
        assert np.linalg.norm(x[t.order[a:b]] - c, axis=1).max() <= r + 1e-9
