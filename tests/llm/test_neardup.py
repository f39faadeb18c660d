"""Near duplicates: rows that share an id, extremes, the search across components, recall of the tables."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import _extremes

from phasorlake.llm import neardup

SCHEMA = "doc_id long, text string"


def _set(text, k):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _plain(rows, k=3, percent=85):
    """doc_id, n_shingles, component_id, kept of each row; rows are nodes of their own."""
    sets = [_set(t, k) if d is not None else set() for d, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            top[root(j)] = root(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return [(d, len(_set(t, k)), None if d is None else low[root(i)], d is None or low[root(i)] == d) for i, (d, t) in enumerate(rows)]


def _chain(n=40, start=0):
    """Texts of which each shares most words with the next, so that links run through many components."""
    return [" ".join(f"w{start}_{j}" for j in range(3 * i, 3 * i + 60)) for i in range(n)]


ROWS = [
    [(1, "a b c d e"), (5, "a b c d e"), (5, "another text of the id five"), (5, "x y z u v w"), (3, "another text of the id five"), (9, "x y z u v w"), (9, "x y z u v w"), (None, "a b c d e"), (7, None), (8, "")],
    [(i % 7, t) for i, t in enumerate(_chain(12))],
    _extremes(),
]


@pytest.mark.parametrize("rows", ROWS, ids=["shared ids", "chains of shared ids", "extremes"])
def test_rows_equal_brute_force(spark, rows):
    got = neardup.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _plain(rows)))


def test_rows_of_a_shared_id_stay_or_go_by_their_texts(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "an other text of seven words here"), (None, "a b c d e f")]
    got = neardup.one_of_each(spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("given"))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*r, "given")) for r in [rows[0], rows[2], rows[3]])


def _numbered(spark, sets):
    schema = "rid long, codes array<long>"
    held = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], schema)
    return held.select("rid", F.size("codes").cast("long").alias("n"), F.col("rid").alias("label")), held


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_the_search_across_components_misses_no_pair(spark, percent):
    rng = np.random.default_rng(percent)
    sets = [set(rng.choice(60, size, replace=False).tolist()) for size in (1, 2, 3, 7, 20, 21, 34, 40)]
    for base in sets[2:]:
        for change in (1, 2, 3, 5):
            turned = set(base)
            for c in list(base)[:change]:
                turned.discard(c)
            sets += [turned | {100 + c for c in range(change // 2)}, turned] if turned else []
    sets = [set(s) for s in {frozenset(s) for s in sets}]
    rest, held = _numbered(spark, sets)
    got = {frozenset(r) for r in neardup._verified(neardup._across(rest, held, percent), held, percent).collect()}
    alike = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    assert got == {frozenset((i, j)) for i, j in combinations(range(len(sets)), 2) if alike(sets[i], sets[j])}


def test_places_ask_for_few_bands_whatever_the_size(spark):
    """Rows of the search follow the number of shingles, not its square."""
    n, seen = 40_000, []
    base = set(range(n))
    rest, held = _numbered(spark, [base, base - set(range(n // 11)) | set(range(n, n + n // 11))])
    found = neardup._across(rest, held, 80)
    assert {tuple(r) for r in found.collect()} in ({(0, 1)}, {(1, 0)})
    for size in (1_000, 100_000):
        low, high = int(np.ceil(size * 0.8)), size
        band = lambda v: int(np.floor(np.log(v) * neardup.BANDS / np.log(1.25)))
        seen.append(band(high) - band(low) + 1)
    assert max(seen) <= neardup.BANDS + 1


def test_recall_of_the_tables(spark, duck):
    """Pairs at the similarity or more meet in a table: 0.99 of them at least, by the keys alone."""
    rows = duck.execute("select doc_id, text from documents").fetchall()
    sets = [_set(t, 3) for _, t in rows]
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and sets[i] != sets[j]]
    sig = neardup.signatures(spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, row long"), 3, 12)
    keys = {r["doc_id"]: (set(enumerate(r["a"])), set(enumerate(r["b"]))) for r in sig.collect()}
    met = [all(keys[rows[i][0]][h] & keys[rows[j][0]][h] for h in (0, 1)) for i, j in pairs]
    assert pairs and np.mean(met) >= 0.99
