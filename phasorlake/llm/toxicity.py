"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Learning: a bounded sample of labelled rows (``bound``) is split by digest. One part gives the lexicon,
words and word beginnings that are more frequent in toxic texts, with a weight that falls with their
support; it is counted on the executors. The next part gives features for the trees, the last the
calibration. Scoring is a map over all documents, whole texts, in slices of bounded size.

Defined results: a null or empty text has all features 0 and gets the score of such a row; repeated rows
score alike; without labelled rows of both classes the score is the share of the class seen, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, mixed, text_bytes
from .fitting import remainder, slices, training_rows

BOUND, LEXICON_SHARE, TREE_SHARE = 20_000, 45, 40
ROUNDS, DEPTH, RATE, BINS, NEAR = 80, 3, 0.15, 48, 4
#: Words of address, and common terms of abuse, of the languages at hand.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre usted ustedes ti tú tus su"
ABUSE = "idiot stupid moron loser trash scum pathetic worthless disgusting clown dumb fool hate kill ugly garbage dumm blöd idiota estúpido basura imbécile stupide"

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DISGUISE = np.zeros(256, bool)
_DISGUISE[[ord(c) for c in "@$*#!013457"]] = True
FEATURES = ("lexicon_density", "lexicon_peak", "lexicon_second", "strong_hits", "strong_rate", "abuse_rate", "person_rate", "person_near", "capital_rate", "shouted_rate", "exclaim_rate", "question_rate", "punct_rate", "disguised_rate", "repeat_rate", "words_log", "word_length")


def word_codes(words: list[str]) -> np.ndarray:
    raw, at = text_bytes(pa.array([w.lower() for w in words], pa.large_string()))
    return np.sort(Words(raw, at, _BREAK, LOWER).code)


def beginnings(w: Words, n: int) -> np.ndarray:
    """A code of each word's first n bytes; 0 where it is not longer."""
    h = np.zeros(len(w), np.uint64)
    long = np.flatnonzero(w.stop - w.start > n)
    for j in range(n):
        h[long] = h[long] * np.uint64(256) + LOWER[w.raw[w.start[long] + j]]
    h[long] = mixed(h[long] * np.uint64(8) + np.uint64(n))
    return h


def codes(raw: np.ndarray, at: np.ndarray) -> tuple[Words, tuple[np.ndarray, ...]]:
    w = Words(raw, at, _BREAK, LOWER)
    return w, (w.code, beginnings(w, 4), beginnings(w, 5))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, rows, toxic rows) of each slice: a code counts once in a text."""
    for batch in batches:
        for part in slices(batch):
            w, kinds = codes(*text_bytes(part.column("text")))
            y = part.column("y").to_numpy(zero_copy_only=False)
            rows = np.concatenate([w.row] * len(kinds))
            every = np.concatenate(kinds)
            order = np.lexsort((rows, every))
            every, rows = every[order], rows[order]
            new = np.ones(len(every), bool)
            new[1:] = (every[1:] != every[:-1]) | (rows[1:] != rows[:-1])
            new &= every != 0
            every, toxic = every[new], y[rows[new]]
            if len(every):
                first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
                yield pa.record_batch([pa.array(every[first].view(np.int64)), pa.array(np.diff(np.append(first, len(every)))), pa.array(np.add.reduceat(toxic.astype(np.int64), first))], names=["code", "n", "k"])


def lexicon(rows: DataFrame, least: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order and their weights: log odds ratio of toxic against other rows, less 1.64 times its
    standard error. ``rows``: text, y; a bounded sample."""
    n, k = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("y")).first())
    table = rows.select("text", "y").mapInArrow(_count, "code long, n long, k long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    a, b = F.col("k") + 0.5, F.col("n") - F.col("k") + 0.5
    weight = F.log(a / (k + 1.0)) - F.log(b / (n - k + 1.0)) - 1.64 * F.sqrt(1 / a + 1 / b)
    got = table.where("k >= 2").select("code", weight.alias("weight")).where(F.col("weight") >= least).toPandas()
    code = got["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(code)
    return code[order], got["weight"].to_numpy(np.float64)[order]


def weights_of(code: np.ndarray, lex: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(lex[0]):
        return np.zeros(len(code))
    at = np.minimum(np.searchsorted(lex[0], code), len(lex[0]) - 1)
    return np.where(lex[0][at] == code, lex[1][at], 0.0)


def features(raw: np.ndarray, at: np.ndarray, lex: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each text."""
    n, size = len(at) - 1, np.diff(at)
    w, kinds = codes(raw, at)
    per = lambda x: np.bincount(w.row, weights=x, minlength=n)
    byte_row = np.repeat(np.arange(n), size)
    at_byte = lambda flag: np.bincount(byte_row[flag], minlength=n)
    words, bytes_ = np.maximum(np.bincount(w.row, minlength=n), 1), np.maximum(size, 1)
    weight = np.maximum.reduce([weights_of(c, lex) for c in kinds]) if len(w) else np.zeros(0)
    peak, second = np.zeros(n), np.zeros(n)
    if len(w):
        order = np.lexsort((-weight, w.row))
        rows, sorted_ = w.row[order], weight[order]
        place = np.arange(len(order)) - w.first[rows]
        peak[rows[place == 0]] = sorted_[place == 0]
        second[rows[place == 1]] = sorted_[place == 1]
    strong = weight >= 1.5
    person = np.isin(w.code, _PERSON)
    near = np.zeros(len(w), bool)
    for d in range(-NEAR, NEAR + 1):
        here = np.flatnonzero(strong) + d
        here = here[(here >= 0) & (here < len(w))]
        here = here[w.row[here] == w.row[here - d]]
        near[here] = True
    length = w.stop - w.start
    capital = (raw >= 65) & (raw < 91)
    before = np.concatenate(([0], np.cumsum(capital)))
    shouted = (before[w.stop] - before[w.start] == length) & (length > 2)
    inner = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = _DISGUISE[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
    triple = np.zeros(len(raw), bool)
    if len(raw) > 2:
        triple[2:] = (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2]) & _LETTER[raw[2:]]
    punct = (raw > 32) & (raw < 127) & _BREAK[raw]
    columns = [per(weight) / words, peak, second, per(strong), per(strong) / words, per(np.isin(w.code, _ABUSE)) / words, per(person) / words, per(person & near) / words, at_byte(capital) / bytes_, per(shouted) / words, at_byte(raw == 33) / bytes_, at_byte(raw == 63) / bytes_, at_byte(punct) / bytes_, at_byte(inner) / words, at_byte(triple) / words, np.log1p(np.bincount(w.row, minlength=n)), per(length) / words]
    return np.stack(columns, 1)


_PERSON, _ABUSE = word_codes(SECOND_PERSON.split()), word_codes(ABUSE.split())


# -- trees ----------------------------------------------------------------------------------------


def fit_trees(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees for the logistic loss: each level splits every node on the binned feature that
    gains most. A tree has 2^DEPTH - 1 splits, those without gain send all rows left."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, trees, width = np.full(len(y), base), [], BINS + 1
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        split = []
        for depth in range(DEPTH):
            wide = 1 << depth
            best = np.full(wide, 1e-9)
            chosen = [(0, np.inf, width)] * wide
            for f in range(x.shape[1]):
                at = node * width + binned[:, f]
                gs = np.bincount(at, weights=g, minlength=wide * width).reshape(wide, width).cumsum(1)
                hs = np.bincount(at, weights=h, minlength=wide * width).reshape(wide, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                top = gain[:, : len(cuts[f])].argmax(1) if len(cuts[f]) else np.zeros(wide, int)
                for k in range(wide):
                    if len(cuts[f]) and gain[k, top[k]] > best[k]:
                        best[k], chosen[k] = gain[k, top[k]], (f, float(cuts[f][top[k]]), int(top[k]))
            split += [c[:2] for c in chosen]
            f_of, b_of = np.array([c[0] for c in chosen]), np.array([c[2] for c in chosen])
            node = 2 * node + (binned[np.arange(len(y)), f_of[node]] > b_of[node])
        leaf = -RATE * np.bincount(node, weights=g, minlength=1 << DEPTH) / (np.bincount(node, weights=h, minlength=1 << DEPTH) + 1)
        score += leaf[node]
        trees.append((np.array([s[0] for s in split]), np.array([s[1] for s in split]), leaf))
    return {"base": base, "trees": trees}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    row = np.arange(len(x))
    for feature, cut, leaf in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for depth in range(DEPTH):
            at = (1 << depth) - 1 + node
            node = 2 * node + (x[row, feature[at]] > cut[at])
        out += leaf[node]
    return out


def fit_isotonic(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing curve closest to y (pool adjacent violators); blocks keep one pseudo-row of
    each end, so the curve stays inside 0 and 1."""
    order = np.argsort(margins, kind="stable")
    blocks: list[list[float]] = []
    for m, v in zip(margins[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(m), float(m)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    knots, values = [], []
    for s, n, lo, hi in blocks:
        value = (s + 0.5 * (s / n)) / (n + 0.5) if 0 < s < n else (0.25 / (n + 0.5) if s == 0 else (n + 0.25) / (n + 0.5))
        knots += [lo, hi] if hi > lo else [lo]
        values += [value] * (2 if hi > lo else 1)
    return np.array(knots), np.maximum.accumulate(np.array(values))


def fit(documents: DataFrame, labels: DataFrame, learn, bound: int = BOUND) -> dict:
    """``learn``: the condition on ``labels`` for rows that may be learnt from."""
    sample = training_rows(labels, "toxic", learn, bound)
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "y", "part")
    lex = lexicon(texts.where(F.col("part") < LEXICON_SHARE))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(*text_bytes(part.column("text")), lex)
                yield pa.record_batch([part.column("y"), part.column("part"), *(pa.array(c) for c in x.T)], names=["y", "part", *FEATURES])

    schema = "y int, part int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = texts.where(F.col("part") >= LEXICON_SHARE).mapInArrow(featured, schema).toPandas().sort_values(["part", *FEATURES, "y"])
    x, y, part = rows[list(FEATURES)].to_numpy(), rows["y"].to_numpy(float), rows["part"].to_numpy()
    if not 0 < y.sum() < len(y):
        return {"share": float(y.mean()) if len(y) else 0.0}
    grown, held = part < LEXICON_SHARE + TREE_SHARE, part >= LEXICON_SHARE + TREE_SHARE
    if y[held].sum() < 20 or not 0 < y[grown].sum() < grown.sum():
        grown = held = np.ones(len(y), bool)  # too few rows to set some aside
    model = fit_trees(x[grown], y[grown])
    return model | {"lexicon": lex, "curve": fit_isotonic(margin(model, x[held]), y[held])}


def score_texts(model: dict, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    if "share" in model:
        return np.full(len(at) - 1, model["share"])
    return np.clip(np.interp(margin(model, features(raw, at, model["lexicon"])), *model["curve"]), 0, 1)


def score(df: DataFrame, model: dict) -> DataFrame:
    """Add ``score`` to a frame that has ``text``; an old column ``score`` is replaced."""
    given = [f for f in df.schema.fields if f.name != "score"]
    schema = type(df.schema)([*given]).add("score", "double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = score_texts(model, *text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, "score"])

    return df.select(*(f.name for f in given)).mapInArrow(each, schema)


def predictions(documents: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows whose remainder is ``held`` aren't learnt from."""
    model = fit(documents, labels, remainder(F.col("doc_id"), mod) != held, bound)
    scored = score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(F.col("doc_id"), mod) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
