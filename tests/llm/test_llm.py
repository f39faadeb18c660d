import hashlib
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

import corpus_pipeline
from phasorlake.llm import common, decontaminate, media, mixing, neardup, pii, quality, substrings, tokens, toxicity, webp, windows
from phasorlake.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees near the quiet river bank at night under pale stars"


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, SF, "documents").select("doc_id", "text").collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df())


def _sets(rows, k):
    out = {}
    for r in rows:
        w = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")).encode().split()
        out[r["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def test_near_duplicates_equal_brute_force(spark, documents):
    sets = _sets(documents, 3)
    label = {d: d for d in sets}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            label[y] = x
    got = QUERIES["op2_minhash_neardup"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def test_pipeline_near_copies_equal_brute_force(spark, documents):
    sets = _sets(documents, 5)
    group = {d: {d} for d in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 10 * both >= 8 * len(sets[a] | sets[b]) and group[a] is not group[b]:
            group[a] |= group[b]
            for d in group[b]:
                group[d] = group[a]
    docs = common.table(spark, SF, "documents")
    got = corpus_pipeline.without_near_copies(spark, docs, SF).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d in sets if min(group[d]) == d)


def _plain_strings(rows, k=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, by all strings of smaller ids."""
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - k + 1 if doc_id is not None else 0):
            first[raw[s : s + k]] = min(doc_id, first.get(raw[s : s + k], doc_id))
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - k + 1 if doc_id is not None else 0):
            if first[raw[s : s + k]] < doc_id:
                gone[s : s + k] = b"\1" * k
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_byte_strings_equal_brute_force(spark, documents):
    expected = _plain_strings([(r["doc_id"], r["text"]) for r in documents])
    assert sorted(map(tuple, QUERIES["op10_suffix_dedup"](spark, SF).collect())) == sorted(expected)


def test_crowded_minimizers_give_the_same(spark):
    docs = common.table(spark, SF, "documents")
    rows = lambda **k: sorted(map(tuple, substrings.remove_repeats(docs, **k).collect()))
    expected = rows()
    for crowds in ((1, 10**6, 10**6), (1, 1, 10**6), (1, 1, 1), (3, 6, 12)):
        assert rows(crowds=crowds) == expected, crowds


def test_media_round_trip(documents, spark):
    for r in documents[:20]:
        raw = (r["text"] or "").encode()
        samples = media.unpack(media.pack(r["text"])).tobytes()
        assert samples[: len(raw)] == raw and len(samples) % 576 == 0 and set(samples[len(raw) :]) <= {255}
    by = {d["doc_id"]: d["text"] or "" for d in documents}
    got = QUERIES["op9_media"](spark, SF).collect()
    assert len(got) == len(documents)
    for r in got:
        text = by[r["doc_id"]].encode()
        payload = text + b"\xff" * (-len(text) % 576 or (0 if text else 576))
        stored = b"".join(media.pack(by[r["doc_id"]]))
        part = len(payload) // 64
        sums = [sum(payload[i * part : (i + 1) * part]) for i in range(64)]
        bits = "".join("1" if sums[i] > sums[(i + 1) % 64] else "0" for i in range(64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), f"{int(bits, 2):016x}")


def test_webp_of_noise():
    rows = np.random.default_rng(0).integers(0, 256, (7, 576), dtype=np.uint8)
    assert ((webp.decode(webp.encode_grey(rows)) & np.uint32(255)).reshape(rows.shape) == rows).all()


@pytest.mark.parametrize("rule", ["first", "most"])
def test_section_counts_equal_brute_force(spark, documents, rule):
    encoding, _ = tokens.encoder(tokens.VOCABULARY)
    text = {r["doc_id"]: r["text"] or "" for r in documents}
    docs = common.table(spark, SF, "documents")
    got = (QUERIES["op8_token_counts"](spark, SF) if rule == "first" else tokens.section_counts(docs, rule)).collect()
    assert len(got) == len(text)
    for r in got:
        t = text[r["doc_id"]]
        lines = t.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        line_of = [n for n, x in enumerate(lines) for _ in x]
        # code point of each byte, then the code points of each token
        point = [i for i, c in enumerate(t) for _ in c.encode()]
        counts, at, crossing = [0] * len(lines), 0, 0
        ids = encoding.encode_ordinary(t)
        for i in ids:
            size = len(encoding.decode_single_token_bytes(i))
            inside = [line_of[p] for p in range(point[at], point[at + size - 1] + 1)]
            crossing += inside[0] != inside[-1]
            best = inside[0] if rule == "first" else min(set(inside), key=lambda n: (-inside.count(n), n))
            counts[best] += 1
            at += size
        assert (r["n_tokens"], r["n_chars"], r["n_sections"], r["n_crossing"]) == (len(ids), len(t), len(lines), crossing)
        assert r["section_tokens"] == ",".join(map(str, counts)) and r["most_tokens"] == max(counts, default=0)


@pytest.mark.parametrize("text", [" " * 2_000_000 + "a", "a" * 2_000_000, "x" + "\n" * 1_200_000 + " y", "\u3000" * 1_000_000])
def test_tokens_of_long_runs(text):
    first, last = tokens.spans(text)
    assert first[0] == 0 and last[-1] == len(text) - 1 and (first[1:] >= last[:-1]).all()


def test_cut_white_space_gives_the_same_tokens():
    encoding, _ = tokens.encoder(tokens.VOCABULARY)
    for t in (" " * 20_000 + "a b", "x" + " " * 20_000, "a" + "\n" * 15_000 + " b", "a" + " " * 15_000 + "\t b", " " * 12_000, "a " + "\x1c" * 12_000 + "b"):
        assert tokens.encoded(t, encoding) == encoding.encode_ordinary(t)


def test_tiles_catch_reordered_passages():
    a, b, c = (np.arange(s, s + 8, dtype=np.uint64) for s in (0, 100, 200))
    found = decontaminate.tiles(np.concatenate([c, np.array([999], np.uint64), a, b]), np.concatenate([a, b, c]))
    assert sorted(n for *_, n in found) == [8, 16]


def test_what_a_tile_leaves_of_a_match_waits_in_order():
    item = np.arange(19)
    doc = np.array([13, 14, 15, 16, 17, 18, 99, 15, 16, 17, 18, 98, 8, 9, 10, 11, 12, 13, 97])
    assert sorted(n for *_, n in decontaminate.tiles(doc.astype(np.uint64), item.astype(np.uint64))) == [5, 6]


@pytest.mark.parametrize("words", [2, 3, 4, 5, 8, 15, 30])
def test_tiling_equals_plain_tiling(words):
    """Of short texts over few words, as many as give other tiles when remainders are dropped or out of order."""
    rng = np.random.default_rng(words)
    for _ in range(750):
        item = rng.integers(0, words, rng.integers(1, 40))
        doc = rng.integers(0, words, rng.integers(1, 60))
        for _ in range(rng.integers(0, 4)):  # passages of the item in any order
            a, at = rng.integers(0, len(item)), rng.integers(0, len(doc))
            piece = item[a : a + rng.integers(1, 20)][: len(doc) - at]
            doc[at : at + len(piece)] = piece
        found = decontaminate.tiles(doc.astype(np.uint64), item.astype(np.uint64))
        assert all((doc[d : d + n] == item[i : i + n]).all() for d, i, n in found)
        assert sum(n for *_, n in found) == _plain_tiling(doc, item, decontaminate.LEAST)


def test_repeated_words_cost_in_proportion():
    took = []
    for n in (100_000, 800_000):
        began = time.perf_counter()
        assert [t[2] for t in decontaminate.tiles(np.zeros(n, np.uint64), np.zeros(300, np.uint64))] == [300]
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5, took
    search = decontaminate._searcher([(1, "a " * 300), (2, "b c d e f")], 0.5)
    assert search(pa.array(["a " * 1_000_000])) == [(0, 1, 300, 300, 1, 300, 1.0)]


def _plain_words(text):
    return re.findall(r"[A-Za-z0-9\x80-\xff]+".encode("latin-1"), (text or "").encode())


def _plain_tiling(doc, item, least):
    """Matched words of greedy string tiling by comparing every place with every place."""
    free_d, free_i, matched = np.ones(len(doc), bool), np.ones(len(item), bool), 0
    while True:
        best = (0, 0, 0)
        run = np.zeros(len(doc) + 1, np.int64)
        for i, word in enumerate(item):  # run[d + 1]: length of the common run that ends at (d, i)
            step = np.zeros(len(doc) + 1, np.int64)
            step[1:] = np.where((doc == word) & free_d & free_i[i], run[:-1] + 1, 0)
            run = step
            for d in np.flatnonzero(run > best[0]):
                if run[d] > best[0]:
                    best = (int(run[d]), int(d) - int(run[d]), i + 1 - int(run[d]))
        n, d, i = best
        if n < least:
            return matched
        free_d[d : d + n] = free_i[i : i + n] = False
        matched += n


def _plain_leaks(rows, items):
    number = {}
    code = lambda t: np.array([number.setdefault(w.lower(), len(number)) for w in _plain_words(t)], np.int64)
    benchmark = [(r["item_id"], code(r["text"])) for r in items]
    found = set()
    for r in rows:
        doc = code(r["text"])
        seeds = {tuple(doc[i : i + decontaminate.LEAST]) for i in range(len(doc) - decontaminate.LEAST + 1)}
        for item_id, item in benchmark:
            if any(tuple(item[i : i + decontaminate.LEAST]) in seeds for i in range(len(item) - decontaminate.LEAST + 1)):
                matched = _plain_tiling(doc, item, decontaminate.LEAST)
                if matched >= decontaminate.SHARE * len(item):
                    found.add((r["doc_id"], item_id, len(item), matched))
    return found


@pytest.fixture(scope="module")
def leaked(spark, documents):
    return _plain_leaks(documents, common.table(spark, SF, "benchmark").collect())


def test_leaks_equal_brute_force(spark, leaked):
    got = {(r["doc_id"], r["item_id"], r["item_words"], r["matched_words"]) for r in QUERIES["op4_decontamination"](spark, SF).collect()}
    assert got == leaked and len(leaked) > 2


def test_pipeline_decontamination_equals_brute_force(spark, documents, leaked):
    docs = common.table(spark, SF, "documents")
    got = corpus_pipeline.without_benchmark(spark, docs, SF).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in got) == sorted({r["doc_id"] for r in documents} - {d for d, *_ in leaked})


def test_pipeline_masks_what_brute_force_masks(spark, documents):
    docs = common.table(spark, SF, "documents")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.masked(spark, docs, SF).collect()}
    masked = 0
    for r in documents:
        t, out, at = r["text"], "", 0
        if t is None:
            assert got[r["doc_id"]][0] is None
            continue
        cells = [None] * len(t)
        order = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[r["doc_id"]].split(",") if s))
        while order:
            a, b, k = order.pop(0)
            while order and order[0][0] < b:
                b = max(b, order.pop(0)[1])
            cells[a:b] = [f"[{k.upper()}]"] + [""] * (b - a - 1)
            masked += 1
        out = "".join(c if x is None else x for c, x in zip(t, cells))
        assert got[r["doc_id"]] == (out, len(out))
    assert masked > 10


def _plain_mix(rows, seed=17, weights=(5, 2, 1), repeats=3):
    """Taken words of each row: targets by giving the excess away again and again, queues served one event at a time."""
    sizes = {}
    for doc_id, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, budget = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = (budget - sum(full.values())) / max(sum(weight[s] for s in open_), 1)
        over = [s for s in open_ if level * weight[s] >= repeats * sizes[s]]
        if not over:
            break
        full |= {s: repeats * sizes[s] for s in over}
    target = {s: full.get(s, level * weight[s]) for s in names}
    place = lambda d: int(hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    events = []
    for s in names:
        so_far = 0
        for doc_id, size in sorted(((d, n) for d, x, n in rows if x == s), key=lambda r: (place(r[0]), r[0] or 0, r[1])):
            so_far += size
            events += [((so_far + k * sizes[s]) / target[s], size, doc_id) for k in range(repeats) if size and target[s]]
    taken, served, last = {}, 0, None
    for v, size, doc_id in sorted(events, key=lambda e: e[0]):
        if served >= budget and v != last:
            break
        served, last = served + size, v
        taken[doc_id] = taken.get(doc_id, 0) + size
    return taken, target


def test_pipeline_mix_equals_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").encode().split())) for r in docs.collect()]
    taken, target = _plain_mix(rows)
    got = corpus_pipeline.mixed(spark, docs, SF).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {d: n for d, n in taken.items() if n}
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])


def test_both_ways_of_decontamination_agree(spark):
    docs, items = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(decontaminate.leaks(docs, items)) == rows(decontaminate.leaks(docs, items, bound=1))


def test_both_ways_drop_the_same_documents(spark, odd):
    clean = [(1, "a clean line that shares its id with a leaked one", "en", "a", 9), (None, "a clean line without an id", "en", "b", 9), (None, None, "en", "b", None)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(clean, SCHEMA))
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, None), (None, "")], "item_id long, text string")
    rows = lambda df: sorted(map(repr, df.collect()))
    expected = rows(docs.where(~F.col("text").eqNullSafe(PASSAGE)))
    assert len(expected) == 8
    for bound in (1_000_000, 1):
        got = decontaminate.without_leaks(docs, benchmark, bound=bound)
        assert got.columns == docs.columns and rows(got) == expected, bound


@pytest.mark.parametrize(("name", "label", "rare", "size"), [("op5_quality", "quality", 0, "sf0.01"), ("op7_toxicity", "toxic", 1, "sf0.1")])
def test_held_out_scores(spark, name, label, rare, size):
    sf = SF.replace("sf0.001", size)
    got = QUERIES[name](spark, sf).where("held_out").join(common.table(spark, sf, "labels"), "doc_id").toPandas()
    y, score = got[label].to_numpy() == rare, got["score"].to_numpy() * (1 if rare else -1)
    above = (score[y][:, None] > score[~y]).mean() + (score[y][:, None] == score[~y]).mean() / 2
    right = (got["predicted"] == got[label]).to_numpy()
    constant = max(y.mean(), 1 - y.mean())
    assert above > 0.95 and right.mean() > constant + 0.04 and right[y].mean() >= 0.6 and right[~y].mean() >= 0.95, (above, right.mean(), right[y].mean())


def test_pipeline_drops_toxic_documents(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels").where("toxic is not null").select("doc_id", "toxic")
    kept = {r["doc_id"] for r in corpus_pipeline.without_toxic(spark, docs, sf).select("doc_id").collect()}
    toxic, clean = ({r["doc_id"] for r in labels.where(F.col("toxic") == k).collect()} for k in (1, 0))
    assert len(toxic & kept) <= 0.2 * len(toxic) and len(clean & kept) >= 0.97 * len(clean)


SWAP = 4_096


def test_long_words_that_differ_by_a_swap_have_different_codes():
    a = bytearray(b"abcdefgh" * 2_000)
    b = bytearray(a)
    a[5], a[5 + SWAP] = 88, 89
    b[5], b[5 + SWAP] = 89, 88
    raw = np.frombuffer(bytes(a) + b" " + bytes(b), np.uint8)
    w = common.Words(raw, np.array([0, len(raw)]), twice=True)
    assert len(w) == 2 and w.code[0] != w.code[1] and w.other[0] != w.other[1]


def _extremes():
    """Long words that differ by a swap in windows that else are equal, long runs of a byte, ids that are shared."""
    a, b = bytearray(b"abcdefgh" * 2_000), bytearray(b"abcdefgh" * 2_000)
    a[5], a[5 + SWAP] = 88, 89
    b[5], b[5 + SWAP] = 89, 88
    words = PASSAGE.split()
    return [(1, " ".join([*words, a.decode(), *words])), (2, " ".join([*words, b.decode(), *words])), (3, "z" * 4_000), (4, "q " + "z" * 9_000 + " end"), (4, PASSAGE), (4, "another text of the same id"), (None, PASSAGE), (5, None), (6, ""), (7, "é" * 300 + PASSAGE), (8, " \t\n" + PASSAGE.upper() + " " + PASSAGE), (8, PASSAGE)]


def test_byte_strings_of_extremes_equal_brute_force(spark):
    rows = _extremes()
    for k in (1, 7):
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(k)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, _plain_strings(rows)))


def test_windows_of_extremes_equal_brute_force(spark):
    rows = _extremes()
    expected = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone, own = bytearray(len(words)), set()
        held = {tuple(w[s : s + 20]) for d, x in rows if d is not None and doc_id is not None and d < doc_id for w in [(x or "").encode().split()] for s in range(len(w) - 19)}
        for s in range(len(words) - 19 if doc_id is not None else 0):
            window = tuple(words[s : s + 20])
            if window in held or window in own:
                gone[s : s + 20] = b"\1" * 20
            own.add(window)
        expected.append((doc_id, len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone) if not g)).hexdigest()))
    got = windows.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_a_run_of_one_byte_in_thousands_of_documents(spark):
    rows = [(i, f"{i} " + "=" * (60 + i % 40) + f" {i * 7919 % 10_007} ") for i in range(4_000)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), crowds=(50, 500, 2_000)).collect()
    assert sorted(map(tuple, got)) == sorted(_plain_strings(rows))


def test_runs_hold_every_window_once():
    raw = np.frombuffer((PASSAGE * 40).encode(), np.uint8)
    at = np.array([0, 0, 700, 730, len(raw)])
    begin, n, place, _ = substrings.runs(raw, at, 50, np.array([True, True, True, True]))
    windows_ = np.concatenate([np.arange(b, b + k) for b, k in zip(begin, n)])
    assert sorted(windows_.tolist()) == [*range(0, 651), *range(730, len(raw) - 49)]
    assert ((place >= begin + n - 1) & (place <= begin + 26)).all()


def test_matches_by_the_hundred_thousand_cost_in_proportion(spark):
    took = []
    for n in (20_000, 100_000):
        docs = spark.createDataFrame([(1, "a@b.co 10.0.0.1 " * n)], "doc_id long, text string")
        began = time.time()
        r = pii.report(docs).first()
        took.append(time.time() - began)
        assert (r["n_email"], r["n_ip"]) == (n, n) and r["spans"].endswith(f"ip:{16 * n - 9}:{16 * n - 1}")
    assert took[1] < 15 * took[0] + 5


def _rows():
    t = "Mail a@b.co.uk or +1 (555) 010-9999, host 10.0.0.1, card 4111 1111 1111 1111. "
    return [(1, PASSAGE, "en", "a", 1), (2, PASSAGE, "en", "a", 1), (2, PASSAGE, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, t, "en", "b", 2), (None, PASSAGE, "en", "a", 1), (6, "word " * 60_000, "en", None, 3), (7, "ein Wort", "de", "a", 8)]


@pytest.fixture(scope="module")
def odd(spark):
    extra = [F.lit(k).alias(k) for k in ("code", "score", "key", "label", "size_", "n", "part", "features", "hi", "lo", "media", "spans", "row", "chunk", "text_")]
    return spark.createDataFrame(_rows(), SCHEMA).select("*", *extra)


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, SF, "labels")


def _operators(labels, benchmark):
    return {
        "pii": pii.report, "neardup": neardup.classes, "mixing": lambda d: mixing.mixed_documents(d), "leaks": lambda d: decontaminate.leaks(d, benchmark),
        "quality": lambda d: quality.predictions(d, labels), "windows": windows.remove_repeats, "toxicity": lambda d: toxicity.predictions(d, labels),
        "tokens": tokens.section_counts, "media": lambda d: media.described(media.stored_media(d.select("doc_id", "text"))), "substrings": substrings.remove_repeats,
    }


NAMES = ["pii", "neardup", "mixing", "leaks", "quality", "windows", "toxicity", "tokens", "media", "substrings"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, labels, name):
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, None), (None, "")], "item_id long, text string")
    got = _operators(labels, benchmark)[name](odd).collect()
    if name == "leaks":
        assert {r["doc_id"] for r in got} == {1, 2, None}
        return
    assert len(got) == 9
    by = {r["doc_id"]: r for r in got}
    if name == "neardup":
        assert (by[2]["component_id"], by[2]["kept"], by[1]["kept"], by[None]["kept"], by[3]["n_shingles"], by[6]["n_shingles"]) == (1, False, True, True, 0, 1)
    if name == "windows":
        assert (by[1]["n_removed"], by[2]["n_removed"], by[None]["n_removed"], by[3]["n_words"]) == (0, 28, 0, 0)
    if name == "substrings":
        assert (by[1]["n_removed"], by[2]["n_removed"], by[None]["n_removed"], by[6]["n_removed"]) == (0, len(PASSAGE), 0, 0)
    if name == "pii":
        assert [by[5][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [1, 1, 1, 1] and by[3]["spans"] == ""
    if name == "mixing":
        assert by[3]["size"] == 0 and by[3]["taken"] == 0 and all(r["taken"] <= 3 * r["size"] for r in got)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, labels, name):
    empty = spark.createDataFrame([], SCHEMA)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert _operators(labels, benchmark)[name](empty).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = common.stored(stage(spark, docs, SF), "test")
        assert docs.columns == before, name
    ids = {r["doc_id"] for r in docs.collect()}
    assert 1 in ids and 2 not in ids and 7 in ids
    assert "a@b.co.uk" not in docs.where("doc_id = 5").first()["text"]
    assert {"size", "source_size", "target", "taken"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns)
