"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

A document's set is that of its distinct runs of ``words`` words (the whole sequence, where it has fewer).
Two collections of ``halves`` half-keys, each of ROWS minhashes, are computed; the keys of the
``halves`` squared tables are all pairs of a half-key of the first and one of the second collection, so 2 *
halves * ROWS minhashes do the work of halves^2 * 2 * ROWS. Second halves are formed only where a first
half is shared. A pair of similarity s meets in no table with probability below 2 * (1 - s^ROWS)^halves:
2e-5 at 0.85 with 12 halves.

Equal sets are one class from the start, whatever their number. Within the tables no group is paired out:

1. Shingles that one class alone holds can't be shared. A class that holds too many of them has no links,
   and for any two classes they bound the similarity.
2. Every member of a table key is verified against two of its members (that with the fewest such shingles,
   and one by digest). Links give components.
3. Where a key still has members of different components, every pair of them that can still be similar
   enough is verified, found by their rarest shingles and admissible sizes (``_across``). This leaves no
   pair of a key unexamined, unless it is in one component already.

Defined results: null and empty texts have empty sets and no links; a row with a null id has no links and
is kept; repeated rows are one class; very long texts count whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, dropped, mixed, on_batches, signed, stored, text_bytes
from .components import components
from .fitting import slices
from .windows import keyed

ROWS = 3


def shingles(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of each row, by row; and where each row's begin (n+1 places)."""
    w = Words(raw, at, fold=LOWER)
    code, begin = w.runs(words)
    row = w.row[begin]
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < words))
    for k in range(1, words):
        of_k = short[counts[short] == k]
        code, row = np.concatenate([code, w.joined(w.first[of_k], k, salt=k)]), np.concatenate([row, of_k])
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    code, row = code[new], row[new]
    return code, np.searchsorted(row, np.arange(len(at)))


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(at.astype(np.int64)), pa.array(signed(np.ascontiguousarray(values)))).cast(pa.list_(pa.int64()))


def signatures(rows: DataFrame, words: int, halves: int) -> DataFrame:
    """doc_id, row, n, hi, lo (a 128-bit code of the set), a, b (the half-keys of both collections).
    ``rows``: doc_id, text, row."""
    rng = np.random.Generator(np.random.PCG64(99))
    odd = rng.integers(0, 2**63, 2 * halves * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, 2 * halves * ROWS, dtype=np.uint64)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            code, at = shingles(*text_bytes(part.column("text")), words)
            n = np.diff(at)
            some = np.flatnonzero(n)
            starts = at[:-1][some]
            keys = np.zeros((2 * halves, part.num_rows), np.uint64)
            hi, lo = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
            if len(code):
                hi[some], lo[some] = np.add.reduceat(mixed(code + np.uint64(1)), starts), np.add.reduceat(mixed(code ^ _OTHER), starts)
                for h in range(2 * halves):
                    key = np.full(len(some), h, np.uint64)
                    for r in range(ROWS):
                        i = h * ROWS + r
                        key = key * odd[0] + np.minimum.reduceat(code * odd[i] + add[i], starts)
                    keys[h, some] = mixed(key)
            flat = lambda k: _lists(k.T.reshape(-1), np.arange(part.num_rows + 1) * halves)
            yield pa.record_batch([part.column("doc_id"), part.column("row"), pa.array(n.astype(np.int64)), pa.array(signed(hi)), pa.array(signed(lo)), flat(keys[:halves]), flat(keys[halves:])], names=["doc_id", "row", "n", "hi", "lo", "a", "b"])

    return on_batches(rows.select("doc_id", "row", "text"), work, "doc_id long, row long, n long, hi long, lo long, a array<long>, b array<long>")


_OTHER = np.uint64(0x5851F42D4C957F2D)


def set_rows(texts: DataFrame, words: int) -> DataFrame:
    """rid, codes: the full sets of rid, text."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch):
            code, at = shingles(*text_bytes(part.column("text")), words)
            yield pa.record_batch([part.column("rid"), _lists(code, at)], names=["rid", "codes"])

    return on_batches(texts.select("rid", "text"), work, "rid long, codes array<long>")


def _bounded(percent: int) -> Column:
    """Whether classes x and y can reach the similarity: n is a set's size, c that without the shingles
    that it alone holds."""
    most = F.least("xc", "yc")
    return most * 100 >= (F.col("xn") + F.col("yn") - most) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("rid").alias("x"), F.col("codes").alias("xs")), "x").join(sets.select(F.col("rid").alias("y"), F.col("codes").alias("ys")), "y")
    common = F.size(F.array_intersect("xs", "ys"))
    return both.where(common * 100 >= (F.size("xs") + F.size("ys") - common) * percent).select("x", "y")


#: Bands of sizes for each step by the similarity asked for.
BANDS = 8


def _across(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of different components that can reach the similarity, among all of ``rest`` (rid, n,
    label). A set's shingles are put in order of how many sets hold them, rarest first. Sets that are
    similar enough share one of the first few, and the places of the first that they share bound what
    they have in common: so a set asks only for the sizes that its place still allows. Sizes meet by bands,
    BANDS + 1 of them at most for each place whatever the size, and are then compared.

    Shingles of one set alone come first, unseen: they only shift the places of the others."""
    each = sets.join(rest, "rid").select("rid", "n", "label", F.explode("codes").alias("code"))
    # written out, so that the join reads both sides anew and a shingle that many sets hold is split
    held = stored(each.groupBy("code").agg(F.count("*").alias("m")).where("m > 1"), "held")
    lists = each.join(held.hint("merge"), "code").groupBy("rid", "n", "label").agg(F.sort_array(F.collect_list(F.struct("m", "code"))).alias("t"))
    alone = F.col("n") - F.size("t")
    low = F.ceil(F.col("n") * percent / 100).cast("long")
    head = F.slice("t", F.lit(1), F.greatest(F.col("n") - low + 1 - alone, F.lit(0)).cast("int"))
    top = F.floor(((F.col("n") - F.col("i")) * (100 + percent) - F.col("n") * percent) / percent).cast("long")
    places = lists.select("rid", "n", "label", alone.alias("alone"), F.posexplode(head).alias("i", "t"))
    places = places.select("rid", "n", "label", (F.col("i") + F.col("alone")).alias("i"), F.col("t.code").alias("code"))
    places = stored(places.select("rid", "n", "label", "code", low.alias("low"), top.alias("top")).where("low <= top"), "places")
    # in each list of a shingle, the component with most members isn't paired with itself
    main = places.groupBy("code", "label").agg(F.count("*").alias("k")).groupBy("code").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("code", "main")
    main = stored(main, "main")
    marked = stored(places.join(main.hint("merge"), "code").withColumn("is_main", F.col("label") == F.col("main")), "places")
    dropped(held, places, main)
    band = lambda size: F.floor(F.log(size.cast("double")) * (BANDS / math.log(100 / min(percent, 99))))
    high = F.least("n", "top")
    x = marked.select("code", F.col("rid").alias("x"), F.col("n").alias("xn"), F.col("label").alias("xl"), "low", high.alias("high"), "is_main", F.explode(F.sequence(band(F.col("low")), band(high))).alias("band"))
    y = marked.select("code", F.col("rid").alias("y"), F.col("n").alias("yn"), F.col("label").alias("yl"), F.col("top").alias("ytop"), F.col("is_main").alias("y_main"), band(F.col("n")).alias("band"))
    meet = (x["code"] == y["code"]) & (x["band"] == y["band"]) & F.col("yn").between(F.col("low"), F.col("high")) & (F.col("xl") != F.col("yl")) & (F.col("ytop") >= F.col("xn")) & ((F.col("xn") > F.col("yn")) | (F.col("x") < F.col("y")))
    some = x.where("not is_main").join(y, meet).select("x", "y")
    return some.union(x.where("is_main").join(y.where("not y_main"), meet).select("x", "y")).distinct()


def classes(documents: DataFrame, words: int = 3, percent: int = 85, halves: int = 12) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return _classes(keyed(documents), words, percent, halves).drop("row")


def _classes(rows: DataFrame, words: int, percent: int, halves: int) -> DataFrame:
    """doc_id, row, n_shingles, component_id, kept of rows doc_id, text, row."""
    sig = stored(signatures(rows, words, halves), "signatures")
    groups = sig.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "row")).alias("head"), F.any_value("n").alias("n"))
    # classes have numbers of their own, fixed when written: rows that share an id may head several
    groups = stored(groups.select("hi", "lo", "head.*", "n", F.monotonically_increasing_id().alias("rid")), "classes")
    # one row for each class, with its half-keys
    heads = groups.join(sig.select("doc_id", "row", "hi", "lo", "a", "b").dropDuplicates(["doc_id", "row", "hi", "lo"]), ["doc_id", "row", "hi", "lo"])
    first = heads.select("rid", "n", "b", F.posexplode("a").alias("i", "ka"))
    shared = first.groupBy("i", "ka").agg(F.count("*").alias("m")).where("m > 1").select("i", "ka")
    tables = first.join(shared, ["i", "ka"]).select("rid", "n", F.explode(F.transform("b", lambda k, j: F.xxhash64("i", "ka", j, k))).alias("key"))
    tables = stored(tables, "tables")
    crowd = tables.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    tables = stored(tables.join(crowd, "key"), "tables")
    live = tables.select("rid").distinct().join(groups.select("rid", "doc_id", "row"), "rid")
    sets = stored(set_rows(rows.where("doc_id is not null").join(live.hint("shuffle_hash"), ["doc_id", "row"]), words).dropDuplicates(["rid"]), "sets")
    # shingles that one live class alone holds
    alone = sets.select("rid", F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("m"), F.min("rid").alias("rid")).where("m = 1").groupBy("rid").agg(F.count("*").alias("u"))
    able = stored(sets.select("rid", F.size("codes").cast("long").alias("n")).join(alone, "rid", "left").select("rid", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c")).where(F.col("c") * 100 >= F.col("n") * percent), "able")
    tables = stored(tables.select("key", "rid").join(able, "rid"), "tables")
    row = F.struct("rid", "n", "c")
    hubs = tables.groupBy("key").agg(F.min_by(row, F.struct((F.col("n") - F.col("c")) / F.col("n"), "n", "rid")).alias("p"), F.min_by(row, F.struct(F.xxhash64("rid", "key"), "rid")).alias("q"))
    hubs = hubs.select("key", F.explode(F.array_distinct(F.array("p", "q"))).alias("h"))

    def ordered(x: tuple, y: tuple) -> list[Column]:
        swap = x[0] < y[0]
        return [F.when(swap, a).otherwise(b).alias(f"{side}{name}") for side, p, q in (("x", x, y), ("y", y, x)) for name, a, b in zip(("", "n", "c"), p, q, strict=True)]

    member = tuple(F.col(c) for c in ("rid", "n", "c"))
    stars = tables.join(hubs, "key").where(F.col("rid") != F.col("h.rid")).select(*ordered(member, tuple(F.col(f"h.{c}") for c in ("rid", "n", "c")))).where(_bounded(percent)).distinct()
    links = stored(_verified(stars, sets, percent), "links")
    found = components(links)
    # keys whose members are in different components still
    named = tables.join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    named = stored(named, "named")
    apart = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key")
    rest = stored(named.join(apart, "key"), "rest")
    dropped(tables, named)
    cross = _across(rest.select("rid", "n", "label").distinct(), sets, percent)
    more = _verified(cross, sets, percent)
    more = stored(more, "links")
    if not more.isEmpty():
        found = components(links.union(more))
    dropped(sets, able, rest)
    # a component goes by the smallest id in it
    member = groups.select("hi", "lo", "rid", "doc_id").join(found.withColumnRenamed("node", "rid"), "rid")
    member = stored(member.select("hi", "lo", "label", "doc_id"), "members")
    smallest = stored(member.groupBy("label").agg(F.min("doc_id").alias("smallest")), "smallest")
    alike = member.join(smallest.hint("merge"), "label").select("hi", "lo", "smallest")
    final = groups.select("hi", "lo", "doc_id").join(alike, ["hi", "lo"], "left").select("hi", "lo", F.coalesce("smallest", "doc_id").alias("label"))
    out = sig.select("doc_id", "row", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("hi")).alias("hi"), "lo").join(final, ["hi", "lo"], "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(documents: DataFrame, words: int = 5, percent: int = 80, halves: int = 14) -> DataFrame:
    """The documents without those that a smaller id of their group stands for, with all their columns.
    Rows that share an id are told apart by their texts; equal rows stay or go together."""
    gone = stored(_classes(keyed(documents), words, percent, halves).where("not kept").select("doc_id", "row").distinct(), "gone")
    return documents.join(gone.hint("shuffle_hash"), (documents["doc_id"] == gone["doc_id"]) & (F.xxhash64(documents["doc_id"], documents["text"]) == gone["row"]), "left_anti").select(*documents.columns)
