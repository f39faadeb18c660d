"""Personal data in texts, in DataFrame operations only: regular expressions propose spans, checksums
confirm them, and words close by adjust their score.

Base kinds (email, ip, card, phone) keep every proposal that passes its check; the method adds ``iban``
(confirmed by mod 97) and ``ssn``, a number that is kept only where its score, with the words close by,
reaches the threshold. A match and the text between two matches of one kind follow from the same
expression, so positions are running sums of lengths and the words close by are the ends of the text
between: the work is in proportion to the text, however many matches it has.

Defined results: a null or empty text has no spans; a text is searched whole; positions are code points;
repeated rows have equal results; other columns are carried along, but for names that begin with ``_pii``
and, by ``find``, ``spans``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Proposals. \G (the end of the last match) and the look-behind start a match only where a run of its
# first class starts, and possessive runs give nothing back: neither changes a match, both keep the
# search linear in texts that are one long run. A card's run of digits under 13 can't pass, so it
# isn't proposed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a proposal that passed its check, before the words close by.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
#: Words close by that speak for a kind, and those that speak against any.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|address|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|fax|mobile",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social|security|taxpayer",
}
AGAINST = "version|isbn|example|sample|order"
BONUS, MALUS, THRESHOLD, NEAR = 0.2, 0.3, 0.5, 40


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 above 9; the sum must end in 0."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda i: value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(i)).otherwise(value(i)))
    return total % 10 == 0


def _mod97(m: Column) -> Column:
    """The first four characters go last, letters count as 10 to 35, and the number leaves 1 mod 97."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    code = F.ascii
    step = lambda s, c: F.when(code(c) >= 65, (s * 100 + code(c) - 55) % 97).otherwise((s * 10 + code(c) - 48) % 97)
    left = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda s, i: step(s, F.substring(turned, i, F.lit(1))))
    return F.length(plain).between(15, 34) & (left == 1)


def _passes(kind: str, m: Column, left: Column, right: Column) -> Column:
    """``left`` and ``right``: the text around the match."""
    alone = ~left.rlike("[0-9A-Za-z-]$") & ~right.rlike("^[0-9A-Za-z-]")
    digits = F.length(_digits(m))
    if kind == "ip":
        return ~F.exists(F.split(m, r"\."), lambda p: ~p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(digits.between(13, 19), _luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return digits.between(9, 15)
    if kind == "iban":
        return alone & _mod97(m)
    if kind == "ssn":
        return alone & ~m.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$")
    return F.lit(True)


def _score(kind: str, near: Column) -> Column:
    words = lambda any_of: F.lower(near).rlike(f"(?:^|[^a-z])(?:{any_of})(?:[^a-z]|$)")
    return F.lit(PRIOR[kind]) + F.when(words(CONTEXT[kind]), BONUS).otherwise(0.0) - F.when(words(AGAINST), MALUS).otherwise(0.0)


def _blocks(values: Column, size: int = 256) -> Column:
    """An array cut into arrays of ``size``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, F.lit(size)))


def _running(values: Column, step, zero: Column, kind: str) -> Column:
    """step over the values so far, for each place. An array grows by copying, so short ones alone are grown."""
    last = lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), zero)
    return F.aggregate(values, F.array().cast(f"array<{kind}>"), lambda s, v: F.concat(s, F.array(step(last(s), v))))


def with_running(df: DataFrame, name: str, values: Column, step, zero: Column, kind: str = "bigint") -> DataFrame:
    """Add ``name``: step over the values of an array so far, for each of its places; null where ``values`` is.
    Within blocks first, then the blocks' ends: work grows little faster than the array."""
    whole = F.col(f"{name}_in")
    df = df.withColumn(f"{name}_in", F.transform(F.when(F.size(values) > 0, _blocks(values)), lambda b: _running(b, step, zero, kind)))
    ends = F.transform(whole, lambda b: F.element_at(b, -1))
    df = df.withColumn(f"{name}_to", F.when(whole.isNotNull(), _running(ends, step, zero, kind)))
    # an argument, not part of the lambda: that would be worked out for each place
    before = F.concat(F.array(zero), F.slice(f"{name}_to", F.lit(1), F.size(f"{name}_to") - 1))
    done = F.flatten(F.zip_with(whole, before, lambda b, o: F.transform(b, lambda v: step(o, v))))
    return df.withColumn(name, done).drop(f"{name}_in", f"{name}_to")


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``spans``: array<struct<kind, start, end, score>> by kind in the order of PATTERNS, then start."""
    given = [c for c in df.columns if c != "spans"]
    body, none = F.col("_pii_text"), F.lit(0).cast("bigint")
    df = df.select(*given, F.coalesce(F.col(text), F.lit("")).alias("_pii_text"))
    found = {k: F.regexp_extract_all(body, F.lit(p), F.lit(0)) for k, p in PATTERNS.items()}
    some = {k: F.when(F.contains(body, F.lit(NEEDS[k])), found[k]) if k in NEEDS else found[k] for k in PATTERNS}
    df = df.withColumns({f"_pii_m_{k}": F.when(F.size(some[k]) > 0, some[k]) for k in PATTERNS})
    df = df.withColumns({f"_pii_b_{k}": F.when(F.col(f"_pii_m_{k}").isNotNull(), F.split(body, p, -1)) for k, p in PATTERNS.items()})
    for k in PATTERNS:
        sizes = F.transform(f"_pii_m_{k}", (lambda k: lambda m, i: (F.length(m) + F.length(F.get(f"_pii_b_{k}", i))).cast("bigint"))(k))
        df = with_running(df, f"_pii_e_{k}", sizes, lambda s, v: s + v, none)

    def kept(k: str) -> Column:
        m, b, e = (F.col(f"_pii_{x}_{k}") for x in "mbe")

        def span(i: Column) -> Column:
            one, left, right = F.get(m, i), F.get(b, i), F.get(b, i + 1)
            near = F.concat(F.right(left, F.lit(NEAR)), F.lit(" "), F.left(right, F.lit(NEAR)))
            made = F.struct(F.lit(k).alias("kind"), (F.get(e, i) - F.length(one)).alias("start"), F.get(e, i).alias("end"), _score(k, near).alias("score"))
            return F.when(_passes(k, one, left, right), made)

        spans = F.filter(F.transform(F.sequence(F.lit(0), F.size(m) - 1), span), lambda s: s.isNotNull())
        return spans if k in KINDS else F.filter(spans, lambda s: s["score"] >= THRESHOLD)

    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return df.select(*given, F.concat(*(F.when(F.col(f"_pii_m_{k}").isNotNull(), kept(k)).otherwise(empty) for k in PATTERNS)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, the number of each base kind, base_sha256, spans (text) and n_added of every document."""
    df = find(documents.select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter(F.col("spans"), lambda s: s["kind"].isin(*KINDS))
    number = lambda k: F.size(F.filter(F.col("spans"), lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return df.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the one that starts
    first is taken and reaches as far as any that it meets. A text without spans, or null, is unchanged, and
    so is a column ``spans``."""
    given = df.columns
    df = find(df.withColumnRenamed("spans", "_pii_given"), text)
    df = df.withColumn("_pii_sorted", F.sort_array(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))))
    # how far the spans up to each reach; one that starts no sooner than those before it end begins anew
    df = with_running(df, "_pii_reach", F.transform("_pii_sorted", lambda s: s["end"]), lambda s, v: F.greatest(s, v), F.lit(0).cast("bigint"))
    s, reach, body = F.col("_pii_sorted"), F.col("_pii_reach"), F.col(text)
    anew = lambda i: F.coalesce(F.get(s, i)["start"] >= F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0)), F.lit(False))
    df = df.withColumn("_pii_first", F.filter(F.sequence(F.lit(0), F.size(s) - 1), anew))
    first = F.col("_pii_first")
    # between two groups: the text from the reach before the later one's first span to its start
    before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0).cast("bigint"))
    piece = lambda i: F.concat(F.substring(body, (before(i) + 1).cast("int"), (F.get(s, i)["start"] - before(i)).cast("int")), F.lit("["), F.upper(F.get(s, i)["kind"]), F.lit("]"))
    rest = F.substring(body, (F.element_at(reach, -1) + 1).cast("int"), F.length(body))
    done = F.when(F.size(s) > 0, F.concat(F.array_join(F.transform(first, piece), ""), rest)).otherwise(body)
    return df.select(*(done.alias(text) if c == text else F.col("_pii_given").alias(c) if c == "spans" else F.col(c) for c in given))
