"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import pii

ORACLES: dict[str, str] = {}

_NEAR = pii.NEAR
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": pii.PATTERNS["phone"],
    "iban": pii.PATTERNS["iban"],
    "ssn": pii.PATTERNS["ssn"],
}


def _pii_kind(n: int, kind: str) -> str:
    """(doc_id, ord, kind, start, stop) of the kept matches of one kind."""
    p = _SQL_PATTERNS[kind]
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    alone = "NOT regexp_matches(l, '[0-9A-Za-z-]$') AND NOT regexp_matches(r, '^[0-9A-Za-z-]')"
    turned = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
    code = f"list_transform(string_split({turned}, ''), lambda c: CASE WHEN ascii(c) >= 65 THEN (ascii(c) - 55)::VARCHAR ELSE c END)"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 1 THEN substr({digits}, i::INT, 1)::INT * 2 - CASE WHEN substr({digits}, i::INT, 1)::INT > 4 THEN 9 ELSE 0 END ELSE substr({digits}, i::INT, 1)::INT END)) % 10 = 0"
    mod97 = f"(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(array_to_string({code}, ''), ''), lambda d: d::BIGINT)), lambda a, b: (a * 10 + b) % 97) = 1)"
    test = {
        "email": "TRUE",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: NOT regexp_full_match(x, '0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})'))) = 0",
        "card": f"CASE WHEN length({digits}) BETWEEN 13 AND 19 THEN {luhn} ELSE FALSE END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"{alone} AND length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {mod97}",
        "ssn": f"{alone} AND NOT regexp_matches(m, '^(?:000|666|9[0-9]{{2}})-|-00-|-0000$')",
    }[kind]
    words = lambda w: f"regexp_matches(lower(right(l, {_NEAR}) || ' ' || left(r, {_NEAR})), '(?:^|[^a-z])(?:{w})(?:[^a-z]|$)')"
    score = f"{pii.PRIOR[kind]}::DOUBLE + CASE WHEN {words(pii.CONTEXT[kind])} THEN {pii.BONUS}::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN {words(pii.AGAINST)} THEN {pii.MALUS}::DOUBLE ELSE 0.0::DOUBLE END"
    more = "" if kind in pii.KINDS else f" AND {score} >= {pii.THRESHOLD}::DOUBLE"
    return f"""
    SELECT id, {n} AS ord, '{kind}' AS kind, start, stop FROM (
      SELECT id, m, l, r, (sum(length(l) + length(m)) OVER w - length(m))::BIGINT AS start, (sum(length(l) + length(m)) OVER w)::BIGINT AS stop FROM (
        SELECT id, unnest(ms) AS m, unnest(bs[1:len(ms)]) AS l, unnest(bs[2:]) AS r, unnest(range(len(ms))) AS i FROM (
          SELECT id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS bs FROM d))
      WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE {test}{more}"""


ORACLES["op1_pii"] = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_pii_kind(n, k) for n, k in enumerate(pii.PATTERNS))}),
g AS (SELECT id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)},
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (ord < {len(pii.KINDS)}) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY ord, start) AS spans, count(*) FILTER (ord >= {len(pii.KINDS)}) AS n_added FROM s GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added
FROM d LEFT JOIN g USING (id)"""

ORACLES["op3_source_mixing"] = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k FROM s0),
s2 AS (SELECT *, [5, 2, 1][1 + k % 3] AS w, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level FROM s2
  WINDOW b AS (ORDER BY cap::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, cap::DOUBLE <= level * w AS filled FROM s3),
plan AS (SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE (SELECT level FROM s4 WHERE NOT filled ORDER BY cap::DOUBLE / w, k LIMIT 1) * w END AS target FROM s4),
timed AS (SELECT d.*, source_size, target, CASE WHEN target > 0 THEN (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::DOUBLE / target END AS v,
  CASE WHEN target > 0 THEN source_size::DOUBLE / target END AS p FROM sized d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
events AS (SELECT v + p * i AS v, size FROM timed, (SELECT unnest([0, 1, 2]) AS i) WHERE size > 0),
served AS (SELECT v, sum(sum(size)) OVER (ORDER BY v) AS upto FROM events GROUP BY v),
cut AS (SELECT min(v) AS c FROM served WHERE upto >= (SELECT sum(size) FROM sized))
SELECT doc_id, size, source_size, target, (size * (CASE WHEN v <= c THEN 1 ELSE 0 END + CASE WHEN v + p <= c THEN 1 ELSE 0 END + CASE WHEN v + p * 2 <= c THEN 1 ELSE 0 END))::BIGINT AS taken
FROM timed, cut"""

ORACLES["op6_window_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(x) ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM again)),
each AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _clusters(rounds: int = 5, k: int = 40) -> str:
    """Chained rounds: every vector against every centroid, then floors of the means."""
    fit = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE {fit})",
        f"c0 AS MATERIALIZED (SELECT i, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS i, v FROM kept) WHERE i < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS MATERIALIZED (SELECT r, vec_id, x.v AS v, min(struct_pack(d := list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, i := i)) AS b FROM kept x, c{n} c GROUP BY ALL)")
        if n < rounds:
            mean = "list(CASE WHEN s % n < 0 THEN (s - (s % n + n)) // n ELSE (s - s % n) // n END::DOUBLE ORDER BY e)"
            steps.append(f"s{n} AS (SELECT i, e, sum(y)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT b.i AS i, unnest(v)::BIGINT AS y, unnest(range(64)) AS e FROM d{n}) GROUP BY i, e)")
            steps.append(f"m{n} AS (SELECT i, {mean} AS v FROM s{n} GROUP BY i)")
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.i, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} USING (i))")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, b.i::INT AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.i)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(list_transform(c{rounds}.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
    FROM d{rounds} JOIN c{rounds} ON c{rounds}.i = b.i"""


ORACLES["op11_sort_means"] = _clusters()

# the remainder table of the checksum is worked out from its polynomial
_CRC_TABLE = "SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, s: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295)"
_TURNED = "((k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT)"


def _jump(shards: int) -> str:
    step = f"struct_pack(k := {_TURNED.replace('k *', 's.k *')}, b := s.j, j := floor((s.j + 1)::DOUBLE * (2147483648::DOUBLE / ({_TURNED.replace('k *', 's.k *')} // 8589934592 + 1)::DOUBLE))::BIGINT)"
    begin = "struct_pack(k := (CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END), b := -1::BIGINT, j := 0::BIGINT)"
    return f"list_reduce(list_prepend({begin}, list_transform(range({shards}), lambda i: {begin})), lambda s, i: CASE WHEN s.j < {shards} THEN {step} ELSE s END).b"


ORACLES["op12_jump_sharding"] = f"""
WITH t AS MATERIALIZED ({_CRC_TABLE}),
     d AS MATERIALIZED (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, {_CRC} AS text_crc32, {_jump(8)}::INT AS shard, {_jump(9)}::INT AS grown_shard FROM documents, t)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM d"""

ORACLES["op13_hard_negatives"] = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r AS cr, c.vec_id AS vec_id, a.label = c.label AS own,
         coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
  FROM e a, e c WHERE a.vec_id % 100 = 0),
p AS MATERIALIZED (SELECT * FROM s WHERE own AND ar <> cr QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, cr) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.own AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.ar, p.cr ORDER BY n.score DESC, n.vec_id, n.cr)
QUALIFY row_number() OVER w <= 10"""
