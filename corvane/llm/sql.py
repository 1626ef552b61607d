"""DuckDB SQL that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

from .licenses import LOWER, PHRASES, TEMPLATES, UPPER, prepared

#: A uniform 60-bit number from an id; the seed is the operator's.
KEY = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':{seed}'{more}), 1, 15) AS BIGINT)"

#: What the mix's key has besides.
TEXT = " || ':' || md5(coalesce(text, ''))"

#: Everything that undirected links l (a, b) reach from each a.
REACH = "reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)"

CAPS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x, v y
  WHERE x.vec_id <> y.vec_id AND list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.9
), {REACH}, n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
), c AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.c, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(c.c, v.vec_id)) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""

#: Exact, from all pairs that share a run of five words.
NEAR = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), s AS (
  SELECT doc_id, count(*) AS s FROM g GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), j AS (
  SELECT o.a, o.b, o.o / (x.s + y.s - o.o) AS j FROM o JOIN s x ON x.doc_id = o.a JOIN s y ON y.doc_id = o.b
), l AS (
  SELECT a, b, j FROM j WHERE j >= 0.8
), {REACH}, n AS (
  SELECT a, count(*) AS n, min(b) FILTER (j = 1) AS same FROM l GROUP BY a
), c AS (
  SELECT a, min(b) AS c FROM reach GROUP BY a
)
SELECT d.doc_id, least(d.doc_id, coalesce(n.same, d.doc_id)) AS class_id, coalesce(n.n, 0) AS n_links, least(d.doc_id, coalesce(c.c, d.doc_id)) AS group_id, d.doc_id = least(d.doc_id, coalesce(c.c, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.a = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""


def _licenses() -> str:
    """Every block of words held against every template."""
    ready = prepared(TEMPLATES, 0.8)
    templates = ", ".join(f"('{t.label}', {sorted(t.tokens)}, {len(t.tokens)}, {t.need}, {t.length}, {t.step}, {sorted(t.must)}::VARCHAR[], {sorted(t.without)}::VARCHAR[], {sorted(t.own)}::VARCHAR[])" for t in ready)
    places = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        places.append(f"SELECT k, i - 1 AS at_word, '{label}' AS label FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {test}")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  {" UNION ALL ".join(places)}
), t(label, tokens, n, need, length, step, must, without, own) AS (VALUES {templates}), b AS (
  SELECT k, label, tokens, n, need, must, without, own, list_distinct(w[i + 1:i + length]) AS b
  FROM (SELECT k, w, t.*, unnest(range(0, len(w), step)) AS i FROM d, t WHERE len(list_intersect(w, tokens)) >= need)
), m AS (
  SELECT k, label, len(list_intersect(b, tokens)) / n AS held FROM b WHERE len(list_intersect(b, tokens)) >= need AND list_has_all(b, must) AND NOT list_has_any(b, without) AND (len(own) = 0 OR list_has_any(b, own))
), x AS (
  SELECT k, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word FROM p GROUP BY k
), y AS (
  SELECT k, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM p GROUP BY k
), z AS (
  SELECT k, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(held) AS best FROM (SELECT k, label, held FROM m UNION ALL SELECT k, label, 0 FROM p) GROUP BY k
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN x USING (k) LEFT JOIN y USING (k) LEFT JOIN z USING (k)
"""


LICENSES = _licenses()


def _shards(limit: int) -> str:
    return f"""
WITH k AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, {KEY.format(seed=5, more="")} AS h FROM documents
), p AS (
  SELECT d.depth, k.h >> (60 - d.depth) AS prefix, sum(k.bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM k, (SELECT unnest(range(0, 25)) AS depth) d GROUP BY ALL HAVING sum(k.bytes) <= {limit}
), b AS (
  SELECT k.doc_id, k.bytes, k.h, min(p.depth) AS depth FROM k JOIN p ON p.prefix = k.h >> (60 - p.depth) GROUP BY ALL
)
SELECT b.doc_id, b.bytes, b.depth::INT AS depth, CASE WHEN b.depth = 0 THEN '' ELSE lpad(bin(p.prefix), b.depth::INT, '0') END AS shard, p.shard_bytes, p.shard_docs
FROM b JOIN p ON p.depth = b.depth AND p.prefix = b.h >> (60 - b.depth)
"""

#: Targets after one, two, .. rounds of resharing: a source is capped once its
#: share passes twice its size; the others share what is left by weight.
MIX = f"""
WITH RECURSIVE k AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, {KEY.format(seed=7, more=TEXT)} AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM k GROUP BY source
), t(round, source, source_size, w, capped, level) AS (
  SELECT 0, source, source_size, w, false, 1.5::DOUBLE * sum(source_size) OVER () / sum(w) OVER () FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w, now,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) FILTER (now) OVER (), 0)) / sum(w) FILTER (NOT now) OVER ()
  FROM (SELECT *, capped OR w * level > 2 * source_size AS now FROM t) WHERE round < 60
), f AS (
  SELECT source, source_size, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE w * level END AS target FROM t WHERE round = 60
), o AS (
  SELECT k.doc_id, k.size, f.source_size, f.target, floor(f.target)::BIGINT AS budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.h, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS start
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget % source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM o
"""

#: The plain patterns of the base kinds, and what a match must also meet.
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and([coalesce(try_cast(p AS HUGEINT) <= 255, false) FOR p IN string_split(m, '.')])"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "len(digits) BETWEEN 16 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN v WHEN v > 4 THEN 2 * v - 9 ELSE 2 * v END FOR v, i IN [x::INT FOR x IN string_split(reverse(digits), '') IF x <> '']]) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(digits) BETWEEN 8 AND 15"),
}


def _base_spans() -> str:
    """Spans of each kind from what stands between the matches."""
    kinds = " UNION ALL ".join(
        f"SELECT k, {order} AS o, '{kind}' AS kind, s, s + len(m) AS e FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM ("
        f"SELECT k, found[i] AS m, list_sum([len(x) FOR x IN gaps[1:i]]) + coalesce(list_sum([len(x) FOR x IN found[1:i - 1]]), 0) AS s FROM ("
        f"SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps FROM d)))) WHERE {test}"
        for order, (kind, (pattern, test)) in enumerate(PLAIN.items())
    )
    counts = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in PLAIN)
    sums = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in PLAIN)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  {kinds}
), a AS (
  SELECT k, {sums}, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY o, s) AS told FROM m GROUP BY k
)
SELECT doc_id, {counts}, sha256(coalesce(told, '')) AS base_sha256 FROM d LEFT JOIN a USING (k)
"""


ORACLES = {
    "op1_ngram_join": NEAR,
    "pii_base": _base_spans(),
    "op3_license_scan": LICENSES,
    "op4_cap_filters": CAPS,
    "op5_sharding": _shards(16 << 20),
    "shards_of_64_kib": _shards(64 << 10),
    "op7_mixing": MIX,
}
