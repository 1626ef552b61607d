"""DuckDB SQL that gives the same rows as the queries of the registry."""

from __future__ import annotations

import string

BLANK = r"[\s\p{Z}\x{85}\x0B]+"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{BLANK}'), lambda x: x <> '')"


def sentences(text: str) -> str:
    return rf"regexp_extract_all({text}, '(?s)(?:.*?[.!?][ \n]|.+$)')"


def letters(text: str) -> str:
    low = f"lower({text})"
    return "[" + ", ".join(f"(length({low}) - length(replace({low}, '{c}', '')))::DOUBLE" for c in string.ascii_lowercase) + "]"


def cosine(a: str, b: str) -> str:
    size = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {size} > 0 THEN list_dot_product({a}, {b}) / {size} ELSE 0 END"


UNITS = f"u AS (SELECT CAST(doc_id AS VARCHAR) AS unit_id, text, lang, source, {tokens('text')} AS words FROM documents)"
QUESTIONS = f"q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, item_id, text, {tokens('text')} AS words FROM benchmark)"
POSTINGS = """
p AS (SELECT unit_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT unit_id, len(words) AS length, unnest(words) AS term FROM u) GROUP BY unit_id, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
n AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM u)
"""
ASKED = "a AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(words) AS term FROM q) GROUP BY ALL)"
#: Rounded scores of all pairs.
SCORED = """
s AS (
  SELECT query_id, unit_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)) * times), 6) AS score
  FROM a JOIN p USING (term) JOIN f USING (term), n GROUP BY query_id, unit_id
)
"""


def bm25(candidates: str = "SELECT * FROM s", units: str = UNITS, questions: str = QUESTIONS, top_k: int = 10) -> str:
    """The CTEs up to r, the ranked list."""
    return f"""WITH {units}, {questions}, {POSTINGS}, {ASKED}, {SCORED}, c AS ({candidates}), r AS (
      SELECT * FROM (SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM c WHERE score > 0) WHERE rank <= {top_k}
    )"""


RANKED = "SELECT query_id, rank::INT AS rank, unit_id, score FROM"
NEAR = f"""
v AS (
  SELECT * FROM (
    SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank
    FROM (SELECT x.query_id, y.unit_id, round({cosine('x.e', 'y.e')}, 6) AS score
          FROM (SELECT query_id, {letters('text')} AS e FROM q) x, (SELECT unit_id, {letters('text')} AS e FROM u) y)
  ) WHERE rank <= 10
)
"""


def fixed(size: int, overlap: int, where: str = "true", text: str = "text") -> str:
    """CTEs up to i: windows k with their bytes."""
    step = size - overlap
    return f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, lang, source, encode({text}) AS b, octet_length(encode({text})) AS n FROM documents WHERE {where}),
    k AS (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(n - {size}, 0) / {step}) AS BIGINT))) AS k FROM d WHERE n > 0),
    i AS (SELECT id || '-' || k AS unit_id, id AS source_doc_id, text, lang, source, n, (k * {step})::INT AS start_byte, least(k * {step} + {size}, n)::INT AS end_byte, b[k * {step} + 1:least(k * {step} + {size}, n)] AS data FROM k)"""


SPANS = "unit_id, source_doc_id, start_byte, end_byte, lower(hex(data)) AS data"
SENTENCES = f"""
t AS (SELECT CAST(doc_id AS VARCHAR) AS id, encode(text) AS b, {sentences('text')} AS said FROM documents),
e AS (SELECT id, b, len(said) AS n, list_transform(range(0, len(said) + 1), lambda k: coalesce(list_sum(list_transform(said[1:k], lambda x: octet_length(encode(x)))), 0)) AS ends FROM t)
"""


def sentence(size: int, overlap: int) -> str:
    reach = lambda i: f"greatest({i} + 1, len(list_filter(ends, lambda x: x <= ends[{i} + 1] + {size})) - 1)"
    following = f"CASE WHEN {overlap} > 0 AND {overlap} < j - i THEN j - {overlap} ELSE j END"
    return f"""WITH RECURSIVE {SENTENCES}, w(id, k, i, j) AS (
      SELECT id, 0, 0, {reach('0')} FROM e WHERE n > 0
      UNION ALL
      SELECT id, k + 1, i, {reach('i')} FROM (SELECT w.id, w.k, {following} AS i, e.n, e.ends FROM w JOIN e USING (id)) WHERE i < n
    )
    SELECT w.id || '-' || k AS unit_id, w.id AS source_doc_id, ends[i + 1]::INT AS start_byte, ends[j + 1]::INT AS end_byte, lower(hex(b[ends[i + 1]::BIGINT + 1:ends[j + 1]::BIGINT])) AS data FROM w JOIN e USING (id)"""


def recursive(size: int, overlap: int) -> str:
    """Level by level: ranges r that are still too long are cut behind each separator
    (p), and neighbours joined while they fit (w)."""
    steps = []
    for level, mark in enumerate(("chr(10) || chr(10)", "chr(10)", "'. '", "' '")):
        reach = lambda i: f"greatest({i} + 1, len(list_filter(ends, lambda x: x <= ends[{i} + 1] + {size})) - 1)"
        steps.append(f"""s{level} AS (
          SELECT id, low, high, string_split(decode(b[low + 1:high]), {mark}) AS parts FROM r{level} JOIN d USING (id) WHERE high - low > {size}
        ), l{level} AS (
          SELECT id, low, high, list_filter([octet_length(encode(x)) + CASE WHEN i < len(parts) THEN length({mark}) ELSE 0 END FOR x, i IN parts], lambda x: x > 0) AS lengths FROM s{level}
        ), p{level} AS (
          SELECT id, low, high, len(lengths) AS n, [low + coalesce(list_sum(lengths[1:k]), 0)::BIGINT FOR k IN range(0, len(lengths) + 1)] AS ends FROM l{level} WHERE len(lengths) > 1
        ), w{level}(id, low, i, j) AS (
          SELECT id, low, 0::BIGINT, {reach('0')} FROM p{level}
          UNION ALL
          SELECT w{level}.id, w{level}.low, w{level}.j, {reach(f'w{level}.j')} FROM w{level} JOIN p{level} USING (id, low) WHERE w{level}.j < n
        ), r{level + 1} AS (
          SELECT id, ends[i + 1] AS low, ends[j + 1] AS high FROM w{level} JOIN p{level} USING (id, low)
          UNION ALL
          SELECT id, low, high FROM r{level} ANTI JOIN p{level} USING (id, low)
        )""")
    last = len(steps)
    return f"""WITH RECURSIVE d AS (
      SELECT CAST(doc_id AS VARCHAR) AS id, encode(text) AS b FROM documents
    ), r0 AS (
      SELECT id, 0::BIGINT AS low, octet_length(b)::BIGINT AS high FROM d WHERE octet_length(b) > 0
    ), {", ".join(steps)}, c AS (
      SELECT id, low, high FROM r{last} WHERE high - low <= {size}
      UNION ALL
      SELECT id, pos AS low, least(pos + {size}, high) AS high FROM (SELECT id, high, unnest(range(low, high, {size})) AS pos FROM r{last} WHERE high - low > {size})
    ), k AS (
      SELECT id, low, high, row_number() OVER (PARTITION BY id ORDER BY low) - 1 AS k FROM c
    ), i AS (
      SELECT id, id || '-' || k AS unit_id, CASE WHEN k > 0 THEN greatest(low - {overlap}, 0) ELSE low END AS start_byte, high AS end_byte FROM k
    ) SELECT unit_id, id AS source_doc_id, start_byte::INT AS start_byte, end_byte::INT AS end_byte, lower(hex(b[start_byte + 1:end_byte])) AS data FROM i JOIN d USING (id)"""


#: Letters of chunks, from their bytes.
BYTE_LETTERS = "[" + ", ".join(f"len(list_filter(pairs, lambda h: h = '{ord(c):02X}' OR h = '{ord(c.upper()):02X}'))::DOUBLE" for c in string.ascii_lowercase) + "]"


def stored_search(where: str, keep: str = "true") -> str:
    """The chunks nearest by letters to each item, of those that it sees."""
    return f"""{fixed(1024, 0)}, h AS (
      SELECT unit_id, source, lang, regexp_extract_all(hex(data), '..') AS pairs FROM i
    ), y AS (
      SELECT unit_id, source, lang, {BYTE_LETTERS} AS e FROM h
    ), x AS (
      SELECT CAST(item_id AS VARCHAR) AS query_id, item_id, {letters('text')} AS e FROM benchmark
    ), z AS (
      SELECT query_id, unit_id, lang, round({cosine('x.e', 'y.e')}, 6) AS score FROM x JOIN y ON {where}
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM z
    ) {RANKED} r WHERE rank <= 10 AND {keep}"""


SEMANTIC = f"""
WITH RECURSIVE {SENTENCES}, o AS (
  SELECT id, unnest(said) AS said, unnest(range(0, len(said))) AS pos FROM t
), l AS (
  SELECT id, pos, octet_length(encode(said)) AS size, {letters('said')} AS v, lag({letters('said')}) OVER (PARTITION BY id ORDER BY pos) AS before FROM o
), g AS (
  SELECT id, size, sum(CASE WHEN pos > 0 AND {cosine('before', 'v')} < 0.7 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS segment FROM l
), z AS (
  SELECT id, segment, sum(size)::BIGINT AS size FROM g GROUP BY ALL
), w(id, segment, begin_, end_) AS (
  SELECT id, segment, 0::BIGINT, size FROM z WHERE segment = 0
  UNION ALL
  SELECT w.id, z.segment, CASE WHEN end_ + size - begin_ <= 600 THEN begin_ ELSE end_ END, end_ + size FROM w JOIN z ON z.id = w.id AND z.segment = w.segment + 1
), c AS (
  SELECT id, begin_, max(end_) AS end_ FROM w GROUP BY ALL
)
SELECT c.id || '-' || (row_number() OVER (PARTITION BY c.id ORDER BY begin_) - 1) AS unit_id, c.id AS source_doc_id, begin_::INT AS start_byte, end_::INT AS end_byte, lower(hex(b[begin_ + 1:end_])) AS data
FROM c JOIN t USING (id)
"""

VECTORS = "v AS (SELECT CAST(vec_id AS VARCHAR) AS unit_id, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def knn(where: str = "true") -> str:
    return f"""WITH {VECTORS}, s AS (
      SELECT q.unit_id AS query_id, v.unit_id, round({cosine('q.e', 'v.e')}, 6) AS score FROM v, (SELECT * FROM v WHERE vec_id % 50 = 0) q WHERE {where}
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s)
    {RANKED} r WHERE rank <= 10"""


FACTS = """
t AS (
  SELECT 'n' || n_nationkey AS unit_id, n_name AS subject, 'in region' AS predicate, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 's' || s_suppkey, s_name, 'based in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
)
"""
IDS = "SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents WHERE "
SUBJECT = "'user' || (CAST(r.query_id AS BIGINT) % 5)"
#: Children of a document are its sentences.
CHILDREN = f"""u AS (
  SELECT id || '-' || k AS unit_id, id AS parent_id, {tokens('said')} AS words
  FROM (SELECT CAST(doc_id AS VARCHAR) AS id, unnest({sentences('text')}) AS said, unnest(range(0, len({sentences('text')}))) AS k FROM documents)
)"""
CASES = "m AS (SELECT r.query_id, r.rank, r.unit_id, coalesce(CAST(substr(x.source, 4) AS INT) = CAST(r.query_id AS BIGINT) % 20, false) AS hit FROM r JOIN u x USING (unit_id))"
CONTEXT = "k AS (SELECT q.query_id, q.text, coalesce((SELECT string_agg(u.text, chr(10) || chr(10) ORDER BY r.rank) FROM r JOIN u USING (unit_id) WHERE r.query_id = q.query_id), '') AS context FROM q)"

ORACLES = {
    "doc_fingerprint": "SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS fingerprint, octet_length(encode(text)) AS size FROM documents",
    "doc_construct": "SELECT CAST(doc_id AS VARCHAR) AS document_id, 'text/plain' AS mime_type, octet_length(encode(text)) AS size, source AS tenant_id, lang AS language, 'doc://' || doc_id AS source_uri FROM documents",
    "doc_changed_anti": "SELECT CAST(doc_id AS VARCHAR) AS document_id, lang FROM documents WHERE lang = 'de'",
    "token_count": r"SELECT CAST(doc_id AS VARCHAR) AS document_id, len(regexp_extract_all(text, '[\p{P}\p{S}]|[^\s\p{Z}\x{85}\x0B\p{P}\p{S}]+'))::INT AS n_tokens FROM documents",
    "token_count_approx": "SELECT CAST(doc_id AS VARCHAR) AS document_id, (octet_length(encode(text)) // 4)::INT AS n_tokens FROM documents",
    "bm25_tokens": f"SELECT CAST(doc_id AS VARCHAR) AS document_id, len({tokens('text')})::INT AS n_tokens, len(list_distinct({tokens('text')}))::INT AS n_distinct FROM documents",
    "parse_score": r"SELECT CAST(doc_id AS VARCHAR) AS document_id, coalesce(CAST(nullif(regexp_extract(text, '\d+\.?\d*'), '') AS DOUBLE), 0) AS score FROM documents",
    "chunk_fixed": f"{fixed(512, 0)} SELECT {SPANS} FROM i",
    "chunk_fixed_overlap": f"{fixed(512, 64)} SELECT {SPANS} FROM i",
    "chunk_sentence": sentence(512, 0),
    "chunk_sentence_overlap": sentence(256, 2),
    "chunk_semantic": SEMANTIC,
    "chunk_recursive": recursive(512, 0),
    "chunk_recursive_overlap": recursive(400, 50),
    "chunk_late": f"{fixed(512, 64)} SELECT unit_id, true AS late, len(list_filter(regexp_extract_all(hex(data), '..'), lambda h: h BETWEEN '41' AND '5A' OR h BETWEEN '61' AND '7A')) AS letters FROM i",
    "chunk_contextual": f"{fixed(512, 64)} SELECT unit_id, 'of ' || n || ' bytes' AS context_prefix, octet_length(data)::INT AS n_bytes FROM i",
    "chunk_proposition": f"SELECT id || '-' || k AS unit_id, id AS source_doc_id, said AS text, n AS end_byte FROM (SELECT CAST(doc_id AS VARCHAR) AS id, octet_length(encode(text))::INT AS n, unnest({sentences('text')}) AS said, unnest(range(0, len({sentences('text')}))) AS k FROM documents)",
    "bm25_tf": f"WITH {UNITS}, {POSTINGS} SELECT term, unit_id, tf FROM p",
    "bm25_df": f"WITH {UNITS}, {POSTINGS} SELECT term, df FROM f",
    "bm25_stats": f"WITH {UNITS}, {POSTINGS} SELECT n, round(mean, 6) AS mean FROM n",
    "bm25_topk": f"{bm25()} {RANKED} r",
    "bm25_filtered": f"{bm25('SELECT s.* FROM s JOIN u USING (unit_id) WHERE u.lang IN (' + chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'fr' + chr(39) + ')')} {RANKED} r",
    "bm25_repeated_terms": f"{bm25().replace('* times)', '* times * 2)')} {RANKED} r",
    "knn_batch": knn(),
    "knn_filtered": knn("v.label IN (1, 2, 3, 4) AND v.label IN (3, 4, 5)"),
    "knn_topk": f"""WITH {VECTORS}, m AS (SELECT list(x ORDER BY pos) AS e FROM (SELECT pos, round(avg(x), 4) AS x FROM (SELECT unnest(e) AS x, unnest(range(0, len(e))) AS pos FROM v) GROUP BY pos))
        SELECT v.unit_id, round({cosine('m.e', 'v.e')}, 6) AS score FROM v, m ORDER BY {cosine('m.e', 'v.e')} DESC, v.unit_id LIMIT 10""",
    "filter_eq": IDS + "lang = 'fr'",
    "filter_in": IDS + "source IN ('src1', 'src2', 'src3')",
    "filter_any_of": IDS + "lang = 'de' OR source = 'src7'",
    "filter_all": IDS + "lang = 'en' AND source IN ('src0', 'src4')",
    "filter_missing": IDS + "false",
    "filter_events": "SELECT event_id FROM events WHERE props ->> '$.k' = '42'",
    "vector_letters": f"WITH {UNITS}, {QUESTIONS}, {NEAR} {RANKED} v",
    "hybrid_rrf": f"""{bm25()}, {NEAR}, b AS (
        SELECT query_id, unit_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, unit_id, rank FROM r UNION ALL SELECT query_id, unit_id, rank FROM v) GROUP BY ALL
    ), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM b) {RANKED} x WHERE rank <= 10""",
    "ensemble": f"""{bm25()}, {NEAR}, b AS (
        SELECT query_id, unit_id, arg_min(score, (list, rank)) AS score FROM (SELECT 0 AS list, query_id, unit_id, rank, score FROM r UNION ALL SELECT 1, query_id, unit_id, rank, score FROM v) GROUP BY ALL
    ), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM b) {RANKED} x WHERE rank <= 10""",
    "router": f"""{bm25()}, {NEAR}, x AS (
        SELECT r.* FROM r JOIN q USING (query_id) WHERE contains(lower(q.text), ' the ') UNION ALL SELECT v.query_id, v.unit_id, v.score, v.rank FROM v JOIN q USING (query_id) WHERE NOT contains(lower(q.text), ' the ')
    ) {RANKED} x""",
    "graph_match": f"""WITH {FACTS}, q AS (SELECT CAST(r_regionkey AS VARCHAR) AS query_id, {tokens("'region ' || r_name || ' nation'")} AS terms FROM region), s AS (
        SELECT query_id, unit_id, len(list_filter(terms, lambda x: contains(lower(subject || ' ' || predicate || ' ' || object), x))) / len(terms) AS score FROM t, q
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM s WHERE score > 0)
    SELECT query_id, rank::INT AS rank, unit_id, round(score, 6) AS score FROM r WHERE rank <= 20""",
    "fact_text": f"WITH {FACTS} SELECT unit_id, subject || ' is related to ' || object || ' via ' || predicate || '.' AS as_text FROM t",
    "small_to_big": f"""{bm25(units=CHILDREN, top_k=20)}, g AS (
        SELECT query_id, parent_id, min(rank) AS pos, max(score) AS score FROM r JOIN u USING (unit_id) GROUP BY ALL
    ) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY pos))::INT AS rank, parent_id AS unit_id, score FROM g""",
    "structured_units": """SELECT 'q1' AS query_id, (row_number() OVER (ORDER BY c_mktsegment))::INT AS rank, 'row-' || (row_number() OVER (ORDER BY c_mktsegment) - 1) AS unit_id, 'warehouse' AS source_doc_id,
        '[row] n: ' || count(*) || ', segment: ' || c_mktsegment AS as_text, 1.0::DOUBLE AS score FROM customer GROUP BY c_mktsegment""",
    "web_results": """SELECT CAST(r_regionkey AS VARCHAR) AS query_id, pos::INT AS rank, url AS unit_id, 'web' AS source_doc_id, round(1 - 0.01 * (pos - 1), 6)::DOUBLE AS score, sha256(html) AS text_sha256
        FROM (SELECT r_regionkey, url, html, row_number() OVER (PARTITION BY r_regionkey ORDER BY page_id) AS pos FROM region JOIN pages ON page_id % 5 = r_regionkey) WHERE pos <= 10""",
    "litm_reorder": f"""{bm25()}, x AS (SELECT *, rank - 1 AS k, count(*) OVER (PARTITION BY query_id) AS n FROM r)
        SELECT query_id, (1 + CASE WHEN k % 2 = 0 THEN k // 2 ELSE n - 1 - k // 2 END)::INT AS rank, unit_id, score FROM x""",
    "crossencoder": f"""{bm25()}, o AS (
        SELECT r.query_id, r.unit_id, round(len(list_intersect(list_distinct(q.words), list_distinct(u.words))) / len(list_distinct(q.words)), 6) AS score FROM r JOIN q USING (query_id) JOIN u USING (unit_id)
    ), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM o WHERE score >= 0.1) {RANKED} x WHERE rank <= 5""",
    "auth_post": f"{bm25()} SELECT r.query_id, r.rank::INT AS rank, r.unit_id, r.score FROM r JOIN u USING (unit_id) WHERE CAST(substr(u.source, 4) AS INT) % 5 = CAST(r.query_id AS BIGINT) % 5",
    "auth_pre": f"{bm25('SELECT s.* FROM s JOIN u USING (unit_id) WHERE CAST(substr(u.source, 4) AS INT) % 5 = 3')} {RANKED} r",
    "auth_roles": f"""{bm25()} SELECT r.query_id, r.rank::INT AS rank, r.unit_id, r.score FROM r JOIN u USING (unit_id)
        WHERE {SUBJECT} = 'user4' OR ({SUBJECT} = 'user0' AND u.lang = 'en') OR ({SUBJECT} = 'user2' AND u.lang = 'fr')""",
    "auth_tenant": f"{bm25('SELECT s.* FROM s JOIN u USING (unit_id) WHERE CAST(substr(u.source, 4) AS INT) = CAST(s.query_id AS BIGINT) % 20')} {RANKED} r",
    "eval_precision_recall": f"""{bm25()}, {CASES}, z AS (SELECT CAST(substr(source, 4) AS INT) AS number, count(*) AS n FROM u GROUP BY ALL)
        SELECT q.query_id AS case_id, CASE WHEN z.n IS NOT NULL THEN coalesce(round(avg(m.hit::INT), 6), 0) END AS context_precision, round(coalesce(sum(m.hit::INT), 0) / z.n, 6) AS context_recall
        FROM q LEFT JOIN m USING (query_id) LEFT JOIN z ON z.number = q.item_id % 20 GROUP BY q.query_id, z.n""",
    "eval_context": f"{bm25()}, {CONTEXT} SELECT query_id AS case_id, sha256(context) AS context_sha256 FROM k WHERE context <> ''",
    "eval_judged": f"""{bm25()}, {CONTEXT}, x AS (SELECT query_id AS case_id, text, context, 'It has ' || len(string_split(context, ' ')) || ' words.' AS answer FROM k)
        SELECT case_id, answer,
          len(string_split('Rate from 0 to 1 how far the context supports the answer.' || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Answer:' || chr(10) || answer || chr(10) || chr(10) || 'Score:', ' '))::DOUBLE AS faithfulness,
          len(string_split('Rate from 0 to 1 how well the answer responds to the question.' || chr(10) || 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Answer:' || chr(10) || answer || chr(10) || chr(10) || 'Score:', ' '))::DOUBLE AS relevance FROM x""",
    "upsert": f"""SELECT unit_id, source_doc_id, octet_length(data)::INT AS n_bytes FROM ({fixed(2048, 0)} SELECT * FROM i) a
        WHERE unit_id NOT IN (SELECT unit_id FROM ({fixed(1024, 0, "lang = 'fr'")} SELECT unit_id FROM i))
        UNION ALL SELECT unit_id, source_doc_id, octet_length(data)::INT FROM ({fixed(1024, 0, "lang = 'fr'")} SELECT * FROM i)""",
    "delete_docs": f"""{fixed(2048, 0, "source NOT IN ('src3', 'src5')")} SELECT unit_id, source_doc_id, octet_length(data)::INT AS n_bytes FROM i""",
    "unit_envelope": f"WITH {FACTS} SELECT 'graph_fact' AS unit_type, unit_id, subject AS said FROM t UNION ALL SELECT 'chunk', CAST(doc_id AS VARCHAR), sha256(text) FROM documents",
    "score_history": f"""{bm25()}, {NEAR}, b AS (
        SELECT query_id, unit_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT query_id, unit_id, rank FROM r UNION ALL SELECT query_id, unit_id, rank FROM v) GROUP BY ALL
    ), x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM b)
    SELECT x.query_id, x.unit_id, 0 AS "at", CASE WHEN r.unit_id IS NULL THEN 'vector' ELSE 'bm25' END AS stage, coalesce(r.score, v.score) AS score
    FROM x LEFT JOIN r ON r.query_id = x.query_id AND r.unit_id = x.unit_id LEFT JOIN v ON v.query_id = x.query_id AND v.unit_id = x.unit_id WHERE x.rank <= 10
    UNION ALL SELECT query_id, unit_id, 1, 'rrf_fusion', score FROM x WHERE rank <= 10""",
    "auth_grants": f"""{bm25()} SELECT r.query_id, r.rank::INT AS rank, r.unit_id, r.score FROM r JOIN u USING (unit_id)
        WHERE (CAST(substr(u.source, 4) AS INT) % 5 = CAST(r.query_id AS BIGINT) % 5 OR ({SUBJECT} = 'user0' AND u.lang = 'en')) AND NOT ({SUBJECT} = 'user0' AND u.source = 'src10')""",
    "auth_everything": f"{bm25()} {RANKED} r",
    "vector_codec": f"WITH {VECTORS} SELECT unit_id, len(e)::INT AS n, round(list_sum(e), 4) AS total FROM v",
    "metadata_codec": "SELECT CAST(doc_id AS VARCHAR) AS unit_id, doc_id AS first, CASE WHEN lang <> 'fr' THEN source END AS source, CASE WHEN lang <> 'fr' THEN doc_id END AS number FROM documents WHERE lang <> 'de'",
    "filter_translations": r"""SELECT * FROM (VALUES
        (0, $$metadata ->> 'lang' = 'f''r'$$, '{"must": [{"key": "lang", "match": {"value": "f''r"}}]}'),
        (1, $$metadata ->> 'n' = '4'$$, '{"must": [{"key": "n", "match": {"value": 4}}]}'),
        (2, $$metadata ->> 'on' = 'true'$$, '{"must": [{"key": "on", "match": {"value": true}}]}'),
        (3, $$metadata ->> 'lang' = ANY(ARRAY['en', 'fr']::text[])$$, '{"must": [{"key": "lang", "match": {"any": ["en", "fr"]}}]}'),
        (4, $$metadata -> 'tags' ?| ARRAY['a', 'b']::text[]$$, '{"must": [{"key": "tags", "match": {"any": ["a", "b"]}}]}'),
        (5, 'FALSE', 'null'),
        (6, 'FALSE', '{"must": [{"key": "lang", "match": {"value": ["en"]}}]}')) t(number, predicate, condition)""",
    "chunk_tables": """SELECT * FROM (VALUES
        ('pgvector', 'CREATE TABLE IF NOT EXISTS notes (unit_id TEXT PRIMARY KEY, source_doc_id TEXT NOT NULL, source_uri TEXT, text TEXT NOT NULL, metadata JSONB, vector vector(3))'),
        ('sqlite', 'CREATE TABLE IF NOT EXISTS notes (unit_id TEXT PRIMARY KEY, source_doc_id TEXT NOT NULL, source_uri TEXT, text TEXT NOT NULL, metadata TEXT, vector TEXT)'),
        ('spark', 'CREATE TABLE IF NOT EXISTS notes (unit_id STRING, source_doc_id STRING, source_uri STRING, text STRING, metadata VARIANT, vector ARRAY<FLOAT>) USING parquet')) t(dialect, statement)""",
    "web_search": """WITH q AS (SELECT CAST(n_nationkey AS VARCHAR) AS query_id, n_name || ' seen ' || n_name AS text FROM nation), w AS (SELECT query_id, text, unnest(string_split(text, ' ')[1:2]) AS w, unnest(range(0, 2)) AS k FROM q)
        SELECT query_id, (k + 1)::INT AS rank, 'web://' || w || '/' || k AS unit_id, 'web://' || w || '/' || k AS source_uri, text AS as_text, round(1 - 0.01 * k, 6)::DOUBLE AS score FROM w""",
    "pipeline_ingest": f"""WITH a AS ({fixed(1024, 0)} SELECT unit_id, source_doc_id, data, lang, source FROM i), b AS ({fixed(1024, 0, "lang = 'fr'", "'again ' || substring(text, 1, 700)")} SELECT unit_id, source_doc_id, data, lang, source FROM i)
        SELECT unit_id, source_doc_id, octet_length(data)::INT AS n_bytes, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS n_ingested
        FROM (SELECT * FROM a WHERE lang <> 'fr' UNION ALL SELECT * FROM b) WHERE NOT (source = 'src3' AND lang = 'en')""",
    "pipeline_tenants": stored_search("y.source = 'src' || (x.item_id % 3)", "lang <> 'de'"),
    "pipeline_subjects": stored_search("CAST(substr(y.source, 4) AS INT) % 5 = x.item_id % 5"),
    "stream_ingest": f"{fixed(2048, 0)} SELECT unit_id, source_doc_id, octet_length(data)::INT AS n_bytes FROM i",
    "database_store": f"""SELECT CAST(doc_id AS VARCHAR) AS unit_id, sha256(CASE WHEN lang = 'fr' THEN 'again ' || text ELSE text END) AS text_sha256, CASE WHEN lang <> 'fr' THEN lang END AS lang, list_sum({letters('text')})::BIGINT AS letters
        FROM documents WHERE source <> 'src3'""",
}
