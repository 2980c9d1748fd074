"""The registered queries of this package, and DuckDB SQL for those it can state.

Ids are taken as unique, as they are in the tables; tests have the other cases.
"""

from __future__ import annotations

from .op1_hilbert import op1_hilbert_shards
from .op2_boundary_bpe import op2_boundary_bpe
from .op3_suffix import op3_suffix_dedup
from .op4_pigeonhole import op4_pigeonhole
from .op5_urls import op5_url_filter
from .op6_topk import op6_block_topk
from .op7_packing import op7_packing
from .op8_windows import op8_windows
from .op9_jaccard import op9_jaccard
from .op10_toxicity import op10_toxicity

ALL = [op1_hilbert_shards, op2_boundary_bpe, op3_suffix_dedup, op4_pigeonhole, op5_url_filter, op6_block_topk, op7_packing, op8_windows, op9_jaccard, op10_toxicity]

#: Each byte whose last repeated start is at most 199 before it goes; what is left is joined as hexadecimal.
OP3 = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT doc_id, b, octet_length(b) AS n, unnest(range(1, octet_length(b) + 1)) AS pos FROM docs),
keys AS (SELECT doc_id, n, pos, CASE WHEN pos + 199 <= n THEN md5(b[pos:pos + 199]) END AS k FROM starts),
repeated AS (SELECT k FROM keys WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
gone AS (
    SELECT doc_id, pos,
           coalesce(max(CASE WHEN r.k IS NOT NULL THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
    FROM keys LEFT JOIN repeated r USING (k)),
edges AS (SELECT doc_id, pos, gone, gone IS DISTINCT FROM lag(gone) OVER (PARTITION BY doc_id ORDER BY pos) AS edge FROM gone),
runs AS (
    SELECT doc_id, gone, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - 1, octet_length(b)) AS last, b
    FROM edges JOIN docs USING (doc_id) WHERE edge)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes,
       coalesce(sum(r.last - r.pos + 1) FILTER (WHERE r.gone), 0)::BIGINT AS n_removed,
       (count(*) FILTER (WHERE r.gone))::BIGINT AS n_spans,
       sha256(unhex(coalesce(string_agg(hex(r.b[r.pos:r.last]), '' ORDER BY r.pos) FILTER (WHERE NOT r.gone), ''))) AS kept_sha256
FROM docs d LEFT JOIN runs r USING (doc_id) GROUP BY d.doc_id, d.b
"""

OP4 = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM component c
"""

OP6 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP8 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n, w FROM docs),
keys AS (SELECT doc_id, pos, word, CASE WHEN pos + 12 <= n THEN array_to_string(w[pos:pos + 12], ' ') END AS k FROM words),
least AS (SELECT k, min(doc_id) AS least FROM keys WHERE k IS NOT NULL GROUP BY k),
gone AS (
    SELECT doc_id, pos, word,
           coalesce(max(CASE WHEN l.least < doc_id THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
    FROM keys LEFT JOIN least l USING (k))
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (count(*) FILTER (WHERE g.gone))::BIGINT AS n_removed,
       sha256(coalesce(string_agg(g.word, ' ' ORDER BY g.pos) FILTER (WHERE NOT g.gone), '')) AS kept_sha256
FROM docs d LEFT JOIN gone g USING (doc_id) GROUP BY d.doc_id, d.w
"""

OP9 = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN sizes ON doc_id = a GROUP BY a
"""


def queries():
    return {f.__name__: f for f in ALL}


def oracle_sql():
    return {"op3_suffix_dedup": OP3, "op4_pigeonhole": OP4, "op6_block_topk": OP6, "op8_windows": OP8, "op9_jaccard": OP9}
