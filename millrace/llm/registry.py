"""What ``__spark_entry__`` adds when this subpackage is there."""

from __future__ import annotations

from . import mixing, queries

QUERIES = {k: f for k, f in vars(queries).items() if k.startswith("op") and callable(f)}

ORACLES = {
    "op3_nearest_neighbours": """
        WITH e AS (
          SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
        ), p AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])) AS sq
          FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
        ), l AS ( -- summed in eight lanes, as the operator does for up to 128 dimensions, a multiple of eight
          SELECT query_id, vec_id, list_transform(range(1, 9), lambda k: list_reduce(sq[k : len(sq) : 8], lambda a, b: a + b)) AS s FROM p
        ), r AS (
          SELECT query_id, vec_id, sqrt(((s[1] + s[2]) + (s[3] + s[4])) + ((s[5] + s[6]) + (s[7] + s[8]))) AS score FROM l
        )
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM r
        WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY row_number() OVER w <= 10
    """,
    "op7_substring_dedup": r"""
        WITH d AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), starts AS (
          SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
        ), again AS (
          SELECT doc_id, i FROM starts QUALIFY count(*) OVER (PARTITION BY words) > 1
        ), w AS (
          SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d
        ), c AS (
          SELECT w.doc_id, w.i, word, max(a.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
          FROM w LEFT JOIN again a ON w.doc_id = a.doc_id AND w.i = a.i
        ), k AS (
          SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
        )
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
    "op5_mixing": mixing.ORACLE,
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)
    """,
}
