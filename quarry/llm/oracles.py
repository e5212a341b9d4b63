"""DuckDB SQL of the training-data queries that SQL can express, by brute force."""

from __future__ import annotations

from quarry.llm.line_rules import line_rules_sql

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Components of ``link`` (x, y) in both directions: the smallest id each node reaches.
_COMPONENTS = """
reached(x, m) AS (SELECT x, y FROM link UNION SELECT reached.x, link.y FROM reached JOIN link ON link.x = reached.m),
component AS (SELECT x, least(x, min(m)) AS component_id FROM reached GROUP BY x)"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 13) t(j)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) t ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

NGRAMS = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END, ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
pairs AS (SELECT x, y, c = p.n AND c = q.n AS same, 10 * c >= 8 * (p.n + q.n - c) AS linked FROM both_ JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y),
link AS (SELECT x, y FROM pairs WHERE linked), {_COMPONENTS}
SELECT d.doc_id, coalesce(least(d.doc_id, (SELECT min(y) FROM pairs WHERE x = d.doc_id AND same)), d.doc_id) AS class_id,
       coalesce((SELECT count(*) FROM link WHERE x = d.doc_id), 0)::BIGINT AS n_links, coalesce(component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN component ON component.x = d.doc_id"""

EMBEDDINGS = f"""
WITH RECURSIVE link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.93), {_COMPONENTS}
SELECT vec_id, coalesce((SELECT count(*) FROM link WHERE x = vec_id), 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept, 1.0::DOUBLE AS audit_recall
FROM embeddings LEFT JOIN component ON component.x = vec_id"""

ORACLE_SQL = {
    "op2_embedding_dedup": EMBEDDINGS,
    "op3_substring_dedup": SUBSTRING,
    "op5_ngram_join": NGRAMS,
    "op8_quality_rules": line_rules_sql(),
}
