"""Quality rules from cross-document line frequency, DataFrame functions only.

Every line with a word is normalised (white space to one blank, trimmed, lower
case) and hashed together with its host. A line counts the distinct documents of its
host that hold it. Its limit is a share of the host's documents, so that verdicts
don't move as a corpus grows, but ``min_docs`` documents at least. Lines above it are
removed; a document that has lost more than ``max_lost`` of its words, or keeps fewer
than ``min_words``, is depleted and rejected. Base rules on words and repeated word
windows come first.

Defined results: a null text has no words and fails the base rules; null is a
host of its own; a document is an id, a row without id is one of its own; equal rows
are judged each on its own, one output row per input row; very long texts are taken
whole, in one row's memory; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut

SPACE = r"[\x20\x09-\x0D]+"


def repeat_words(words: str, windows: str, marked: str) -> Column:
    """Words inside a 3-word window that the text holds twice or more.

    ``windows`` holds each window's hash, ``marked`` (hash, position) in order of
    the hash: a window is repeated if a neighbour in that order has its hash.
    """
    order = F.col(marked)
    twice = F.filter(
        order,
        lambda x, i: (x["h"] == F.get(order, i - 1)["h"]) | (x["h"] == F.get(order, i + 1)["h"]),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.array().cast("array<int>")).otherwise(
        F.sort_array(F.transform(twice, lambda x: x["i"]))
    )


def document_facts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per input row: base counts and its distinct lines' (key, words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(host_col).cast("string").alias("_host"),
        text.alias("_text"),
    )
    df = df.select("*", F.filter(F.split("_text", SPACE), lambda w: w != "").alias("_words"))
    words = F.col("_words")
    df = df.select(
        "*",
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
        ).alias("_windows"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    df = df.select(
        "*",
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("_marked"),
    )
    df = df.select("*", repeat_words("_words", "_windows", "_marked").alias("_twice"))
    twice = F.col("_twice")
    covered = F.aggregate(
        F.transform(twice, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(twice, k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    host = F.col("_host")
    lines = F.transform(
        "_lines",
        lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE, " "))),
    )
    keyed = F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(host.isNull(), host, x).alias("key"),
            F.size(F.split(x, " ")).alias("n"),
        ),
    )
    return df.select(
        "_row",
        "_id",
        F.xxhash64(host.isNull(), host).alias("_host"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        keyed.alias("_keyed"),
    )


def line_rules(
    docs: DataFrame,
    *,
    max_share: float = 0.01,
    min_docs: int = 10,
    max_lost: float = 0.7,
    min_words: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Base counts, words lost to frequent lines, and the verdict, per row of ``docs``.

    The texts are read once; what goes on is a few numbers per document and line,
    cut to the shared folder. Counting is pre-aggregated twice (per line and document,
    then per line), so a line that a third of all documents share costs one row
    per map task; its join back to the documents is one that Spark may split.
    """
    facts = cut(document_facts(docs, id_col, text_col, host_col))
    own = F.when(F.col("_id").isNull(), F.col("_row")).alias("_own")  # a row without id is a document
    sizes = facts.select("_host", "_id", own).distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    lines = facts.select("_row", "_host", "_id", own, F.explode("_keyed").alias("_line")).select(
        "_row", "_host", "_id", "_own", F.col("_line.key").alias("_key"), F.col("_line.n").alias("_n")
    )
    frequent = (
        lines.select("_key", "_host", "_id", "_own")
        .distinct()
        .groupBy("_key", "_host")
        .agg(F.count("*").alias("_held"))
        .filter(F.col("_held") > min_docs)
        .join(sizes, "_host")
        .filter(F.col("_held") > F.lit(float(max_share)) * F.col("_docs"))
        .select("_key")
    )
    lost = lines.join(frequent, "_key", "left_semi").groupBy("_row").agg(F.sum("_n").alias("_lost"))
    n_lost = F.coalesce(F.col("_lost"), F.lit(0)).cast("long")
    left = F.col("n_words") - n_lost
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (n_lost > 0) & ((left < min_words) | (n_lost > max_lost * F.col("n_words")))
    return facts.drop("_keyed", "_host").join(lost, "_row", "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"),
        n_lost.alias("n_lost_words"),
    )


def line_rules_sql(max_share: float = 0.01, min_docs: int = 10, max_lost: float = 0.7, min_words: int = 20) -> str:
    """The same verdicts over the table ``documents``, in DuckDB's SQL."""
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM win WHERE n > 1) GROUP BY doc_id),
ln AS (
  SELECT doc_id, source, t, line, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm
  FROM (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source),
freq AS (
  SELECT ln.source, norm FROM ln JOIN host ON host.source IS NOT DISTINCT FROM ln.source GROUP BY ln.source, norm, docs
  HAVING count(DISTINCT doc_id) > greatest({min_docs}, {max_share}::DOUBLE * docs)),
lost AS (
  SELECT ln.doc_id, sum(len(string_split(ln.norm, ' '))) AS lost
  FROM ln JOIN freq ON ln.norm = freq.norm AND ln.source IS NOT DISTINCT FROM freq.source GROUP BY ln.doc_id),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
g AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (n_lost_words > 0 AND (n_words - n_lost_words < {min_words}
        OR n_lost_words > {max_lost} * n_words))) AS kept, n_lost_words
FROM g
"""
