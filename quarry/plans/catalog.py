"""Queries of the operators over the provided tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import seeds
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import code_graph as cg
from quarry.operators import definitions as df_
from quarry.operators import findings as fo
from quarry.operators import flow
from quarry.operators import graph as g
from quarry.operators import prefilter as pf
from quarry.operators import summaries as su
from quarry.operators import vectors as vo
from quarry.operators.chunking import split_lines
from quarry.plans import roles, samples
from quarry.plans.roles import SQL, table
from quarry.sources import files, stores
from quarry.streaming.streams import answered, pending, token_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = re.sub(r"(count_if\([^()]*\))", r"\1::BIGINT", sql)
        return f

    return add


def flat(c: str) -> F.Column:
    return F.array_join(c, ",")


# -- A: sources ----------------------------------------------------------------


@query(
    r"""SELECT page_id, CASE
  WHEN regexp_matches(lower(trim(url)), '^(git@|git://|ssh://)') THEN 'git'
  WHEN regexp_matches(lower(trim(url)), '^https?://') THEN
    CASE WHEN regexp_matches(lower(trim(url)), '\.git/?$')
           OR regexp_matches(lower(trim(url)), '^https?://(www\.)?(github\.com|gitlab\.com|bitbucket\.org|codeberg\.org)/')
         THEN 'git' ELSE 'url' END
  WHEN regexp_matches(lower(trim(url)), '^file://') AND regexp_matches(lower(trim(url)), '\.git/?$') THEN 'git'
  WHEN regexp_matches(lower(trim(url)), '\.zip$') THEN 'zip' END AS kind FROM pages"""
)
def a1_source_kind(spark, d):
    return table(spark, d, "pages").select("page_id", T.source_kind(F.col("url")).alias("kind"))


@query(
    r"""SELECT lower(regexp_extract(url, '(\.[^./?#]+)(?:[?#].*)?$', 1)) AS extension, count(*) AS n,
  CASE lower(regexp_extract(url, '(\.[^./?#]+)(?:[?#].*)?$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript'
    WHEN '.php' THEN 'php' WHEN '.go' THEN 'go' WHEN '.sh' THEN 'bash' END AS language
FROM pages GROUP BY 1, 3"""
)
def a8_language_by_extension(spark, d):
    pages = table(spark, d, "pages").select(F.col("url").alias("path"), F.lit("").alias("code"))
    found = files.with_language(pages, seeds.languages(spark))
    return found.groupBy(T.extension(F.col("path")).alias("extension"), "language").agg(F.count("*").alias("n"))


_LINES = {"en": "#!/usr/bin/env python3\n", "fr": "#!/bin/bash\n", "de": "#!/usr/bin/php8\n", "es": "#!/usr/bin/env -S node\n"}


@query(
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'bash' WHEN 'de' THEN 'php' WHEN 'es' THEN 'node' END AS interpreter
FROM documents"""
)
def a9_shebang(spark, d):
    lines = F.create_map(*(F.lit(x) for pair in _LINES.items() for x in pair))
    code = F.concat(lines[F.col("lang")], F.col("text"))
    return table(spark, d, "documents").select("doc_id", T.shebang(code).alias("interpreter"))


@query(
    """WITH f AS (SELECT doc_id, source, n_chars FROM documents WHERE n_chars <= 20000),
t AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS total FROM f)
SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS size FROM t WHERE total <= 60000 GROUP BY source"""
)
def a10_size_guards(spark, d):
    kept = files.within_limits(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id", "n_chars", 20_000, 60_000, ["source"])
    return kept.groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"))


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[\x00-\x08\x0b-\x1f\x7f]')")
def a11_control_characters(spark, d):
    return table(spark, d, "documents").filter(files.allowed_path(F.col("text"))).select("doc_id")


@query(
    """WITH k AS (SELECT DISTINCT source, CASE lang WHEN 'en' THEN 'web' WHEN 'fr' THEN 'mobile' WHEN 'de' THEN 'contract' ELSE 'binary' END AS app FROM documents)
SELECT source, CASE min(CASE app WHEN 'firmware' THEN 0 WHEN 'binary' THEN 1 WHEN 'web' THEN 2 WHEN 'mobile' THEN 3 ELSE 4 END)
  WHEN 0 THEN 'firmware' WHEN 1 THEN 'binary' WHEN 2 THEN 'web' WHEN 3 THEN 'mobile' ELSE 'contract' END AS app_type FROM k GROUP BY source"""
)
def a12_app_type(spark, d):
    kinds = {"en": "web", "fr": "mobile", "de": "contract"}
    app = F.coalesce(F.create_map(*(F.lit(x) for p in kinds.items() for x in p))[F.col("lang")], F.lit("binary"))
    return su.app_type(table(spark, d, "documents"), "source", app)


@query(
    """WITH l AS (SELECT source, substring(sha256(doc_id::VARCHAR), 1, 3) AS r, doc_id || ':' || sha256(text) AS line FROM documents),
g AS (SELECT source, r, count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM l GROUP BY source, r)
SELECT source, sum(n)::BIGINT AS files, sha256(string_agg(r || ':' || digest, chr(10) ORDER BY r)) AS digest FROM g GROUP BY source"""
)
def a15_corpus_digest(spark, d):
    docs = table(spark, d, "documents").withColumn("hash", F.sha2("text", 256)).withColumn("path", F.col("doc_id").cast("string"))
    return stores.corpus_digest(docs.select("path", "hash", "source"), "path", "hash", ["source"])


@query(
    """SELECT event_type AS target, arg_max(event_id, (ts, event_id)) AS run_id, max(ts) AS created_at FROM events GROUP BY event_type"""
)
def a16_latest_run(spark, d):
    runs = table(spark, d, "events").select(F.col("event_type").alias("target"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"))
    return stores.latest_run(runs)


@query(
    """SELECT DISTINCT split_part(p_name, ' ', -1) || '.' || p_brand AS pattern,
  CASE p_size % 3 WHEN 0 THEN 'command_injection' ELSE 'sql_injection' END AS sink_type
FROM part WHERE p_size % 3 <> 2 AND p_partkey % 5 <> 0 AND p_brand NOT IN ('Brand#11')"""
)
def a18_import_models(spark, d):
    kinds = spark.createDataFrame([(0, "command_injection"), (1, "sql_injection")], "kind int, sink_type string")
    rows = table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 5 != 0, "sinkModel").otherwise("sourceModel").alias("model"),
        F.replace("p_name", F.lit(" "), F.lit(".")).alias("receiver"),
        F.col("p_brand").alias("method"),
        (F.col("p_size") % 3).alias("kind"),
    )
    return stores.import_sink_rows(rows, kinds, ["Brand#11"])


@query(
    r"""SELECT DISTINCT 'Obj.m' || p_size AS pattern, 'xss' AS sink_type FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0"""
)
def a19_import_rules(spark, d):
    types = spark.createDataFrame([("79", "xss")], "cwe string, sink_type string")
    head = F.when(F.col("p_partkey") % 3 == 0, F.lit("$X.m")).otherwise(F.lit("Obj.m"))
    rules = table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, "taint").otherwise("search").alias("mode"),
        F.lit("CWE-79: cross-site scripting").alias("cwe"),
        F.concat(head, F.col("p_size").cast("string"), F.lit("($Y)")).alias("pattern"),
    )
    return stores.import_rules(rules, types)


@query("SELECT event_id AS id, event_type AS status FROM events WHERE event_type = 'purchase' AND date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)")
def a20_read_findings(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.date_trunc("day", "ts").alias("run_id"))
    return stores.findings_in(rows, status="purchase").select("id", "status")


# -- B: chunks -----------------------------------------------------------------


@query(
    r"""SELECT doc_id, (i - 1)::INTEGER AS ordinal, regexp_extract(seg, '^([A-Z]\w+)', 1) AS name, length(seg)::INTEGER AS size
FROM (SELECT doc_id, unnest(s[2:]) AS seg, unnest(range(1, len(s))) AS i
      FROM (SELECT doc_id, string_split(regexp_replace(text, '(^|\n)([A-Z]\w)', '\1' || chr(30) || '\2', 'g'), chr(30)) AS s FROM documents))"""
)
def b6_line_segments(spark, d):
    return split_lines(table(spark, d, "documents"), "doc_id", "text", r"([A-Z]\w+)").select("doc_id", "ordinal", "name", F.length("segment").alias("size"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def b7_chunk_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", su.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, source || '::' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS id FROM documents")
def b8_chunk_id(spark, d):
    from quarry.operators.chunking import chunk_ids

    return chunk_ids(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "id")


@query(
    """SELECT doc_id, substring(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], ''), 1, 200) AS signature FROM documents"""
)
def b9_signature(spark, d):
    return table(spark, d, "documents").select("doc_id", T.signature(F.col("text")).alias("signature"))


# -- C: predicates -------------------------------------------------------------

_WORDS = ["licensed", "ther and", "und der"]


@query("""SELECT DISTINCT lower(k) AS keyword FROM (VALUES ('system('), ('exec('), ('popen'), ('subprocess'), ('eval('), ('exec('), ('os.system')) v(k)""")
def c1_profile_keywords(spark, d):
    present = table(spark, d, "documents").select(F.when(F.col("lang") == "en", "python").alias("language")).distinct()
    return pf.profile_keywords(seeds.keywords(spark), seeds.languages(spark), ["command_injection"], present)


@query(
    """SELECT doc_id AS id FROM documents WHERE lang IN ('es') OR contains(lower(text), 'licensed') OR contains(lower(text), 'ther and') OR contains(lower(text), 'und der')"""
)
def c2_keyword_filter(spark, d):
    return pf.keyword_filter(roles.chunks(spark, d), _WORDS, ["es"]).select("id")


@query("SELECT doc_id AS id FROM documents WHERE contains(source, 'src1') OR contains(source, 'c7')")
def c3_path_filter(spark, d):
    return roles.chunks(spark, d).filter(pf.in_paths(F.col("file"), ["src1", "c7"])).select("id")


@query("SELECT p_partkey FROM part WHERE contains('.' || replace(p_name, ' ', '.') || '.', '.ring.') OR contains('.' || replace(p_name, ' ', '.') || '.', '.hot.gear.')")
def c4_segment_match(spark, d):
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    return table(spark, d, "part").filter(T.segment_match(name, F.lit("ring")) | T.segment_match(name, F.lit("hot.gear"))).select("p_partkey")


@query(
    r"""SELECT p_partkey, CASE WHEN regexp_matches(regexp_replace(s, '\($', ''), '^[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*$') THEN regexp_replace(s, '\($', '') END AS core
FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '.') || '(' WHEN 1 THEN p_name || '(' ELSE replace(p_name, ' ', '_') END AS s FROM part)"""
)
def c5_call_core(spark, d):
    dotted, under = F.replace("p_name", F.lit(" "), F.lit(".")), F.replace("p_name", F.lit(" "), F.lit("_"))
    s = F.when(F.col("p_size") % 3 == 0, F.concat(dotted, F.lit("("))).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit("("))).otherwise(under)
    return table(spark, d, "part").select("p_partkey", T.call_core(s).alias("core"))


@query(
    """WITH p AS (SELECT * FROM (VALUES ('en', 'of the('), ('en', 'the'), ('fr', 'la'), ('de', 'und die')) v(language, pattern)),
c AS (SELECT doc_id AS id, lang AS language, text AS code, list_distinct(string_split(text, ' ')) AS names, doc_id % 2 = 0 AS precise FROM documents)
SELECT DISTINCT id, pattern, 't' AS sink_type FROM c JOIN p USING (language)
WHERE CASE WHEN pattern IN ('the', 'la') THEN list_contains(names, pattern) OR len(list_filter(names, lambda n: contains('.' || n || '.', '.' || pattern || '.'))) > 0
             OR (NOT precise AND contains(code, pattern))
           ELSE contains(code, pattern) END"""
)
def c6_sink_match(spark, d):
    patterns = spark.createDataFrame([("en", "of the(", "t"), ("en", "the", "t"), ("fr", "la", "t"), ("de", "und die", "t")], "language string, pattern string, sink_type string")
    calls = roles.chunks(spark, d).select("id", "language", F.array_distinct(F.split("code", " ")).alias("names"), "code", (F.col("id") % 2 == 0).alias("precise"))
    return pf.match_sinks(calls, patterns)


@query(
    """SELECT p_partkey, starts_with(p_name, 'a') AS by_name, starts_with(p_brand, 'Brand#1') AS by_decorator, contains(p_type, 'STEEL') AS by_text FROM part"""
)
def c8_entry_test(spark, d):
    args = (F.col("p_name"), F.array("p_brand"), F.col("p_type"))
    return table(spark, d, "part").select(
        "p_partkey",
        pf.is_entry(*args, F.lit("def a")).alias("by_name"),
        pf.is_entry(*args, F.lit("@Brand#1")).alias("by_decorator"),
        pf.is_entry(*args, F.lit("STEEL")).alias("by_text"),
    )


@query(
    """SELECT DISTINCT source AS file, lang AS name FROM documents
WHERE (lang = 'en' AND (contains(text, 'stthe') OR contains(text, 'erof'))) OR (lang = 'fr' AND contains(text, 'lela'))"""
)
def c9_entry_points(spark, d):
    patterns = spark.createDataFrame([("en", "stthe"), ("en", "erof"), ("fr", "lela")], "language string, pattern string")
    named = roles.chunks(spark, d).withColumn("name", F.col("language"))
    return pf.entry_points(named, patterns).select("file", "name")


@query(
    """WITH m AS (SELECT * FROM (VALUES ('one', 'en', 'ther the'), ('one', 'en', 'licensed'), ('two', 'de', 'und die'), ('two', 'fr', 'de la'), ('none', 'es', '@@@')) v(id, language, marker))
SELECT m.id, count(DISTINCT source) AS files FROM documents JOIN m ON lang = language AND contains(text, marker) GROUP BY m.id"""
)
def c10_frameworks(spark, d):
    frames = spark.createDataFrame(
        [("one", "en", [], ["ther the", "licensed"]), ("two", "de", [], ["und die"]), ("two", "fr", [], ["de la"]), ("none", "es", [], ["@@@"])],
        "id string, language string, also array<string>, markers array<string>",
    )
    return pf.detect_frameworks(roles.chunks(spark, d), frames)


@query(
    """SELECT l.language, string_agg(DISTINCT s, ',' ORDER BY s) AS sinks FROM
(VALUES ('python', 'render_template_string'), ('java', 'JdbcTemplate.query'), ('kotlin', 'JdbcTemplate.query')) l(language, s) GROUP BY 1"""
)
def c11_overlays(spark, d):
    frames = seeds.frameworks(spark)
    found = frames.filter(F.col("id").isin("flask", "spring")).select("id")
    return pf.overlays(frames, found).select("language", flat("sinks").alias("sinks"))


@query(
    """SELECT source, string_agg(DISTINCT p, ',' ORDER BY p) AS patterns FROM (
  SELECT source, lang AS p FROM documents UNION ALL SELECT DISTINCT source, 'eval' FROM documents) GROUP BY source"""
)
def c13_overlay_merge(spark, d):
    own = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("own"))
    return own.select("source", flat(pf.merge_patterns(F.col("own"), F.array(F.lit("eval")))).alias("patterns"))


@query("SELECT event_id FROM events WHERE event_type IN ('purchase', 'signup')")
def c14_status_filter(spark, d):
    return su.with_status(table(spark, d, "events"), "event_type", ["purchase", "signup"]).select("event_id")


@query(
    """SELECT c_custkey, array_to_string(list_sort(list_filter([
  CASE WHEN c_custkey % 7 = 0 THEN 'no object' END, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 5 = 0 THEN 'missing name' END,
  CASE WHEN c_custkey % 7 > 0 AND c_custkey % 3 = 0 THEN 'unknown extra' END, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 2 = 0 THEN 'extensions is no array' END,
  CASE WHEN c_custkey % 7 > 0 AND c_custkey % 11 = 0 THEN 'id is no string' END, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 13 = 0 THEN 'app_types is too long' END],
  lambda x: x IS NOT NULL)), ',') AS errors FROM customer"""
)
def c15_validation(spark, d):
    key = F.col("c_custkey")
    some = lambda n, yes, no="": F.when(key % n == 0, yes).otherwise(no)
    text = F.concat(
        F.lit("{"), some(11, '"id": 5, ', '"id": "x", '), some(5, "", '"name": "n", '), some(3, '"extra": 1, '),
        some(13, '"app_types": ["' + "y" * 501 + '"], '), some(2, '"extensions": ".x"}', '"extensions": [".x", ".y"]}'),
    )
    rows = table(spark, d, "customer").select("c_custkey", F.when(key % 7 == 0, "[1]").otherwise(text).alias("json"))
    return df_.schema_errors(rows).select("c_custkey", flat("errors").alias("errors"))


# -- D: implied joins -------------------------------------------------------------


@query(
    """WITH s AS (SELECT p_partkey AS id, p_brand AS file, split_part(p_name, ' ', 1) AS name FROM part),
own AS (SELECT file, name, min(id) AS own FROM s GROUP BY 1, 2 HAVING count(DISTINCT id) = 1),
every AS (SELECT name, min(id) AS one FROM s GROUP BY 1 HAVING count(DISTINCT id) = 1),
c AS (SELECT p_partkey AS src, p_brand AS file, split_part(p_name, ' ', 2) AS name FROM part)
SELECT src, coalesce(own, one, -1) AS dst FROM c LEFT JOIN own USING (file, name) LEFT JOIN every USING (name)"""
)
def d2_resolve_calls(spark, d):
    part = table(spark, d, "part")
    word = lambda k: F.coalesce(F.get(F.split("p_name", " "), k), F.lit(""))
    symbols = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), word(0).alias("name"))
    calls = part.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("file"), word(1).alias("name"))
    return g.resolve_calls(calls, symbols).select("src", F.coalesce("dst", F.lit(-1)).cast("long").alias("dst"))


_CALLS_SQL = r"""SELECT DISTINCT s.id AS src, n.dst, 'calls' AS type FROM
(SELECT page_id AS id, unnest(list_distinct(regexp_extract_all(html, '\b([A-Za-z_]\w*)\s*\(', 1))) AS name FROM pages) s
JOIN (SELECT name, min(id) AS dst FROM (SELECT page_id AS id, unnest(['track', 'margin', 'f' || page_id]) AS name FROM pages) GROUP BY name) n ON s.name = n.name WHERE s.id <> n.dst"""


@query(_CALLS_SQL)
def d3_call_sites(spark, d):
    pages = table(spark, d, "pages")
    named = pages.select(F.col("page_id").alias("id"), F.col("html").alias("code"), F.explode(F.array(F.lit("track"), F.lit("margin"), F.concat(F.lit("f"), F.col("page_id").cast("string")))).alias("name"))
    sites = named.filter("name = 'track'").withColumn("name", F.lit("track"))
    names = named.select("id", F.lit("").alias("code"), "name")
    return g.call_graph(sites.unionByName(names.filter("name <> 'track'")).withColumn("ord", F.col("id")))


QUERIES["e11_call_graph"], ORACLE["e11_call_graph"] = d3_call_sites, _CALLS_SQL


@query(
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'subprocess' ELSE o_orderpriority END || '.run' AS resolved FROM orders"""
)
def d4_alias_expansion(spark, d):
    calls = table(spark, d, "orders").select("o_orderkey", F.lit("f").alias("file"), F.concat("o_orderpriority", F.lit(".run")).alias("name"))
    names = spark.createDataFrame([("f", "1-URGENT", "subprocess")], "file string, alias string, target string")
    return g.expand_aliases(calls, names).select("o_orderkey", "resolved")


@query(
    """WITH f AS (SELECT DISTINCT replace(p_name, ' ', '/') || '/m' || p_size % 4 AS file FROM part),
s AS (SELECT file, unnest([split_part(file, '/', -1), split_part(file, '/', -2) || '.' || split_part(file, '/', -1), replace(file, '/', '.')]) AS suffix,
      len(string_split(file, '/')) AS n FROM f)
SELECT suffix, CASE WHEN count(DISTINCT file) = 1 THEN min(file) ELSE '' END AS file FROM (SELECT DISTINCT file, suffix FROM s) GROUP BY suffix"""
)
def d5_module_suffixes(spark, d):
    part = table(spark, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/m"), (F.col("p_size") % 4).cast("string")).alias("file"))
    return g.module_suffixes(part)


@query(
    """WITH n AS (SELECT l_orderkey AS file, min(l_linenumber) AS line_start, max(l_linenumber) AS line_end, l_partkey AS id, l_returnflag AS name FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag),
f AS (SELECT o_orderkey AS finding, o_orderkey AS file, 2 AS line, CASE WHEN o_orderkey % 2 = 0 THEN 'R' END AS fn FROM orders)
SELECT finding, id AS node FROM (SELECT finding, id, row_number() OVER (PARTITION BY finding ORDER BY coalesce(fn = name, false) DESC, line_end - line_start, id, name) AS r
FROM f JOIN n USING (file) WHERE coalesce(fn = name, false) OR line BETWEEN line_start AND line_end) WHERE r = 1"""
)
def d6_locate(spark, d):
    nodes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("name")).agg(
        F.min("l_linenumber").alias("line_start"), F.max("l_linenumber").alias("line_end")
    )
    found = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("finding"), F.col("o_orderkey").alias("file"), F.lit(2).alias("line"), F.when(F.col("o_orderkey") % 2 == 0, "R").alias("function")
    )
    return fo.locate(found, nodes)


@query(
    """WITH c AS (SELECT turn AS ord, conv_id AS batch, conv_id * 1000 + turn AS id, role AS file, turn * 10 AS line_start, turn * 10 + 9 AS line_end FROM conversations),
f AS (SELECT DISTINCT conv_id AS finding, conv_id AS batch, CASE WHEN conv_id % 3 = 0 THEN 'nobody' ELSE 'assistant' END AS file, 15 AS line FROM conversations)
SELECT finding, id AS chunk, tier FROM (SELECT finding, id, tier, row_number() OVER (PARTITION BY finding ORDER BY tier, ord) AS r FROM (
  SELECT finding, id, ord, CASE WHEN f.file = c.file AND line BETWEEN line_start AND line_end THEN 0 WHEN f.file = c.file THEN 1 ELSE 2 END AS tier FROM f JOIN c USING (batch))) WHERE r = 1"""
)
def d8_attribution(spark, d):
    conv = table(spark, d, "conversations")
    chunks = conv.select(
        F.col("turn").alias("ord"), F.col("conv_id").alias("batch"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("file"),
        (F.col("turn") * 10).alias("line_start"), (F.col("turn") * 10 + 9).alias("line_end"),
    )
    found = conv.select(F.col("conv_id").alias("finding"), F.col("conv_id").alias("batch"), F.when(F.col("conv_id") % 3 == 0, "nobody").otherwise("assistant").alias("file"), F.lit(15).alias("line")).distinct()
    return fo.attribute(found, chunks)


@query(
    """SELECT (sha256(text) IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))) AS hit, count(*) AS n FROM documents GROUP BY 1"""
)
def d9_cache_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    hits, misses = stores.split_cache(docs, docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), "key")
    return hits.agg(F.lit(True).alias("hit"), F.count("*").alias("n")).union(misses.agg(F.lit(False).alias("hit"), F.count("*").alias("n"))).filter("n > 0")


@query(
    """WITH f AS (SELECT doc_id AS id, source AS file, n_chars AS line, lang AS type FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
v AS (SELECT doc_id AS id, source AS file, n_chars AS line, lang AS type FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT * FROM f UNION ALL SELECT v.* FROM v WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.file = v.file AND f.line = v.line AND f.type = v.type)"""
)
def d10_variant_merge(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("n_chars").alias("line"), F.col("lang").alias("type"))
    known = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return fo.merge_variants(rows.join(known, "id", "left_semi"), rows.join(known, "id", "left_anti")).select("id", "file", "line", "type")


# -- E: graph construction -------------------------------------------------------


@query(
    f"""WITH {SQL},
c AS (SELECT l_partkey AS src, l_suppkey AS dst, l_linestatus AS v, l_quantity > 25 AS data, l_discount > 0.05 AS back, l_tax > 0.04 AS guard, l_discount > 0.07 AS clean FROM lineitem)
SELECT type, count(*) AS n, count_if(sanitized) AS clean, min(condition) AS first_condition FROM (
  SELECT src, dst, 'calls' AS type, '' AS condition, false AS sanitized FROM c UNION ALL
  SELECT src, dst, 'data_flow', '', clean FROM c WHERE data UNION ALL
  SELECT dst, src, 'data_flow', '', false FROM c WHERE back UNION ALL
  SELECT src, dst, 'control_flow', 'if a & while b', false FROM c WHERE guard) WHERE src <> dst GROUP BY type"""
)
def e8_emit_edges(spark, d):
    none = F.array().cast("array<string>")
    calls = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("src"),
        F.col("l_suppkey").alias("dst"),
        F.when(F.col("l_quantity") > 25, F.array("l_linestatus")).otherwise(none).alias("data_vars"),
        F.when(F.col("l_discount") > 0.05, F.lit("r")).alias("returns_to"),
        F.when(F.col("l_tax") > 0.04, F.array(F.lit("if  a"), F.lit("while b"))).otherwise(none).alias("guards"),
        (F.col("l_discount") > 0.07).alias("sanitized"),
    )
    return g.emit_edges(calls).groupBy("type").agg(F.count("*").alias("n"), F.count_if("sanitized").alias("clean"), F.min("condition").alias("first_condition"))


@query(
    f"""WITH {SQL} SELECT src, dst, type, string_agg(DISTINCT var, ',' ORDER BY var) AS data_vars, string_agg(DISTINCT condition, ' | ' ORDER BY condition) AS condition,
bool_and(sanitized) AS sanitized FROM raw_edges GROUP BY src, dst, type"""
)
def e9_merge_edges(spark, d):
    return g.merge_edges(roles.raw_edges(spark, d)).withColumn("data_vars", flat("data_vars"))


@query(
    f"""WITH {SQL} SELECT src, dst, type, condition FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY condition, var, sanitized) AS r FROM raw_edges) WHERE r = 1"""
)
def e10_first_edges(spark, d):
    edges = roles.raw_edges(spark, d)
    return g.first_edges(edges, ["condition", F.get("data_vars", 0), "sanitized"]).select("src", "dst", "type", "condition")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'method' WHEN p_size % 4 = 1 THEN 'module' ELSE 'function' END AS type FROM part""")
def e13_node_type(spark, d):
    kind = F.when(F.col("p_size") % 4 == 0, "method").when(F.col("p_size") % 4 == 2, "strange")
    name = F.when(F.col("p_size") % 4 == 1, "<module>").otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", g.node_type(kind, name).alias("type"))


@query(r"""SELECT doc_id, substring(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), 1, 160) AS condition FROM documents""")
def e14_condition(spark, d):
    return table(spark, d, "documents").select("doc_id", g.squash_condition(F.col("text")).alias("condition"))


# -- sources of our own: what syntax trees and heads give ---------------------------


def values(columns: str, rows: str) -> str:
    """SQL of a table of stated rows, one per line."""
    return f"SELECT * FROM (VALUES {', '.join(f'({r.strip()})' for r in rows.strip().splitlines())}) t({columns})"


@query(
    values(
        "id, name, qualname, kind, line_start, line_end",
        """
    'app/shop.py::0', '<module>', '<module>', 'module', 1, 5
    'app/shop.py::1', 'order', 'order', 'function', 8, 14
    'app/shop.py::2', 'describe', 'describe', 'function', 17, 19
    'app/shop.py::3', 'run', 'run', 'function', 22, 23
    'app/shop.py::4', 'run_safe', 'run_safe', 'function', 26, 27
    'app/shop.py::5', 'Basket', 'Basket', 'class', 30, 43
    'app/shop.py::6', 'total', 'Basket.total', 'method', 33, 37
    'app/shop.py::7', 'put', 'Basket.put', 'method', 39, 40
    'app/shop.py::8', 'flush', 'Basket.flush', 'method', 42, 43
    'app/tool.py::0', 'run', 'run', 'function', 1, 2
    'app/tool.py::1', 'main', 'main', 'function', 5, 7
    'old/broken.py::0', 'half', NULL, NULL, 1, 2
    'old/broken.py::1', 'other', NULL, NULL, 4, 5
    'src/ping.c::0', 'ping', NULL, NULL, 3, 6
    'src/ping.c::1', 'main', NULL, NULL, 8, 13""",
    )
)
def b1_chunks(spark, d):
    return samples.chunks(spark).select("id", "name", "qualname", "kind", "line_start", "line_end")


@query(values("file, class, fields", "'app/shop.py', 'Basket', 'self.kept'"))
def e2_class_fields(spark, d):
    found = flow.class_fields(samples.chunks(spark).filter("language = 'python'"))
    return found.select("file", "class", F.array_join("fields", ",").alias("fields"))


@query(
    values(
        "src, resolved, data_vars, guards, returns_to, sanitized",
        """
    'app/shop.py::1', 'describe', 'item', '', 'note', false
    'app/shop.py::1', 'quote', 'item', '', NULL, false
    'app/shop.py::1', 'run', 'note', 'if mode == ''admin''', NULL, false
    'app/shop.py::1', 'run_safe', 'item', '', NULL, true
    'app/shop.py::3', 'subprocess.run', 'cmd', '', NULL, false
    'app/shop.py::6', 'inner', '', '', NULL, false
    'app/shop.py::8', 'os.system', 'self.kept', '', NULL, false
    'app/tool.py::1', 'missing', 'argv', '', NULL, false
    'app/tool.py::1', 'run', 'argv', '', NULL, false""",
    )
)
def e5_call_records(spark, d):
    chunks = samples.chunks(spark).filter("language = 'python'")
    calls = g.expand_aliases(flow.calls(chunks, fields=flow.class_fields(chunks)), flow.aliases(samples.sources(spark).filter("language = 'python'")))
    return calls.select("src", "resolved", flat("data_vars").alias("data_vars"), flat("guards").alias("guards"), "returns_to", "sanitized")


@query(
    values(
        "id, decorators",
        """
    'app/shop.py::0', ''
    'app/shop.py::1', 'app.route,logged'
    'app/shop.py::2', ''
    'app/shop.py::3', ''
    'app/shop.py::4', ''
    'app/shop.py::5', ''
    'app/shop.py::6', 'property'
    'app/shop.py::7', ''
    'app/shop.py::8', ''
    'app/tool.py::0', ''
    'app/tool.py::1', ''""",
    )
)
def e12_decorators(spark, d):
    return cg.decorators(samples.chunks(spark)).select("id", flat("decorators").alias("decorators"))


def _sample_graph(spark) -> dict[str, DataFrame]:
    models = spark.createDataFrame([("subprocess.run", "command_injection"), ("os.popen", "command_injection")], "pattern string, sink_type string")
    return cg.build_graph(samples.sources(spark), samples.chunks(spark), samples.patterns(spark), models)


@query(
    values(
        "place, id, type, signature, is_entry_point, is_sink, tags",
        """
    1, 'app/shop.py::1', 'function', '@app.route("/order")', true, false, 'user_input'
    2, 'app/shop.py::2', 'function', 'def describe(item):', false, false, ''
    3, 'app/shop.py::3', 'function', 'def run(cmd):', false, true, ''
    4, 'app/shop.py::4', 'function', 'def run_safe(cmd):', false, false, ''
    5, 'app/shop.py::5', 'class', 'class Basket(Base):', false, false, ''
    6, 'app/shop.py::6', 'method', '@property', false, false, ''
    7, 'app/shop.py::7', 'method', 'def put(self, thing):', false, false, ''
    8, 'app/shop.py::8', 'method', 'def flush(self):', false, true, ''
    9, 'app/tool.py::0', 'function', 'def run(cmd):', false, false, ''
    10, 'app/tool.py::1', 'function', 'def main(argv):', true, false, 'user_input'
    11, 'old/broken.py::0', 'function', 'def half(:', false, true, ''
    12, 'old/broken.py::1', 'function', 'def other(y)', false, false, ''
    13, 'src/ping.c::0', 'function', 'static void ping(const char *host) {', false, true, ''
    14, 'src/ping.c::1', 'function', 'int main(int argc, char **argv) {', true, false, 'user_input'
    15, 'app/shop.py::0', 'module', '\"\"\"A shop.\"\"\"', false, false, ''""",
    )
)
def e1_graph_nodes(spark, d):
    place = F.row_number().over(Window.orderBy("ord"))  # a handful of rows
    return _sample_graph(spark)["nodes"].select(place.alias("place"), "id", "type", "signature", "is_entry_point", "is_sink", flat("tags").alias("tags"))


@query(
    values(
        "id, pattern, sink_type",
        """
    'app/shop.py::3', 'subprocess', 'unknown'
    'app/shop.py::3', 'subprocess.run', 'command_injection'
    'app/shop.py::8', 'os.system', 'unknown'
    'old/broken.py::0', 'eval(', 'unknown'
    'src/ping.c::0', 'system(', 'command_injection'""",
    )
)
def e1_graph_sinks(spark, d):
    return _sample_graph(spark)["sinks"]


@query(
    values(
        "src, dst, type, data_vars, condition, sanitized",
        """
    'app/shop.py::1', 'app/shop.py::2', 'calls', '', '', false
    'app/shop.py::1', 'app/shop.py::2', 'data_flow', 'item', '', false
    'app/shop.py::1', 'app/shop.py::3', 'calls', '', '', false
    'app/shop.py::1', 'app/shop.py::3', 'control_flow', '', 'if mode == ''admin''', false
    'app/shop.py::1', 'app/shop.py::3', 'data_flow', 'note', '', false
    'app/shop.py::1', 'app/shop.py::4', 'calls', '', '', false
    'app/shop.py::1', 'app/shop.py::4', 'data_flow', 'item', '', true
    'app/shop.py::2', 'app/shop.py::1', 'data_flow', 'note', '', false
    'app/tool.py::1', 'app/tool.py::0', 'calls', '', '', false
    'app/tool.py::1', 'app/tool.py::0', 'data_flow', 'argv', '', false
    'old/broken.py::1', 'old/broken.py::0', 'calls', '', '', false
    'src/ping.c::1', 'app/tool.py::1', 'calls', '', '', false
    'src/ping.c::1', 'src/ping.c::0', 'calls', '', '', false""",
    )
)
def e1_graph_edges(spark, d):
    return _sample_graph(spark)["edges"].select("src", "dst", "type", flat("data_vars").alias("data_vars"), "condition", "sanitized")


# -- F: graph queries --------------------------------------------------------------

_REACH = f"""WITH RECURSIVE {SQL},
r(id, hop) AS (SELECT id, 0 FROM nodes WHERE is_sink UNION SELECT e.src, r.hop + 1 FROM r JOIN edges e ON e.dst = r.id AND e.type = 'calls' WHERE r.hop < 2)
SELECT id, min(hop)::INTEGER AS hop FROM r GROUP BY id"""


@query(_REACH)
def f1_nodes_reaching_sink(spark, d):
    return g.reach(roles.raw_edges(spark, d), roles.nodes(spark, d).filter("is_sink"), 2)


@query(
    f"""WITH RECURSIVE {SQL},
r(id, hop) AS (SELECT id, 0 FROM nodes WHERE is_sink UNION SELECT e.src, r.hop + 1 FROM r JOIN edges e ON e.dst = r.id AND e.type = 'calls' WHERE r.hop < 2)
SELECT id, name FROM nodes WHERE id IN (SELECT id FROM r) AND NOT contains(name, 'a')"""
)
def f2_graph_rescue(spark, d):
    nodes = roles.nodes(spark, d)
    reached = g.reach(roles.raw_edges(spark, d), nodes.filter("is_sink"), 2)
    return pf.rescue_reached(nodes, nodes.filter(F.contains("name", F.lit("a"))), reached).select("id", "name")


def _search_sql(name: str, kind: str) -> str:
    """A table of the shortest path to every node reached from the entry points, the smallest among equals."""
    return f"""{name}(id, path) USING KEY (id) AS (SELECT id, [id] FROM nodes WHERE is_entry_point
  UNION SELECT e.dst, min(list_append(r.path, e.dst)) FROM {name} r JOIN edges e ON e.src = r.id AND e.type = '{kind}'
  LEFT JOIN recurring.{name} known ON known.id = e.dst WHERE known.id IS NULL GROUP BY e.dst)"""


def _path_sql(kind: str, alone: bool) -> str:
    return f"""WITH RECURSIVE {SQL},
{_search_sql("reached", kind)}
SELECT id, array_to_string(path, '>') AS path FROM reached {'' if alone else 'WHERE len(path) > 1'}"""


def _paths(spark, d, kind, alone):
    found = g.shortest_paths(roles.raw_edges(spark, d), roles.nodes(spark, d).filter("is_entry_point"), (kind,), None, alone=alone)
    return found.select("id", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(_path_sql("calls", True))
def f3_call_paths(spark, d):
    return _paths(spark, d, g.CALLS, True)


@query(_path_sql("data_flow", False))
def f4_data_paths(spark, d):
    return _paths(spark, d, g.DATA, False)


@query(f"WITH {SQL} SELECT src AS id, count(*) AS n, min(dst) AS first FROM edges WHERE type = 'calls' GROUP BY src")
def f5_adjacency(spark, d):
    return su.adjacency(roles.raw_edges(spark, d), g.CALLS)


@query(
    f"""WITH RECURSIVE {SQL}, b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges),
r(id, hop) AS (SELECT id, 0 FROM nodes WHERE is_sink UNION SELECT b.y, r.hop + 1 FROM r JOIN b ON b.x = r.id WHERE r.hop < 2)
SELECT id, min(hop)::INTEGER AS hop FROM r GROUP BY id"""
)
def f6_neighbourhood(spark, d):
    return g.neighbourhood(roles.raw_edges(spark, d), roles.nodes(spark, d).filter("is_sink"), 2)


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'red')")
def f7_match_nodes(spark, d):
    return g.match_nodes(roles.nodes(spark, d), "RED").select("id")


@query(
    f"""WITH {SQL}, ids AS (SELECT src AS id FROM edges WHERE type IN ('data_flow', 'control_flow') UNION SELECT dst FROM edges WHERE type IN ('data_flow', 'control_flow'))
SELECT DISTINCT src, dst, type FROM edges WHERE type IN ('calls', 'data_flow') AND src IN (SELECT i.id FROM ids i JOIN nodes USING (id)) AND dst IN (SELECT i.id FROM ids i JOIN nodes USING (id))"""
)
def f8_select_view(spark, d):
    _, edges = g.select_view(roles.nodes(spark, d), roles.raw_edges(spark, d), kinds=(g.CALLS, g.DATA), only_flows=True)
    return edges.select("src", "dst", "type").distinct()


@query(
    f"""WITH RECURSIVE {SQL}, {_search_sql("by_data", "data_flow")}, {_search_sql("by_calls", "calls")},
both_ AS (SELECT 'data_flow' AS kind, id, path FROM by_data UNION ALL SELECT 'calls', id, path FROM by_calls),
one AS (SELECT path, max(kind) AS kind, min(id) AS sink FROM both_ WHERE id IN (SELECT id FROM nodes WHERE is_sink) GROUP BY path),
pairs AS (SELECT path, i, path[i] AS src, path[i + 1] AS dst FROM (SELECT path, unnest(range(1, len(path))) AS i FROM one)),
labels AS (
  SELECT src, dst, string_agg(DISTINCT var, ', ' ORDER BY var) || CASE WHEN bool_and(sanitized) THEN ' (sanitized)' ELSE ' (unsanitized)' END AS label
  FROM raw_edges WHERE type = 'data_flow' GROUP BY src, dst
  UNION ALL SELECT src, dst, 'only ' || string_agg(DISTINCT condition, ' | ' ORDER BY condition) FROM raw_edges WHERE type = 'control_flow' GROUP BY src, dst),
each AS (SELECT path, i, coalesce(string_agg(DISTINCT label, ' · ' ORDER BY label), '') AS hop FROM pairs LEFT JOIN labels USING (src, dst) GROUP BY path, i),
joined AS (SELECT path, string_agg(hop, ' / ' ORDER BY i) AS hops, bool_or(contains(hop, 'unsanitized')) OR bool_and(hop = '') AS tainted FROM each GROUP BY path)
SELECT kind, sink, array_to_string(one.path, '>') AS path, coalesce(hops, '') AS hops, coalesce(tainted, true) AS tainted
FROM one LEFT JOIN joined USING (path) ORDER BY coalesce(tainted, true) DESC, kind DESC, len(one.path), one.path LIMIT 40"""
)
def f9_flow_paths(spark, d):
    edges = g.merge_edges(roles.raw_edges(spark, d))
    names = lambda c: F.array_join(F.col(c).cast("array<string>"), ">")
    found = g.flow_paths(roles.nodes(spark, d), edges)
    return found.select("kind", "sink", names("path").alias("path"), F.array_join("hops", " / ").alias("hops"), "tainted")


@query(
    f"""WITH {SQL}, m AS (SELECT src, dst, type, string_agg(DISTINCT var, ',' ORDER BY var) AS vars, bool_and(sanitized) AS sanitized FROM raw_edges GROUP BY 1, 2, 3),
g AS (SELECT src, dst, list_sort(list(DISTINCT condition))[1:5] AS guards FROM (SELECT src, dst, string_agg(DISTINCT condition, ' | ' ORDER BY condition) AS condition FROM raw_edges WHERE type = 'control_flow' GROUP BY 1, 2) GROUP BY 1, 2),
p AS (SELECT DISTINCT src, dst FROM edges)
SELECT p.src, p.dst, coalesce(a.vars, '') AS tainted_vars, coalesce(NOT a.sanitized, false) AS unsanitized, coalesce(array_to_string(g.guards, ';'), '') AS guards
FROM p LEFT JOIN m a ON a.src = p.src AND a.dst = p.dst AND a.type = 'data_flow' LEFT JOIN g ON g.src = p.src AND g.dst = p.dst"""
)
def f12_evidence(spark, d):
    edges = g.merge_edges(roles.raw_edges(spark, d))
    paths = edges.select("src", "dst").distinct().select(F.concat_ws(">", "src", "dst").alias("key"), F.array("src", "dst").alias("path"))
    found = g.evidence(paths, edges)
    return found.select(
        F.get("path", 0).alias("src"), F.get("path", 1).alias("dst"), flat("tainted_vars").alias("tainted_vars"), "unsanitized", F.array_join("guards", ";").alias("guards")
    )


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'llm' WHEN p_size % 2 = 0 THEN 'graph+llm' ELSE 'graph' END AS origin FROM part"""
)
def f13_origin(spark, d):
    path = F.when(F.col("p_size") % 3 != 0, F.array("p_partkey"))
    return table(spark, d, "part").select("p_partkey", g.origin(path, F.when(F.col("p_size") % 2 == 0, F.lit("confirmed"))).alias("origin"))


@query(
    f"""WITH {SQL},
d AS (SELECT src, dst, string_agg(DISTINCT var, ', ' ORDER BY var) || '#' || CASE WHEN bool_and(sanitized) THEN ' (sanitized)' ELSE ' (unsanitized)' END AS note FROM raw_edges WHERE type = 'data_flow' GROUP BY 1, 2),
c AS (SELECT src, dst, left(string_agg(DISTINCT condition, ' | ' ORDER BY condition), 80) AS condition FROM raw_edges WHERE type = 'control_flow' GROUP BY 1, 2),
n AS (
  SELECT dst AS id, 0 AS way, f.name AS other, replace(note, '#', ' from ' || f.name) AS note FROM d JOIN nodes f ON f.id = src JOIN nodes t ON t.id = dst
  UNION ALL SELECT src, 1, t.name, replace(note, '#', ' to ' || t.name) FROM d JOIN nodes f ON f.id = src JOIN nodes t ON t.id = dst
  UNION ALL SELECT src, 2, t.name, 'calls ' || t.name || ' only if ' || trim(condition) FROM c JOIN nodes f ON f.id = src JOIN nodes t ON t.id = dst),
r AS (SELECT *, row_number() OVER (PARTITION BY id, way > 0 ORDER BY way, other, note) AS k FROM n)
SELECT id, coalesce(string_agg(note, '; ' ORDER BY k) FILTER (WHERE way = 0), '') AS incoming, coalesce(string_agg(note, '; ' ORDER BY k) FILTER (WHERE way > 0), '') AS outgoing
FROM r WHERE k <= 4 GROUP BY id"""
)
def f14_flow_notes(spark, d):
    notes = cg.flow_notes(roles.nodes(spark, d), g.merge_edges(roles.raw_edges(spark, d)))
    return notes.select("id", F.array_join("incoming", "; ").alias("incoming"), F.array_join("outgoing", "; ").alias("outgoing"))


@query(
    f"""WITH {SQL} SELECT 'nodes' AS metric, count(*) AS n FROM nodes UNION ALL SELECT 'entry_points', count_if(is_entry_point) FROM nodes UNION ALL
SELECT 'sinks', count_if(is_sink) FROM nodes UNION ALL SELECT 'edges:' || type, count(*) FROM edges GROUP BY type"""
)
def f17_graph_stats(spark, d):
    return g.stats(roles.nodes(spark, d), roles.raw_edges(spark, d).select("src", "dst", "type").distinct())


# -- G: vectors ---------------------------------------------------------------------


@query(
    r"""WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[A-Za-z_]\w*|[^\s\w]')) AS tok FROM benchmark),
h AS (SELECT item_id, sha256(tok) AS h FROM t),
s AS (SELECT item_id, ('0x' || substring(h, 1, 8))::BIGINT % 256 AS slot, sum(CASE WHEN ('0x' || substring(h, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2)
SELECT item_id, slot::INTEGER AS slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY item_id)), 6) AS value FROM s WHERE v <> 0"""
)
def g1_hash_embedding(spark, d):
    rows = table(spark, d, "benchmark")
    return (
        V.hash_embed(rows, "item_id", "text")
        .select("item_id", F.posexplode("embedding").alias("slot", "v"))
        .filter("v <> 0")
        .select("item_id", "slot", F.round("v", 6).alias("value"))
    )


@query(
    """WITH f AS (SELECT label, min(vec_id) AS head FROM embeddings GROUP BY label)
SELECT b.vec_id AS id, f.head, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
FROM embeddings b JOIN f USING (label) JOIN embeddings a ON a.vec_id = f.head"""
)
def g5_cosine(spark, d):
    vec = table(spark, d, "embeddings")
    heads = vec.groupBy("label").agg(F.min("vec_id").alias("head"), F.min_by("embedding", "vec_id").alias("va"))
    return vec.join(heads, "label").select(F.col("vec_id").alias("id"), "head", F.round(V.cosine(F.col("va"), F.col("embedding")), 6).alias("sim"))


_SCORE = """s AS (SELECT b.vec_id AS id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS score
FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id GROUP BY 1)"""


@query(
    f"""WITH {_SCORE} SELECT id, round(score, 6) AS score FROM s WHERE score >= 0.22 ORDER BY score DESC, id
LIMIT (SELECT greatest(25, floor(count(*) * 0.1)::BIGINT) FROM embeddings WHERE label = 0)"""
)
def g6_semantic_rescue(spark, d):
    rows = table(spark, d, "embeddings")
    vec = rows.select(F.col("vec_id").alias("id"), "embedding")
    budget = pf.rescue_budget(rows.filter("label = 0").count())  # what earlier layers kept
    got = vo.rescue_similar(vec, vec.filter("id % 20 = 0"), 0.22, budget)
    return got.select("id", F.round("score", 6).alias("score"))


@query(
    """SELECT vec_id AS id, round(s, 6) AS score FROM (SELECT b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + CASE WHEN b.label = 3 THEN 1.0 ELSE 0.0 END AS s
FROM embeddings a, embeddings b WHERE a.vec_id = 0) ORDER BY s DESC, vec_id LIMIT 40"""
)
def g7_scope(spark, d):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    query = [float(x) for x in vec.filter("id = 0").first()["embedding"]]
    score = V.cosine(F.col("embedding"), F.array(*map(F.lit, query)))
    return pf.scope(vec, score, F.col("label") == 3, 40).select("id", F.round("score", 6).alias("score"))


@query(
    """SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR source = 'src3'"""
)
def g8_exact_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return vo.exact_dedup(docs, "hash", "doc_id", F.col("source") == "src3").select("doc_id")


# besides the rows themselves, every third once more at another length and every fifth with a small change; such a row
# is near to its original and the original's other offspring alone, so the loop's answer is that no earlier row is near
@query(
    """WITH v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
  UNION ALL SELECT 1000000000 + vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 2) FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT 2000000000 + vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i % 16 = 1 THEN 0.02 ELSE 0 END) FROM embeddings WHERE vec_id % 5 = 0)
SELECT id FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.id < a.id AND list_cosine_similarity(a.e, b.e) > 0.95)"""
)
def g9_near_dedup(spark, d):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    scaled = vec.filter("id % 3 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.transform("embedding", lambda x: x * 2).alias("embedding"))
    moved = vec.filter("id % 5 = 0").select(
        (F.col("id") + 2_000_000_000).alias("id"), F.transform("embedding", lambda x, i: x + F.when(i % 16 == 0, 0.02).otherwise(0.0)).alias("embedding")
    )
    return vo.near_dedup(vec.union(scaled).union(moved), 0.95).select("id")


@query(
    """WITH c AS (SELECT a.vec_id AS seed, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, id) AS r FROM c WHERE sim >= 0.3),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, seed) AS q FROM k WHERE r <= 10)
SELECT id, seed, round(sim, 6) AS sim FROM b WHERE q = 1"""
)
def g10_neighbours(spark, d):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    got = vo.neighbours(vec.filter("id % 20 = 0"), vec, 0.3, 10, among_seeds=True)
    return got.select("id", "seed", F.round("sim", 6).alias("sim"))


@query(
    """SELECT vec_id AS id, (vec_id % 2 = 0) AS cached, CASE WHEN vec_id % 2 = 0 THEN round(embedding[1]::DOUBLE, 6) END AS first FROM embeddings"""
)
def g11_vector_cache(spark, d):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.sha2(F.col("vec_id").cast("string"), 256).alias("hash"), "embedding")
    cache = vec.select(F.col("hash").alias("key"), F.when(F.col("id") % 2 == 0, "m1").otherwise("m2").alias("model"), F.col("embedding").cast("array<double>").alias("embedding"))
    held, missing = vo.cached_vectors(vec.select("id", "hash"), cache, "m1")
    return held.select("id", F.lit(True).alias("cached"), F.get("embedding", 0).alias("first")).union(missing.select("id", F.lit(False), F.lit(None).cast("double")))


# -- H: aggregates, windows, sets -----------------------------------------------------


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def h1_by_status(spark, d):
    return su.counts(table(spark, d, "events").withColumnRenamed("event_type", "status"), "status")


@query("SELECT count_if(quality = 1 AND toxic = 0) AS confirmed, count_if(toxic = 1) AS conditional, count_if(quality = 0) AS false_positive FROM labels")
def h2_totals(spark, d):
    quality, toxic = F.col("quality"), F.col("toxic")
    tests = {"confirmed": (quality == 1) & (toxic == 0), "conditional": toxic == 1, "false_positive": quality == 0}
    return su.totals(table(spark, d, "labels"), tests)


@query(
    """SELECT d.source, count(*) AS scoped, count(l.doc_id) AS analysed, count_if(l.quality = 0) AS flagged FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source"""
)
def h3_coverage(spark, d):
    return su.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "source", F.col("quality") == 0)


@query(
    """WITH r AS (SELECT lang AS category, quality = 0 AS actual, (length(text) - length(replace(text, '|', '')) + length(text) - length(replace(text, '%', ''))) > 5 AS predicted FROM documents JOIN labels USING (doc_id)),
c AS (SELECT category, count_if(actual AND predicted) AS tp, count_if(NOT actual AND predicted) AS fp, count_if(actual AND NOT predicted) AS fn, count_if(NOT actual AND NOT predicted) AS tn FROM r GROUP BY category)
SELECT category, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision, round(fp / nullif(fp + tn, 0), 6) AS fpr,
round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fn, 0) - fp / nullif(fp + tn, 0), 6) AS youden FROM c"""
)
def h4_evaluation(spark, d):
    signs = F.regexp_count("text", F.lit(r"[|%]"))
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("category"), (F.col("quality") == 0).alias("actual"), (signs > 5).alias("predicted"))
    got = fo.evaluation(rows, "category", "actual", "predicted")
    return got.select("category", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "fpr", "f1", "youden")))


@query(
    """(SELECT doc_id, toxic FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 20) UNION ALL (SELECT doc_id, toxic FROM labels WHERE toxic = 0 ORDER BY doc_id LIMIT (SELECT 40 - least(20, count(*)) FROM labels WHERE toxic = 1))"""
)
def h5_balanced_sample(spark, d):
    return fo.balanced(table(spark, d, "labels").select("doc_id", "toxic"), F.col("toxic") == 1, "doc_id", 40)


@query("SELECT role AS model, count(*) AS calls, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY role")
def h6_usage(spark, d):
    return su.usage(table(spark, d, "conversations"), "role", "text")


@query("SELECT event_type, round(avg(value), 6) AS latency FROM events GROUP BY event_type")
def h7_latency(spark, d):
    return su.latency(table(spark, d, "events"), "event_type", "value")


@query("SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents GROUP BY source")
def h8_language_sets(spark, d):
    return su.value_sets(table(spark, d, "documents"), "source", "lang", "languages").withColumn("languages", flat("languages"))


@query(
    """SELECT substring(string_agg(text, chr(10) ORDER BY length(text) DESC, doc_id), 1, 8000) AS sample FROM (SELECT * FROM documents ORDER BY length(text) DESC, doc_id LIMIT 15)"""
)
def h9_longest_sample(spark, d):
    return su.longest_sample(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 400")
def h10_inventory(spark, d):
    return su.first_rows(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 400)


@query("SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10)::BIGINT AS batch FROM documents")
def h11_batches(spark, d):
    return pf.batches(table(spark, d, "documents").select("doc_id", "source"), 10, "doc_id", ["source"])


@query("SELECT doc_id, printf('F%03d', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS number FROM documents")
def h12_numbering(spark, d):
    return stores.number(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], ["source"]).select("doc_id", "number")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def h13_newest_runs(spark, d):
    return su.first_rows(table(spark, d, "events").select("event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 20)


@query(
    """SELECT doc_id AS id, CASE WHEN contains(lower(text), 'licensed') THEN 'keyword' WHEN contains(source, 'src1') THEN 'path' ELSE 'label' END AS layer FROM documents
WHERE contains(lower(text), 'licensed') OR contains(source, 'src1') OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def h14_layer_union(spark, d):
    c = roles.chunks(spark, d)
    toxic = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")).distinct()
    layers = [
        ("keyword", pf.keyword_filter(c, ["licensed"], [])),
        ("path", c.filter(pf.in_paths(F.col("file"), ["src1"]))),
        ("label", c.join(toxic, "id", "left_semi")),
    ]
    return pf.union_layers(c.select("id"), layers).select("id", "layer")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def h15_dropped(spark, d):
    return su.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT label AS tier, count(*) AS n, min(vec_id) AS first_task FROM embeddings GROUP BY label")
def h16_tasks_by_tier(spark, d):
    return su.tasks_by_tier(table(spark, d, "embeddings"), "label", "vec_id")


# -- I, K: scalar functions -----------------------------------------------------------


@query(
    r"""SELECT doc_id, CASE WHEN length(text) > 48 THEN substring(text, 1, 47) || '…' ELSE text END AS label,
replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS html,
greatest(0.0, least(1.0, (n_chars - 100) / 1000.0))::DOUBLE AS clamped FROM documents"""
)
def i1_escaping(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.label(F.col("text")).alias("label"), T.html(F.col("text")).alias("html"), T.clamp((F.col("n_chars") - 100) / F.lit(1000.0), 0.0, 1.0).alias("clamped")
    )


@query(r"""SELECT doc_id, regexp_replace(text, '([\\`*_{}\[\]()#+|<>-])', '\\\1', 'g') AS md FROM documents""")
def i2_markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", T.markdown(F.col("text")).alias("md"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)((?:password|passwd|pwd)\s*[:=]\s*)(["'']?[^\s"'',;]{4,}["'']?)', '\1[REDACTED]', 'g'),
'(?i)((?:api[_-]?key|secret|token)\s*[:=]\s*)(["'']?[A-Za-z0-9_\-./+]{8,}["'']?)', '\1[REDACTED]', 'g'), '()(\bAKIA[0-9A-Z]{16}\b)', '\1[REDACTED]', 'g'), '()(-----BEGIN [A-Z ]*PRIVATE KEY-----)', '\1[REDACTED]', 'g') AS redacted
FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' password = "hunter' || doc_id || '"' ELSE '' END AS t FROM documents)"""
)
def k1_redaction(spark, d):
    hidden = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(' password = "hunter'), F.col("doc_id").cast("string"), F.lit('"'))).otherwise("")
    return table(spark, d, "documents").select("doc_id", T.redact(F.concat("text", hidden)).alias("redacted"))


# -- J: caches, budgets, control --------------------------------------------------------


@query("SELECT doc_id, sha256(sha256(text) || '|' || lang || '|' || 'a,b,' || '|' || 'v3') AS key FROM documents")
def j1_cache_key(spark, d):
    key = stores.cache_key(F.sha2("text", 256), F.col("lang"), F.array(F.lit("b"), F.lit("a")), F.lit(3))
    return table(spark, d, "documents").select("doc_id", key.alias("key"))


def _hunt_sql(rounds: int = 5, total: int = 50) -> str:
    """The rounds of a variant hunt written out, each with its frontier and what was seen before."""
    parts = [
        """s AS MATERIALIZED (SELECT a.vec_id AS seed, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)""",
        "f0 AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 20 = 0), seen0 AS (SELECT id FROM f0), got0 AS (SELECT 0 AS id, 0 AS variant_of, '' AS status, 0 AS round LIMIT 0)",
    ]
    for r in range(1, rounds + 1):
        p = r - 1
        parts.append(
            f"""k{r} AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY sim DESC, id) AS k FROM s WHERE sim >= 0.3 AND seed IN (SELECT id FROM f{p}) AND id NOT IN (SELECT id FROM f{p})),
b{r} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, seed) AS q FROM k{r} WHERE k <= 10),
j{r} AS MATERIALIZED (SELECT id, seed AS variant_of, CASE WHEN label % 2 = 0 THEN 'confirmed' ELSE 'false_positive' END AS status, {r} AS round
  FROM (SELECT * FROM b{r} WHERE q = 1 AND id NOT IN (SELECT id FROM seen{p}) ORDER BY sim DESC, id LIMIT (SELECT {total} - count(*) FROM got{p})) JOIN embeddings ON vec_id = id),
f{r} AS (SELECT id FROM j{r} WHERE status = 'confirmed'), seen{r} AS (SELECT id FROM seen{p} UNION ALL SELECT id FROM j{r}), got{r} AS (SELECT * FROM got{p} UNION ALL SELECT * FROM j{r})"""
        )
    return "WITH " + ",\n".join(parts) + f" SELECT * FROM got{rounds}"


@query(_hunt_sql())
def j3_variant_hunt(spark, d):
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")

    def near(frontier: DataFrame, seen: DataFrame) -> DataFrame:
        return vo.neighbours(vec.join(frontier, "id", "left_semi"), vec, 0.3, 10)

    def judge(fresh: DataFrame) -> DataFrame:
        return fresh.join(vec.select("id", "label"), "id").withColumn("status", F.when(F.col("label") % 2 == 0, "confirmed").otherwise("false_positive"))

    found, _ = fo.hunt_variants(vec.filter("id % 20 = 0").select("id"), near, judge)
    return found


@query(
    """SELECT event_id, coalesce(sum(user_id % 50) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500 AS runs FROM events"""
)
def j5_token_budget(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", (F.col("user_id") % 50).alias("tokens"))
    return fo.within_budget(rows, "tokens", 500, ["ts", "event_id"], ["event_type"]).select("event_id", "runs")


@query(
    """SELECT event_id, w::BIGINT AS window_tokens, (w <= 60 OR w = t) AS passes FROM (
SELECT event_id, user_id % 50 AS t, sum(user_id % 50) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS w FROM events)"""
)
def j6_pacing(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", (F.col("user_id") % 50).alias("tokens"))
    return fo.pacing(rows, "tokens", "ts", "event_type", 60).select("event_id", "window_tokens", "passes")


@query(
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'high' WHEN event_type IN ('signup', 'view') THEN 'mid' ELSE 'low' END AS tier FROM events"""
)
def j8_tier_policy(spark, d):
    policy = spark.createDataFrame([("purchase", "high"), ("signup", "mid"), ("view", "mid")], "event_type string, tier string")
    return table(spark, d, "events").join(F.broadcast(policy), "event_type", "left").select("event_id", F.coalesce("tier", F.lit("low")).alias("tier"))


_INDEX = """new AS (SELECT source || '/' || doc_id AS path, sha256(text) AS hash FROM documents WHERE lang <> 'de'),
old AS (SELECT source || '/' || doc_id AS path, CASE WHEN toxic = 1 THEN 'x' ELSE sha256(text) END AS hash FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'src1' || CASE WHEN item_id % 2 = 0 THEN '/' ELSE '0/' END || 'gone' || item_id, sha256(text) FROM benchmark)"""


def _merged(incremental: bool) -> str:
    kept = "WHEN new.path IS NULL AND old.path <> 'src1' AND NOT starts_with(old.path, 'src1/') THEN 'kept'" if incremental else ""
    reused = "WHEN new.hash = old.hash THEN 'reused'" if incremental else ""
    return f"""SELECT {incremental} AS incremental, coalesce(new.path, old.path) AS path, coalesce(new.hash, old.hash) AS hash,
  CASE {kept} WHEN new.path IS NULL THEN 'dropped' WHEN old.path IS NULL THEN 'added' {reused} ELSE 'changed' END AS state
FROM new FULL JOIN old ON new.path = old.path"""


@query(f"WITH {_INDEX} {_merged(True)} UNION ALL {_merged(False)}")
def j12_incremental(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    path, digest = F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.sha2("text", 256)
    new = docs.filter("lang <> 'de'").select(path.alias("path"), digest.alias("hash"))
    seen = docs.join(labels.select("doc_id", "toxic"), "doc_id").select(path.alias("path"), F.when(F.col("toxic") == 1, "x").otherwise(digest).alias("hash"))
    place = F.concat(F.lit("src1"), F.when(F.col("item_id") % 2 == 0, "/").otherwise("0/"), F.lit("gone"), F.col("item_id").cast("string"))
    old = seen.union(table(spark, d, "benchmark").select(place, digest))
    one = lambda way: stores.merge_index(new, old, "src1", way).select(F.lit(way).alias("incremental"), "path", "hash", "state")
    return one(True).union(one(False))


# -- L: confirmation and reports ----------------------------------------------------------

@query(
    f"""WITH RECURSIVE {SQL}, {_search_sql("by_data", "data_flow")}, {_search_sql("by_calls", "calls")},
f AS (SELECT s.id AS finding, min(n.id) AS node FROM nodes s JOIN nodes n USING (name, file) WHERE s.is_sink GROUP BY s.id),
p AS (SELECT finding, node, CASE WHEN len(d.path) > 1 THEN d.path ELSE c.path END AS path,
        CASE WHEN len(d.path) > 1 THEN 'data_flow' WHEN c.path IS NOT NULL THEN 'calls' ELSE 'none' END AS path_kind
      FROM f LEFT JOIN by_data d ON d.id = node LEFT JOIN by_calls c ON c.id = node),
h AS (SELECT finding, path[i] AS src, path[i + 1] AS dst FROM (SELECT finding, path, unnest(range(1, len(path))) AS i FROM p)),
v AS (SELECT finding, string_agg(DISTINCT var, ',' ORDER BY var) AS vars FROM h JOIN raw_edges e USING (src, dst) WHERE type = 'data_flow' GROUP BY finding),
u AS (SELECT finding, bool_or(NOT clean) AS unsanitized FROM (SELECT finding, src, dst, bool_and(sanitized) AS clean FROM h JOIN raw_edges USING (src, dst) WHERE type = 'data_flow' GROUP BY ALL) GROUP BY finding),
c AS (SELECT finding, list_sort(list(DISTINCT condition))[1:5] AS guards FROM (SELECT finding, src, dst, string_agg(DISTINCT condition, ' | ' ORDER BY condition) AS condition
      FROM h JOIN raw_edges USING (src, dst) WHERE type = 'control_flow' GROUP BY ALL) GROUP BY finding),
j AS (SELECT p.*, coalesce(vars, '') AS tainted_vars, coalesce(unsanitized, false) AS unsanitized, coalesce(array_to_string(guards, ';'), '') AS guards
      FROM p LEFT JOIN v USING (finding) LEFT JOIN u USING (finding) LEFT JOIN c USING (finding))
SELECT finding, node, coalesce(array_to_string(path, '>'), '') AS path, path_kind, tainted_vars, unsanitized, guards,
  CASE WHEN path_kind = 'data_flow' THEN CASE WHEN NOT unsanitized THEN 'false_positive' WHEN guards <> '' THEN 'conditional' ELSE 'confirmed' END ELSE 'needs_review' END AS status,
  CASE WHEN path IS NULL THEN 'llm' ELSE 'graph+llm' END AS origin FROM j"""
)
def l2_confirm(spark, d):
    nodes = roles.nodes(spark, d).withColumn("line_start", F.lit(1)).withColumn("line_end", F.lit(1))
    found = nodes.filter("is_sink").select(F.col("id").alias("finding"), "file", F.col("name").alias("function"), F.lit(0).alias("line"))
    done = fo.confirm(found, nodes, g.merge_edges(roles.raw_edges(spark, d)))
    return done.select(
        "finding", "node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "path_kind",
        flat("tainted_vars").alias("tainted_vars"), "unsanitized", F.array_join("guards", ";").alias("guards"), "status", "origin",
    )


@query(
    """SELECT doc_id AS id, coalesce(try_cast(CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR ELSE 'x' END AS INTEGER), 0) AS line,
coalesce(greatest(0.0, least(1.0, try_cast(CASE WHEN doc_id % 3 = 0 THEN '1.5' WHEN doc_id % 3 = 1 THEN '0.25' ELSE 'high' END AS DOUBLE))), 0.0)::DOUBLE AS confidence,
CASE WHEN doc_id % 4 = 0 THEN 'head' ELSE source END AS file, substring(text, 1, 500) AS snippet FROM documents"""
)
def l1_coercion(spark, d):
    i = F.col("doc_id")
    raw = table(spark, d, "documents").select(
        i.alias("id"),
        F.when(i % 2 == 0, F.col("n_chars").cast("string")).otherwise("x").alias("line"),
        F.when(i % 3 == 0, "1.5").when(i % 3 == 1, "0.25").otherwise("high").alias("confidence"),
        F.when(i % 4 == 0, " ").otherwise(F.col("source")).alias("file"),
        F.col("text").alias("snippet"),
    )
    return fo.coerce(raw, F.lit("head"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'confirmed' WHEN doc_id % 4 = 1 THEN 'false_positive' ELSE 'needs_review' END AS status FROM documents""")
def l3_verdicts(spark, d):
    i = F.col("doc_id") % 4
    verdict = F.when(i == 0, " Confirmed").when(i == 1, "false_positive").when(i == 2, "maybe")
    return table(spark, d, "documents").select("doc_id", fo.verdict_status(F.coalesce(verdict, F.lit(""))).alias("status"))


@query(
    """SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'confirmed' WHEN toxic = 0 THEN 'false_positive' ELSE 'needs_review' END AS status,
CASE WHEN toxic IS NULL THEN 'not evaluated' ELSE '' END AS review_reason FROM documents d LEFT JOIN labels USING (doc_id)"""
)
def l4_failures(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    verdicts = table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "confirmed").otherwise("false_positive").alias("verdict"), F.lit(None).cast("string").alias("failure")
    )
    return fo.merge_verdicts(rows, verdicts)


@query(
    """WITH c AS (SELECT p_brand AS run_id, p_partkey AS ord, replace(lower(p_type), ' ', '_') AS type,
  ['critical', 'high', 'medium', 'low', 'info'][p_size % 5 + 1] AS severity, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS summary,
  CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE 'src/' || p_brand END AS uri, CASE WHEN p_size % 2 = 0 THEN greatest(p_size - 20, 1) ELSE 1 END AS line,
  p_size / 10.0 AS score FROM part)
SELECT run_id, 'result' AS part, ord, '{"ruleId":"' || type || '","level":"' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END
  || '","message":{"text":"' || CASE WHEN summary = '' THEN type ELSE summary END || '"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || uri
  || '"},"region":{"startLine":' || line || '}}}],"properties":{"security-severity":"' || printf('%.1f', score::DOUBLE) || '","cvss-vector":"AV:N","finding-id":"F' || ord || '"}}' AS json FROM c
UNION ALL SELECT run_id, 'rule', min(ord), '{"id":"' || type || '","name":"' || type || '","shortDescription":{"text":"'
  || array_to_string(list_transform(string_split(type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || '"}}' FROM c GROUP BY run_id, type"""
)
def l8_sarif(spark, d):
    size = F.col("p_size")
    causes = table(spark, d, "part").select(
        F.col("p_brand").alias("run_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("F"), F.col("p_partkey").cast("string")).alias("finding_id"),
        F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")).alias("type"), F.get(F.array(*map(F.lit, seeds.SEVERITIES)), size % 5).alias("severity"),
        F.when(size % 4 == 0, "").otherwise(F.col("p_name")).alias("summary"), F.lit("").alias("root_cause"),
        F.when(size % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src/"), "p_brand"))).alias("affected_files"),
        F.when(size % 2 == 0, F.array(F.lit("nowhere"), F.concat(F.lit(":"), F.greatest(size - 20, F.lit(0)).cast("string")))).otherwise(F.array(F.lit("a:x"))).alias("affected_lines"),
        F.lit("AV:N").alias("cvss_vector"), (size / 10).alias("cvss_score"),
    )
    named = lambda df, part: df.select("run_id", F.lit(part).alias("part"), "ord", "json")
    return named(fo.sarif_results(causes), "result").union(named(fo.sarif_rules(causes), "rule"))


@query(r"SELECT doc_id, coalesce(regexp_matches(text, '[#*]{3,}') OR regexp_matches(text, '(?i)\bpassword\b'), false) AS unsafe FROM documents")
def l9_unsafe_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.matches_any(F.col("text"), [r"[#*]{3,}", r"(?i)\bpassword\b"]).alias("unsafe"))


@query(
    """SELECT date_trunc('minute', ts) AS window_start, event_type AS model, sum(user_id % 50)::BIGINT AS tokens, count(*) AS calls FROM events GROUP BY 1, 2"""
)
def m1_token_windows(spark, d):
    rows = table(spark, d, "events").select("ts", "event_type", (F.col("user_id") % 50).alias("tokens"))
    return token_windows(rows, "ts", "event_type", "tokens")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def m2_pending(spark, d):
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return pending(asked, table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")))


@query(
    """WITH q AS (SELECT user_id AS id, min(ts) AS asked FROM events GROUP BY user_id), s AS (SELECT user_id AS id, ts AS answered, event_type AS body FROM events WHERE event_type = 'purchase')
SELECT q.id, q.asked, s.answered, s.body FROM q LEFT JOIN s ON q.id = s.id AND s.answered BETWEEN q.asked AND q.asked + INTERVAL 86400 SECONDS"""
)
def m3_answered(spark, d):
    events = table(spark, d, "events")
    asked = events.groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("asked"))
    got = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.col("ts").alias("answered"), F.col("event_type").alias("body"))
    return answered(asked, got, "86400 seconds")


# -- further operators -----------------------------------------------------------------------


@query(
    """SELECT p_partkey, 'hot.gear' AS pattern, 'first' AS sink_type FROM part WHERE contains('.' || replace(p_name, ' ', '.') || '.', '.hot.gear.')"""
)
def c7_qualified_models(spark, d):
    models = spark.createDataFrame([("hot.gear", "first"), ("ring", "second")], "pattern string, sink_type string")
    calls = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"))
    return pf.match_qualified(calls, models).select("p_partkey", "pattern", "sink_type")


@query(
    """SELECT * FROM (VALUES ('python', 'request.GET,request.POST,request.args,request.form', 'escape('), ('javascript', 'req.body,req.query', 'validator.escape')) v(language, sources, sanitizers)"""
)
def c12_taint_patterns(spark, d):
    frames = seeds.frameworks(spark)
    found = frames.filter(F.col("id").isin("flask", "django", "express")).select("id")
    return pf.overlays(frames, found).select("language", flat("sources").alias("sources"), flat("sanitizers").alias("sanitizers"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'paranoid' WHEN c_mktsegment = 'BUILDING' THEN 'audit' ELSE 'fast' END AS mode,
CASE WHEN c_mktsegment = 'BUILDING' THEN '3' ELSE '2' END AS hops FROM customer"""
)
def c16_config_layers(spark, d):
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    base = F.create_map(F.lit("mode"), F.lit("fast"), F.lit("hops"), F.lit("2"))
    group = F.when(F.col("c_mktsegment") == "BUILDING", F.create_map(F.lit("mode"), F.lit("audit"), F.lit("hops"), F.lit("3"))).otherwise(empty)
    own = F.when(F.col("c_custkey") % 5 == 0, F.create_map(F.lit("mode"), F.lit("paranoid"))).otherwise(empty)
    config = pf.layered(base, group, own)
    return table(spark, d, "customer").select("c_custkey", config["mode"].alias("mode"), config["hops"].alias("hops"))


@query("""SELECT doc_id AS id, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'go' END AS language, CASE lang WHEN 'en' THEN 4 WHEN 'fr' THEN 2 ELSE 0 END AS sinks FROM documents""")
def d1_language_join(spark, d):
    named = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "python").when(F.col("lang") == "fr", "go").alias("language"))
    return su.sink_counts(named, seeds.languages(spark)).select("id", "language", "sinks")


@query(
    """WITH c AS (SELECT conv_id, turn AS ord, turn * 10 AS line_start, turn * 10 + 14 AS line_end FROM conversations)
SELECT finding, node FROM (SELECT f.conv_id AS finding, c.ord AS node, row_number() OVER (PARTITION BY f.conv_id ORDER BY line_end - line_start, c.ord) AS r
FROM (SELECT DISTINCT conv_id FROM conversations) f JOIN c ON c.conv_id = f.conv_id AND 12 BETWEEN line_start AND line_end) WHERE r = 1"""
)
def d7_finding_chunk(spark, d):
    conv = table(spark, d, "conversations")
    nodes = conv.select(F.col("conv_id").alias("file"), F.col("turn").alias("id"), F.lit("x").alias("name"), (F.col("turn") * 10).alias("line_start"), (F.col("turn") * 10 + 14).alias("line_end"))
    found = conv.select(F.col("conv_id").alias("finding"), F.col("conv_id").alias("file"), F.lit(12).alias("line"), F.lit(None).cast("string").alias("function")).distinct()
    return fo.locate(found, nodes)


@query(
    f"""WITH {SQL}, p AS (SELECT DISTINCT src, dst FROM edges), m AS (
  SELECT src, dst, string_agg(DISTINCT var, ', ' ORDER BY var) || ' (' || CASE WHEN bool_and(sanitized) THEN 'sanitized' ELSE 'unsanitized' END || ')' AS t FROM raw_edges WHERE type = 'data_flow' GROUP BY 1, 2
  UNION ALL SELECT src, dst, 'only ' || string_agg(DISTINCT condition, ' | ' ORDER BY condition) FROM raw_edges WHERE type = 'control_flow' GROUP BY 1, 2)
SELECT p.src || '>' || p.dst AS key, coalesce(string_agg(t, ' · ' ORDER BY t), '') AS label FROM p LEFT JOIN m ON m.src = p.src AND m.dst = p.dst GROUP BY 1"""
)
def d12_hop_labels(spark, d):
    edges = g.merge_edges(roles.raw_edges(spark, d))
    paths = edges.select("src", "dst").distinct().select(F.concat_ws(">", "src", "dst").alias("key"), F.array("src", "dst").alias("path"))
    return g.hop_labels(paths, edges).select("key", F.get("hops", 0).alias("label"))


@query(
    """SELECT conv_id, string_agg(turn || ':' || substring(role || ' — ' || text, 1, 300), chr(10) ORDER BY turn) AS steps FROM conversations GROUP BY conv_id"""
)
def f15_taint_steps(spark, d):
    paths = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x).alias("s")
    )
    steps = fo.taint_steps(paths.select("conv_id", F.transform("s", lambda x: x["role"]).alias("hops"), F.transform("s", lambda x: x["text"]).alias("notes"), F.transform("s", lambda x: x["turn"]).alias("path")), "conv_id")
    text = F.transform(F.array_sort("steps"), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["note"]))
    return steps.select("conv_id", F.array_join(text, "\n").alias("steps"))


@query(
    """SELECT doc_id AS key, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE 'old' END AS findings FROM documents"""
)
def j2_cache_store(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"))
    new = docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("key")), "key", "left_semi")
    return stores.upsert(docs.withColumn("findings", F.lit("old")), new.withColumn("findings", F.lit("new")), "key")


@query("""SELECT doc_id AS id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'confirmed' ELSE 'needs_review' END AS status FROM documents""")
def j11_recheck(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.lit("needs_review").alias("status"))
    checked = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"), F.lit("confirmed").alias("status"))
    return fo.replace_one(rows, checked).withColumn("id", F.col("id").cast("long"))


@query("SELECT lang AS type, string_agg(DISTINCT source, ',' ORDER BY source) AS affected_files, count(*) AS findings FROM documents GROUP BY lang")
def l5_root_causes(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("type"), F.col("source").alias("file"))
    return fo.root_causes(rows, "type").select("type", flat("affected_files").alias("affected_files"), "findings")


@query("""SELECT '{"doc_id":' || doc_id || ',"source":"' || source || '","n_chars":' || n_chars || '}' AS json FROM documents""")
def l7_json_export(spark, d):
    return fo.to_json(table(spark, d, "documents").select("doc_id", "source", "n_chars"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'local_gpu' WHEN p_size >= 16 THEN 'local_cpu' ELSE 'hash' END AS backend FROM part""")
def l10_backend(spark, d):
    return table(spark, d, "part").select("p_partkey", fo.backend(F.col("p_size")).alias("backend"))
