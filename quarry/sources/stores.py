"""Run archive, graph store with manifest, keyed caches and importers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.ranges import running

GRAPH_VERSION = 1


def corpus_digest(files: DataFrame, path: str, digest: str, by: list[str]) -> DataFrame:
    """(by, files, digest): SHA-256 over a project's ``path:hash`` lines, whatever their order.

    The lines fall into 4,096 ranges by the hash of the path. A range's digest is that of
    its sorted lines, the project's that of the ranges' in order, so no task holds more
    than a range of a project.
    """
    lines = files.select(*by, F.substring(F.sha2(F.col(path).cast("string"), 256), 1, 3).alias("_range"), F.concat_ws(":", F.col(path), F.col(digest)).alias("_line"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    ranges = lines.groupBy(*by, "_range").agg(F.count("*").alias("_n"), joined("_line").alias("_digest"))
    each = ranges.withColumn("_d", F.concat_ws(":", "_range", "_digest"))
    return each.groupBy(*by).agg(F.sum("_n").alias("files"), joined("_d").alias("digest"))


def table_digest(df: DataFrame, columns: list[str]) -> str:
    """Order-free digest of a table: hashes are summed per task, so no row leaves its partition."""
    row = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    high, low = F.xxhash64(F.lit(1), row), F.xxhash64(F.lit(2), row)
    got = df.agg(F.count("*").alias("n"), F.sum(high.cast("decimal(20,0)")).alias("a"), F.sum(low.cast("decimal(20,0)")).alias("b")).first()
    return f"{got['n']}:{got['a']}:{got['b']}"


class GraphStore:
    """Nodes, edges and sinks as Parquet with a manifest that is checked on load."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, nodes: DataFrame, edges: DataFrame, sinks: DataFrame, source_digest: str, definitions: str = "") -> None:
        parts = {"nodes": nodes, "edges": edges, "sinks": sinks}
        for name, df in parts.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        held = {n: table_digest(self.spark.read.parquet(f"{self.path}/{n}"), self.spark.read.parquet(f"{self.path}/{n}").columns) for n in parts}
        manifest = {"version": GRAPH_VERSION, "source": source_digest, "definitions": definitions, "digest": held}
        self.spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest")

    def load(self, source_digest: str, definitions: str = "") -> tuple[dict[str, DataFrame] | None, str]:
        """(tables, "") or (None, reason): missing, version, source, then digest."""
        try:
            manifest = json.loads(self.spark.read.parquet(f"{self.path}/manifest").first()[0])
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None, "missing"
            raise
        if manifest["version"] != GRAPH_VERSION:
            return None, "version"
        if (manifest["source"], manifest["definitions"]) != (source_digest, definitions):
            return None, "source"
        tables = {n: self.spark.read.parquet(f"{self.path}/{n}") for n in manifest["digest"]}
        if any(table_digest(t, t.columns) != manifest["digest"][n] for n, t in tables.items()):
            return None, "digest"
        return tables, ""


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run of every target; equal times fall to the larger id."""
    return runs.groupBy("target").agg(
        F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"), F.max("created_at").alias("created_at")
    )


def run_id(created_at: Column, seed: Column) -> Column:
    return F.concat(F.lit("run-"), F.date_format(created_at, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.sha2(seed.cast("string"), 256), 1, 4))


def upsert(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those with the same key."""
    return index.join(new.select(key), key, "left_anti").unionByName(new)


def cache_key(digest: Column, model: Column, profile: Column, prompt_version: Column) -> Column:
    """One key for (content, model, profile in sorted order, prompt version)."""
    return F.sha2(
        F.concat_ws("|", digest, model, F.concat(F.array_join(F.array_sort(profile), ","), F.lit(",")), F.concat(F.lit("v"), prompt_version.cast("string"))), 256
    )


def split_cache(rows: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses)."""
    return rows.join(cache.select(key), key, "left_semi"), rows.join(cache.select(key), key, "left_anti")


def import_sink_rows(rows: DataFrame, kinds: DataFrame, generic: list[str]) -> DataFrame:
    """(pattern, sink_type) from rows (model, receiver, method, kind).

    Only sink models with a known kind, a receiver and a method that isn't generic;
    the pattern is the receiver's last segment and the method.
    """
    kept = rows.filter((F.col("model") == "sinkModel") & (F.trim("receiver") != "") & (F.trim("method") != "") & ~F.col("method").isin(generic))
    last = F.element_at(F.split("receiver", r"\."), -1)
    return kept.join(kinds, "kind").select(F.concat_ws(".", last, "method").alias("pattern"), "sink_type").distinct()


def import_rules(rules: DataFrame, types: DataFrame) -> DataFrame:
    """(pattern, sink_type) from taint rules (mode, cwe, pattern); metavariable receivers are no patterns."""
    call = F.explode(F.regexp_extract_all("pattern", F.lit(r"(?<![$\w.])([A-Za-z_]\w*\.[A-Za-z_]\w*)\("), 1))
    number = F.regexp_extract("cwe", r"CWE-(\d+)", 1)
    return (
        rules.filter("mode = 'taint'")
        .select(call.alias("pattern"), number.alias("cwe"))
        .join(types, "cwe")
        .select("pattern", "sink_type")
        .distinct()
    )


def findings_in(findings: DataFrame, run: str | None = None, status: str | None = None, finding: str | None = None) -> DataFrame:
    """Reader with its filters; without ``run`` and ``finding`` the newest run."""
    if finding is not None:
        return findings.filter(F.lower("id") == finding.lower())
    if run is None:
        newest = findings.agg(F.max("run_id").alias("run_id"))
        findings = findings.join(newest, "run_id", "left_semi")
    elif run != "all":
        findings = findings.filter(F.col("run_id") == run)
    return findings if status is None else findings.filter(F.col("status") == status)


def number(df: DataFrame, order: list[Column | str], by: list[str], prefix: str = "F") -> DataFrame:
    """Adds ids F001, F002, ... in order within ``by``."""
    return running(df, by, order).withColumn("number", F.format_string(prefix + "%03d", "n")).drop("n", "before")


def merge_index(current: DataFrame, prior: DataFrame, source: str = "", incremental: bool = False) -> DataFrame:
    """(path, hash, state): the index after ``source``, a path below the project, was read again.

    ``current`` and ``prior``: (path, hash). Read files are ``added``, ``changed`` or, with an
    equal hash and ``incremental``, ``reused``. Of the others those below ``source`` are gone and
    ``dropped``; those elsewhere are ``kept`` if ``incremental``, else ``dropped`` as well. An
    empty ``source`` is the whole project. Dropped files stay in the answer, to be reported.
    """
    source = source.strip("/")
    joined = current.select("path", "hash").join(prior.select(F.col("path").alias("_p"), F.col("hash").alias("_h")), F.col("path") == F.col("_p"), "full_outer")
    below = F.lit(True) if source in ("", ".") else (F.col("_p") == source) | F.col("_p").startswith(source + "/")
    state = (
        F.when(F.col("path").isNull(), F.when(F.lit(incremental) & ~below, "kept").otherwise("dropped"))
        .when(F.col("_p").isNull(), "added")
        .when(F.lit(incremental) & (F.col("hash") == F.col("_h")), "reused")
        .otherwise("changed")
    )
    return joined.select(F.coalesce("path", "_p").alias("path"), F.coalesce("hash", "_h").alias("hash"), state.alias("state"))
