"""Filter cascade over chunks: keywords, graph reach, similarity, paths; entry points and frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import call_core, segment_match
from quarry.operators.ranges import running


def any_in(text: Column, needles: list[str]) -> Column:
    """Whether one of the literal needles occurs; false for none."""
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return found


def profile_keywords(keywords: DataFrame, languages: DataFrame, profile: list[str], present: DataFrame) -> DataFrame:
    """Distinct lower-case keywords of the profile's classes and of the present languages' sinks."""
    classes = keywords.filter(F.col("vuln").isin(profile)).select(F.lower("keyword").alias("keyword"))
    sinks = languages.join(present.select(F.col("language").alias("id")).distinct(), "id").select(
        F.explode(F.transform("sink_patterns", F.lower)).alias("keyword")
    )
    return classes.union(sinks).distinct()


def keyword_filter(chunks: DataFrame, keywords: list[str], uncovered: list[str], language: str = "language", code: str = "code") -> DataFrame:
    """Layer 1: chunks with a keyword, or of a language without sink patterns; without keywords all.

    The keywords are a small literal list, so the scan is one pass without a join.
    """
    if not keywords:
        return chunks
    return chunks.filter(F.col(language).isin(uncovered) | any_in(F.lower(F.col(code)), keywords))


def rescue_reached(chunks: DataFrame, kept: DataFrame, reached: DataFrame, key: str = "id") -> DataFrame:
    """Layer 2: chunks not kept so far whose node reaches a sink."""
    return chunks.join(kept.select(key), key, "left_anti").join(reached.select(key), key, "left_semi")


def rescue_budget(kept: int, floor: int = 25, fraction: float = 0.1) -> int:
    return max(floor, int(kept * fraction))


def in_paths(file: Column, paths: list[str]) -> Column:
    """Whether a file lies below one of the scoped paths, as a part of its name."""
    return any_in(file, paths)


def union_layers(chunks: DataFrame, layers: list[tuple[str, DataFrame]], key: str = "id") -> DataFrame:
    """Chunks any layer admitted, with the first that did as ``layer``."""
    marks = None
    for i, (name, df) in enumerate(layers):
        part = df.select(key, F.lit(i).alias("_i"), F.lit(name).alias("_l"))
        marks = part if marks is None else marks.unionByName(part)
    first = marks.groupBy(key).agg(F.min_by("_l", "_i").alias("layer"))
    return chunks.join(first, key)


def scope(chunks: DataFrame, score: Column, boosted: Column, limit: int, key: str = "id") -> DataFrame:
    """The ``limit`` best chunks; those under a scoped path gain 1.0."""
    return chunks.withColumn("score", score + F.when(boosted, 1.0).otherwise(0.0)).orderBy(F.desc("score"), key).limit(limit)


def entry_points(chunks: DataFrame, patterns: DataFrame, language: str = "language", code: str = "code") -> DataFrame:
    """First chunk per (file, name) with a pattern of its language. ``patterns``: (language, pattern)."""
    per = patterns.groupBy(F.col("language").alias("_l")).agg(F.collect_set("pattern").alias("_p"))
    hit = chunks.join(per, F.col(language) == F.col("_l")).filter(F.exists("_p", lambda p: F.contains(F.col(code), p)))
    return hit.drop("_l", "_p").dropDuplicates(["file", "name"])


def is_entry(name: Column, decorators: Column, code: Column, pattern: Column) -> Column:
    """``def X`` matches the beginning of the name, ``@X`` of a decorator, anything else the code."""
    return (
        F.when(pattern.startswith("def "), name.startswith(F.substring(pattern, 5, 1000)))
        .when(pattern.startswith("@"), F.exists(decorators, lambda d: d.startswith(F.substring(pattern, 2, 1000))))
        .otherwise(F.contains(code, pattern))
    )


def detect_frameworks(chunks: DataFrame, frameworks: DataFrame, min_files: int = 1) -> DataFrame:
    """(id, files): frameworks a marker of which occurs in a chunk of their languages."""
    marked = frameworks.select("id", F.explode(F.concat(F.array("language"), F.col("also"))).alias("_l"), "markers")
    hit = chunks.select("file", "language", "code").join(marked, F.col("language") == F.col("_l"))
    hit = hit.filter(F.exists("markers", lambda m: F.contains("code", m)))
    return hit.groupBy("id").agg(F.countDistinct("file").alias("files")).filter(F.col("files") >= min_files)


def overlays(frameworks: DataFrame, detected: DataFrame) -> DataFrame:
    """Per language the sorted sinks, entries, sources and sanitizers of the detected frameworks."""
    held = frameworks.join(detected.select("id"), "id", "left_semi").select(
        F.explode(F.concat(F.array("language"), F.col("also"))).alias("language"), "sinks", "entry_patterns", "sources", "sanitizers"
    )
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return held.groupBy("language").agg(flat("sinks"), flat("entry_patterns"), flat("sources"), flat("sanitizers"))


def merge_patterns(own: Column, new: Column) -> Column:
    """Sorted union; the case of patterns is kept."""
    return F.array_sort(F.array_distinct(F.concat(own, new)))


def match_sinks(calls: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern, sink_type) where a resolved call matches a sink pattern.

    ``calls``: (id, language, names array, code, precise). Dotted-name patterns match
    by segments; others, and any where names aren't precise, by substring.
    """
    p = patterns.select(F.col("language").alias("_l"), "pattern", "sink_type", call_core(F.col("pattern")).alias("_core"))
    joined = calls.join(p, F.col("language") == F.col("_l"))
    by_name = F.exists("names", lambda n: segment_match(n, F.col("_core")))
    by_text = (F.col("_core").isNull() | ~F.col("precise")) & F.contains("code", F.col("pattern"))
    return joined.filter(F.coalesce(by_name, F.lit(False)) | by_text).select("id", "pattern", "sink_type").distinct()


def first_per(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def batches(df: DataFrame, size: int, order: str, by: list[str]) -> DataFrame:
    """Adds ``batch``: consecutive runs of ``size`` rows within ``by``."""
    return running(df, by, [order]).withColumn("batch", F.floor((F.col("n") - 1) / size).cast("long")).drop("n", "before")


def match_qualified(calls: DataFrame, models: DataFrame, name: str = "name") -> DataFrame:
    """Calls matched with the models whose pattern is qualified, that is holds a dot.

    A pattern matches a run of a name's segments; every run of two or more meets the
    patterns by an equi-join, so the models may be as many as they like.
    """
    core = call_core(F.col("pattern"))
    held = models.select("pattern", "sink_type", core.alias("_core")).filter(F.contains("_core", F.lit("."))).distinct()
    parts = F.split(F.col(name), r"\.")
    last = F.size(parts)
    run = lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "."))
    runs = F.when(last > 1, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), last - 1), run)))).otherwise(F.array().cast("array<string>"))
    return calls.withColumn("_core", F.explode(runs)).join(held, "_core").drop("_core").distinct()


def layered(*layers: Column) -> Column:
    """Maps laid over each other, the last that has a key wins."""
    out = layers[0]
    for layer in layers[1:]:
        out = F.map_zip_with(out, layer, lambda _, old, new: F.coalesce(new, old))
    return out
