"""Reading source trees and archives as tables of files."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import extension, shebang
from quarry.operators.ranges import running

MAX_FILE = 10 << 20
MAX_PROJECT = 2 << 30
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
PRUNED = frozenset([".git", ".quarry"])
_FILES = "path string, content binary, size_bytes long"


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, size_bytes) of regular files below ``root``.

    Symbolic links, pruned folders and anything that resolves outside are left out;
    the names are listed on the driver, the bytes read in parallel.
    """
    top = os.path.realpath(root)
    found = []
    for folder, dirs, names in os.walk(top, followlinks=False):
        dirs[:] = sorted(d for d in dirs if d not in PRUNED and not os.path.islink(os.path.join(folder, d)))
        for name in sorted(names):
            path = os.path.join(folder, name)
            if os.path.isfile(path) and not os.path.islink(path) and os.path.realpath(path).startswith(top + os.sep):
                found.append(path)
    if not found:
        return spark.createDataFrame([], _FILES)
    files = spark.read.format("binaryFile").load(found)
    own = F.regexp_replace(F.col("path"), r"^file:/+", "/")
    return files.select(F.substring(own, len(top) + 2, 100_000).alias("path"), "content", F.col("length").alias("size_bytes"))


def unzip(archives: DataFrame, max_file: int = MAX_FILE, max_archive: int = MAX_PROJECT) -> DataFrame:
    """(path, content, size_bytes) of the members of zip archives given as ``content``.

    Members that are links, folders, point outside the archive or unpack to more than
    ``max_file`` bytes are left out; no more of one is ever unpacked than that, whatever
    size it states. An archive whose kept members pass ``max_archive`` bytes is an error.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                total = 0
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for info in z.infolist():
                        link = (info.external_attr >> 16) & 0o170000 == 0o120000
                        path = os.path.normpath(info.filename)
                        if link or info.is_dir() or os.path.isabs(path) or path.split(os.sep)[0] == "..":
                            continue
                        with z.open(info) as member:
                            content = member.read(max_file + 1)
                        if len(content) > max_file:
                            continue
                        total += len(content)
                        if total > max_archive:
                            raise ValueError(f"an archive unpacks to more than {max_archive} bytes")
                        yield pd.DataFrame({"path": [path], "content": [content], "size_bytes": [len(content)]})

    return archives.select("content").mapInPandas(members, _FILES)


def classify(source: str) -> str:
    """directory, zip, git or url; an error for anything else."""
    low = source.strip().lower()
    hosts = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org")
    if low.startswith(("git@", "git://", "ssh://")):
        return "git"
    if low.startswith(("http://", "https://")):
        host = low.split("/")[2].removeprefix("www.")
        return "git" if low.rstrip("/").endswith(".git") or host in hosts and low.rstrip("/").count("/") > 2 else "url"
    if low.startswith("file://") and low.rstrip("/").endswith(".git"):
        return "git"
    path = source.removeprefix("file://")
    if os.path.isdir(path):
        return "directory"
    if os.path.isfile(path) and low.endswith(".zip"):
        return "zip"
    raise ValueError(f"neither a folder, an archive nor an address: {source}")


def read_source(spark: SparkSession, source: str) -> DataFrame:
    """(path, content, size_bytes) of a folder or zip archive; archives are unpacked in tasks, never to disk."""
    kind = classify(source)
    if kind == "directory":
        return scan_tree(spark, source.removeprefix("file://"))
    if kind == "zip":
        return unzip(spark.read.format("binaryFile").load(source).select("content"))
    raise ValueError(f"a {kind} source has to be fetched first: {source}")


def decode(files: DataFrame) -> DataFrame:
    """Text of the files that aren't binary (a NUL among the first 4096 bytes); bad bytes become U+FFFD."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None or b"\x00" in bytes(b[:4096]) else bytes(b).decode("utf-8", "replace"))

    return files.withColumn("code", text("content")).filter("code IS NOT NULL").drop("content")


def with_language(files: DataFrame, languages: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """Adds ``language``: by extension, else by interpreter; later definitions win."""
    ranked = languages.select("*", F.monotonically_increasing_id().alias("_o"))
    by_ext = ranked.select("_o", "id", F.explode("extensions").alias("_ext")).groupBy("_ext").agg(F.max_by("id", "_o").alias("_l1"))
    by_run = ranked.select("_o", "id", F.explode("interpreters").alias("_run")).groupBy("_run").agg(F.max_by("id", "_o").alias("_l2"))
    out = files.select("*", extension(F.col(path)).alias("_ext"), shebang(F.col(code)).alias("_run"))
    return (
        out.join(by_ext, "_ext", "left")
        .join(by_run, "_run", "left")
        .withColumn("language", F.coalesce("_l1", "_l2"))
        .drop("_ext", "_run", "_l1", "_l2")
    )


def allowed_path(path: Column) -> Column:
    """No control character (tab and line feed are allowed)."""
    return ~path.rlike(CONTROL)


def within_limits(files: DataFrame, order: str, size: str, max_file: int = MAX_FILE, max_project: int = MAX_PROJECT, per: list[str] | None = None) -> DataFrame:
    """Files up to ``max_file``, in order until the running total would pass ``max_project``.

    The cut stops the scan: nothing after the first file that doesn't fit is taken.
    Totals run per project (``per``), over ranges of its files.
    """
    fit = running(files.filter(F.col(size) <= max_file), per or [], [order], size)
    return fit.filter(F.col("before") + F.col(size) <= max_project).select(*files.columns)
