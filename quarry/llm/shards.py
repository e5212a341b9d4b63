"""Sharding by size-tiered compaction over a versioned manifest.

A store is a folder with ``data/`` (immutable Parquet shards) and ``manifest/``
(``v<N>.json``). ``append`` writes arrivals as small shards and commits the next
manifest; ``compact`` merges, tier after tier, runs of similarly sized shards into
files near the target size; ``read`` opens the shards of one committed version.
A manifest becomes visible by one rename that fails if the version exists, so a
version is either whole or absent. Of two writers one loses: an append names its
shards in the next version instead, a merge whose inputs are gone is planned anew.
``vacuum`` removes old versions, the shards that only they name, and files that no
version names once they are older than any running writer.

The driver handles one small entry per shard, never rows; all files are touched
through Spark's and Hadoop's file systems. A lost executor repeats its task: files
count only when a manifest names them.

Defined results: appending no rows commits no shard, on an empty store its schema
alone; reading a store without shards gives no rows; columns and rows are stored as
they come, repeated rows, nulls and very long texts included; all appends must have
one schema; a column named like that of the location keeps its name, the location's
gets underscores until it differs.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the store
    bytes: int
    rows: int
    level: int  # merges it went through
    added: int  # version that named it first


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


class ShardStore:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        *,
        target_bytes: int = 128 << 20,
        fan_in: int = 4,
        small_bytes: int = 1 << 20,
        keep_versions: int = 2,
        max_tries: int = 20,
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fan_in, self.small, self.keep, self.tries = target_bytes, fan_in, small_bytes, keep_versions, max_tries
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # -- manifests ---------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The given or the latest committed version; version 0 is the empty store."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Manifest(0, "", ())
        stream = self._fs.open(self._path(f"manifest/v{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Manifest(held["version"], held["schema"], tuple(Shard(**s) for s in held["shards"]))

    def _commit(self, base: Manifest, schema: str, shards: list[Shard]) -> Manifest:
        new = Manifest(base.version + 1, schema, tuple(sorted(shards, key=lambda s: s.path)))
        draft = self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(asdict(new)).encode()))
        finally:
            out.close()
        goal = self._path(f"manifest/v{new.version:010d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self._conf).getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, goal, none)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {new.version} exists") from None
            raise
        return new

    def _written(self, folder: str, level: int, version: int) -> list[Shard]:
        """The shards below ``folder``, with their row counts."""
        sizes = {
            s.getPath().getName(): s.getLen()
            for s in self._fs.listStatus(self._path(folder))
            if s.getPath().getName().endswith(".parquet")
        }
        if not sizes:
            return []
        counts = (
            self.spark.read.parquet(f"{self.path}/{folder}")
            .groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"))
            .count()
            .collect()
        )
        rows = {r["name"]: r["count"] for r in counts}
        return [Shard(f"{folder}/{n}", size, rows[n], level, version) for n, size in sizes.items() if rows.get(n)]

    # -- operations --------------------------------------------------------

    def _check(self, manifest: Manifest, schema: str) -> None:
        fields = lambda text: [(f["name"], f["type"]) for f in json.loads(text)["fields"]]
        if manifest.schema and fields(manifest.schema) != fields(schema):
            raise ValueError("arrivals have another schema than the store")

    def _add(self, folder: str, schema: str) -> Manifest:
        """Commit the files below ``folder`` as new shards on top of whatever version is the latest."""
        for _ in range(self.tries):
            base = self.manifest()
            self._check(base, schema)
            new = self._written(folder, 0, base.version + 1)
            if not new and base.schema:
                return base
            try:
                return self._commit(base, base.schema or schema, [*base.shards, *new])
            except CommitConflict:
                continue
        raise CommitConflict(f"other writers were first {self.tries} times")

    def append(self, arrivals: DataFrame, *, max_rows: int = 8_192) -> Manifest:
        """Write ``arrivals`` as shards of at most ``max_rows`` rows and commit them."""
        schema = arrivals.schema.json()
        self._check(self.manifest(), schema)
        folder = f"data/{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", max_rows).parquet(f"{self.path}/{folder}")
        return self._add(folder, schema)

    def append_parts(self, arrivals: DataFrame, part: Column, *, max_rows: int = 8_192) -> Manifest:
        """Write ``arrivals`` in one pass, a folder for each value of the integer ``part``, and commit each as one arrival."""
        schema = arrivals.schema.json()
        self._check(self.manifest(), schema)
        folder, name = f"data/{uuid.uuid4().hex}", "part_"
        while name in arrivals.columns:
            name += "_"
        numbered = arrivals.withColumn(name, part.cast("int"))
        numbered.write.option("maxRecordsPerFile", max_rows).partitionBy(name).parquet(f"{self.path}/{folder}")
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory())
        if not found:
            return self._add(folder, schema)
        for each in found:
            done = self._add(f"{folder}/{each}", schema)
        return done

    def tier(self, shard: Shard) -> int:
        """Shards of one tier differ in size by less than the factor ``fan_in``."""
        return max(0, math.floor(math.log(max(shard.bytes, 1) / self.small, self.fan_in)) + 1) if shard.bytes > self.small else 0

    def plan(self, manifest: Manifest) -> tuple[list[Shard], int] | None:
        """The smallest tier with ``fan_in`` shards or more below the target, and the files to make of it."""
        tiers: dict[int, list[Shard]] = defaultdict(list)
        for s in manifest.shards:
            if s.bytes < self.target / 2:
                tiers[self.tier(s)].append(s)
        for t in sorted(tiers):
            run = tiers[t]
            if len(run) >= self.fan_in:
                files = max(1, math.ceil(sum(s.bytes for s in run) / self.target))
                if files < len(run):
                    return run, files
        return None

    def compact(self) -> Manifest:
        """Merge until no tier holds a run; every merge is one commit.

        A merge reads similarly sized files and coalesces them without a shuffle,
        so equal shares of files are nearly equal shares of bytes.
        """
        manifest, lost = self.manifest(), 0
        while step := self.plan(manifest):
            run, files = step
            folder = f"data/{uuid.uuid4().hex}"
            source = self.spark.read.schema(self._schema(manifest)).parquet(*(f"{self.path}/{s.path}" for s in run))
            source.coalesce(files).write.parquet(f"{self.path}/{folder}")
            merged = self._written(folder, max(s.level for s in run) + 1, manifest.version + 1)
            if sum(s.rows for s in merged) != sum(s.rows for s in run):
                raise RuntimeError("a merge has changed the number of rows")
            gone = {s.path for s in run}
            while gone <= {s.path for s in manifest.shards}:
                try:
                    manifest = self._commit(manifest, manifest.schema, [*(s for s in manifest.shards if s.path not in gone), *merged])
                    break
                except CommitConflict:
                    lost += 1
                    if lost > self.tries:
                        raise
                    manifest = self.manifest()
            else:  # another merge took these shards
                self._fs.delete(self._path(folder), True)
        return manifest

    def _schema(self, manifest: Manifest):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest.schema))

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a committed version."""
        manifest = self.manifest(version)
        if not manifest.schema:
            raise ValueError("nothing has been appended yet")
        if not manifest.shards:
            return self.spark.createDataFrame([], self._schema(manifest))
        return self.spark.read.schema(self._schema(manifest)).parquet(*(f"{self.path}/{s.path}" for s in manifest.shards))

    def located(self, columns: list[str], version: int | None = None, *, name: str = "shard") -> DataFrame:
        """``columns`` of every row with the shard (path below the store) it lies in, as the last column."""
        while name in columns:
            name += "_"
        if not self.manifest(version).shards:
            return self.read(version).select(*columns, F.lit("").alias(name))
        path = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/(?:[^/]+/)?[^/]+)$", 1)
        return self.read(version).select(*columns, path.alias(name))

    def vacuum(self, *, grace_seconds: float = 86_400) -> int:
        """Remove old manifests, the shards that only they name, and files older than ``grace_seconds``
        that no manifest names (lost commits, failed writes, drafts); how many files went."""
        versions = self.versions()
        kept = versions[-self.keep :]
        named = {s.path for v in kept for s in self.manifest(v).shards}
        old = {s.path for v in versions if v not in kept for s in self.manifest(v).shards} - named
        for v in versions:
            if v not in kept:
                self._fs.delete(self._path(f"manifest/v{v:010d}.json"), False)
        before = (time.time() - grace_seconds) * 1000
        strays = []
        for folder in ("data", "manifest"):
            if not self._fs.exists(self._path(folder)):
                continue
            files = self._fs.listFiles(self._path(folder), True)
            while files.hasNext():
                f = files.next()
                path = f.getPath().toString()
                path = path[path.rindex(f"/{folder}/") + 1 :]
                draft = path.startswith("manifest/.draft-")
                if f.getModificationTime() <= before and path not in named and (draft or folder == "data" and path.endswith(".parquet")):
                    strays.append(path)
        gone = old | set(strays)
        for p in gone:
            self._fs.delete(self._path(p), False)
        self._sweep()
        return len(gone)

    def _sweep(self) -> None:
        """Delete the folders below ``data`` that hold no shard any more."""
        if not self._fs.exists(self._path("data")):
            return
        versions = self.versions()
        named = {s.path.split("/")[1] for v in versions for s in self.manifest(v).shards}
        for s in self._fs.listStatus(self._path("data")):
            folder = s.getPath().getName()
            files = self._fs.listFiles(s.getPath(), True)
            empty = True
            while empty and files.hasNext():
                empty = not files.next().getPath().getName().endswith(".parquet")
            written = self._fs.exists(self._path(f"data/{folder}/_SUCCESS"))
            if folder not in named and empty and written:
                self._fs.delete(s.getPath(), True)

    def drop(self) -> None:
        """Delete the whole store."""
        self._fs.delete(self._path(""), True)
