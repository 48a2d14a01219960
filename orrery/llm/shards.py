"""Sharding: append arrivals as small immutable shards, compact them by size, commit manifests.

A store is a folder with ``data`` (Parquet shards, written once and never changed) and
``manifest`` (one JSON file a version). A shard's tier is the power of ``fan_in`` that its
size has over ``small_bytes``. Whenever a tier below the target holds ``fan_in`` shards or
more, one Spark job merges that run into files of about ``target_bytes`` or of the next
tier: input files are coalesced, so rows are copied once and never shuffled.

A version becomes visible by the creation of its manifest file, which fails if another
writer was first; then the loser reads the winner's version and tries again. Data files that no
manifest names are never read, so a lost executor or a failed job leaves the store as it was.
A manifest names the shards that its version adds and removes; every ``FULL``-th names all,
so that a commit writes what changed and a reader opens ``FULL`` files at most. Entries are
files, not rows.

Edge cases: an empty arrival commits a version without new shards, and an empty store
reads as an empty table of its schema; nulls, repeated rows and columns of any name are
data; an arrival whose columns differ from the store's is refused. ``vacuum`` deletes every
file below the store that the newest ``keep`` versions do not name, files of failed jobs and lost
races too, once it is ``grace_s`` seconds old: younger ones may belong to a running writer.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import discard, filesystem, fresh, rename_new

#: Versions between two manifests that name all shards.
FULL = 16
LARGE = 99


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int
    tier: int
    born: int


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 256 << 20, small_bytes: int = 1 << 20, fan_in: int = 4):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.small_bytes, self.fan_in = target_bytes, small_bytes, fan_in

    # manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        fs, folder = filesystem(self.spark, f"{self.root}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _said(self, version: int) -> dict:
        fs, path = filesystem(self.spark, self._manifest(version))
        stream = fs.open(path)
        try:
            jvm = self.spark.sparkContext._jvm
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _chain(self, version: int) -> list[dict]:
        """The manifests that make up a version: from the last that names all shards on."""
        chain = [self._said(version)]
        while not chain[0]["full"]:
            chain.insert(0, self._said(chain[0]["version"] - 1))
        return chain

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``schema`` (JSON or None), ``shards``; version 0 is the empty store."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        shards: dict[str, Shard] = {}
        schema = None
        for said in self._chain(version) if version else ():
            schema = said["schema"]
            for path in said["removed"]:
                del shards[path]
            shards |= {s["path"]: Shard(**s) for s in said["added"]}
        return {"version": version, "schema": schema, "shards": list(shards.values())}

    def _commit(self, now: dict, schema: str, shards: list[Shard]) -> int:
        """The whole manifest goes to a file of its own, which a rename without overwriting makes the version."""
        version, was, new = now["version"] + 1, {s.path for s in now["shards"]}, {s.path for s in shards}
        full = version % FULL == 1
        said = {
            "version": version, "schema": schema, "full": full, "removed": [] if full else sorted(was - new),
            "added": [asdict(s) for s in shards if full or s.path not in was],
        }
        name = f"{self.root}/manifest/.draft-{uuid.uuid4().hex}"
        fs, draft = filesystem(self.spark, name)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if not rename_new(self.spark, name, self._manifest(version)):
            fs.delete(draft, False)
            raise Conflict(f"version {version} is there")
        return version

    def _change(self, make: Callable[[dict], tuple[str, list[Shard]] | None], tries: int = 5) -> int:
        for attempt in range(tries):
            now = self.manifest()
            if (made := make(now)) is None:
                return now["version"]
            try:
                return self._commit(now, *made)
            except Conflict:
                if attempt == tries - 1:
                    raise
        raise AssertionError

    # data

    def tier(self, size: int) -> int:
        if size >= self.target_bytes // 2:
            return LARGE
        k = 0
        while size > self.small_bytes * self.fan_in**k:
            k += 1
        return k

    def _written(self, df: DataFrame, born: int) -> list[Shard]:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        counts = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes")
        )
        return [Shard(r["path"], r["rows"], r["bytes"], self.tier(r["bytes"]), born) for r in counts.collect()]

    def append(self, df: DataFrame) -> int:
        """Writes ``df`` as new shards, one or more for each of its partitions; the version that has them."""
        schema = StructType(df.schema.fields).json()
        bare = lambda s: [(f.name, f.dataType) for f in StructType.fromJson(json.loads(s)).fields]
        shards: list[Shard] | None = None

        def make(now: dict) -> tuple[str, list[Shard]]:
            nonlocal shards
            if now["schema"] and bare(now["schema"]) != bare(schema):
                raise ValueError("the arrival's columns differ from the store's")
            if shards is None:
                shards = self._written(df, now["version"] + 1)
            return now["schema"] or schema, now["shards"] + shards

        return self._change(make)

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of shards of one tier that are due for a merge: the lowest tier that has enough."""
        by: dict[int, list[Shard]] = {}
        for s in shards:
            if s.tier != LARGE:
                by.setdefault(s.tier, []).append(s)
        return [sorted(v, key=lambda s: (s.born, s.path)) for _, v in sorted(by.items()) if len(v) >= self.fan_in][:1]

    def compact(self) -> int:
        """Merges runs until no tier holds ``fan_in`` shards; the version after the last merge."""
        version = self.manifest()["version"]
        while True:
            merged: dict[tuple[str, ...], list[Shard]] = {}

            def make(now: dict) -> tuple[str, list[Shard]] | None:
                due = self.runs(now["shards"])
                if not due:
                    return None
                gone = {s.path for s in due[0]}
                key = tuple(sorted(gone))
                if key not in merged:
                    # Files of the target size if the run has enough for several, else one of a higher tier.
                    files = max(1, min(sum(s.bytes for s in due[0]) // self.target_bytes, len(gone) // 2))
                    merged[key] = self._written(self.load(now["schema"], sorted(gone)).coalesce(files), now["version"] + 1)
                return now["schema"], [s for s in now["shards"] if s.path not in gone] + merged[key]

            after = self._change(make)
            if after == version:
                return version
            version = after

    def load(self, schema: str, paths: list[str]) -> DataFrame:
        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The store's rows in a version; with ``shard_col`` each row's shard too."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise AnalysisException("the store has no versions yet")
        df = self.load(now["schema"], [s.path for s in now["shards"]])
        if shard_col is None:
            return df
        where = F.col("_metadata.file_path") if now["shards"] else F.lit(None).cast("string")
        return df.withColumn(shard_col, where)

    def shards(self, version: int | None = None) -> DataFrame:
        rows = [(s.path, s.rows, s.bytes, s.tier, s.born) for s in self.manifest(version)["shards"]]
        return self.spark.createDataFrame(rows, "path string, rows long, bytes long, tier int, born long")

    def vacuum(self, keep: int = 1, grace_s: float = 86_400.0) -> int:
        """Deletes the files that the newest ``keep`` versions do not need and that are ``grace_s`` seconds old; how many."""
        known = self.versions()
        if not known:
            return 0
        kept = known[-keep:]
        path_of = lambda p: filesystem(self.spark, p)[1].toUri().getPath()
        needed = {path_of(s.path) for v in kept for s in self.manifest(v)["shards"]}
        needed |= {path_of(self._manifest(v)) for v in range(self._chain(kept[0])[0]["version"], known[-1] + 1)}
        fs, root = filesystem(self.spark, self.root)
        files, old, before = fs.listFiles(root, True), [], (time.time() - grace_s) * 1000
        while files.hasNext():
            status = files.next()
            # A version that came after the list was read is younger than the list, if not than the grace.
            name, newer = status.getPath().getName(), status.getModificationTime() > before
            fresh_version = name[:-5].isdigit() and name.endswith(".json") and int(name[:-5]) > known[-1]
            if status.getPath().toUri().getPath() not in needed and not newer and not fresh_version:
                old.append(status.getPath())
        for path in old:
            fs.delete(path, False)
        return len(old)


def shard_table(docs: DataFrame, root: str, arrivals: int = 4, key: str = "doc_id", **sizes: int) -> ShardStore:
    """A store of ``docs``, dealt by a hash of ``key`` into ``arrivals`` appends, then compacted and vacuumed.

    The rows are dealt in one pass; each arrival is then appended by itself.
    """
    spark = docs.sparkSession
    dealt = f"{root}/arriving"
    [arrival] = fresh(docs, "arrival")
    number = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(arrivals)).cast("int")
    docs.withColumn(arrival, number).write.partitionBy(arrival).parquet(dealt)
    store = ShardStore(spark, root, **sizes)
    for k in range(arrivals):
        fs, part = filesystem(spark, f"{dealt}/{arrival}={k}")
        if fs.exists(part):
            store.append(spark.read.schema(docs.schema).parquet(f"{dealt}/{arrival}={k}"))
    if not store.versions():
        store.append(docs.limit(0))
    discard(spark, dealt)
    store.compact()
    store.vacuum(grace_s=0.0)  # nobody else writes here yet
    return store
