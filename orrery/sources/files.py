"""Readers and writers of the engine's own file forms: CSV tables, JSON manifests, arrays, staged folders."""

from __future__ import annotations

import fnmatch
import io
import math
import tarfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, r6
from .checkpoints import ready
from .views import TRACK_OBS, hashed, table, track_obs

#: Files to a batch of a listing; what a task reads, and what opening a file counts for.
LISTED, TASK_BYTES, OPEN_BYTES = 10_000, 16 << 20, 64 << 10

#: Takes rows as they come to a task and gives the names and contents of files.
Make = Callable[[Iterator[pd.DataFrame]], Iterator[tuple[str, bytes]]]


def scratch(spark: SparkSession, what: str) -> str:
    return f"{ready(spark).rstrip('/')}/orrery-{what}-{uuid.uuid4().hex}"


def read_indexed_csv(spark: SparkSession, path: str, schema: str, index: str) -> DataFrame:
    """A CSV table with a header whose ``index`` is unique; a table without rows or with repeats is an error."""
    df = spark.read.schema(schema).csv(path, header=True)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    if repeated := df.groupBy(index).count().filter("count > 1").limit(3).collect():
        raise ValueError(f"{index} repeats: {[r[index] for r in repeated]}")
    return df


@query("SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance FROM customer")
def src_csv_unique_index(spark, sf_dir):
    """Written as CSV and read back with a checked index."""
    path = scratch(spark, "csv")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance")).write.csv(path, header=True)
    return read_indexed_csv(spark, path, "id long, name string, balance double", "id")


def read_manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    """``scene, n_frames, bad`` of a JSON manifest's map of scenes; another version is an error."""
    schema = "version int, scenes map<string, struct<n_frames: long, bad: array<long>>>"
    found = spark.read.schema(schema).json(path)
    if found.filter(~F.col("version").eqNullSafe(version)).limit(1).count():
        raise ValueError(f"{path} has another version than {version}")
    return found.select(F.explode("scenes").alias("scene", "s")).select("scene", "s.n_frames", "s.bad")


@query(f"WITH {TRACK_OBS} SELECT CAST(track AS VARCHAR) AS scene, max(frame) + 1 AS n_frames, count(*) FILTER (WHERE NOT vis) AS bad FROM track_obs GROUP BY track")
def src_json_manifest(spark, sf_dir):
    path = scratch(spark, "manifest")
    rows = track_obs(spark, sf_dir).groupBy("track").agg((F.max("frame") + 1).alias("n_frames"), F.sort_array(F.collect_list(F.when(~F.col("vis"), F.col("frame")))).alias("bad"))
    rows.select(F.lit(3).alias("version"), F.create_map(F.col("track").cast("string"), F.struct("n_frames", "bad")).alias("scenes")).write.json(path)
    found = read_manifest(spark, path, 3)
    return found.select("scene", "n_frames", F.size("bad").cast("long").alias("bad"))


@query(f"WITH {TRACK_OBS} SELECT view, frame, round(avg(x), 6) AS x FROM track_obs WHERE view = 1 AND frame BETWEEN 10 AND 19 GROUP BY view, frame")
def src_pruned_view_frame(spark, sf_dir):
    """Views are folders and frames are sorted within files: a read of one view and ten frames skips the rest."""
    path = scratch(spark, "views")
    track_obs(spark, sf_dir).select("view", "frame", "x").repartition("view").sortWithinPartitions("view", "frame").write.partitionBy("view").parquet(path)
    found = spark.read.schema("frame long, x double, view long").parquet(path).filter("view = 1 AND frame BETWEEN 10 AND 19")
    return found.groupBy("view", "frame").agg(r6(F.avg("x")).alias("x"))


def read_arrays(spark: SparkSession, path: str, shape: tuple[int, ...]) -> DataFrame:
    """``.npy`` files as rows ``path, i, j, value``; an array of another rank or width is an error."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != len(shape) or any(w >= 0 and w != n for w, n in zip(shape, a.shape, strict=True)):
                    raise ValueError(f"{name} has shape {a.shape}, not {shape}")
                i, j = np.indices(a.shape)
                yield pd.DataFrame({"path": name, "i": i.ravel(), "j": j.ravel(), "value": a.ravel().astype(np.float64)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(rows, "path string, i long, j long, value double")


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, modificationTime`` of the files below a folder; contents are not read.

    The driver lists the folder itself, tasks what lies in its folders. Names that begin with a dot or an underscore are left out, as Spark's readers do.
    """
    base = located(path).rstrip("/")
    fs, root = pyarrow.fs.FileSystem.from_uri(base)
    before, shown = base[: len(base) - len(root)], lambda name: name[0] not in "._"
    folders = [i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(root)) if not i.is_file and shown(i.base_name)]

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(base)
        for batch in batches:
            for folder, deep in zip(batch["folder"], batch["deep"], strict=True):
                found = [i for i in fs.get_file_info(pyarrow.fs.FileSelector(folder, recursive=bool(deep))) if i.is_file and fnmatch.fnmatchcase(i.base_name, pattern) and all(map(shown, i.path[len(root) :].strip("/").split("/")))]
                for at in range(0, len(found), LISTED):
                    some = found[at : at + LISTED]
                    yield pd.DataFrame({"path": [before + i.path for i in some], "length": [i.size for i in some], "modificationTime": pd.to_datetime([i.mtime_ns // 1000 for i in some], unit="us", utc=True)})

    places = spark.createDataFrame([(root, False), *((f, True) for f in folders)], "folder string, deep boolean")
    return places.repartition(min(len(folders) + 1, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(files, "path string, length long, modificationTime timestamp")


def dealt(files: DataFrame, each: int = TASK_BYTES) -> DataFrame:
    """Rows ``path, length`` of files, dealt over tasks of about ``each`` bytes; a file counts ``OPEN_BYTES`` more than it holds."""
    size = files.agg(F.sum(F.col("length") + OPEN_BYTES)).first()[0] or 0
    return files.repartition(max(1, math.ceil(size / each)), "path")


def opened(uri: str) -> io.RawIOBase:
    """A stream of a file that Spark has listed, on the worker."""
    fs, where = pyarrow.fs.FileSystem.from_uri(uri)
    return fs.open_input_stream(where)


def located(path: str) -> str:
    """A path as a URI."""
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def named_contents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch["name"], batch["content"], strict=True)


def as_rows(make: Make, most: int = 4 << 20) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What ``make`` gives as rows ``name, content``, in batches of about ``most`` bytes."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for one in make(batches):
            out.append(one)
            held += len(one[1])
            if held >= most:
                yield pd.DataFrame(out, columns=["name", "content"])
                out, held = [], 0
        yield pd.DataFrame(out, columns=["name", "content"])

    return rows


def write_files(rows: DataFrame, path: str, make: Make | None = None) -> int:
    """Writes rows ``name, content`` as files below ``path``, each whole or not at all; how many.

    With ``make`` the rows are any, and each task makes its files' contents of them, which no one else sees.
    A worker writes beside the name and moves: a task that runs again writes the same.
    """
    base = located(path)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(base)
        n, made = 0, set()
        for name, content in (make or named_contents)(batches):
            place = f"{root}/{name}"
            folder = place.rpartition("/")[0]
            if folder not in made:
                if len(made) >= LISTED:
                    made.clear()
                fs.create_dir(folder)
                made.add(folder)
            with fs.open_output_stream(draft := f"{place}.{uuid.uuid4().hex}.draft") as out:
                out.write(content)
            fs.move(draft, place)
            n += 1
        yield pd.DataFrame({"n": [n]})

    return (rows if make else rows.select("name", "content")).mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_tars(spark: SparkSession, path: str, batch_bytes: int = 32 << 20) -> DataFrame:
    """Members of TAR shards as rows ``shard, position, scene, kind, name, bytes, content``.

    A member's scene is its folder and its kind the last part of its name. A shard is a
    stream, never a value: a task reads many small shards one after the other, or a large one, and members leave in batches of about ``batch_bytes``.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["shard", "position", "scene", "kind", "name", "bytes", "content"]
        out, held = [], 0
        for batch in batches:
            for shard in batch["path"]:
                with opened(shard) as stream, tarfile.open(fileobj=stream, mode="r|") as tar:
                    for k, member in enumerate(m for m in tar if m.isfile()):
                        scene, _, base = member.name.rpartition("/")
                        out.append((shard, k, scene, base.rpartition(".")[2], member.name, member.size, tar.extractfile(member).read()))
                        held += member.size
                        if held >= batch_bytes or len(out) >= LISTED:
                            yield pd.DataFrame(out, columns=names)
                            out, held = [], 0
        yield pd.DataFrame(out, columns=names)

    shards = dealt(listed(spark, path, "*.tar").select("path", "length"))
    return shards.mapInPandas(rows, "shard string, position long, scene string, kind string, name string, bytes long, content binary")


def publish(df: DataFrame, path: str) -> bool:
    """Writes ``df`` beside ``path`` and renames it into place; False, and nothing written, if it is there."""
    spark = df.sparkSession
    final = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(final):
        return False
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if not fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged), final):
        raise RuntimeError(f"{path} could not be published")
    return True


__all__ = ["hashed"]
