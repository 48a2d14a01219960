"""Pluggable sources through the Python Data Source API: scenes of any dataset, and a history that grows.

``SceneSource`` lets a dataset be read as a table: a function names its scenes, another makes the rows of
one. ``HistorySource`` follows a folder of history pages with a step cursor, as a stream.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..registry import query, r6
from .files import scratch
from .views import SCALARS, points, scalars

#: Datasets by name: the names of the scenes, and the rows ``frame, view, x, y`` of one.
DATASETS: dict[str, tuple[Callable[[dict], list[str]], Callable[[str, dict], Iterator[tuple]]]] = {}


def dataset(name: str, scenes: Callable[[dict], list[str]], rows: Callable[[str, dict], Iterator[tuple]]) -> None:
    DATASETS[name] = (scenes, rows)


class Scene(InputPartition):
    def __init__(self, name: str, rows: Callable[[str, dict], Iterator[tuple]], options: dict):
        super().__init__(name)
        self.rows, self.options = rows, options


class SceneReader(DataSourceReader):
    """One partition a scene: a worker makes a scene's rows, the driver only names them."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[Scene]:
        name = self.options.get("dataset")
        if name not in DATASETS:
            raise ValueError(f"{name} is none of the datasets {sorted(DATASETS)}")
        scenes, rows = DATASETS[name]
        return [Scene(s, rows, self.options) for s in scenes(self.options)]

    def read(self, partition: Scene) -> Iterator[tuple]:
        for row in partition.rows(partition.value, partition.options):
            yield (partition.value, *row)


class SceneSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_scenes"

    def schema(self) -> str:
        return "scene string, frame long, view long, x double, y double"

    def reader(self, schema) -> SceneReader:
        return SceneReader(self.options)


def folder_scenes(options: dict) -> list[str]:
    """The folders of a dataset whose scenes are folders of Parquet files."""
    fs, root = pyarrow.fs.FileSystem.from_uri(options["path"] if ":" in options["path"] else f"file://{options['path']}")
    return sorted(f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.type == pyarrow.fs.FileType.Directory)


def folder_rows(scene: str, options: dict) -> Iterator[tuple]:
    fs, root = pyarrow.fs.FileSystem.from_uri(options["path"] if ":" in options["path"] else f"file://{options['path']}")
    for batch in pyarrow.dataset.dataset(f"{root}/{scene}", filesystem=fs, format="parquet").to_batches(columns=["frame", "view", "x", "y"]):
        yield from zip(*(batch.column(c).to_pylist() for c in ("frame", "view", "x", "y")), strict=True)


dataset("folders", folder_scenes, folder_rows)


@query("SELECT 'rig=' || label AS scene, vec_id AS frame, label::BIGINT AS view, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings")
def src_scene_plugin(spark, sf_dir):
    """A dataset of one's own as a table: the driver names its scenes, workers read them."""
    path = scratch(spark, "scenes")
    p = points(spark, sf_dir).select(F.col("batch").alias("rig"), F.col("id").alias("frame"), F.col("batch").alias("view"), "x", "y")
    p.write.partitionBy("rig").parquet(path)
    spark.dataSource.register(SceneSource)
    return spark.read.format("orrery_scenes").option("dataset", "folders").option("path", path).load()


PAGE = re.compile(r"steps=(\d+)-(\d+)$")


def pages(path: str) -> list[tuple[int, int, str]]:
    """``first, last, folder`` of the pages below a history's folder, which are named by their steps."""
    fs, root = pyarrow.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    found = fs.get_file_info(pyarrow.fs.FileSelector(root))
    return sorted((int(m[1]), int(m[2]), f.path) for f in found if (m := PAGE.search(f.path)))


class Page(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)


class HistoryReader(DataSourceStreamReader):
    """Follows a history by its step: each batch takes the pages whose steps come after the cursor; workers read them."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"step": -1}

    def latestOffset(self) -> dict:
        return {"step": max((last for _, last, _ in pages(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(folder) for first, last, folder in pages(self.path) if start["step"] < first and last <= end["step"]]

    def read(self, partition: Page) -> Iterator[tuple]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")
        for file in fs.get_file_info(pyarrow.fs.FileSelector(partition.value)):
            if file.path.endswith(".json"):
                for line in fs.open_input_stream(file.path).read().splitlines():
                    row = json.loads(line)
                    for tag, value in row.items():
                        if not tag.startswith("_") and tag != "global_step" and value is not None:
                            yield row.get("global_step", row.get("_step")), row["_step"], tag, float(value)


class HistorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_history"

    def schema(self) -> str:
        return "step long, ordinal long, tag string, value double"

    def streamReader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


def write_page(rows: DataFrame, path: str, first: int, last: int) -> None:
    """History rows ``_step, global_step`` and a column a tag, as the page of these steps."""
    rows.filter(F.col("_step").between(first, last)).write.option("ignoreNullFields", "true").json(f"{path}/steps={first}-{last}")


@query(f"""WITH {SCALARS}, w AS (SELECT ordinal, CASE WHEN ordinal % 4 > 0 THEN step ELSE ordinal END AS step, value AS loss, CASE WHEN ordinal % 3 = 0 THEN value * 2 END AS rate FROM scalars), u AS (SELECT step, ordinal, tag, value FROM w UNPIVOT (value FOR tag IN (loss, rate)))
SELECT tag, step, round(arg_max(value, ordinal), 6) AS value FROM u GROUP BY tag, step""")
def strm_history(spark, sf_dir):
    """A history in three pages, followed by its cursor; the step falls back to the row's own, later rows win."""
    from ..streaming.live import drained

    path, k = scratch(spark, "history"), F.col("ordinal")
    rows = scalars(spark, sf_dir).select(
        k.alias("_step"), F.when(k % 4 > 0, F.col("step")).alias("global_step"), F.col("value").alias("loss"), F.when(k % 3 == 0, F.col("value") * 2).alias("rate"), F.col("value").alias("_hidden")
    )
    last = rows.agg(F.max("_step")).first()[0] or 0
    for at in range(3):
        write_page(rows, path, at * (last // 3 + 1), (at + 1) * (last // 3 + 1) - 1)
    spark.dataSource.register(HistorySource)
    seen = drained(spark.readStream.format("orrery_history").option("path", path).load(), "append", available_now=False)
    return seen.groupBy("tag", "step").agg(r6(F.max_by("value", "ordinal")).alias("value"))
