"""Byte stores, and byte ranges of files, read by seeking on the workers; neighbouring ranges are one read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import ranked
from ..registry import query
from .files import listed, scratch, write_files
from .views import table

#: Ranges that begin within so many bytes of a file are one task's; a read has so many bytes at most, unless one range has more.
BLOCK, READ = 64 << 20, 8 << 20
#: Frames to a file of a store: a task gathers and writes one file.
FRAMES = 1024


def read_ranges(wanted: DataFrame, gap: int = 0, block: int = BLOCK) -> DataFrame:
    """Rows ``file, start, end`` and any others, with ``data`` and ``fetched``: the bytes that were read from the file for this row.

    Ranges no more than ``gap`` bytes apart are read at once, and the first of them counts the read; so
    ``fetched`` sums to what was read. A file that ends before a range does is an error.
    """
    names = wanted.columns

    def flush(run: list[dict]) -> list[dict]:
        begin, end = run[0]["start"], max(r["end"] for r in run)
        fs, where = pyarrow.fs.FileSystem.from_uri(run[0]["file"])
        with fs.open_input_file(where) as file:
            file.seek(begin)
            data = file.read(end - begin)
        if len(data) != end - begin:
            raise ValueError(f"{run[0]['file']} ends at {begin + len(data)}, before {end}")
        return [r | {"data": data[r["start"] - begin : r["end"] - begin], "fetched": 0 if k else len(data)} for k, r in enumerate(run)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, out, held = [], [], 0
        frame = lambda: pd.DataFrame(out, columns=[*names, "data", "fetched"])
        for batch in batches:
            for row in batch.to_dict("records"):
                if run and (row["file"] != run[0]["file"] or row["start"] > run[-1]["end"] + gap or row["end"] - run[0]["start"] > READ):
                    out += flush(run)
                    held, run = held + out[-1]["end"] - run[0]["start"], []
                    if held >= READ:
                        yield frame()
                        out, held = [], 0
                run.append(row)
        if run:
            out += flush(run)
        yield frame()

    schema = T.StructType([*wanted.schema.fields, T.StructField("data", T.BinaryType()), T.StructField("fetched", T.LongType())])
    near = wanted.repartition("file", F.floor(F.col("start") / block)).sortWithinPartitions("file", "start", "end")
    return near.mapInPandas(rows, schema)


def byte_store(rows: DataFrame, path: str, frames: int = FRAMES) -> DataFrame:
    """Writes rows ``store, frame, data`` as files of bytes, ``frames`` to a file; ``store, part, frame, start, end`` of the frames in them."""

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{key[0]}/{key[1]:06d}.bin"], "content": [b"".join(group.sort_values("frame")["data"])]})

    parts = ranked(rows, ["store"], [F.col("frame")], "place").withColumn("part", F.floor(F.col("place") / frames)).drop("place")
    write_files(parts.groupBy("store", "part").applyInPandas(join, "name string, content binary"), path)
    end = F.sum(F.length("data")).over(Window.partitionBy("store", "part").orderBy("frame"))
    return parts.select("store", "part", "frame", (end - F.length("data")).alias("start"), end.alias("end"))


def store_ranges(spark: SparkSession, offsets: DataFrame, path: str) -> DataFrame:
    """``file, store, frame, start, end`` of the frames of the complete stores below ``path``.

    A store is complete if in each of its files the offsets rise without a gap and end at the file's size.
    """
    in_part = Window.partitionBy("store", "part").orderBy("frame")
    rises = (F.col("start") < F.col("end")) & (F.coalesce(F.lag("end").over(in_part), F.lit(0)) == F.col("start"))
    said = offsets.withColumn("rises", rises).groupBy("store", "part").agg(F.bool_and("rises").alias("rises"), F.max("end").alias("last"))
    at = lambda k: F.regexp_extract("path", r"([^/]+)/(\d+)\.bin$", k)
    files = listed(spark, path, "*.bin").select(F.col("path").alias("file"), at(1).alias("store"), at(2).cast("long").alias("part"), "length")
    found = said.join(files, ["store", "part"], "left")
    broken = found.filter(~F.coalesce(F.col("rises") & (F.col("last") == F.col("length")), F.lit(False))).select("store").distinct()
    whole = found.join(broken, "store", "left_anti").select("store", "part", "file")
    return offsets.join(whole, ["store", "part"]).select("file", "store", "frame", "start", "end")


def customer_store(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Five hundred customers to a store, 128 to a file; the ranges of all."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.format_string("store_%d", F.floor(k / 500)).alias("store"), k.alias("frame"), F.col("c_name").cast("binary").alias("data"))
    return store_ranges(spark, byte_store(rows, path, 128), path)


@query("SELECT 'store_' || (c_custkey // 500) AS store, c_custkey AS frame, c_name AS said FROM customer")
def src_byte_store(spark, sf_dir):
    """Records in byte stores, checked, and read by their ranges."""
    return read_ranges(customer_store(spark, sf_dir, scratch(spark, "bytes"))).select("store", "frame", F.col("data").cast("string").alias("said"))


@query("""WITH n AS (SELECT c_custkey // 500 AS k, c_custkey AS frame, c_name AS said, (row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) - 1) // 128 AS part FROM customer),
c AS (SELECT 'store_' || k AS store, frame, said, part, frame // 3 AS run FROM n WHERE frame % 3 <> 0)
SELECT store, frame, said, CASE WHEN frame = min(frame) OVER w THEN CAST(sum(strlen(said)) OVER w AS BIGINT) ELSE 0 END AS fetched FROM c WINDOW w AS (PARTITION BY store, part, run)""")
def src_byte_ranges(spark, sf_dir):
    """Two of three records of byte stores: neighbours come with one read, and no other byte is read."""
    wanted = customer_store(spark, sf_dir, scratch(spark, "ranges")).filter("frame % 3 <> 0")
    return read_ranges(wanted).select("store", "frame", F.col("data").cast("string").alias("said"), "fetched")
