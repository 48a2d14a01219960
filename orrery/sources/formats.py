"""File forms of experiments, written and read back: CSV tables, JSON lines, byte stores, shards with inventories, catalogues.

Every query writes its form to the shared folder with Spark and reads it with the reader under test.
"""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import top_k
from ..operators.quantiles import ranked
from ..registry import query, r6
from .files import LISTED, as_rows, dealt, listed, opened, publish, read_arrays, read_tars, scratch, write_files
from .views import METRICS, SCALARS, TRACK_OBS, metrics, points, scalars, table, track_obs


def read_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """``metric, value`` of CSV files without a header; rows without a metric go."""
    return spark.read.schema("metric string, value double").csv(path).dropna(subset=["metric"])


@query("SELECT p_brand AS metric, round(avg(p_size), 6) AS value FROM part WHERE p_brand NOT LIKE '%5' GROUP BY p_brand")
def src_csv_headerless(spark, sf_dir):
    path = scratch(spark, "metrics")
    m = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_size").alias("value"))
    m.select(F.when(~F.col("p_brand").endswith("5"), F.col("p_brand")), "value").write.csv(path)
    return read_metric_csv(spark, path).select("metric", r6("value").alias("value"))


def read_mapping(spark: SparkSession, path: str, scene: str, form: str) -> DataFrame:
    """Rows of an asset mapping of one scene whose sequence's whole name has a form, with the form's groups."""
    rows = spark.read.schema("scene string, sequence_name string, archive string").csv(path, header=True)
    at = lambda k: F.regexp_extract("sequence_name", f"^(?:{form})$", k)
    return rows.filter((F.col("scene") == scene) & F.col("sequence_name").rlike(f"^(?:{form})$")).select("archive", at(1).cast("long").alias("sequence"), at(2).cast("long").alias("take"))


@query("SELECT c_name AS archive, c_custkey AS sequence, c_nationkey::BIGINT AS take FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10")
def src_csv_mapping(spark, sf_dir):
    path = scratch(spark, "mapping")
    c = table(spark, sf_dir, "customer")
    c.select(F.col("c_mktsegment").alias("scene"), F.format_string("seq_%d_v%d", "c_custkey", "c_nationkey").alias("sequence_name"), F.col("c_name").alias("archive")).write.csv(path, header=True)
    return read_mapping(spark, path, "BUILDING", r"seq_(\d+)_v(\d)")


CAMERA = "name string, " + ", ".join(f"{c} double" for c in ("x", "y", "z", "yaw", "pitch", "roll", "focal", "width", "height"))


def read_camera_csv(spark: SparkSession, path: str) -> DataFrame:
    """``view, frame`` and nine numbers of the image rows of a camera table; one of other than ten columns is an error."""
    if (width := len(spark.read.csv(path, header=True).columns)) != 10:
        raise ValueError(f"{path} has {width} columns, not 10")
    rows = spark.read.schema(CAMERA).option("mode", "FAILFAST").csv(path, header=True).filter(F.col("name").endswith(".png"))
    at = lambda k: F.regexp_extract("name", r"^view_(\d+)/(\d+)\.png$", k).cast("long")
    return rows.select(at(1).alias("view"), at(2).alias("frame"), "*").drop("name")


@query("""WITH r AS (SELECT vec_id % 3 AS view, vec_id // 3 AS frame FROM embeddings WHERE vec_id % 7 <> 6), a AS (SELECT count(DISTINCT frame) AS every FROM r)
SELECT view, count(*) AS rows, count(DISTINCT frame) = any_value(every) AS complete FROM r, a GROUP BY view""")
def src_csv_cameras(spark, sf_dir):
    """Image rows of each view, and whether it has every frame that any view has."""
    path, k = scratch(spark, "cameras"), F.col("id")
    name = F.format_string("view_%d/%06d.%s", k % 3, F.floor(k / 3), F.when(k % 7 == 6, "txt").otherwise("png"))
    numbers = [F.element_at("fvec", j + 1).alias(c.split()[0]) for j, c in enumerate(CAMERA.split(", ")[1:])]
    points(spark, sf_dir).select(name.alias("name"), *numbers).write.csv(path, header=True)
    rows = read_camera_csv(spark, path)
    every = rows.agg(F.count_distinct("frame").alias("every"))
    seen = rows.groupBy("view").agg(F.count("*").alias("rows"), F.count_distinct("frame").alias("frames"))
    return seen.crossJoin(F.broadcast(every)).select("view", "rows", (F.col("frames") == F.col("every")).alias("complete"))  # one number


def time_slice(rows: DataFrame, key: str, place: str, start: int, end: int, stride: int, head: int) -> DataFrame:
    """Places ``start + 1`` to ``end``, every ``stride``-th, the first ``head`` of them; then those that have a time."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(place)) - 1
    some = rows.withColumn("__k", k).filter((F.col("__k") > start) & (F.col("__k") < end) & ((F.col("__k") - start - 1) % stride == 0))
    return some.filter(F.col("__k") < start + 1 + head * stride).filter(F.col("t").isNotNull() & ~F.isnan("t")).drop("__k")


@query(f"WITH {TRACK_OBS} SELECT track, frame, round(x, 6) AS t FROM track_obs WHERE frame >= 5 AND frame < 60 AND (frame - 5) % 3 = 0 AND (frame - 5) // 3 < 12 AND vis")
def src_csv_time_slice(spark, sf_dir):
    path = scratch(spark, "times")
    track_obs(spark, sf_dir).select("track", "frame", F.when(F.col("vis"), F.col("x")).otherwise(F.lit(float("nan"))).alias("t")).write.csv(path, header=True)
    rows = spark.read.schema("track long, frame long, t double").csv(path, header=True)
    return time_slice(rows, "track", "frame", 4, 60, 3, 12).withColumn("t", r6("t"))


def append_losses(rows: DataFrame, path: str, k: int) -> None:
    """Appends one JSON object a step, with its ``k`` largest losses."""
    top = top_k(rows, "step", [F.col("loss").desc(), F.col("scene")], k)
    one = F.sort_array(F.collect_list(F.struct((-F.col("loss")).alias("less"), "scene", "loss")))
    top.groupBy("step").agg(F.transform(one, lambda s: F.struct(s["scene"].alias("scene"), s["loss"].alias("loss"))).alias("top_scenes")).write.mode("append").json(path)


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """``step, scene, loss`` of JSON lines with nested records."""
    rows = spark.read.schema("step long, top_scenes array<struct<scene: long, loss: double>>").json(path)
    return rows.select("step", F.explode("top_scenes").alias("s")).select("step", "s.scene", "s.loss")


TOP = f"{SCALARS}, n AS (SELECT step, ordinal AS scene, value AS loss, row_number() OVER (PARTITION BY step ORDER BY value DESC, ordinal) AS place FROM scalars), top AS (SELECT * FROM n WHERE place <= 4)"


def written_losses(spark, sf_dir) -> DataFrame:
    path, rows = scratch(spark, "losses"), scalars(spark, sf_dir).select("step", F.col("ordinal").alias("scene"), F.col("value").alias("loss"))
    for half in (0, 1):
        append_losses(rows.filter(F.col("step") % 2 == half), path, 4)
    return read_losses(spark, path)


@query(f"WITH {TOP} SELECT scene % 50 AS scene, count(*) AS hits, round(avg(loss), 6) AS loss FROM top GROUP BY 1")
def arr_explode_top_scenes(spark, sf_dir):
    """Nested loss records of JSON lines, one row each, by scene."""
    return written_losses(spark, sf_dir).groupBy((F.col("scene") % 50).alias("scene")).agg(F.count("*").alias("hits"), r6(F.avg("loss")).alias("loss"))


@query(f"WITH {TOP} SELECT step, scene, loss FROM top")
def sink_jsonl_append(spark, sf_dir):
    return written_losses(spark, sf_dir)


def array_files(rows: DataFrame, key: list[str], columns: list[str], name: str) -> DataFrame:
    """``name, content``: one ``.npy`` file of rows by columns for each key, whose rows are few."""

    def pack(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, group.sort_values("id")[columns].to_numpy(np.float32))
        return pd.DataFrame({"name": [name % keys], "content": [out.getvalue()]})

    return rows.groupBy(*key).applyInPandas(pack, "name string, content binary")


@query("SELECT label::BIGINT AS batch, count(*) AS rows, round(sum(embedding[1]::DOUBLE), 4) AS x, round(sum(embedding[3]::DOUBLE), 4) AS z FROM embeddings GROUP BY label")
def src_npy_arrays(spark, sf_dir):
    """Points as arrays of 256 rows at most, read with a checked width."""
    path = scratch(spark, "arrays")
    p = points(spark, sf_dir).select("id", "batch", F.floor(F.col("id") / 256).alias("part"), "x", "y", "z")
    write_files(array_files(p, ["batch", "part"], ["x", "y", "z"], "batch_%d/part_%06d.npy"), path)
    a = read_arrays(spark, f"{path}/*", (-1, 3)).withColumn("batch", F.regexp_extract("path", r"batch_(\d+)/", 1).cast("long"))
    at = lambda j: F.round(F.sum(F.when(F.col("j") == j, F.col("value"))), 4)
    return a.groupBy("batch").agg(F.count_if(F.col("j") == 0).alias("rows"), at(0).alias("x"), at(2).alias("z"))


SHARD_ROWS = 8


def shard_scenes(spark, sf_dir) -> DataFrame:
    """Scenes with their source and shard, a shard's in order in one task: ``packed`` takes them."""
    scenes = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("source"), F.col("c_custkey").alias("scene"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("segment"))
    placed = ranked(scenes, ["source"], [F.col("scene")], "n").withColumn("shard", F.floor(F.col("n") / SHARD_ROWS))
    return placed.repartition("source", "shard").sortWithinPartitions("source", "shard", "n")


def packed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
    """Names and contents of the TAR shards of sorted scenes, each with its inventory, a text of ``v1.2 N`` and N lines. A task holds one shard."""
    each = (r for batch in batches for r in batch.itertuples(index=False))
    for key, rows in groupby(each, lambda r: (r.source, r.shard)):
        out, lines = io.BytesIO(), []
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for r in rows:
                for name, data in ((f"scene_{r.scene}/meta.json", json.dumps({"title": r.title}).encode()), (f"scene_{r.scene}/view_0.txt", r.segment.encode())):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    at = out.tell() + 512
                    tar.addfile(info, io.BytesIO(data))
                    lines.append(f"{name.rpartition('.')[2]} {at} {len(data)} {name}")
        base = f"source_{key[0]}/shard_{key[1]:05d}"
        yield f"{base}.tar", out.getvalue()
        yield f"{base}.idx", "\n".join([f"v1.2 {len(lines)}", *lines]).encode()


def shard_files(spark, sf_dir) -> DataFrame:
    """``name, content`` of the shards and inventories, for those who want them as rows."""
    return shard_scenes(spark, sf_dir).mapInPandas(as_rows(packed), "name string, content binary")


def inventories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the inventories at ``path``, line by line; one that does not hold what it says ends with a row that is ``wrong``."""
    names = ["shard", "ext", "offset", "size", "name", "wrong"]
    out = []
    for batch in batches:
        for shard in batch["path"]:
            said, n, wrong = None, 0, False
            with opened(shard) as raw, io.TextIOWrapper(io.BufferedReader(raw), "utf-8", "replace") as lines:
                for line in lines:
                    w = line.rstrip("\n").split(" ")
                    try:
                        if len(w) == 4:
                            out.append((shard, w[0], int(w[1]), int(w[2]), w[3], False))
                            n += 1
                        elif len(w) == 2 and w[0] == "v1.2" and said is None:
                            said = int(w[1])
                        else:
                            wrong = True
                    except ValueError:
                        wrong = True
                    if len(out) >= LISTED:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if wrong or said != n:
                out.append((shard, "", 0, 0, "", True))
    yield pd.DataFrame(out, columns=names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``shard, ext, offset, size, name`` of shard inventories; a count other than the header's is an error, and so is an empty inventory.

    Tasks read many small inventories one after the other, each once, and check them as they read; what they find is written, so that no later look opens them again.
    """
    found, files = scratch(spark, "inventories"), dealt(listed(spark, path, "*.idx").select("path", "length"))
    schema = "shard string, ext string, offset long, size long, name string, wrong boolean"
    files.mapInPandas(inventories, schema).write.parquet(found)
    rows = spark.read.schema(schema).parquet(found)
    if bad := rows.filter("wrong").select("shard").limit(3).collect():
        raise ValueError(f"inventories that do not hold what they say: {[r['shard'] for r in bad]}")
    return rows.drop("wrong")


def shard_name(path: str, kind: str) -> Column:
    """A shard's folder and name without its kind; a search of the whole path would try each of its letters."""
    return F.regexp_extract(F.substring_index(path, "/", -2), rf"^(.+)\.{kind}$", 1)


@query("""WITH n AS (SELECT c_nationkey AS source, c_custkey AS scene, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 8 AS shard, c_name, c_mktsegment FROM customer),
m AS (SELECT *, 'json' AS ext, 'meta.json' AS base, length(c_name) + 13 AS size FROM n UNION ALL SELECT *, 'txt', 'view_0.txt', length(c_mktsegment) FROM n)
SELECT format('source_{}/shard_{:05d}', source, shard) AS shard, ext, 'scene_' || scene || '/' || base AS name, size::BIGINT AS size FROM m""")
def src_shard_index(spark, sf_dir):
    path = scratch(spark, "shards")
    write_files(shard_scenes(spark, sf_dir), path, packed)
    return read_index(spark, path).select(shard_name("shard", "idx").alias("shard"), "ext", "name", "size")


@query("""WITH n AS (SELECT c_nationkey AS source, c_custkey AS scene, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, c_name, c_mktsegment FROM customer)
SELECT format('source_{}/shard_{:05d}', source, k // 8) AS shard, scene, c_name AS title, c_mktsegment AS segment FROM n""")
def sink_tar_shards(spark, sf_dir):
    """Scenes written as TAR shards and streamed back from the shards that have an inventory."""
    path = scratch(spark, "shards")
    write_files(shard_scenes(spark, sf_dir), path, packed)
    whole = listed(spark, path, "*.idx").select(shard_name("path", "idx").alias("shard"))
    members = read_tars(spark, path).withColumn("shard", shard_name("shard", "tar")).join(whole, "shard", "left_semi")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("content").cast("string")))
    rows = members.groupBy("shard", "scene").agg(F.get_json_object(of("json"), "$.title").alias("title"), of("txt").alias("segment"))
    return rows.withColumn("scene", F.expr("substring(scene, 7)").cast("long"))


@query("""WITH n AS (SELECT c_nationkey::BIGINT AS source, c_custkey AS scene, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer)
SELECT source, k // 8 AS shard, scene, row_number() OVER (ORDER BY source, k // 8, scene) - 1 AS sample FROM n""")
def sink_catalog(spark, sf_dir):
    """A catalogue of shards, published once: each shard's scenes with their running sample index as a map, read back as rows."""
    path = scratch(spark, "catalog")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("source"), F.col("c_custkey").alias("scene"))
    placed = ranked(ranked(rows, ["source"], [F.col("scene")], "n"), [], [F.col("source"), F.col("n")], "sample")
    shards = placed.groupBy("source", F.floor(F.col("n") / SHARD_ROWS).alias("shard")).agg(F.map_from_entries(F.collect_list(F.struct("scene", "sample"))).alias("scenes"))
    for _ in range(2):  # the second finds the first's
        publish(shards, path)
    return spark.read.parquet(path).select("source", F.col("shard").cast("long").alias("shard"), F.explode("scenes").alias("scene", "sample"))


@query("SELECT n_regionkey::BIGINT AS region, count(*) AS nations, CASE WHEN n_regionkey < 2 THEN 1 ELSE 2 END::BIGINT AS run FROM nation GROUP BY n_regionkey")
def sink_staged_publish(spark, sf_dir):
    """Each region's result is published once, manifest last; a second run does only what has no manifest yet."""
    path, done = scratch(spark, "staged"), None
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("region"), "n_name")
    for run, some in ((1, n.filter("region < 2")), (2, n)):  # the first run gets as far as two regions
        todo = some if done is None else some.join(done, "region", "left_anti")
        publish(todo.groupBy("region").agg(F.count("*").alias("nations")), f"{path}/run={run}")
        done = spark.read.parquet(path).select("region")
    return spark.read.parquet(path).select("region", "nations", F.col("run").cast("long").alias("run"))


@query("SELECT label::BIGINT AS scene, count(DISTINCT vec_id % 4) AS views, max(vec_id % 4) + 1 = count(DISTINCT vec_id % 4) AND min(vec_id % 4) = 0 AS contiguous FROM embeddings GROUP BY label")
def src_directories(spark, sf_dir):
    """Folders of views found by listing; a scene is whole if they run from 0 without a gap."""
    path = scratch(spark, "folders")
    views = points(spark, sf_dir).select("batch", (F.col("id") % 4).alias("view")).distinct()
    write_files(views.select(F.format_string("scene_%d/view_%d/meta.json", "batch", "view").alias("name"), F.lit(b"{}").alias("content")), path)
    at = lambda k: F.regexp_extract("path", r"scene_(\d+)/view_(\d+)/", k).cast("long")
    found = listed(spark, path).select(at(1).alias("scene"), at(2).alias("view")).distinct()
    n = F.count("*")
    return found.groupBy("scene").agg(n.alias("views"), ((F.max("view") - F.min("view") + 1 == n) & (F.min("view") == 0)).alias("contiguous"))


def changed(spark: SparkSession, path: str, seen: DataFrame | None) -> DataFrame:
    """Files that are new or have another size or time than when they were ``seen``."""
    now = listed(spark, path, "*.json")
    return now if seen is None else now.join(seen, ["path", "length", "modificationTime"], "left_anti")


def read_event_files(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.schema("tag string, step long, value double, ordinal long").json(files)


def last_by_step(rows: DataFrame) -> DataFrame:
    """The last finite value of each tag and step."""
    ok = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return rows.filter(ok).groupBy("tag", "step").agg(F.max_by("value", "ordinal").alias("value"))


@query(f"WITH {SCALARS} SELECT tag, step, arg_max(value, ordinal) AS value FROM scalars WHERE ordinal % 13 <> 0 GROUP BY tag, step")
def src_event_files(spark, sf_dir):
    """Event files scanned twice: the second scan reads the files that came between, and later values win."""
    path, seen, parts = scratch(spark, "events"), None, []
    rows = scalars(spark, sf_dir).withColumn("value", F.when(F.col("ordinal") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    for half in (0, 1):
        rows.filter((F.col("ordinal") > 10) == bool(half)).write.mode("append").json(path)
        new = changed(spark, path, seen).checkpoint()
        # A scan's files are listed on the driver, as Spark's own readers do.
        parts.append(read_event_files(spark, [r["path"] for r in new.select("path").collect()]))
        seen = new if seen is None else seen.union(new)
    return last_by_step(parts[0].union(parts[1]))


@query(f"WITH {METRICS}, w AS (SELECT dataset, sequence, max(value) FILTER (WHERE metric = 'F' AND method = 'original') AS F, max(value) FILTER (WHERE metric = 'O' AND method = 'original') AS O FROM metrics GROUP BY ALL) SELECT dataset, round(avg(F), 6) AS F, round(avg(O), 6) AS O FROM w GROUP BY dataset")
def sink_metrics_csv(spark, sf_dir):
    """Metrics by sequence as CSV, their averages as a second CSV of key and score, read back."""
    path = scratch(spark, "evaluation")
    wide = metrics(spark, sf_dir).filter("method = 'original'").groupBy("dataset", "sequence").pivot("metric", ["F", "O"]).agg(F.max("value"))
    wide.write.csv(f"{path}/metrics", header=True)
    each = spark.read.schema("dataset string, sequence long, F double, O double").csv(f"{path}/metrics", header=True)
    each.groupBy("dataset").agg(F.avg("F").alias("F"), F.avg("O").alias("O")).unpivot(["dataset"], ["F", "O"], "key", "score").write.csv(f"{path}/average", header=True)
    average = spark.read.schema("dataset string, key string, score double").csv(f"{path}/average", header=True)
    return average.groupBy("dataset").pivot("key", ["F", "O"]).agg(r6(F.max("score")))


@query(f"""WITH {METRICS} SELECT dataset, metric, sequence, round(max(value) FILTER (WHERE method = 'candidate') - max(value) FILTER (WHERE method = 'original'), 6) AS delta FROM metrics GROUP BY dataset, metric, sequence""")
def sink_deltas_csv(spark, sf_dir):
    path = scratch(spark, "deltas")
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("value")))
    metrics(spark, sf_dir).groupBy("dataset", "metric", "sequence").agg((of("candidate") - of("original")).alias("delta")).write.csv(path, header=True)
    return spark.read.schema("dataset string, metric string, sequence long, delta double").csv(path, header=True).withColumn("delta", r6("delta"))


def column_ending(df: DataFrame, suffix: str) -> Column:
    """The one column whose name ends in ``suffix``; none or several are an error."""
    found = [c for c in df.columns if c.endswith(suffix)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns end in {suffix!r}: {found}")
    return F.col(f"`{found[0]}`")


@query(f"WITH {METRICS} SELECT dataset, sequence, max(value) FILTER (WHERE metric = 'F') AS value FROM metrics WHERE method = 'candidate' GROUP BY dataset, sequence")
def prj_suffix_lookup(spark, sf_dir):
    wide = metrics(spark, sf_dir).filter("method = 'candidate'").groupBy("dataset", "sequence").pivot("metric", ["F", "O", "P"]).agg(F.max("value"))
    wide = wide.withColumnsRenamed({c: f"views/model__{c}__any" for c in "FOP"})
    return wide.select("dataset", "sequence", column_ending(wide, "/model__F__any").alias("value"))


@query("SELECT count(*) AS rows, sum(l_quantity)::BIGINT AS quantity, max(l_orderkey) AS last FROM lineitem")
def dq_observed_write(spark, sf_dir):
    """Counters that Spark keeps while it writes; no second pass."""
    from pyspark.sql import Observation

    seen = Observation()
    watched = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").observe(
        seen, F.count("*").alias("rows"), F.sum("l_quantity").cast("long").alias("quantity"), F.max("l_orderkey").alias("last")
    )
    watched.write.parquet(scratch(spark, "watched"))
    got = seen.get
    return spark.createDataFrame([(got["rows"], got["quantity"], got["last"])], "rows long, quantity long, last long")


@query("""WITH p AS (SELECT embedding[1]::DOUBLE * 10 AS u, embedding[2]::DOUBLE * 10 AS v, embedding[3]::DOUBLE AS value, exp(embedding[4]::DOUBLE) AS w FROM embeddings),
c AS (SELECT floor(u) + dx AS cx, floor(v) + dy AS cy, value, w * (CASE WHEN dx = 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END) * (CASE WHEN dy = 0 THEN 1 - (v - floor(v)) ELSE v - floor(v) END) AS w FROM p, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy))
SELECT cx::BIGINT AS cx, cy::BIGINT AS cy, round(sum(w * value) / sum(w), 6) AS value FROM c GROUP BY cx, cy HAVING sum(w) > 0.000001""")
def agg_soft_splat(spark, sf_dir):
    """Values scattered onto the four pixels around, weighed by nearness and importance, and normalised."""
    at = lambda k: F.element_at("fvec", k)
    p = points(spark, sf_dir).select((at(1) * 10).alias("u"), (at(2) * 10).alias("v"), at(3).alias("value"), F.exp(at(4)).alias("w"))
    share = lambda c, d: F.abs(F.lit(1 - d) - (F.col(c) - F.floor(c)))
    corners = [F.struct((F.floor("u") + dx).alias("cx"), (F.floor("v") + dy).alias("cy"), (F.col("w") * share("u", dx) * share("v", dy)).alias("w")) for dx in (0, 1) for dy in (0, 1)]
    c = p.select("value", F.explode(F.array(*corners)).alias("c")).select("value", "c.*")
    return c.groupBy("cx", "cy").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("value")).alias("s")).filter("w > 0.000001").select(
        F.col("cx").cast("long").alias("cx"), F.col("cy").cast("long").alias("cy"), r6(F.col("s") / F.col("w")).alias("value")
    )
