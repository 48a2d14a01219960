"""The engine's tables as views of the driver's, each with the SQL of the same view.

``track_obs``: one row a track and frame, true and predicted position and visibility.
``track_query``: the frame from which a track is followed, for tracks seen twice or more.
``points``: positions with feature vectors. ``residual``: signed residuals by layout, mode
and view. ``scalars``: a tag's values by step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(salt: str, key: Column | str) -> Column:
    """A number in [0, 1) that a key and a salt settle, the same on every engine."""
    said = F.concat(F.lit(f"{salt}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long") % 10000 / F.lit(10000.0).cast("double")


def hashed_sql(salt: str, key: str) -> str:
    return f"((('0x' || substr(md5('{salt}:' || {key}), 1, 8))::BIGINT % 10000) / CAST(10000 AS DOUBLE))"


def track_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_track = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"),
        (F.col("user_id") % 4).alias("scene"),
        (F.row_number().over(in_track) - 1).cast("long").alias("frame"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        (F.col("event_type") != "error").alias("vis"),
        (F.col("value") + (hashed("px", "event_id") - 0.5) * 60).alias("px"),
        (F.get_json_object("props", "$.k").cast("double") + (hashed("py", "event_id") - 0.5) * 60).alias("py"),
        (hashed("pv", "event_id") < 0.8).alias("pvis"),
        (F.col("event_id") % 3).alias("view"),
        "event_id",
    )


TRACK_OBS = f"""track_obs AS (
    SELECT user_id AS track, user_id % 4 AS scene,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
           value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type <> 'error' AS vis,
           value + ({hashed_sql("px", "event_id")} - 0.5::DOUBLE) * 60 AS px,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) + ({hashed_sql("py", "event_id")} - 0.5::DOUBLE) * 60 AS py,
           {hashed_sql("pv", "event_id")} < 0.8::DOUBLE AS pvis, event_id % 3 AS view, event_id
    FROM events)"""


def track_query(obs: DataFrame) -> DataFrame:
    return (
        obs.groupBy("track")
        .agg(F.min(F.when(F.col("vis"), F.col("frame"))).alias("qt"), (F.max("frame") + 1).alias("nf"), F.count_if("vis").alias("seen"))
        .filter("seen >= 2")
        .drop("seen")
    )


TRACK_QUERY = """track_query AS (
    SELECT track, min(frame) FILTER (WHERE vis) AS qt, max(frame) + 1 AS nf
    FROM track_obs GROUP BY track HAVING count(*) FILTER (WHERE vis) >= 2)"""


def followed(obs: DataFrame) -> DataFrame:
    """Observations of followed tracks, with ``qt``, ``nf`` and the distance ``d`` of the prediction."""
    d = F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2)
    return obs.join(track_query(obs), "track").withColumn("d", d)


FOLLOWED = f"""{TRACK_OBS}, {TRACK_QUERY}, followed AS (
    SELECT o.*, qt, nf, sqrt((px - x) ** 2 + (py - y) ** 2) AS d FROM track_obs o JOIN track_query USING (track))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("batch"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"),
        F.transform("embedding", lambda v: v.cast("double")).alias("fvec"),
    )


POINTS = """points AS (
    SELECT vec_id AS id, CAST(label AS BIGINT) AS batch, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
           CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding AS DOUBLE[]) AS fvec
    FROM embeddings)"""


def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
        .join(part, "l_partkey")
        .select(
            F.col("l_returnflag").alias("layout"), F.col("l_linestatus").alias("mode"), F.col("l_linenumber").cast("long").alias("view"),
            (F.col("l_extendedprice") / F.col("l_quantity") - F.col("p_retailprice")).alias("r"), F.col("l_orderkey").alias("ordinal"),
        )
    )


RESIDUAL = """residual AS (
    SELECT l_returnflag AS layout, l_linestatus AS mode, CAST(l_linenumber AS BIGINT) AS view,
           l_extendedprice / l_quantity - p_retailprice AS r, l_orderkey AS ordinal
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tag"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("step"), "value", F.col("event_id").alias("ordinal")
    )


SCALARS = """scalars AS (
    SELECT event_type AS tag, date_diff('day', TIMESTAMP '2024-01-01', ts) AS step, value, event_id AS ordinal FROM events)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long metric table: ``dataset, method, sequence, metric, value``, of two methods."""
    o = table(spark, sf_dir, "orders")
    base = o.groupBy(F.col("o_orderpriority").alias("dataset"), (F.col("o_custkey") % 20).alias("sequence"), F.col("o_orderstatus").alias("metric")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count("*").alias("n")
    )
    # Whole numbers until the last step: four decimals without ties to round.
    base = base.select("dataset", "sequence", "metric", (F.floor(F.col("cents") / F.col("n") / 10) / 10000.0).alias("value"))
    moved = F.round(F.col("value") + hashed("cand", F.concat_ws("-", "dataset", "sequence", "metric")) - 0.4, 4)
    one = base.withColumn("method", F.lit("original"))
    return one.unionByName(base.withColumn("value", moved).withColumn("method", F.lit("candidate"))).select("dataset", "method", "sequence", "metric", "value")


METRICS = f"""base_metric AS (
    SELECT o_orderpriority AS dataset, o_custkey % 20 AS sequence, o_orderstatus AS metric, floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 10) / CAST(10000 AS DOUBLE) AS value
    FROM orders GROUP BY ALL
), metrics AS (
    SELECT dataset, 'original' AS method, sequence, metric, value FROM base_metric
    UNION ALL
    SELECT dataset, 'candidate', sequence, metric, round(value + {hashed_sql("cand", "concat_ws('-', dataset, sequence, metric)")} - 0.4::DOUBLE, 4) FROM base_metric)"""
