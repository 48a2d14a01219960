"""Text, number, bit, JSON and map functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query, r6
from ..sources.views import POINTS, SCALARS, TRACK_OBS, points, scalars, table, track_obs

LINE = "format('datapoint {} tracks={} loss={:.3f} {}', event_id, user_id, value, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'ok' END)"


def log_lines(events: DataFrame, *keep: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "FAILED").otherwise("ok")
    return events.select(*keep, F.format_string("datapoint %d tracks=%d loss=%.3f %s", "event_id", "user_id", "value", state).alias("line"))


def parsed(lines: DataFrame, *keep: str) -> DataFrame:
    """``sample, tracks, loss, failed`` of log lines; lines of another form are left out."""
    at = lambda k: F.regexp_extract("line", r"^datapoint (\d+) tracks=(\d+) loss=([0-9.]+) (\w+)$", k)
    ok = lines.filter(F.col("line").rlike(r"^datapoint \d+ tracks="))
    return ok.select(*keep, at(1).cast("long").alias("sample"), at(2).cast("long").alias("tracks"), at(3).cast("double").alias("loss"), (at(4) == "FAILED").alias("failed"))


@query("SELECT event_id AS sample, user_id AS tracks, CAST(format('{:.3f}', value) AS DOUBLE) AS loss, event_type = 'error' AS failed FROM events")
def str_log_fields(spark, sf_dir):
    return parsed(log_lines(table(spark, sf_dir, "events")))


@query("""WITH n AS (SELECT page_id, 'kubric-noise' || (page_id % 5) || 'cm-views0123-' || CASE WHEN page_id % 2 = 0 THEN 'training' ELSE 'single' END || CASE WHEN page_id % 11 = 0 THEN '-odd' ELSE '' END AS name FROM pages)
SELECT page_id, 'kubric' AS base, (page_id % 5)::BIGINT AS noise, '0123' AS views, page_id % 2 = 0 AS training, page_id % 2 = 1 AS single, page_id % 11 <> 0 AS valid FROM n""")
def str_name_grammar(spark, sf_dir):
    """A dataset's name: a base and optional suffixes in a fixed order; what is left over is an error."""
    end = F.when(F.col("page_id") % 2 == 0, "training").otherwise("single")
    name = F.concat(F.lit("kubric-noise"), F.col("page_id") % 5, F.lit("cm-views0123-"), end, F.when(F.col("page_id") % 11 == 0, "-odd").otherwise(""))
    return grammar(table(spark, sf_dir, "pages").select("page_id", name.alias("name")), "name").drop("name")


def grammar(df: DataFrame, name: str) -> DataFrame:
    """``base, noise, views, training, single, valid`` of a dataset's name."""
    form = r"^([a-z0-9]+)(?:-noise(\d+)cm)?(?:-views(\d+))?(-training)?(-single)?(.*)$"
    at = lambda k: F.regexp_extract(name, form, k)
    return df.select(
        *df.columns, at(1).alias("base"), F.nullif(at(2), F.lit("")).cast("long").alias("noise"), F.nullif(at(3), F.lit("")).alias("views"),
        (at(4) != "").alias("training"), (at(5) != "").alias("single"), (at(6) == "").alias("valid"),
    )


@query("SELECT page_id, CASE WHEN contains(url, '/de/') THEN 'panoptic' WHEN contains(url, '/fr/') THEN 'dexycb' WHEN contains(url, '.org') THEN 'kubric' ELSE 'default' END AS setting FROM pages")
def str_setting_dispatch(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(url.contains("/de/"), "panoptic").when(url.contains("/fr/"), "dexycb").when(url.contains(".org"), "kubric").otherwise("default").alias("setting"))


@query("SELECT page_id, string_split(url, '/')[-1] AS tail, regexp_replace(url, '^https?://', '') AS bare, regexp_extract(url, '^(.*)/[^/]*$', 1) AS head FROM pages")
def str_rsplit(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.split(url, "/"), -1).alias("tail"), F.regexp_replace(url, "^https?://", "").alias("bare"), F.regexp_extract(url, "^(.*)/[^/]*$", 1).alias("head"))


@query("SELECT c_custkey, 'scene_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS name FROM customer")
def str_zero_pad(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("scene_%06d", "c_custkey").alias("name"))


@query("SELECT c_nationkey::BIGINT AS source, sha256(string_agg(c_name || ':' || c_custkey, ';' ORDER BY c_name)) AS fingerprint FROM customer GROUP BY c_nationkey")
def str_fingerprint(spark, sf_dir):
    """Of a source's sorted records; records are short and one source's fit a row."""
    said = F.struct("c_name", F.concat_ws(":", "c_name", "c_custkey").alias("r"))
    joined = F.concat_ws(";", F.transform(F.sort_array(F.collect_list(said)), lambda s: s["r"]))
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("source")).agg(F.sha2(joined, 256).alias("fingerprint"))


@query("""SELECT o_orderkey, sha256('{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS hash FROM orders""")
def str_plan_hash(spark, sf_dir):
    plan = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(plan, 256).alias("hash"))


@query("SELECT p_brand AS method, '| ' || p_brand || ' | ' || format('{:.2f}', round_even(avg(p_size), 2)) || ' |' AS row FROM part GROUP BY p_brand")
def str_markdown_row(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("method")).agg(F.format_string("| %s | %.2f |", F.first("p_brand"), F.bround(F.avg("p_size"), 2)).alias("row"))


@query("""WITH s AS (SELECT n_nationkey::BIGINT AS ordinal, n_name AS dataset, range(n_nationkey % 3, 12, n_regionkey + 1) AS steps FROM nation) SELECT dataset, min(ordinal) AS ordinal FROM s WHERE list_contains(steps, 6) GROUP BY dataset""")
def str_schedule_lookup(spark, sf_dir):
    """Datasets that a step evaluates, in the order first seen."""
    steps = F.sequence(F.col("n_nationkey") % 3, F.lit(11), F.col("n_regionkey") + 1)
    return table(spark, sf_dir, "nation").filter(F.array_contains(steps, 6)).groupBy(F.col("n_name").alias("dataset")).agg(F.min(F.col("n_nationkey").cast("long")).alias("ordinal"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents), e AS (SELECT doc_id, w, unnest(range(len(w) // 4)) AS i FROM t)
SELECT doc_id, i AS entry, w[4 * i + 1] AS ext, w[4 * i + 2] AS off, w[4 * i + 4] AS name FROM e""")
def str_quartet_parse(spark, sf_dir):
    """A flat list of tokens as entries of four; what is left of a list is no entry."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    fours = F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 4).cast("int") - 1), lambda i: F.slice("w", 4 * i + 1, 4))
    t = t.filter(F.size("w") >= 4).select("doc_id", F.posexplode(fours).alias("entry", "e"))
    return t.select("doc_id", F.col("entry").cast("long").alias("entry"), F.col("e")[0].alias("ext"), F.col("e")[1].alias("off"), F.col("e")[3].alias("name"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def str_utc_iso(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("""SELECT o_orderkey, o_orderstatus AS status, round(o_totalprice, 2) AS price FROM orders""")
def json_roundtrip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))).alias("j"))
    back = F.from_json("j", "status string, price double")
    return o.select("o_orderkey", back["status"].alias("status"), F.round(back["price"], 2).alias("price"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.output.rgb.invalid'), '[]') AS invalid FROM events")
def json_path_default(spark, sf_dir):
    """A nested value or its default."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1).cast("long")).alias("k"), F.coalesce(F.get_json_object("props", "$.output.rgb.invalid"), F.lit("[]")).alias("invalid")
    )


@query("SELECT n_regionkey::BIGINT AS rig, count(*) AS views, CAST(max(n_nationkey) AS BIGINT) AS last, string_agg(n_name || '=' || n_nationkey, ',' ORDER BY n_name) AS entries FROM nation GROUP BY n_regionkey")
def map_nested_build(spark, sf_dir):
    """Views by name as a map of each scene, shown as its sorted entries."""
    entry = F.struct(F.col("n_name").alias("key"), F.col("n_nationkey").cast("long").alias("value"))
    built = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("rig")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    said = F.transform(F.sort_array(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return built.select("rig", F.size("m").cast("long").alias("views"), F.array_max(F.map_values("m")).alias("last"), F.concat_ws(",", said).alias("entries"))


@query(f"WITH {SCALARS} SELECT ordinal, CAST(floor(value / 8 + 0.5::DOUBLE) AS BIGINT) AS half_up, CAST(round_even(value / 8, 0) AS BIGINT) AS half_even, round_even(value, 1) AS shown FROM scalars")
def num_rounding_modes(spark, sf_dir):
    """Half up for pixels, half to even for reports."""
    v = F.col("value")
    return scalars(spark, sf_dir).select("ordinal", F.floor(v / 8 + 0.5).cast("long").alias("half_up"), F.bround(v / 8, 0).cast("long").alias("half_even"), F.bround(v, 1).alias("shown"))


@query(f"WITH {TRACK_OBS} SELECT track, frame, (track % 40) * 64 + frame % 64 AS flat, ((track % 40) * 64 + frame % 64) // 64 AS row, ((track % 40) * 64 + frame % 64) % 64 AS col FROM track_obs")
def num_sub2ind(spark, sf_dir):
    o = track_obs(spark, sf_dir).withColumn("flat", (F.col("track") % 40) * 64 + F.col("frame") % 64)
    return o.select("track", "frame", "flat", F.floor(F.col("flat") / 64).cast("long").alias("row"), (F.col("flat") % 64).alias("col"))


def spread(c: Column) -> Column:
    """The low 16 bits of a long with two empty bits between each, by masks."""
    for shift, mask in ((16, 0x0000FF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249)):
        c = (c.bitwiseOR(F.shiftleft(c, shift))).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column, z: Column) -> Column:
    """Bits of x, y, z interleaved: x at 3i + 2, y at 3i + 1, z at 3i; 16 bits each."""
    wide = lambda c: spread(c.cast("long").bitwiseAND(F.lit(0xFFFF)))
    return F.shiftleft(wide(x), 2).bitwiseOR(F.shiftleft(wide(y), 1)).bitwiseOR(wide(z))


def gathered(c: Column) -> Column:
    """The inverse of ``spread``."""
    c = c.bitwiseAND(F.lit(0x249249249249))
    for shift, mask in ((2, 0x0C30C30C30C3), (4, 0x00F00F00F00F), (8, 0x0000FF0000FF), (16, 0x00000000FFFF)):
        c = (c.bitwiseOR(F.shiftright(c, shift))).bitwiseAND(F.lit(mask))
    return c


def grid_codes(spark, sf_dir) -> DataFrame:
    g = lambda c: F.floor((F.col(c) + 1) * 32).cast("long")
    return points(spark, sf_dir).select("id", g("x").alias("gx"), g("y").alias("gy"), g("z").alias("gz")).withColumn("code", morton(F.col("gx"), F.col("gy"), F.col("gz")))


SQL_GRID = f"{POINTS}, g AS (SELECT id, CAST(floor((x + 1) * 32) AS BIGINT) AS gx, CAST(floor((y + 1) * 32) AS BIGINT) AS gy, CAST(floor((z + 1) * 32) AS BIGINT) AS gz FROM points), codes AS (SELECT *, CAST(list_sum(list_transform(range(0, 7), lambda i: ((gx >> i) & 1) * (1 << (3 * i + 2)) + ((gy >> i) & 1) * (1 << (3 * i + 1)) + ((gz >> i) & 1) * (1 << (3 * i)))) AS BIGINT) AS code FROM g)"


@query(f"WITH {SQL_GRID} SELECT id, code, gx AS x, gy AS y, gz AS z FROM codes")
def bit_morton(spark, sf_dir):
    """Encoded, and decoded again."""
    c = grid_codes(spark, sf_dir)
    return c.select("id", "code", gathered(F.shiftright("code", 2)).alias("x"), gathered(F.shiftright("code", 1)).alias("y"), gathered(F.col("code")).alias("z"))


@query(f"WITH {SQL_GRID} SELECT id, code, row_number() OVER (ORDER BY code, id) AS place FROM codes")
def sort_morton(spark, sf_dir):
    """Points along the space-filling curve, ranked by code prefix and then within it."""
    from ..operators.windows import global_index

    c = grid_codes(spark, sf_dir).withColumn("prefix", F.shiftright("code", 12)).withColumn("key", F.struct("code", "id"))
    return global_index(c, "prefix", "key", "n").select("id", "code", (F.col("n") + 1).cast("long").alias("place"))


__all__ = ["r6", "Column"]
