"""Hand-computed cases, properties and odd inputs of the operators."""

import io
import json
import math
import tarfile

import numpy as np
import pandas as pd
import pytest
from orrery.functions import scalars, udfs
from orrery.operators import aggregates, components, joins, ordering, quantiles, windows
from orrery.plans import schedules, track_metrics
from orrery.sources import checkpoints, files, formats, plugins, ranges
from orrery.streaming import live
from pyspark.sql import functions as F


def frames(spark, n, bad):
    return spark.createDataFrame([(1, k, k in bad) for k in range(n)], "track long, frame long, bad boolean")


@pytest.mark.parametrize(("n", "bad", "starts"), [(50, {25}, [0, 1, 26]), (50, {23, 24}, [25, 26]), (30, {0, 29}, [1, 2, 3, 4, 5]), (23, set(), []), (24, set(), [0])])
def test_legal_starts(spark, n, bad, starts):
    assert sorted(r.start for r in windows.legal_starts(frames(spark, n, bad), 24).collect()) == starts


def test_path_lengths(spark):
    rows = [(1, 0, k, x, 0.0, True, 0) for k, x in enumerate((0.0, 0.1, 0.3, 0.6))] + [(2, 0, k, float(k), 0.0, k != 2, 0) for k in range(4)]
    df = spark.createDataFrame(rows, "track long, scene long, frame long, x double, y double, vis boolean, qt long")
    adjacent = {r.track: r.path for r in track_metrics.path_adjacent(df, "vis").collect()}
    assert adjacent[1] == pytest.approx(0.6) and adjacent[2] == pytest.approx(1.0)
    across = {r.track: r.path for r in track_metrics.path_visible(df).collect()}
    assert across[2] == pytest.approx(3.0)


def test_rolling_rate(spark):
    df = spark.createDataFrame([(1, k, bool(f)) for k, f in enumerate((1, 0, 1, 0))], "track long, frame long, flag boolean")
    got = windows.rolling_rate(df, "track", ["frame"], F.col("flag"), 3).orderBy("frame").collect()
    assert [r.rate for r in got] == pytest.approx([1, 1 / 2, 2 / 3, 1 / 3])


@pytest.mark.parametrize(("lo", "hi", "said"), [(-0.2, 0.8, "non-regressed"), (0.8, 1.2, "inconclusive"), (1.1, 1.4, "regressed")])
def test_verdict(spark, lo, hi, said):
    assert spark.range(1).select(aggregates.verdict(F.lit(lo), F.lit(hi), 1.0).alias("v")).first().v == said


def test_cosine_of_relations(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([0.0, 0.0], [1.0, 0.0], None)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>, want long").select("want", joins.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(r.c == r.want for r in got)


def test_spearman_with_ties_is_pandas(spark):
    r = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": r.integers(0, 3, 300), "a": r.integers(0, 9, 300).astype(float), "b": r.normal(size=300)})
    pdf.loc[5, "a"] = np.nan
    got = {x.g: x.rho for x in aggregates.spearman(spark.createDataFrame(pdf), "g", "a", "b").collect()}
    for g, part in pdf.dropna().groupby("g"):
        assert got[g] == pytest.approx(part["a"].rank().corr(part["b"].rank()))


def test_nearest_rank(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(10)] + [(2, 5.0)], "k long, v double")
    assert {(r.k, r.v) for r in aggregates.nearest_rank(df, "k", "v", 0.9).collect()} == {(1, 8.0), (2, 5.0)}


def test_nearest_matches_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(int(k), int(k % 3), *map(float, r.integers(0, 4, 3))) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, batch long, x double, y double, z double")
    got = sorted((x.id, x.place, x.ref) for x in joins.nearest(df, df, 5).collect())
    want = []
    for q in rows:
        best = sorted((np.linalg.norm(np.subtract(q[2:], p[2:])), p[0]) for p in rows if p[1] == q[1])[:5]
        want += [(q[0], n + 1, ref) for n, (_, ref) in enumerate(best)]
    assert got == sorted(want)


def test_components_are_transitive(spark):
    checkpoints.ready(spark)
    df = spark.createDataFrame([(k, 0.009 * k, 0.0, 0.0) for k in range(6)] + [(9, 5.0, 5.0, 5.0)], "id long, x double, y double, z double")
    assert {(r.id, r.component) for r in joins.eps_components(df, 0.01).collect()} == {(k, 0) for k in range(6)} | {(9, 9)}


def test_every_cycle_is_a_permutation(spark):
    rows = spark.createDataFrame([(s, k) for s in "ab" for k in range(7)], "source string, scene long")
    got = schedules.balanced_cycles(rows, "source", "scene", 3, 1).toPandas()
    for _, part in got.groupby(["source", "cycle"]):
        assert sorted(part["scene"]) == list(range(7)) == sorted(part["offset"])
    assert got.groupby("cycle")["scene"].apply(tuple).nunique() == 3


def test_greedy_ranks_balance():
    group = pd.DataFrame({"source": 1, "shard": range(9), "bytes": [9, 8, 7, 6, 5, 4, 3, 2, 1]})
    got = schedules.greedy(3)(group)
    loads = group.sort_values(["bytes"], ascending=False)["bytes"].groupby(got["rank"].to_numpy()).sum()
    assert loads.max() - loads.min() <= 2 and len(got) == 9


def test_stratified_shrinks_to_the_scarcest(spark):
    rows = spark.createDataFrame([("a", k) for k in range(50)] + [("b", 100 + k) for k in range(4)], "bucket string, id long")
    got = schedules.stratified(rows, "bucket", "id", {"a": 0.5, "b": 0.5}, 40, "s").groupBy("bucket").count().collect()
    assert {(r["bucket"], r["count"]) for r in got} == {("a", 4), ("b", 4)}


def test_morton_round_trip(spark):
    df = spark.createDataFrame([(1, 0, 0), (0, 1, 0), (0, 0, 1), (65535, 65535, 65535), (12345, 54321, 777)], "x long, y long, z long")
    code = scalars.morton(F.col("x"), F.col("y"), F.col("z"))
    got = df.withColumn("c", code).select("*", scalars.gathered(F.shiftright("c", 2)).alias("a"), scalars.gathered(F.shiftright("c", 1)).alias("b"), scalars.gathered(F.col("c")).alias("d")).collect()
    assert [r.c for r in got[:3]] == [4, 2, 1] and all((r.x, r.y, r.z) == (r.a, r.b, r.d) for r in got)


def test_hilbert_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    codes = udfs.hilbert_codes(grid, 3)
    assert sorted(codes) == list(range(512))
    path = grid[np.argsort(codes)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_similarity_fit_of_noise_free_points(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=(40, 3))
    q, _ = np.linalg.qr(r.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    b = 1.7 * a @ q.T + [1, 2, 3]
    df = spark.createDataFrame([(1, *map(float, p), *map(float, s)) for p, s in zip(a, b, strict=True)], "batch long, ax double, ay double, az double, bx double, by double, bz double")
    got = udfs.similarity_fit(df).first()
    assert got.scale == pytest.approx(1.7) and np.allclose(np.array(got.rotation).reshape(3, 3), q) and np.allclose(got.shift, [1, 2, 3])


def test_log_lines_of_other_forms_are_left_out(spark):
    df = spark.createDataFrame([("datapoint 3 tracks=9 loss=0.250 FAILED",), ("other",), (None,), ("datapoint x",)], "line string")
    assert [tuple(r) for r in scalars.parsed(df).collect()] == [(3, 9, 0.25, True)]


def test_dataset_names(spark):
    df = spark.createDataFrame([("kubric",), ("dex-views01-single",), ("kubric-noise3cm-training-what",), ("kubric-single-training",)], "name string")
    got = [(r.base, r.noise, r.views, r.training, r.single, r.valid) for r in scalars.grammar(df, "name").collect()]
    assert got == [("kubric", None, None, False, False, True), ("dex", None, "01", False, True, True), ("kubric", 3, None, True, False, False), ("kubric", None, None, False, True, False)]


def test_csv_index_must_be_unique(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n1,3\n")
    (tmp_path / "b.csv").write_text("id,v\n")
    for name in ("a.csv", "b.csv"):
        with pytest.raises(ValueError):
            files.read_indexed_csv(spark, str(tmp_path / name), "id long, v long", "id")


def test_manifest_version_is_checked(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 2, "scenes": {"a": {"n_frames": 3, "bad": [1]}}}))
    assert [tuple(r) for r in files.read_manifest(spark, str(tmp_path / "m.json"), 2).collect()] == [("a", 3, [1])]
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "m.json"), 3)


def test_arrays_are_read_and_checked(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    got = files.read_arrays(spark, str(tmp_path), (-1, 3)).orderBy("i", "j").collect()
    assert [(r.i, r.j, r.value) for r in got] == [(i, j, 3.0 * i + j) for i in range(2) for j in range(3)]
    with pytest.raises(Exception, match="shape"):
        files.read_arrays(spark, str(tmp_path), (-1, 4)).collect()


def test_publish_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "out")
    assert files.publish(spark.range(3), path) and not files.publish(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


def test_top_k_breaks_ties_by_the_next_key(spark):
    df = spark.createDataFrame([("a", 1.0, k) for k in (3, 1, 2)], "g string, v double, id long")
    assert [r.id for r in ordering.top_k(df, "g", [F.col("v").desc(), "id"], 2).orderBy("place").collect()] == [1, 2]


def test_global_index_runs_over_keys(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("c", 0)], "k string, o long")
    got = {(r.k, r.o): r.n for r in windows.global_index(df, "k", "o", "n").collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, ("b", 1): 2, ("c", 0): 3}


def test_tar_members_are_rows(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        for name, data in (("s1/meta.json", b"{}"), ("s1/view0.jpg", b"abc"), ("s2/meta.json", b"{ }")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    got = files.read_tars(spark, str(tmp_path), batch_bytes=3).orderBy("position").collect()
    assert [(r.position, r.scene, r.kind, r.bytes, bytes(r.content)) for r in got] == [(0, "s1", "json", 2, b"{}"), (1, "s1", "jpg", 3, b"abc"), (2, "s2", "json", 3, b"{ }")]


@pytest.mark.parametrize("keys", [["g"], []])
def test_exact_quantiles_are_numpys(spark, keys):
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": r.integers(0, 3, 500), "v": np.where(r.random(500) < 0.4, 7.0, r.normal(size=500).round(2))})
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([(0, None), (9, 1.5)], "g long, v double"))
    levels = [0.0, 0.12, 0.5, 0.9, 1.0]
    got = {(x[keys[0]] if keys else 0, x.level): x.quantile for x in quantiles.exact_quantiles(df, keys, "v", levels).collect()}
    groups = {int(g): p["v"] for g, p in pdf.groupby("g")} | {9: pd.Series([1.5])} if keys else {0: pd.concat([pdf["v"], pd.Series([1.5])])}
    assert got == {(g, p): pytest.approx(np.quantile(v, p)) for g, v in groups.items() for p in levels}


def test_nearest_compares_few_of_all_pairs(spark):
    r = np.random.default_rng(11)
    p = spark.createDataFrame([(k, 0, *map(float, x)) for k, x in enumerate(r.random((3000, 3)))], "id long, batch long, x double, y double, z double")
    compared = []
    assert joins.nearest(p, p, 4, compared=compared).count() == 12_000
    assert 12_000 < sum(compared) < 0.1 * 3000 * 3000


@pytest.mark.parametrize("batches", [1, 3])
def test_nearest_of_clustered_points_and_far_queries(spark, batches):
    r = np.random.default_rng(5)
    clustered = np.concatenate([r.normal(0, 0.01, (60, 3)), r.normal(50, 5, (40, 3))])
    rows = [(k, k % batches, *map(float, p)) for k, p in enumerate(clustered)]
    far = [(1000 + k, k % (batches + 1), *map(float, p)) for k, p in enumerate(r.normal(-300, 90, (12, 3)))]
    schema = "id long, batch long, x double, y double, z double"
    got = sorted((x.id, x.place, x.ref) for x in joins.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(rows + far, schema), 4).collect())
    want = []
    for q in rows + far:
        best = sorted((round(float(np.sqrt(((np.array(q[2:]) - p[2:]) ** 2).sum())), 9), p[0]) for p in rows if p[1] == q[1])[:4]
        want += [(q[0], n + 1, ref) for n, (_, ref) in enumerate(best)]
    assert got == sorted(want)


def test_components_of_a_hub_and_of_struct_vertices(spark):
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 2000)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {k: 0 for k in [*range(400), 2000]} | {k: 1000 for k in range(1000, 1041)}
    assert {r.id: r.component for r in components.components(df).collect()} == want
    both = df.select(*[F.struct(F.col(c).alias("id"), F.lit(1).alias("n")).alias(c) for c in "uv"])
    assert {r.id[0]: r.component[0] for r in components.components(both).collect()} == want


def test_ranks_and_lookups_of_a_hot_key(spark):
    rows = [("hot", k // 3) for k in range(300)] + [(None, 5), (None, 1), ("b", 2)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = quantiles.ranked(df.withColumn("id", F.monotonically_increasing_id()), ["k"], [F.col("v"), F.col("id")], "n").collect()
    for key in ("hot", None, "b"):
        mine = sorted((r.n, r.v) for r in got if r.k == key)
        assert [n for n, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for k, v in rows if k == key)
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    upto = {(r.k, r.v): r.upto for r in quantiles.running_counts(counts, ["k"], "v", "upto").collect()}
    assert upto["hot", 99] == 300 and upto["hot", 0] == 3 and upto[None, 1] == 1 and upto[None, 5] == 2
    table = spark.createDataFrame([("hot", 7), ("b", 8), ("c", 9)], "k string, w long")
    assert sorted((r.k, r.w) for r in quantiles.looked_up(df, table, ["k"]).select("k", "w").distinct().collect()) == [("b", 8), ("hot", 7)]
    assert quantiles.looked_up(df, table, ["k"]).count() == 301


def test_summaries_meet_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, None)], "k string, v double")
    got = {r.k: (r.n, r.m) for r in quantiles.summarised(df, ["k"], [F.count("v").alias("n")], {"m": (F.col("v"), 0.5)}).collect()}
    assert got == {"a": (2, 2.0), None: (1, 5.0)}


def test_summaries_at_grains_are_numpys(spark):
    r = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": r.integers(0, 3, 900), "b": r.choice(["x", "y", None], 900), "v": np.where(r.random(900) < 0.3, -7.0, r.normal(size=900) * 10.0 ** r.integers(-3, 4, 900))})
    pdf.loc[::50, "v"] = 0.0
    df = spark.createDataFrame(list(pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)), "a long, b string, v double")
    df = df.union(spark.createDataFrame([(0, "x", None), (9, None, None), (8, "z", 1e300), (8, "z", float("inf")), (8, "z", float("inf"))], df.schema))
    levels = {"least": 0.0, "low": 0.12, "middle": 0.5, "high": 0.93, "most": 1.0}
    wanted = {n: (F.col("v"), p) for n, p in levels.items()} | {"size": (F.abs("v"), 0.5)}
    rows = [(x.a, x.b, x.v) for x in df.collect()]
    for shared in (quantiles.FEW, 0):  # with the buckets told to all tasks, and met by key
        old, quantiles.FEW = quantiles.FEW, shared
        try:
            got = quantiles.grain_summary(df, [("a", "b"), ("b",), ()], ["a", "b"], [F.count("v").alias("n")], wanted).collect()
        finally:
            quantiles.FEW = old
        seen = {(g.grain, g.a, g.b) for g in got}
        assert len(got) == len(seen) and seen == {k for a, b, _ in rows for k in ((0, a, b), (2, None, b), (3, None, None))}
        for g in got:
            v = [v for a, b, v in rows if v is not None and (g.grain == 3 or b == g.b) and (g.grain > 0 or a == g.a)]
            assert g.n == len(v) and (v or g.middle is None)
            for n, p in levels.items() if v else ():
                assert g[n] == pytest.approx(np.quantile(v, p)) or np.isinf(v).any()
            assert not v or np.isinf(v).any() or g["size"] == pytest.approx(np.median(np.abs(v)))
            if g.a == 8:
                assert (g.least, g.middle, g.most) == (1e300, math.inf, math.inf)


def test_discrete_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    got = {r.level: r.quantile for r in quantiles.exact_quantiles(df, [], "v", [0.0, 0.25, 0.5, 0.51, 1.0], discrete=True).collect()}
    assert got == {0.0: 1.0, 0.25: 1.0, 0.5: 2.0, 0.51: 3.0, 1.0: 4.0}


def test_kmeans_is_lloyds(spark):
    r = np.random.default_rng(3)
    p = r.normal(size=(200, 3)).round(4)
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(p)], "id long, x double, y double, z double")
    centres = p[:5]
    for _ in range(3):
        of = ((p[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([p[of == k].mean(0) for k in range(5)])
    got = sorted(udfs.kmeans(df, ("x", "y", "z"), 5, 3).collect(), key=lambda g: g.cluster)
    assert [g.points for g in got] == np.bincount(of).tolist() and np.allclose([[g.x, g.y, g.z] for g in got], centres)


def test_ransac_leaves_outliers_out(spark):
    r = np.random.default_rng(6)
    rows = []
    for batch in (0, 1):
        a = r.normal(size=(50, 3))
        b = a[:, [1, 0, 2]] * [1, -1, 1] + batch
        b[:15] += r.normal(5, 20, (15, 3))
        rows += [(100 * batch + k, batch, *map(float, x), *map(float, y)) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "id long, batch long, ax double, ay double, az double, bx double, by double, bz double")
    got = {g.batch: g for g in udfs.ransac(df, 30, 1e-6).collect()}
    for batch, g in got.items():
        assert g.inliers == 35 and g.scale == pytest.approx(1) and np.allclose(np.array(g.rotation).reshape(3, 3), [[0, 1, 0], [-1, 0, 0], [0, 0, 1]]) and np.allclose(g.shift, batch)
    assert len(got) == 2


def test_camera_tables_of_another_width_are_refused(spark, tmp_path):
    (tmp_path / "nine.csv").write_text("name,x,y,z,yaw,pitch,roll,focal,width\nview_0/000000.png,1,2,3,4,5,6,7,8\n")
    with pytest.raises(ValueError, match="9 columns"):
        formats.read_camera_csv(spark, str(tmp_path / "nine.csv"))
    (tmp_path / "ten.csv").write_text("name,x,y,z,yaw,pitch,roll,focal,width,height\nview_1/000004.png,1,2,3,4,5,6,7,8,9\nnotes.txt,1,2,3,4,5,6,7,8,9\n")
    assert [(r.view, r.frame, r.height) for r in formats.read_camera_csv(spark, str(tmp_path / "ten.csv")).collect()] == [(1, 4, 9.0)]


def test_inventories_must_hold_what_they_say(spark, tmp_path):
    (tmp_path / "a.idx").write_text("v1.2 2\njson 512 3 s/meta.json\ntxt 1536 4 s/v.txt")
    assert [(r.ext, r.offset, r.size, r.name) for r in formats.read_index(spark, str(tmp_path)).orderBy("offset").collect()] == [("json", 512, 3, "s/meta.json"), ("txt", 1536, 4, "s/v.txt")]
    for text in ("v1.2 3\njson 512 3 s/meta.json", "v9 1\njson 512 3 s/meta.json", "v1.2 1\njson 512 3 s/meta.json extra"):
        (tmp_path / "a.idx").write_text(text)
        with pytest.raises(ValueError, match="inventories"):
            formats.read_index(spark, str(tmp_path))


def test_inventories_are_read_once_and_many_to_a_task(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"source_{k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"source_{k % 3}" / f"shard_{k:05d}.idx").write_text(f"v1.2 1\njson 512 {k} s_{k}/meta.json")
    rows = formats.read_index(spark, str(tmp_path))
    for f in tmp_path.rglob("*.idx"):
        f.unlink()  # what was found is written: no later look opens them
    assert rows.rdd.getNumPartitions() <= 8
    assert sorted((r.shard[-24:], r.size) for r in rows.collect()) == sorted((f"source_{k % 3}/shard_{k:05d}.idx", k) for k in range(300))


@pytest.mark.parametrize("text", ["", "v1.2 x\njson 512 3 s/meta.json", "v1.2 1\njson at 3 s/meta.json", "v1.2 1\nv1.2 1\njson 512 3 s/meta.json"])
def test_inventories_without_a_count_or_a_place_are_refused(spark, tmp_path, text):
    (tmp_path / "a.idx").write_text(text)
    with pytest.raises(ValueError, match="inventories"):
        formats.read_index(spark, str(tmp_path))


def test_byte_stores_with_gaps_are_not_complete(spark, tmp_path):
    rows = spark.createDataFrame([(s, k, bytearray([65 + k] * (k + 1))) for s in "pq" for k in range(4)], "store string, frame long, data binary")
    offsets = ranges.byte_store(rows, str(tmp_path), frames=3)
    assert sorted(f"{f.parent.name}/{f.name}" for f in tmp_path.rglob("*.bin")) == [f"{s}/00000{k}.bin" for s in "pq" for k in (0, 1)]
    found = ranges.store_ranges(spark, offsets, str(tmp_path))
    assert sorted((r.store, bytes(r.data)) for r in ranges.read_ranges(found).collect()) == [(s, bytes([65 + k] * (k + 1))) for s in "pq" for k in range(4)]
    (tmp_path / "q/000001.bin").write_bytes(b"short")
    assert {r.store for r in ranges.store_ranges(spark, offsets, str(tmp_path)).collect()} == {"p"}
    assert ranges.store_ranges(spark, offsets.filter("frame != 1"), str(tmp_path)).count() == 0
    (tmp_path / "p/000000.bin").unlink()
    assert ranges.store_ranges(spark, offsets, str(tmp_path)).count() == 0


def test_one_column_must_end_so(spark):
    df = spark.range(1).selectExpr("1 AS `a/model__F`", "2 AS `b/model__F`", "3 AS `model__O`")
    assert df.select(formats.column_ending(df, "__O")).first()[0] == 3
    for suffix in ("__F", "__P"):
        with pytest.raises(ValueError, match="columns end"):
            formats.column_ending(df, suffix)


def test_changed_files_are_read_again(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tag": "x"}\n')
    seen = spark.createDataFrame(formats.changed(spark, str(tmp_path), None).collect(), "path string, length long, modificationTime timestamp")
    assert seen.count() == 1 and formats.changed(spark, str(tmp_path), seen).count() == 0
    (tmp_path / "a.json").write_text('{"tag": "longer"}\n')
    assert formats.changed(spark, str(tmp_path), seen).count() == 1


def test_an_unknown_dataset_is_an_error(spark):
    spark.dataSource.register(plugins.SceneSource)
    with pytest.raises(Exception, match="none of the datasets"):
        spark.read.format("orrery_scenes").option("dataset", "nothing").load().count()


def test_progress_is_rate_limited_and_never_goes_back():
    now = iter((0.0, 0.5, 1.0, 2.5, 2.5, 2.6))
    log = live.ProgressLog(2.0, lambda: next(now))
    for rows in (5, 1, 1, 2, 0):
        log.count(rows)
    assert log.snapshots == [5, 9]
    log.onQueryTerminated(None)
    assert log.snapshots == [5, 9]
    with pytest.raises(ValueError):
        log.count(-1)


def test_a_stream_reports_its_progress(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "in"))
    log = live.ProgressLog(0.0)
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        assert live.drained(stream, "append").count() == 40
        for _ in range(100):
            if log.rows == 40:
                break
            live.time.sleep(0.1)
        assert log.rows == 40 and log.snapshots == sorted(log.snapshots)
    finally:
        spark.streams.removeListener(log)


def test_nearest_shuffles_no_pairs(spark, monkeypatch):
    """Copies at one place, blocks dealt over salts and slices, and pairs in several rounds of one task."""
    monkeypatch.setattr(joins, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(joins, "BLOCK_REFS", 30)
    monkeypatch.setattr(joins, "BLOCK_PAIRS", 500)
    r = np.random.default_rng(12)
    xyz = np.concatenate([r.normal(size=(150, 3)), np.full((100, 3), 0.25), r.normal(0, 1e-3, (50, 3))])
    p = spark.createDataFrame([(k, 0, *map(float, x)) for k, x in enumerate(xyz)] + [(900, 0, None, 0.0, 0.0)], "id long, batch long, x double, y double, z double")
    for keep_self in (True, False):
        compared = []
        got = {(g.id, g.place): g.ref for g in joins.nearest(p, p, 3, keep_self, compared).collect()}
        want = {}
        for k, x in enumerate(xyz):
            d = np.sqrt(((xyz - x) ** 2).sum(1)).round(9)
            near = [j for j in np.lexsort((np.arange(len(xyz)), d)) if keep_self or j != k][:3]
            want |= {(k, n): j for n, j in enumerate(near, 1)}
        assert got == want and sum(compared) < 0.5 * len(xyz) ** 2  # of all copies of a place four are met
