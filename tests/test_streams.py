"""Streams with state, the log tail, byte ranges, event records, shards by rank."""

import os
import struct
from datetime import datetime

import pytest
from orrery.sources import ranges, records, shard_stream, tail
from orrery.sources.files import listed, read_tars, write_files
from orrery.sources.formats import packed, shard_files, shard_scenes
from orrery.streaming import state
from pyspark.sql import functions as F

from .conftest import DATA


def lines(spark, rows):
    return spark.createDataFrame(rows, "run long, at timestamp, line long, kind string, value double")


def day(k, hour=0):
    return datetime(2024, 1, 1 + k, hour)


def test_a_sample_stays_open_over_batches_and_restarts(spark, tmp_path):
    first = lines(spark, [(1, day(0), 10, "open", 0.0), (1, day(0, 1), 11, "failed", 0.0), (2, day(0), 20, "tracks", 5.0)])
    second = lines(spark, [(1, day(1, 2), 13, "tracks", 256.0), (1, day(1), 12, "failed", 0.0), (1, day(1, 3), 14, "tracks", 9.0), (2, day(1), 21, "open", 0.0)])
    third = lines(spark, [(2, day(2), 22, "open", 0.0), (2, day(2, 1), 23, "tracks", 128.0)])
    base = str(tmp_path)
    first.write.parquet(f"{base}/in/k=0")
    source = lambda: spark.readStream.schema(first.schema).parquet(f"{base}/in/*")
    with state.keyed_state(spark):
        for k, more in enumerate((None, second, third)):
            if more is not None:
                more.write.parquet(f"{base}/in/k={k}")
            job = state.appended(state.filled_samples(source()), base)  # each time a new query on the old checkpoint
            job.processAllAvailable()
            job.stop()
    got = spark.read.parquet(f"{base}/out/batch=*").collect()
    assert sorted(map(tuple, got)) == [(1, 10, 256.0, 2), (2, 22, 128.0, 0)]


def test_a_run_turns_stale_by_its_timer(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "run long, at timestamp, kind string")
    arrivals = [
        rows((1, day(0), "line"), (2, day(0), "finished"), (3, day(0), "registered"), (4, day(0), "line")),
        rows((5, day(2), "line")),
        rows((1, day(3), "line"), (4, day(3), "fatal")),
    ]
    base = str(tmp_path)

    def job(s):
        out = state.run_status(s, 12 * 3_600_000).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state")
        return out.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{base}/out/batch={k}")).start()

    with state.keyed_state(spark):
        state.fed(arrivals, job)
    said = {}
    for r in sorted(spark.read.schema(state.RunStatus.schema).parquet(f"{base}/out/batch=*").collect(), key=lambda r: r.change):
        said.setdefault(r.run, []).append(r.status)
    assert said == {1: ["running", "stale", "running"], 2: ["completed"], 3: ["waiting"], 4: ["running", "stale", "failed"], 5: ["running", "stale"]}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = state.SeriesStore(spark, str(tmp_path), ["tag"], "ordinal")
    rows = lambda *x: spark.createDataFrame(list(x), "tag string, ordinal long, value double")
    held = lambda: {r.tag: (r.ordinal, r.value) for r in store.read().collect()}
    assert store.merge(rows(("a", 3, 1.0), ("b", 1, 2.0), ("a", 2, 7.0)), 0)
    assert not store.merge(rows(("a", 9, 9.0)), 0) and held() == {"a": (3, 1.0), "b": (1, 2.0)}
    assert store.merge(rows(("a", 1, 5.0), ("c", 1, 3.0)), 1) and held() == {"a": (3, 1.0), "b": (1, 2.0), "c": (1, 3.0)}
    store.compact()
    assert store.names("base") == [1] and store.names("delta") == []
    assert not store.merge(rows(("a", 9, 9.0)), 1)
    assert store.merge(rows(("b", 2, 4.0)), 2) and held() == {"a": (3, 1.0), "b": (2, 4.0), "c": (1, 3.0)}
    store.compact()
    store.compact()
    assert store.names("base") == [2] and held() == {"a": (3, 1.0), "b": (2, 4.0), "c": (1, 3.0)}


class Follower:
    """The reader's own offsets, as Spark would keep them."""

    def __init__(self, path, **options):
        self.reader = tail.TailReader({"path": str(path), **options})
        self.at = self.reader.initialOffset()

    def __call__(self):
        start, self.at = self.at, self.reader.latestOffset()
        return [(at, line) for p in self.reader.partitions(start, self.at) for _, at, line in self.reader.read(p)]


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_tail_waits_for_whole_lines_and_starts_anew(tmp_path, block):
    log, follow = tmp_path / "a.log", Follower(tmp_path, block=block)
    assert follow() == []
    log.write_bytes(b"Datapoint 1")
    assert follow() == []
    log.write_bytes(b"Datapoint 1\n\nsecond \xff\r\nthi")
    assert follow() == [(0, "Datapoint 1"), (12, ""), (13, "second �")]
    assert follow() == []
    with log.open("ab") as f:
        f.write(b"rd\nfourth\n")
    assert follow() == [(23, "third"), (29, "fourth")]
    log.write_bytes(b"Datapoint 1\nshort\n")  # cut: shorter than the cursor
    assert follow() == [(0, "Datapoint 1"), (12, "short")]
    log.write_bytes(b"another beginning of a longer file\nwith two lines\n")  # replaced
    assert follow() == [(0, "another beginning of a longer file"), (35, "with two lines")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.log").write_bytes(b"x" * 200_000 + b"\ny")
    assert [(at, len(line)) for at, line in follow()] == [(0, 200_000)]


def test_a_cut_while_reading_is_an_error(tmp_path):
    log, follow = tmp_path / "a.log", Follower(tmp_path)
    log.write_bytes(b"one\ntwo\n")
    plan = follow.reader.partitions({}, follow.reader.latestOffset())
    log.write_bytes(b"one\ntw")
    with pytest.raises(RuntimeError, match="was cut"):
        [list(follow.reader.read(p)) for p in plan]


def test_ranges_read_what_is_asked(spark, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "f.bin").write_bytes(data)
    name = f"file://{tmp_path}/f.bin"
    asked = [(name, k, k + 4) for k in range(0, 4000, 12)] + [(name, 5, 5), (name, 0, 4), (name, 9000, 10240)]
    rows = spark.createDataFrame(asked, "file string, start long, end long").repartition(3)
    got = ranges.read_ranges(rows).collect()
    assert sorted((r.start, r.end) for r in got) == sorted(x[1:] for x in asked)
    assert all(bytes(r.data) == data[r.start : r.end] for r in got)
    assert sum(r.fetched for r in got) == len({b for _, s, e in asked for b in range(s, e)})
    joined = ranges.read_ranges(rows, gap=8).collect()
    assert all(bytes(r.data) == data[r.start : r.end] for r in joined) and sum(r.fetched > 0 for r in joined) == 2
    with pytest.raises(Exception, match="ends at"):
        ranges.read_ranges(spark.createDataFrame([(name, 10_000, 10_241)], rows.schema)).collect()


def test_event_records_are_framed_and_checked(tmp_path):
    import pyarrow.fs

    assert records.checksum(b"") == (0xA282EAD8) and records.checksum(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    messages = [records.version_event(1.5), records.scalar_event(2.0, -3, "loss", 0.25), records.scalar_event(3.0, 1 << 40, "é" * 100, float("inf"))]
    name = b"\x0a\x03abc"
    tensor = b"\x08\x02\x22\x08" + struct.pack("<d", 0.1)
    one = name + b"\x42" + records.varint(len(tensor)) + tensor
    messages.append(b"\x2a" + records.varint(len(one) + 2) + b"\x0a" + records.varint(len(one)) + one)
    data = b"".join(map(records.framed, messages))
    (tmp_path / "e").write_bytes(data + records.framed(messages[1])[:-1])
    fs = pyarrow.fs.LocalFileSystem()
    with fs.open_input_file(str(tmp_path / "e")) as f:
        got = list(records.records(f, 0, "e"))
    assert got[-1][0] == len(data) and [records.scalars_of(m) for _, m in got] == [
        (1.5, 0, []), (2.0, -3, [("loss", 0.25)]), (3.0, 1 << 40, [("é" * 100, float("inf"))]), (0.0, 0, [("abc", 0.1)])
    ]
    for at in (3, 30, len(data) - 2):
        bad = bytearray(data)
        bad[at] ^= 1
        (tmp_path / "bad").write_bytes(bad)
        with fs.open_input_file(str(tmp_path / "bad")) as f, pytest.raises(ValueError, match="checksum"):
            list(records.records(f, 0, "bad"))


def test_a_scan_goes_on_where_the_last_one_ended(spark, tmp_path):
    one, two = (records.framed(records.scalar_event(float(k), k, "t", k / 2)) for k in (1, 2))
    file = tmp_path / "run/events.out.tfevents.1"
    file.parent.mkdir()
    file.write_bytes(one + two[:9])
    found, cursors = records.scan_events(spark, str(tmp_path))
    assert [(r.step, r.value) for r in found.collect()] == [(1, 0.5)]
    file.write_bytes(one + two)
    found, cursors = records.scan_events(spark, str(tmp_path), cursors)
    assert [(r.step, r.value) for r in found.collect()] == [(2, 1.0)]
    found, cursors = records.scan_events(spark, str(tmp_path), cursors)
    assert found.count() == 0 and [r.upto for r in cursors.collect()] == [len(one + two)]


def test_ranks_share_no_shard_and_epochs_differ(spark, tmp_path):
    write_files(shard_files(spark, f"{DATA}/sf0.001"), str(tmp_path))
    spark.dataSource.register(shard_stream.ShardSource)
    read = lambda **o: spark.read.format("orrery_shards").options(path=str(tmp_path), seed=3, **o).load()
    whole = read(world=3, epoch=0).collect()
    of = lambda rows: [s for _, s in sorted({(r.place * 3 + r.rank, r.shard) for r in rows})]
    order = of(whole)
    assert len(order) == len(set(order)) and sorted(order) == sorted(of(read(world=3, epoch=1).collect())) and order != of(read(world=3, epoch=1).collect())
    assert {r.shard for r in read(world=3, epoch=0, rank=1).collect()} == set(order[1::3])
    assert len({r.scene for r in whole}) == len(whole) and all(set(r.members) == {"meta.json", "view_0.txt"} for r in whole)
    (next(tmp_path.rglob("*.idx"))).unlink()
    assert len(of(read(world=3, epoch=0).collect())) == len(order) - 1


def test_many_small_shards_are_few_tasks(spark, tmp_path):
    write_files(shard_scenes(spark, f"{DATA}/sf0.001"), str(tmp_path), packed)
    shards = len(list(tmp_path.rglob("*.tar")))
    members = read_tars(spark, str(tmp_path))
    assert shards > 20 and members.rdd.getNumPartitions() < 5
    assert members.select("shard").distinct().count() == shards and members.count() == 300
    (tmp_path / "source_1/_hidden.tar").write_bytes(b"")
    (tmp_path / ".away").mkdir()
    (tmp_path / ".away/a.tar").write_bytes(b"")
    assert listed(spark, str(tmp_path), "*.tar").count() == shards and listed(spark, str(tmp_path / "source_1"), "*.idx").filter("length > 0").count() > 0


def test_a_partition_is_a_run_of_one_ranks_shards(tmp_path, monkeypatch):
    monkeypatch.setattr(shard_stream, "EACH", 3)
    for k in range(20):
        (tmp_path / f"s_{k}.tar").write_bytes(b"x" * 10)
        (tmp_path / f"s_{k}.idx").write_bytes(b"")
    reader = lambda **o: shard_stream.ShardReader({"path": str(tmp_path), "world": "2", **o})
    plan = reader().partitions()
    assert [(p.rank, p.place, len(p.names)) for p in plan] == [(r, k, n) for r in (0, 1) for k, n in ((0, 3), (3, 3), (6, 3), (9, 1))]
    assert len({n for p in plan for n in p.names}) == 20
    monkeypatch.setattr(shard_stream, "TASK_BYTES", 20)
    assert [(p.rank, p.place, len(p.names)) for p in reader(rank="1").partitions()] == [(1, k, 2) for k in range(0, 10, 2)]


def test_small_stretches_share_a_task_and_known_files_are_not_opened(tmp_path, monkeypatch):
    for k in range(50):
        (tmp_path / f"{k}.log").write_bytes(b"one\ntwo\nthree\n")
        os.utime(tmp_path / f"{k}.log", (1_000_000, 1_000_000))
    follow = Follower(tmp_path, block=4)
    looks = []
    monkeypatch.setattr(tail, "mark", lambda file, of=tail.mark: looks.append(1) or of(file))
    end = follow.reader.latestOffset()
    plan = follow.reader.partitions({}, end)
    assert len(plan) == 1 and len(plan[0].stretches) == 200
    monkeypatch.setattr(tail, "TOGETHER", 10 * tail.OPENING)
    assert len(follow.reader.partitions({}, end)) > 15
    assert len(follow()) == 150 and len(looks) == 50
    (tmp_path / "7.log").write_bytes(b"one\ntwo\nseven\n")  # as long as before, but later
    assert follow() == [] and len(looks) == 51
    assert follow() == [] and len(looks) == 52  # its time is fresh


def test_one_timer_serves_the_runs_of_a_group(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "run long, at timestamp, kind string")
    base = str(tmp_path)

    def job(s):
        out = state.run_status(s, 12 * 3_600_000, groups=1).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state")
        return out.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{base}/out/batch={k}")).start()

    with state.keyed_state(spark):
        state.fed([rows((1, day(0), "line"), (2, day(0, 20), "line"), (3, day(0), "fatal"), *((k, day(0), "registered") for k in range(100, 140))), rows((4, day(1), "line")), rows((5, day(3), "line")), rows((1, day(3), "registered"))], job)
    said = {}
    for r in sorted(spark.read.schema(state.RunStatus.schema).parquet(f"{base}/out/batch=*").collect(), key=lambda r: r.change):
        said.setdefault(r.run, []).append(r.status)
    assert all(said.pop(k) == ["waiting"] for k in range(100, 140))
    assert said == {1: ["running", "stale", "running", "stale"], 2: ["running", "stale"], 3: ["failed"], 4: ["running", "stale"], 5: ["running"]}


def test_keys_share_a_group_and_its_state(spark, tmp_path):
    first = lines(spark, [(k, day(0, k % 5), 10 * k, "open", 0.0) for k in range(300)] + [(None, day(0), 5, "open", 0.0)])
    second = lines(spark, [(k, day(1), 10 * k + 1, "failed", 0.0) for k in range(0, 300, 2)] + [(k, day(1, 1), 10 * k + 2, "tracks", float(k)) for k in range(300)] + [(None, day(1), 6, "tracks", 7.0)])
    base = str(tmp_path)
    with state.keyed_state(spark):
        state.fed([first, second], lambda s: state.appended(state.filled_samples(s, groups=3), base))
    got = {r.run: (r.sample, r.tracks, r.failed) for r in spark.read.parquet(f"{base}/out/batch=*").collect()}
    assert got == {k: (10 * k, float(k), int(k % 2 == 0)) for k in range(300)} | {None: (5, 7.0, 0)}


def test_event_files_are_made_as_their_rows_pass():
    """A file leaves when its last row has come, while the next batches have not been taken."""
    import pandas as pd

    taken = []

    def batches():
        for k in range(4):
            taken.append(k)
            yield pd.DataFrame({"file": [k, k + 1], "ordinal": [2 * k, 2 * k + 1], "tag": "t", "step": 1, "value": [0.5, None]})

    made = records.encoded("run_%d/e")(batches())
    name, content = next(made)
    assert name == "run_0/e" and content == records.framed(records.version_event(0.0)) + records.framed(records.scalar_event(0.0, 1, "t", 0.5)) and taken == [0]
    sizes = {name: len(content) for name, content in made}
    assert list(sizes) == [f"run_{k}/e" for k in range(1, 5)]
    assert {name: len(content) for name, content in records.encoded("run_%d/e", 0.5)(batches())}["run_4/e"] == sizes["run_4/e"] // 2


def test_shards_leave_as_their_scenes_pass():
    """The writer holds one shard: it leaves while the next batches have not been taken."""
    import pandas as pd

    taken = []

    def batches():
        for k in range(3):
            taken.append(k)
            yield pd.DataFrame({"source": 1, "scene": [2 * k, 2 * k + 1], "title": "t", "segment": "s", "n": 0, "shard": [k, k + 1]})

    made = packed(batches())
    assert next(made)[0] == "source_1/shard_00000.tar" and taken == [0]
    assert [name[-9:] for name, _ in made] == ["00000.idx", *(f"{k:05d}.{e}" for k in (1, 2, 3) for e in ("tar", "idx"))]
