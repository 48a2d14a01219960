"""Streams that carry state of their own: samples that stay open between batches, runs with timers, series by key.

``transformWithState`` keeps a key's state in the state store, so a restarted job goes on where it was;
rows of a key are taken in order within a batch, and batches come in order. Keys share a call and a state in groups, by a hash,
as a call for each key costs milliseconds. ``SeriesStore`` is where a stream in update mode puts its rows: each batch once, whatever is replayed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..registry import query, r6
from ..sources.files import publish
from ..sources.views import SCALARS, scalars, table
from .live import appended, fed, folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Jobs that start here keep their state in RocksDB, which ``transformWithState`` needs; others are left as they were."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """A group's rows of a batch, in order."""
    return pd.concat(rows, ignore_index=True).sort_values(by, kind="stable")


#: Groups of keys with one state each: a call of Python for each group and batch costs the same for one key as for thousands.
GROUPS = 1024
#: What stands for a missing key or time in a group's table.
NEVER = -(1 << 63)


def grouped(lines: DataFrame, key: str, groups: int = GROUPS) -> GroupedData:
    """A stream's rows by groups of keys; a job's number of groups stays as it began, as its state lies by group. A null key is ``NEVER``."""
    whole = lines.withColumn(key, F.coalesce(key, F.lit(NEVER)))
    return whole.withColumn("group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("group")


def ungrouped(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn(key, F.when(F.col(key) != NEVER, F.col(key)))


class Held:
    """A group's table in a value state: rows of fixed width, by key, as bytes."""

    def __init__(self, handle: StatefulProcessorHandle, fields: list[tuple[str, str]]):
        self.fields, self.state = fields, handle.getValueState("held", "data binary")

    def get(self) -> pd.DataFrame:
        data = self.state.get()[0] if self.state.exists() else b""
        return pd.DataFrame.from_records(np.frombuffer(bytes(data), np.dtype(self.fields)))

    def put(self, rows: pd.DataFrame) -> None:
        if len(rows):
            held = np.empty(len(rows), np.dtype(self.fields))
            for name, _ in self.fields:
                held[name] = rows[name].to_numpy()
            self.state.update((held.tobytes(),))
        else:
            self.state.clear()


class OpenSamples(StatefulProcessor):
    """Lines of a run attach to the last sample that is open: failures are counted on it, and its count of tracks closes it.

    A line of a later batch finds the sample of an earlier one in the state, which holds the open samples of a group of runs.
    """

    schema = "run long, sample long, tracks double, failed long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = Held(handle, [("run", "<i8"), ("sample", "<i8"), ("failed", "<i8")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lines, held = in_order(rows, ["run", "at", "line"]), self.open.get()
        kind = lines["kind"].to_numpy()
        # What is open from before comes first in its run, as a line that opens it and has its failures.
        run = np.concatenate([held["run"], lines["run"]]).astype(np.int64)
        order = np.argsort(run, kind="stable")
        run = run[order]
        line = np.concatenate([held["sample"], lines["line"]]).astype(np.int64)[order]
        opens = np.concatenate([np.ones(len(held), bool), kind == "open"])[order]
        counts = np.concatenate([np.zeros(len(held), bool), kind == "tracks"])[order]
        value = np.concatenate([np.zeros(len(held)), lines["value"].to_numpy(np.float64)])[order]
        fails = np.concatenate([held["failed"], kind == "failed"]).astype(np.int64)[order]
        failed = np.cumsum(fails)
        begins = opens | np.append(True, run[1:] != run[:-1])
        part = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        before = failed[first] - fails[first]
        at = np.flatnonzero(counts & opens[first][part])
        at = at[np.unique(part[at], return_index=True)[1]]  # the first count of tracks closes
        out = pd.DataFrame({"run": run[at], "sample": line[first[part[at]]], "tracks": value[at], "failed": failed[at] - before[part[at]]})
        ends = np.append(first[1:], len(run)) - 1
        left = opens[first] & np.append(run[first][1:] != run[first][:-1], True)
        left[part[at]] = False
        self.open.put(pd.DataFrame({"run": run[first], "sample": line[first], "failed": failed[ends] - before})[left])
        yield out

    def close(self) -> None:
        pass


def filled_samples(lines: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``run, sample, tracks, failed`` of a stream of ``run, at, line, kind, value``, as samples get their tracks."""
    return ungrouped(grouped(lines, "run", groups).transformWithStateInPandas(OpenSamples(), OpenSamples.schema, "Append", "none"), "run")


def by_weeks(rows: DataFrame, time: str, most: int = 5) -> list[DataFrame]:
    """Arrivals in the order of time, a week each, the last one with what is left."""
    week = F.least(F.floor(F.datediff(time, F.lit("2024-01-01").cast("date")) / 7), F.lit(most - 1))
    return [rows.filter(week == k) for k in range(most)]


KINDS = {"view": "open", "error": "failed", "click": "tracks"}


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("line"), F.coalesce(kind, F.lit("other")).alias("kind"), "value")


@query("""WITH l AS (SELECT user_id AS run, ts, event_id AS line, event_type AS kind, value FROM events),
s AS (SELECT *, last_value(CASE WHEN kind = 'view' THEN line END IGNORE NULLS) OVER w AS sample FROM l WINDOW w AS (PARTITION BY run ORDER BY ts, line ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, count(*) FILTER (WHERE kind = 'click') OVER v AS counts, count(*) FILTER (WHERE kind = 'error') OVER v AS failed FROM s WHERE sample IS NOT NULL WINDOW v AS (PARTITION BY run, sample ORDER BY ts, line ROWS UNBOUNDED PRECEDING))
SELECT run, sample, value AS tracks, failed FROM c WHERE kind = 'click' AND counts = 1""")
def strm_open_samples(spark, sf_dir):
    """Five arrivals of a log: samples that stay open over the end of a batch are closed by a later one."""
    base = folder(spark, "samples")
    with keyed_state(spark):
        fed(by_weeks(run_lines(spark, sf_dir), "at"), lambda lines: appended(filled_samples(lines), base))
    return spark.read.schema(OpenSamples.schema).parquet(f"{base}/out/batch=*")


#: By their number in the state; none is said before a run's first change.
STATUS = np.array(["completed", "failed", "waiting", "stale", "running"], object)
COMPLETED, FAILED, WAITING, STALE, RUNNING = range(5)


class RunStatus(StatefulProcessor):
    """A run's status whenever it changes: completed, failed, waiting, stale or running, in this order of precedence.

    The state holds a group of runs, and a timer stands at the time at which the first of them turns stale: a run
    without another line until then turns stale by the timer alone.
    """

    schema = "run long, change long, status string, last timestamp"

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = Held(handle, [("run", "<i8"), ("last", "<i8"), ("done", "?"), ("failed", "?"), ("status", "<i1"), ("change", "<i8")])

    def said(self, held: pd.DataFrame, status: np.ndarray, known: np.ndarray) -> pd.DataFrame:
        """The changes of runs from a status (-1 at first) to another, which the state takes over."""
        new = status != known
        held["status"], held["change"] = status, held["change"] + new
        rows = held[new]
        last = rows["last"].to_numpy(np.int64).view("datetime64[ms]").astype("datetime64[us]")  # of which NEVER is the missing one
        self.runs.put(held)
        return pd.DataFrame({"run": rows["run"], "change": rows["change"], "status": STATUS[rows["status"].to_numpy(np.int64)], "last": last})

    def timed(self, held: pd.DataFrame, have: set[int]) -> None:
        """One timer, at which the next of the runs that go on turns stale; ``have`` are those that stand."""
        due = held.loc[held["status"] == RUNNING, "last"] + self.stale_ms
        wanted = {int(due.min())} if len(due) else set()
        for t in have - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - have:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.runs.get()
        parts = [held.assign(line=False)]
        for batch in rows:
            line = batch["kind"] != "registered"
            at = batch["ms"].where(line).astype("Int64").fillna(NEVER).astype("int64")
            one = pd.DataFrame({"run": batch["run"], "last": at, "done": batch["kind"] == "finished", "failed": batch["kind"] == "fatal", "status": -1, "change": 0, "line": True})
            parts.append(one.groupby("run", as_index=False).max())
        found = pd.concat(parts, ignore_index=True).groupby("run", as_index=False).max()
        known, line = found["status"].to_numpy(), found["line"].to_numpy(bool)
        done, failed, last = found["done"].to_numpy(bool), found["failed"].to_numpy(bool), found["last"].to_numpy()
        status = np.where(line, np.select([done, failed, last == NEVER], [COMPLETED, FAILED, WAITING], RUNNING), known)
        found = found.drop(columns="line")
        yield self.said(found, status, known)
        self.timed(found, set(self.handle.listTimers()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, mark = self.runs.get(), timerValues.getCurrentWatermarkInMs()
        known = held["status"].to_numpy()
        late = (known == RUNNING) & (held["last"].to_numpy() + self.stale_ms <= mark)
        yield self.said(held, np.where(late, STALE, known), known)
        self.timed(held, set())  # the one that has fired goes by itself

    def close(self) -> None:
        pass


def run_status(lines: DataFrame, stale_ms: int, delay: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """``run, change, status, last``: the changes of each run's status, of a stream of ``run, at, kind``.

    Time is that of the watermark, so a run turns stale when the others have gone on for long enough.
    """
    timed = lines.withWatermark("at", delay).withColumn("ms", F.unix_millis("at"))
    return ungrouped(grouped(timed, "run", groups).transformWithStateInPandas(RunStatus(stale_ms), RunStatus.schema, "Update", "EventTime"), "run")


#: A run is a user's day. A third of the signups finishes a run, the others register one; some errors are fatal.
RUN = "user_id * 100 + day(ts)"
LINE_KIND = "CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'finished' ELSE 'registered' END WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'fatal' ELSE 'line' END"
STALE_HOURS = 12


@query(f"""WITH k AS (SELECT {RUN} AS run, ts, {LINE_KIND} AS kind FROM events), mark AS (SELECT max(ts) - INTERVAL '1 hour' AS mark FROM events),
s AS (SELECT run, max(ts) FILTER (WHERE kind <> 'registered') AS last, bool_or(kind = 'finished') AS done, bool_or(kind = 'fatal') AS failed FROM k GROUP BY run)
SELECT run, CASE WHEN done THEN 'completed' WHEN failed THEN 'failed' WHEN last IS NULL THEN 'waiting' WHEN date_trunc('millisecond', last) + INTERVAL '{STALE_HOURS} hours' <= mark THEN 'stale' ELSE 'running' END AS status FROM s, mark""")
def strm_run_status(spark, sf_dir):
    """The last status of each run, its lines come in five arrivals; staleness comes from timers."""
    base = folder(spark, "status")
    e = table(spark, sf_dir, "events").select(F.expr(RUN).alias("run"), F.col("ts").cast("timestamp").alias("at"), F.expr(LINE_KIND).alias("kind"))

    def job(lines: DataFrame) -> StreamingQuery:
        out = run_status(lines, STALE_HOURS * 3_600_000).writeStream.outputMode("update").option("checkpointLocation", f"{base}/state")
        return out.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{base}/out/batch={k}")).start()

    with keyed_state(spark):
        fed(by_weeks(e, "at"), job)
    seen = spark.read.schema(RunStatus.schema).parquet(f"{base}/out/batch=*")
    return seen.groupBy("run").agg(F.max_by("status", "change").alias("status"))


class SeriesStore:
    """Rows by key, of which a later ``order`` wins: batches of an update-mode stream are merged in, each once.

    A batch becomes one delta, published by a rename under its number, so a batch that is replayed finds
    its delta and changes nothing. Readers see whole deltas only. ``compact`` merges what is there into a new base, published alike,
    and drops the deltas before it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str):
        self.spark, self.path, self.keys, self.order = spark, path, keys, order

    def names(self, kind: str) -> list[int]:
        """The numbers of the published deltas or bases, rising."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in found if n.isdigit())

    def last(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), self.order).alias("row")).select(*self.keys, "row.*")

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Takes a batch in; False, and nothing done, if it is in already."""
        bases = self.names("base")
        if bases and batch <= bases[-1]:
            return False
        return publish(self.last(rows), f"{self.path}/delta/{batch}")

    def read(self) -> DataFrame:
        bases, deltas = self.names("base"), self.names("delta")
        held = [f"{self.path}/base/{b}" for b in bases[-1:]] + [f"{self.path}/delta/{d}" for d in deltas if not bases or d > bases[-1]]
        return self.last(self.spark.read.parquet(*held))

    def compact(self) -> None:
        """One base in place of the base and deltas so far."""
        bases, deltas = self.names("base"), self.names("delta")
        if deltas and (not bases or deltas[-1] > bases[-1]):
            publish(self.read(), f"{self.path}/base/{deltas[-1]}")
        newest = self.names("base")[-1:]
        jvm = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for kind, n in [("base", b) for b in bases if b < newest[0]] + [("delta", d) for d in deltas if d <= newest[0]] if newest else []:
            old = jvm(f"{self.path}/{kind}/{n}")
            old.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)


@query(f"WITH {SCALARS} SELECT tag, step, max(ordinal) AS ordinal, round(arg_max(value, ordinal), 6) AS value FROM scalars GROUP BY tag, step")
def strm_upsert_series(spark, sf_dir):
    """A stream in update mode into a store by key; every batch comes twice, and the store is compacted on the way."""
    base = folder(spark, "series")
    store = SeriesStore(spark, f"{base}/store", ["tag", "step"], "ordinal")

    def merge(rows: DataFrame, batch: int) -> None:
        for _ in range(2):
            store.merge(rows, batch)
        if batch % 3 == 2:
            store.compact()

    def job(rows: DataFrame) -> StreamingQuery:
        last = rows.groupBy("tag", "step").agg(F.max_by("value", "ordinal").alias("value"), F.max("ordinal").alias("ordinal"))
        return last.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").foreachBatch(merge).start()

    s = scalars(spark, sf_dir)
    fed([s.filter(F.col("ordinal") % 4 == k) for k in range(4)], job)
    return store.read().select("tag", "step", "ordinal", r6("value").alias("value"))
