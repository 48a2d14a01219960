"""Live series and logs as Structured Streaming jobs.

Each job takes a streaming frame and a target; the queries run one over the events until no
input is left and return what it wrote. Windows, sessions and joins append results once the
watermark has passed them, which drops their state; rows that come later than that are dropped.
Only summaries of a few tags and the status of a run, which a reader wants whole at each trigger, are complete.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.scalars import log_lines, parsed
from ..registry import query, r6
from ..sources.checkpoints import ready

DELAY = "2 days"


def folder(spark: SparkSession, what: str) -> str:
    return f"{ready(spark).rstrip('/')}/orrery-{what}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with a time that watermarks accept."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A stream reads folders: a single file is named by a pattern.
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return source.withColumn("t", F.col("ts").cast("timestamp"))


#: Four arrivals of eight days each, and a fifth of rows that were held up: every tenth of the first twenty days.
ARRIVAL = "CASE WHEN event_id % 10 = 0 AND day < 20 THEN 4 ELSE least(3, day // 8) END"
ARRIVED = f"""days AS (SELECT *, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day FROM events), arrived AS (SELECT *, {ARRIVAL} AS arrival FROM days),
marks AS (SELECT a AS arrival, (SELECT max(ts) FROM arrived WHERE arrived.arrival < a) - INTERVAL '2 days' AS mark FROM (SELECT unnest(range(6)) AS a)),
last_mark AS (SELECT mark FROM marks WHERE arrival = 5)"""


def move(spark: SparkSession, source: str, target: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(target).getParent())
    if not fs.rename(hadoop(source), hadoop(target)):
        raise RuntimeError(f"{source} could not be moved to {target}")


def fed(arrivals: list[DataFrame], job: Callable[[DataFrame], StreamingQuery]) -> None:
    """Runs a job over arrivals, each a micro-batch: an arrival appears whole, when what came before it is done."""
    spark, base = arrivals[0].sparkSession, folder(arrivals[0].sparkSession, "fed")
    empty = arrivals[0].limit(0)
    empty.write.parquet(f"{base}/seen/arrival_0")
    running = job(spark.readStream.schema(empty.schema).parquet(f"{base}/seen/*"))
    try:
        for k, rows in enumerate(arrivals, 1):
            rows.write.parquet(f"{base}/coming/arrival_{k}")
            move(spark, f"{base}/coming/arrival_{k}", f"{base}/seen/arrival_{k}")
            running.processAllAvailable()
    finally:
        running.stop()


def appended(stream: DataFrame, base: str) -> StreamingQuery:
    """A job that appends a stream's rows to Parquet below ``base``, each batch in a folder of its own."""
    out = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state")
    return out.foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{base}/out/batch={k}")).start()


def arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events by their arrival."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    arrival = F.when((F.col("event_id") % 10 == 0) & (day < 20), 4).otherwise(F.least(F.lit(3), F.floor(day / 8).cast("int")))
    return [events.filter(arrival == k).withColumn("t", F.col("ts").cast("timestamp")) for k in range(5)]


def of_arrivals(spark: SparkSession, sf_dir: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a job appends when the events come in their arrivals, one a micro-batch."""
    base, made = folder(spark, "stream"), []

    def job(stream: DataFrame) -> StreamingQuery:
        made.append(transform(stream))
        return appended(made[0], base)

    fed(arrivals(spark, sf_dir), job)
    return spark.read.schema(made[0].schema).parquet(f"{base}/out/batch=*")


def drained(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None] | None = None, available_now: bool = True) -> DataFrame:
    """What a stream has written to Parquet when its input ends."""
    spark = stream.sparkSession
    base = folder(spark, "stream")
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state")
    if available_now:
        out = out.trigger(availableNow=True)

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={k}")

    job = out.foreachBatch(write or keep).start()
    if available_now:
        job.awaitTermination()
    else:
        job.processAllAvailable()
        job.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/batch=*" if mode != "complete" else f"{base}/out")


@query("SELECT event_type AS tag, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS largest FROM events GROUP BY event_type")
def strm_snapshot_complete(spark, sf_dir):
    """The whole summary at each trigger."""
    s = event_stream(spark, sf_dir).groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.max("value").alias("largest"))
    return drained(s, "complete")


@query("SELECT event_id AS sample, user_id AS tracks, CAST(format('{:.3f}', value) AS DOUBLE) AS loss, event_type = 'error' AS failed FROM events")
def strm_log_parse(spark, sf_dir):
    """Lines of log files that appear in a folder, parsed as they come."""
    path = folder(spark, "logs")
    log_lines(spark.read.parquet(f"{sf_dir}/events.parquet")).write.text(path)
    return drained(parsed(spark.readStream.text(path).withColumnRenamed("value", "line")), "append")


@query(f"""WITH {ARRIVED}, w AS (SELECT *, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2024-01-01') AS day_at FROM arrived JOIN marks USING (arrival))
SELECT event_type AS tag, day_at AS day, count(*) AS n, round(sum(value), 4) AS total FROM w, last_mark WHERE (w.mark IS NULL OR day_at + INTERVAL '1 day' > w.mark) AND day_at + INTERVAL '1 day' <= last_mark.mark GROUP BY ALL""")
def strm_tumbling(spark, sf_dir):
    """Days, each appended once no more of its rows can come."""
    def days(s: DataFrame) -> DataFrame:
        found = s.withWatermark("t", DELAY).groupBy(F.window("t", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        return found.select(F.col("event_type").alias("tag"), F.col("window.start").cast("timestamp_ntz").alias("day"), "n", "total")

    return of_arrivals(spark, sf_dir, days)


@query(f"""WITH {ARRIVED}, w AS (SELECT value, mark, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') - INTERVAL '6 hours']) AS start FROM arrived JOIN marks USING (arrival))
SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w, last_mark WHERE (w.mark IS NULL OR start + INTERVAL '12 hours' > w.mark) AND start + INTERVAL '12 hours' <= last_mark.mark GROUP BY start""")
def strm_sliding(spark, sf_dir):
    """Windows of twelve hours every six."""
    def windows(s: DataFrame) -> DataFrame:
        found = s.withWatermark("t", DELAY).groupBy(F.window("t", "12 hours", "6 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "total")

    return of_arrivals(spark, sf_dir, windows)


@query(f"""WITH {ARRIVED}, ok AS (SELECT user_id, ts FROM arrived JOIN marks USING (arrival) WHERE mark IS NULL OR ts + INTERVAL '6 hours' > mark),
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM ok), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
n AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS done, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, start, n FROM n, last_mark WHERE done <= mark""")
def strm_session(spark, sf_dir):
    """Sessions that end after six quiet hours."""
    def sessions(s: DataFrame) -> DataFrame:
        found = s.withWatermark("t", DELAY).groupBy(F.session_window("t", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
        return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")

    return of_arrivals(spark, sf_dir, sessions)


JOINED = f"""{ARRIVED}, both_marks AS (SELECT a AS arrival, least((SELECT max(ts) FROM arrived WHERE arrived.arrival < a AND event_type = 'view'), (SELECT max(ts) FROM arrived WHERE arrived.arrival < a AND event_type = 'click')) - INTERVAL '2 days' AS mark FROM (SELECT unnest(range(6)) AS a)),
ok AS (SELECT arrived.* FROM arrived JOIN both_marks USING (arrival) WHERE mark IS NULL OR ts > mark)"""


@query(f"""WITH {JOINED} SELECT v.user_id, v.event_id AS seen, c.event_id AS clicked FROM ok v JOIN ok c ON v.user_id = c.user_id AND c.ts >= v.ts AND c.ts <= v.ts + INTERVAL '3 hours' WHERE v.event_type = 'view' AND c.event_type = 'click'""")
def strm_join(spark, sf_dir):
    """Clicks within three hours of a view of the same user: two streams, whose state the watermarks bound."""

    def clicked(s: DataFrame) -> DataFrame:
        views = s.filter("event_type = 'view'").withWatermark("t", DELAY).select("user_id", F.col("event_id").alias("seen"), F.col("t").alias("at"))
        clicks = s.filter("event_type = 'click'").withWatermark("t", DELAY).select(F.col("user_id").alias("who"), F.col("event_id").alias("clicked"), F.col("t").alias("then"))
        near = F.expr("user_id = who AND then >= at AND then <= at + INTERVAL 3 HOURS")
        return views.join(clicks, near).select("user_id", "seen", "clicked")

    return of_arrivals(spark, sf_dir, clicked)


@query("SELECT DISTINCT user_id, event_type FROM events")
def strm_dedupe(spark, sf_dir):
    """First of each key within the watermark's span, which is longer here than the keys live."""
    s = event_stream(spark, sf_dir).withWatermark("t", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return drained(s.select("user_id", "event_type"), "append")


def status(events: DataFrame, now: str, stale: str) -> DataFrame:
    """A run's status: completed, failed, waiting, stale or running, in this order of precedence."""
    last, seen = F.max("t"), lambda kind: F.bool_or(F.col("event_type") == kind)
    late = last < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {stale}")
    state = F.when(seen("signup") & (F.count("*") > 70), "completed").when(F.count_if(F.col("event_type") == "error") > 12, "failed").when(F.count("*") < 20, "waiting").when(late, "stale").otherwise("running")
    return events.groupBy("user_id").agg(state.alias("status"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'signup') AND count(*) > 70 THEN 'completed' WHEN count(*) FILTER (WHERE event_type = 'error') > 12 THEN 'failed' WHEN count(*) < 20 THEN 'waiting'
WHEN max(ts) < TIMESTAMP '2024-01-30' - INTERVAL 60 MINUTES THEN 'stale' ELSE 'running' END AS status FROM events GROUP BY user_id""")
def strm_status(spark, sf_dir):
    return drained(status(event_stream(spark, sf_dir), "2024-01-30", "60 MINUTES"), "complete")


class ProgressLog(StreamingQueryListener):
    """Snapshots of a stream's counted rows, ``every_s`` seconds apart at least; a count never goes back."""

    def __init__(self, every_s: float, clock: Callable[[], float] = time.monotonic):
        self.every_s, self.clock = every_s, clock
        self.rows, self.said, self.snapshots = 0, None, []

    def count(self, rows: int) -> None:
        if rows < 0:
            raise ValueError("counters do not go backwards")
        self.rows += rows
        if self.said is None or self.clock() - self.said >= self.every_s:
            self.said = self.clock()
            self.snapshots.append(self.rows)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.count(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if not self.snapshots or self.snapshots[-1] != self.rows:
            self.snapshots.append(self.rows)
