"""Append-only logs as a stream: a cursor a file, whole lines only, a new start where a file was cut or replaced.

The cursor is part of the stream's checkpoint: for each file a mark of its first line and the place after its last whole line. So a partial
last line waits for the write that ends it, a file whose mark has changed or that is shorter than its cursor is read
from its beginning, and no state is needed besides. The driver reads a file's first line and its end, again only where size or time have
changed since the last look, or were fresh then; workers read the lines, in stretches of ``block`` bytes, of which small ones share a
partition. A file that is replaced by a longer one with the same first line looks like one that has grown.
"""

from __future__ import annotations

import io
import time
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow.fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.scalars import log_lines, parsed
from ..registry import query
from .files import write_files
from .views import table

HEAD, STEP = 4096, 1 << 16
#: A partition's stretches hold so many bytes together, of which each counts ``OPENING`` more than it has; nanoseconds in which a file's time is fresh.
TOGETHER, OPENING, FRESH = 16 << 20, 1 << 15, 2_000_000_000


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def mark(file: pyarrow.NativeFile) -> int:
    file.seek(0)
    return zlib.crc32(file.read(HEAD).split(b"\n", 1)[0])


def last_line_end(file: pyarrow.NativeFile) -> int:
    """The place after the last line break; 0 if there is none."""
    at = file.size()
    while at > 0:
        begin = max(0, at - STEP)
        file.seek(begin)
        if (found := file.read(at - begin).rfind(b"\n")) >= 0:
            return begin + found + 1
        at = begin
    return 0


class Stretch(NamedTuple):
    """The lines of a file that begin from ``begin`` on and before ``end``."""

    file: str
    begin: int
    end: int
    inside: bool


class Stretches(InputPartition):
    def __init__(self, number: int, stretches: list[Stretch]):
        super().__init__(number)
        self.stretches = stretches


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".log")
        self.block = int(options.get("block", 64 << 20))
        #: What the last look found, by file: size, time, whether it was fresh, and mark and end.
        self.seen: dict[str, tuple[int, int, bool, list[int] | None]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, root = located(self.path)
        now, seen = time.time_ns(), {}
        for info in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
            if info.is_file and info.path.endswith(self.suffix):
                size, at, known = info.size, info.mtime_ns, self.seen.get(info.path)
                if known is None or known[2] or known[:2] != (size, at):
                    with fs.open_input_file(info.path) as file:
                        end = last_line_end(file)
                        known = size, at, at is None or at > now - FRESH, [mark(file), end] if end else None
                seen[info.path] = known
        self.seen = seen
        return {path: known[3] for path, known in seen.items() if known[3]}

    def partitions(self, start: dict, end: dict) -> list[Stretches]:
        out, held = [], TOGETHER
        for file, (now, upto) in sorted(end.items()):
            before, at = start.get(file, (None, 0))
            at = at if before == now and at <= upto else 0
            for b in range(at, upto, self.block):
                if held >= TOGETHER:
                    out.append(Stretches(len(out), []))
                    held = 0
                one = Stretch(file, b, min(b + self.block, upto), b > at)
                out[-1].stretches.append(one)
                held += one.end - one.begin + OPENING
        return out

    def read(self, partition: Stretches) -> Iterator[tuple]:
        fs, _ = located(self.path)
        for one in partition.stretches:
            yield from lines(fs, one)


def lines(fs: pyarrow.fs.FileSystem, one: Stretch) -> Iterator[tuple[str, int, str]]:
    with fs.open_input_file(one.file) as raw:
        at = one.begin
        if one.inside:  # the line that holds the byte before belongs to the stretch before
            at -= 1
        raw.seek(at)
        file = io.BufferedReader(raw, min(STEP, max(HEAD, one.end - one.begin)))
        if one.inside:
            at += len(file.readline())
        while at < one.end:
            line = file.readline()
            if not line.endswith(b"\n"):
                raise RuntimeError(f"{one.file} was cut while it was read")
            yield one.file, at, line.decode("utf-8", "replace").rstrip("\r\n")
            at += len(line)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "orrery_tail"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


LOG = 500


@query(f"""WITH l AS (SELECT event_id // {LOG} AS log, event_id, user_id, value, event_type FROM events)
SELECT log, event_id AS sample, user_id AS tracks, CAST(format('{{:.3f}}', value) AS DOUBLE) AS loss, event_type = 'error' AS failed FROM l
UNION ALL SELECT log, event_id, user_id, CAST(format('{{:.3f}}', value) AS DOUBLE), event_type = 'error' FROM l WHERE log % 3 = 0 AND event_id % {LOG} >= {LOG - 40}""")
def strm_log_tail(spark, sf_dir):
    """Logs that grow in two writes, the first of which ends within a line; then each third is replaced by a shorter one."""
    from ..streaming.live import folder
    from ..streaming.state import appended

    base = folder(spark, "tail")
    e = table(spark, sf_dir, "events").withColumn("log", F.floor(F.col("event_id") / LOG))
    said = log_lines(e, "log", "event_id")

    def text(rows):
        each = F.array_sort(F.collect_list(F.struct("event_id", "line")))
        joined = F.concat(F.array_join(F.transform(each, lambda x: x.line), "\n"), F.lit("\n"))
        return rows.groupBy("log").agg(joined.alias("content")).withColumn("name", F.format_string("run_%d.log", "log"))

    whole = text(said)
    shorter = text(said.filter((F.col("log") % 3 == 0) & (F.col("event_id") % LOG >= LOG - 40)))
    spark.dataSource.register(TailSource)
    tail = None
    for files in (whole.withColumn("content", F.expr("substring(content, 1, CAST(0.6 * length(content) AS INT))")), whole, shorter):
        write_files(files.select("name", F.encode("content", "UTF-8").alias("content")), f"{base}/logs")
        if tail is None:
            tail = appended(spark.readStream.format("orrery_tail").option("path", f"{base}/logs").option("block", 4096).load(), base)
        tail.processAllAvailable()
    tail.stop()
    seen = spark.read.schema("file string, at long, line string").parquet(f"{base}/out/batch=*")
    log = F.regexp_extract("file", r"run_(\d+)\.log$", 1).cast("long")
    return parsed(seen.withColumn("log", log), "log")
