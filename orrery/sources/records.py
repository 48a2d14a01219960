"""Event files as experiment writers leave them: framed binary records with checksums, scanned from where the last scan ended.

A record is its length, the length's checksum, the message and the message's checksum. A
file's last record may be torn, as its writer is not done: a scan stops before it, and
the next one begins there. A record that is whole but fails its checksum is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from .files import Make, listed, scratch, write_files
from .formats import last_by_step
from .views import SCALARS, scalars

#: Fixed values of the format: the checksum's polynomial, and its mask.
CASTAGNOLI, MASK = 0x82F63B78, 0xA282EAD8
EVENTS = "path string, upto long, wall_time double, step long, tag string, value double"
ROWS = 50_000


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return out


TABLE = _table()


def checksum(data: bytes) -> int:
    """CRC-32C, rotated and shifted by the format's mask."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = TABLE[(crc ^ b) & 255] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(message: bytes) -> bytes:
    size = struct.pack("<Q", len(message))
    return size + struct.pack("<I", checksum(size)) + message + struct.pack("<I", checksum(message))


def varint(n: int) -> bytes:
    out, n = bytearray(), n & (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def scalar_event(wall_time: float, step: int, tag: str, value: float) -> bytes:
    """The message of one scalar."""
    name = tag.encode()
    one = b"\x0a" + varint(len(name)) + name + b"\x15" + struct.pack("<f", value)
    summary = b"\x0a" + varint(len(one)) + one
    return b"\x09" + struct.pack("<d", wall_time) + b"\x10" + varint(step) + b"\x2a" + varint(len(summary)) + summary


def version_event(wall_time: float) -> bytes:
    said = b"brain.Event:2"
    return b"\x09" + struct.pack("<d", wall_time) + b"\x1a" + varint(len(said)) + said


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``number, value`` of a message's fields: numbers for varints, bytes for the rest."""

    def number(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            b = message[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    at = 0
    while at < len(message):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


def tensor_value(message: bytes) -> float | None:
    """The first number of a tensor of floats or doubles, which newer writers put in place of a simple value."""
    has = dict(fields(message))
    form, size = {1: ("<f", 4), 2: ("<d", 8)}.get(has.get(1), (None, 0))
    data = has.get(4) or has.get(5 if size == 4 else 6)
    return struct.unpack(form, data[:size])[0] if form and data else None


def scalars_of(message: bytes) -> tuple[float, int, list[tuple[str, float]]]:
    """``wall_time, step`` and the scalars of an event."""
    wall_time, step, found = 0.0, 0, []
    for number, value in fields(message):
        if number == 1:
            wall_time = struct.unpack("<d", value)[0]
        elif number == 2:
            step = value - (1 << 64) if value >> 63 else value
        elif number == 5:
            for _, one in fields(value):
                has = dict(fields(one))
                said = struct.unpack("<f", has[2])[0] if 2 in has else tensor_value(has[8]) if 8 in has else None
                if said is not None:
                    found.append((has.get(1, b"").decode(), said))
    return wall_time, step, found


def records(file: pyarrow.NativeFile, at: int, name: str) -> Iterator[tuple[int, bytes]]:
    """``end, message`` of each whole record from ``at`` on."""
    file.seek(at)
    while len(head := file.read(12)) == 12:
        size, said = struct.unpack("<QI", head)
        if checksum(head[:8]) != said:
            raise ValueError(f"{name}: the length at {at} fails its checksum")
        body = file.read(size + 4)
        if len(body) < size + 4:
            return
        if checksum(body[:size]) != struct.unpack("<I", body[size:])[0]:
            raise ValueError(f"{name}: the record at {at} fails its checksum")
        at += 16 + size
        yield at, body[:size]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in EVENTS.split(", ")]
    out = []
    for batch in batches:
        for name, begin in zip(batch["path"], batch["upto"], strict=True):
            fs, where = pyarrow.fs.FileSystem.from_uri(name)
            with fs.open_input_file(where) as file:
                for end, message in records(file, int(begin), name):
                    wall_time, step, found = scalars_of(message)
                    out += [(name, end, wall_time, step, tag, value) for tag, value in found or [(None, None)]]
                    if len(out) >= ROWS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
    yield pd.DataFrame(out, columns=names)


def scan_events(spark: SparkSession, path: str, cursors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The scalars that have come since ``cursors``, and the cursors ``path, upto`` after them.

    Only files that have grown are opened, from their cursor on. A file is one task's, as a record's place is known only from the one before.
    """
    files = listed(spark, path, "*tfevents*").select("path", "length")
    files = files.withColumn("upto", F.lit(0).cast("long")) if cursors is None else files.join(cursors, "path", "left").withColumn("upto", F.coalesce("upto", F.lit(0).cast("long")))
    grown = files.filter("length > upto").select("path", "upto")
    place = scratch(spark, "events")
    grown.repartition("path").mapInPandas(_scan, EVENTS).write.parquet(place)
    found = spark.read.schema(EVENTS).parquet(place)
    ends = found.select("path", "upto") if cursors is None else found.select("path", "upto").union(cursors)
    return found.filter("tag IS NOT NULL"), ends.groupBy("path").agg(F.max("upto").alias("upto"))


def event_rows(rows: DataFrame) -> DataFrame:
    """Rows ``file, ordinal, tag, step, value`` as ``encoded`` takes them: a file's rows in order in one task."""
    return rows.select("file", "ordinal", "tag", "step", "value").repartition("file").sortWithinPartitions("file", "ordinal", "tag", "step", "value")


def encoded(name: str, share: float = 1.0) -> Make:
    """Names and contents of event files, of sorted rows; of each content the first ``share``. A task holds one file and a batch of rows."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, bytes]]:
        each = (r for batch in batches for r in batch.itertuples(index=False))
        for file, rows in groupby(each, lambda r: r.file):
            content = b"".join([framed(version_event(0.0)), *(framed(scalar_event(float(r.ordinal), r.step, r.tag, np.float32(r.value))) for r in rows)])
            yield name % file, content[: int(share * len(content))]

    return make


@query(f"WITH {SCALARS} SELECT tag, step, CAST(arg_max(CAST(value AS FLOAT), ordinal) AS DOUBLE) AS value FROM scalars WHERE ordinal % 13 <> 0 GROUP BY tag, step")
def src_event_records(spark, sf_dir):
    """Event files scanned while their last record is torn, and again when they are whole; later values win."""
    path, cursors, parts = scratch(spark, "runs"), None, []
    rows = scalars(spark, sf_dir).withColumn("value", F.when(F.col("ordinal") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    files = event_rows(rows.withColumn("file", F.floor(F.col("ordinal") / 400)))
    for share in (0.7, 1.0):
        write_files(files, path, encoded("run_%d/events.out.tfevents.0", share))
        found, cursors = scan_events(spark, path, cursors)
        parts.append(found)
    seen = parts[0].union(parts[1])
    return last_by_step(seen.withColumnRenamed("wall_time", "ordinal"))
