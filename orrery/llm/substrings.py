"""Substring dedup by hashing units of lines.

Units are lines. A line of more than ``2 * reach`` words is cut further, before words whose hash is the
smallest within ``reach`` words to both sides: these borders depend on the words around them
alone, so that they lie alike in a passage that was pasted into the middle of another line. A
unit is normalised (lower case, single spaces) and hashed to 128 bits; the digests are grouped
over all documents. The occurrence ranked first, by id and then place, stays; the others
are repeats. Neighbouring repeats, and the white space between them, make one span, and
spans of ``least_span`` words or more are removed, in code points of the original text. A
single line that many documents share stays: it is a phrase, not a passage.

What is missed: the words of a pasted passage before its first border and after its last, where
it does not start or end with a line; and so passages much shorter than twice ``least_span``.

Texts are read and hashed in one pass, whose rows are written once. Digests are counted with partial
aggregation, and occurrences meet those that repeat by key. The few digests that have more than
one of ``SHARE`` of all occurrences, fewer than ``SHARE`` therefore, are known to all tasks, and their
occurrences are dealt over salts: no task holds the occurrences of such a digest.

Edge cases: null and empty texts have no units; a document of any length is one row; a null
id ranks last; rows that repeat an id, or have none, rank by their place in the table, and each
is a document; repeats within one document count as well; an empty table gives an empty
result; other columns, whatever their names, are not looked at, and ``remove_repeats`` returns
them as they were.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Remembered, cut, fresh, parts, written

REACH, LEAST_SPAN = 4, 25
SALTS, SHARE = 1_024, 10_000
WORD, LINE = re.compile(r"\S+"), re.compile("\n")
UNITS = "doc_id long, row long, unit int, start int, end int, words int, high long, low long"
U = np.uint64


def word_key(word: str) -> int:
    """The first half of a word's MD5, which any engine has."""
    return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "big")


def borders(keys: np.ndarray, lines: np.ndarray, reach: int) -> np.ndarray:
    """Whether a unit starts before each word: lines do, and words with the least key within ``reach`` words of their line."""
    n = len(keys)
    starts = np.ones(n, bool)
    starts[1:] = lines[1:] != lines[:-1]
    if n > 2 * reach:
        # Strict to the left only: of equal keys that are near, the first is the border.
        least = np.ones(n - 2 * reach, bool)
        here = keys[reach : n - reach]
        for step in range(1, reach + 1):
            least &= here < keys[reach - step : n - reach - step]
            least &= here <= keys[reach + step : n - reach + step]
        least &= lines[: n - 2 * reach] == lines[2 * reach :]
        starts[reach : n - reach] |= least
    return starts


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def units(text: str, reach: int, keys: dict[str, int]) -> tuple[np.ndarray, ...]:
    """``start, end, words, high, low`` of each unit of a text; the last two are its 128-bit digest.

    A half of the digest is the sum of the words' keys, each mixed with its place in the unit.
    """
    spans = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
    if not len(spans):
        return (np.zeros(0, np.int64),) * 5
    ends = np.array([m.start() for m in LINE.finditer(text)], np.int64)
    said = np.fromiter(map(keys.__getitem__, [w.lower() for w in WORD.findall(text)]), U, len(spans))
    at = np.flatnonzero(borders(said, np.searchsorted(ends, spans[:, 0]), reach))
    words = np.diff(np.append(at, len(said)))
    place = (np.arange(len(said)) - np.repeat(at, words)).astype(U)
    halves = (np.add.reduceat(mixed(said + place * U(odd)), at) for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
    return spans[at, 0], spans[at + words - 1, 1], words, *(mixed(h + words.astype(U)).astype(np.int64) for h in halves)


def hashed(reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = Remembered(word_key, 200_000)
        for batch in parts(batches):
            found = [units(t, reach, keys) for t in batch["text"]]
            many = np.array([len(f[0]) for f in found], np.int64)
            start, end, words, high, low = (np.concatenate(x) for x in zip(*found, strict=True))
            unit = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].repeat(many).array, "row": np.repeat(batch["row"].to_numpy(), many), "unit": unit,
                "start": start, "end": end, "words": words, "high": high, "low": low,
            })

    return run


def occurrences(docs: DataFrame, reach: int, id_col: str, text_col: str, row: Column) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInPandas(hashed(reach), UNITS)


def repeats(
    docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None
) -> DataFrame:
    """Repeated units: ``doc_id, row, unit, start, end, words, first_doc_id, first_start, copies``.

    ``row`` tells the rows of ``docs`` apart.
    """
    digest = ["high", "low"]
    found = written(occurrences(docs, reach, id_col, text_col, F.monotonically_increasing_id() if row is None else row), "units")
    repeated = found.groupBy(*digest).agg(F.count("*").alias("copies")).filter("copies > 1")
    repeated = written(repeated.withColumn("hot", F.col("copies") > 1 + found.count() // SHARE), "digests")
    hot = F.broadcast(repeated.filter("hot").select(*digest, F.lit(True).alias("hot")))  # SHARE rows at most
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    sent = found.join(hot, digest, "left").withColumn("salt", salt).drop("hot")
    again = written(sent.join(repeated.withColumn("salt", F.explode(salts)).drop("hot"), [*digest, "salt"]), "repeats")
    again = again.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "start"))
    first = again.groupBy(*digest, "salt").agg(F.min("rank").alias("first"))
    # A digest has SALTS rows here at most, so its window is bounded.
    first = first.select(*digest, "salt", F.min("first").over(Window.partitionBy(*digest)).alias("first"))
    return again.join(first, [*digest, "salt"]).filter("rank != first").select(
        "doc_id", "row", "unit", "start", "end", "words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), "copies"
    )


def repeated_spans(
    docs: DataFrame, reach: int = REACH, least_span: int = LEAST_SPAN, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None
) -> DataFrame:
    """One row a removed span: ``doc_id, start, end, units, words, first_doc_id, first_start, row``.

    ``first_doc_id`` and ``first_start`` are where the span's first unit stays.
    """
    found = repeats(docs, reach, id_col, text_col, row)
    place = F.row_number().over(Window.partitionBy("row").orderBy("unit"))  # one document
    joined = found.withColumn("island", F.col("unit") - place)
    return joined.groupBy("row", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("units"), F.sum("words").alias("words"),
        F.min(F.struct("unit", "first_doc_id", "first_start")).alias("first"),
    ).filter(F.col("words") >= least_span).select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "units", "words",
        F.col("first.first_doc_id").alias("first_doc_id"), F.col("first.first_start").cast("long").alias("first_start"), "row",
    )


def remove_repeats(docs: DataFrame, reach: int = REACH, least_span: int = LEAST_SPAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the removed spans; what a null text was stays null.

    The rows get their number once and for all, in a copy of ``docs`` in the shared folder.
    """
    row, cuts = fresh(docs, "row", "cuts")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    spans = repeated_spans(rows, reach, least_span, id_col, text_col, F.col(f"`{row}`")).groupBy(F.col("row").alias(row)).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts)  # one document
    )

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, cuts, strict=True):
            at, kept = 0, []
            for s in spans if spans is not None and text is not None else ():
                kept.append(text[at : s["start"]])
                at = s["end"]
            out.append("".join([*kept, text[at:]]) if kept else text)
        return pd.Series(out, dtype=object)

    joined = rows.join(spans, row, "left")
    text = without(F.col(f"`{text_col}`"), F.col(f"`{cuts}`"))
    return joined.select(*[(text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])
