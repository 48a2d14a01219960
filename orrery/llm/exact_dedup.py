"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition is a run of (digest, best row) entries, cut into ranges of digests.
Runs meet in binomial rounds: in round r, ``fan_in`` neighbouring runs merge into one, range by
range: a task gets the sorted segments of its runs, sorts them into one and walks along it, keeping one
verified best row for each digest. Only digests travel, never texts; a segment holds about
``segment_rows`` entries at most, and a digest has at most ``fan_in`` entries in any merge, however
many copies it has. The winners then go back down the same tree, so no step gathers the copies of
one text.

Edge cases: a null text counts as empty; empty texts are equal to each other; a null
id ranks after every other id and may still be kept, ``keep_id`` is then null; of rows
that repeat an id and a text exactly one is kept; an empty table gives an empty
result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row for each input row; ``check`` verifies what ``digest`` claims."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        normalised(text).alias("norm"),
        F.char_length(text).alias("chars"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
    ).select(
        "doc_id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm", F.char_length("norm")).alias("check"),
        F.struct(
            (-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"
        ).alias("best"),
        "run",
    )


def merged(runs: DataFrame, run: Column) -> DataFrame:
    """Multiway merge of the sorted runs that share ``run``, range by range: one entry for each digest, sorted.

    The aggregation runs along the sorted rows: they are neither hashed nor shuffled again for it.
    """
    keys = ("range", "run", "digest", "check")
    together = runs.withColumn("run", run).repartition("range", "run").sortWithinPartitions(*keys)
    return together.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16, segment_rows: int = 1_000_000) -> DataFrame:
    """Rows ``doc_id, keep_id, group_size, kept, text_sha256``, one for each input row.

    Texts are equal when identical without ASCII white space. The row with the most
    code points in its original text stays, then the smallest id.
    """
    sigs = cut(signatures(docs, id_col, text_col))
    top, rows = sigs.agg(F.max("run"), F.count("*")).first()
    ranges = 1 + rows // segment_rows
    high = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    sigs = sigs.withColumn("range", F.shiftright(high * ranges, 32).cast("int"))
    levels, top = [cut(merged(sigs.withColumn("n", F.lit(1).cast("long")), F.col("run")))], top or 0
    while top:
        top //= fan_in
        levels.append(cut(merged(levels[-1], F.floor(F.col("run") / fan_in).cast("int"))))
    winners = levels.pop()
    for level in reversed(levels):
        lower = level.select("range", "run", F.floor(F.col("run") / fan_in).cast("int").alias("upper"), "digest", "check")
        upper = winners.withColumnRenamed("run", "upper")
        winners = lower.join(upper, ["range", "upper", "digest", "check"]).drop("upper")
    won = winners.withColumnRenamed("best", "winner").drop("range")
    return sigs.join(won, ["run", "digest", "check"]).select(
        F.col("best.doc_id").alias("doc_id"),
        F.col("winner.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best.row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    own, sha, row = fresh(docs, "id", "sha", "row")
    kept = cut(exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha)))
    number, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    mine = F.sha2(normalised(text), 256)
    rows = docs.join(kept, number.eqNullSafe(F.col(own)) & (mine == F.col(sha)), "left_semi")
    # Rows that repeat both id and text would all pass the join; only then is a second step due.
    repeated = docs.groupBy(number).count().filter("count > 1").limit(1).count()
    if repeated:
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        length = F.char_length(F.coalesce(text, F.lit("")))
        rows = rows.groupBy(number.alias(own), mine.alias(sha)).agg(F.max_by(whole, length).alias(row)).select(f"`{row}`.*")
    return rows
