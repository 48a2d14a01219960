"""Fill-in-middle transformation over an index of distinct texts.

A text is cut at two of its token boundaries, and its parts are put in another order with
sentinels before them. Identical texts have the same boundaries, so they are found once:

1. *Index.* Rows meet by the SHA-256 of their text and, which verifies it, another hash and the length; first within
   each partition, so that a text travels once from each however many copies it has. Its
   boundaries become an Elias-Fano list.
2. *Joining back.* Rows travel as id and digest alone. They have a place among the copies of their
   text, dealt by ranges, and meet the index in groups of ``PER_GROUP``: the first
   of each text where the index lies, the others of texts with more copies in groups of their own.
3. *Cuts.* Id and seed settle form and two boundaries; the list gives their places without
   being unpacked, and the parts are put together by Spark.

Each distinct text is shuffled once, and once more for each group after its first; its list is made once, and once
more if it has more groups than one.

Edge cases: null and empty texts have no tokens and stay plain, as do texts that hold a sentinel; a
null id is hashed as no digits; rows that repeat an id, a text or both give one row each; an empty
table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quantiles import ranked
from .shared import cut

#: Sentinels of prefix, suffix and middle, and the share in a hundred that is cut, and of it in the order suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_PERCENT, SPM_PERCENT, SEED = 50, 80, 42
PER_GROUP = 256
HEAD = struct.Struct(">QQ")
ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


def token_ends(text: str) -> np.ndarray:
    """Where the tokens end, in code points: words with the white space before them, then white space at the end."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = (letters == 0x20) | ((letters >= 0x09) & (letters <= 0x0D))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(letters)) if len(letters) and space[-1] else ends


def packed(ends: np.ndarray, upto: int) -> bytes:
    """The Elias-Fano list of rising numbers up to ``upto``: low bits side by side, high parts in unary."""
    n = len(ends)
    width = max(0, (upto // n).bit_length() - 1) if n else 0
    low = (ends[:, None] >> np.arange(width)) & 1
    unary = np.zeros((upto >> width) + n + 1 if n else 0, np.uint8)
    unary[(ends >> width) + np.arange(n)] = 1
    return HEAD.pack(n, width) + np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()


def selected(data: bytes, k: int) -> int:
    """Where the first ``k`` tokens end: the k-th number of a packed list, 0 for none."""
    if k == 0:
        return 0
    n, width = HEAD.unpack_from(data)
    body = np.frombuffer(data, np.uint8, offset=HEAD.size)
    split = -(-n * width // 8)
    upto = np.cumsum(ONES[body[split:]])
    byte = int(np.searchsorted(upto, k))
    within = np.flatnonzero(np.unpackbits(body[split + byte], bitorder="little"))[k - 1 - int(upto[byte] - ONES[body[split + byte]])]
    at, end = (k - 1) * width, k * width
    bits = np.unpackbits(body[at // 8 : -(-end // 8)], bitorder="little")[at % 8 : at % 8 + width]
    return ((8 * byte + int(within) - (k - 1)) << width) | int(bits @ (1 << np.arange(width)))


@F.pandas_udf(T.BinaryType())
def boundary_lists(text: pd.Series) -> pd.Series:
    return pd.Series([packed(token_ends(t), len(t)) for t in text], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("prefix_chars", T.LongType()), T.StructField("until", T.LongType())]))
def cut_places(bounds: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
    """The places of both cuts; -1 where there is none to make."""
    each = lambda of: [selected(b, int(k)) if k >= 0 else -1 for b, k in zip(bounds, of, strict=True)]
    return pd.DataFrame({"prefix_chars": each(low), "until": each(high)})


KEYS = ["digest", "check"]


def keyed(text: Column) -> list[Column]:
    """What texts are told apart by: their digest, and what verifies it."""
    return [F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text, F.length(text)).alias("check")]


def text_index(docs: DataFrame) -> DataFrame:
    """``digest, check, text, copies`` of rows ``digest, check, text``."""
    return docs.groupBy(*KEYS).agg(F.min("text").alias("text"), F.count("*").alias("copies"))


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: parts hold no sentinel, so each ends at the first one that can follow."""
    after = lambda c, mark: F.substring(c, F.locate(mark, c) + len(mark), F.length(c))
    before = lambda c, mark: F.substring(c, F.lit(1), F.locate(mark, c) - 1)
    body = F.substring(output, F.lit(1 + len(PREFIX)), F.length(output))  # without the sentinel that it begins with
    suffix_then = after(body, SUFFIX)
    psm = F.concat(before(body, SUFFIX), after(suffix_then, MIDDLE), before(suffix_then, MIDDLE))
    prefix_then = after(body, PREFIX)
    spm = F.concat(before(prefix_then, MIDDLE), after(prefix_then, MIDDLE), before(body, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, id_col: str = "doc_id", text_col: str = "text", per_group: int = PER_GROUP
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output, copies``, one row for each input row.

    ``n`` counts the text's tokens, ``copies`` the rows that have it.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    held = docs.select(*keyed(text), text.alias("text"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *keyed(text))
    rows = cut(ranked(cut(rows), KEYS, [F.col("doc_id")], "place").withColumn("group", F.floor(F.col("place") / per_group)).drop("place"))

    index = text_index(held)
    with_bounds = lambda some: some.withColumn("bounds", boundary_lists("text"))
    # A text meets the list of its first rows where the index lies. Both parts read the index's one shuffle.
    ids = F.collect_list(F.struct("doc_id")).alias("ids")
    first = with_bounds(index.join(rows.filter("group = 0").groupBy(*KEYS).agg(ids), KEYS))
    more = with_bounds(index.filter(F.col("copies") > per_group)).withColumn("group", F.explode(F.sequence(F.lit(1).cast("long"), F.floor((F.col("copies") - 1) / per_group))))
    more = more.join(rows.filter("group > 0").groupBy(*KEYS, "group").agg(ids), [*KEYS, "group"]).drop("group")

    met = first.unionByName(more).withColumn("id", F.explode("ids")).select("id.doc_id", "text", "bounds", "copies")
    # The list begins with the number of its entries.
    count = F.conv(F.hex(F.substring("bounds", 1, 8)), 16, 10).cast("long")
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring(said, 8 * k + 1, 8), 16, 10).cast("long")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.col("text").contains(mark)
    plain = (F.col("text") == "") | marked | (h(2) % 100 >= cut_percent)
    met = met.withColumn("n", count).withColumn("form", F.when(plain, "plain").when(h(3) % 100 < spm_percent, "spm").otherwise("psm"))
    one, two = h(0) % (F.col("n") + 1), h(1) % (F.col("n") + 1)
    cuts = lambda c: F.when(F.col("form") == "plain", F.lit(-1).cast("long")).otherwise(c)
    met = met.withColumn("cut", cut_places("bounds", cuts(F.least(one, two)), cuts(F.greatest(one, two)))).drop("bounds")
    a, b = F.col("cut.prefix_chars"), F.col("cut.until")
    part = lambda at, size: F.substring(F.col("text"), at.cast("int") + 1, size.cast("int"))
    output = assembled(F.col("form"), part(F.lit(0), a), part(a, b - a), part(b, F.length("text") - b), F.col("text"))
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return met.select("doc_id", "n", "form", cut_only(a).alias("prefix_chars"), cut_only(b - a).alias("middle_chars"), output.alias("output"), "copies")
