"""Exact top-k inner-product search by a three-phase uniform threshold.

Components are dealt into ``lists`` dimension groups. Each group is a table of its own, in
blocks of rows, and gives every row a partial score for a query; the score is the sum of the
partial ones. The phases see one group at a time:

1. Each list reports the rows that lead it, for each query. The other partial scores of these
   few rows are resolved, and their k-th best score is a safe cutoff: k rows reach it.
2. The cutoff goes to the lists. A row that reaches it has a partial score of at least
   cutoff / lists in some list, so each list collects the rows that do: enough.
3. For each pair of blocks the lists' collections meet. Partial scores that a list has
   reported are taken as they are, the missing ones of the collected rows are resolved, and
   the k best of each query that reach the cutoff travel on.

Query blocks meet row blocks by key, one task a pair of blocks and list; vectors and
collections travel as packed integers. No block holds more than about ``block_rows`` rows.

Edge cases: vectors that are null, empty or hold a null or non-finite component take no
part; vectors meet only those of their own dimension; a query with fewer candidates than k
returns all; ties go to the smaller id; rows that repeat an id are each a query and a candidate,
and a row is no candidate of itself only; null ids take no part; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

ENTRY = np.dtype([("qi", "<i4"), ("ci", "<i4"), ("part", "<i8")])
NEVER = np.iinfo(np.int64).min
COLLECTED = "dim int, q int, c int, list int, n long, entries binary"


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``row, vec_id, dim, v``: usable rows with a number of their own, components as floor(scale * x)."""
    v = F.col(f"`{vector_col}`")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, sound))
    return usable.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.size(v).alias("dim"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


def blocked(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """Rows gathered into blocks, one row a block and dimension: ids, row numbers and components, by id."""

    def run(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["vec_id", "row"])
        matrix = np.stack([np.asarray(v, dtype=np.int64) for v in batch["v"]])
        if np.abs(matrix).max() < 1 << 15:
            matrix = matrix.astype(np.int16)
        ids, numbers = (batch[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "row"))
        return pd.DataFrame({"dim": [key[0]], name: [key[1]], f"{name}_ids": [ids], f"{name}_own": [numbers], f"{name}_rows": [matrix.tobytes()]})

    key = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias(name)
    schema = f"dim int, {name} int, {name}_ids binary, {name}_own binary, {name}_rows binary"
    return rows.select("row", "vec_id", "dim", "v", key).groupBy("dim", name).applyInPandas(run, schema)


def groups(dim: int, lists: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), lists)


def matrix(data: bytes, count: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * count * width else np.int64).reshape(count, width)


def listed(blocks: DataFrame, lists: int, name: str) -> DataFrame:
    """Blocks by list: the components of one dimension group, and the rows' numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, block, own, data in batch.itertuples(index=False):
                whole = matrix(data, len(own) // 8, dim)
                parts = [np.ascontiguousarray(whole[:, g]).tobytes() for g in groups(dim, lists)]
                yield pd.DataFrame({"dim": dim, "list": range(lists), name: block, f"{name}_own": [own] * lists, f"{name}_part": parts})

    schema = f"dim int, list int, {name} int, {name}_own binary, {name}_part binary"
    return blocks.select("dim", name, f"{name}_own", f"{name}_rows").mapInPandas(run, schema)


def partial_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact: through floats while sums stay within their whole numbers."""
    largest = int(np.abs(q.astype(np.int64)).max(initial=0)) * int(np.abs(c.astype(np.int64)).max(initial=0)) * q.shape[1]
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


def by_list(pick: Callable[[np.ndarray, np.ndarray], np.ndarray], lists: int, rows_at_once: int):
    """For a pair of blocks of one list the entries that ``pick`` takes from the partial scores and cutoffs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_own, c_own = np.frombuffer(r.q_own, np.int64), np.frombuffer(r.c_own, np.int64)
                width = len(groups(r.dim, lists)[r.list])
                q, c = matrix(r.q_part, len(q_own), width), matrix(r.c_part, len(c_own), width)
                cutoff, found = spread(r.cutoffs, len(q_own)), []
                for at in range(0, len(q_own), rows_at_once):
                    part = partial_scores(q[at : at + rows_at_once], c)
                    other = q_own[at : at + rows_at_once, None] != c_own[None, :]
                    qi, ci = np.nonzero(pick(np.where(other, part, NEVER), cutoff[at : at + rows_at_once, None]) & other)
                    out = np.empty(len(qi), ENTRY)
                    out["qi"], out["ci"], out["part"] = qi + at, ci, part[qi, ci]
                    found.append(out)
                entries = np.concatenate(found)
                yield pd.DataFrame({"dim": [r.dim], "q": [r.q], "c": [r.c], "list": [r.list], "n": [len(entries)], "entries": [entries.tobytes()]})

    return run


def leaders(count: int):
    def pick(part: np.ndarray, cutoff: np.ndarray) -> np.ndarray:
        few, out = min(count, part.shape[1]), np.zeros(part.shape, bool)
        np.put_along_axis(out, np.argpartition(part, part.shape[1] - few, axis=1)[:, part.shape[1] - few :], True, axis=1)
        return out

    return pick


def enough(lists: int):
    """Partial scores of cutoff / lists or more, in whole numbers."""
    return lambda part, cutoff: part >= -(-cutoff // lists)


def spread(cutoffs: bytes | None, count: int) -> np.ndarray:
    """The cutoff of each query of a block; without one, none is too low."""
    out = np.full(count, NEVER // 2)
    if cutoffs is not None:
        pairs = np.frombuffer(cutoffs, np.int64).reshape(-1, 2)
        out[pairs[:, 0]] = pairs[:, 1]
    return out


def resolved(k: int, lists: int):
    """The collections of a pair of blocks to full scores: of each query the k best that reach its cutoff."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids, c_ids = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.c_ids, np.int64)
                c_own = np.frombuffer(r.c_own, np.int64)
                q, c = matrix(r.q_rows, len(q_ids), r.dim), matrix(r.c_rows, len(c_ids), r.dim)
                lists_of = [np.frombuffer(e["entries"], ENTRY) for e in r.collected]
                code = [e["qi"].astype(np.int64) * len(c_ids) + e["ci"] for e in lists_of]
                pairs, at = np.unique(np.concatenate(code), return_inverse=True)
                qi, ci = np.divmod(pairs, len(c_ids))
                part, known = np.zeros((lists, len(pairs)), np.int64), np.zeros((lists, len(pairs)), bool)
                ends = np.cumsum([0, *map(len, code)])
                for e, entries, a, b in zip(r.collected, lists_of, ends, ends[1:], strict=False):
                    part[e["list"], at[a:b]], known[e["list"], at[a:b]] = entries["part"], True
                for g, dims in enumerate(groups(r.dim, lists)):
                    for rest in np.array_split(np.flatnonzero(~known[g]), 1 + len(pairs) // 65_536):
                        x, y = q[np.ix_(qi[rest], dims)].astype(np.int64), c[np.ix_(ci[rest], dims)].astype(np.int64)
                        part[g, rest] = np.einsum("ij,ij->i", x, y)
                score = part.sum(0)
                good = score >= spread(r.cutoffs, len(q_ids))[qi]
                qi, ci, score = qi[good], ci[good], score[good]
                # Rows of a block are in the order of ids, so a stable sort settles ties.
                order = np.lexsort((ci, -score, qi))
                qi, ci, score = qi[order], ci[order], score[order]
                starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.zeros(0, np.int64)
                place = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
                best = place < k
                yield pd.DataFrame({
                    "dim": r.dim, "q": r.q, "qi": qi[best], "query_id": q_ids[qi[best]], "vec_id": c_ids[ci[best]], "own": c_own[ci[best]], "score": score[best]
                })

    return run


class Search:
    """Blocks of queries and rows, by list and whole, and the phases over them."""

    def __init__(self, rows: DataFrame, wanted: Column, k: int, lists: int, block_rows: int, query_rows: int, rows_at_once: int):
        self.k, self.lists, self.at_once = k, lists, rows_at_once
        counts = rows.agg(F.count("*").alias("c"), F.count_if(wanted).alias("q")).first()
        self.n_c, self.n_q = max(1, -(-counts["c"] // block_rows)), max(1, -(-counts["q"] // query_rows))
        self.rows, self.queries = cut(blocked(rows, self.n_c, "c")), cut(blocked(rows.filter(wanted), self.n_q, "q"))
        self.row_lists, self.query_lists = (cut(listed(b, lists, n)) for b, n in ((self.rows, "c"), (self.queries, "q")))
        # Tasks of much work and few bytes: as many as there are pairs of blocks, within reason.
        pairs = self.n_c * self.n_q * lists
        self.tasks = max(1, min(pairs, max(2 * rows.sparkSession.sparkContext.defaultParallelism, pairs // 8)))

    def collected(self, pick, cutoffs: DataFrame | None) -> DataFrame:
        """``dim, q, c, list, n, entries``: what each list reports for each pair of blocks."""
        sent = self.query_lists
        sent = sent.withColumn("cutoffs", F.lit(None).cast("binary")) if cutoffs is None else sent.join(cutoffs, ["dim", "q"], "left")
        every = F.explode(F.sequence(F.lit(0), F.lit(self.n_c - 1)))
        met = sent.withColumn("c", every).join(self.row_lists, ["dim", "list", "c"]).repartition(self.tasks, "dim", "list", "q", "c")
        return met.mapInPandas(by_list(pick, self.lists, self.at_once), COLLECTED).filter("n > 0")

    def scored(self, collected: DataFrame, cutoffs: DataFrame | None) -> DataFrame:
        """``dim, q, qi, query_id, vec_id, own, score`` of what the lists have collected."""
        met = collected.groupBy("dim", "q", "c").agg(F.collect_list(F.struct("list", "entries")).alias("collected"))  # one entry a list
        met = met.join(self.queries.drop("q_own"), ["dim", "q"]).join(self.rows, ["dim", "c"])
        met = met.withColumn("cutoffs", F.lit(None).cast("binary")) if cutoffs is None else met.join(cutoffs, ["dim", "q"], "left")
        return met.repartition(self.tasks, "dim", "q", "c").mapInPandas(
            resolved(self.k, self.lists), "dim int, q int, qi int, query_id long, vec_id long, own long, score long"
        )

    def best(self, scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("dim", "q", "qi").orderBy(F.col("score").desc(), "vec_id", "own")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k)

    def cutoffs(self) -> DataFrame:
        """``dim, q, cutoffs``: a safe cutoff for each query that has k candidates, packed by block."""
        leading = self.collected(leaders(max(1, -(-4 * self.k // self.n_c))), None)
        kth = self.best(self.scored(leading, None)).groupBy("dim", "q", "qi").agg(F.count("*").alias("n"), F.min("score").alias("cutoff"))

        def pack(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"dim": [key[0]], "q": [key[1]], "cutoffs": [found[["qi", "cutoff"]].to_numpy(np.int64).tobytes()]})

        return kth.filter(F.col("n") == self.k).groupBy("dim", "q").applyInPandas(pack, "dim int, q int, cutoffs binary")


def exact_top_k(
    vectors: DataFrame,
    is_query: Callable[[Column], Column],
    k: int = 20,
    scale: int = 64,
    lists: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = 4_096,
    query_rows: int = 1_024,
    rows_at_once: int = 128,
) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: each query's k highest integer inner products.

    ``is_query`` picks the queries by their id column; candidates are all other rows.
    """
    rows = cut(quantised(vectors, id_col, vector_col, scale))
    search = Search(rows, is_query(F.col("vec_id")), k, lists, block_rows, query_rows, rows_at_once)
    cutoffs = cut(search.cutoffs())
    found = search.best(search.scored(cut(search.collected(enough(lists), cutoffs)), cutoffs))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
