"""Runs of words that repeat with a period, found on a harmonic grid.

A run is a stretch of words with smallest period q, of ``least`` words and ``times`` periods at
least, that neither neighbour extends. For every period p, grid points stand 3 p apart: the sum
over the periods is harmonic, n log n points a text of n words. A run that holds four periods holds a grid
point g of its own period with both g and g + p in it, so it is found from there: the longest common
extensions of g and g + p, forwards and backwards, are its borders. All pairs of a period and a
grid point, of all texts of a portion, are searched at once: binary search over the lengths, in
which numpy compares prefix hashes. The words of what is found are compared one by one; if a hash
has lied, the portion is searched again with another base. Of one stretch the smallest period stays.

No shuffle: a text is searched where it is read. A worker holds a portion of texts of bounded
size, or one longer text, and ``POINTS`` pairs at a time.

Edge cases: null, empty and white texts have no words; rows that repeat an id or a text
are worked on row by row; an empty table gives an empty result; other columns, whatever their
names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import portions

#: Fixed values of a run.
LEAST, TIMES = 6, 4
PRIME = (1 << 31) - 1
POINTS = 1 << 19
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

#: For a row's id and its number of words: from which word on, and with which period, its words are an echo; or None.
Echo = Callable[[int | None, int], tuple[int, int] | None]


class Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Hashes:
    """Prefix hashes of a sequence of numbers, modulo a prime, to a base of one's own."""

    def __init__(self, numbers: np.ndarray, base: int):
        self.powers = np.ones(1, np.int64)
        while len(self.powers) < len(numbers):
            step = self.powers[-1] * base % PRIME
            self.powers = np.concatenate([self.powers, self.powers * step % PRIME])
        values = (numbers * (base // 2) + base // 3) % PRIME * self.powers[: len(numbers)] % PRIME
        self.before = np.concatenate([[0], np.cumsum(values) % PRIME])

    def same(self, at: np.ndarray, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches from ``at`` and from ``at + apart`` seem equal."""
        one = (self.before[at + length] - self.before[at]) % PRIME * self.powers[apart] % PRIME
        return one == (self.before[at + apart + length] - self.before[at + apart]) % PRIME


def longest(same: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """Of each pair the greatest length up to ``most`` at which it is the ``same``, by one binary search for all."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        yes = same(middle)
        low, high = np.where(yes, middle, low), np.where(yes, high, middle - 1)
    return low


def grid(begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``point, period, begin, end``, some at a time: the grid points of every text and period, with the text's borders."""
    most = np.where(sizes >= LEAST, sizes // TIMES, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = (sizes[text] - 1 - period) // (3 * period) + 1
    upto = np.cumsum(points)
    at = 0
    while at < len(text):
        until = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + POINTS, "right")))
        t, p, c = text[at:until], period[at:until], points[at:until]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        t, p = np.repeat(t, c), np.repeat(p, c)
        yield begins[t] + 3 * p * k, p, begins[t], begins[t] + sizes[t]
        at = until


def found_runs(numbers: np.ndarray, begins: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray | None:
    """Rows ``start, end, period`` of all texts, sorted; None if a hash took different words for equal."""
    hashes, found = Hashes(numbers, base), [np.zeros((0, 3), np.int64)]
    for point, period, begin, end in grid(begins, sizes):
        hit = np.flatnonzero(numbers[point] == numbers[point + period])  # others extend by nothing
        g, p, begin, end = point[hit], period[hit], begin[hit], end[hit]
        ahead = longest(lambda n: hashes.same(g, p, n), end - g - p)  # noqa: B023
        back = longest(lambda n: hashes.same(g - n, p, n), g - begin)  # noqa: B023
        runs = np.stack([g - back, g + p + ahead, p], axis=1)
        found.append(np.unique(runs[runs[:, 1] - runs[:, 0] >= np.maximum(LEAST, TIMES * p)], axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    if all(np.array_equal(numbers[s : e - p], numbers[s + p : e]) for s, e, p in runs):
        return runs
    return None


def all_runs(numbers: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``found_runs`` with the first base whose hashes hold against the words."""
    draw = np.random.default_rng(len(numbers))
    while (runs := found_runs(numbers, begins, sizes, int(draw.integers(1 << 20, PRIME)))) is None:
        pass
    return runs


def worked(batch: pd.DataFrame, echo: Echo | None) -> pd.DataFrame:
    said = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch["text"]]
    ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
    for k, (doc_id, words) in enumerate(zip(ids, said, strict=True)):
        if echo and words and (from_on := echo(doc_id, len(words))):
            a, p = from_on
            said[k] = words[:a] + (words[a : a + p] * (1 + (len(words) - a) // p))[: len(words) - a]
    sizes = np.array([len(w) for w in said], np.int64)
    begins = np.cumsum(sizes) - sizes
    index = Numbers()
    numbers = np.fromiter((n for w in said for n in map(index.__getitem__, w)), np.int64, int(sizes.sum()))
    runs = all_runs(numbers, begins, sizes)

    # How many runs begin to drop a word here, less those that end.
    edges = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    owner = np.searchsorted(begins + sizes, runs[:, 0], "right")
    per = [[] for _ in said]
    for (s, e, p), k in zip(runs.tolist(), owner.tolist(), strict=True):
        per[k].append({"start": s - int(begins[k]), "length": e - s, "period": p})
    collapsed = [
        b" ".join(w if not r else [x for x, stays in zip(w, kept[b : b + n], strict=True) if stays]).decode("utf-8", "surrogatepass")
        for w, r, b, n in zip(said, per, begins, sizes, strict=True)
    ]
    for r in per:
        r.sort(key=lambda x: (x["start"], x["period"]))
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": sizes, "runs": per, "collapsed": collapsed})


def _search(echo: Echo | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(worked, portions(batches), repeat(echo))

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", echo: Echo | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row: its runs by start and period, and its text without their repeats.

    A word goes if any run holds it after that run's first period. ``echo`` may make a row's words
    repeat before they are searched: word i from ``a`` on becomes word ``a + (i - a) % p``.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInPandas(_search(echo), SCHEMA)
