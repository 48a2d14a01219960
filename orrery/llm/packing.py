"""Best-fit packing of tokenised documents by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. The program over
the length histogram (at most one entry for each length up to the capacity, whatever
the number of documents) is solved by multiplicative weights: lengths carry prices, a
knapsack dynamic program finds the configurations worth most, and prices move with the
coverage so reached, until the solution is within a hundredth of its lower bound, or no better
for ``PATIENCE`` rounds; the gap that is reached is reported. Prices start from the best of the
functions that are known to give no configuration more than 1. Weights are rounded
down, the program is solved again for what remains, and the last pieces, whose
counts are too small for it, go best fit.
The plan is a bounded list of slot ranges by length; pieces find their slots by their
rank among the pieces of their length, which is counted in salted groups.

Edge cases: a null or empty text is one piece that holds the end token only; texts of
any length are cut at the capacity and nowhere else; an empty table gives an empty
result; repeated ids are separate documents; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import Remembered, cut, parts

CAPACITY, END_ID = 4096, 1
#: The solution's gap to its bound that is asked for; rounds without a better one, and so many steps of prices, that end a program.
GAP, PATIENCE, STEPS = 0.01, 8, 8
#: The same for the programs of what rounding leaves, which are small.
LATER = 2
#: The share of the sizes in the first prices, so that no piece is worth nothing.
BY_SIZE = 0.1
REMEMBERED = 300_000
pack_ids = struct.Struct("<I").pack
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words that need no Unicode normalisation and no contextual lower-casing; what is in no text of such words.
PLAIN = re.compile(r"[\x21-\x7e\xa1-\xff]+").fullmatch
OTHER = re.compile(r"[^\n\x20-\x7e\xa1-\xff]").search
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT = regex.compile(PATTERN).findall
#: After letters, at the end of a word, each is a pre-token of its own.
CLOSING = frozenset(",.;:!?)")


class Lasting(Remembered):
    """``Remembered`` that keeps the last ``room`` words when it is full, beside the next: frequent words stay."""

    def __init__(self, make: Callable[[str], bytes], room: int):
        super().__init__(make, room)
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        made = self.old.get(word)
        if made is None:
            made = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[word] = made
        return made


class Words:
    """Ids of a text by the tokenizer, one word at a time and each new word once.

    The tokenizer drops white space and joins nothing across it, so a text's ids are
    those of its words. A text of plain Latin-1 is lower-cased whole, and of a new word only
    the pre-tokens that are new go through the merges. So do those of a plain word in any other
    text, whose other words go through all of the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.lowered, self.parts = (Lasting(f, REMEMBERED) for f in (self.word, self.low, self.part))
        self.merge = self.tokenizer.model.tokenize
        shown = byte_letters()
        self.letters = str.maketrans({chr(b): shown[b] for b in range(256)})
        self.plain = json.dumps(PATTERN)[1:-1] in self.tokenizer.to_str()

    def part(self, part: str) -> bytes:
        """Of a lower-cased pre-token; plain ASCII is printed as it is."""
        tokens = self.merge(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))
        return b"".join([pack_ids(t.id) for t in tokens])

    def low(self, word: str) -> bytes:
        """Of a plain word in lower case."""
        if word.isalpha():
            return self.part(word)
        if word[-1] in CLOSING and (head := word[:-1]).isalpha():
            return self.lowered[head] + self.parts[word[-1]]
        return b"".join(map(self.parts.__getitem__, SPLIT(word)))

    def word(self, word: str) -> bytes:
        if not word:
            return b""
        if not self.plain or "<|" in word or not PLAIN(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return self.lowered[word.lower()]

    def ids(self, text: str) -> bytes:
        if self.plain and "<|" not in text and not OTHER(text):
            return b"".join(map(self.lowered.__getitem__, text.lower().split()))
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies print each byte as."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def cut_pieces(tokenizer_path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, end = words(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in parts(batches):
            rows = []
            for doc, text in zip(batch["doc_id"].array, batch["text"], strict=True):
                data = made.ids(text) + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInPandas(cut_pieces(tokenizer_path, capacity, end_id), PIECES)


Config = tuple[int, ...]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The best worth of pieces that fit each room from 0 to ``capacity``."""
    best = np.zeros(capacity + 1)
    for room in range(int(lengths[0]), capacity + 1):
        fits = np.searchsorted(lengths, room, "right")
        best[room] = max(best[room - 1], float((best[room - lengths[:fits]] + prices[:fits]).max()))
    return best


def priced_column(
    first: int, lengths: np.ndarray, left: np.ndarray, prices: np.ndarray, best: np.ndarray, capacity: int, allowed: float, looks: int = 40
) -> dict[int, int] | None:
    """A configuration from ``first`` on, within ``left``, that is worth ``best[capacity] - allowed`` at least.

    Depth first, longest piece first: a piece is taken if the optimum for the room that is left to it can
    still make up the worth. Gives up after ``looks`` pieces that lead nowhere.
    """
    held: dict[int, int] = {}
    #: Room, what may still be lost, the piece taken last, and whether it is to be tried.
    path: list[tuple[int, float, int]] = []
    room, spare, below = capacity, allowed, first + 1
    while True:
        fits = min(below, int(np.searchsorted(lengths, room, "right")))
        loss = best[room] - best[room - lengths[:fits]] - prices[:fits]
        ok = np.flatnonzero((left[:fits] > 0) & (loss <= spare))
        k = next((int(j) for j in ok[::-1] if left[j] > held.get(int(j), 0)), None)
        if k is not None:
            path.append((room, spare, k))
            held[k] = held.get(k, 0) + 1
            room, spare, below = room - int(lengths[k]), spare - float(loss[k]), k + 1
            continue
        if best[room] <= spare:
            return held
        looks -= 1
        if looks < 0 or len(path) < 2:
            return None
        room, spare, k = path.pop()
        held[k] -= 1
        below = k


def priced_columns(lengths: np.ndarray, left: np.ndarray, prices: np.ndarray, best: np.ndarray, capacity: int, slack: float) -> list[tuple[Config, int]]:
    """Configurations worth ``(1 - slack) * best[capacity]`` or more, and how often each is used, on the pieces that are ``left``.

    Each starts with the longest piece that none holds yet, and is used until it runs out of a
    length: there are at most as many as lengths.
    """
    left, out = left.copy(), []
    for first in range(len(lengths) - 1, -1, -1):
        while left[first] and (held := priced_column(first, lengths, left, prices, best, capacity, slack * best[capacity])):
            held = {j: n for j, n in held.items() if n}
            times = min(int(left[j]) // n for j, n in held.items())
            for j, n in held.items():
                left[j] -= times * n
            out.append((tuple(sorted(j for j, n in held.items() for _ in range(n))), times))
    return out


def feasible_prices(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Prices at which no configuration is worth more than 1, and the lower bound that they give: the best of three families.

    The share of a sequence; steps, at which pieces of more than a k-th of a sequence count for whole ones; and
    for each small size, that pieces below it count nothing and those that leave no room for it count a sequence.
    """
    share = lengths / capacity
    found = [share]
    for k in range(1, STEPS + 1):
        exact = lengths * (k + 1) % capacity == 0
        found.append(np.where(exact, share, lengths * (k + 1) // capacity / k))
    prices = max(found, key=lambda p: float(counts @ p))
    bound, worth = float(counts @ prices), counts * share
    # Sums from the ends give each small size its bound.
    few, much = np.r_[0, np.cumsum(worth)], np.r_[0, np.cumsum(counts)]
    small = np.flatnonzero(2 * lengths <= capacity)
    large = np.searchsorted(lengths, capacity - lengths[small], "right")
    bounds = few[large] - few[small] + much[-1] - much[large]
    if len(small) and bounds.max() > bound:
        at = small[int(bounds.argmax())]
        bound = float(bounds.max())
        prices = np.where(lengths > capacity - lengths[at], 1.0, np.where(lengths < lengths[at], 0.0, share))
    return prices, bound


def uncovered(columns: dict[Config, float], counts: np.ndarray) -> np.ndarray:
    bare = counts.astype(np.float64).copy()
    for config, weight in columns.items():
        np.subtract.at(bare, list(config), weight)
    return np.maximum(bare, 0.0)


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP, patience: int = PATIENCE, rate: float = 0.2) -> tuple[dict[Config, float], float, float]:
    """The configuration program by multiplicative weights: columns and weights, a lower bound, and the gap to it.

    Minimise the number of sequences such that the configurations cover each length's count.
    In each round the knapsack program prices the rooms, which gives the
    bound ``counts @ prices / best``, and near-optimal columns; what they
    leave uncovered gets dearer by a factor. A round's columns cover no length more than once, and so
    does their mean over the rounds. The cheaper of the two counts, with what it leaves uncovered
    in sequences of one length; the cheapest of all rounds is the solution.
    """
    prices, bound = feasible_prices(lengths, counts, capacity)
    prices, alone = (1 - BY_SIZE) * prices + BY_SIZE * lengths / capacity, capacity // lengths
    total: dict[Config, float] = {}
    found, least, k, better = {}, np.inf, 0, 0
    while k - better < patience:
        k += 1
        best = knapsack(lengths, prices, capacity)
        raised = float(counts @ prices) / best[capacity]
        now = {}
        for config, times in priced_columns(lengths, counts, prices, best, capacity, gap / 2):
            now[config] = now.get(config, 0.0) + times
            total[config] = total.get(config, 0.0) + times
        bare = uncovered(now, counts)
        for columns in (now, {c: w / k for c, w in total.items()} if k > 1 else now):
            cost = sum(columns.values()) + float((uncovered(columns, counts) / alone).sum())
            if cost < least:
                found, least, better = columns, cost, k
        if raised > bound:
            bound, better = raised, k
        if least <= (1 + gap) * bound:
            break
        prices = prices * np.exp(rate * bare / counts)
        prices /= best[capacity]
    return found, bound, least / bound - 1


def rounded(columns: dict[Config, float], left: np.ndarray) -> list[tuple[Config, int]]:
    """The columns' weights rounded down, heaviest first, within what is left; ``left`` is lowered."""
    plan = []
    for config, weight in sorted(columns.items(), key=lambda x: (-x[1], x[0])):
        ids, held = np.unique(config, return_counts=True)
        if (times := min(int(weight + 1e-9), int((left[ids] // held).min()))) > 0:
            left[ids] -= times * held
            plan.append((config, times))
    return plan


def best_fit(plan: list[tuple[Config, int]], lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """``plan`` with all pieces that are left: longest first, each into the fullest sequence that has room."""
    rooms: dict[int, list[tuple[Config, int]]] = {}
    for config, times in plan:
        rooms.setdefault(capacity - int(lengths[list(config)].sum()), []).append((config, times))
    for k in range(len(lengths) - 1, -1, -1):
        size, need = int(lengths[k]), int(left[k])
        while need:
            room = min((r for r in rooms if r >= size and rooms[r]), default=None)
            config, times = rooms[room].pop() if room is not None else ((), -(-need // (capacity // size)))
            if room is None:
                # New sequences take as many copies as fit.
                fits = capacity // size
                whole, rest = divmod(need, fits)
                for copies, n in ((fits, whole), (rest, 1)):
                    if copies and n:
                        rooms.setdefault(capacity - copies * size, []).append(((k,) * copies, n))
                break
            used = min(times, need)
            if times > used:
                rooms[room].append((config, times - used))
            rooms.setdefault(room - size, []).append(((*config, k), used))
            need -= used
    return [x for room in rooms.values() for x in room]


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[str, float]]:
    """A plan for all pieces of the histogram, (lengths, how often); and what made it.

    The program is solved and rounded down, and solved again for what that leaves, until a pass places less
    than a tenth of it: passes grow with the logarithm of the pieces. What the last passes have placed is left to
    best fit if that makes fewer sequences, as it may where lengths are rare or leave room that nothing fills: so there are
    never more than by best fit alone. ``by_columns`` is the number of pieces that the program placed,
    ``bound`` the lower bound of the first solution, ``gap`` how far that is from it.
    """
    full = histogram.get(capacity, 0)
    plan = [((capacity,), full)] if full else []
    lengths = np.array(sorted(n for n, c in histogram.items() if n < capacity and c), dtype=np.int64)
    said = {"bound": float(full), "gap": 0.0, "by_columns": full, "pieces": sum(histogram.values())}
    if not len(lengths):
        return plan, said
    left = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    #: What each pass begins with: the plan so far, and the pieces that are left.
    made: list[tuple[list[tuple[Config, int]], np.ndarray]] = [([], left)]
    while left.any():
        open_ = np.flatnonzero(left)
        columns, bound, gap = fractional(lengths[open_], left[open_], capacity, patience=LATER if len(made) > 1 else PATIENCE)
        if len(made) == 1:
            said |= {"bound": bound + full, "gap": gap}
        now = left[open_]
        taken = [(tuple(int(open_[j]) for j in config), times) for config, times in rounded(columns, now)]
        before, left = int(left.sum()), left.copy()
        left[open_] = now
        made.append((made[-1][0] + taken, left))
        if before - int(left.sum()) < before / 10:
            break
    ends = [(best_fit(some, lengths, rest, capacity), rest) for some, rest in reversed(made)]
    done, rest = min(ends, key=lambda x: sum(times for _, times in x[0]))
    said["by_columns"] = said["pieces"] - int(rest.sum())
    return plan + [(tuple(int(lengths[j]) for j in config), times) for config, times in done], said


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length: rank ``low`` and up of a length sit ``copies`` to a sequence from ``sequence`` on."""
    rows, taken, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for length in sorted(set(config), reverse=True):
            copies = config.count(length)
            low = taken.get(length, 0)
            rows.append((length, low, copies, sequence, offset))
            taken[length] = low + copies * times
            offset += copies * length
        sequence += times
    rows.sort()
    return {k: np.array(v, dtype=np.int64) for k, v in zip(("length", "low", "copies", "sequence", "offset"), zip(*rows, strict=True), strict=True)} if rows else {}


def _placed(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = 1 << 40
        keys = table["length"] * wide + table["low"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch.pop("rank").to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            k = rank - table["low"][at]
            copies = table["copies"][at]
            yield batch.assign(sequence_id=table["sequence"][at] + k // copies, offset=table["offset"][at] + k % copies * length)

    return run


def ranked(cuts: DataFrame, salts: int) -> DataFrame:
    """Each piece's rank, from 0, among the pieces of its length; no window holds a whole length."""
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    )
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    return (
        salted.withColumn("within", within)
        .join(before.drop("count"), ["length", "salt"])
        .withColumn("rank", (F.coalesce("before", F.lit(0)) + F.col("within") - 1).cast("long"))
        .drop("salt", "within", "before")
    )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows_per_salt: int = 20_000,
) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cuts = cut(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    histogram = {r["length"]: r["count"] for r in cuts.groupBy("length").count().collect()}  # at most `capacity` rows
    plan, _ = pack_histogram(histogram, capacity)
    salts = max(16, sum(histogram.values()) // rows_per_salt)
    schema = PIECES + ", sequence_id long, offset long"
    if not plan:
        return cuts.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    return ranked(cuts, salts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(_placed(slots(plan)), schema)
