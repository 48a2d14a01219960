"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. A document is of
one latent class: good, or one of several kinds of bad, for each of which several labellers look.
Expectation-maximisation over the counts of vote patterns, which cover all documents and are
bounded by the number of patterns, estimates how often each labeller votes what on each class,
and a posterior for each pattern: labellers are weighed by what they are found to be worth, and one
false alarm does not make a document bad. The posteriors label a sample of documents, and a
linear scorer over hashed words and word shapes learns from them; it then scores every
document over its whole text.

Measures of short texts are drawn towards the middle, where labellers do not vote, by a few made-up words.
The sample that fits the scorer is bounded by ``sample`` (default 3,000 documents, the
smallest by a hash of the row); all else covers all rows. The labellers' limits and ``REJECT`` were set by
the table ``labels`` of sf0.1.

Edge cases: null and empty texts get no votes, and the score of no words; texts of
any length are scored whole; repeated rows give repeated rows; null ids are rows like others; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Remembered, parts

WIDTH = 1024
GOOD, BAD, NONE = 0, 1, 2
REMEMBERED = 150_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*+<=>@\\^_`{|}~")] = True
UPPER, LETTER = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
END = re.compile(r"[.!?\n]+")
TAIL = re.compile(r"[#$%&*+<=>@\\^_`{|}~]{2,}(?!\S)")
#: Made-up words, letters and sentences at the middle of each measure.
WORDS, LETTERS, SENTENCES = 4, 20, 2


def measures(text: str, words: list[str]) -> tuple[float, ...]:
    """Shares: symbols and symbol tails, capitals, shouted words and exclamations, repeats of words, pairs and sentences, bars."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, letters, k = len(text), int(counts[LETTER].sum()), len(words)
    sentences = [s for s in map(str.strip, END.split(text)) if s]
    next_ones = words[1:]
    drawn = lambda x, of, middle, more: (float(x) + middle * more) / (of + more)
    return (
        drawn(counts[SYMBOLS].sum(), n, 0.02, LETTERS),
        drawn(len(TAIL.findall(text)), k, 0.1, WORDS),
        drawn(counts[UPPER].sum(), letters, 0.3, LETTERS),
        drawn(sum(map(str.isupper, words)), k, 0.3, WORDS),
        drawn(counts[ord("!")], k, 0.2, WORDS),
        drawn(sum(map(operator.eq, words, next_ones)), k, 0.1, WORDS),
        drawn(len(set(words)), k, 0.4, WORDS),
        drawn(len(set(zip(words, next_ones, strict=False))), len(next_ones), 0.7, WORDS),
        drawn(len(set(sentences)), len(sentences), 0.7, SENTENCES),
        drawn(counts[ord("|")], k, 0.1, WORDS),
        drawn(sum(map((4).__gt__, map(len, words))), k, 0.15, 5 * WORDS),
    )


#: Each labeller: its measure, the kind of badness that it looks for, where it votes good, where it votes bad.
LABELLERS = (
    ("symbols", 0, 0, lambda x: x < 0.015, lambda x: x > 0.04),
    ("tails", 1, 0, lambda x: x < 0.05, lambda x: x > 0.2),
    ("long words", 10, 0, lambda x: x > 0.2, lambda x: x < 0.1),
    ("capitals", 2, 1, lambda x: x < 0.2, lambda x: x > 0.5),
    ("shouting", 3, 1, lambda x: x < 0.15, lambda x: x > 0.5),
    ("exclaiming", 4, 1, lambda x: x < 0.1, lambda x: x > 0.4),
    ("stutter", 5, 2, lambda x: x < 0.05, lambda x: x > 0.2),
    ("variety", 6, 2, lambda x: x > 0.5, lambda x: x < 0.25),
    ("pairs", 7, 2, lambda x: x > 0.85, lambda x: x < 0.5),
    ("sentences", 8, 2, lambda x: x > 0.85, lambda x: x < 0.5),
    ("bars", 9, 3, lambda x: x < 0.05, lambda x: x > 0.2),
)
KINDS = 4
#: Pseudo-votes of each labeller on each class that keep a vote from being impossible.
SMOOTH = 0.5
#: The fit weighs both classes alike though most documents are good, so rejection asks for more than a half.
REJECT = 0.8
WORST = float(np.log(REJECT / (1 - REJECT)))


def votes(text: str, words: list[str]) -> int:
    """The vote pattern as a number in base 3; without words no labeller votes."""
    if not words:
        return 3 ** len(LABELLERS) - 1
    m, out = measures(text, words), 0
    for _, k, _, good, bad in LABELLERS:
        out = 3 * out + (GOOD if good(m[k]) else BAD if bad(m[k]) else NONE)
    return out


def patterns(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3 ** (len(LABELLERS) - 1 - j) % 3 for j in range(len(LABELLERS))], 1).astype(np.int8)


def posteriors(codes: np.ndarray, counts: np.ndarray, rounds: int = 200, settled: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(bad | pattern), P(good or bad | vote, class) of each labeller, and the classes' shares, by expectation-maximisation.

    The classes are good and one for each kind of badness, and votes are independent within a
    class; a labeller that does not vote tells nothing. A pattern starts in the kind for which most labellers raise it, with the share of that kind's
    labellers that do; then shares and tables take turns until the likelihood has settled.
    """
    seen = patterns(codes)
    of = np.array([kind for _, _, kind, _, _ in LABELLERS])
    raised = np.stack([(seen[:, of == k] == BAD).mean(1) for k in range(KINDS)], 1)
    share = np.concatenate([1 - raised.max(1, keepdims=True), raised * (raised == raised.max(1, keepdims=True))], 1)
    share /= share.sum(1, keepdims=True)
    before = -np.inf
    for _ in range(rounds):
        weight = (share * counts[:, None]).T
        prior = (weight.sum(1) + SMOOTH) / (weight.sum() + SMOOTH * len(weight))
        tables = np.stack([[np.bincount(seen[:, j], w, 3)[:NONE] + SMOOTH for j in range(seen.shape[1])] for w in weight])
        tables /= tables.sum(2, keepdims=True)
        said_of = np.concatenate([np.log(tables), np.zeros((*tables.shape[:2], 1))], 2)  # no vote says nothing
        worth = np.log(prior)[:, None] + sum(said_of[:, j][:, seen[:, j]] for j in range(seen.shape[1]))
        most = worth.max(0)
        share = np.exp(worth - most).T
        said = float(counts @ (np.log(share.sum(1)) + most))
        share /= share.sum(1, keepdims=True)
        if said - before <= settled * abs(said):
            break
        before = said
    return 1 - share[:, 0], tables, prior


class Hashed:
    """Hashed counts of words and word shapes as a unit vector, the share of repeats, and a constant."""

    def __init__(self):
        self.known = Remembered(self.ids, REMEMBERED)

    def ids(self, word: str) -> int:
        body = word.strip(".,;:")
        said = f"{'aA'[body.isupper()]}{len(body)}" if body.isalpha() else "m" + re.sub(r"\w+", "w", body)
        shape, name = (zlib.crc32(w.encode("utf-8", "surrogatepass")) % (WIDTH // 2) for w in (said, word.lower()))
        return shape | (WIDTH // 2 + name) << 16

    def __call__(self, words: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        again = (np.diff(ids) == 0).sum() if len(ids) else 0
        x = np.bincount(np.concatenate([ids & 0xFFFF, ids >> 16]), minlength=WIDTH).astype(np.float64)
        return np.concatenate([x / max(1.0, np.sqrt(x @ x)), [again / max(1, len(words)), 1.0]])


def fit(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by Adam; the two classes weigh the same."""
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    balance = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean()))
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (balance * (p - y)) / len(y) + ridge * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def _voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in parts(batches):
        yield pd.DataFrame({"pattern": [votes(t, t.split()) for t in batch["text"]]})


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashed = Hashed()
    for batch in parts(batches):
        words = [t.split() for t in batch["text"]]
        yield pd.DataFrame({"pattern": [votes(t, w) for t, w in zip(batch["text"], words, strict=True)], "x": [hashed(w).astype("<f4").tobytes() for w in words]})


def _scored(weights: np.ndarray, chance: dict[int, float]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = Hashed()
        for batch in parts(batches):
            words = [t.split() for t in batch["text"]]
            score = np.array([hashed(w) @ weights for w in words])
            bad = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
            weak = [chance.get(votes(t, w), 0.5) for t, w in zip(batch["text"], words, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "p_bad_weak": weak, "p_bad": bad, "kept": bad < REJECT})

    return run


class Classifier:
    """A fitted scorer, the patterns' posteriors and the labellers' accuracies."""

    def __init__(self, weights: np.ndarray, chance: dict[int, float], tables: np.ndarray):
        self.weights, self.chance, self.tables = weights, chance, tables


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def draw_limit(rows: float, sample: int) -> int:
    """The largest of the 64-bit hashes that one and a half times ``sample`` of so many rows do not exceed."""
    return min((1 << 63) - 1, -(1 << 63) + int(1.5 * sample / rows * 2.0**64))


def train(docs: DataFrame, sample: int = 3_000, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    rows = _texts(docs, id_col, text_col)
    # The driver gets one count for each vote pattern, of which there are 3 ** 11 at most, whatever the rows.
    seen = rows.mapInPandas(_voted, "pattern int").groupBy("pattern").count().toPandas()
    codes, counts = seen["pattern"].to_numpy(np.int64), seen["count"].to_numpy(np.float64)
    if not len(codes):
        return Classifier(np.zeros(WIDTH + 2), {}, np.zeros((1 + KINDS, len(LABELLERS), 2)))
    chance, tables, _ = posteriors(codes, counts)
    by = dict(zip(codes.tolist(), chance.tolist(), strict=True))
    # A hash limit with room to spare, then exactly the smallest hashes.
    drawn = rows.withColumn("key", F.xxhash64("doc_id", "text")).filter(F.col("key") <= draw_limit(counts.sum(), sample))
    some = drawn.orderBy("key", "doc_id").limit(sample).select("text").mapInPandas(_featured, "pattern int, x binary").toPandas()
    x = np.stack([np.frombuffer(b, "<f4") for b in some["x"]]).astype(np.float64) if len(some) else np.zeros((1, WIDTH + 2))
    y = np.array([by[p] for p in some["pattern"]]) if len(some) else np.zeros(1)
    return Classifier(fit(x, y), by, tables)


def classify(docs: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, p_bad_weak, p_bad, kept``: the labellers' posterior, the scorer's, its verdict."""
    model = model or train(docs, id_col=id_col, text_col=text_col)
    return _texts(docs, id_col, text_col).mapInPandas(_scored(model.weights, model.chance), "doc_id long, p_bad_weak double, p_bad double, kept boolean")


def keep_good(docs: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the scorer rejects, all columns as they were."""
    model = model or train(docs, id_col=id_col, text_col=text_col)
    weights = model.weights

    @F.pandas_udf("boolean")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashed = Hashed()
        for texts in batches:
            yield pd.Series([bool(hashed((t or "").split()) @ weights < WORST) for t in texts], dtype=bool)

    return docs.filter(good(F.col(f"`{text_col}`")))
