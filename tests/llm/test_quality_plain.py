"""The quality classifier against a second, plain implementation of its votes, features and score."""

import math
import re
import zlib

import pytest
from orrery.llm import quality

from ..conftest import DATA

SYMBOLS = set("#$%&*+<=>@\\^_`{|}~")


def plain_votes(text):
    """The eleven votes in order, from counts of characters and words: g, b or a dot."""
    words = text.split()
    if not words:
        return "." * 11
    data = text.encode()
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in data)
    share = lambda x, of, middle, more: (x + middle * more) / (of + more)
    runs = 0  # runs of symbols at the end of words
    for w in words:
        tail = len(w)
        while tail and w[tail - 1] in SYMBOLS:
            tail -= 1
        runs += len(w) - tail >= 2
    said = [s.strip() for s in re.split(r"[.!?\n]+", text)]
    said = [s for s in said if s]
    pairs = list(zip(words, words[1:], strict=False))
    k = len(words)
    rules = [
        (share(sum(chr(c) in SYMBOLS for c in data if c < 128), len(text), 0.02, 20), lambda x: x < 0.015, lambda x: x > 0.04),
        (share(runs, k, 0.1, 4), lambda x: x < 0.05, lambda x: x > 0.2),
        (share(sum(len(w) < 4 for w in words), k, 0.15, 20), lambda x: x > 0.2, lambda x: x < 0.1),
        (share(sum(65 <= c <= 90 for c in data), letters, 0.3, 20), lambda x: x < 0.2, lambda x: x > 0.5),
        (share(sum(w.isupper() for w in words), k, 0.3, 4), lambda x: x < 0.15, lambda x: x > 0.5),
        (share(text.count("!"), k, 0.2, 4), lambda x: x < 0.1, lambda x: x > 0.4),
        (share(sum(a == b for a, b in pairs), k, 0.1, 4), lambda x: x < 0.05, lambda x: x > 0.2),
        (share(len(set(words)), k, 0.4, 4), lambda x: x > 0.5, lambda x: x < 0.25),
        (share(len(set(pairs)), k - 1, 0.7, 4), lambda x: x > 0.85, lambda x: x < 0.5),
        (share(len(set(said)), len(said), 0.7, 2), lambda x: x > 0.85, lambda x: x < 0.5),
        (share(text.count("|"), k, 0.1, 4), lambda x: x < 0.05, lambda x: x > 0.2),
    ]
    return "".join("g" if good(x) else "b" if bad(x) else "." for x, good, bad in rules)


def plain_features(text):
    """Buckets of words and shapes as a dictionary of unit length, the share of repeats, the constant."""
    words, found, again, last = text.split(), {}, 0, None
    for w in words:
        body = w.strip(".,;:")
        if body.isalpha():
            shape = ("A" if body.isupper() else "a") + str(len(body))
        else:
            shape = "m" + re.sub(r"\w+", "w", body)
        half = quality.WIDTH // 2
        here = (zlib.crc32(shape.encode()) % half, half + zlib.crc32(w.lower().encode()) % half)
        for b in here:
            found[b] = found.get(b, 0) + 1
        again, last = again + (here == last), here
    size = max(1.0, math.sqrt(sum(n * n for n in found.values())))
    return {b: n / size for b, n in found.items()} | {quality.WIDTH: again / max(1, len(words)), quality.WIDTH + 1: 1.0}


def test_votes_features_and_scores_are_the_plain_ones(spark, corpus):
    for docs in (spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"), corpus.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        model = quality.train(docs)
        got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
        kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
        by_votes = {}
        for r in docs.collect():
            text = r.text or ""
            number = int(plain_votes(text).translate(str.maketrans("gb.", "012")), 3)
            by_votes.setdefault(number, set()).add(got[r.doc_id].p_bad_weak)
            assert got[r.doc_id].p_bad_weak == model.chance[number]
            score = sum(model.weights[b] * x for b, x in plain_features(text).items())
            assert got[r.doc_id].p_bad == pytest.approx(1 / (1 + math.exp(-score)), rel=1e-6, abs=1e-12)
            assert got[r.doc_id].kept == (got[r.doc_id].p_bad < 0.8)
        assert set(by_votes) == set(model.chance) and all(len(p) == 1 for p in by_votes.values())
        assert kept == {d for d, r in got.items() if r.kept} == {d for d, r in got.items() if r.p_bad < 0.8}
