import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from orrery.llm import bpe, packing
from tokenizers import Tokenizer

from ..conftest import DATA

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = ["", " ", "  \n\t x", "naïve café ÅÄÖ", "İstanbul ΑΣ Σ", "漢字かな交じり文", "👩‍👩‍👧 emoji", "a\u0301b\u00a0c\u2003d\x1ce\x85f", "don't WE'LL it's '", "1234567890 ½ ²", "<|endoftext|> <|startoftext|>", "x" * 5000, "ab" * 3000 + "!" * 700, "\ufeffbom \x00nul"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS)


def test_bpe_encodes_as_the_library_does(spark, library):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([*ODD, None])], "doc_id long, text string")
    both = docs.union(more)
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    got = bpe.bpe_round_trip(both, RANKS, P.PATTERN).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == texts[r.doc_id].encode()
    digests = {r.doc_id: r.ids for r in bpe.bpe_round_trip(both, RANKS, P.PATTERN, digests=True).collect()}
    assert digests == {r.doc_id: hashlib.sha256(r.ids).hexdigest() for r in got}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abc eE'tsTS\n09.,é漢"), st.characters(codec="utf-8")), max_size=60))
def test_bpe_of_any_text(library, text):
    assert np.frombuffer(bpe.codec(RANKS, P.PATTERN).encode(text), "<u4").tolist() == library.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abc eE'tsTS\n09.,éÉß<|>\u00a0\u0301"), st.characters(codec="utf-8")), max_size=60))
def test_word_ids_of_any_text(tokenizer, text):
    ids = np.frombuffer(packing.words(WORDS).ids(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_fill_sequences_without_gaps(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate([*ODD, None, "w " * 9000])], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = packing.pack(docs, WORDS).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            part = ids[4096 * k : 4096 * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 4096 * k, len(part), zlib.crc32(part.tobytes()))
        assert len(by_doc[doc]) == -(-len(ids) // 4096)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_seq) <= 1.02 * -(-sum(r.length for r in got) // 4096) + 1


def test_packing_comes_near_the_bound(rand):
    r = rand(2)
    for top in (300, 1500, 4096):
        histogram = {}
        for _ in range(4000):
            n = min(4096, max(1, int(r.expovariate(1 / (top / 3)))))
            histogram[n] = histogram.get(n, 0) + 1
        plan, said = packing.pack_histogram(histogram)
        used = {}
        for config, times in plan:
            assert sum(config) <= 4096
            for n in config:
                used[n] = used.get(n, 0) + times
        assert used == histogram
        assert sum(t for _, t in plan) <= 1.02 * said["bound"] + 2


def used_by(plan):
    used = {}
    for config, times in plan:
        assert sum(config) <= 4096
        for n in config:
            used[n] = used.get(n, 0) + times
    return used


@pytest.mark.parametrize("times", [1, 20])
def test_the_program_places_the_pieces(spark, times):
    """On the lengths of a table: near its bound, by columns, and in no more sequences than best fit alone."""
    cuts = packing.pieces(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), WORDS)
    histogram = {r["length"]: times * r["count"] for r in cuts.groupBy("length").count().collect()}
    plan, said = packing.pack_histogram(histogram)
    assert used_by(plan) == histogram
    assert said["gap"] < 0.01 and said["by_columns"] >= 0.9 * said["pieces"]
    lengths = np.array(sorted(histogram))
    alone = packing.best_fit([], lengths, np.array([histogram[int(n)] for n in lengths]), 4096)
    assert sum(t for _, t in plan) <= sum(t for _, t in alone)
    assert sum(t for _, t in plan) >= said["bound"] - 1e-6


@pytest.mark.parametrize(("low", "high", "most"), [(1200, 3000, 0.0025), (1366, 2048, 0.0), (900, 1500, 0.03), (600, 1100, 0.01), (1300, 1500, None), (2000, 2100, 0.001), (1, 4096, 0.005)])
def test_never_more_than_best_fit_alone(low, high, most):
    """Lengths that fill sequences badly: against best fit, and against the bound where the program comes near it."""
    drawn = np.random.default_rng(low).integers(low, high + 1, 20_000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(drawn, return_counts=True)), strict=True))
    plan, said = packing.pack_histogram(histogram)
    lengths = np.array(sorted(histogram))
    alone = sum(t for _, t in packing.best_fit([], lengths, np.array([histogram[n] for n in lengths.tolist()]), 4096))
    used = sum(t for _, t in plan)
    assert used_by(plan) == histogram and said["bound"] - 1e-6 <= used <= alone
    assert most is None or used <= (1 + most) * said["bound"] + 1


def test_feasible_prices_give_no_configuration_more_than_one(rand):
    r = rand(21)
    for _ in range(200):
        capacity = r.choice([16, 31, 64])
        lengths = np.array(sorted(r.sample(range(1, capacity), r.randint(1, 12))))
        counts = np.array([r.randint(1, 50) for _ in lengths])
        prices, bound = packing.feasible_prices(lengths, counts, capacity)
        assert packing.knapsack(lengths, prices, capacity)[capacity] <= 1 + 1e-9 and bound == pytest.approx(counts @ prices)
        assert bound >= counts @ lengths / capacity - 1e-9


def test_prices_find_what_lengths_do_not_show():
    """Two lengths of a third: only the mixed configuration is full, and best fit alone misses it."""
    plan, said = packing.pack_histogram({1366: 1000, 1365: 1000})
    assert used_by(plan) == {1366: 1000, 1365: 1000} and sum(t for _, t in plan) == 750 and said["gap"] < 0.01
    lengths = np.array([1365, 1366])
    assert sum(t for _, t in packing.best_fit([], lengths, np.array([1000, 1000]), 4096)) > 750


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plans_hold_every_piece(histogram):
    plan, said = packing.pack_histogram(histogram, 64)
    used = {}
    for config, times in plan:
        assert sum(config) <= 64 and times > 0
        for n in config:
            used[n] = used.get(n, 0) + times
    assert used == histogram and said["by_columns"] <= said["pieces"] == sum(histogram.values())


def test_long_words_are_not_kept():
    for made in (packing.words(WORDS), bpe.codec(RANKS, P.PATTERN)):
        known = made.known
        known["q" * 100_000], known["short"]
        assert "short" in known and max(map(len, known)) <= known.longest


def test_frequent_words_outlive_a_full_room():
    """Each new word is worked out once, and a word that keeps coming stays when others have filled the room."""
    made = []
    known = packing.Lasting(lambda word: made.append(word) or word.encode(), 4)
    for k in range(20):
        assert known["often"] == b"often" and known[f"w{k}"] == b"w%d" % k
    assert made.count("often") == 1 and len(known) <= 4 and len(known.old) <= 4


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeE'tslvm \n09.,;:!?)(-éÉßµ×ª\xad", max_size=60))
def test_word_ids_of_plain_text(tokenizer, text):
    made = packing.words(WORDS)
    assert np.frombuffer(made.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_plain_text_goes_through_no_word_check(monkeypatch):
    made = packing.Words(WORDS)
    monkeypatch.setattr(packing, "PLAIN", None)
    assert made.ids("Some Words, some words.\nÉté.") == made.ids("some words, Some words. été.")
    assert {"some", "words", "words,", "été"} <= set(made.lowered) and not made.known


def test_many_pieces_of_one_length(spark):
    docs = spark.range(2000).selectExpr("id doc_id", "'same words here' text", "1 piece", "2 salt")
    got = packing.pack(docs, WORDS, rows_per_salt=100).collect()
    places = {(r.sequence_id, r.offset) for r in got}
    assert len(places) == 2000 and len({r.sequence_id for r in got}) == -(-2000 // (4096 // got[0].length))


def test_nothing_to_encode(empty):
    assert bpe.bpe_round_trip(empty, RANKS, P.PATTERN).count() == 0
    assert packing.pack(empty, WORDS).count() == 0
