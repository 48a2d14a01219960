"""Fill-in-middle, periodic runs and mixing against plain versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from orrery.llm import middle, mixing, periods, shared
from pyspark.sql import functions as F

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    w = TOKEN.findall(text)
    n = len(w)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, mid, suffix = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def brute_periods(words):
    """All runs, by the definition: for every period the stretches that have it, of which the smallest period counts."""
    n, found = len(words), {}
    for p in range(1, n):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            found.setdefault((i, j + p - i), p)  # periods rise
            i = j + 1
    return sorted((s, size, p) for (s, size), p in found.items() if size >= max(6, 4 * p))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def test_packed_lists_give_their_numbers(rand):
    r = rand(1)
    for n, upto in ((0, 0), (0, 9), (1, 1), (1, 5000), (7, 7), (40, 41), (300, 70_000), (2000, 2100)):
        ends = np.array(sorted(r.sample(range(1, upto + 1), n)), np.int64)
        data = middle.packed(ends, upto)
        assert [middle.selected(data, k) for k in range(n + 1)] == [0, *ends.tolist()]
        assert len(data) < 20 + n * (3 + max(1, upto // max(n, 1)).bit_length()) / 8 + 8


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a\n\nb \t", "\x0b\x0c a\x1fb\x85c d e", "\U0001f600 é́ x", "x" * 500])
def test_token_ends_are_the_patterns(text):
    assert middle.token_ends(text).tolist() == [m.end() for m in TOKEN.finditer(text)]


def middle_rows(docs, **more):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in middle.fill_in_middle(docs, **more).collect()), key=repr)


@pytest.mark.parametrize("per_group", [1, 2, 256])
def test_fill_in_middle_is_the_plain_one(spark, corpus, per_group):
    """Groups of one and two rows, so that most copies of a text lie in groups of their own."""
    extra = spark.createDataFrame(
        [(10_000 + k, t, "x", "y", 1) for k, t in enumerate(["a <P> b", "<M>", "a <S b <<P d < M>", "\U0001f600 tail \n "] + ["many copies of one text "] * 40 + ["< P>S><"] * 40)]
        + [(None, "many copies of one text ", None, None, None)] * 3, corpus.schema,
    )
    docs = corpus.union(extra)
    assert middle_rows(docs, per_group=per_group) == sorted(((r.doc_id, *brute_middle(r.doc_id, r.text)) for r in docs.collect()), key=repr)


def test_outputs_give_the_text_back(spark, rand):
    """Parts that begin and end with pieces of sentinels."""
    r = rand(2)
    rows = [(k, " ".join(r.choice(["<", "<S", "S>", "<P", ">", "<M", "x", "M>"]) for _ in range(r.randint(1, 9)))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = middle.fill_in_middle(docs, cut_percent=100)
    got = {r.doc_id: r.back for r in made.withColumn("back", middle.restored(F.col("form"), F.col("output"))).collect()}
    assert got == dict(rows)
    assert {r.form for r in made.collect()} >= {"spm", "psm"}


def test_new_operators_take_empty_tables_and_clashing_columns(spark, corpus, empty):
    assert middle.fill_in_middle(empty).count() == periods.periodic_runs(empty).count() == 0
    assert mixing.mixture(empty).count() == mixing.mix(empty).count() == 0
    clash = corpus.select("*", *[F.lit(1).alias(c) for c in ("digest", "check", "copies", "group", "place", "bounds", "runs", "key", "copy", "rate", "drawn", "row", "size", "weight")])
    for f in (middle.fill_in_middle, periods.periodic_runs, mixing.mixture):
        assert sorted(map(str, f(clash).collect())) == sorted(map(str, f(corpus).collect()))
    assert mixing.mix(clash).columns == clash.columns
    renamed = corpus.withColumnsRenamed({"doc_id": "a b", "text": "t.x", "source": "s.y"})
    assert middle.fill_in_middle(renamed, id_col="a b", text_col="t.x").count() == periods.periodic_runs(renamed, "a b", "t.x").count() == corpus.count()
    assert mixing.mixture(renamed, id_col="a b", text_col="t.x", source_col="s.y").count() == corpus.count()


def run_rows(docs, **more):
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs, **more).collect()), key=repr)


def test_runs_are_those_of_all_pairs(spark, rand):
    r = rand(3)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 3 + "a", "a b " * 4, "a b c " * 4, "x " + "a b c " * 5 + "a b", "a a b " * 6 + "a a a a a a a"]
    for _ in range(250):
        letters, n = "abc"[: r.randint(1, 3)], r.randint(1, 60)
        texts.append(" ".join(r.choice(letters) for _ in range(n)))
        unit = [r.choice("abcd") for _ in range(r.randint(1, 9))]
        texts.append("\n".join((unit * 20)[r.randint(0, 8) : r.randint(20, 60)] + [r.choice("abcd") for _ in range(r.randint(0, 5))]))
    texts.append(" ".join(["p", "q", "r"] * 3000 + [f"w{k}" for k in range(3000)] + ["s"] * 2000))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "a b " * 9), (1, "z " * 9), (1, "z " * 9)], "doc_id long, text string")
    want = []
    for d, t in [(x.doc_id, x.text) for x in docs.collect()]:
        words = (t or "").encode().split()
        runs = brute_periods(words) if len(words) < 5000 else [(0, 9000, 3), (12000, 2000, 1)]
        want.append((d, len(words), runs, collapsed(words, runs)))
    assert run_rows(docs) == sorted(want, key=repr)


def test_grid_goes_in_slices_and_lying_hashes_are_found_out(monkeypatch, rand):
    r = rand(4)
    batch = pd.DataFrame({"doc_id": pd.array(range(60), "Int64"), "text": [" ".join(r.choice("ab") for _ in range(r.randint(0, 50))) for _ in range(60)]})
    want = periods.worked(batch, None)
    monkeypatch.setattr(periods, "POINTS", 7)
    assert periods.worked(batch, None).equals(want)
    # A hash that takes all stretches for equal is refused; the next base is asked.
    true, asked = periods.found_runs, []

    def found(numbers, begins, sizes, base):
        asked.append(base)
        if len(asked) == 1:
            with monkeypatch.context() as m:
                m.setattr(periods.Hashes, "same", lambda self, at, apart, length: np.ones(len(at), bool))
                assert true(numbers, begins, sizes, base) is None
            return None
        return true(numbers, begins, sizes, base)

    monkeypatch.setattr(periods, "found_runs", found)
    assert periods.worked(batch, None).equals(want) and len(set(asked)) == 2


def test_an_echo_repeats_words(spark):
    docs = spark.createDataFrame([(7, "a b c d e f g h i j k l"), (8, "a b"), (9, None)], "doc_id long, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in periods.periodic_runs(docs, echo=lambda d, n: (1, 2) if d == 7 else None).collect()}
    assert got == {7: ("a b c", [(1, 11, 2)]), 8: ("a b", []), 9: ("", [])}


def test_portions_are_bounded_and_whole():
    batch = pd.DataFrame({"doc_id": [1, None, 3, 4, 5], "text": ["x" * 5, None, "y" * 30, "z" * 4, "z" * 6]})
    got = list(shared.portions([batch], letters=10))
    assert [p["text"].tolist() for p in got] == [["x" * 5, None], ["y" * 30], ["z" * 4, "z" * 6]]
    assert [str(d) for p in got for d in p["doc_id"]] == ["1", "<NA>", "3", "4", "5"]


def plain_targets(sizes, weights, share, most):
    """Round by round: what a source would get beyond its ceiling is shared by the others."""
    left, got, budget = set(sizes), {}, share * sum(sizes.values())
    while left:
        level = (budget - sum(got.values())) / sum(weights[s] for s in left)
        above = {s for s in left if weights[s] * level > most * sizes[s] + 1e-9}
        if not above:
            return got | {s: weights[s] * level for s in left}
        got |= {s: most * sizes[s] for s in above}
        left -= above
    return got


@pytest.mark.parametrize(("share", "most", "few"), [(1.5, 2.0, 10_000), (0.4, 2.0, 0), (2.0, 2.0, 10_000), (3.0, 2.0, 0), (1.2, 1.25, 10_000)])
def test_mix_meets_its_targets(spark, rand, monkeypatch, share, most, few):
    monkeypatch.setattr(mixing, "SMALL_SIDE_ROWS", few)
    r = rand(6)
    names = ["b", "a", "Z", "é", "", "\U0001f600", "￿", None]
    rows = [(k, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 9))), r.choice([*names[:1] * 6, *names])) for k in range(3000)]
    rows += [(9001, "", "no words"), (9002, None, "no words"), (None, "a b", "a"), (None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs, share=share, most=most).collect()
    assert len(got) == len(rows) and mixing.mixture(docs, share=share, most=most).exceptAll(mixing.mixture(docs.repartition(7), share=share, most=most)).isEmpty()
    order = sorted({x[2] for x in rows}, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets({s: sizes[s] for s in order}, weights, share, most)
    taken = Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert x.copies in (int(x.rate), int(x.rate) + 1) and x.copies <= most + (most % 1 > 0)
        taken[x.source] += x.copies * x.size
    for s in order:
        assert taken[s] == pytest.approx(want[s], abs=6 * 9 * (1 + sum(x.source == s for x in got)) ** 0.5)
    emitted = Counter((x.doc_id, x.text, x.source) for x in mixing.mix(docs, share=share, most=most).collect())
    planned = Counter()
    for x in got:
        planned[x.doc_id, x.source] += x.copies
    assert Counter({k: v for k, v in planned.items() if v}) == sum((Counter({(d, s): n}) for (d, _, s), n in emitted.items()), Counter())
