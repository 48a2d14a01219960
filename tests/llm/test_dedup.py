import hashlib
import re
from collections import defaultdict

from orrery.llm import exact_dedup, jaccard, substrings
from pyspark.sql import functions as F

from ..conftest import DATA
from .conftest import prose


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_matches_brute_force(corpus):
    rows = corpus.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r)
    got = exact_dedup.exact_dedup(corpus).collect()
    assert len(got) == len(rows)
    wanted = []
    for n, group in groups.items():
        best = min(group, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        wanted += [(r.doc_id, best.doc_id, len(group), hashlib.sha256(n.encode()).hexdigest()) for r in group]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=key) == sorted(wanted, key=key)
    assert sum(g.kept for g in got) == len(groups)


def test_exact_dedup_on_many_runs(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t "), F.col("id") % 700)).alias("text"), F.lit(1).alias("best"), F.lit(2).alias("n"))
    got = exact_dedup.exact_dedup(df.repartition(37), fan_in=3)
    hot = got.filter("group_size > 900")
    assert hot.count() == 1000 and hot.select("keep_id").distinct().collect()[0][0] == 0
    assert got.filter("kept").count() == got.select("text_sha256").distinct().count()
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == got.filter("kept").count()


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


def test_drop_copies_keeps_one_of_each(corpus):
    kept = exact_dedup.drop_copies(corpus).collect()
    assert sorted(norm(r.text) for r in kept) == sorted({norm(r.text) for r in corpus.collect()})


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    """Every pair of rows compared."""
    sets = [shingle_set(r.text) for r in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[find(k)] = min(least.get(find(k), r.doc_id), r.doc_id)
    return sorted((r.doc_id, len(sets[k]), least[find(k)]) for k, r in enumerate(rows) if r.doc_id is not None)


def components_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None)


def test_jaccard_matches_brute_force(corpus):
    assert components_of(jaccard.jaccard_components(corpus)) == brute_components(corpus.collect())


def test_jaccard_blocks_hubs_and_salts_change_nothing(corpus, monkeypatch):
    for name, value in (("BLOCK_SETS", 3), ("FEW", 2), ("COUNTERS", 1 << 20)):
        monkeypatch.setattr(jaccard, name, value)
    assert components_of(jaccard.jaccard_components(corpus.repartition(5))) == brute_components(corpus.collect())


def test_jaccard_on_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    assert components_of(jaccard.jaccard_components(docs)) == brute_components(docs.collect())


def test_a_tree_links_as_all_pairs_do(rand):
    import numpy as np

    r = rand(3)
    sets = []
    for _ in range(12):
        base = [r.getrandbits(64) for _ in range(r.randint(1, 400))]
        for _ in range(r.randint(1, 25)):
            own = [x if r.random() > 0.12 else r.getrandbits(64) for x in base]
            sets.append(np.unique(np.array(own, np.uint64)))
    label = jaccard.Tree(sets).labels(80)
    plain = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 180 * o >= 80 * (len(sets[a]) + len(sets[b])):
                was, now = plain[a], plain[b]
                plain = [now if x == was else x for x in plain]
    pairs = lambda x: {(i, j) for i in range(len(x)) for j in range(i) if x[i] == x[j]}
    assert pairs(label.tolist()) == pairs(plain)


def test_jaccard_of_nothing(empty):
    assert jaccard.jaccard_components(empty).count() == 0
    assert jaccard.drop_near_copies(empty).count() == 0


def test_drop_near_copies_keeps_columns_and_one_of_each(corpus):
    kept = jaccard.drop_near_copies(corpus)
    assert kept.columns == corpus.columns
    ids = {c for _, _, c in brute_components(corpus.collect())}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == ids


def plain_units(text, reach=4):
    """Lines, cut before words whose key is the least of the ``reach`` words to both sides: ``start, end, words, said``."""
    out, base = [], 0
    for line in text.split("\n"):
        places = [(m.start() + base, m.end() + base) for m in re.finditer(r"\S+", line)]
        words = [text[a:b].lower() for a, b in places]
        keys = [hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:16] for w in words]
        starts = [0] if words else []
        for at in range(reach, len(words) - reach):
            if all(keys[at] < k for k in keys[at - reach : at]) and all(keys[at] <= k for k in keys[at + 1 : at + reach + 1]):
                starts.append(at)
        for a, b in zip(starts, [*starts[1:], len(words)], strict=False):
            out.append((places[a][0], places[b - 1][1], b - a, " ".join(words[a:b])))
        base += len(line) + 1
    return out


def brute_spans(rows, least=25):
    """Removed spans as (place of the row, start, end, words), by a set of what was seen before."""
    seen, out = set(), []
    for place, r in sorted(enumerate(rows), key=lambda x: (x[1].doc_id is None, x[1].doc_id or 0, x[0])):
        island = None
        for start, end, words, said in plain_units(r.text or ""):
            if said in seen:
                island = (place, island[1], end, island[3] + words) if island else (place, start, end, words)
                continue
            seen.add(said)
            out, island = out + [island] * (island is not None), None
        out += [island] * (island is not None)
    return [s for s in out if s[3] >= least]


def ids_of(rows, spans):
    return sorted(((rows[p].doc_id, a, b, w) for p, a, b, w in spans), key=str)


def test_units_are_lines_and_parts_of_long_lines(rand):
    keys = substrings.Remembered(substrings.word_key, 100)
    for text in ("One two.\n\n  three  FOUR five \n", "", " \n ", prose(rand(1), 700), "word " * 300, "x" * 5000, "a\u2003b\x1cc\x85d"):
        start, end, words, *digests = (x.tolist() for x in substrings.units(text, 4, keys))
        wanted = plain_units(text)
        assert list(zip(start, end, words, strict=True)) == [u[:3] for u in wanted] and sum(words) == len(text.split())
        # Equal digests, in both halves, for equal words and no others.
        said = [u[3] for u in wanted]
        for half in digests:
            assert len(set(half)) == len(set(said)) == len(set(zip(half, said, strict=True)))


def test_digests_tell_orders_and_lengths_apart():
    keys = substrings.Remembered(substrings.word_key, 100)
    lines = ["a b", "b a", "a", "a a", "a a a", "b", "a b a", "ab"]
    *_, high, low = substrings.units("\n".join(lines), 4, keys)
    assert len(set(high.tolist())) == len(set(low.tolist())) == len(lines)


def test_spans_match_brute_force(corpus):
    rows = corpus.collect()
    got = substrings.repeated_spans(corpus.selectExpr("*", "1 AS row", "2 AS start")).collect()
    assert sorted(((r.doc_id, r.start, r.end, r.words) for r in got), key=str) == ids_of(rows, brute_spans(rows)) and len(got) > 20


def test_rows_that_repeat_go_but_one(spark, rand):
    text = prose(rand(8), 80)
    rows = [(1, text), (1, text), (None, text), (None, text), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "cuts": F.lit("c"), "ROW": F.lit(2)})
    kept = substrings.remove_repeats(df)
    assert kept.columns == df.columns
    said = [(r.doc_id, (r.text or "").strip()) for r in kept.collect()]
    assert sum(t == text.strip() for _, t in said) == 1 and (1, text.strip()) in said and sum(t == "" for _, t in said) == 5
    assert kept.filter("text IS NULL").count() == 1


def test_spans_are_removed_and_the_first_stays(spark, rand):
    passage = prose(rand(2), 60).strip()
    rows = [(3, f"{passage}\nSomething that is only here for once."), (1, f"Another beginning of some length.\n{passage}"), (2, f"x\n{passage.upper()}\ny"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("digest", F.lit("z"))
    spans = {(r.doc_id, r.start, r.end, r.first_doc_id) for r in substrings.repeated_spans(df).collect()}
    assert spans == {(3, 0, len(passage), 1), (2, 2, 2 + len(passage), 1)}
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(df).collect()}
    assert kept[3] == "\nSomething that is only here for once." and kept[1] == rows[1][1] and kept[2] == "x\n\ny" and kept[4] is None and kept[5] == ""


def test_a_shared_line_stays(spark, rand):
    r = rand(4)
    rows = [(k, f"{prose(r, 40)}\nall rights are reserved by whoever wrote this.\n{prose(r, 40)}") for k in range(20)]
    assert substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_a_passage_pasted_into_sentences_is_found(spark, rand):
    r = rand(3)
    say = lambda n: " ".join("".join(r.choice("abcdefghiklmnoprst") for _ in range(7)) for _ in range(n))
    passage = say(60)
    texts = [f"{say(9)} {passage} {say(8)}.", f"{say(3)} {passage}. {say(2)}.", f"{say(40)} {passage} {say(40)}"]
    spans = substrings.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for k in (1, 2):
        [(start, end)] = [(s.start, s.end) for s in spans if s.doc_id == k]
        assert texts[k][start:end] in passage and end - start > len(passage) / 2
    assert {s.doc_id for s in spans} == {1, 2}


def test_repeats_of_nothing(empty):
    assert substrings.repeated_spans(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0


CLASHES = ("id", "sha", "row", "own", "cid", "node", "more", "range", "run", "best", "all")


def test_columns_of_any_name_stay(corpus):
    odd = corpus.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})
    for keep in (exact_dedup.drop_copies, jaccard.drop_near_copies, substrings.remove_repeats):
        kept = keep(odd)
        assert kept.columns == odd.columns and kept.filter(f"{CLASHES[0]} != 0 OR row != 2").count() == 0 and kept.count() == keep(corpus).count()


def test_merges_run_along_sorted_rows(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    runs = exact_dedup.signatures(docs).withColumns({"range": F.col("doc_id") % 2, "n": F.lit(1)})
    plan = exact_dedup.merged(runs, F.col("run"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" in plan and plan.count("Sort [") == 1


def test_classes_of_one_id_keep_their_links(spark, rand):
    a, b = prose(rand(5), 60), prose(rand(6), 60)
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (9, b + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert components_of(jaccard.jaccard_components(df)) == brute_components(df.collect())


def near_texts(r, n, step):
    """Texts of ``n`` words, each of which differs from its neighbours in ``step`` words at its ends."""
    words = prose(r, n + 3 * step).replace("\n", " ").split()
    return [" ".join(words[k * step : k * step + n]) for k in range(3)]


def test_rows_without_an_id_link_and_one_of_each_component_stays(spark, rand):
    r = rand(12)
    a, b, c = near_texts(r, 100, 5)  # a and c meet through b alone
    d, e, f = near_texts(r, 100, 5)
    g, h = prose(r, 50), prose(r, 50)
    rows = [(1, a), (None, b), (3, c), (None, d), (None, e), (None, f), (None, g), (None, g), (7, g), (None, h), (None, h), (None, h), (None, ""), (None, None), (9, "")]
    df = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, place long")
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == len(rows)
    assert sorted((x.doc_id, x.component_id) for x in got if x.doc_id is not None) == [(1, 1), (3, 1), (7, 7), (9, 9)]
    assert sorted(str(x.component_id) for x in got if x.doc_id is None) == ["1", "7", "7"] + ["None"] * 8
    kept = [x.place for x in jaccard.drop_near_copies(df).collect()]
    assert len(set(kept)) == len(kept) and {0, 8, 12, 13, 14} <= set(kept)
    assert len({3, 4, 5} & set(kept)) == 1 and len({9, 10, 11} & set(kept)) == 1 and len(kept) == 7


def test_an_id_that_repeats_multiplies_nothing(spark, rand, monkeypatch):
    r = rand(13)
    head = prose(r, 8)
    texts = [f"{head} {prose(r, 30)}" for _ in range(200)] + [f"{head} again and again"] * 40
    df = spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string").repartition(3)
    joined = []
    real = type(df).join

    def join(self, other, *more):
        out = real(self, other, *more)
        if "first_key" in out.columns:
            joined.append(out.count())
        return out

    monkeypatch.setattr(type(df), "join", join)
    assert {x.component_id for x in jaccard.jaccard_components(df).collect()} == {0}
    assert joined and joined[0] <= len(texts)
    assert jaccard.drop_near_copies(df).count() == 201


def moved(spark):
    """Bytes that all stages so far have written for shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm = context._jvm
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def large_texts(spark, r):
    """Rows of 50 KB of text and 50 KB beside it, of which three are near copies; no two others are alike."""
    long = lambda n, k: " ".join("%0*x" % (k, r.getrandbits(4 * k)) for _ in range(n))
    texts = [long(50, 1000) for _ in range(97)]
    texts += [f"{texts[k]} {word}" for k, word in ((3, "one"), (3, "two"), (8, "three"))]
    return spark.createDataFrame([(k, t, long(1, 50_000)) for k, t in enumerate(texts)], "doc_id long, text string, other string").repartition(4).localCheckpoint()


def test_texts_that_no_family_wants_do_not_travel(spark, rand):
    docs = large_texts(spark, rand(21))
    before = moved(spark)
    assert components_of(jaccard.jaccard_components(docs)) == brute_components(docs.collect())
    assert moved(spark) - before < 1_000_000


def test_pairs_that_meet_too_seldom_are_dropped_before_their_bitmaps_travel(spark, rand, monkeypatch):
    """In a large corpus the counters are all about as full: what is rare is chance."""
    import numpy as np

    r = rand(22)
    monkeypatch.setattr(jaccard, "frequencies", lambda signed: np.ones(jaccard.COUNTERS, np.int64))
    phrases = [prose(r, 5).replace("\n", " ") for _ in range(60)]
    texts = [" ".join(f"{p} {prose(r, 60)}" for p in r.sample(phrases, 4)) for _ in range(200)]
    texts += [f"{t} more" for t in texts[:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    joined = []
    real = type(df).join

    def join(self, other, *more):
        out = real(self, other, *more)
        if "bits_v" in out.columns:
            joined.append(out.count())
        return out

    monkeypatch.setattr(type(df), "join", join)
    assert components_of(jaccard.jaccard_components(df)) == brute_components(df.collect())
    assert 30 <= joined[0] <= 100


def test_any_two_similar_sets_share_as_many_of_their_rarest(rand):
    import numpy as np

    r = rand(23)
    for percent in (1, 30, 80, 97, 100):
        counts = np.array([r.randint(1, 9) for _ in range(1 << 20)])
        for _ in range(300):
            a = {r.getrandbits(64) for _ in range(r.choice((1, 2, 5, 49, 50, 120, 400)))}
            gone = set(r.sample(sorted(a), int(r.random() * (1 - percent / 100) * len(a))))
            b = (a - gone) | {r.getrandbits(64) for _ in range(r.randint(0, 2 + len(a) // 6))}
            if not b or 100 * len(a & b) < percent * len(a | b):
                continue
            rare = [set(jaccard.rare_first(np.array(sorted(x), np.uint64), counts, percent)[0].tolist()) for x in (a, b)]
            assert len(rare[0] & rare[1]) >= jaccard.least_shared(min(len(a), len(b)), percent) >= 1


def test_rows_that_stay_do_not_travel(spark, rand):
    docs = large_texts(spark, rand(24))
    before = moved(spark)
    kept = jaccard.drop_near_copies(docs).collect()
    assert sorted(kept) == sorted(docs.filter("doc_id < 97").collect())
    assert moved(spark) - before < 1_000_000


def test_without_a_least_span_no_later_copy_of_a_line_stays(spark):
    """Lines of any length: with spans of one word on, every line that is left is the first of its kind."""
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    said = lambda rows: [" ".join(line.lower().split()) for r in sorted(rows, key=lambda r: r.doc_id) for line in (r.text or "").split("\n")]
    before = [x for x in said(docs.collect()) if x]
    after = [x for x in said(substrings.remove_repeats(docs, least_span=1).collect()) if x]
    assert len(before) - len(set(before)) > 100
    whole = set(before)
    left = [x for x in after if x in whole]
    assert len(left) == len(set(left))
