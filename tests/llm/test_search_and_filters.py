import re

import numpy as np
import pytest
from orrery.llm import pii, quality, shards, topk, url_filters
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ..conftest import DATA


def brute_top(rows, k, every):
    """All inner products of each query row with every other row."""
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)))
    out = []
    for own, (i, q) in enumerate(good):
        if i % every == 0:
            best = sorted((-int(q @ w), j) for other, (j, w) in enumerate(good) if other != own and len(w) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    rows += [(k, rows[40][1]) for k in range(10_000, 10_060)]  # ties
    rows += [(20_000, None), (20_020, []), (20_040, [float("nan")] * 64), (20_060, [None] + [0.0] * 63), (20_080, [float("inf")] * 64), (None, rows[0][1]), (20_100, [1.0, 2.0]), (20_120, [3.0, -2.0]), (20, rows[7][1]), (20, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS q", "3 AS dim", "4 AS row")
    for sizes in ({}, {"block_rows": 37, "query_rows": 11, "lists": 3}):
        got = topk.exact_top_k(df, lambda v: v % 20 == 0, **sizes)
        assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 20, 20)


def test_top_k_of_few_and_of_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.25, 2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.exact_top_k(df, lambda v: v % 20 == 0).collect()] == [(0, 1, 1, 80 * 0 + int(np.floor(64) * 16 + 32 * 128))]
    assert topk.exact_top_k(df.limit(0), lambda v: v % 20 == 0).count() == 0


def test_lists_collect_a_part_of_all_pairs(spark):
    r = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(r.normal(size=(3000, 64)).astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held = topk.cut(topk.quantised(df, "vec_id", "embedding", 64))
    search = topk.Search(held, F.col("vec_id") % 20 == 0, 20, 2, 1_000, 100, 128)
    cutoffs = topk.cut(search.cutoffs())
    some = search.collected(topk.enough(2), cutoffs).agg(F.sum("n")).first()[0]
    assert 150 * 20 <= some < 0.15 * 150 * 2999


def rule_of(url):
    host, _, rest = (url or "").partition("://")[2], "", ""
    if "://" not in (url or ""):
        return "", "", None
    after = url.split("://", 1)[1]
    host = re.split(r"[/?#]", after, maxsplit=1)[0]
    path = re.split(r"[?#]", after[len(host) :], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(d + p, v) for d, p, v in url_filters.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0])) if fits else None


def test_url_rules_match_plain_code(spark):
    urls = [r.url for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()]
    urls += [None, "", "nothing", "http://", "HTTP://EXAMPLE.NET/en/x", "a://b://c.net/x", "http://example.net", "http://net/", "http://xnet/", "http://sub.EXAMPLE.com/de/?q#f", "http://h.org?x=/fr/", "http://h.org/fr/#a", "x\n://h.net/a\nb?c"]
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string").selectExpr("*", "'h' AS host", "1 AS trust")
    for r in url_filters.url_verdicts(df).collect():
        host, path, rule = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0]), urls[r.page_id]
        assert r.verdict == (rule[1] if rule else r.verdict)


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    link = lambda h: f'<a href="http://{h}/x">there</a>'
    rows = [
        (1, "http://bad.net/a", link("other.io")), (2, "http://farm.io/b", link("bad.net") + link("BAD.net")), (3, "http://hub.io/c", link("farm.io")),
        (4, "http://fine.org/fr/a", link("good.io")), (5, "http://good.io/d", None), (6, "http://alone.io/e", ""), (7, None, link("bad.net")),
    ]
    got = {r.page_id: r for r in url_filters.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    assert got[2].distrust > got[3].distrust > 0 and got[5].trust > 0


def test_propagation_matches_a_dense_solution(spark, rand):
    r = rand(1)
    hosts = [f"h{k}" for k in range(12)]
    edges = sorted({(r.choice(hosts), r.choice(hosts)) for _ in range(40)})
    edges = [(a, b) for a, b in edges if a != b]
    seed = {h: r.random() * (k % 3 == 0) for k, h in enumerate(hosts)}
    rank = dict(seed)
    degree = {a: sum(x == a for x, _ in edges) for a in hosts}
    for _ in range(5):
        rank = {h: 0.15 * seed[h] + 0.85 * sum(rank[a] / degree[a] for a, b in edges if b == h) for h in hosts}
    df = spark.createDataFrame([(a, b, hash(b) % url_filters.SALTS) for a, b in edges], "src string, dst string, salt int")
    got = {x.host: x.t for x in url_filters.propagated(spark.createDataFrame(list(seed.items()), "host string, seed double"), df, "t", 5, 0.85).collect()}
    assert all(abs(got.get(h, 0) - rank[h]) < 1e-9 for h in hosts)


def test_distrust_comes_from_any_distance_and_settles(spark):
    link = lambda h: f'<a href="http://{h}/x">there</a>'
    rows = [(0, "http://bad.net/a", None)] + [(k, f"http://h{k}.io/a", link(f"h{k - 1}.io" if k > 1 else "bad.net")) for k in range(1, 13)]
    got = {r.page_id: r for r in url_filters.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(r.verdict == "block" for r in got.values())
    assert all(abs(got[k].distrust - 0.15 * 0.85**k) < 1e-6 for k in range(13))


def test_siblings_meet_in_a_parent_without_pages(spark):
    rows = [(1, "http://a.shop.net/x", None), (2, "http://b.far.shop.io/x", None), (3, "http://a.shop.io/de/x", None), (4, "http://other.io/x", None), (5, "http://1.0.0.9/x", None), (6, "http://2.0.0.9/x", None)]
    rules = (("a.shop.io", "/", "block"), ("1.0.0.9", "/", "block"))
    got = {r.page_id: r.verdict for r in url_filters.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow"}


def test_url_filters_of_nothing(spark):
    assert url_filters.url_verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".") if p) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("a@.-%+_ ()0123459é\n4"), max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111 1111 1111", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "+1 (555) 010-9999", "a.b@c.example.com", "x@y", "word", " ", ".", "-", ",", "@"]), max_size=12).map("".join))
def test_base_spans_of_pieces(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_on_the_table(spark, corpus):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        said = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        spans = [(k, int(a), int(b)) for k, a, b in said]
        assert set(base) <= set(spans) and len(spans) == len(base) + r.n_added
        assert spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))
    odd = corpus.selectExpr("*", "1 AS spans", "2 AS n_ip")
    assert pii.find_pii(odd).count() == corpus.count()
    kept = pii.redact(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert kept.filter("text IS NULL").count() == corpus.filter("text IS NULL").count()


def test_the_field_learns_held_out_rows():
    field = pii.default_field()
    held_out = pii.labelled_table(400, seed=99)
    said = field.decode([[pii.features(w) for w, _ in row] for row in held_out])
    right = sum(pii.LABELS[int(y)] == want for labels, row in zip(said, held_out, strict=True) for y, (_, want) in zip(labels, row, strict=True))
    assert right / sum(map(len, held_out)) > 0.97


def test_the_field_adds_what_the_patterns_miss():
    text = "please write to anna.21[at]mail.example.com or call (555) 201-3344 soon, hash 3f9a0c12e4b7d6558899aabbccddeeff00112233 is not data"
    base, added = next(pii.detect([text], pii.default_field()))
    assert not base and [(k, text[a:b]) for k, a, b in added] == [("email", "anna.21[at]mail.example.com"), ("phone", "(555) 201-3344")]


def test_redaction_hides_what_was_found(spark):
    df = spark.createDataFrame([(1, "mail me at jo.doe@mail.example.com or +1 (555) 010-2222 now")], "doc_id long, text string")
    assert pii.redact(df).first().text == "mail me at [EMAIL] or [PHONE] now"


def test_viterbi_finds_the_best_path(rand):
    import itertools

    r = rand(4)
    field = pii.Field(np.array([[[r.gauss(0, 1) for _ in pii.LABELS] for _ in range(pii.WIDTH + 1)] for _ in range(3)], np.float32) * (np.arange(pii.WIDTH + 1) < pii.WIDTH)[None, :, None], np.where(pii.LEGAL, 0.3, -1e9).astype(np.float32))
    chains = [[tuple(r.randrange(pii.WIDTH) for _ in range(3)) for _ in range(n)] for n in (1, 2, 3, 4, 3)]
    for chain, got in zip(chains, field.decode(chains), strict=True):
        worth = field.worth(pii._padded([chain]))[0]
        legal = [p for p in itertools.product(range(len(pii.LABELS)), repeat=len(chain)) if pii.LEGAL_START[p[0]] and all(pii.LEGAL[a, b] for a, b in itertools.pairwise(p))]
        value = lambda p: sum(worth[t, y] for t, y in enumerate(p)) + sum(field.moves[a, b] for a, b in itertools.pairwise(p))
        assert abs(value(tuple(got.tolist())) - max(map(value, legal))) < 1e-3


def test_classifier_agrees_with_held_out_labels(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.classify(docs).collect()}
    known = [d for d in labels if d in got]
    right = {q: [got[d].kept == bool(q) for d in known if labels[d] == q] for q in (0, 1)}
    assert np.mean(right[1]) > 0.97 and np.mean(right[0]) > 0.9


def test_classifier_on_odd_rows(corpus, empty):
    assert quality.classify(corpus).count() == corpus.count()
    assert quality.classify(empty).count() == 0 and quality.keep_good(empty).count() == 0
    assert quality.keep_good(corpus).columns == corpus.columns


@pytest.fixture
def store(spark, tmp_path):
    return shards.ShardStore(spark, f"{tmp_path}/store", target_bytes=60_000, small_bytes=4_000, fan_in=3)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_store_keeps_every_row_through_compaction(store, corpus):
    for _ in range(4):
        store.append(corpus.repartition(3))
    before = store.manifest()
    assert before["version"] == 4 and len(before["shards"]) >= 4
    after = store.compact()
    now = store.manifest()
    assert after > 4 and len(now["shards"]) < len(before["shards"])
    assert not store.runs(now["shards"]) and sum(s.rows for s in now["shards"]) == 4 * corpus.count()
    everything = rows_of(corpus.union(corpus).union(corpus).union(corpus))
    assert rows_of(store.read()) == everything and rows_of(store.read(4)) == everything
    assert store.vacuum() == 0 and store.vacuum(grace_s=0) > 0 and rows_of(store.read()) == everything
    assert store.versions()[-1] == after and after - store.versions()[0] < shards.FULL


def test_vacuum_leaves_nothing_that_no_version_names(store, corpus, tmp_path):
    store.append(corpus)
    store._written(corpus, 9)  # the files of a writer that failed
    (tmp_path / "store" / "manifest" / ".draft-1").write_text("{}")
    store.vacuum(grace_s=0)
    left = {f.name for f in (tmp_path / "store").rglob("*") if f.is_file() and not f.name.endswith(".crc")}
    assert left == {s.path.rsplit("/", 1)[1] for s in store.manifest()["shards"]} | {"000000000001.json"}


def test_many_versions_read_alike(store, spark):
    row = lambda k: spark.createDataFrame([(k, "t", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    for k in range(shards.FULL + 3):
        store.append(row(k))
        if k == 9:
            store.compact()
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(shards.FULL + 3))
    assert store.read(5).count() == 5


def test_one_of_two_writers_loses(store, corpus):
    store.append(corpus.limit(3))
    now = store.manifest()
    store._commit(now, now["schema"], now["shards"])
    with pytest.raises(shards.Conflict):
        store._commit(now, now["schema"], [])
    assert store.manifest()["shards"] == now["shards"]
    with pytest.raises(ValueError):
        store.append(corpus.select("doc_id"))


def test_empty_arrivals(store, empty):
    assert store.append(empty) == 1 and store.compact() >= 1
    assert store.read().columns == empty.columns and store.read().count() == 0


def test_columns_of_any_name_are_stored(spark, tmp_path, corpus):
    odd = corpus.selectExpr("*", "7 AS arrival", "doc_id % 3 AS __arrival", "8 AS Arrival_")
    assert rows_of(shards.shard_table(odd, f"{tmp_path}/c").read()) == rows_of(odd)


def test_shard_table_names_each_row(spark, tmp_path, corpus, empty):
    made = shards.shard_table(corpus, f"{tmp_path}/a", target_bytes=60_000, small_bytes=4_000)
    assert rows_of(made.read()) == rows_of(corpus)
    assert made.read(shard_col="where").filter("where IS NULL").count() == 0
    assert shards.shard_table(empty, f"{tmp_path}/b").read().count() == 0


def plain_posteriors(codes, counts):
    """The same model in plain loops: classes good and each kind, votes independent within a class, no vote no word."""
    kinds = [k for _, _, k, _, _ in quality.LABELLERS]
    seen = []
    for code in codes:
        digits = []
        for _ in kinds:
            code, d = divmod(code, 3)
            digits.append(d)
        seen.append(digits[::-1])
    share = []
    for v in seen:
        raised = [sum(x == 1 for x, k in zip(v, kinds, strict=True) if k == kind) / kinds.count(kind) for kind in range(4)]
        one = [1 - max(raised), *[r if r == max(raised) else 0 for r in raised]]
        share.append([x / sum(one) for x in one])
    for _ in range(200):
        total = sum(counts)
        prior = [(sum(s[c] * n for s, n in zip(share, counts, strict=True)) + 0.5) / (total + 2.5) for c in range(5)]
        table = {}
        for c in range(5):
            for j in range(len(kinds)):
                good, bad = (sum(s[c] * n for s, n, v in zip(share, counts, seen, strict=True) if v[j] == x) + 0.5 for x in (0, 1))
                table[c, j] = (good / (good + bad), bad / (good + bad))
        for i, v in enumerate(seen):
            worth = [prior[c] * np.prod([table[c, j][x] for j, x in enumerate(v) if x < 2]) for c in range(5)]
            share[i] = [w / sum(worth) for w in worth]
    return [1 - s[0] for s in share]


def patterns_of(texts):
    codes = [quality.votes(t, t.split()) for t in texts]
    found, counts = np.unique(codes, return_counts=True)
    return codes, found, counts.astype(float)


def test_posteriors_match_a_plain_model(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    _, found, counts = patterns_of(texts)
    got, _, _ = quality.posteriors(found, counts)
    assert np.abs(got - plain_posteriors(found.tolist(), counts.tolist())).max() < 1e-3


def test_estimated_accuracies_are_those_on_labels(spark):
    """What the model says of its labellers without labels, against the labels; and it is no mere vote of any."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").collect()}
    rows = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").collect()
    codes, found, counts = patterns_of([r.text or "" for r in rows])
    chance, tables, prior = quality.posteriors(found, counts)
    by = dict(zip(found.tolist(), chance, strict=True))
    seen = quality.patterns(np.array(codes))
    known = np.array([r.doc_id in labels for r in rows])
    good = np.array([labels.get(r.doc_id) == 1 for r in rows])
    bad = known & ~good
    for j, (name, *_) in enumerate(quality.LABELLERS):
        votes, wrong = seen[good, j], (seen[good, j] == quality.BAD).sum()
        assert abs(wrong / max(1, (votes != quality.NONE).sum()) - tables[0, j, quality.BAD]) < 0.02, name
        of_bad = [(tables[1:, j, quality.BAD] * prior[1:]).sum() / prior[1:].sum(), (seen[bad, j] == quality.BAD).sum() / max(1, (seen[bad, j] != quality.NONE).sum())]
        assert abs(of_bad[0] - of_bad[1]) < 0.12, name
    said = np.array([by[c] for c in codes]) > 0.5
    assert (said[good]).mean() < 0.005 and said[bad].mean() > 0.97
    assert (said != (seen == quality.BAD).any(1)).any()


def test_the_draw_holds_at_any_number_of_rows():
    for rows in (1, 100, 3_000, 10**6, 10**9, 10**11, 10**14):
        share = (quality.draw_limit(rows, 3_000) + 2**63) / 2**64
        assert share == 1 - 2**-64 or abs(share * rows - min(rows, 4_500)) < 1


def test_scores_of_very_long_and_short_texts(spark):
    rows = [(1, "word " * 200_000), (2, "x" * 2_000_000), (3, "a"), (None, None), (4, "\ud83d\ude00 " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.classify(df).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 4] and all(0 <= r.p_bad <= 1 for r in got)
