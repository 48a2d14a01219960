"""The registered queries, with their production parameters, against SQL, libraries and brute force."""

import base64
import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from orrery.llm import pii, queries, shards
from tokenizers import Tokenizer

from ..conftest import DATA
from .test_dedup import brute_components, brute_spans, ids_of
from .test_search_and_filters import plain_spans, rule_of
from .test_transforms import brute_middle, brute_periods, collapsed

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs}


@pytest.fixture
def run(spark):
    return lambda name: queries.queries()[name](spark, SF).collect()


def test_names_and_sql():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracles()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_queries_match_their_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = c.execute(queries.oracles()[name])
    names = [d[0] for d in wanted.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(wanted.fetchall())


def test_url_verdicts_of_linked_pages_match_the_sql(spark, rand, tmp_path):
    """Hosts that link to each other, seeds at several distances: the limit of the ranks, in another engine."""
    r = rand(3)
    hosts = [f"{a}.{b}.{t}" for a in "abcdef" for b in ("x", "y", "example") for t in ("net", "com", "org", "io")]
    host = lambda: r.choice(hosts).upper() if r.random() < 0.2 else r.choice(hosts)
    links = lambda: "".join(f'<a class=1 href="http://{host()}/q">l</a>' for _ in range(r.randint(0, 3)))
    rows = [(k, f"https://{r.choice(hosts)}/{r.choice(['de', 'fr', 'en'])}/{k}", links() if r.random() < 0.9 else None) for k in range(600)]
    rows += [(600, None, links()), (601, "nothing", None), rows[0], (602, rows[1][1], "x" * 1_000_000 + links())]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    wanted = c.execute(queries.OP4_SQL)
    names = [d[0] for d in wanted.description]
    got = queries.op4_url_filters(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(wanted.fetchall(), key=repr)
    assert {g.verdict for g in got if g.rule is None} == {"allow", "block"}


def test_op2(run, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.BPE_RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = {}
    for d, t in texts.items():
        ids = library.encode_ordinary(t)
        wanted[d] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode()))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run("op2_byte_bpe")} == wanted


def test_op3(run, docs):
    spans = run("op3_substring_dedup")
    assert sorted(((r.doc_id, r.start, r.end, r.words) for r in spans), key=str) == ids_of(docs, brute_spans(docs)) and spans


def test_op4(spark, run):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = run("op4_url_filters")
    assert {r.page_id for r in got} == set(urls)
    for r in got:
        host, path, rule = rule_of(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict in ("allow", "block") and (not rule or r.verdict == rule[1])


def test_op5(run, texts):
    tokenizer = Tokenizer.from_file(P.path(queries.WORD_BPE))
    wanted = {}
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k in range(-(-len(ids) // 4096)):
            part = ids[4096 * k : 4096 * (k + 1)]
            wanted[d, k] = (4096 * k, len(part), zlib.crc32(part.tobytes()))
    got = run("op5_best_fit_packing")
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == wanted
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


def test_op6_shards(spark, tmp_path):
    """What the query reads back lies in files of the sizes that its tiers allow."""
    store = shards.shard_table(spark.read.parquet(f"{SF}/documents.parquet").repartition(6), f"{tmp_path}/s")
    held = store.manifest()["shards"]
    assert not store.runs(held) and all(s.tier == store.tier(s.bytes) for s in held)
    assert max(collections.Counter(s.tier for s in held).values()) < store.fan_in
    files = [f for f in (tmp_path / "s").rglob("*") if f.is_file() and f.suffix in (".parquet", ".json")]
    assert {f.name for f in files if f.suffix == ".parquet"} == {s.path.rsplit("/", 1)[1] for s in held}
    assert all(f.stat().st_size == s.bytes for f in files for s in held if f.name == s.path.rsplit("/", 1)[1])


def test_op8(run, docs):
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in run("op8_jaccard_join")) == brute_components(docs)


def test_op9(run, texts):
    for r in run("op9_pii"):
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_op10(run, texts):
    got = run("op10_quality_classifier")
    assert {r.doc_id for r in got} == set(texts) and all(0 <= r.p_bad <= 1 for r in got)


def test_op11(run, texts):
    got = {r.doc_id: r for r in run("op11_fill_in_middle")}
    assert set(got) == set(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, t in texts.items():
        n, form, prefix, middle, output = brute_middle(d, t)
        assert (got[d].n, got[d].form, got[d].prefix_chars, got[d].middle_chars, got[d].output_sha256, got[d].restored_sha256) == (n, form, prefix, middle, sha(output), sha(t))
    assert {r.form for r in got.values()} == {"plain", "psm", "spm"}


def test_op12(run, texts):
    got = {r.doc_id: r for r in run("op12_periodic_runs")}
    some = sorted(texts, key=lambda d: len(texts[d]))[:150]  # the plain version compares all pairs of words
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in some:
        words = [w for w in texts[d].encode().split()]
        g, tenth = divmod(zlib.crc32(str(d).encode()), 10)
        if tenth == 0 and words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        runs = brute_periods(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)) and r.collapsed_sha256 == sha(collapsed(words, runs))
    assert set(got) == set(texts) and any(r.n_runs for r in got.values())


def test_op13(run, texts, docs):
    got = {r.doc_id: r for r in run("op13_source_mix")}
    assert {d: r.size for d, r in got.items()} == {d: len(t.encode().split()) for d, t in texts.items()}
    sources = {}
    for r in docs:
        sources.setdefault(r.source, []).append(got[r.doc_id])
    total = sum(r.size for r in got.values())
    assert sum(rows[0].target for rows in sources.values()) == pytest.approx(1.5 * total)
    for rows in sources.values():
        size = sum(r.size for r in rows)
        assert {r.source_size for r in rows} == {size} and len({r.target for r in rows}) == 1 and rows[0].target <= 2 * size
        rate = rows[0].target / size
        assert all(r.taken in (r.size * int(rate), r.size * -int(-rate // 1)) for r in rows)
    assert sum(r.taken for r in got.values()) == pytest.approx(1.5 * total, rel=0.2)
