"""The pipeline, stage by stage, against plain versions of the same decisions on collected rows."""

import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from orrery.llm import pii, quality
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..conftest import DATA
from .test_dedup import brute_components, norm
from .test_search_and_filters import plain_spans

SF = f"{DATA}/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    """The table, with copies, near copies, empty texts and a null added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.concat(F.lit(" "), F.col("text"), F.lit("\n")))
    last = spark.createDataFrame([(2 * 10**6, None, "en", "s", 0), (2 * 10**6 + 1, "", "en", "s", 0)], docs.schema)
    return docs.union(more).union(last)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages_follow_the_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "jaccard_join", "pii", "best_fit_packing"]


def test_quality_stage_is_the_scorers_verdict(spark, documents):
    kept = STAGES["quality_classifier"](spark, documents, SF)
    model = quality.train(documents)
    codes, counts = np.unique([quality.votes(r.text or "", (r.text or "").split()) for r in documents.collect()], return_counts=True)
    chance, tables, _ = quality.posteriors(codes, counts.astype(float))
    assert np.allclose(tables, model.tables) and {int(c): pytest.approx(p) for c, p in zip(codes, chance, strict=True)} == model.chance
    hashed = quality.Hashed()
    wanted = sorted(r.doc_id for r in documents.collect() if 1 / (1 + np.exp(-(hashed((r.text or "").split()) @ model.weights))) < quality.REJECT)
    assert ids(kept) == wanted and kept.columns == documents.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = set(wanted)
    good, bad = ([d in stay for d in labels if labels[d] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_exact_dedup_stage(spark, documents):
    kept = STAGES["exact_dedup"](spark, documents, SF)
    best = {}
    for r in documents.collect():
        k = (-len(r.text or ""), r.doc_id)
        best[norm(r.text)] = min(best.get(norm(r.text), k), k)
    assert ids(kept) == sorted(d for _, d in best.values()) and kept.columns == documents.columns


def test_jaccard_stage(spark, documents):
    some = documents.filter("doc_id < 120 OR doc_id >= 1000000")
    kept = STAGES["jaccard_join"](spark, some, SF)
    assert ids(kept) == sorted({c for _, _, c in brute_components(some.collect())}) and kept.columns == documents.columns


def test_pii_stage(spark, documents):
    before = {r.doc_id: r.text for r in documents.collect()}
    kept = STAGES["pii"](spark, documents, SF)
    assert kept.columns == documents.columns
    after = {r.doc_id: r.text for r in kept.collect()}
    assert set(after) == set(before)
    for doc, text in after.items():
        if before[doc] is None:
            assert text is None
            continue
        base = plain_spans(before[doc])
        assert (text == before[doc]) == (not base and not next(pii.detect([before[doc]], pii.default_field()))[1])
        for kind, start, end in base:
            if kind == "email":
                assert before[doc][start:end] not in text
        outside = re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", text)
        assert len(outside) <= len(before[doc])


def test_the_whole_run(spark):
    """All stages in a row: what is packed is what the stages keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    packed = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == lengths


def test_every_stage_takes_an_empty_table(spark, documents):
    docs = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
