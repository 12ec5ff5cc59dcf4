"""The stages of the corpus pipeline on the smallest documents."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentflow.llm import minhash, simhash
from segmentflow.llm.queries import fold_of


def test_stages_take_effect_and_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34", "en", "s", 5)], docs.schema)
    secret = docs.limit(1).select(F.lit(10**6 + 3).cast("long").alias("doc_id"), F.concat("text", F.lit(" password=hunter2hunter2 end")).alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(secret).unionByName(docs.limit(5)).cache()
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        counts.append(out.count())
        if name == "language":
            assert out.where("doc_id between 1000000 and 1000002").count() == 0
        if name == "near_dedup":
            assert out.count() == out.select("doc_id").distinct().count()
            again = simhash.near_duplicates(out, width=corpus_pipeline.SHINGLE_WORDS)
            assert again.where("doc_id <> component_id").count() == 0
        if name == "secrets":
            assert out.where("text like '%hunter2hunter2%'").count() == 0 and out.count() == docs.count()
            assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        if name == "packing":
            assert out.select("doc_id").distinct().count() == docs.count()
        else:
            assert out.columns == columns
        docs = out
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0


def test_run_of_the_whole_pipeline(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_near_dedup_stage_drops_similar_texts_only(spark, sf_dir):
    words = [f"w{i}" for i in range(200)]
    near, far = [*words[:100], "x", *words[101:]], [w if i % 20 else "y" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, near, far))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()) == [0, 2]


def test_near_dedup_stage_links_by_the_simhash_operator(spark, sf_dir, monkeypatch):
    """Without any MinHash key, fingerprints within two bits still link, once whole sets are alike."""
    words = [f"w{i}" for i in range(400)]
    variants = [" ".join([*words[:i], "x", *words[i + 1 :]]) for i in range(0, 400, 5)]
    own = simhash.fingerprint(" ".join(words).encode(), 5)
    bits = lambda v: ((simhash.fingerprint(v.encode(), 5) ^ own) & (2**64 - 1)).bit_count()
    near, far = (next(v for v in variants if wanted(bits(v))) for wanted in (lambda n: 0 < n <= 2, lambda n: n > 4))
    docs = spark.createDataFrame(list(enumerate([" ".join(words), near, far, "other words", None])), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).orderBy("doc_id").collect()] == [0, 3, 4]
    real = minhash.signatures
    monkeypatch.setattr(minhash, "signatures", lambda *a: real(*a).withColumn("keys", F.array().cast("array<long>")))
    assert [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).orderBy("doc_id").collect()] == [0, 2, 3, 4]


def test_language_stage_drops_noise_and_unlearned_languages_only(spark, sf_dir):
    rng = random.Random(1)
    planted = [
        "Zażółć gęślą jaźń. Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
        "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心",
        "".join(rng.choices("abcdefghijklmnopqrstuvwxyz   ", k=400)),
    ]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(planted)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.unionByName(extra), sf_dir).select("doc_id").collect()}
    assert not any(i >= 10**6 for i in kept)
    lettered = docs.where(F.col("text").rlike("[A-Za-z]") & (fold_of("doc_id", 3) == 1)).select("doc_id").collect()
    assert np.mean([r.doc_id in kept for r in lettered]) > 0.98


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_no_rows_and_of_clashing_columns(spark, sf_dir, name):
    """Every stage gives no rows for no rows, and all but the last pass columns with the names used inside."""
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    if name == "packing":
        return
    names = ["lang_pred", "lang_score", "toxic_score", "doc", "root", "text_key", "digest", "cuts", "a.b"]
    wide = docs.limit(60).withColumns({n: F.lit("k") for n in names})
    out = stage(spark, wide, sf_dir)
    assert out.columns == wide.columns
    got = out.collect()
    assert got and all(list(r)[-len(names) :] == ["k"] * len(names) for r in got)
