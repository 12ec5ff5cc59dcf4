"""Corpus pipeline over ``documents``: language ID, toxicity, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in
the shared checkpoint folder and hands the reread table to the next stage.  The folder of a run stays there
until the cluster clears it.  All but the last stage return exactly the columns of docs, extra ones and
ones with the names used inside included.

Defined results of every stage: an empty table gives an empty one; null ids are rows like any other, but
train no model; repeated rows are judged alike, and near-dedup keeps one of them; texts of any length are
read whole.  Null and empty texts are ``und`` and leave in the first stage; given to a later stage alone,
they count as not toxic, as copies of each other, as free of secrets, and as one end-of-text id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentflow.llm import langid, minhash, packing, secret_scan, toxicity
from segmentflow.llm.batches import small_batches
from segmentflow.llm.columns import column, fresh
from segmentflow.llm.queries import fold_of, packed_pieces
from segmentflow.session import ensure_checkpoint_dir, table

SHINGLE_WORDS = 5
#: SQL cannot express the models, fingerprints and plans of the stages; tests compare them with brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised; texts without letters, noise and unlearned languages go.

    Without any row to learn from, no language is recognised and all documents go.
    """
    model = langid.fit(docs, fold_of("doc_id", 3) != 1)
    lang, score = (fresh(n, docs.columns) for n in ("lang_pred", "lang_score"))
    told = langid.predict(docs, model, only_learned=True, names=(lang, score))
    return told.where(F.col(lang) != langid.UND).select(*map(column, docs.columns))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents scored 0.5 or more; without any toxic label, all documents stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    score = fresh("toxic_score", docs.columns)
    return toxicity.score(docs, model, name=score).where(F.col(score) < 0.5).select(*map(column, docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    SimHash fingerprints within two bits and then MinHash bands propose, whole sets decide.
    The smallest id stays, of equal ids the smallest text; a null id stays only where its group has no other.
    """
    return minhash.keep_first(docs, width=SHINGLE_WORDS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every reported secret; all documents stay, and n_chars, where there is one, follows the text."""
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into windows of 1024 tokens; one row per piece, in no order; equal documents are packed each."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    return packed_pieces(packing.pack(docs, path, pattern))


def _bounded(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, its texts in Arrow batches of bounded size."""

    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return function(spark, docs, sf_dir)

    return stage


STAGES = [
    ("language", _bounded(known_language)),
    ("toxicity", _bounded(not_toxic)),
    ("near_dedup", _bounded(one_of_each)),
    ("secrets", _bounded(without_secrets)),
    ("packing", _bounded(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        name, function = stage
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
