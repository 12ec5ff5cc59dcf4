"""Ranked lexical search in whole numbers over a length-stratified index.

A document's normaliser m depends on its length only, so documents of equal m are one stratum.  Within a
stratum the postings of a term are kept by tf, and an impact is computed once per tf.  The largest tf of a
term bounds what the stratum can add, so each query visits strata by falling bound and stops at the first
one below its k-th best score.

The index is dealt by ranges of (m, a hash), so a stratum of any size spreads over tasks; a task holds
``BLOCK_POSTINGS`` at a time.  Queries are read in blocks of ``QUERY_TERMS`` distinct (query, term) pairs, or of
one longer query, so what tasks hold of them is bounded too.  On large tables, the k-th best score of each
query within a 64th of the documents is found first; it is no more than the final one, so blocks and strata
that cannot reach it are left out without changing a result.

Defined results: null texts have no terms; documents without terms count in nothing; repeated rows are ranked
each, with ranks of their own; equal scores rise by id, null ids last; every row of items is an item of its
own; an empty table gives no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentflow.llm.columns import column
from segmentflow.llm.tokens import ALPHANUMERIC, chunks, words
from segmentflow.session import ensure_checkpoint_dir

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
QUERY_TERMS = 200_000
BLOCK_POSTINGS = 4_000_000
BLOCK_DOCUMENTS = 50_000
#: Thresholds are sought first from so many documents on, in so large a share of them.
SEEK_FIRST, SEEK_SHARE = 100_000, 64
#: Of the score: scale of weights and impacts, and the parts of the normaliser.
W_SCALE, IMPACT_SCALE, TF_SCALE, M_SCALE, M_FLAT, M_SLOPE = 1000, 1_000_000_000, 1000, 12, 75, 25


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, item, term, times) with one query number per row of items."""
    own = F.regexp_extract_all(column(text_col).cast("string"), F.lit(TERM), 0)
    rows = items.select(F.monotonically_increasing_id().alias("query"), column(id_col).alias("item"), own.alias("own")).checkpoint()
    terms = rows.select("query", "item", F.explode("own").alias("term")).withColumn("term", F.translate("term", UPPER, UPPER.lower()))
    return terms.groupBy("query", "item", "term").agg(F.count("*").alias("times"))


def document_terms(docs: DataFrame, vocabulary: pa.Array, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) per row: all terms counted, those of the vocabulary by number, as little-endian int32."""
    chosen = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.to_pylist())
    out = T.StructType([chosen.schema["id"], *T._parse_datatype_string("n long, terms binary, tfs binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for _, data, offsets in chunks(batch.column(1)):
                found, rows = words(data, offsets, ALPHANUMERIC), len(offsets) - 1
                number = pc.fill_null(pc.index_in(found.array(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                key, tf = np.unique(found.row[number >= 0] * len(known) + number[number >= 0], return_counts=True)
                row, term = np.divmod(key, max(1, len(known)))
                cut = np.searchsorted(row, np.arange(rows + 1))
                sizes += np.bincount(found.row, minlength=rows).tolist()
                term, tf = term.astype("<i4"), tf.astype("<i4")
                terms += [term[a:b].tobytes() for a, b in zip(cut, cut[1:])]
                tfs += [tf[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], out.names)

    return chosen.mapInArrow(run, out)


def document_frequencies(told: DataFrame, n_terms: int) -> np.ndarray:
    """The number of documents of each term; counted per batch, then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=n_terms)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["term", "df"])

    rows = told.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, dtype=np.int64)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return df


class Stratum(NamedTuple):
    """Documents of one m; postings by term, then by tf; their impacts; the largest impact of each term."""

    documents: np.ndarray
    starts: np.ndarray
    posted: np.ndarray
    impact: np.ndarray
    most: np.ndarray


def strata(m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int) -> list[Stratum]:
    """The strata of a block; row tells each posting's document."""
    out = []
    order = np.lexsort((tf, term, m[row]))
    row, term, tf = row[order], term[order], tf[order]
    edges = np.flatnonzero(np.diff(m[row])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(row)]):
        documents, posted = np.unique(row[a:b], return_inverse=True)
        kinds, kind = np.unique(tf[a:b], return_inverse=True)
        of_kind = IMPACT_SCALE * kinds.astype(np.int64) // (TF_SCALE * kinds.astype(np.int64) + M_SCALE * m[documents[0]])
        impact, starts = of_kind[kind], np.searchsorted(term[a:b], np.arange(n_terms + 1))
        held = starts[1:] > starts[:-1]
        most = np.zeros(n_terms, dtype=np.int64)
        most[held] = impact[starts[1:][held] - 1]
        out.append(Stratum(documents, starts, posted, impact, most))
    return out


def best_of_block(own: list[Stratum], ranks: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray]], floors: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, documents, scores): the k best of a block per query, if they reach its floor; ranks order equal scores."""
    bounds = np.array([[int(s.most[t] @ w) for s in own] for t, w in queries], dtype=np.int64).reshape(len(queries), len(own))
    for query, (terms, weights) in enumerate(queries):
        docs, scores, least = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), max(1, int(floors[query]))
        for at in np.argsort(-bounds[query], kind="stable"):
            if bounds[query, at] < least:
                break
            s = own[at]
            sizes = s.starts[terms + 1] - s.starts[terms]
            ends = np.cumsum(sizes)
            picked = np.arange(ends[-1]) + np.repeat(s.starts[terms] - ends + sizes, sizes)
            score = np.zeros(len(s.documents), dtype=np.int64)
            np.add.at(score, s.posted[picked], s.impact[picked] * np.repeat(weights, sizes))
            good = np.flatnonzero(score >= least)
            docs, scores = np.concatenate([docs, s.documents[good]]), np.concatenate([scores, score[good]])
            if len(docs) > k:
                keep = np.lexsort((ranks[docs], -scores))[:k]
                docs, scores = docs[keep], scores[keep]
            if len(docs) == k:
                least = max(least, int(scores.min()))
        if len(docs):
            yield query, docs, scores


def _found(index: DataFrame, queries: list, n_terms: int, floors: np.ndarray, k: int) -> DataFrame:
    """(query, id, score): the best of every block of the index."""
    shared = index.sparkSession.sparkContext.broadcast((queries, floors))
    out = T.StructType([T.StructField("at", T.LongType()), index.schema["id"], T.StructField("score", T.LongType())])

    def told(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(batches)
        terms, tfs = block.column("terms").to_pylist(), block.column("tfs").to_pylist()
        row = np.repeat(np.arange(len(terms)), [len(t) // 4 for t in terms])
        term, tf = (np.frombuffer(b"".join(x), "<i4").astype(np.int64) for x in (terms, tfs))
        ids = block.column("id").combine_chunks()
        ranks = np.empty(len(ids), dtype=np.int64)
        ranks[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        found = [*best_of_block(strata(block.column("m").to_numpy(), row, term, tf, n_terms), ranks, *shared.value, k)]
        at = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
        docs, scores = (np.concatenate([np.zeros(0, dtype=np.int64), *(f[i] for f in found)]) for i in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(at), ids.take(pa.array(docs)), pa.array(scores)], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                postings += sum(len(t) // 4 for t in batch.column(2).to_pylist())
            if postings >= BLOCK_POSTINGS:
                yield told(held)
                held, postings = [], 0
        if held:
            yield told(held)

    return index.select("id", "m", "terms", "tfs").mapInArrow(run, out)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, own: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, id, score) for a bounded block of query terms."""
    spark = docs.sparkSession
    rows = own.toArrow().combine_chunks()
    known = pc.unique(rows.column("term").combine_chunks()).sort()
    told = document_terms(docs, known.cast(pa.large_binary()), id_col, text_col).checkpoint()
    n, total = (int(x or 0) for x in told.agg(F.count_if(F.col("n") > 0), F.sum(F.col("n").cast("decimal(38,0)"))).first())
    df = spark.createDataFrame([(int(x),) for x in document_frequencies(told, len(known))], "df long")
    weight = F.floor(W_SCALE * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df").cast("double") + 1)))
    weights = np.array([w for (w,) in df.select(weight.cast("long")).collect()], dtype=np.int64)

    term = pc.index_in(rows.column("term"), known).to_numpy().astype(np.int64)
    query, times = rows.column("query").to_numpy(), rows.column("times").to_numpy()
    order = np.argsort(query, kind="stable")
    names, cuts = np.unique(query[order], return_index=True)
    parts = np.split(order, cuts[1:])
    queries = [(term[p], weights[term[p]] * times[p]) for p in parts]
    items = rows.column("item").take(pa.array([p[0] for p in parts], pa.int64()))

    m = F.expr(f"{M_FLAT} + ({M_SLOPE} * cast(n as decimal(18,0)) * cast({n} as decimal(18,0))) div cast({max(1, total)} as decimal(38,0))")
    index = told.where(F.length("terms") > 0).select("id", m.cast("long").alias("m"), "terms", "tfs", F.xxhash64("id", "terms").alias("spread"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // BLOCK_DOCUMENTS)
    floors = np.zeros(len(queries), dtype=np.int64)
    if n >= SEEK_FIRST:
        some = index.where(F.pmod("spread", F.lit(SEEK_SHARE)) == 0)
        for at, score in _ranked(_found(some, queries, len(known), floors, k), k).where(F.col("rank") == k).select("at", "score").collect():
            floors[at] = score
    found = _found(index.repartitionByRange(tasks, "m", "spread"), queries, len(known), floors, k)
    named = spark.createDataFrame(pa.table({"at": pa.array(range(len(names)), pa.int64()), "item": items}))
    return _ranked(found, k).join(F.broadcast(named), "at").select("item", "rank", "id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(item, rank, id, score): each item's k documents of the highest score above 0, under the names of both id columns."""
    ensure_checkpoint_dir(docs.sparkSession)
    terms = query_terms(items, item_col, item_text).checkpoint()
    pairs = terms.count()
    blocks = -(-pairs // QUERY_TERMS)
    own = terms.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, blocks))))
    out = None
    for block in range(blocks):
        part = own.where(F.col("block") == block)
        if blocks > 1 and part.isEmpty():
            continue
        found = _search_block(docs, part, k, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    if out is None:  # no item has a term
        ids = docs.select(column(id_col).alias("id")).limit(0)
        out = terms.select("item", F.lit(1).alias("rank"), "times").join(ids, F.lit(False)).select("item", "rank", "id", F.col("times").alias("score"))
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
