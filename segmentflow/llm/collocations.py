"""Phrase collocations by SETM: persisted occurrence relations, merge-joined, counted and semi-joined level by level.

The occurrences of a language are cut into blocks of whole documents.  A block's relation of level k holds the
sorted positions of its k-word phrases, each with a number; positions skip one between pieces, so positions that
follow each other lie in one piece.  One step from k to k+1 words merge-joins a relation of frequent groups with
itself at adjacent positions and counts the pairs of each block.  A pair of (first k words, last k words) is an
exact name of k+1 words.  Pairs are dealt by hash to shards of about ``SHARD_PAIRS``, in packed chunks; a shard
sums the blocks' counts, and groups of ``least`` occurrences come back to the blocks that hold them, where a
semi-join leaves the relation of the next level.  Relations and groups are written as tables in the shared
checkpoint folder; a crowded word or phrase has one count per block at most.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each; a
document of any length is read whole and stays in one block; an empty table gives no rows; other columns are
ignored.  Products are decimals of 38 digits: exact up to 10^17 words in a language, an error beyond.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.llm.columns import column
from segmentflow.llm.tokens import chunks, words
from segmentflow.session import ensure_checkpoint_dir

UND = "und"
#: Words of one block, and of all unfinished blocks of a task.
BLOCK_WORDS, OPEN_WORDS = 2_000_000, 4_000_000
_WORD = np.array([b not in b" \t.,;:!?\n\x0b\x0c\r" for b in range(256)])
_BREAK = np.array([b in b".,;:!?\n\x0b\x0c\r" for b in range(256)])
#: Occurrences whose pairs one shard counts.
SHARD_PAIRS = 2_000_000
RELATION = -1
#: Rows of code RELATION hold a block's relation, the others its words: own number, name, occurrences.
FIRST = "block long, code long, lang string, word string, n long, relation binary"
CHUNKS = "shard long, block long, pairs binary"
#: A row per frequent pair (block is null) and a row per block and shard with the pairs (left, right, id) it holds.
GROUPS = "block long, pairs binary, `left` long, `right` long, id long, total long"


def _packed(*columns: np.ndarray) -> bytes:
    """Equally long columns of whole numbers, compressed."""
    raw = b"".join(x.astype("<i8" if len(x) and x.max() >= 1 << 31 else "<i4").tobytes() for x in columns)
    widths = bytes(8 if len(x) and x.max() >= 1 << 31 else 4 for x in columns)
    return bytes([len(columns)]) + widths + len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    widths = blob[1 : 1 + blob[0]]
    n = int.from_bytes(blob[1 + blob[0] : 9 + blob[0]], "little")
    raw = pa.decompress(blob[9 + blob[0] :], decompressed_size=n * sum(widths), codec="zstd", asbytes=True)
    edges = np.cumsum([0, *(n * w for w in widths)])
    return [np.frombuffer(raw[a:b], f"<i{w}").astype(np.int64) for a, b, w in zip(edges, edges[1:], widths)]


def _relation(positions: np.ndarray, names: np.ndarray) -> bytes:
    return _packed(np.diff(positions, prepend=0), names)


def _read(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, names = _unpacked(blob)
    return np.cumsum(steps), names


def word_relations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """FIRST: the words of every block with their occurrences, and its relation of level 1."""
    chosen = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit(UND)).alias("lang"), column(text_col).cast("string").alias("text"))
    names = ["block", "code", "lang", "word", "n", "relation"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, made = {}, TaskContext.get().partitionId() << 32

        def closed(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            parts = open_.pop(lang)
            coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
            codes = coded.indices.to_numpy()
            own = coded.dictionary.cast(pa.large_string()).cast(pa.string())
            last, positions = -2, []
            for _, at in parts:  # one place stays free between parts, as their documents differ
                positions.append(at + last + 2)
                last = int(positions[-1][-1])
            n, counts = len(own), np.bincount(codes, minlength=len(own))
            columns = [
                pa.array(np.full(n + 1, made)), pa.array(np.append(np.arange(n), RELATION)), pa.array([lang] * (n + 1)),
                pa.concat_arrays([own, pa.nulls(1, pa.string())]), pa.array(np.append(counts, len(codes))),
                pa.array([None] * n + [_relation(np.concatenate(positions), codes)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        size = lambda lang: sum(len(p[0]) for p in open_[lang])
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                texts = batch.column(1).filter(pa.array([x == lang for x in langs]))
                for _, data, offsets in chunks(texts):
                    found = words(data, offsets, _WORD)
                    if not len(found.row):
                        continue
                    piece = np.cumsum(_BREAK[data], dtype=np.int64)[found.start]
                    new = (np.diff(piece) > 0) | (np.diff(found.row) > 0)
                    at = np.arange(len(found.row)) + np.concatenate([[0], np.cumsum(new)])
                    open_.setdefault(lang, []).append((found.array(), at))
                    if size(lang) >= BLOCK_WORDS:
                        yield closed(lang)
            while sum(map(size, open_)) >= OPEN_WORDS:
                yield closed(max(open_, key=size))
        for lang in [*open_]:
            yield closed(lang)

    return chosen.mapInArrow(run, FIRST)


def _adjacent(at: np.ndarray) -> np.ndarray:
    """The merge-join of a relation with itself by piece and adjacent position: first rows of the pairs."""
    return np.flatnonzero(np.diff(at) == 1)


def _with_ids(own: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The relation of level 1 semi-joined with the frequent words (left: number, id) of its block."""
    at, codes = _read(own.column("relation")[0].as_py())
    numbers, ids = (words.column(c).to_numpy() for c in ("left", "id"))
    id_of = np.full(int(max(codes.max(), numbers.max(initial=0))) + 1, -1)
    id_of[numbers] = ids
    named = id_of[codes]
    return at[named >= 0], named[named >= 0]


def _chunks(block: int, at: np.ndarray, ids: np.ndarray, shards: int) -> pa.Table:
    """CHUNKS: the pairs of a block with their counts, by shard."""
    names = ["shard", "block", "pairs"]
    first = _adjacent(at)
    kinds, code = np.unique(ids, return_inverse=True)
    pairs, counts = np.unique(code[first] * len(kinds) + code[first + 1], return_counts=True)
    left, right = (kinds[x] for x in np.divmod(pairs, max(1, len(kinds))))
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    shard = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    found, cuts = np.unique(shard[order], return_index=True)
    blobs = [_packed(left[p], right[p], counts[p]) for p in np.split(order, cuts[1:])] if len(found) else []
    return pa.table([pa.array(found, pa.int64()), pa.array(np.full(len(found), block), pa.int64()), pa.array(blobs, pa.binary())], names=names)


def _pair_chunks(relation: DataFrame, words_: DataFrame | None, shards: int) -> DataFrame:
    """CHUNKS of all blocks; words_ are given for the relations of level 1, whose names are numbers of words."""

    def of_words(own: pa.Table, known: pa.Table) -> pa.Table:
        none = np.zeros(0, dtype=np.int64)
        at, ids = _with_ids(own, known) if own.num_rows and known.num_rows else (none, none)
        return _chunks(own.column("block")[0].as_py() if own.num_rows else 0, at, ids, shards)

    def of_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _chunks(block, *_read(blob), shards).to_batches()

    if words_ is None:
        return relation.select("block", "relation").mapInArrow(of_phrases, CHUNKS)
    return relation.select("block", "relation").groupBy("block").cogroup(words_.groupBy("block")).applyInArrow(of_words, CHUNKS)


def counted_pairs(chunks: DataFrame, least: int) -> DataFrame:
    """GROUPS: the frequent pairs with an id and their occurrences, and which of them each block holds."""

    def count(chunk: pa.Table) -> pa.Table:
        shard = chunk.column("shard")[0].as_py()
        read = [_unpacked(x) for x in chunk.column("pairs").to_pylist()]
        left, right, n = (np.concatenate(x) for x in zip(*read))
        block = np.repeat(chunk.column("block").to_numpy(), [len(x[0]) for x in read])
        order = np.lexsort((block, right, left))
        left, right, n, block = left[order], right[order], n[order], block[order]
        chief = np.ones(len(left), dtype=bool)
        chief[1:] = (np.diff(left) != 0) | (np.diff(right) != 0)
        group = np.cumsum(chief) - 1
        total = np.bincount(group, weights=n)[group].astype(np.int64) if len(n) else n  # below 2^53, so exact
        ids, kept = (shard << 32) + group, total >= least
        own = kept & chief
        order = np.flatnonzero(kept)[np.argsort(block[kept], kind="stable")]
        blocks, cuts = np.unique(block[order], return_index=True)
        blobs = [_packed(left[p], right[p], ids[p]) for p in np.split(order, cuts[1:])] if len(blocks) else []
        n_own, n_blocks = int(own.sum()), len(blocks)
        none = pa.nulls(n_blocks, pa.int64())
        columns = [
            pa.concat_arrays([pa.nulls(n_own, pa.int64()), pa.array(blocks, pa.int64())]),
            pa.array([None] * n_own + blobs, pa.binary()),
            *[pa.concat_arrays([pa.array(x[own], pa.int64()), none]) for x in (left, right, ids, total)],
        ]
        return pa.table(columns, names=["block", "pairs", "left", "right", "id", "total"])

    return chunks.groupBy("shard").applyInArrow(count, GROUPS)


def _semi_joined(own: pa.Table, frequent: pa.Table, from_words: bool) -> pa.Table:
    """(block, n, relation): the pairs of a block's relation that are frequent, as the relation of the next level."""
    names = ["block", "n", "relation"]
    empty = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("relation", pa.binary())]).empty_table()
    blobs = frequent.column("pairs").drop_null().to_pylist()
    if not own.num_rows or not blobs:
        return empty
    if from_words:
        at, ids = _with_ids(own, frequent.filter(pc.is_null(frequent.column("pairs"))))
    else:
        at, ids = _read(own.column("relation")[0].as_py())
    first = _adjacent(at)
    kinds, code = np.unique(ids, return_inverse=True)
    left, right, new = (np.concatenate(x) for x in zip(*map(_unpacked, blobs)))
    pairs = np.searchsorted(kinds, left) * len(kinds) + np.searchsorted(kinds, right)
    order = np.argsort(pairs)
    pairs, new = pairs[order], new[order]
    asked = code[first] * len(kinds) + code[first + 1]
    place = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
    hit = pairs[place] == asked
    blob = _relation(at[first[hit]], new[place[hit]])
    return pa.table([[own.column("block")[0].as_py()], [int(hit.sum())], pa.array([blob], pa.binary())], names=names)


def _frequent_words(level: DataFrame, least: int) -> DataFrame:
    """(block, code, id, chief, lang, word, total) of words with the least total; one row of each id is its chief."""
    same = Window.partitionBy("lang", "word")
    rows = level.where(F.col("code") != RELATION).select("block", "code", "lang", "word", "n", F.monotonically_increasing_id().alias("row_id"))
    summed = rows.withColumn("total", F.sum("n").over(same)).withColumn("id", F.min("row_id").over(same))
    return summed.where(F.col("total") >= least).select("block", "code", "id", (F.col("id") == F.col("row_id")).alias("chief"), "lang", "word", "total")


def phrases(docs: DataFrame, least: int = 100, most_words: int = 5, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and per length (id, left, right, lang, phrase, total, firsts, lasts) of the frequent phrases.

    firsts and lasts are the occurrences of the first and of the last 1, 2, ... words of the phrase.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/phrases-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    level = written(word_relations(docs, lang_col, text_col), "relations-1")
    sizes = level.where(F.col("code") == RELATION).groupBy("lang").agg(F.sum("n").alias("n"))
    words_ = written(_frequent_words(level, least), "groups-1")
    alone = F.array("total")
    found = [words_.where("chief").select("id", "lang", F.col("word").alias("phrase"), "total", alone.alias("firsts"), alone.alias("lasts"))]
    relation = level.where(F.col("code") == RELATION).select("block", "n", "relation")
    by_number = words_.select("block", F.lit(None).cast("binary").alias("pairs"), F.col("code").alias("left"), "id")
    for size in range(2, most_words + 1):
        occurrences = relation.agg(F.sum("n")).first()[0] or 0
        chunks_ = _pair_chunks(relation, by_number if size == 2 else None, max(1, -(-int(occurrences) // SHARD_PAIRS)))
        groups = written(counted_pairs(chunks_, least), f"groups-{size}")
        if size < most_words:
            frequent = groups.where(F.col("block").isNotNull()).select("block", "pairs", "left", "id")
            frequent = frequent.unionByName(by_number) if size == 2 else frequent
            step = partial(_semi_joined, from_words=size == 2)
            joined = relation.groupBy("block").cogroup(frequent.groupBy("block"))
            relation = written(joined.applyInArrow(step, "block long, n long, relation binary"), f"relations-{size}")
        one = found[-1]
        last = F.substring_index(F.col("phrase_right"), " ", -1)
        left = one.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("phrase_left"), "firsts")
        right = one.select(F.col("id").alias("right"), F.col("phrase").alias("phrase_right"), "lasts")
        named = groups.where(F.col("block").isNull()).select("id", "left", "right", "total").join(left, "left").join(right, "right").select(
            "id", "left", "right", "lang", F.concat_ws(" ", "phrase_left", last).alias("phrase"), "total",
            F.concat("firsts", F.array("total")).alias("firsts"), F.concat("lasts", F.array("total")).alias("lasts"),
        )
        found.append(written(named, f"phrases-{size}"))
    return sizes, found


def _cuts(n_words: int) -> Column:
    """The scores of all cuts with their parts, in whole numbers of up to 38 digits; the lowest, then shortest first part."""
    wide = lambda x: x.cast("decimal(19,0)")
    cuts = []
    for at in range(1, n_words):
        first, rest = F.get("firsts", F.lit(at - 1)), F.get("lasts", F.lit(n_words - at - 1))
        share = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(F.col("total")) * wide(F.col("n")), wide(first) * wide(rest))
        cuts.append(F.struct(share.cast("long").alias("score"), F.lit(at).alias("at"), first.alias("l"), rest.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(
    docs: DataFrame, least: int = 100, most_words: int = 5, absorbed: int = 100, k: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first k phrases by score.

    A phrase goes if a longer one around it occurs at least ``absorbed`` hundredths as often.  One word more at
    either side is enough to look at: what lies around that is no more frequent.
    """
    sizes, found = phrases(docs, least, most_words, lang_col, text_col)
    scored = None
    for n_words in range(2, most_words + 1):
        own = found[n_words - 1]
        if n_words < most_words:
            more = found[n_words]
            around = more.select(F.col("left").alias("id"), "total").unionByName(more.select(F.col("right").alias("id"), "total"))
            around = around.groupBy("id").agg(F.max("total").alias("around"))
            own = own.join(around, "id", "left").where(F.col("around").isNull() | (100 * F.col("around") < absorbed * F.col("total")))
        own = own.join(sizes, "lang").withColumn("cut", _cuts(n_words))
        own = own.select("lang", "phrase", F.col("total").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        scored = own if scored is None else scored.unionByName(own)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
