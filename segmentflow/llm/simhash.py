"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments.  Of two fingerprints that differ in at most two
bits, one segment differs in at most one, so both own a common variant of that segment with one bit left
out.  Variants meet in an equality join and the full distance is verified.

Copies share a fingerprint and are one node.  A variant shared by more than ``SMALL_BUCKET``
fingerprints is never paired: its members get exact residual keys (one bit left out on the other side
too, or none here and two there), whose groups lie within two bits of each other and link as stars.
Nothing is capped: small buckets are compared in full, larger ones by residual keys, with equal results.

Defined results: null and empty texts, and texts of white space, have fingerprint zero and link with
each other; texts of any length are hashed whole, in pieces of bounded memory; repeated rows each give
a row; a null id never names a component unless all ids of the component are null; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentflow.llm.columns import column
from segmentflow.llm.graph import components, first_rows, named_by_first, spread_join
from segmentflow.session import ensure_checkpoint_dir

SEED = 42
SMALL_BUCKET = 32
CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of an ASCII-lower-cased text, in chunks; nothing for no words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not words:
        return
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[: len(words) - width]]
    stops = ends[width - 1 :]
    of = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK], stops[at : at + CHUNK])
        yield np.array([of(joined[a : b - 1], SEED) for a, b in pairs], dtype=np.uint64)


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The signed 64-bit fingerprint of a text."""
    return fingerprint_of(shingle_hashes(text or b"", width))


def fingerprint_of(chunks: Iterable[np.ndarray]) -> int:
    """The signed 64-bit fingerprint of hashes: a bit is set if over half of them set it."""
    counts, total = np.zeros((8, 256), dtype=np.int64), 0
    lanes = np.arange(8, dtype=np.int64) * 256
    for hashes in chunks:
        total += len(hashes)
        lane_bytes = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + lanes
        counts += np.bincount(lane_bytes.ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _BITS).ravel() > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = [fingerprint(texts[i].as_py(), width) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["node_id", "fingerprint"])

    chosen = docs.select(column(id_col).alias("node_id"), column(text_col).cast("string").alias("text"))
    schema = T.StructType([chosen.schema["node_id"], T.StructField("fingerprint", T.LongType())])
    return chosen.mapInArrow(run, schema)


def _segment(print_: Column, which: Column) -> Column:
    return F.when(which == 0, print_.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(print_, 32))


def _without(value: Column, bit: Column) -> Column:
    """The value with one of its 32 bits cleared."""
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))))


def _pack(high: Column, low: Column) -> Column:
    """high * 2^32 + low."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low)


def links(prints: DataFrame) -> DataFrame:
    """(src, dst): links that connect all distinct fingerprints within two bits of each other.

    Every link is between fingerprints within two bits; groups are linked as stars, so the links span
    the components rather than list every pair.
    """
    spark = prints.sparkSession
    ensure_checkpoint_dir(spark)
    p = F.col("fingerprint")
    # Fingerprints are small and their 64 variants are not: spread them over tasks before they multiply.
    # (By a hash: by the fingerprint itself the exchange is the one below and gets coalesced with it.)
    prints = prints.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fingerprint"))
    variant = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: _pack(i, _without(_segment(p, F.floor(i / 32)), i % 32)),
    )
    keyed = prints.select("fingerprint", F.explode(variant).alias("key"))
    # Spark sizes a table as if explode made one row of each, so without the hint it would broadcast all variants of
    # some 400,000 fingerprints.
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes.hint("merge"), "key").checkpoint()

    small = shared.where(F.col("n") <= SMALL_BUCKET)
    pairs = (
        small.select("key", F.col("fingerprint").alias("src"))
        .join(small.select("key", F.col("fingerprint").alias("dst")), "key")
        .where((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2))
        .select("src", "dst")
    )

    hot = shared.where(F.col("n") > SMALL_BUCKET)
    if hot.isEmpty():
        return pairs.distinct()
    which = F.shiftright("key", 37)  # the segment that the variant belongs to
    other = _segment(p, F.lit(1) - which)
    one = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _pack(i, _without(other, i)))
    near_both = hot.select("fingerprint", F.col("key").alias("k1"), F.explode(one).alias("k2"))
    same = hot.select("fingerprint", which.alias("which")).distinct()
    rest = _segment(p, F.lit(1) - F.col("which"))
    two = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(31)),
            lambda i: F.transform(
                F.sequence(F.lit(0), i - 1), lambda j: _pack(i * 32 + j, _without(_without(rest, i), j))
            ),
        )
    )
    exact_here = same.select(
        "fingerprint",
        (-1 - _pack(F.col("which"), _segment(p, F.col("which")))).alias("k1"),
        F.explode(two).alias("k2"),
    )
    residual = near_both.unionByName(exact_here)
    least = residual.groupBy("k1", "k2").agg(F.min("fingerprint").alias("dst"), F.count("*").alias("n")).where("n > 1")
    stars = (
        residual.join(least.hint("merge"), ["k1", "k2"])
        .where("fingerprint <> dst")
        .select(F.col("fingerprint").alias("src"), "dst")
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) per row; component_id is the smallest id reachable by links."""
    ensure_checkpoint_dir(docs.sparkSession)
    hashed = fingerprints(docs, id_col, text_col, width).checkpoint()
    nodes = hashed.groupBy("fingerprint").agg(F.min("node_id").alias("first_id"))
    named = named_by_first(nodes, components(links(nodes.select("fingerprint"))), "fingerprint")
    return spread_join(hashed, named, "fingerprint").select(F.col("node_id").alias(id_col), "fingerprint", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The documents with exactly one row left of each component: the smallest id, then the smallest text.

    Components are told by their fingerprints, so texts of several components may share an id or have none.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    text = column(text_col).cast("string")
    keyed = docs.select(F.struct(column(id_col).alias("node_id"), F.xxhash64(text).alias("text_key")).alias("row_id"), text.alias("text"))
    hashed = fingerprints(keyed, "row_id", "text", width).checkpoint()
    nodes = hashed.select("fingerprint").distinct()
    roots = components(links(nodes.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    rooted = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    found = spread_join(hashed, rooted, "fingerprint").select("node_id.*", "root")
    return first_rows(docs, found, id_col, text_col)
