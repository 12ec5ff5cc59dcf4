"""Benchmark decontamination: a broadcast set of test n-grams, scanned over the word windows of every text.

Words are runs of digits, letters and everything beyond ASCII, with A-Z lower-cased.  A window is ``width``
consecutive words of an item; an item of fewer words is one window.  Rolling hashes of all windows of a text
are looked up in a bitmap; those that pass are compared as text, so every hit is exact.

Up to ``BROADCAST_WINDOWS`` windows and ``BROADCAST_BYTES`` of their text, tasks hold the whole set.  A larger
set stays a table: tasks hold its bitmap only (``MOST_BITS`` at most, whatever the set's size) and what passes
meets the table in a join by the window's text, with equal results.

Defined results: null and empty texts have no words and no hits; repeated rows are judged alike; rows of one
item id are one item, and a null id is an item with an empty name; texts of any length are read whole; an empty
benchmark hits nothing; other columns, also ones with names used inside, are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentflow.llm.columns import column, fresh
from segmentflow.llm.graph import spread_join
from segmentflow.llm.tokens import ALPHANUMERIC, Words, chunks, words
from segmentflow.session import ensure_checkpoint_dir

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 64_000_000
LEAST_BITS, MOST_BITS = 20, 27
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """(item, size, window): the distinct windows of every item, words joined by one space."""
    own = F.regexp_extract_all(F.translate(column(text_col).cast("string"), UPPER, UPPER.lower()), F.lit(WORD), 0)
    size = F.size("own")
    starts = F.when(size > width, F.sequence(F.lit(1), size - width + 1)).when(size > 0, F.array(F.lit(1)))
    return (
        benchmark.select(F.coalesce(column(id_col).cast("string"), F.lit("")).alias("item"), own.alias("own"))
        .select("item", F.least(size, F.lit(width)).alias("size"), "own", F.explode(starts).alias("at"))
        .select("item", "size", F.array_join(F.slice("own", F.col("at"), F.col("size")), " ").alias("window"))
        .distinct()
    )


@lru_cache(maxsize=2)
def _powers(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(
        np.cumprod(np.concatenate([[np.uint64(1)], np.full(least - 1, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse)
    )


class Stream:
    """Words joined by one space, and the hashes of any runs of them."""

    def __init__(self, found: Words):
        sizes = found.end - found.start
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        total = int(self.end[-1]) + 1 if len(sizes) else 0
        self.data = np.full(total, 32, dtype=np.uint8)
        letter = np.ones(total, dtype=bool)
        letter[self.end] = False
        edge = np.zeros(len(found.data) + 1, dtype=np.int8)
        edge[found.start] += 1
        edge[found.end] -= 1  # each of both holds a place once
        self.data[letter] = found.data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
        power, self.inverse = _powers(1 << max(23, total.bit_length()))
        self.sums = np.zeros(total + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:total], out=self.sums[1:])

    def hashes(self, size: int) -> np.ndarray:
        """The mixed hash of each run of so many words, also of runs over two rows."""
        start, end = self.start[: len(self.start) - size + 1], self.end[size - 1 :]
        return (self.sums[end] - self.sums[start]) * self.inverse[start] * _MIX

    def text(self, at: int, size: int) -> bytes:
        return self.data[self.start[at] : self.end[at + size - 1]].tobytes()


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def window_bits(texts: pa.Array, bits: int) -> np.ndarray:
    """The bit of each window, given as joined words."""
    out = []
    for _, data, offsets in chunks(texts):
        stream_end = offsets[1:]
        power, inverse = _powers(1 << max(23, len(data).bit_length()))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        out.append(_bit((sums[stream_end] - sums[offsets[:-1]]) * inverse[offsets[:-1]] * _MIX, bits))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """One byte per eight hash values, set where a window has one of them; made on Spark, 2^bits bits in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(window_bits(batch.column(0), bits))], ["bit"])

    found = windows.select("window").mapInArrow(run, "bit long")
    slots = found.groupBy(F.floor(F.col("bit") / 63).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 63 as int))")).alias("mask")
    )
    rows = slots.toArrow()
    flags = np.zeros((1 << bits) // 63 * 63 + 63, dtype=bool)
    slot, mask = (rows.column(i).to_numpy() for i in (0, 1))
    for k in range(63):
        flags[slot[(mask >> k) & 1 == 1] * 63 + k] = True
    return np.packbits(flags[: 1 << bits], bitorder="little")


def _passing(stream: Stream, row: np.ndarray, size: int, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """First words of the runs within one row that the bitmap lets pass."""
    if len(row) < size:
        return np.zeros(0, dtype=np.int64)
    bit = _bit(stream.hashes(size), bits)
    seen = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
    at = np.flatnonzero(seen)
    return at[row[at] == row[at + size - 1]]


SPANS = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def _merged(at: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words lies in a run."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _held(batch_text: pa.Array, items: list, held: dict[bytes, int], sizes: list[int], bitmap: np.ndarray, bits: int) -> Iterator[tuple]:
    """Per text (words, hit words, items, spans in bytes) where the whole set is at hand."""
    for _, data, offsets in chunks(batch_text):
        found, n_rows = words(data, offsets, ALPHANUMERIC), len(offsets) - 1
        n_words = np.bincount(found.row, minlength=n_rows)
        stream = Stream(found) if len(found.row) else None
        hits: list[tuple[int, int, int]] = []
        for size in sizes if stream else ():
            for at in _passing(stream, found.row, size, bitmap, bits).tolist():
                if (window := held.get(stream.text(at, size))) is not None:
                    hits.append((at, size, window))
        by_row: dict[int, set] = {}
        for at, _, window in hits:
            by_row.setdefault(int(found.row[at]), set()).update(items[window])
        hit = _merged(*(np.array([h[i] for h in hits], dtype=np.int64) for i in (0, 1)), len(found.row))
        n_hit = np.bincount(found.row[hit], minlength=n_rows)
        first_word = np.concatenate([[0], np.cumsum(n_words)])
        for i in range(n_rows):
            spans = _spans(hit[first_word[i] : first_word[i + 1]], found, first_word[i], offsets[i]) if n_hit[i] else []
            yield int(n_words[i]), int(n_hit[i]), sorted(by_row.get(i, ())), spans


def _spans(hit: np.ndarray, found: Words, first: int, base: int) -> list[dict]:
    """Byte ranges of the runs of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return [
        {"start": int(found.start[first + a] - base), "end": int(found.end[first + b - 1] - base)}
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))
    ]


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows as one struct, so that no name clashes, with their text."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("doc"), column(text_col).cast("string").alias("own_text"))


def _scanned_at_hand(rows: DataFrame, windows: DataFrame, bits: int) -> DataFrame:
    """rows with SPANS, by the whole set of windows in every task."""
    own = windows.groupBy("window", "size").agg(F.collect_list("item").alias("items")).toArrow()
    texts = own.column("window").combine_chunks()
    items, sizes = own.column("items").to_pylist(), sorted(set(own.column("size").to_pylist()))
    held = {w.encode(): i for i, w in enumerate(texts.to_pylist())}
    flags = np.zeros(1 << bits, dtype=bool)
    flags[window_bits(texts, bits)] = True
    shared = rows.sparkSession.sparkContext.broadcast((items, held, sizes, np.packbits(flags, bitorder="little")))
    out = T.StructType([*rows.schema.fields, *T._parse_datatype_string(SPANS).fields])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [*zip(*_held(batch.column(1), *shared.value, bits))] or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, told, kinds)], out.names)

    return rows.mapInArrow(run, out)


def _scanned_by_join(rows: DataFrame, windows: DataFrame, sizes: list[int], bits: int) -> DataFrame:
    """rows with SPANS, by a join of the windows that pass the bitmap with the table of windows."""
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(windows, bits))
    out = T.StructType(
        [*rows.schema.fields, *T._parse_datatype_string("row_key long, n_words long, bounds array<struct<start:long,end:long>>, passed array<struct<at:long,size:long,window:string>>").fields[1:]]
    )
    bound, passed = pa.struct([("start", pa.int64()), ("end", pa.int64())]), pa.struct([("at", pa.int64()), ("size", pa.int64()), ("window", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bounds, seen = [], [], []
            for _, data, offsets in chunks(batch.column(1)):
                found = words(data, offsets, ALPHANUMERIC)
                n_words = np.bincount(found.row, minlength=len(offsets) - 1)
                first = np.concatenate([[0], np.cumsum(n_words)])
                own: list[list] = [[] for _ in n_words]
                stream = Stream(found) if len(found.row) else None
                for size in sizes if stream else ():
                    for at in _passing(stream, found.row, size, shared.value, bits).tolist():
                        row = int(found.row[at])
                        own[row].append({"at": at - int(first[row]), "size": size, "window": stream.text(at, size).decode("utf-8", "replace")})
                counts += n_words.tolist()
                seen += own
                for i, x in enumerate(own):  # word bounds only where something may be cut
                    span = slice(first[i], first[i + 1]) if x else slice(0, 0)
                    bounds.append([{"start": a, "end": b} for a, b in zip((found.start[span] - offsets[i]).tolist(), (found.end[span] - offsets[i]).tolist())])
            columns = [pa.array(counts, pa.int64()), pa.array(bounds, pa.list_(bound)), pa.array(seen, pa.list_(passed))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], out.names)

    scanned = rows.mapInArrow(run, out).withColumn("row_key", F.monotonically_increasing_id()).checkpoint()
    named = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    seen = scanned.select("row_key", F.explode("passed").alias("p")).select("row_key", "p.*")
    hits = spread_join(seen, named, "window")
    in_runs = F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("size") - 1)))
    by_row = hits.groupBy("row_key").agg(
        F.array_sort(F.array_distinct(in_runs)).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("found_items")
    )
    hit = F.coalesce("hit", F.array().cast("array<long>"))
    # Hit words in order; a run ends where the next word is not hit.
    starts = F.filter("hit", lambda x, i: (i == 0) | (F.get("hit", i - 1) != x - 1))
    ends = F.filter("hit", lambda x, i: (i == F.size("hit") - 1) | (F.get("hit", i + 1) != x + 1))
    at = lambda i, end: F.get("bounds", i.cast("int"))[end]
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(at(a, "start").alias("start"), at(b, "end").alias("end")))
    return scanned.join(by_row, "row_key", "left").withColumn("hit", hit).select(
        "doc", "own_text", "n_words", F.size("hit").cast("long").alias("n_hit"),
        F.coalesce("found_items", F.array().cast("array<string>")).alias("items"),
        spans.cast("array<struct<start:long,end:long>>").alias("spans"),
    )


def _scan(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, width: int) -> DataFrame:
    ensure_checkpoint_dir(docs.sparkSession)
    windows = item_windows(benchmark, item_col, item_text, width).checkpoint()
    facts = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + F.octet_length("item")).alias("bytes"), F.collect_set("size").alias("sizes")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * facts.n).bit_length()))
    rows = _rows(docs, text_col)
    if facts.n <= BROADCAST_WINDOWS and (facts.bytes or 0) <= BROADCAST_BYTES:
        return _scanned_at_hand(rows, windows, bits)
    return _scanned_by_join(rows, windows, sorted(facts.sizes), bits)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10
) -> DataFrame:
    """(id, n_words, n_hit, items, spans) per row; items rise as strings, spans are ranges of the text's UTF-8 bytes."""
    found = _scan(docs, benchmark, text_col, item_col, item_text, width)
    return found.select(F.col("doc")[id_col].alias(id_col), "n_words", "n_hit", "items", "spans")


def without_hits(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 10
) -> DataFrame:
    """docs without the documents that hold a window, or (remove="spans") with the hit runs of words cut out of their texts."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found = _scan(docs, benchmark, text_col, item_col, item_text, width)
    if remove == "documents":
        return found.where("n_hit = 0").select("doc.*")

    def cut(text: Column, spans: Column) -> Column:
        raw = F.encode(text, "UTF-8")
        edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["end"]))), F.array(F.octet_length(raw).cast("long")))
        kept = F.transform(
            F.sequence(F.lit(0), F.size(spans)),
            lambda i: F.decode(F.substring(raw, (F.get(edges, i * 2) + 1).cast("int"), (F.get(edges, i * 2 + 1) - F.get(edges, i * 2)).cast("int")), "UTF-8"),
        )
        return F.array_join(kept, "")

    cleaned = fresh("cleaned", docs.columns)
    text = F.when(F.col("n_hit") > 0, cut(F.col("own_text"), F.col("spans"))).otherwise(F.col("own_text"))
    out = found.select("doc.*", text.alias(cleaned))
    return out.select(*[column(cleaned).alias(c) if c == text_col else column(c) for c in docs.columns])
