"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pre-tokens that a batch of texts newly brings form one linked list of byte positions.  Each merge
rank has a bucket of the positions whose pair has that rank; a three-level bitmap over the ranks finds
the next non-empty bucket by find-first-set.  All live positions of that bucket merge at once, from the
left; entries whose pair changed since they were queued are stale and skipped.  A pre-token of any length
takes time linear in its merges.  Words met before are looked up in a bounded table of the worker.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored; ids unknown to the vocabulary raise.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from segmentflow.llm.columns import column

NO_RANK = -1
#: Bytes of new pre-tokens that share a linked list, and words that a worker remembers.
LIST_BYTES, REMEMBERED = 1_000_000, 250_000
#: Code points of text handled before results are handed on.
SLICE_CHARS = 8_000_000


class RankQueue:
    """Buckets of positions by rank under a three-level bitmap."""

    def __init__(self, ranks: int) -> None:
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[np.ndarray]]:
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class Vocabulary:
    """Ranks of byte strings (id = rank), the pairs that make each, and the splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.strings = {i: s for s, i in ranks.items()}
        self.byte_ids = np.array([ranks.get(bytes([i]), NO_RANK) for i in range(256)], dtype=np.int32)
        made = sorted(
            (ranks[left] << 32 | ranks[right], rank)
            for s, rank in ranks.items()
            for k in range(1, len(s))
            if (left := s[:k]) in ranks and (right := s[k:]) in ranks
        )
        self.keys = np.array([k for k, _ in made] or [-1], dtype=np.int64)
        self.made = np.array([r for _, r in made] or [NO_RANK], dtype=np.int32)
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        #: Tokens that are part of a pair of an earlier rank than their own; all others merge bucket by bucket.
        self.early = np.zeros(self.size, dtype=bool)
        if made:
            self.early[left[self.made < left]] = True
            self.early[right[self.made < right]] = True
            self.early[self.byte_ids[self.byte_ids >= 0]] = False  # never the result of a merge
        self.words: dict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.encoded: list[bytes] = []

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], NO_RANK).astype(np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each non-empty piece."""
        out, at = [], 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (to == at or size + len(pieces[to]) <= LIST_BYTES):
                size += len(pieces[to])
                to += 1
            out += self._merge(pieces[at:to])
            at = to
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        whole = [self.ranks.get(p) for p in pieces]
        todo = [p for p, w in zip(pieces, whole) if w is None]
        done = iter(self._merge_list(todo) if todo else [])
        return [next(done) if w is None else w.to_bytes(4, "little") for w in whole]

    def _merge_list(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.array([len(p) for p in pieces])
        stops = np.cumsum(lengths)
        n = int(stops[-1])
        token = np.append(self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)], NO_RANK)
        after = np.arange(1, n + 2, dtype=np.int32)  # n stands for no neighbour
        before = np.arange(-1, n, dtype=np.int32)
        after[stops - 1], before[stops - lengths], after[n], before[n] = n, n, n, n
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        rank = np.full(n + 1, NO_RANK, dtype=np.int32)
        inner = np.flatnonzero(after[:n] != n)
        rank[inner] = self.rank_of(token[inner], token[after[inner]])
        alive = np.ones(n, dtype=bool)
        queue = RankQueue(self.size)

        def enqueue(positions: np.ndarray) -> None:
            ranks = rank[positions]
            order = np.argsort(ranks, kind="stable")
            order = order[np.searchsorted(ranks[order], 0) :]
            if not len(order):
                return
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, group in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
                queue.push(r, group)

        def merge(at: np.ndarray, now: int) -> np.ndarray:
            """Merge disjoint pairs; the positions whose pairs changed."""
            gone = after[at]
            beyond = after[gone]
            token[at], after[at], before[beyond] = now, beyond, at
            rank[gone], alive[gone] = NO_RANK, False
            left = before[at]
            changed = np.concatenate((at, left[left != n]))
            right = after[changed]
            rank[changed] = np.where(right == n, NO_RANK, self.rank_of(token[changed], token[right]))
            return changed

        def waits(at: np.ndarray, now: int) -> np.ndarray:
            """Positions of pieces that hold several of these pairs and may come to hold an earlier one."""
            own = piece[at]
            several = np.zeros(len(at), dtype=bool)
            same = own[1:] == own[:-1]
            several[1:] |= same
            several[:-1] |= same
            if not several.any():
                return several
            result = np.full(len(at), now)
            risky = np.zeros(len(at), dtype=bool)
            for made in (
                self.rank_of(token[before[at]], result),
                self.rank_of(result, token[after[after[at]]]),
                self.rank_of(result[:1], result[:1]),
            ):
                risky |= (made >= 0) & (made < now)
            return several & np.isin(own, own[risky])

        def merge_singly(at: np.ndarray, now: int) -> None:
            """For results that may form a pair of an earlier rank: their piece then waits for that pair."""
            waiting: set[int] = set()
            later = []
            for p in at.tolist():
                if rank[p] != now:
                    continue
                if int(piece[p]) in waiting:
                    later.append(p)
                    continue
                changed = merge(np.array([p]), now)
                fresh = rank[changed]
                if np.any((fresh >= 0) & (fresh < now)):
                    waiting.add(int(piece[p]))
                enqueue(changed)
            if later:
                queue.push(now, np.array(later))

        enqueue(inner)
        while queue.top:
            now, chunks = queue.pop()
            at = chunks[0] if len(chunks) == 1 else np.concatenate(chunks)
            at = at[rank[at] == now]  # the others are stale
            if len(at) > 1:
                at = np.unique(at)
                if self.early[now]:
                    single = waits(at, now)
                    merge_singly(at[single], now)
                    at = at[~single]
                if np.any(after[at[:-1]] == at[1:]):
                    taken, last = [], -1
                    for p, q in zip(at.tolist(), after[at].tolist()):
                        if p != last:
                            taken.append(p)
                            last = q
                    at = np.array(taken)
            if len(at):
                enqueue(merge(at, now))
        ids = token[:n][alive].astype("<u4").tobytes()
        counts = np.add.reduceat(alive, stops - lengths, dtype=np.int64)
        ends = (4 * np.cumsum(counts)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        known = len(self.encoded)
        code = self.words.__getitem__
        coded = [np.fromiter(map(code, self.pattern.findall(t)), dtype=np.int32) for t in texts]
        new = list(self.words)[known:] if len(self.words) > known else []
        self.encoded += self.encode_pieces([w.encode() for w in new])
        out = [b"".join(map(self.encoded.__getitem__, c.tolist())) for c in coded]
        if len(self.encoded) > REMEMBERED:
            self.words.clear()
            self.encoded.clear()
        return out

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Vocabulary(ranks, pattern)


def _slices(values: list, cost) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, v in enumerate(values):
        if size and size + cost(v) > SLICE_CHARS:
            yield at, i
            at, size = i, 0
        size += cost(v)
    if at < len(values):
        yield at, len(values)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) per row; ids are packed little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(texts, len):
                packed = pa.array(vocab.encode(texts[a:b]), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], packed], ["id", "ids"])

    chosen = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    schema = T.StructType([chosen.schema["id"], T.StructField("ids", T.BinaryType())])
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded) per row of packed ids; decoded are the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            packed = [p or b"" for p in batch.column(1).to_pylist()]
            for a, b in _slices(packed, len):
                decoded = pa.array([vocab.decode(p) for p in packed[a:b]], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch[a:b].columns, decoded], ["id", "ids", "decoded"])

    chosen = encoded.select(column(id_col).alias("id"), "ids")
    schema = T.StructType([*chosen.schema, T.StructField("decoded", T.BinaryType())])
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)
