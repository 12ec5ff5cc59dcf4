"""Order-preserving packing of documents into fixed windows by dynamic programming.

Each input partition is packed as one stream in its stored order.  Window cuts lie at document ends,
sentence ends, or (where neither comes for long) between words.  The plan minimises padding plus
penalties for cutting inside a document.  With f the cost up to a boundary and p its token position,

    f[j] = penalty[j] + min( min over p[j]-p[i] <= W of (f[i] + p[i]) + W - p[j],  min over p[j]-p[i] = 2^k of f[i] ) + c

where the first minimum slides over a monotone queue, so a boundary costs constant time, and the second
holds the window lengths that need no padding.  Only one window's tail is carried between blocks, so
memory is bounded by a block and the longest document.

Defined results: null and empty texts are one closing id; a document longer than a window becomes
several pieces; repeated rows are packed each; null ids are kept; an empty table gives no pieces; other
columns are ignored.  Sequence ids are unique: partition number * 2^33 + number in the partition.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from segmentflow.llm.columns import column
from tokenizers import Tokenizer

#: Tokens planned at a time, costs in padded tokens, and the distance of cuts where no sentence ends.
BLOCK_TOKENS = 1 << 19
WINDOW_COST, SENTENCE_COST, WORD_COST, WORD_STEP = 32.0, 0.5, 3.0, 16
SENTENCE_END = (".", "!", "?", "\n", "。", "！", "？")


class Ids:
    """Token ids of a tokenizer file, by the same ranks in the faster library where they agree."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as lines:
            model = json.load(lines)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.slow = Tokenizer.from_file(path)
        letters = _byte_letters()
        vocab = {
            bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in self.special
        }
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        in_order = all(model["model"]["vocab"]["".join(m)] == 256 + i for i, m in enumerate(merges))
        self.fast = (
            tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocab, special_tokens={}) if in_order else None
        )
        self.ends = np.zeros(max([*vocab.values(), *model["model"]["vocab"].values()]) + 2, dtype=bool)
        for word, i in vocab.items():
            self.ends[i] = word.decode("utf-8", "ignore").rstrip(" ").endswith(SENTENCE_END)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next letter from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def token_ids(path: str, pattern: str) -> Ids:
    return Ids(path, pattern)


def plan(at: np.ndarray, penalty: np.ndarray, width: int) -> list[int]:
    """Indices of the chosen boundaries.  at: rising positions from 0, no two neighbours over width apart."""
    n = len(at)
    index = np.full(int(at[-1]) + 1, -1, dtype=np.int64)
    index[at] = np.arange(n)
    exact: list[list[int]] = [[] for _ in range(n)]
    for k in range(width.bit_length()):
        if 1 << k > width:
            break
        have = np.flatnonzero(at >= 1 << k)
        start = index[at[have] - (1 << k)]
        for j, i in zip(have[start >= 0].tolist(), start[start >= 0].tolist()):
            exact[j].append(i)
    places, penalties = at.tolist(), penalty.tolist()
    cost, origin = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, n):
        p = places[j]
        while p - queue[0][1] > width:
            queue.popleft()
        best, start = queue[0][0] + width - p, queue[0][2]
        for i in exact[j]:
            if cost[i] < best:
                best, start = cost[i], i
        cost[j], origin[j] = best + penalties[j] + WINDOW_COST, start
        key = cost[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(origin[chosen[-1]])
    return chosen[::-1]


class Stream:
    """Documents of one partition, packed block by block."""

    def __init__(self, ids: Ids, end_id: int, width: int, first_sequence: int) -> None:
        self.ids, self.end_id, self.width, self.sequence = ids, end_id, width, first_sequence
        self.held: list[tuple[object, int, int, np.ndarray]] = []  # id, start in the document, its tokens, ids here
        self.size = 0

    def add(self, doc_id: object, text: str) -> None:
        ids = np.append(self.ids.encode(text), np.uint32(self.end_id))
        self.held.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Pieces of all windows but, unless last, the final one, which stays."""
        if not self.held:
            return
        flow = np.concatenate([h[3] for h in self.held])
        stops = np.cumsum([len(h[3]) for h in self.held])
        marks = np.full(len(flow) + 1, np.inf)
        marks[WORD_STEP::WORD_STEP] = WORD_COST
        marks[1:][self.ids.ends[flow]] = SENTENCE_COST
        marks[stops] = 0.0
        marks[0] = 0.0
        at = np.flatnonzero(marks < np.inf)
        chosen = at[plan(at, marks[at], self.width)]
        until = len(chosen) - 1 if last else len(chosen) - 2
        starts = stops - [len(h[3]) for h in self.held]
        for a, b in zip(chosen[:until].tolist(), chosen[1 : until + 1].tolist()):
            d = int(np.searchsorted(stops, a, side="right"))
            while d < len(stops) and starts[d] < b:
                doc_id, before, total, _ = self.held[d]
                x, y = max(a, int(starts[d])), min(b, int(stops[d]))
                yield doc_id, before + x - int(starts[d]), y - x, total, self.sequence, x - a, flow[x:y].astype("<u4").tobytes()
                d += 1
            self.sequence += 1
        rest = int(chosen[until]) if until > 0 else 0
        if last or rest >= len(flow):
            self.held, self.size = [], 0
            return
        d = int(np.searchsorted(stops, rest, side="right"))
        doc_id, before, total, ids = self.held[d]
        cut = rest - int(starts[d])
        self.held = [(doc_id, before + cut, total, ids[cut:]), *self.held[d + 1 :]]
        self.size = len(flow) - rest


def pack(
    docs: DataFrame,
    path: str,
    pattern: str,
    end_id: int = 0,
    width: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, sequence_id, offset, ids); ids are packed unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(token_ids(path, pattern), end_id, width, TaskContext.get().partitionId() << 33)
        kind: pa.DataType | None = None
        names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            columns = list(zip(*stream.pack(last)))
            if columns:
                types = [kind, *repeat(pa.int64(), 5), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream.add(doc_id, text or "")
                if stream.size >= BLOCK_TOKENS:
                    yield from emit(False)
        yield from emit(True)

    chosen = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    longs = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = T.StructType(
        [chosen.schema["id"], *(T.StructField(n, T.LongType()) for n in longs), T.StructField("ids", T.BinaryType())]
    )
    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)
