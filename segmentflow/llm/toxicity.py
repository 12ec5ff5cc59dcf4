"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; other text is unlabelled, toxic or not.  With class prior
pi the risk of a classifier is  pi R(P, +) + max(0, R(U, -) - pi R(P, -)),  so unlabelled toxic texts
do not count as clean ones.  Features are hashed words, word beginnings and, in
words beyond ASCII, runs of code points present in a text; a test of
their rates in P against U keeps the telling ones, and a logistic model is fitted on those in NumPy.

Training takes a bounded sample (``MOST_POSITIVE`` and ``MOST_UNLABELLED`` rows, chosen by a hash of the
id); every text is scored whole on the executors, in one scan and no shuffle.

Defined results: null and empty texts get the score of a text without features; with no confirmed toxic
example every score is the prior; a document labelled both ways counts as toxic; repeated rows get equal
scores; a null id is never trained on; an empty table gives no rows; all other columns pass through, and
one that has the name of the result gives way to it (callers choose that name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentflow.llm.columns import column

SLOTS_BITS = 20
MOST_POSITIVE, MOST_UNLABELLED = 3000, 9000
#: The prior where no row is labelled as clean, and the bounds that a measured one is held to.
USUAL_PRIOR, PRIOR_BOUNDS = 0.1, (0.001, 0.9)
#: A feature needs this many positives, this share of toxic texts (prior times rate in P over rate in U)
#: and this many standard deviations above chance.
LEAST_COUNT, LEAST_PRECISION, LEAST_Z = 3, 0.6, 4.0
#: Lengths in code points of the word beginnings that are hashed, beside whole words.
CUTS = (4, 6)
#: Lengths of the runs of code points that are hashed inside words with any code point above ASCII, as
#: many scripts have no spaces.
GRAMS = (2, 3, 4)
CHUNK = 1 << 20
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(129)])


def _chunks(text: str) -> Iterator[str]:
    """Parts of a text that end at spaces, of about CHUNK code points."""
    at = 0
    while len(text) - at > CHUNK:
        to = text.find(" ", at + CHUNK)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


@lru_cache(maxsize=32)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, dtype=np.uint64))


def _slots(hashed: np.ndarray) -> np.ndarray:
    return np.unique((hashed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOTS_BITS)).astype(np.uint32)


def _word_hashes(data: np.ndarray, letter: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the words up to their real ends, and of the runs inside words beyond ASCII."""
    own = data[letter].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(own)) - np.repeat(first, lengths)
    yield np.add.reduceat(own * _powers(1 << int(lengths.max()).bit_length())[place], first)
    beyond = np.logical_or.reduceat(own > 128, first)
    if not beyond.any():
        return
    inside = np.zeros(len(data), dtype=bool)
    inside[letter] = np.repeat(beyond, lengths)
    whole, hashed = inside, data.astype(np.uint64)
    for n in range(2, GRAMS[-1] + 1):
        whole = whole[:-1] & inside[n - 1 :]
        hashed = hashed[:-1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n in GRAMS:
            yield (hashed[whole] ^ np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str) -> np.ndarray:
    """The distinct hashed features of a whole text, rising; every code point of a word is part of one."""
    found = []
    for part in _chunks(text):
        data = np.frombuffer(f" {part.lower()}{' ' * CUTS[-1]}".encode("utf-32-le", "replace"), dtype="<u4")
        letter = _LETTER[np.minimum(data, 128)]
        at = np.flatnonzero(~letter[:-1] & letter[1:]) + 1
        if not len(at):
            continue
        hashed, live = np.zeros(len(at), dtype=np.uint32), np.ones(len(at), dtype=bool)
        for j in range(CUTS[-1]):
            live &= letter[at + j]
            hashed = np.where(live, (hashed ^ data[at + j]) * np.uint32(16777619) + np.uint32(0x9E3779B9), hashed)
            if j + 1 in CUTS:
                salted = (hashed ^ np.uint32(j * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(2654435761)
                found.append(np.unique(salted >> np.uint32(32 - SLOTS_BITS)))
        lengths = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1 - at
        found.extend(map(_slots, _word_hashes(data, letter, at, lengths)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint32)


@dataclass
class Model:
    slots: np.ndarray  # rising
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        own = features(text)
        at = np.searchsorted(self.slots, own)
        at[at == len(self.slots)] = 0
        hit = self.slots[at] == own if len(self.slots) else np.zeros(len(own), dtype=bool)
        z = self.bias + float(self.weights[at[hit]].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))))


def fit_nnpu(
    row: np.ndarray, column: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, width: int, prior: float, steps: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk with logistic loss; (row, column) are the present features."""
    n = len(positive)
    w, b = np.zeros(width), np.log(prior / (1 - prior))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    p_share, u_share = positive / max(positive.sum(), 1), unlabelled / max(unlabelled.sum(), 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[column], minlength=n)
        chance = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        as_negative = np.logaddexp(0, z)
        below = u_share @ as_negative - prior * (p_share @ as_negative)
        if below >= 0:
            slope = prior * p_share * (chance - 1) + (u_share - prior * p_share) * chance
            on_bias = slope.sum()
        else:  # the clean part went below zero: the weights step back; the bias, shared by all texts, stays
            slope = -(u_share - prior * p_share) * chance
            on_bias = 0.0
        grad = np.append(np.bincount(column, weights=slope[row], minlength=width) + 1e-4 * w, on_bias)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    # The mean chance over unlabelled texts is the prior; a bias that left it too low is raised to it.
    z = b + np.bincount(row, weights=w[column], minlength=n)
    low, high = 0.0, 20.0
    for _ in range(50):
        raised = (low + high) / 2
        mean = u_share @ (1.0 / (1.0 + np.exp(-np.clip(z + raised, -30, 30))))
        low, high = (raised, high) if mean < prior else (low, raised)
    return w, float(b + low)


def _share(id_col: str, salt: str) -> Column:
    return F.pmod(F.xxhash64(column(id_col).cast("string"), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labels of the trainable ids and from trainable texts; trainable is over id_col."""
    known = (
        labels.where(trainable & column(label_col).isNotNull() & column(id_col).isNotNull())
        .groupBy(column(id_col))
        .agg(F.max(column(label_col).cast("int")).alias("toxic"))
    )
    n_positive, n_known = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    prior = n_positive / n_known if n_positive < n_known else USUAL_PRIOR
    prior = float(np.clip(prior, *PRIOR_BOUNDS))
    untaught = Model(np.zeros(0, dtype=np.uint32), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not n_positive:
        return untaught
    total = docs.count()
    chosen = known.where((F.col("toxic") == 1) & (_share(id_col, "positive") < min(1.0, MOST_POSITIVE / n_positive)))
    # At most about MOST_POSITIVE ids of eight bytes, whatever the size of the tables.
    confirmed = F.broadcast(chosen.select(column(id_col).alias("confirmed_id")))
    texts = docs.where(trainable & column(id_col).isNotNull()).select(
        column(id_col).alias("doc_key"),
        column(text_col).cast("string").alias("text"),
        (_share(id_col, "unlabelled") < min(1.0, MOST_UNLABELLED / max(total, 1))).alias("unlabelled"),
    )
    sample = (
        texts.join(confirmed, F.col("doc_key") == F.col("confirmed_id"), "left")
        .where(F.col("unlabelled") | F.col("confirmed_id").isNotNull())
        .select(F.col("confirmed_id").isNotNull().alias("positive"), "unlabelled", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t or "").astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.list_(pa.int32()))], ["positive", "unlabelled", "slots"])

    got = sample.mapInArrow(run, "positive boolean, unlabelled boolean, slots array<int>").toArrow()
    positive = np.array(got.column("positive").to_pylist(), dtype=bool)
    unlabelled = np.array(got.column("unlabelled").to_pylist(), dtype=bool)
    if not positive.any() or not unlabelled.any():
        return untaught

    def present() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers and slots, one chunk of rows at a time."""
        before = 0
        for chunk in got.column("slots").chunks:
            lengths = pc.list_value_length(chunk).to_numpy(zero_copy_only=False)
            yield np.repeat(np.arange(before, before + len(chunk)), lengths), chunk.flatten().to_numpy(zero_copy_only=False)
            before += len(chunk)

    def counts(which: np.ndarray) -> np.ndarray:
        total = np.zeros(1 << SLOTS_BITS)
        for row, slot in present():
            total += np.bincount(slot[which[row]], minlength=1 << SLOTS_BITS)
        return total

    in_p, in_u = counts(positive), counts(unlabelled)
    rate_u = (in_u + 0.5) / (unlabelled.sum() + 1.0)
    expected = positive.sum() * rate_u
    rate_p = in_p / positive.sum()
    telling = in_p >= LEAST_COUNT
    telling &= (prior * rate_p >= LEAST_PRECISION * rate_u) & (in_p - expected >= LEAST_Z * np.sqrt(expected))
    slots = np.flatnonzero(telling).astype(np.uint32)
    if not len(slots):
        return untaught
    place = np.full(1 << SLOTS_BITS, -1)
    place[slots] = np.arange(len(slots))
    kept = [(row[place[slot] >= 0], place[slot[place[slot] >= 0]]) for row, slot in present()]
    row, column_ = (np.concatenate(parts) for parts in zip(*kept))
    weights, bias = fit_nnpu(row, column_, positive.astype(float), unlabelled.astype(float), len(slots), prior)
    return Model(slots, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "toxic_score") -> DataFrame:
    """The rows with their score under the given name; all other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], out.names)

    kept = [c for c in docs.columns if c.lower() != name.lower()]
    inner = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)], column(text_col).cast("string").alias("text"))
    out = T.StructType([*(inner.schema[f"c{i}"] for i in range(len(kept))), T.StructField("score", T.DoubleType())])
    done = inner.mapInArrow(run, out)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("score").alias(name))
