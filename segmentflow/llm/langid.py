"""Language identification by hierarchical discrimination.

A text becomes a unit vector of hashed byte bigrams and trigrams.  One-versus-rest linear support vector
machines choose the language family; one-versus-one machines then separate the languages within it.
The machines are fitted in NumPy on a bounded sample of labelled rows (``SAMPLE_ROWS`` in all, spread
over the ``MOST_LANGUAGES`` languages with most rows, chosen by a hash of the id); every row is scored
whole on the executors.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0; so is every
text if no row has a language to learn from.  A language alone in its family needs no second step.
Repeated rows get equal results; a null id is never trained on; an empty table gives no rows; all other
columns pass through, and one that has the name of a result gives way to it (callers choose those names).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentflow.llm.columns import column

# Language families by code; any other code belongs to the family "other".
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa si ur",
    "sinitic": "zh yue",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UND = "und"
SLOTS_BITS = 12
SLOTS = 1 << SLOTS_BITS
#: Rows to learn from in all, and of one language; with many languages, each still gets the least number.
SAMPLE_ROWS, MOST_PER_LANGUAGE, LEAST_PER_LANGUAGE = 2400, 600, 6
#: Languages that are learned, those with most rows first.  Texts of any further one get the nearest learned language.
MOST_LANGUAGES = 1000
CHUNK = 1 << 20
#: A text is foreign if it fits its language worse than all but this share of the training rows, by this factor.
FOREIGN_SHARE, FOREIGN_SLACK = 0.001, 1.25
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of bigram and trigram counts over the whole text."""
    data = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    counts = np.zeros(SLOTS)
    for a in range(0, len(data), CHUNK):
        b = data[a : a + CHUNK + 2]
        if len(b) < 3:
            break
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(263) + b[2:] + np.uint32(1 << 25)
        for grams in (two[: len(three)], three):
            counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - SLOTS_BITS), minlength=SLOTS)
    vector = np.sqrt(counts)
    return (vector / max(np.linalg.norm(vector), 1e-12)).astype(np.float32)


def fit_svm(x: np.ndarray, positive: np.ndarray, steps: int = 120, c: float = 20.0) -> np.ndarray:
    """Squared-hinge linear machine (weights, then bias) by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    rate = 1.0 / (1.0 / c + 4.0)
    for t in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (x @ ahead))
        grad = ahead / c - 2.0 * (x.T @ (weight * y * slack))
        new = ahead - rate * grad
        ahead = new + (t / (t + 3.0)) * (new - w)
        w = new
    return w


class Model:
    """Family machines, pair machines and the languages they name."""

    def __init__(self, langs: list[str], x: np.ndarray, labels: np.ndarray) -> None:
        self.langs = langs
        of = [FAMILY_OF.get(lang, "other") for lang in langs]
        self.families = sorted(set(of))
        self.members = [[i for i, f in enumerate(of) if f == family] for family in self.families]
        family_of_row = np.array([self.families.index(f) for f in of])[labels]
        rows = [fit_svm(x, family_of_row == k) for k in range(len(self.families))] if len(self.families) > 1 else []
        self.family_weights = np.array(rows, dtype=np.float32).reshape(-1, SLOTS + 1)
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        rows = [fit_svm(x[(labels == i) | (labels == j)], labels[(labels == i) | (labels == j)] == i) for i, j in self.pairs]
        self.pair_weights = np.array(rows, dtype=np.float32).reshape(-1, SLOTS + 1)

        # Squared entries of a vector are the frequencies of its grams, so fits are linear in them.
        profiles = np.array([(x[labels == i] ** 2).mean(axis=0) for i in range(len(langs))], dtype=np.float64)
        self.log_profiles = np.log((profiles + 1e-3 / SLOTS) / (1 + 1e-3))
        self.usual = (profiles * self.log_profiles).sum(axis=1)
        self.spread = np.sqrt(np.maximum((profiles * self.log_profiles**2).sum(axis=1) - self.usual**2, 1e-6))
        blocks = [self.strangeness(x[a : a + 256], labels[a : a + 256]) for a in range(0, len(x), 256)]
        self.bound = FOREIGN_SLACK * max(float(np.quantile(np.concatenate(blocks), 1 - FOREIGN_SHARE)), 1.0)

    def strangeness(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """How far the mean log-likelihood of the grams lies below the usual one, for the length of the text."""
        share = np.square(x, dtype=np.float64)
        fit = np.einsum("ij,ij->i", share, self.log_profiles[labels])
        least = np.where(share > 0, share, np.inf).min(axis=1)  # about one over the number of grams
        return (self.usual[labels] - fit) / (0.1 + self.spread[labels] * np.sqrt(np.minimum(least, 1.0)))

    def foreign(self, x: np.ndarray, langs: list[str]) -> np.ndarray:
        """Whether each text fits its language worse than the training rows do."""
        return self.strangeness(x, np.array([self.langs.index(lang) for lang in langs])) > self.bound

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        chance = np.ones((n, len(self.families)))
        if len(self.families) > 1:
            margins = 4.0 * (x @ self.family_weights[:, :-1].T + self.family_weights[:, -1])
            chance = np.exp(margins - margins.max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
        family = chance.argmax(axis=1)
        margins = x @ self.pair_weights[:, :-1].T + self.pair_weights[:, -1]
        wins = 1.0 / (1.0 + np.exp(-4.0 * margins))
        support = np.zeros((n, len(self.langs)))
        rivals = np.zeros(len(self.langs))
        for k, (i, j) in enumerate(self.pairs):
            support[:, i] += wins[:, k]
            support[:, j] += 1.0 - wins[:, k]
            rivals[[i, j]] += 1
        support = np.where(rivals > 0, support / np.maximum(rivals, 1), 1.0)
        inside = np.zeros((len(self.families), len(self.langs)), dtype=bool)
        for k, m in enumerate(self.members):
            inside[k, m] = True
        support = np.where(inside[family], support, -1.0)
        best = support.argmax(axis=1)
        score = chance[np.arange(n), family] * support[np.arange(n), best]
        return [self.langs[i] for i in best], np.clip(score, 0.0, 1.0)


def _hash_share(id_col: str) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(column(id_col).cast("string"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fit(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the languages of the trainable rows; None if there are none."""
    rows = docs.where(trainable & column(lang_col).isNotNull() & (column(lang_col) != UND) & column(id_col).isNotNull())
    counted = rows.groupBy(column(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in counted.collect()}
    if not counts:
        return None
    each = max(LEAST_PER_LANGUAGE, min(MOST_PER_LANGUAGE, SAMPLE_ROWS // len(counts)))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    sample = rows.where(_hash_share(id_col) < share[column(lang_col)]).select(
        column(lang_col).alias("lang"), column(text_col).cast("string").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(g, t) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and has_letter(t)]
            vectors = pa.array([features(t) for _, t in kept], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in kept], pa.string()), vectors], ["lang", "vector"])

    got = sample.mapInArrow(run, "lang string, vector array<float>").toArrow()
    if not got.num_rows:
        return None
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in got.column("vector").chunks]).reshape(-1, SLOTS)
    return Model(langs, x, np.array([langs.index(n) for n in names]))


def predict(
    docs: DataFrame,
    model: Model | None,
    text_col: str = "text",
    only_learned: bool = False,
    names: tuple[str, str] = ("lang_pred", "lang_score"),
) -> DataFrame:
    """The rows with their language and its score under the given names; all other columns pass through.

    With only_learned, lettered noise and texts in languages that were not learned are ``und`` too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                ready = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                langs, scores = [UND] * len(texts), np.zeros(len(texts))
                if ready:
                    x = np.array([features(texts[i]) for i in ready])
                    found, sure = model.predict(x)
                    if only_learned:
                        foreign = model.foreign(x, found)
                        found, sure = [UND if f else g for f, g in zip(foreign, found)], np.where(foreign, 0.0, sure)
                    scores[ready] = sure
                    for i, lang in zip(ready, found):
                        langs[i] = lang
                columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*out.names])

    kept = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    inner = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(kept)], column(text_col).cast("string").alias("text"))
    fields = [inner.schema[f"c{i}"] for i in range(len(kept))]
    out = T.StructType([*fields, T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    done = inner.mapInArrow(run, out)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("lang").alias(names[0]), F.col("score").alias(names[1]))
