"""Approximate nearest neighbours by inner product: stable projections, kd-trees, a chi-square stop.

Inner products become distances by one added coordinate: with M the largest norm, |(x, sqrt(M^2-|x|^2)) -
(Mq/|q|, 0)|^2 = 2 M^2 - 2 M x.q/|q|.  Every vector is projected by ``PROJECTIONS`` Gaussian (2-stable)
projections made orthogonal, so a projected squared distance is the true one times a variable with no heavier
upper tail than chi-square.  The added coordinate is in every query's distances; its line has the mean length,
as a long draw would push all neighbours of all queries over the stop together.  The top of the
kd-tree, fitted on a bounded sample of projected rows, deals all rows to shards; each shard completes its
own tree.  A query first searches its home shard; its k-th distance then bounds the other shards: one
whose box fails the test is skipped.  In a shard, the tree yields points in the order of their projected
distance, and they are verified in that order until the test stops: once the next projected squared
distance exceeds the ``CONFIDENCE`` quantile of chi-square times the k-th true squared distance.  The bound on
what is left out holds over draws of the lines; a run has one draw, so the stop is raised to the ``CALIBRATED``
quantile of projected over true squared distances measured on the neighbours within a sample of rows.

Queries and shards meet in bounded blocks: crowded shards are cut by a hash of the row, and the queries
that reach a shard by blocks of ``QUERY_BLOCK``; rows are copied to the blocks of their own shard only.
Every row is indexed and may be found.

Defined results: null, empty and zero vectors and those with null or non-finite components take no part,
as query or candidate; vectors meet those of their own length only; very large and very small components
are ranked as if scaled by a power of two, while the score is the plain product, which may overflow or
vanish; ties go to the smaller id, and equal vectors tie wherever they are stored; repeated rows are
candidates each, and a query skips every row with its own id; each query row has a list of its own, told
apart by ``query_hash`` (a hash of its vector) and ``query_copy`` (from 1, for equal rows); null ids take
no part; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentflow.llm.vectors import exponents, matrix, packed
from segmentflow.session import ensure_checkpoint_dir

PROJECTIONS, CONFIDENCE, SEED = 8, 0.95, 20141029
#: The stop is checked on the neighbours of so many queries among so many sampled rows, of so many numbers in all.
CALIBRATED, CALIBRATION_QUERIES, CALIBRATION_ROWS, CALIBRATION_NUMBERS = 0.97, 128, 2_048, 1 << 21
#: Rows that the top of the tree is fitted on, and bounds of shards, leaves and blocks of queries.
SAMPLE_ROWS, SHARD_ROWS, MOST_SHARDS, LEAF_ROWS, QUERY_BLOCK = 16_384, 8_192, 4_096, 512, 8_192
#: Shards for vectors of other lengths than the most common one, searched without the top of the tree.
OTHER_SHARDS = 1_024
CHUNK = 64


def chi_square_quantile(share: float, degrees: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))
        low, high = (low, x) if 1 - tail > share else (x, high)
    return high


class Space:
    """Scales, lifts and projects vectors of one length; no component exceeds 2^exponent, no scaled norm ``largest``."""

    def __init__(self, size: int, exponent: int, largest: float) -> None:
        self.size, self.exponent, self.largest = size, exponent, largest
        drawn = np.random.default_rng([SEED, size]).standard_normal((size + 1, PROJECTIONS))
        if size + 1 >= PROJECTIONS:
            self.lines = np.linalg.qr(drawn)[0] * math.sqrt(size + 1)
        else:  # fewer coordinates than lines: distances are kept exactly
            self.lines = np.linalg.qr(drawn.T)[0].T * math.sqrt(PROJECTIONS)
        self.lines[-1] *= math.sqrt(PROJECTIONS) / np.linalg.norm(self.lines[-1])

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return np.ldexp(v, -self.exponent)

    def rows(self, scaled: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - np.einsum("ij,ij->i", scaled, scaled), 0.0))
        return scaled @ self.lines[:-1] + rest[:, None] * self.lines[-1]

    def queries(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries scaled each by its own power of two, their norms and projections."""
        scaled = np.ldexp(v, -exponents(v)[:, None])
        norms = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
        return scaled, norms, (scaled * (self.largest / norms)[:, None]) @ self.lines[:-1]

    def distance(self, near: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Squared distances behind products of scaled rows and a scaled query."""
        return np.maximum(0.0, 2 * self.largest**2 - 2 * self.largest * near / norm)


def calibrated_stop(space: Space, sample: np.ndarray, k: int) -> float:
    """The chi-square quantile, or the measured one where it is larger; sample are vectors of the space's length."""
    stop = chi_square_quantile(CONFIDENCE, PROJECTIONS)
    if len(sample) <= k:
        return stop
    scaled, asked = space.scaled(sample), sample[:CALIBRATION_QUERIES]
    queries, norms, at = space.queries(asked)
    true = space.distance(scaled @ queries.T, norms[None, :])
    true[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argpartition(true, k, axis=0)[:k]
    points, ratios = space.rows(scaled), []
    for i in range(len(asked)):
        d = true[near[:, i], i]
        apart = np.isfinite(d) & (d > 1e-9 * space.largest**2)  # copies are found anyway, and their rounding is no distance
        ratios.append(((points[near[apart, i]] - at[i]) ** 2).sum(axis=1) / d[apart])
    measured = np.concatenate(ratios)
    return max(stop, float(np.quantile(measured, CALIBRATED))) if len(measured) else stop


class TopTree:
    """Median splits of the projected sample, to a depth; shards are numbered left to right."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        count = 1 << depth
        self.axis, self.value = np.zeros(count, dtype=np.int64), np.zeros(count)
        self.low = np.full((count, PROJECTIONS), -np.inf)
        self.high = np.full((count, PROJECTIONS), np.inf)
        self._split(1, 0, 0, sample)

    def _split(self, node: int, level: int, first: int, part: np.ndarray) -> None:
        if level == self.depth:
            return
        axis = int(np.argmax(part.std(axis=0))) if len(part) else level % PROJECTIONS
        value = float(np.median(part[:, axis])) if len(part) else 0.0
        self.axis[node], self.value[node] = axis, value
        half = 1 << (self.depth - level - 1)
        left, right = slice(first, first + half), slice(first + half, first + 2 * half)
        self.high[left, axis] = np.minimum(self.high[left, axis], value)
        self.low[right, axis] = np.maximum(self.low[right, axis], value)
        self._split(2 * node, level + 1, first, part[part[:, axis] < value])
        self._split(2 * node + 1, level + 1, first + half, part[part[:, axis] >= value])

    def shard(self, projected: np.ndarray) -> np.ndarray:
        node = np.ones(len(projected), dtype=np.int64)
        for _ in range(self.depth):
            right = projected[np.arange(len(node)), self.axis[node]] >= self.value[node]
            node = 2 * node + right
        return node - (1 << self.depth)

    def distances(self, projected: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each shard's region."""
        out = np.zeros((len(projected), len(self.low)))
        for k in range(PROJECTIONS):
            q = projected[:, k][:, None]
            out += np.maximum(0.0, np.maximum(self.low[:, k] - q, q - self.high[:, k])) ** 2
        return out


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """A kd-tree's leaves: median splits on the widest axis down to LEAF_ROWS."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= LEAF_ROWS:
            leaves.append(at)
            continue
        axis = int(np.argmax(np.ptp(points[at], axis=0)))
        order = at[np.argpartition(points[at, axis], len(at) // 2)]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return leaves


class Shard:
    """Rows of one length stored leaf by leaf; yields each query's best."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, space: Space) -> None:
        scaled = space.scaled(v)
        p = space.rows(scaled)
        leaves = _leaves(p)
        order = np.concatenate(leaves)
        self.space, self.v, self.ids, self.p = space, scaled[order], ids[order], p[order]
        stops = np.cumsum([len(at) for at in leaves])
        self.runs = list(zip([0, *stops[:-1].tolist()], stops.tolist()))
        self.low = np.array([self.p[a:b].min(axis=0) for a, b in self.runs])
        self.high = np.array([self.p[a:b].max(axis=0) for a, b in self.runs])

    def best(self, query: np.ndarray, norm: float, at: np.ndarray, own_id: int, bound: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and products of the k best rows, verified in the order of projected distance until the stop.

        bound is the query's k-th squared distance elsewhere.  Leaves are opened in the order of their boxes;
        a point is verified once no unopened leaf can hold one that is nearer in projection.
        """
        gap = np.maximum(0.0, np.maximum(self.low - at, at - self.high))
        ahead = np.einsum("ij,ij->i", gap, gap)
        order = np.argsort(ahead, kind="stable")
        near, found = np.zeros(0), np.zeros(0, dtype=np.int64)
        waiting, waiting_d = np.zeros(0, dtype=np.int64), np.zeros(0)
        opened, step = 0, 1
        while True:
            if opened < len(order) and ahead[order[opened]] <= stop * bound:
                new = np.concatenate([np.arange(*self.runs[leaf]) for leaf in order[opened : opened + step]])
                opened, step = opened + step, 2 * step
                off = self.p[new] - at
                d = np.einsum("ij,ij->i", off, off)
                kept = (d <= stop * bound) & (self.ids[new] != own_id)
                waiting, waiting_d = np.append(waiting, new[kept]), np.append(waiting_d, d[kept])
            more = opened < len(order) and ahead[order[opened]] <= stop * bound
            ready = waiting_d <= ahead[order[opened]] if more else np.ones(len(waiting), dtype=bool)
            rank = np.flatnonzero(ready)[np.argsort(waiting_d[ready], kind="stable")]
            c, size = 0, CHUNK
            while c < len(rank) and waiting_d[rank[c]] <= stop * bound:
                part = rank[c : c + size]
                c, size = c + size, 2 * size
                part = waiting[part[waiting_d[part] <= stop * bound]]
                s = np.einsum("ij,j->i", self.v[part], query)  # a row's sum does not depend on its place
                if len(near) == k:
                    part, s = part[s >= near[-1]], s[s >= near[-1]]
                if not len(part):
                    continue
                near, found = np.append(near, s), np.append(found, part)
                top = np.lexsort((self.ids[found], -near))[:k]
                near, found = near[top], found[top]
                if len(near) == k:
                    bound = min(bound, float(self.space.distance(near[-1], norm)))
            if not more:
                return found, near
            waiting, waiting_d = waiting[~ready], waiting_d[~ready]


FOUND = "query_id long, query_hash long, copies long, vec_id long, near double, score double"


def _search(rows: pa.Table, queries: pa.Table, space_of: Callable[[int], Space], k: int, stop: float) -> pa.Table:
    """Each query's best k of the rows of its length."""
    parts = []
    row_sizes, query_sizes = (np.array([len(b) // 8 for b in t.column("vec").to_pylist()]) for t in (rows, queries))
    for size in np.intersect1d(row_sizes, query_sizes).tolist():
        own, asked = rows.take(pa.array(np.flatnonzero(row_sizes == size))), queries.take(pa.array(np.flatnonzero(query_sizes == size)))
        space = space_of(size)
        shard = Shard(matrix(own.column("vec")), own.column("vec_key").to_numpy(), space)
        qv = matrix(asked.column("vec"))
        scaled, norms, at = space.queries(qv)
        shift = exponents(qv) + space.exponent
        ids, bounds = asked.column("vec_key").to_numpy(), asked.column("bound").to_numpy()
        got = [shard.best(scaled[i], norms[i], at[i], ids[i], bounds[i], k, stop) for i in range(len(qv))]
        counts = np.array([len(f) for f, _ in got])
        which = pa.array(np.repeat(np.arange(len(qv)), counts))
        near = np.concatenate([s for _, s in got])
        head = asked.select(["vec_key", "query_hash", "copies"]).take(which)
        with np.errstate(over="ignore", under="ignore"):
            score = np.ldexp(near, np.repeat(shift, counts))
        places = np.concatenate([f for f, _ in got])
        columns = [*head.columns, pa.array(shard.ids[places]), pa.array(near), pa.array(score)]
        parts.append(pa.table(columns, names=["query_id", "query_hash", "copies", "vec_id", "near", "score"]))
    return pa.concat_tables(parts) if parts else pa.table({n: pa.array([], t) for n, t in zip(
        ["query_id", "query_hash", "copies", "vec_id", "near", "score"], [pa.int64()] * 4 + [pa.float64()] * 2)})


QUERY = ["query_id", "query_hash"]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy(*QUERY).orderBy(F.desc("near"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _measure(rows: DataFrame) -> DataFrame:
    """Per length: rows, the exponent of the largest component, and log2 of the largest norm."""

    def run(batches):
        for batch in batches:
            vectors = [np.frombuffer(b, dtype="<f8") for b in batch.column(0).to_pylist()]
            tops = [int(np.frexp(np.abs(v).max())[1]) for v in vectors]
            logs = [e + math.log2(np.linalg.norm(np.ldexp(v, -e))) for v, e in zip(vectors, tops)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(v) for v in vectors], pa.int64()), pa.array(tops, pa.int64()), pa.array(logs, pa.float64())], ["size", "top", "log"]
            )

    return rows.select("vec").mapInArrow(run, "size long, top long, log double").groupBy("size").agg(
        F.count("*").alias("n"), F.max("top").alias("top"), F.max("log").alias("log")
    )


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score, query_hash, query_copy) of each query row's k best found among all other rows.

    is_query tells from an id whether its rows ask.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = packed(vectors, id_col, vector_col).where("vec is not null and vec_key is not null")
    rows = rows.select(F.col("vec_key").cast("long").alias("vec_key"), "vec", F.monotonically_increasing_id().alias("row_no")).checkpoint()
    sizes = _measure(rows).orderBy(F.desc("n"), "size")
    usual = sizes.first()
    out = ["query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score", "query_hash"]
    if usual is None:
        none = spark.createDataFrame([], FOUND).withColumn("rank", F.lit(0))
        return none.select(*out, F.lit(1).alias("query_copy"))
    exponent = sizes.agg(F.max("top")).first()[0]
    largest = 2.0 ** (usual["log"] - exponent) * (1 + 1e-9)
    common = Space(usual["size"], exponent, max(largest, 1e-150))

    def space_of(size: int) -> Space:
        return common if size == common.size else Space(size, exponent, math.sqrt(size))

    is_common = F.octet_length("vec") == 8 * common.size

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                p = common.rows(common.scaled(matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array(list(p), pa.list_(pa.float64()))], ["p"])

    def sampled(most: int) -> DataFrame:
        share = min(1.0, most / usual["n"])
        return rows.where(is_common & (F.pmod(F.xxhash64("row_no"), F.lit(1 << 30)) < share * (1 << 30)))

    chosen = sampled(SAMPLE_ROWS)
    sample = chosen.select("vec").mapInArrow(project, "p array<double>").toArrow().column("p").to_pylist()
    depth = min(int(math.log2(MOST_SHARDS)), max(0, math.ceil(math.log2(usual["n"] / SHARD_ROWS))))
    tree = TopTree(np.array(sample, dtype=float).reshape(-1, PROJECTIONS), depth)
    few = sampled(min(CALIBRATION_ROWS, CALIBRATION_NUMBERS // common.size)).select("vec").toArrow().column("vec").combine_chunks()
    stop = calibrated_stop(common, matrix(few) if len(few) else np.zeros((0, common.size)), k)

    def placed(place: Callable):
        """Appends the shards of each row; place gives (row, shard) of a batch of one length."""

        def run(batches):
            for batch in batches:
                lengths = np.array([len(b) // 8 for b in batch.column("vec").to_pylist()], dtype=np.int64)
                for size in np.unique(lengths).tolist():
                    part = batch.take(pa.array(np.flatnonzero(lengths == size)))
                    at, shard = place(part, size)
                    part = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shard, pa.int64())], [*batch.schema.names, "shard"])

        return run

    def home(projected: Callable) -> Callable:
        def place(part, size):
            at = np.arange(part.num_rows)
            if size != common.size:
                return at, np.full(part.num_rows, -1 - size % OTHER_SHARDS)
            return at, tree.shard(projected(matrix(part.column("vec"))))

        return place

    def elsewhere(part, size):
        """The shards beside a query's own that may hold a nearer row."""
        p = common.queries(matrix(part.column("vec")))[2]
        open_ = tree.distances(p) <= stop * part.column("bound").to_numpy()[:, None]
        open_[np.arange(len(p)), tree.shard(p)] = False
        return np.nonzero(open_)

    dealt = rows.mapInArrow(placed(home(lambda v: common.rows(common.scaled(v)))), "vec_key long, vec binary, row_no long, shard long")
    crowds = dealt.groupBy("shard").agg(F.ceil(F.count("*") / (2 * SHARD_ROWS)).cast("int").alias("cuts"))
    kind = "vec_key long, query_hash long, copies long, vec binary, bound double"

    def search(queries: DataFrame, place: Callable) -> DataFrame:
        asking = queries.mapInArrow(placed(place), f"{kind}, shard long")
        load = asking.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        meetings = F.broadcast(crowds.join(load, "shard"))  # MOST_SHARDS + OTHER_SHARDS rows at most
        here = (
            dealt.join(meetings, "shard")
            .withColumn("cut", F.pmod(F.xxhash64("row_no"), F.col("cuts")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("vec_key", "vec", "shard", "cut", "block")
        )
        spread = (
            asking.join(meetings, "shard")
            .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            .withColumn("block", F.pmod(F.xxhash64("vec_key", "query_hash"), F.col("blocks")).cast("int"))
            .select("vec_key", "query_hash", "copies", "vec", "bound", "shard", "cut", "block")
        )
        keys = ["shard", "cut", "block"]
        return here.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, space_of, k, stop), FOUND)

    asked = (
        rows.where(F.coalesce(is_query(F.col("vec_key")), F.lit(False)))
        .groupBy("vec_key", F.xxhash64("vec").alias("query_hash"), "vec")
        .agg(F.count("*").alias("copies"))
        .select("vec_key", "query_hash", "copies", "vec")
        .checkpoint()
    )
    first = search(asked.withColumn("bound", F.lit(float("inf"))), home(lambda v: common.queries(v)[2]))
    near_home = _best(first, k).checkpoint()
    kth = near_home.where(F.col("rank") == k).select(F.col("query_id").alias("vec_key"), "query_hash", F.col("near").alias("kth"))

    def bound(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            norms = common.queries(matrix(batch.column("vec")))[1]
            s = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
            d = np.where(np.isnan(s), np.inf, common.distance(s, norms))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(d)], ["vec_key", "query_hash", "copies", "vec", "bound"])

    joined = asked.where(is_common).join(kth, ["vec_key", "query_hash"], "left").select("vec_key", "query_hash", "copies", "vec", "kth")
    others = search(joined.mapInArrow(bound, kind).checkpoint(), elsewhere)
    merged = _best(near_home.drop("rank").unionByName(others), k)
    return merged.select(*out, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("query_copy"))
