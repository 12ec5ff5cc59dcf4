"""Embedding near-duplicates by collision-counting projections.

Counting window collisions over all pairs of a single sorted projection touches a fixed share of all
pairs, which is quadratic.  So the projections first cut space: a bundle of b sign projections of the
centred vectors sends each vector to one of 2^b cells, with b growing with log n so that a cell stays a
small block, and as many bundles as make a pair at the threshold share a cell with probability
``RECALL``.  Where that would take more than ``MOST_BUNDLES`` bundles, cells have fewer bits and hold
more vectors instead, so the promised recall holds at every size and threshold.

Inside a cell, each of ``LINES`` further projections is sorted, every vector's query-centred window is cut
out of the sorted line, and window collisions are counted per pair; pairs with at least the calibrated
number of collisions (a pair at the threshold reaches it with probability ``COUNT_RECALL``) are verified
by their cosine in double precision.

A pair that shares several cells counts in the first one only, so link counts add up without listing
pairs; a cell hands on one row per vector.  Exact copies are one weighted node.  A cell above ``BLOCK``
vectors is cut into blocks, all pairs of blocks compared as separate groups, so nothing is left out.

Defined results: null, empty and zero vectors and those with null or non-finite components link with
nothing; vectors of different lengths never link; very large and very small components are scaled, not
lost; each repeated row is a vector of its own; a null id never names a component with another id; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentflow.llm.graph import components, named_by_first, spread_join
from segmentflow.llm.vectors import matrix, packed, units
from segmentflow.session import ensure_checkpoint_dir

RECALL, COUNT_RECALL = 0.998, 0.9995
LINES, WINDOW = 32, 2.0
CELL_ROWS, BLOCK, MOST_BITS, MOST_BUNDLES = 256, 1024, 30, 96
#: The share of vectors that may lie nearer to the centre than the design assumes.
NEAR_CENTRE = 0.01
SEED = 20240917


def design(n: int, cosine: float, spread: float = 1.0) -> tuple[int, int, float, int]:
    """Bits of a cell, bundles, half window and least collisions for n vectors and a threshold.

    spread is the squared distance of unit vectors from their centre that all but a few exceed: two vectors
    at the threshold are seen from the centre under an angle of cosine 1 - (1 - cosine) / spread.
    """
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(n, 1) / CELL_ROWS))))
    one = 1 - math.acos(max(-1.0, 1 - (1 - cosine) / max(spread, 1e-12))) / math.pi

    def needed(b: int) -> float:
        together = one**b
        return 1.0 if together >= RECALL else math.log(1 - RECALL) / math.log1p(-together) if together > 1e-12 else math.inf

    while bits and needed(bits) > MOST_BUNDLES:
        bits -= 1
    half = WINDOW * math.sqrt(2 * (1 - cosine))
    hit = math.erf(WINDOW / math.sqrt(2))
    least, tail = LINES, hit**LINES
    while tail < COUNT_RECALL:
        least -= 1
        tail += math.comb(LINES, least) * hit**least * (1 - hit) ** (LINES - least)
    return bits, math.ceil(needed(bits)), half, least


def _planes(size: int, rows: int, salt: int) -> np.ndarray:
    return np.random.default_rng([SEED, size, salt]).standard_normal((rows, size))


def codes_of(unit: np.ndarray, bits: int, bundles: int, centre: np.ndarray | None = None) -> np.ndarray:
    """The cell number of each vector in each bundle; planes pass through the centre of vectors of its length."""
    if not bits:
        return np.zeros((len(unit), bundles), dtype=np.int64)
    planes = _planes(unit.shape[1], bits * bundles, 0)
    at = planes @ centre if centre is not None and len(centre) == unit.shape[1] else 0.0
    signs = (unit @ planes.T > at).reshape(len(unit), bundles, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def colliding(a: np.ndarray, b: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose windows collide on at least ``least`` lines (columns).

    The first half of the lines is sorted and windows are cut out; the few pairs that can still reach the
    count are then looked up on the other lines.
    """
    first, lines = (a.shape[1] + 1) // 2, a.shape[1]
    hits = np.zeros(len(a) * len(b), dtype=np.int64)
    rows = np.arange(len(a), dtype=np.int64) * len(b)
    for k in range(first):
        order = np.argsort(b[:, k], kind="stable")
        line = b[order, k]
        low, high = np.searchsorted(line, a[:, k] - half, "left"), np.searchsorted(line, a[:, k] + half, "right")
        width = high - low
        inside = np.arange(width.sum()) + np.repeat(low - np.cumsum(width) + width, width)
        hits += np.bincount(np.repeat(rows, width) + order[inside], minlength=len(hits))
    pairs = np.flatnonzero(hits >= least - (lines - first))
    i, j, count = pairs // len(b), pairs % len(b), hits[pairs]
    for k in range(first, lines):
        count += (b[j, k] >= a[i, k] - half) & (b[j, k] <= a[i, k] + half)
    return i[count >= least], j[count >= least]


def _links_of_block(table: pa.Table, plan: tuple, cosine: float, centre: np.ndarray | None) -> pa.Table:
    """For each vector of a cell's pair of blocks: its links counted here and the least key reachable here."""
    bits, bundles, half, least = plan
    bundle, low, high = (table.column(c)[0].as_py() for c in ("bundle", "low", "high"))
    order = np.argsort(np.array(table.column("class_key").to_pylist()))
    table = table.take(pa.array(order))
    block, copies = table.column("block").to_numpy(), table.column("copies").to_numpy()
    unit = units(matrix(table.column("vec").combine_chunks()))
    a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
    lines = unit @ _planes(unit.shape[1], LINES, 1).T
    i, j = colliding(lines[a], lines[b], half, least)
    i, j = a[i], b[j]
    once = i < j if low == high else i != j
    i, j = i[once], j[once]
    linked = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), 1 << 16):
        x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        linked[s : s + (1 << 16)] = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
    i, j = i[linked], j[linked]
    codes = codes_of(unit, bits, bundles, centre)
    first = np.ones(len(i), dtype=bool)
    for g in range(bundle):
        first &= codes[i, g] != codes[j, g]
    counted = np.zeros(len(unit), dtype=np.int64)
    np.add.at(counted, i[first], copies[j[first]])
    np.add.at(counted, j[first], copies[i[first]])
    least_of = np.arange(len(unit))
    while True:
        before = least_of.copy()
        np.minimum.at(least_of, i, least_of[j])
        np.minimum.at(least_of, j, least_of[i])
        if np.array_equal(before, least_of):
            break
    told = np.flatnonzero((counted > 0) | (least_of != np.arange(len(unit))))
    keys = table.column("class_key").combine_chunks()
    return pa.table(
        {
            "class_key": keys.take(pa.array(told)),
            "links": pa.array(counted[told], pa.int64()),
            "reaches": keys.take(pa.array(least_of[told])),
        }
    )


def centre_of(classes: DataFrame) -> tuple[np.ndarray | None, float]:
    """Mean of the unit vectors of the most common length, and the squared distance from it that nearly all exceed."""
    sizes = classes.groupBy(F.octet_length("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return None, 1.0
    same = classes.where(F.octet_length("vec") == sizes["size"]).select("vec")

    def sums(batches):
        for batch in batches:
            if batch.num_rows:
                total = units(matrix(batch.column(0))).sum(axis=0)
                places = pa.array(np.arange(len(total), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([places, pa.array(total)], ["place", "value"])

    summed = same.mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    centre = np.zeros(sizes["size"] // 8)
    for row in summed.collect():  # one row per component of a vector
        centre[row["place"]] = row["value"] / sizes["n"]

    def away(batches):
        for batch in batches:
            if batch.num_rows:
                off = units(matrix(batch.column(0))) - centre
                yield pa.RecordBatch.from_arrays([pa.array(np.einsum("ij,ij->i", off, off))], ["away"])

    spread = same.mapInArrow(away, "away double").agg(F.percentile_approx("away", NEAR_CENTRE)).first()[0]
    return centre, float(spread)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) per row; links are pairs found with at least the cosine."""
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = packed(vectors, id_col, vector_col).withColumn("class_key", F.sha2("vec", 256)).checkpoint()
    classes = rows.where("vec is not null").groupBy("class_key").agg(
        F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_key").alias("first_id")
    ).checkpoint()
    centre, spread = centre_of(classes)
    plan = bits, bundles, _, _ = design(classes.count(), cosine, spread)

    def cells(batches):
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("vec").to_pylist()], dtype=np.int64)
            for size in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == size)))
                codes = codes_of(units(matrix(part.column("vec"))), bits, bundles, centre)
                for g in range(bundles):
                    n = part.num_rows
                    own = [pa.array(np.full(n, g, dtype=np.int32)), pa.array(np.full(n, size)), pa.array(codes[:, g])]
                    yield pa.RecordBatch.from_arrays([*part.columns, *own], ["class_key", "vec", "copies", "bundle", "size", "cell"])

    schema = "class_key string, vec binary, copies long, bundle int, size long, cell long"
    celled = classes.select("class_key", "vec", "copies").mapInArrow(cells, schema)
    where = ["bundle", "size", "cell"]
    # A bundle's cells are at most 2^bits; only their sizes are joined back, and cells of one are dropped.
    sizes = celled.groupBy(where).agg(F.count("*").alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    placed = (
        celled.join(sizes, where)
        .withColumn("block", F.pmod(F.xxhash64("class_key"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "class_key", "vec", "copies", *where, "block",
            F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        )
    )

    def run(table: pa.Table) -> pa.Table:
        return _links_of_block(table, plan, cosine, centre)

    found = (
        placed.groupBy(*where, "low", "high")
        .applyInArrow(run, "class_key string, links long, reaches string")
        .groupBy("class_key", "reaches")
        .agg(F.sum("links").alias("links"))
        .checkpoint()
    )
    links = found.groupBy("class_key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class_key").alias("src"), F.col("reaches").alias("dst")))
    named = named_by_first(classes.select("class_key", "first_id", "copies"), roots, "class_key").join(links, "class_key", "left")
    valid = spread_join(rows.where("vec is not null").select("vec_key", "class_key"), named, "class_key")
    linked = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long")
    alone = rows.where("vec is null").select("vec_key", F.lit(0).cast("long").alias("n_links"), F.col("vec_key").alias("component_id"))
    done = valid.select("vec_key", linked.alias("n_links"), F.coalesce("component_id", "vec_key").alias("component_id")).unionByName(alone)
    return done.select(
        F.col("vec_key").alias(id_col), "n_links", "component_id", F.col("vec_key").eqNullSafe(F.col("component_id")).alias("kept")
    )
