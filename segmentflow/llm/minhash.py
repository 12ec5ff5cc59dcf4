"""Near-duplicates by Jaccard similarity of word shingles: SimHash and MinHash bands propose pairs, whole sets decide.

Equal shingle sets are one node.  Nodes whose fingerprints the SimHash operator links (``simhash.links``: within two
bits, found by their deletion variants) are compared first.  Two bits find the smallest edits only, so MinHash
proposes beside it and follows over what both leave apart.  A node has ``BANDS`` keys of ``ROWS`` minima each; nodes that share a
key are candidates, and every link is verified by the true similarity of the two sets.  A pair at 0.8
shares a key with probability 0.998, one at 0.9 nearly always.

Only components are wanted, so the nodes of a key are first compared with its most central node (whose keys
are the most common).  What that leaves apart is compared in full: every pair of nodes that share a key and
lie in different components.  Keys of up to ``SMALL_BUCKET`` nodes become rows of pairs; larger ones are cut
into blocks of bounded size, and each pair of blocks is one task's matrix of common shingles.  Both ways give
the same components; work grows with the square of what a key holds apart, not of what it holds.

Defined results: texts without words have the empty set and link with each other only; texts of any
length are hashed whole; repeated rows and null ids are ordinary rows; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmentflow.llm import simhash
from segmentflow.llm.columns import column
from segmentflow.llm.graph import components, first_rows, sieved, spread_join
from segmentflow.llm.simhash import shingle_hashes
from segmentflow.session import ensure_checkpoint_dir

BANDS, ROWS = 20, 6
#: Keys of more nodes are paired by blocks; results do not depend on it.
SMALL_BUCKET = 8
#: Nodes and shingles of one block, as expected; nodes come to blocks by hash.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 19
#: Sets of sizes in one class or in neighbouring ones may be alike; more than the inverse of the least similarity.
SIZE_STEP = 1.26
#: Shingles in so many sets of a block are compared by a matrix product, rarer ones one by one.
COMMON = 8
CHUNK = 1 << 13
#: The least similarity as a fraction, compared in whole numbers.
LEAST = (4, 5)
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def text_hashes(text: str | None, width: int) -> list[np.ndarray]:
    """The shingle hashes of a whole text, repeats included, in chunks."""
    return list(shingle_hashes((text or "").encode("utf-8", "replace"), width))


def distinct_hashes(chunks: list[np.ndarray]) -> np.ndarray:
    """The distinct ones, rising."""
    return np.unique(np.concatenate(chunks)) if chunks else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a whole text, rising."""
    return distinct_hashes(text_hashes(text, width))


def band_keys(own: np.ndarray) -> list[int]:
    """One signed 64-bit key per band; none for the empty set, which equals only itself."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), CHUNK):
        least = np.minimum(least, (own[at : at + CHUNK] * _FACTORS + _SHIFTS).min(axis=1))
    of = xxhash.xxh64_intdigest
    keys = [of(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets are equal or have at least the least Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = column(text_col).cast("string")
    return docs.select(column(id_col).alias("node_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node_id, text_key, fingerprint, node, size, keys) per row; node is the digest of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, nodes, sizes, keys = [], [], [], []
            for i in range(batch.num_rows):
                hashes = text_hashes(batch.column(2)[i].as_py(), width)
                own = distinct_hashes(hashes)
                prints.append(simhash.fingerprint_of(hashes))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                keys.append(band_keys(own))
            columns = [pa.array(prints, pa.int64()), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], out.names)

    chosen = _keyed(docs, id_col, text_col)
    out = T.StructType([*chosen.schema.fields[:2], *T._parse_datatype_string("fingerprint long, node long, size long, keys array<long>").fields])
    return chosen.mapInArrow(run, out)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, own) for the wanted (node, rep), from the row of each that rep names; texts stay where they are."""
    reps = wanted.select("node", F.col("rep.node_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key")).checkpoint()
    hashes = reps.select(F.xxhash64("rep_id", "rep_key").alias("hash"))
    rows = sieved(_keyed(docs, id_col, text_col), F.xxhash64("node_id", "text_key"), hashes, "asked").where("asked").select("node_id", "text_key", "text")
    out = T.StructType([*rows.schema.fields[:2], T.StructField("own", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(batch.column(2)[i].as_py(), width).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.binary())], out.names)

    same = F.col("node_id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key"))
    return rows.mapInArrow(run, out).join(reps, same).groupBy("node").agg(F.first("own").alias("own"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst, r1, r2) that are alike."""
    joined = pairs.join(sets.select(F.col("node").alias("src"), F.col("own").alias("a")), "src").join(
        sets.select(F.col("node").alias("dst"), F.col("own").alias("b")), "dst"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(4), batch.column(5)
            read = lambda x: np.frombuffer(x.as_py(), dtype=np.uint64)
            good = [alike(read(a[i]), read(b[i])) for i in range(batch.num_rows)]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    return joined.select(*PAIR, "a", "b").mapInArrow(run, "src long, dst long, r1 long, r2 long")


def _fits() -> Column:
    """Whether the sizes of a pair allow the least similarity."""
    return F.least("size", "other_size") * LEAST[1] >= F.greatest("size", "other_size") * LEAST[0]


PAIR = ["src", "dst", "r1", "r2"]


def _paired(members: DataFrame) -> DataFrame:
    """All pairs under a common key of different roots whose sizes allow the similarity."""
    other = members.select("key", F.col("node").alias("dst"), F.col("root").alias("r2"), F.col("size").alias("other_size"))
    both = members.join(other, "key").where((F.col("node") < F.col("dst")) & (F.col("root") != F.col("r2")) & _fits())
    return both.select(F.col("node").alias("src"), "dst", F.col("root").alias("r1"), "r2")


def _starred(members: DataFrame, order: str) -> DataFrame:
    """Every member paired with the one of its key that comes last by order; a crowded key is spread."""
    hubs = members.groupBy("key").agg(F.max(F.struct(order, "node", "size", "root")).alias("hub"))
    both = spread_join(members, hubs, "key").withColumn("other_size", F.col("hub.size")).where((F.col("root") != F.col("hub.root")) & _fits())
    first = F.col("node") < F.col("hub.node")
    return both.select(
        F.least("node", "hub.node").alias("src"), F.greatest("node", "hub.node").alias("dst"),
        F.when(first, F.col("root")).otherwise(F.col("hub.root")).alias("r1"),
        F.when(first, F.col("hub.root")).otherwise(F.col("root")).alias("r2"),
    )


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common shingles of each set of left with each of right."""
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for sets in (left, right):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((np.concatenate(sets), owner))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    placed = []
    for values, owner in sides:
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        hit = shared[at] == values if len(shared) else np.zeros(len(values), dtype=bool)
        placed.append((at[hit], owner[hit]))
    often = np.minimum(*(np.bincount(at, minlength=len(shared)) for at, _ in placed)) >= COMMON
    columns = np.cumsum(often) - 1
    for first in range(0, int(often.sum()), CHUNK):  # a product of 0/1 matrices, exact in single precision
        parts = []
        for (at, owner), n in zip(placed, counts.shape):
            own = often[at] & (columns[at] >= first) & (columns[at] < first + CHUNK)
            part = np.zeros((n, min(CHUNK, int(often.sum()) - first)), dtype=np.float32)
            part[owner[own], columns[at[own]] - first] = 1
            parts.append(part)
        counts += parts[0] @ parts[1].T
    rare = [(at[~often[at]], owner[~often[at]]) for at, owner in placed]
    (a, a_owner), (b, b_owner) = (tuple(x[np.argsort(r[0], kind="stable")] for x in r) for r in rare)
    low, high = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
    for first in range(0, len(a), CHUNK):  # each rare shingle of left meets its sets of right
        n = (high - low)[first : first + CHUNK]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(low[first : first + CHUNK] - ends + n, n)
        np.add.at(counts, (np.repeat(a_owner[first : first + CHUNK], n), b_owner[at]), 1)
    return counts.astype(np.int64)


def _block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (src, dst, r1, r2) that are alike among the members (key, node, size, root) of each key, enough to join their roots.

    A root with many members of a key has blocks of its own, which are never compared with each other.
    """
    members = members.withColumn("class", F.floor(F.log("size") / F.lit(float(np.log(SIZE_STEP))))).checkpoint()
    parts = lambda: F.greatest(F.ceil(F.sum("n") / BLOCK_NODES), F.ceil(F.sum("weight") / BLOCK_SHINGLES))
    per_root = members.groupBy("key", "class", "root").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    large = (F.col("n") * 2 >= BLOCK_NODES) | (F.col("weight") * 2 >= BLOCK_SHINGLES)
    homes = per_root.withColumn("home", F.when(large, F.col("root"))).checkpoint()
    sizes = homes.groupBy("key", "class", "home").agg(parts().alias("parts"))
    placed = members.join(homes.select("key", "class", "root", "home"), ["key", "class", "root"])
    sized = sizes.checkpoint()
    placed = placed.join(
        sized.select(F.col("key").alias("k"), F.col("class").alias("c"), F.col("home").alias("h"), "parts"),
        (F.col("key") == F.col("k")) & (F.col("class") == F.col("c")) & F.col("home").eqNullSafe(F.col("h")),
    ).select("key", "class", "home", F.pmod(F.xxhash64("node"), "parts").alias("part"), "node", "root")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    blocks = sized.select("key", "class", "home", part).select("key", F.struct("class", "home", "part").alias("block"))
    step = F.col("b.block.class") - F.col("a.block.class")
    one_home = F.coalesce(F.col("a.block.home") == F.col("b.block.home"), F.lit(False))
    pairs = (
        blocks.alias("a").join(blocks.alias("b"), F.col("a.key") == F.col("b.key"))
        .where(((step == 1) | ((step == 0) & (F.col("a.block") <= F.col("b.block")))) & ~one_home)
        .select(F.monotonically_increasing_id().alias("pair"), F.col("a.key").alias("key"), F.col("a.block").alias("a"), F.col("b.block").alias("b"))
        .checkpoint()
    )
    sides = pairs.select("pair", "key", F.lit(0).alias("side"), F.col("a").alias("block")).unionByName(
        pairs.where(~F.col("a").eqNullSafe(F.col("b"))).select("pair", "key", F.lit(1).alias("side"), F.col("b").alias("block"))
    )
    keyed = placed.select("key", F.struct("class", "home", "part").alias("block"), "node", "root")
    same = (sides["key"] == keyed["key"]) & sides["block"].eqNullSafe(keyed["block"])
    met = sides.join(keyed, same).select("pair", "side", "node", "root").join(sets, "node").select("pair", "side", "node", "root", "own")

    def link(group: pa.Table) -> pa.Table:
        node, root, side = (group.column(c).to_numpy() for c in ("node", "root", "side"))
        own = [np.frombuffer(x, dtype=np.uint64) for x in group.column("own").to_pylist()]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in PAIR})
        a, b = [own[i] for i in left], [own[i] for i in right]
        both = common_counts(a, b)
        total = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
        good = (LEAST[1] * both >= LEAST[0] * (total - both)) & (root[left][:, None] != root[right][None, :])
        i, j = (x[at] for x, at in zip((left, right), np.nonzero(good)))
        low = node[i] < node[j]
        src, dst = np.where(low, i, j), np.where(low, j, i)
        _, first = np.unique(np.stack([root[src], root[dst]], axis=1), axis=0, return_index=True)
        boss: dict[int, int] = {}

        def top(x: int) -> int:
            while boss.get(x, x) != x:
                x = boss[x]
            return x

        kept = []
        for at in first.tolist():  # a forest over the roots is enough
            p, q = top(int(root[src[at]])), top(int(root[dst[at]]))
            if p != q:
                boss[max(p, q)] = min(p, q)
                kept.append(at)
        src, dst = src[kept], dst[kept]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(PAIR, (node[src], node[dst], root[src], root[dst]))})

    return met.groupBy("pair").applyInArrow(link, "src long, dst long, r1 long, r2 long")


def _print_pairs(found: DataFrame) -> DataFrame:
    """Pairs of nodes whose fingerprints the SimHash operator links, and of nodes with one fingerprint, as stars."""
    prints = found.select("fingerprint", "node").distinct().checkpoint()
    hubs = prints.groupBy("fingerprint").agg(F.min("node").alias("hub")).checkpoint()
    copies = spread_join(prints, hubs, "fingerprint").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    named = lambda end, name: hubs.select(F.col("fingerprint").alias(end), F.col("hub").alias(name))
    linked = simhash.links(hubs.select("fingerprint")).join(named("src", "a"), "src").join(named("dst", "b"), "dst").select("a", "b")
    ends = copies.unionByName(linked).where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return ends.select("src", "dst", F.col("src").alias("r1"), F.col("dst").alias("r2"))


def linked_roots(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, root) of the nodes that are alike to others; found are the signatures of docs."""
    nodes = (
        found.groupBy("node")
        .agg(F.min(F.struct("node_id", "text_key")).alias("rep"), F.first("size").alias("size"), F.first("keys").alias("keys"))
        .checkpoint()
    )
    printed = _print_pairs(found).checkpoint()
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    counted = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = spread_join(keyed, counted, "key").checkpoint()
    wanted = shared.select("node").unionByName(printed.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    sets = _sets(docs, nodes.select("node", "rep").join(wanted, "node"), id_col, text_col, width).checkpoint()
    # With these, every node of a key and its most central one.
    central = shared.groupBy("node").agg(F.sum(F.log("n")).alias("central"))
    starred = _starred(shared.join(central, "node").withColumn("root", F.col("node")), "central")
    pairs = printed.unionByName(starred).distinct().checkpoint()
    roots = components(_verified(pairs, sets)).checkpoint()

    # Keys whose nodes are still apart.
    members = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).checkpoint()
    open_keys = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    apart = spread_join(members, open_keys, "key").checkpoint()
    small = _paired(apart.where(F.col("n") <= SMALL_BUCKET)).distinct()
    small = small.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti")
    crowded = _block_links(apart.where(F.col("n") > SMALL_BUCKET).drop("n"), sets)
    bridges = _verified(small, sets).unionByName(crowded).checkpoint()
    if bridges.isEmpty():
        return roots

    # Components joined by bridges take the least root; both ends of a bridge become nodes with a root.
    ends = bridges.select(F.col("src").alias("node"), F.col("r1").alias("root")).unionByName(
        bridges.select(F.col("dst").alias("node"), F.col("r2").alias("root"))
    )
    joined = components(bridges, "r1", "r2").select(F.col("node").alias("root"), F.col("root").alias("lower"))
    return roots.unionByName(ends).distinct().join(joined.checkpoint(), "root", "left").select("node", F.coalesce("lower", "root").alias("root"))


def rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(node_id, text_key, root) per row; rows of one component have one root."""
    ensure_checkpoint_dir(docs.sparkSession)
    found = signatures(docs, id_col, text_col, width).checkpoint()
    roots = linked_roots(docs, found, id_col, text_col, width)
    named = found.select("node").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return spread_join(found.select("node_id", "text_key", "node"), named, "node").select("node_id", "text_key", "root")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The documents with exactly one row left of each component: the least id, then the least text."""
    return first_rows(docs, rooted(docs, id_col, text_col, width), id_col, text_col)
