"""Connected components of a distributed edge table by alternating large and small stars.

Each round is two group-minimum joins; the edges shrink to one star per component.  Rounds are cut with
``checkpoint()`` in the shared checkpoint folder, so a lost executor costs one round at most.  A star's
centre may own most edges, so its rows must not meet in one task: see ``spread_join``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentflow.llm.columns import column
from segmentflow.session import ensure_checkpoint_dir

#: Rows of a broadcast table of bit masks; a power of two.
MOST_SLOTS = 1 << 20


def spread_join(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows with the columns of values, which holds one row per key; a key may hold most rows.

    values are grouped results.  They are written first, as adaptive execution splits a crowded key's rows
    over tasks only where both sides of a join are plain exchanges, without an aggregation in between.
    """
    return rows.join(values.checkpoint(), key)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return spread_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _single(edges: DataFrame) -> bool:
    """Whether each node has an edge to one smaller node only."""
    return not edges.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n") > 1).first()[0]


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node with an edge to another one; root is the component's smallest node."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    now = now.checkpoint()
    seen = _signature(now)
    while seen[0]:
        stars = _large_star(now).checkpoint()
        before, seen = seen, _signature(stars)
        if before == seen and _single(stars):  # nothing moved, and small stars would not change them either
            break
        now = _small_star(stars).checkpoint()
        seen = _signature(now)
    return (
        now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    )


def named_by_first(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """nodes (node, first_id, ...) with component_id, the least first_id of the node's component.

    A component without any id has a null name.
    """
    rooted = nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return spread_join(rooted, firsts, "root").drop("root", "first_id")


def sieved(rows: DataFrame, hashed: Column, wanted: DataFrame, name: str) -> DataFrame:
    """rows with the boolean ``name``: true for every hash among wanted (hash), and for few others.

    The hashes become a table of bit masks that is broadcast: ``MOST_SLOTS`` rows of two numbers at most,
    whatever the number of hashes, so rows that cannot match stay where they are.  With more hashes than bits,
    more rows pass; none that should is lost.
    """
    n = wanted.count()
    slots = 1 << min(MOST_SLOTS.bit_length() - 1, max(10, (16 * n // 63).bit_length()))
    slot = lambda h: F.pmod(h, F.lit(slots)).alias("sieve_slot")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(63)).cast("int"))
    masks = wanted.select(slot(F.col("hash")), bit(F.col("hash")).alias("bit")).groupBy("sieve_slot").agg(F.bit_or("bit").alias("sieve_mask"))
    joined = rows.withColumn("sieve_hash", hashed).withColumn("sieve_slot", slot(F.col("sieve_hash"))).join(F.broadcast(masks), "sieve_slot", "left")
    hit = F.coalesce(F.col("sieve_mask").bitwiseAND(bit(F.col("sieve_hash"))) != 0, F.lit(False))
    return joined.withColumn(name, hit).drop("sieve_slot", "sieve_mask", "sieve_hash")


def first_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs per root of found (node_id, text_key, root): the least id, then the least text.

    Rows without an id come last.  Rows alone under their root stay where they are; only the others meet their
    group, and only rows that tie by id are grouped with their texts.  Columns of docs travel as one struct, so
    their names cannot clash with those used here.
    """
    sizes = found.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    pairs = spread_join(found, sizes.select("root"), "root").groupBy("root", "node_id", "text_key").agg(F.count("*").alias("rows")).checkpoint()
    least = pairs.groupBy("root").agg(F.min("node_id").alias("least_id"))
    pairs = spread_join(pairs, least, "root").withColumn("keeps", F.col("node_id").eqNullSafe(F.col("least_id")))
    ties = pairs.where("keeps").groupBy("root").agg(F.sum("rows").alias("n_root"))
    pairs = spread_join(pairs, ties, "root").select("root", "node_id", F.col("text_key").alias("pair_key"), "keeps", "n_root").checkpoint()
    text = column(text_col)
    keyed = docs.select(
        F.struct(*map(column, docs.columns)).alias("doc"), column(id_col).alias("own_id"),
        F.xxhash64(text.cast("string")).alias("text_key"), text.alias("text"),
    )
    wanted = pairs.select(F.xxhash64("node_id", "pair_key").alias("hash"))
    marked = sieved(keyed, F.xxhash64("own_id", "text_key"), wanted, "grouped")
    same = F.col("own_id").eqNullSafe(F.col("node_id")) & (F.col("text_key") == F.col("pair_key"))
    met = marked.where("grouped").join(pairs, same, "left").where("keeps or keeps is null")
    several = met.where("n_root > 1").groupBy("root").agg(
        F.min_by("doc", F.struct(F.col("text").isNotNull(), F.col("text"))).alias("doc")
    )
    alone = [marked.where("not grouped"), met.where("n_root is null or n_root = 1"), several]
    return reduce(DataFrame.unionByName, [rows.select("doc.*") for rows in alone])
