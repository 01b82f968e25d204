"""Mix sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame functions only.

Documents are dealt to blocks of their source by a hash, so the blocks are a random permutation of the
source. A source's quota is a number of block draws: as many whole passes as its target holds, and a
part of one more. The quotas of all sources form the root of a binary tree over the output shards.
Each node passes to its left half a multivariate-hypergeometric share of every quota, as if the
node's draws had been shuffled and cut; the rest goes right. A leaf takes the next blocks of each
source's permutation, disjoint from all other leaves, and its rows are put in hash order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK_ROWS = 2048
MAX_BROADCAST_SOURCES = 10_000


def _unit(*parts) -> Column:
    """52 pseudo-random bits of the parts, the same in every run and engine that has MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per source: number, words, rows, target words, block count and whole passes.

    Targets are ``share`` of all words by weight; what lies above ``most`` times a source's words is
    shared again by weight, which ends where every target is the smaller of its cap and weight x level.
    Sums are whole numbers, so that the result does not depend on their order.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    numer, denom = share
    s = (stats.withColumn("source_no", number).withColumn("weight", weight)
         .withColumn("_all", F.sum("source_size").over(everything) * numer).withColumn("_w", F.sum("weight").over(everything))
         .withColumn("_full", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         .withColumn("_wfull", F.coalesce(F.sum("weight").over(before), F.lit(0)))
         # The level if exactly the sources before this one are at their cap, times denom * _left.
         .withColumn("_num", F.col("_all") - denom * most * F.col("_full")).withColumn("_left", F.col("_w") - F.col("_wfull"))
         .withColumn("_above", F.col("weight") * F.col("_num") >= denom * most * F.col("source_size") * F.col("_left")))
    # _left falls along the order: the first source below its cap has the largest _left.
    level = F.max(F.when(~F.col("_above"), F.struct("_left", "_num"))).over(everything)
    s = s.withColumn("_level", level)
    target = F.when(F.col("_above") | F.col("_level").isNull(), (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.col("_level._num")).cast("double") / (denom * F.col("_level._left")).cast("double"))
    s = s.withColumn("target", target)
    passes = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    return (s.withColumn("passes", passes).withColumn("part", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
            .withColumn("n_blocks", F.ceil(F.col("n_rows") / block_rows).cast("long"))
            .select("source", "source_no", "source_size", "n_rows", "target", "passes", "part", "n_blocks"))


def _dealer(seed: int, depth: int):
    """Deals a source's blocks of one node: each goes left with probability (room left) / (blocks not yet dealt)."""

    def deal(state, x):
        def one(s, i):
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), F.col("node"), x.no, i), F.lit(1 << 52)).cast("double") / float(1 << 52)
            go = (u * s.rest < s.room).cast("long")
            return F.struct((s.rest - 1).alias("rest"), (s.room - go).alias("room"), (s.left + go).alias("left"))

        none = F.struct(state.rest.alias("rest"), state.room.alias("room"), F.lit(0).cast("long").alias("left"))
        drawn = F.when(x.q > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(x.q, F.lit(1).cast("long"))), none, one)).otherwise(none)
        return F.struct(drawn.rest.alias("rest"), drawn.room.alias("room"),
                        F.concat(state.out, F.array(F.struct(x.no.alias("no"), drawn.left.alias("q")))).alias("out"))

    return deal


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(leaf, source_no, quota) of ``quotas(source_no, quota)`` split ``levels`` times.

    Each level is one expression over a node's array of quotas. A block of a source goes left with
    probability (places left in the left half) / (blocks not yet dealt), which draws the
    multivariate-hypergeometric law exactly, block by block.
    """
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source_no").cast("long").alias("no"), F.col("quota").cast("long").alias("q")))).alias("qs"))
    nodes = nodes.select(F.lit(0).cast("long").alias("node"), F.coalesce("qs", F.array().cast("array<struct<no:bigint,q:bigint>>")).alias("qs"))
    for depth in range(levels):
        total = F.aggregate("qs", F.lit(0).cast("long"), lambda a, x: a + x.q)
        nodes = nodes.withColumn("_total", total).withColumn("_half", F.expr("_total div 2"))

        start = F.struct(F.col("_total").alias("rest"), F.col("_half").alias("room"), F.array().cast("array<struct<no:bigint,q:bigint>>").alias("out"))
        left = F.aggregate("qs", start, _dealer(seed, depth), lambda s: s.out)
        nodes = nodes.withColumn("_lefts", left).withColumn("_right", F.zip_with("qs", "_lefts", lambda a, b: F.struct(a.no.alias("no"), (a.q - b.q).alias("q"))))
        nodes = nodes.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("_lefts").alias("qs")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.col("_right").alias("qs")))).alias("n")).select("n.node", "n.qs")
    return nodes.select(F.col("node").cast("int").alias("leaf"), F.explode("qs").alias("x")).select("leaf", F.col("x.no").alias("source_no"), F.col("x.q").alias("quota"))


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, levels: int = 4,
        block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: ``row`` (all its columns), size, source_size, target, taken and ``shards``.

    ``shards`` lists the output shard of every copy that is taken; ``taken`` is size x copies. Whole
    documents are taken, so a source misses its target by half a document at most, and a document
    is never taken more than ``most`` times. A null or empty text has size 0 and is taken as its place
    in the permutation says, which adds no words. Null sources are one source, the last. Rows
    that repeat an id follow each other by size. An empty table gives an empty result.
    """
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    keys = sized.select("id", "source", "size")
    sources = source_targets(keys, weights, share, most, block_rows)
    few = sources.count() <= MAX_BROADCAST_SOURCES
    sources = F.broadcast(sources) if few else sources
    u = _unit(seed, F.col("id"))
    # 32 of the bits choose the block, so the product stays within 64 bits.
    block = F.expr("((u div 1048576) * n_blocks) div 4294967296")

    def placed(rows: DataFrame) -> DataFrame:
        named = sources.withColumnRenamed("source", "_source")
        return rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("u", u).withColumn("block", block)

    blocks = placed(keys).groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.first("part").alias("part"), F.first("passes").alias("passes"))
    in_order = Window.partitionBy("source_no").orderBy("block")
    blocks = (blocks.withColumn("before", F.coalesce(F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("rank", F.row_number().over(in_order) - 1)
              .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source_no"))))
    # Block draws: `passes` times all blocks, then those that begin before the rest of the target is reached.
    begins = F.col("before") < F.col("part")
    copies = F.col("passes") + begins.cast("long")
    blocks = blocks.withColumn("draws", F.transform(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), F.greatest(copies - 1, F.lit(0).cast("long")))).otherwise(
        F.array().cast("array<bigint>")), lambda e: e * F.col("n") + F.col("rank")))
    quotas = blocks.groupBy("source_no").agg(F.sum(copies).alias("quota"))
    tree = splitting_tree(quotas, levels, seed)
    upto = Window.partitionBy("source_no").orderBy("leaf")
    ranges = tree.withColumn("_to", F.sum("quota").over(upto)).where("quota > 0")
    # A source's draws are numbered along its permutation; each leaf holds a range of them.
    leaves = ranges.groupBy("source_no").agg(F.sort_array(F.collect_list(F.struct(F.col("_to").alias("to"), F.col("leaf").alias("leaf")))).alias("leaves"))
    shard_of = lambda d: F.element_at(F.filter("leaves", lambda x: x.to > d), 1).leaf
    blocks = (blocks.join(leaves, "source_no", "left").withColumn("shards", F.coalesce(F.transform("draws", shard_of), F.array().cast("array<int>")))
              .select("source_no", "block", "before", "shards", "passes"))
    rows = placed(sized).drop("passes").join(blocks, ["source_no", "block"])
    inside = Window.partitionBy("source_no", "block").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # Of the block in which the target ends, a document is taken when at least half of it lies before the end.
    taken = F.col("passes") + (2 * at + F.col("size") <= 2 * F.col("part")).cast("long")
    return (rows.withColumn("_copies", F.least(taken, F.size("shards").cast("long")))
            .withColumn("shards", F.slice("shards", F.lit(1), F.col("_copies").cast("int")))
            .select("row", "size", "source_size", "target", (F.col("size") * F.col("_copies")).alias("taken"), "shards", "u"))


def mixed_rows(mixture: DataFrame, seed: int = 7, shards: int | None = None) -> DataFrame:
    """One row per taken copy: ``row`` (the document's columns), ``shard`` and ``place``; each shard in hash order.

    Rows of a shard are dealt over as many tasks as the hash gives and ordered by ``place`` in each.
    """
    copies = mixture.select("row", "u", F.posexplode("shards").alias("copy", "shard"))
    placed = copies.select("row", "shard", F.xxhash64(F.lit(seed), "u", "shard", "copy").alias("place"))
    n = shards or int(mixture.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "shard", "place").sortWithinPartitions("shard", "place")
