"""Sharding by a hierarchical weighted hash tree.

A tree of regions, racks and shards is descended by weighted hash draws: at
each level every child draws an exponential variate from the hash of the key
and its own name, divided by its weight, and the least draw wins. A child's
draw depends on no other child, so if a weight changes, keys only move into or
out of the subtrees whose weights change.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwright.llm.storage import cut

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
#: Slots are numbered within this many parts of each shard at a time.
PARTS = 256


def layout(n_shards: int, base: int = 24, per_rack: int = 4, racks: int = 2) -> Tree:
    """A tree of equal shards: the first `base` in full racks and regions, each later one in a region of its own.

    So a shard that is added changes no weight of the subtrees that were there:
    the keys that move all move into it.
    """
    tree: Tree = {}
    for s in range(n_shards):
        rack = f"rack{s // per_rack}" if s < base else f"rack-of-{s}"
        region = f"region{s // per_rack // racks}" if s < base else f"region-of-{s}"
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _drawn(key: Column, children: Column, seed: int) -> Column:
    """The node of the child (name, weight, node) with the least draw."""

    def exponential(child: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), child["name"], key), 11).cast("double") + 0.5) / 2.0**53
        return F.struct((-F.log(uniform) / child["weight"]).alias("draw"), child["node"].alias("node"))

    return F.array_min(F.transform(children, exponential))["node"]


def _children(some: list[tuple[str, float, int]]) -> Column:
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(node).alias("node")) for name, weight, node in some))


def assign(key: Column, tree: Tree, seed: int = 7) -> Column:
    """The shard of a key: its region is drawn, then a rack among that region's, then a shard among that rack's.

    Only the children of the node at hand are drawn. Equal keys, null ones too,
    get equal shards. Subtrees without weight get none; a tree without weight
    gives null.
    """
    regions: list[tuple[str, float, int]] = []
    racks: list[list[tuple[str, float, int]]] = []  # of each region
    shards: list[list[tuple[str, float, int]]] = []  # of each rack
    for region, inside in tree.items():
        own = []
        for rack, leaves in inside.items():
            some = [(f"{region}/{rack}/{s}", w, s) for s, w in leaves.items() if w > 0]
            if some:
                own.append((f"{region}/{rack}", sum(w for _, w, _ in some), len(shards)))
                shards.append(some)
        if own:
            regions.append((region, sum(w for _, w, _ in own), len(racks)))
            racks.append(own)
    if not regions:
        return F.lit(None).cast("int")
    region = _drawn(key, _children(regions), seed)
    rack = _drawn(key, F.element_at(F.array(*map(_children, racks)), region + 1), seed)
    return _drawn(key, F.element_at(F.array(*map(_children, shards)), rack + 1), seed).cast("int")


def numbered(rows: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 within each shard, in an order of all columns' hash; equal rows are counted, not gathered.

    Each shard is numbered in PARTS parts at a time by a hash, with the sums of
    the parts before as offsets, so that no task holds a whole shard.
    """
    names = rows.columns
    counted = cut(rows.groupBy(*names).agg(F.count("*").alias("__n")).withColumn("__h", F.xxhash64(*names)).withColumn("__part", F.pmod("__h", F.lit(PARTS))))
    parts = counted.groupBy(shard, "__part").agg(F.sum("__n").alias("__size"))
    before = W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(F.col(shard).alias("__s"), F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    within = W.partitionBy(shard, "__part").orderBy("__h", *names).rowsBetween(W.unboundedPreceding, -1)
    placed = counted.withColumn("__before", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(offsets, (F.col(shard) == F.col("__s")) & (F.col("__part") == F.col("__p")))
    lots = placed.withColumn("__lot", F.explode(F.expr("sequence(0L, (__n - 1) div 65536)")))
    each = lots.withColumn("__i", F.explode(F.expr("sequence(__lot * 65536, least(__n, (__lot + 1) * 65536) - 1)")))
    return each.select(*names, (F.col("__offset") + F.col("__before") + F.col("__i")).alias(slot))


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """One row per row of `docs`: id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, grown_shard and slot.

    The id alone decides on the shard; null ids are a key like any other. A
    null text has no bytes: size 8, text_crc32 0. Repeated rows each get a slot
    of their own. An empty table gives an empty table.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
        assign(F.col(id_col), tree, seed).alias("shard"),
        (assign(F.col(id_col), grown, seed) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return numbered(rows)
