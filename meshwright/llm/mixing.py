"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

The words of all documents, cut into equal blocks, are seats; sources are
parties. Seats go to the highest quotients target / (2k + 1); each source's
seats go in the same way to its groups of shards, and on from group to group
down to shards, by their sizes. In a shard the documents stand in a seeded
order, a line of words that is cut into blocks. All blocks are taken as often
as the quota holds them all; what is left of it are blocks drawn by a seeded
permutation.

Only DataFrame operations are used. All that is gathered in one place is a row
per source, and a row for each of at most FANOUT parts of a group; documents
are only shuffled by (source, shard).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meshwright.llm.storage import cut, numbered

#: Parts of a group of shards.
FANOUT = 256
#: Primes above any number of blocks in a shard; the multiplier of a shard's permutation is one of them.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579, 2_147_483_563)
WORD = "[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]++"


def n_words(text: str) -> Column:
    """Words of a text column; 0 for null."""
    return F.expr(f"coalesce(regexp_count({text}, '{WORD}'), 0)").cast("bigint")


def water_fill(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds target: shares of the sum of `size` by weight, none above `most` times its own size.

    The sources are few (one row each). In order of size per weight, those
    below the common level are full; the level is what is left for the others
    per weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", w).withColumn("cap", F.col("size") * most)
    by_room = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = ranked.withColumn("total", F.sum("size").over(W.partitionBy())).withColumn("full_before", F.coalesce(F.sum("cap").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    full = full.withColumn("weight_left", F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing)))
    full = full.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_left"))
    # the level rises as long as the source at hand is full below it, and falls after that
    level = F.max("level").over(W.partitionBy())
    return full.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("cap", "full_before", "weight_left", "level")


def apportion(parties: DataFrame, seats: Column, votes: str, among: list[str], order: list[Column]) -> DataFrame:
    """Adds quota: within each group of `among`, `seats` seats by highest quotients votes / (2k + 1); ties go by `order`.

    Seats that a party gets under any divisor near the answer are given at
    once; only the few quotients in doubt are listed and ranked.
    """
    group = W.partitionBy(*among)
    known = parties.withColumn("__seats", seats).withColumn("__parties", F.count("*").over(group)).withColumn("__fair", F.try_divide(F.col("__seats") * F.col(votes), F.sum(votes).over(group)))
    known = known.withColumn("__fair", F.coalesce("__fair", F.lit(0.0)))
    half = F.col("__parties") / (F.lit(2.0) * F.greatest(F.col("__seats"), F.lit(1)))
    low = F.greatest(F.lit(0), F.floor(F.col("__fair") * (1 - half) + 0.5 - 1e-6))
    high = F.when(F.col("__fair") > 0, F.floor(F.col("__fair") * (1 + half) + 0.5 + 1e-6)).otherwise(0)
    known = known.withColumn("__low", low.cast("bigint")).withColumn("__high", high.cast("bigint"))
    doubt = known.withColumn("__left", F.col("__seats") - F.sum("__low").over(group)).withColumn("__k", F.explode(F.expr("if(__high > __low, sequence(__low, __high - 1), array(cast(null as bigint)))")))
    rank = F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("__k") + 1)).desc_nulls_last(), *order, "__k"))
    won = doubt.withColumn("__won", (F.col("__k").isNotNull() & (rank <= F.col("__left"))).cast("bigint"))
    keys = parties.columns
    return won.groupBy(*keys).agg((F.first("__low") + F.sum("__won")).alias("quota"))


def _quotas(cells: DataFrame, plan: DataFrame, depth: int) -> DataFrame:
    """Adds quota to (source, shard, cell_size): each source's seats, handed down from groups of shards to shards in `depth` steps."""
    above = plan.select("s", F.lit(0).cast("bigint").alias("k"), F.col("source_quota").alias("seats"))
    for level in reversed(range(depth)):
        size = F.lit(FANOUT**level)
        parts = cells.groupBy("source", F.floor(F.col("shard") / size).alias("part")).agg(F.sum("cell_size").alias("part_size"))
        parts = parts.withColumn("group", F.floor(F.col("part") / FANOUT) if level < depth - 1 else F.lit(0).cast("bigint"))
        parts = parts.join(above, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("k"))).drop("s", "k")
        given = apportion(parts, F.col("seats"), "part_size", ["source", "group"], [F.col("part")])
        above = given.select(F.col("source").alias("s"), F.col("part").alias("k"), F.col("quota").alias("seats"))
    return cells.join(above, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k"))).drop("s", "k").withColumnRenamed("seats", "quota")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_rows: int = 512, most_block: int = 64, row_col: str | None = None, scatter: bool = True) -> DataFrame:
    """One row per row of `docs`: row (row_col, else null), id, source, size, source_size, target, taken.

    Weights go to the sources by code point, null last, over and over. A
    source's target is its share of all words, at most `most` times what it
    has; the excess goes to the others. taken counts words with repeats, and
    is at most `most` times a document's size. Null, empty and wordless texts
    have size 0 and nothing is taken of them; a source of only such has target
    0. Ids may be null or repeated. Draws depend on what is in a row, never on
    its place, so reruns agree; rows that are alike in all columns are one as
    good as the other. An empty table gives an empty table.

    Without `scatter`, a shard's blocks are those at the front of its line, so
    that at most one document of a shard is taken in part.
    """
    content = [f.name for f in docs.schema if f.name != row_col and "map" not in f.dataType.simpleString()]
    columns = [F.col(row_col) if row_col else F.lit(None).cast("bigint"), F.col(id_col), F.col(source_col), n_words(f"`{text_col}`"), F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in content))]
    sized = cut(docs.select(*(c.alias(n) for c, n in zip(columns, ("row", "id", "source", "size", "draw"), strict=True))))
    sources = water_fill(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), weights, most)
    block = F.least(F.lit(most_block), F.greatest(F.lit(1), F.floor(F.col("total") / 65_536))).cast("bigint")
    sources = sources.withColumn("block", block).withColumn("seats", F.round(F.col("total") / F.col("block")).cast("bigint")).withColumn("shards", F.ceil(F.col("rows") / shard_rows).cast("bigint"))
    sources = cut(apportion(sources, F.col("seats"), "target", ["total"], [F.col("source").asc_nulls_last()]).withColumnRenamed("size", "source_size").withColumnRenamed("quota", "source_quota"))
    plan = sources.select(F.col("source").alias("s"), "source_size", "target", "block", "shards", "source_quota")
    widest, depth = sources.agg(F.max("shards")).first()[0] or 1, 1
    while FANOUT**depth < widest:
        depth += 1
    placed = sized.join(plan.select("s", "shards"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("shard", F.pmod("draw", F.col("shards")))
    placed = cut(placed.select("row", "id", "source", "size", "draw", "shard"))
    cells = cut(placed.groupBy("source", "shard").agg(F.sum("size").alias("cell_size")))
    quotas = _quotas(cells, plan, depth).join(plan.select("s", "source_size", "target", "block"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    quotas = quotas.select(F.col("source").alias("s"), F.col("shard").alias("k"), "cell_size", "source_size", "target", "block", F.least(F.col("quota") * F.col("block"), F.col("cell_size") * most).alias("take"))
    quotas = quotas.selectExpr("*", "if(cell_size > 0, take div cell_size, 0) as rounds", "if(cell_size > 0, take % cell_size, 0) as rest", "greatest(1, cell_size div block) as blocks")
    drawn = F.xxhash64(F.lit(seed), "s", "k")
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(drawn, F.lit(len(PRIMES))) + 1).cast("int"))
    quotas = quotas.withColumn("by", prime if scatter else F.lit(1)).withColumn("shift", F.pmod(F.shiftright(drawn, 8), F.col("blocks")) if scatter else F.lit(0))
    line = W.partitionBy("source", "shard").orderBy("draw", "size", "id", "row").rowsBetween(W.unboundedPreceding, -1)
    rows = placed.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0))).join(quotas, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("k")))
    # block j stands at (j * by + shift) % blocks of the drawn order: those before place rest div block are taken whole, the next one's first words are the remainder
    place = "(if(j < blocks, (j * by + shift) % blocks, blocks))"
    words = f"if({place} < rest div block, block, if({place} = rest div block, rest % block, 0))"
    of_block = f"greatest(0, least(before + size, j * block + {words}) - greatest(before, j * block))"
    part = f"if(size > 0 and rest > 0, aggregate(sequence(before div block, (before + size - 1) div block), 0L, (sum, j) -> sum + {of_block}), 0L)"
    return rows.selectExpr("row", "id", "source", "size", "source_size", "cast(target as double) as target", f"cast(rounds * size + {part} as bigint) as taken")


def repeat_rows(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """`docs` as the mix takes them, each row as often as it is taken whole; all columns stay.

    No text is cut: a part of half a text or more becomes a whole copy, a
    smaller one none. A shard has one part at most, so its words are off by no
    more than half a document. Rows of which nothing is taken go. An empty
    table gives an empty table.
    """
    columns, docs = docs.columns, numbered(docs)
    mixed = mix(docs, text_col=text_col, row_col="__row", scatter=False, **options).select(F.col("row").alias("__row"), "size", "taken")
    copies = mixed.selectExpr("__row", "if(size > 0, (2 * taken + size) div (2 * size), 0) as __copies").where("__copies > 0")
    return docs.join(copies, "__row").withColumn("__copy", F.explode(F.expr("sequence(1, __copies)"))).select(*columns)
