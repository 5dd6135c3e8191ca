"""Longest-match alignment of two word sequences of any length, with no sequence in one row.

The alignment of a region takes its longest block of equal words (the first one in the first reading, then in the second),
and goes on with the regions before and behind it. Regions of more than ``leaf`` words are split so, all at once in rounds of joins
on hashes of word groups; a region of at most ``leaf`` words is one row and is aligned in one call. Which regions are split
changes no block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import settle

REGION = ["alo", "blo"]


def _powers(words: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Adds ``h``: hashes of the groups of 1, 2, 4, ... words from each position on, as long as both readings share one."""
    now, t = settle(words.withColumn("h", F.array(F.xxhash64("norm"))).drop("norm")), 0
    while True:
        half = F.get("h", F.lit(t))
        ahead = now.select(*keys, "side", (F.col("pos") - (1 << t)).alias("pos"), half.alias("_next"))
        both = F.when(half.isNotNull() & F.col("_next").isNotNull(), F.xxhash64(half, "_next"))
        now, t = settle(now.join(ahead, [*keys, "side", "pos"], "left").withColumn("h", F.concat("h", F.array(both))).drop("_next")), t + 1
        if _shared(now.withColumn("c", F.get("h", F.lit(t))).where(F.col("c").isNotNull()), keys).isEmpty():
            return now, t - 1


def _shared(places: DataFrame, groups: list[str]) -> DataFrame:
    """Values of ``c`` that both readings have."""
    return places.groupBy(*groups, "c").agg(F.min("side").alias("_l"), F.max("side").alias("_r")).where("_l < _r").drop("_l", "_r")


def _longest(placed: DataFrame, powers: DataFrame, open_: DataFrame, keys: list[str], top: int) -> DataFrame:
    """``i, j, n`` of the first longest common block of each open region that has one.

    The length is built from its highest binary digit down; after each digit only places of common groups stay.
    """
    region = [*keys, *REGION]
    high = F.when(F.col("side") == 0, F.col("ahi")).otherwise(F.col("bhi"))
    zero = F.lit(0).cast("long")
    places = placed.join(open_, region).select(*region, "side", "pos", high.alias("_hi"), zero.alias("c"), zero.alias("n"))
    for t in range(top, -1, -1):
        here = powers.select(*keys, "side", F.col("pos").alias("_at"), F.get("h", F.lit(t)).alias("_g"))
        fits = places.where(F.col("pos") + F.col("n") + (1 << t) <= F.col("_hi")).withColumn("_at", F.col("pos") + F.col("n"))
        more = settle(fits.join(here, [*keys, "side", "_at"]).where(F.col("_g").isNotNull()).select(
            *region, "side", "pos", "_hi", F.xxhash64("c", "_g").alias("c"), (F.col("n") + (1 << t)).alias("n")))
        common = _shared(more, region)
        places = more.join(common, [*region, "c"], "left_semi").unionByName(places.join(common.select(*region).distinct(), region, "left_anti"))
    places = settle(places.where("n > 0"))
    first = places.where("side = 0").groupBy(*region).agg(F.min(F.struct("pos", "c", "n")).alias("_f")).select(*region, "_f.*")
    second = places.where("side = 1").select(*region, "c", F.col("pos").alias("j"))
    return first.withColumnRenamed("pos", "i").join(second, [*region, "c"]).groupBy(*region, "i", "n").agg(F.min("j").alias("j"))


def split_regions(a: DataFrame, b: DataFrame, keys: list[str], leaf: int) -> tuple[DataFrame, DataFrame]:
    """Regions and blocks of sequences ``a, b (keys, pos, norm)`` whose positions count from 0.

    ``regions``: ``alo, ahi, blo, bhi, matched`` cover what lies between the blocks ``i, j, n``. A region with ``matched`` true has
    at most ``leaf`` words a reading, or none in the first one, and is still to be aligned; the others have no word in common.
    """
    both = a.select(*keys, F.lit(0).alias("side"), "pos", "norm").unionByName(b.select(*keys, F.lit(1).alias("side"), "pos", "norm"))
    size = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("pos") + 1)), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    whole = settle(both.groupBy(*keys).agg(size(0).alias("ahi"), size(1).alias("bhi")).withColumn("alo", zero).withColumn("blo", zero))
    na, nb = F.col("ahi") - F.col("alo"), F.col("bhi") - F.col("blo")
    small = ((na <= leaf) & (nb <= leaf)) | (na == 0)
    final, regions = whole.where(small).withColumn("matched", F.lit(True)), whole.where(~small)
    blocks = whole.limit(0).select(*keys, *REGION, zero.alias("i"), zero.alias("j"), zero.alias("n"))
    if regions.isEmpty():
        return final, blocks
    powers, top = _powers(both.join(regions.select(*keys), keys, "left_semi"), keys)
    placed = powers.select(*keys, "side", "pos", *[zero.alias(c) for c in REGION])
    while not regions.isEmpty():
        found = _longest(placed, powers, regions, keys, top)
        parts = settle(regions.join(found, [*keys, *REGION], "left"))
        final = final.unionByName(parts.where("n IS NULL").drop("i", "j", "n").withColumn("matched", F.lit(False)))
        cut = parts.where("n IS NOT NULL")
        blocks = blocks.unionByName(cut.select(*blocks.columns))
        end = [F.col("i") + F.col("n"), F.col("j") + F.col("n")]
        every = cut.select(*keys, "alo", F.col("i").alias("ahi"), "blo", F.col("j").alias("bhi")).unionByName(
            cut.select(*keys, end[0].alias("alo"), "ahi", end[1].alias("blo"), "bhi"))
        final = final.unionByName(every.where(small).withColumn("matched", F.lit(True)))
        regions = every.where(~small)
        at, behind = (F.when(F.col("side") == 0, x).otherwise(y) for x, y in ((F.col("i"), F.col("j")), end))
        joined = placed.join(cut.select(*keys, *REGION, "i", "j", "n"), [*keys, *REGION]).withColumn("_behind", F.col("pos") >= behind)
        moved = joined.where((F.col("pos") < at) | F.col("_behind")).select(
            *keys, "side", "pos", *[F.when(F.col("_behind"), e).otherwise(F.col(c)).alias(c) for c, e in zip(REGION, end)])
        placed = settle(moved.join(regions.select(*keys, *REGION), [*keys, *REGION], "left_semi"))
    return settle(final), settle(blocks)


def in_regions(rows: DataFrame, regions: DataFrame, keys: list[str], low: str, high: str, width: int = 4096) -> DataFrame:
    """Rows with the region that holds their position, or the position just before it."""
    spread = regions.withColumn("_b", F.explode(F.sequence(F.floor((F.col(low) - 1) / width), F.floor(F.col(high) / width))))
    r = spread.select(*keys, *REGION, F.col(low).alias("_low"), F.col(high).alias("_high"), "_b")
    held = (F.col("pos") >= F.col("_low") - 1) & (F.col("pos") < F.col("_high"))
    return rows.withColumn("_b", F.floor(F.col("pos") / width)).join(r, [*keys, "_b"]).where(held).withColumn(
        "before", F.col("pos") < F.col("_low")).drop("_b", "_low", "_high")


def block_words(rows: DataFrame, blocks: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Rows of the first reading inside of a block, but its last one."""
    b = blocks.select(*keys, F.col("i").alias("_i"), (F.col("i") + F.col("n") - 1).alias("_last"))
    b = b.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_i") / width), F.floor(F.col("_last") / width))))
    held: Column = (F.col("pos") >= F.col("_i")) & (F.col("pos") < F.col("_last"))
    return rows.withColumn("_b", F.floor(F.col("pos") / width)).join(b, [*keys, "_b"]).where(held).drop("_b", "_i", "_last")
