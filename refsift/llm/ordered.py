"""Neighbours in a total order, without a task that holds all rows or all rows of a group.

Rows are dealt to ranges of the order by bounds taken from a hash sample of the distinct keys. The first row of each
range is also dealt to the range before it, and the last to the range after it, so a window over one range sees every
neighbour. The bounds only decide where a row is handled; they never change a result.

The bounds are broadcast, so there are MOST_RANGES ranges at most: a table of more than that many times rows_per_range
rows has longer ranges, which a task sorts with spilling and reads in order, holding few rows at a time. The sample that
the bounds come from is put in order by one task; it has about SAMPLE keys a range, and MOST_SAMPLED at most.

Defined cases: rows with equal keys lie in one range, and are neighbours of each other; fields of the key may be null
(they come first); an empty table gives an empty result; further columns are carried through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

#: Sampled keys for each range.
SAMPLE = 24
#: The table of bounds that is broadcast has at most so many entries.
MOST_RANGES = 65536
MOST_SAMPLED = 1 << 19


def _lookup(bounds: Column, step: Column, key: Column) -> Column:
    """How many bounds are at or below the key, by two short scans."""
    firsts = bounds.getField("firsts")
    parts = bounds.getField("parts")
    block = F.size(F.filter(firsts, lambda f: f <= key))
    inside = F.size(F.filter(F.element_at(parts, block), lambda f: f <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)


def dealt(df: DataFrame, key: Column, rows_per_range: int, space: Workspace, *, before: bool, after: bool, wrap: bool) -> tuple[DataFrame, int]:
    """df with _rs_range int and _rs_ghost int, and the number of ranges. _rs_ghost is 0 for the row itself, 1 for a copy
    that follows its range's rows (the first row of the next range), -1 for one that precedes them. key: one orderable
    column, not null itself."""
    thin = df.select(key.alias("k"))
    n = thin.count()
    ranges = min(MOST_RANGES, max(1, -(-n // rows_per_range)))
    share = min(1.0, min(MOST_SAMPLED, SAMPLE * ranges) / max(n, 1))
    picked = thin.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct()
    step = max(1, int(ranges**0.5))
    every = picked.agg(F.sort_array(F.collect_list("k")).alias("s")).select(
        F.expr(f"transform(filter(sequence(1, {ranges}), i -> i < {ranges} and size(s) > 0), i -> s[cast(floor(cast(i as double) * size(s) / {ranges}) as int)])").alias("b")
    )
    blocks = every.select(
        F.lit(1).alias("_rs_one"),
        F.expr(f"transform(filter(sequence(0, size(b)), j -> j % {step} = 0 and j < size(b)), j -> b[j])").alias("firsts"),
        F.expr(f"transform(filter(sequence(0, size(b)), j -> j % {step} = 0 and j < size(b)), j -> slice(b, j + 1, {step}))").alias("parts"),
    )
    bounds = space.cut(blocks.select("_rs_one", F.struct("firsts", "parts").alias("_rs_bounds")), "bounds")
    keyed = df.withColumns({"_rs_key": key, "_rs_one": F.lit(1)})
    ranged = keyed.join(F.broadcast(bounds), "_rs_one").withColumn("_rs_range", _lookup(F.col("_rs_bounds"), F.lit(step), F.col("_rs_key")).cast("int")).drop("_rs_bounds", "_rs_one")
    # one row a range: bounded by MOST_RANGES
    order = W.partitionBy(F.lit(0)).orderBy("_rs_at")
    ends = ranged.groupBy(F.col("_rs_range").alias("_rs_at")).agg(F.min("_rs_key").alias("_rs_low"), F.max("_rs_key").alias("_rs_high"))
    ends = ends.withColumns({"_rs_prev": F.lag("_rs_at").over(order), "_rs_next": F.lead("_rs_at").over(order), "_rs_last": F.max("_rs_at").over(W.partitionBy(F.lit(0)))})
    if wrap:
        ends = ends.withColumn("_rs_prev", F.coalesce("_rs_prev", "_rs_last"))
    ends = F.broadcast(space.cut(ends, "ends"))
    copies = [F.struct(F.col("_rs_range").alias("r"), F.lit(0).alias("g"))]
    if after:
        to_prev = (F.col("_rs_key") == F.col("_rs_low")) & F.col("_rs_prev").isNotNull()
        copies.append(F.when(to_prev, F.struct(F.col("_rs_prev").alias("r"), F.lit(1).alias("g"))))
    if before:
        to_next = (F.col("_rs_key") == F.col("_rs_high")) & F.col("_rs_next").isNotNull()
        copies.append(F.when(to_next, F.struct(F.col("_rs_next").alias("r"), F.lit(-1).alias("g"))))
    joined = ranged.join(ends, F.col("_rs_range") == F.col("_rs_at"))
    spread = joined.withColumn("_rs_to", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
    spread = spread.withColumns({"_rs_range": F.col("_rs_to.r"), "_rs_ghost": F.col("_rs_to.g")})
    return spread.drop("_rs_to", "_rs_at", "_rs_low", "_rs_high", "_rs_prev", "_rs_next", "_rs_last"), ranges


def within(*tie: str) -> W:
    """The window of a range: its rows in order, with the copies at both ends."""
    return W.partitionBy("_rs_range").orderBy("_rs_ghost", "_rs_key", *tie)
