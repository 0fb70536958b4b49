"""Keyed merges, ordered lookups, folds and band joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Strata from the best to the worst.
STRATA = ("A1", "A2", "A3", "A4", "B1", "B2", "B3", "B4", "B5", "C")
QUARTILES = ("Q1", "Q2", "Q3", "Q4")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A full outer merge in which a null never overwrites a value. Columns that only one side has are kept."""
    a = old.select(*[F.col(c).alias(f"_o_{c}") for c in old.columns])
    b = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns])
    joined = a.join(b, F.col(f"_o_{key}") == F.col(f"_n_{key}"), "full_outer")
    names = [*old.columns, *[c for c in new.columns if c not in old.columns]]
    sides = lambda c: [F.col(f"{p}{c}") for p, df in (("_n_", new), ("_o_", old)) if c in df.columns]
    return joined.select(*[F.coalesce(*sides(c)).alias(c) for c in names])


def replace_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, whole; partial aggregation makes it one row a key and task before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in rows.columns])


def first_hit(rows: DataFrame, id_col: str, keys_col: str, dim: DataFrame, dim_key: str, value: str) -> DataFrame:
    """id -> value of the first key of its array that dim holds; ids without a hit are left out."""
    parts = rows.select(id_col, F.posexplode(keys_col).alias("_at", "_key"))
    d = dim.select(F.col(dim_key).alias("_key"), F.col(value).alias("_value"))
    return parts.join(d, "_key").groupBy(id_col).agg(F.min_by("_value", "_at").alias(value))


def latest(dim: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    """All rows of the latest year of each key."""
    top = F.max(year).over(W.partitionBy(*keys))
    return dim.withColumn("_top", top).where(F.col(year) == F.col("_top")).drop("_top")


def stratum_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STRATA]), c)


def fold_strata(rows: DataFrame, key: str, title: str, area: str, stratum: str, order: str) -> DataFrame:
    """One row a key: first title, best stratum, sorted areas; conflicts counts rows whose stratum differs from the best
    one so far (rows after the first)."""
    position = stratum_rank(F.col(stratum))
    before = F.min(position).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumns({"_p": position, "_before": before}).where("_p > 0")
    out = marked.groupBy(key).agg(
        F.min_by(title, order).alias(title),
        F.element_at(F.array(*[F.lit(s) for s in STRATA]), F.min("_p").cast("int")).alias(stratum),
        F.array_sort(F.collect_set(area)).alias("areas"),
        F.count_if(F.col("_before").isNotNull() & (F.col("_before") != F.col("_p"))).alias("conflicts"),
    )
    return out


def band_join(left: DataFrame, right: DataFrame, on: str, wanted: str, value: str, tolerance: float) -> DataFrame:
    """Rows of left beside rows of right with the same key whose value lies within the tolerance of the wanted one
    (relative; 0 matches nothing). Values are cut into logarithmic bands as wide as the tolerance, so that a key with
    very many values on either side is no quadratic group."""
    width = F.log(F.lit(1 + tolerance))

    def band(c: Column) -> Column:
        return F.floor(F.log(F.abs(c)) / width).cast("long")

    l_, r_ = F.col(wanted), F.col(value)
    spread = left.where(l_ != 0).withColumn("_band", F.explode(F.sequence(band(l_) - 2, band(l_) + 2))).withColumn("_sign", F.signum(l_))
    dealt = right.where(r_ != 0).withColumn("_band", band(r_)).withColumn("_sign", F.signum(r_))
    return spread.join(dealt, [on, "_band", "_sign"]).where(F.abs(r_ - l_) / F.abs(l_) <= tolerance).drop("_band", "_sign")


def expired(verified: Column, as_of: Column, days: int) -> Column:
    """Never verified, or over so many days ago."""
    return verified.isNull() | (F.date_diff(as_of, verified) > days)


def stale(facts: DataFrame, hashes: DataFrame) -> DataFrame:
    """facts whose reference has another content hash than the stored one become stale, rejected ones excepted."""
    changed = hashes.where(~F.col("stored").eqNullSafe(F.col("current"))).select("ref_number").distinct().withColumn("_changed", F.lit(True))
    out = facts.join(changed, "ref_number", "left")
    return out.withColumn("status", F.when(F.col("_changed") & (F.col("status") != "rejected"), "stale").otherwise(F.col("status"))).drop("_changed")


def not_in(rows: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return rows.join(base.select(key).distinct(), key, "left_anti")
