"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Rows are equal when their texts are identical after deleting spaces, tabs, line feeds, vertical tabs, form feeds and
carriage returns; a null text counts as empty. The row whose original text has the most code points stays, then the
one with the smallest doc_id.

1. One pass over the texts leaves a thin table (id, SHA-256 of the normalised text, code points).
2. Frequent digests are found by the frequent-items sketch behind approx_top_k, a Misra-Gries summary that lowers its
   counters in batches; it merges across tasks and never holds more than TRACKED counters.
3. The candidates are verified: exact counts and winners by a partial aggregation that shuffles one row a task and
   digest. At most HEAVY rows come out, so the winners are broadcast and heavy rows never shuffle.
4. The remaining digests are shuffled once.

Defined cases: null and empty texts are one group (the empty normalised text); ids may be of any ordered type; rows that
share a doc_id are separate rows of `resolve`, kept when their id is the keep_id of their digest; `deduplicate` leaves one
row of each group, also where rows share id and text (the one whose columns have the smallest hash); a null doc_id loses
ties; an empty table gives an empty result; further columns are ignored by `resolve` and carried through by
`deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, once

#: Counters of the summary: any digest with over 1 / (0.75 * TRACKED) of the rows is sure to be among them.
TRACKED = 4096
#: Digests that may be broadcast at most.
HEAVY = 256

BLANKS = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, points: what the rest of the operator needs of a row."""
    return docs.select(
        F.col("doc_id"),
        F.sha2(normalised(F.col("text")), 256).alias("text_sha256"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("points"),
    )


def _order() -> Column:
    """The smallest stays: most code points, then a known id, then the smallest one, of whatever type ids are."""
    return F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"))


def _winner() -> list[Column]:
    return [F.min(_order()).getField("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]


def resolve(docs: DataFrame, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    space = Workspace(docs.sparkSession, "exact")
    thin = space.cut(digests(docs), "digests")
    found = thin.select(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top"))
    candidates = found.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("text_sha256"))
    # at most `heavy` rows, by construction
    frequent = space.cut(
        thin.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(*_winner()),
        "frequent",
    )
    hot = thin.join(F.broadcast(frequent), "text_sha256")
    rest = thin.join(F.broadcast(frequent.select("text_sha256")), "text_sha256", "left_anti")
    group = W.partitionBy("text_sha256")
    best = F.min(_order()).over(group)
    cold = rest.select(
        "doc_id",
        "text_sha256",
        best.getField("doc_id").alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    both = hot.select("doc_id", "text_sha256", "keep_id", "group_size").unionByName(cold)
    return both.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group."""
    space = Workspace(docs.sparkSession, "exact-keep")
    told = space.cut(resolve(docs).select(F.col("doc_id").alias("_rs_id"), "kept", F.col("text_sha256").alias("_rs_same")), "told")
    by_id = told.groupBy("_rs_id").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    by_id = space.cut(by_id, "ids")
    gone = by_id.where("not kept").select(F.col("_rs_id").alias("_rs_gone"))
    often = by_id.where("kept").select(F.col("_rs_id").alias("_rs_often"))
    pairs = told.where("kept").join(often, F.col("_rs_id").eqNullSafe(F.col("_rs_often")), "left_semi").select("_rs_id", "_rs_same").distinct()
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_rs_gone")), "left_anti")
    return once(kept, space.cut(pairs, "pairs"), F.sha2(normalised(F.col("text")), 256))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS points
  FROM documents
), g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id ASC) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
