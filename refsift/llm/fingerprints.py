"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the sorted array of the K smallest distinct 64-bit hashes of a text's five-word shingles (lower-cased words
between white space; a text of one to four words is one shingle; without words the sketch is empty). Sketches of parts
merge into the sketch of the whole: the K smallest of their union. From two sketches come resemblance (Jaccard) and
containment, from one the number of distinct shingles.

Defined cases: a null text is empty; two empty sketches resemble each other fully (1.0), an empty and a full one not at
all (0.0); a table of one row is its own next document; rows that share a doc_id are ordered by text; a null doc_id
sorts first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .ordered import dealt, within

K = 128
WORDS = 5
#: Rows of one range when the next document is looked up; about 13 MB of text.
ROWS = 4096


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, words: int = WORDS) -> Column:
    """Hashes of the distinct shingles of a text: array<long>."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))

    def grams(ws: Column) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.size(ws) - (words - 1)), lambda i: F.xxhash64(*[F.element_at(ws, i + j) for j in range(words)]))
        part = F.array(F.aggregate(ws, F.lit(0).cast("long"), lambda acc, w: F.xxhash64(acc, w)))
        return F.when(F.size(ws) >= words, full).when(F.size(ws) > 0, part).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, grams)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingles(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Of the K smallest hashes of both, the share that both have."""
    least = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(common.cast("double"), F.size(least)), F.lit(0.0)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Exact below K; otherwise (K - 1) over the K-th hash's place in the hash space."""
    place = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has, from the resemblance and the three counts."""
    union = distinct_count(merge(a, b, k), k)
    share = F.try_divide(resemblance(a, b, k) * union, distinct_count(a, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: each document beside the one of the next higher id (the first
    one's beside the last)."""
    space = Workspace(docs.sparkSession, "fingerprints")
    plain = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spread, _ = dealt(plain, F.struct("doc_id"), rows, space, before=False, after=True, wrap=True)
    here = within("text")
    ranged = spread.repartition("_rs_range").withColumn("sketch", sketch(F.col("text")))
    both = ranged.withColumns({"next_text": F.lead("text").over(here), "next_sketch": F.lead("sketch").over(here)})
    return both.where("_rs_ghost = 0").select(
        "doc_id", "text", "sketch", F.coalesce("next_text", "text").alias("next_text"), F.coalesce("next_sketch", "sketch").alias("next_sketch")
    )


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points give way to the first as many (or all) of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare(docs: DataFrame) -> DataFrame:
    """The contract's row for every document, the share of its shingles that the edited text has (in_edited), and their
    estimated number."""
    told = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    told = told.withColumn("edited_sketch", sketch(F.col("edited")))
    return told.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"),
        distinct_count(F.col("sketch")).alias("distinct_shingles"),
    )
