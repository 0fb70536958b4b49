"""Shard placement by a permutation-filled lookup table, in DataFrame operations only.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a skip drawn from its name
(slot = (offset + turn * skip) mod size). The shards take turns; at its turn a shard claims the first slot of its
permutation that is still free, until the table is full. So every shard owns as many slots as any other, give or take
one, and a shard that joins or leaves moves few keys besides its own. The table has SLOTS entries whatever the size of
the data; it is broadcast, and a row's place is one hash and one look-up: no shuffle.

Defined cases: a null key is placed like the empty string; equal keys have equal places; weights take whole turns (a
shard of weight 2 claims two slots a turn); an empty table gives an empty result; other columns are carried through, one
that is named slot or shard in whatever case as `<its name>_input` (with further underscores while that is taken too).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prime, and over 100 times the usual number of shards, which keeps the shares within one per cent.
SLOTS = 65537


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup_table(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """The owner (index into shards) of every slot."""
    if not 0 < len(shards) <= slots:
        raise ValueError("between one shard and one shard a slot")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    turns = list(weights) if weights is not None else [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    place, skip = [], []
    for name in shards:
        raw = hashlib.md5(name.encode()).digest()
        place.append(int.from_bytes(raw[:8], "big") % slots)
        skip.append(int.from_bytes(raw[8:], "big") % (slots - 1) + 1 if slots > 2 else 1)
    owner = [-1] * slots
    free = slots
    while free:
        for shard, times in enumerate(turns):
            for _ in range(times):
                if not free:
                    break
                while owner[place[shard]] >= 0:
                    place[shard] = (place[shard] + skip[shard]) % slots
                owner[place[shard]] = shard
                free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 60 bits of the key's MD5, modulo the number of slots."""
    first = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10)
    return F.pmod(first.cast("long"), F.lit(slots)).cast("int")


def table_frame(spark: SparkSession, owner: Sequence[int]) -> DataFrame:
    """slot, shard: the look-up table as a frame, from one literal."""
    values = "[" + ",".join(map(str, owner)) + "]"
    parsed = F.from_json(F.lit(values), "array<int>")
    return spark.range(1).select(F.posexplode(parsed).alias("_rs_slot", "shard"))


def carried(columns: Sequence[str]) -> list[str]:
    """The names under which a table's columns go on beside slot and shard."""
    taken = {"slot", "shard"} | {c.lower() for c in columns}
    out = []
    for c in columns:
        name = c
        while name.lower() in ("slot", "shard") or name != c and name.lower() in taken:
            name = f"{c}_input" if name == c else f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def place(df: DataFrame, key: Column, shards: Sequence[str], weights: Sequence[int] | None = None, slots: int = SLOTS) -> DataFrame:
    """df with two more columns: slot int and shard int (index into shards)."""
    owner = lookup_table(shards, slots, weights)
    lookup = F.broadcast(table_frame(df.sparkSession, owner))
    held = df.select(F.struct("*").alias("_rs_row"), slot_of(key, slots).alias("_rs_at"))
    kept = [F.col("_rs_row").getField(c).alias(name) for c, name in zip(df.columns, carried(df.columns), strict=True)]
    return held.join(lookup, F.col("_rs_at") == F.col("_rs_slot")).select(*kept, F.col("_rs_at").alias("slot"), "shard")


def write_shards(df: DataFrame, key: Column, shards: Sequence[str], path: str) -> None:
    """One folder a shard below path. Rows are written where they are: no shuffle, so no task gathers a shard."""
    place(df, key, shards).write.partitionBy("shard").parquet(path)


def oracle(n_shards: int, slots: int = SLOTS) -> str:
    owner = ",".join(map(str, lookup_table(shard_names(n_shards), slots)))
    return f"""
WITH lookup AS (SELECT string_split('{owner}', ',') AS owner),
slots AS (
  SELECT doc_id, text, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot
  FROM documents
)
SELECT doc_id, md5(text) AS text_md5, slot, CAST(owner[slot + 1] AS INTEGER) AS shard FROM slots, lookup
"""
