"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: it begins at an offset and
goes on by a step, both hashed from its name. The shards take turns claiming their next free slot, so
each holds nearly the same share, and when a shard comes or goes few slots change hands. A row's key is
hashed to a slot; the table, whose size is a parameter, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import free

#: Slots; prime, and far more than shards.
SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard index that holds each slot. Shard names must differ and be no more than the slots."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shard names must be distinct, at least one and at most one a slot")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    hashed = lambda name, use: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, person=use).digest(), "little")
    at = [hashed(s, b"offset") % slots for s in shards]
    step = [hashed(s, b"step") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for shard in range(len(shards)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step[shard]) % slots
            table[slot] = shard
            at[shard] = (slot + step[shard]) % slots
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its text's MD5, modulo the slots. A null key counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("bigint")


def assign(df: DataFrame, key: Column | str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with its slot and shard columns, row for row (columns of those names are replaced).

    Nulls, empty keys and repeated rows each have the one place of their key; an empty table stays empty.
    The broadcast side has exactly ``slots`` rows.
    """
    spark = df.sparkSession
    listed = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",").cast("array<int>")
    at, slot, shard = (free(df, f"__{n}") for n in ("at", "slot", "shard"))
    table = spark.range(slots).select(F.col("id").alias(slot), F.element_at(listed, (F.col("id") + 1).cast("int")).alias(shard))
    key = F.col(key) if isinstance(key, str) else key
    placed = df.withColumn(at, slot_of(key, slots)).join(F.broadcast(table), F.col(at) == F.col(slot), "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (slot_col, shard_col)]
    return placed.select(*kept, F.col(at).alias(slot_col), F.col(shard).alias(shard_col))


def write(df: DataFrame, path: str, key: Column | str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, salts: int = 8) -> None:
    """Write one folder a shard; ``salts`` tasks share each shard's rows, so a hot shard is not one task."""
    out = assign(df, key, shards, slots)
    salted = out.repartition(F.col("shard"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in out.columns]), F.lit(salts)))
    salted.write.partitionBy("shard").parquet(path)
