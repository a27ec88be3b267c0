"""Sharding by a permutation-filled lookup table: constant-time placement, little movement when shards come or go."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots; a prime well above 100 times the number of shards keeps the shares within about a percent.
SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) of each slot. Shard i prefers slots offset + k * skip; the shards take turns,
    each claiming the first slot of its list that is still free."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards have to be distinct, at least one and at most as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots has to be prime")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, looked up in a broadcast table of ``slots`` rows (its size is a parameter).

    Rows with equal keys, repeated rows included, go to one shard; null keys go to the slot of the hash's seed; columns
    of these two names are replaced; an empty table stays empty. Nothing is shuffled.
    """
    names = list(shards or SHARDS)
    table = df.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(fill_table(names, slots))], "slot int, shard string")
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot")


def write_shards(df: DataFrame, path: str, **parameters) -> None:
    """Write ``df`` as Parquet with a folder for each shard; each task writes what it reads, nothing is shuffled."""
    place(df, **parameters).write.partitionBy("shard").parquet(path)
