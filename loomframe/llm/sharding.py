"""Consistent sharding by a permutation-filled lookup table, DataFrame functions only.

Shards take turns claiming slots of a prime-sized table, each in its own preference order
(offset + j * skip, all slots for a prime size). The table's size is a parameter, not data: the
driver fills it once and it reaches the executors as one broadcast of `slots` rows, so placing a row
is one hash and one array look-up and needs no shuffle of the rows placed.

Defined results: a null key goes to the shard of the string '' ; equal keys go to equal shards;
repeated rows are all kept; an empty table gives an empty table; a clash of column names raises.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS, SLOTS = 64, 8191


def digest(text: str) -> int:
    """The first 15 hex digits of a text's MD5 as a number, as `hashed` has it in SQL."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def hashed(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(names: list[str], slots: int) -> list[int]:
    """slot -> index of the shard that claimed it. Removing a shard moves few slots of the others."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    if not is_prime(slots) or slots < len(names):
        raise ValueError("slots must be a prime, at least as many as shards")
    at = [digest(f"{x}/offset") % slots for x in names]
    skip = [digest(f"{x}/skip") % (slots - 1) + 1 if slots > 2 else 1 for x in names]
    owner, left = [-1] * slots, slots
    while left:
        for k in range(len(names)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            owner[at[k]], left = k, left - 1
            if not left:
                break
    return owner


def place(df: DataFrame, key: str, names: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard` (a name's index). One broadcast of `slots` rows, however long df is."""
    names = [f"shard-{k:05d}" for k in range(SHARDS)] if names is None else names
    clash = {"slot", "shard"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}")
    owners = ",".join(map(str, lookup_table(names, slots)))
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("_slot", "_owner"))
    table = table.select(F.col("_slot").cast("long").alias("slot"), F.col("_owner").cast("int").alias("shard"))
    return df.withColumn("slot", hashed(F.col(f"`{key}`")) % slots).join(F.broadcast(table), "slot")


def sizes(placed: DataFrame) -> DataFrame:
    """Rows in each shard."""
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))
