"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, given by an offset and a skip
that follow from its name. The shards take turns, each claiming the first slot of its
permutation that is still free, until the table is full. All shards so get the same number of
slots but for one, and when one joins or leaves, most slots keep their shard.

A row's key is hashed to a slot; the table is broadcast (its size is a parameter, not the
data's), so placing a row takes constant time and no shuffle. Rows with one hot key can be
spread by naming more columns in the key.

Results for odd rows: a NULL key counts as an empty text; equal keys meet in one shard; an
empty table gives an empty table. Other columns are kept as they are, and `slot` and `shard`
replace columns of these names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 8191
SHARDS = 64


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(names: list[str], slots: int = SLOTS, turns: list[int] | None = None) -> list[int]:
    """The table: the shard's place in `names` for each slot.

    `turns` gives shards of more weight more claims in each round.
    """
    if not names or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards are needed, and a prime number of slots")
    if turns and max(turns) < 1:
        raise ValueError("some shard must have a turn")
    at = [_number(f"offset {n}") % slots for n in names]
    skip = [_number(f"skip {n}") % (slots - 1) + 1 for n in names]
    table = [-1] * slots
    free = slots
    while free:
        for i in range(len(names)):
            for _ in range(turns[i] if turns else 1):
                if not free:
                    break
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                free -= 1
    return table


def lookup(spark: SparkSession, table: list[int]) -> DataFrame:
    """(slot, shard) rows of a table."""
    text = F.split(F.lit(",".join(map(str, table))), ",")
    rows = spark.range(1).select(F.posexplode(text).alias("slot", "shard"))
    return rows.select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: list[Column], slots: int) -> Column:
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(
    df: DataFrame,
    key: list[str],
    shards: list[str] | None = None,
    slots: int = SLOTS,
    turns: list[int] | None = None,
) -> DataFrame:
    """The rows with `slot` and `shard` (its number in the list of names)."""
    table = lookup(df.sparkSession, fill(shards or shard_names(), slots, turns))
    slot = slot_of([F.col(f"`{k}`") for k in key], slots).cast("int")
    keyed = df.drop("shard").withColumn("slot", slot)
    return keyed.join(F.broadcast(table), "slot").select(*keyed.columns, "shard")


def write_shards(placed: DataFrame, path: str, files: int = 1, shards: int = SHARDS) -> None:
    """One folder per shard, each written by `files` tasks; `shards` is how many were placed."""
    spread = F.pmod(F.xxhash64(*[c for c in placed.columns if c != "shard"]), F.lit(files))
    n = shards * files
    placed.repartition(n, "shard", spread).write.partitionBy("shard").parquet(path)
