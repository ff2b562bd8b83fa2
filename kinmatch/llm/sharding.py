"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size
(start and step from two hashes of its name). The shards take turns; at its
turn a shard claims the first free slot in its order of preference, until no
slot is free. A row's key hashes to a slot, the table names the shard. Shards
get slot counts that differ by one at most, and taking a shard away moves few
keys that it didn't hold.

Rows are placed by DataFrame functions alone: the table, whose size is fixed,
is broadcast, and no row is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 10_007
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not is_prime(slots) or len(shards) > slots or not shards or len(set(shards)) < len(shards):
        raise ValueError("slots must be a prime, no less than the number of the distinct shards")
    start = [_hash(f"{s}/start") % slots for s in shards]
    step = [_hash(f"{s}/step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, turn, left = [-1] * slots, [0] * len(shards), slots
    while True:
        for k in range(len(shards)):
            while table[at := (start[k] + turn[k] * step[k]) % slots] >= 0:
                turn[k] += 1
            table[at] = k
            turn[k] += 1
            left -= 1
            if not left:
                return table


def shard_documents(docs: DataFrame, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """doc_id, slot and shard of every row; `key` is hashed as text, a null like the empty text.

    Equal keys get equal shards. Nothing but doc_id and the key is read; an
    empty input gives an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    held = F.lit(fill_table(shards, slots))  # folded into one constant
    names = F.lit(list(shards))
    lookup = spark.range(slots).select(F.col("id").alias("slot"), F.get(names, F.get(held, F.col("id").cast("int"))).alias("shard"))
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots
    placed = docs.select(F.col("doc_id"), slot.alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select("doc_id", "slot", "shard")


def oracle_sql(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    held = ",".join(map(str, fill_table(shards, slots)))
    return f"""
    WITH t AS (SELECT [{held}] AS held)
    SELECT doc_id, slot, 'shard-' || lpad(CAST(held[slot + 1] AS VARCHAR), 3, '0') AS shard
    FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {slots} AS slot FROM documents), t
    """
