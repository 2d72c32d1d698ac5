"""Placement by a permutation-filled lookup table (operator 5, DataFrame functions only).

The table has a prime number of slots. Every shard has its own permutation of the slots, given by an
offset and a skip; the shards take turns, and on its turn a shard claims the first slot of its
permutation that is still free. A row's key is hashed to a slot and the slot's owner is its shard: one
broadcast look-up a row, no shuffle. When a shard is added or removed, few slots change their owner.

The table has ``slots`` rows whatever the data's size, which bounds the broadcast. Keys that hold a large
share of the rows can be spread over ``spread`` slots by a second column (``spread_col``).

Defined results: a null key is placed like the text ``null``; repeated rows get the same shard; an empty
table gives no rows; columns named ``slot`` or ``shard`` in the input do not clash, for only the key is read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production parameters: slots is a prime over 100 times the number of shards.
SHARDS, SLOTS = 16, 2039


def permutation(shard: str, slots: int) -> tuple[int, int]:
    """Offset and skip of a shard's preference order, from the MD5 of its name."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:12], 16) % slots, int(digest[12:24], 16) % (slots - 1) + 1


def fill(shards: list[str], slots: int) -> list[int]:
    """Owner (index into ``shards``) of each slot after the shards have claimed all slots in turn."""
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime")
    if not 0 < len(shards) <= slots:
        raise ValueError("there must be one shard at least and no more shards than slots")
    orders, turn = [permutation(s, slots) for s in shards], [0] * len(shards)
    owner = [-1] * slots
    for claim in range(slots):
        i = claim % len(shards)
        offset, skip = orders[i]
        while owner[slot := (offset + turn[i] * skip) % slots] >= 0:
            turn[i] += 1
        owner[slot] = i
    return owner


def slot_of(key: Column, slots: int, salt: Column | None = None) -> Column:
    """Slot of a key: the first 12 hex digits of its MD5, modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    text = text if salt is None else F.concat_ws("/", text, salt.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long"), F.lit(slots))


def shard(df: DataFrame, key_col: str, shards: list[str] | None = None, slots: int = SLOTS, spread_col: str | None = None, spread: int = 1) -> DataFrame:
    """``(key, slot, shard)`` for every row. With ``spread_col``, a key's rows go to ``spread`` slots."""
    names = shards or [f"shard{i}" for i in range(SHARDS)]
    spark = df.sparkSession
    table = spark.createDataFrame([(i, s) for i, s in enumerate(fill(names, slots))], "slot long, shard int")
    salt = F.pmod(F.xxhash64(F.col(spread_col)), F.lit(spread)) if spread_col and spread > 1 else None
    placed = df.select(F.col(key_col), slot_of(F.col(key_col), slots, salt).alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(key_col, "slot", "shard")


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """The same in DuckDB SQL; the table is filled by a recursive query, one claim a step."""
    return f"""
WITH RECURSIVE hashes AS (
  SELECT i, md5('shard' || i) AS h FROM range({shards}) t(i)
), perms AS (
  SELECT list(('0x' || substr(h, 1, 12))::BIGINT % {slots} ORDER BY i) AS offs,
         list(('0x' || substr(h, 13, 12))::BIGINT % {slots - 1} + 1 ORDER BY i) AS skips FROM hashes
), claims(step, turns, owner, slot) AS (
  SELECT 0, list_transform(range({shards}), lambda x: 0::BIGINT), list_transform(range({slots}), lambda x: -1::BIGINT), -1::BIGINT
  UNION ALL
  SELECT step + 1,
         list_transform(turns, lambda t, k: CASE WHEN k = step % {shards} + 1 THEN turn + 1 ELSE t END),
         list_transform(owner, lambda o, k: CASE WHEN k = pick + 1 THEN (step % {shards})::BIGINT ELSE o END), pick
  FROM (
    SELECT step, turns, owner, turn, (offs[step % {shards} + 1] + turn * skips[step % {shards} + 1]) % {slots} AS pick
    FROM (
      SELECT *, list_filter(range(turns[step % {shards} + 1], {slots}),
                            lambda j: owner[(offs[step % {shards} + 1] + j * skips[step % {shards} + 1]) % {slots} + 1] < 0)[1] AS turn
      FROM claims, perms WHERE step < {slots}
    )
  )
), lookup AS (
  SELECT slot, ((step - 1) % {shards})::INTEGER AS shard FROM claims WHERE step > 0
), placed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT % {slots} AS slot FROM documents
)
SELECT doc_id, placed.slot AS slot, shard FROM placed JOIN lookup ON placed.slot = lookup.slot
"""
