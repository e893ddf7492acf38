"""Shards by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, from two hashes of its name. Shards take turns and
claim the first free slot of their permutation, so that slots are even to within one and few of them move when a
shard comes or goes. A document hashes to a slot; the table, of a fixed number of rows, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .apply import quoted, whole_row

#: A prime; at least about 100 times the number of shards keeps shares within a per cent.
SLOTS = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The index of the shard at each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least and not more than slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    state = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        state.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1))
    table, step, free = [-1] * slots, [0] * len(shards), slots
    while True:
        for i, (offset, skip) in enumerate(state):
            while table[slot := (offset + step[i] * skip) % slots] >= 0:
                step[i] += 1
            table[slot] = i
            step[i] += 1
            if not (free := free - 1):
                return table


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


def sharded(docs: DataFrame, shards: tuple[str, ...] = SHARDS, key: tuple[str, ...] = ("doc_id", "text"), slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """docs with the slot and the shard of each row.

    The key is the id with the text, so that rows without an id and copies under other ids spread; rows equal in both
    stay together. Null is a value like any other, and so is the empty text; of a long text all is hashed. An empty
    table gives an empty result. Columns that are named like the new ones, in any case of letters, are replaced, unless
    they are of the key, which is read before; the others stay, whatever their names.
    """
    rows = [(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))]
    table = docs.sparkSession.createDataFrame(rows, "slot int, shard string")
    dealt = docs.select(whole_row(docs), slot_of(*map(quoted, key), slots=slots).alias("slot")).join(F.broadcast(table), "slot", "left")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    return dealt.select(*kept, F.col("slot").alias(slot_col), F.col("shard").alias(shard_col))
