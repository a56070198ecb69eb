"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a table of prime size, each in the order of its own permutation of all slots, until
every slot is taken.  Shares then differ by one slot at most, and a changed list of shards moves little else than the
slots of the shards that came or went.  A document's slot is a hash of its id; its shard stands in the table, which
is broadcast: its size is the prime, fixed by a parameter and at most ``MAX_SLOTS``.

Defined results: a null id is placed like the empty string; repeated rows go to the same shard; an empty table gives
no rows; the text plays no part; other columns are kept, and one of the name ``shard`` or ``slot`` is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import table

MAX_SLOTS = 1_000_003
SHARDS = tuple(f"shard-{i:03d}" for i in range(32))
SLOTS = 4099


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it.

    >>> from collections import Counter
    >>> sorted(Counter(lookup(("a", "b", "c"), 13)).values())
    [4, 4, 5]
    """
    if not 2 <= slots <= MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MAX_SLOTS}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, one at least and no more than slots")
    at = [_hash(s, "start") % slots for s in shards]
    step = [_hash(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            if not free:
                break
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
    return owner


def slot_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """slot, shard: the lookup table as a DataFrame of ``slots`` rows."""
    owners = F.split(F.lit(",".join(map(str, lookup(shards, slots)))), ",")
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    names = F.split(F.lit("\x00".join(shards)), "\x00")
    return rows.select(F.col("slot").cast("long"), F.get(names, F.col("owner").cast("int")).alias("shard"))


def assign(docs: DataFrame, id_col: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Adds slot and shard: one broadcast hash lookup a row, no shuffle."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return docs.drop("shard", "slot").withColumn("slot", h % slots).join(F.broadcast(slot_table(docs.sparkSession, shards, slots)), "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


OP5_SQL = f"""
SELECT doc_id, slot, 'shard-' || lpad([{",".join(map(str, lookup()))}][slot + 1]::VARCHAR, 3, '0') AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
"""
