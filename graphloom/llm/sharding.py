"""Sharding by a permutation-filled lookup table; built-in functions only.

Each shard has a preference order of all slots of a prime-sized table: (offset + j * skip) modulo the size.  Shards
take turns claiming their next free slot until the table is full, so they hold equal shares, and a shard that
joins or leaves moves few other keys.  The table's size is a parameter, not a matter of the data; it is
broadcast, and a row finds its shard by the hash of its key: no shuffle, one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = SIZE) -> list[int]:
    """The table: of each slot, the position of its shard in the sorted list of distinct names."""
    names = sorted({*shards})
    if not names or not _is_prime(size) or size < len(names):
        raise ValueError("a lookup table needs a shard and a prime size of no fewer slots than shards")
    digests = [hashlib.md5(n.encode()).digest() for n in names]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (size - 1) + 1 for d in digests]
    table, left = [-1] * size, size
    while True:
        for k in range(len(names)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot(key: Column, size: int = SIZE) -> Column:
    """The slot of a key: the first 60 bits of its text's MD5 modulo the size; a null key is an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def lookup(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """``slot, shard``: one row for each slot."""
    names = sorted({*shards})
    each = F.posexplode(F.split(F.lit(",".join(map(str, fill(shards, size)))), ","))
    return spark.range(1).select(each.alias("slot", "k")).select("slot", F.element_at(F.array(*map(F.lit, names)), F.col("k").cast("int") + 1).alias("shard"))


def place(rows: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """All rows with ``slot`` and ``shard`` by the hash of ``key``.  Equal keys share a shard; columns of these names are replaced."""
    kept = rows.drop("slot", "shard") if key not in ("slot", "shard") else rows
    where = F.broadcast(lookup(rows.sparkSession, shards, size))  # size rows, a parameter
    placed = kept.select(*[F.col(c).alias(f"in_{c}") for c in kept.columns], slot(F.col(key), size).alias("slot")).join(where, "slot", "left")
    out = [c for c in kept.columns if c not in ("slot", "shard")]
    return placed.select(*[F.col(f"in_{c}").alias(c) for c in out], "slot", "shard")
