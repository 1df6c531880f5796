"""A seeded, engine-independent integer hash for sampling, splits and k-means starts.

Two rounds of the Park-Miller multiplicative step modulo the Mersenne prime
2^31-1. It only needs integer ``pmod`` and products below 2^63, so it is
identical in Spark and in any SQL engine used as an oracle, and it is
stable under repartitioning (a pure function of the key).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generator (Park & Miller, 1988).
MODULUS = 2147483647
MULTIPLIER = 48271


def stable_hash(key, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    # a key that is no integer counts by the first 15 hex digits of the md5 of its text
    digest = F.conv(F.substring(F.md5(k.cast("string")), 1, 15), 16, 10).cast("long")
    number = F.pmod(F.coalesce(k.try_cast("long"), digest), F.lit(MODULUS))
    h = F.pmod(number + F.lit(int(seed)), F.lit(MODULUS))
    h = F.pmod(h * F.lit(MULTIPLIER), F.lit(MODULUS))
    return F.pmod(h * F.lit(MULTIPLIER), F.lit(MODULUS))


def stable_hash_sql(key_sql: str, seed: int) -> str:
    """The same hash as SQL text (for the DuckDB oracle)."""
    p, m = MODULUS, MULTIPLIER
    h = f"((({key_sql}) + {int(seed)}) % {p} + {p}) % {p}"
    h = f"(({h}) * {m}) % {p}"
    return f"(({h}) * {m}) % {p}"
