"""Seeded hash order shared by Spark and the SQL oracle.

Every "random" choice in the library (shuffles, splits, draws, pairings,
masks) is a pure function of a seed and row keys, so results do not depend on
partitioning, task retries or executor loss, and the same ordering can be
written in plain SQL:

    hash_key(seed, k1, k2)   = md5(seed || ':' || k1 || ':' || k2)          (hex string)
    hash_mod(seed, k..., n)  = int(first 8 hex digits of hash_key) mod n
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hash_key(seed, *keys) -> Column:
    parts = [_as_col(seed).cast("string")]
    for k in keys:
        parts += [F.lit(":"), _as_col(k).cast("string")]
    return F.md5(F.concat(*parts))


def hash_int(seed, *keys) -> Column:
    """Non-negative 32-bit integer drawn from the hash key."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("bigint")


def hash_mod(seed, *keys_and_n) -> Column:
    *keys, n = keys_and_n
    return F.pmod(hash_int(seed, *keys), _as_col(n).cast("bigint"))


# SQL spellings (DuckDB) of the same functions, used by the oracle builders.
def sql_hash_key(seed, *keys: str) -> str:
    parts = [f"CAST({seed} AS VARCHAR)"]
    for k in keys:
        parts += ["':'", f"CAST({k} AS VARCHAR)"]
    return "md5(" + " || ".join(parts) + ")"


def sql_hash_int(seed, *keys: str) -> str:
    return f"CAST(('0x' || substr({sql_hash_key(seed, *keys)}, 1, 8)) AS BIGINT)"


def sql_hash_mod(seed, *keys_and_n) -> str:
    *keys, n = keys_and_n
    return f"({sql_hash_int(seed, *keys)} % CAST({n} AS BIGINT))"
