"""Keyed joins that refuse to match on columns nobody named."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
) -> DataFrame:
    """Join on ``keys`` alone; raises if another column name is shared.

    ``null_safe`` makes a null key match a null key.  Spark broadcasts the
    smaller side only if its size is known to be small, and AQE splits a key
    that holds too many rows.
    """
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared and how not in ("left_semi", "left_anti"):
        raise ValueError(f"columns on both sides but not keys: {sorted(shared)}")
    if not null_safe:
        return left.join(right, list(keys), how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    )
    joined = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "right":
        joined = joined.drop(*[left[k] for k in keys]).withColumnsRenamed(
            {f"_r_{k}": k for k in keys}
        )
        return joined.select(*left.columns, *[c for c in right.columns if c not in keys])
    return joined.drop(*[f"_r_{k}" for k in keys])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    salts: int = 32,
) -> DataFrame:
    """Left join of log rows with a lookup table that is unique by ``keys``.

    Nothing is forced: Spark broadcasts a staged lookup if its files are small
    and AQE splits the rows of a busy key.  Only rows without a key, which can
    never match, are spread over ``salts`` by ``spread_by``.
    """
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    if shared:
        raise ValueError(f"columns on both sides but not keys: {sorted(shared)}")
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salt = F.when(unknown, F.pmod(F.xxhash64(*spread_by), F.lit(salts))).otherwise(0).cast("int")
    plain = right.withColumn("_salt", F.lit(0))
    return left.withColumn("_salt", salt).join(plain, [*keys, "_salt"], "left").drop("_salt")


def in_role(dimension: DataFrame, key: str, role: str) -> DataFrame:
    """The same dimension for another role: every column gets the role's suffix,
    the key becomes ``role`` itself."""
    names: Mapping[str, str] = {
        c: role if c == key else f"{c}_{role}" for c in dimension.columns
    }
    return dimension.withColumnsRenamed(names)


def members_of(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other table."""
    return df.join(keys.select(*on), list(on), "left_semi")


def unique_rows(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Distinct rows of ``columns``; fails at run time if ``keys`` is not unique.

    One aggregation by key: the map side already drops the copies.
    """
    rest = [c for c in columns if c not in keys]
    row = F.struct(*rest)
    checked = df.groupBy(*keys).agg(F.min(row).alias("_row"), F.max(row).alias("_max"))
    same = F.col("_row").eqNullSafe(F.col("_max"))
    row = F.when(same, F.col("_row")).otherwise(
        F.raise_error(F.lit(f"more than one row for a key of {list(keys)}"))
    )
    return checked.select(*keys, row.alias("_row")).select(*keys, "_row.*").select(*columns)
