"""Equi-joins that treat a missing key as a value, and semi-joins on key lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from daypanel.operators.reshape import q, quoted


def join_null_safe(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", suffix: str = "_right"
) -> DataFrame:
    """Left or inner equi-join where NULL matches NULL, as a sort-merge join.

    Non-key columns that both sides have get ``suffix`` on the right. The right side is a panel like the left
    one, so it is never broadcast: Spark would judge it by its file, which may be a hundredth of its rows, and
    a hash table cannot spill.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is 'left' or 'inner'")
    shared = set(left.columns) & set(right.columns) - set(on)
    key = {k: f"_key_{i}" for i, k in enumerate(on)}
    renamed = right.select(*[q(c).alias(key.get(c, c + suffix if c in shared else c)) for c in right.columns])
    same = reduce(lambda a, b: a & b, [left[quoted(k)].eqNullSafe(renamed[key[k]]) for k in on])
    return left.join(renamed.hint("merge"), same, how).drop(*key.values())


def join_natural(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Null-safe join on every column both sides have."""
    return join_null_safe(left, right, [c for c in left.columns if c in right.columns], how)


def join_suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join on named keys; non-key columns that both sides have get the two suffixes."""
    shared = set(left.columns) & set(right.columns) - set(on)

    def renamed(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*[q(c).alias(c + suffix if c in shared else c) for c in df.columns])

    return join_null_safe(renamed(left, suffixes[0]), renamed(right, suffixes[1]), on, "inner")


def keep_listed(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in the list; repeated list entries do no harm.

    No broadcast hint: a list may be long, so Spark decides by the size it sees at run time.
    """
    return df.join(keys, on=[on] if isinstance(on, str) else list(on), how="left_semi")


def drop_listed(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose (multi-column) key is not in the list."""
    return df.join(keys, on=list(on), how="left_anti")


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add the single value of a one-row frame to every row, as a scalar subquery."""
    return df.withColumn(name, one_row.scalar())
