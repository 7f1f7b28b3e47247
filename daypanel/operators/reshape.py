"""Projection, unpivot, pivot, header promotion and unions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def q(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or slashes."""
    return F.col(quoted(name))


def select_range(df: DataFrame, positions: int = 0, first: str | None = None, last: str | None = None) -> DataFrame:
    """The first ``positions`` columns plus the run of columns from ``first`` to ``last``."""
    names = df.columns
    picked = names[:positions]
    if first is not None:
        run = names[names.index(first) : (names.index(last) if last else len(names) - 1) + 1]
        picked = picked + [n for n in run if n not in picked]
    return df.select(*[q(n) for n in picked])


def rename_positions(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Rename columns by position, counted from one."""
    return df.toDF(*[names.get(i, n) for i, n in enumerate(df.columns, start=1)])


def map_columns(
    df: DataFrame,
    fn: Callable[[Column], Column],
    cols: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Apply one column function to the listed columns, or to all but the excluded ones."""
    chosen = set(df.columns if cols is None else cols) - set(exclude)
    return df.select(*[fn(q(n)).alias(n) if n in chosen else q(n) for n in df.columns])


def unpivot_rest(
    df: DataFrame, ids: int | Sequence[str], variable: str, value: str, value_type: str = "double"
) -> DataFrame:
    """Wide to long: every column but the id columns becomes a (variable, value) row; NULL cells stay.

    Values are read with a tolerant cast, so text columns of a scanned wide file need no type inference.
    """
    names = df.columns[:ids] if isinstance(ids, int) else list(ids)
    return unpivot_some(df, [n for n in df.columns if n not in names], variable, value, names, value_type)


def unpivot_some(
    df: DataFrame,
    cols: Sequence[str],
    variable: str,
    value: str,
    keep: Sequence[str] | None = None,
    value_type: str = "double",
) -> DataFrame:
    """Wide to long over the named columns; the other columns are kept (or only those in ``keep``)."""
    keep = [quoted(n) for n in (df.columns if keep is None else keep) if n not in cols]
    cells = [quoted(n) for n in cols]
    typed = df.selectExpr(*keep, *[f"try_cast({c} AS {value_type}) AS {c}" for c in cells])
    return typed.unpivot(keep, cells, variable, value)


def pivot_declared(
    df: DataFrame, ids: Sequence[str], key: str, value: str, values: Sequence, unique: bool = False
) -> DataFrame:
    """Long to wide with the output columns declared up front, so no extra job looks for them.

    A column is named by the text of its value, as ``str`` writes it. Spark's pivot costs the same per row
    however many columns there are. ``unique=True`` raises when one cell would get two values.
    """
    if len({str(v) for v in values}) < len(values):
        raise ValueError("two pivot values have the same text")
    cell = F.first(q(value), ignorenulls=True)
    if unique:
        cell = F.when(F.count(F.lit(1)) > 1, _duplicate()).otherwise(cell)
    wide = df.groupBy(*[q(n) for n in ids]).pivot(key, list(values)).agg(cell)
    return wide.toDF(*ids, *[str(v) for v in values])


def _duplicate() -> Column:
    return F.raise_error(F.lit("pivot: duplicate cell"))


def with_label(df: DataFrame, key: str, labels: Mapping[str, str], out: str = "label") -> DataFrame:
    """Add the display label of a measure name; unknown names get NULL."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(labels.items())])
    return df.withColumn(out, F.try_element_at(pairs, q(key)))


def union_fill(*dfs: DataFrame) -> DataFrame:
    """Union all by column name; columns a frame lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union all by name, each row tagged with the name of its frame."""
    return union_fill(*[df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def promote_header(
    rows: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    header_rows: int = 1,
    drop_rows: Sequence[int] = (),
    row: str = "row_idx",
    cells: str = "cells",
) -> DataFrame:
    """Rows of text cells to named columns, the names taken from the first row or rows of each table.

    Names of a two-row header are joined with a space. The caller declares the columns to read; one
    that a table lacks is NULL. Rows are counted from zero. One window per table, so a single shuffle.
    """
    table = Window.partitionBy(*[q(k) for k in keys])
    names = [F.max(F.when(q(row) == i, q(cells))).over(table) for i in range(header_rows)]
    header = reduce(
        lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))),
        names,
    )
    body = rows.withColumn("_header", header).where((q(row) >= header_rows) & ~q(row).isin(list(drop_rows)))
    at = [F.array_position("_header", F.lit(c)).cast("int") for c in columns]
    picked = [F.when(p > 0, F.try_element_at(q(cells), p)).alias(c) for p, c in zip(at, columns)]
    return body.select(*[q(k) for k in keys], q(row), *picked)
