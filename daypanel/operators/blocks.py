"""Windows over series longer than a task, and order statistics of groups larger than one.

A plain window brings all rows of a series to one task. Here rows get their position in their series by a range
partitioning, positions are cut into blocks, and windows run inside (series, block). Offsets find their rows because
each block is sent the last rows of the one before and the first of the one after; running sums add what the blocks before
come to, which a second window over one row per block computes. A series of 10^8 rows is some hundred
blocks on as many tasks, and nothing depends on how long the longest series is.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from daypanel.operators.reshape import q
from daypanel.session import stage

BLOCK_ROWS = 1 << 18


def add_by(rows: DataFrame, keys: Sequence[str], other: DataFrame) -> DataFrame:
    """The columns that ``other`` has beside the keys, for each row; missing keys match. ``other`` has one row per key."""
    renamed = other.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    on = [q(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(renamed, reduce(lambda a, b: a & b, on)).drop(*[f"_k{i}" for i in range(len(keys))])


def placed(df: DataFrame, keys: Sequence[str], by: Sequence[str | Column], weight: str | None = None) -> DataFrame:
    """Every row with ``_pos``, its place from 0 in the order of its group, and ``_n``, the rows of the group.

    With ``weight`` a row stands for that many equal ones: ``_pos`` is the place of its first, ``_n`` the sum.
    Rows are range-partitioned by (keys, order), so a group with most of them spreads over all tasks, and written
    once; the counts of the partitions before give the shift. Rows that tie on the order are told apart by all their columns.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [q(k).asc() for k in keys] + [q(c).asc() if isinstance(c, str) else c for c in by] + [F.col("_tie").asc()]
    ordered = df.withColumn("_tie", F.xxhash64(*[q(c) for c in df.columns])).repartitionByRange(parts, *order)
    # The id holds the partition above bit 33 and the place of the row below.
    ordered = ordered.sortWithinPartitions(*order).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    rows = stage(ordered, "placed").withColumn("_part", F.shiftright("_at", 33))
    group, within = [q(k) for k in keys], [*[q(k) for k in keys], F.col("_part")]
    size = F.count(F.lit(1)) if weight is None else F.sum(q(weight))
    sizes = rows.groupBy(*within).agg(size.alias("_rows"), F.min("_at").alias("_least"))
    over = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(*within, F.sum("_rows").over(over).alias("_n"), before.alias("_before"), "_least")
    out = add_by(rows, [*keys, "_part"], shift)
    if weight is None:
        out = out.withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_least"))
    else:
        inside = Window.partitionBy(*within).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_pos", F.col("_before") + F.coalesce(F.sum(q(weight)).over(inside), F.lit(0)))
    return out.drop("_at", "_part", "_before", "_least")


@dataclass(frozen=True)
class Blocks:
    """Rows of series by position, ``size`` to a block."""

    rows: DataFrame
    size: int

    @classmethod
    def of(cls, df: DataFrame, keys: str | Sequence[str] = "region", by: str | Sequence[str] = "date", size: int = BLOCK_ROWS) -> Blocks:
        keys, by = ([x] if isinstance(x, str) else list(x) for x in (keys, by))
        # A struct is never missing and equals another with the same missing parts, so windows and joins share one partitioning.
        key = F.struct(*[q(k).alias(f"k{i}") for i, k in enumerate(keys)])
        rows = placed(df, keys, by).withColumns({"_key": key, "_block": F.floor(F.col("_pos") / size).cast("bigint")}).drop("_n")
        return cls(rows, size)

    def _series(self) -> WindowSpec:
        return Window.partitionBy("_key", "_block").orderBy("_pos")

    def with_columns(self, columns: Mapping[str, Column]) -> Blocks:
        return replace(self, rows=self.rows.withColumns(dict(columns)))

    def with_offsets(self, make: Callable[[WindowSpec], Mapping[str, Column]], back: int = 0, ahead: int = 0) -> Blocks:
        """Columns of a window that reach at most ``back`` rows back and ``ahead`` rows on: ``make`` gets the window.

        The rows within reach of a border are sent to the neighbouring block too, and removed after the window.
        """
        if max(back, ahead) > self.size:
            raise ValueError(f"offsets of {max(back, ahead)} rows need blocks of as many; these have {self.size}")
        place = F.col("_pos") % self.size
        homes = F.array_compact(
            F.array(F.lit(0), F.when(place >= self.size - back, F.lit(1)), F.when((place < ahead) & (F.col("_block") > 0), F.lit(-1)))
        )
        sent = self.rows.withColumn("_to", F.explode(homes)).withColumn("_block", F.col("_block") + F.col("_to"))
        return replace(self, rows=sent.withColumns(dict(make(self._series()))).where("_to = 0").drop("_to"))

    def with_running(self, sums: Mapping[str, str], strict: bool = True) -> Blocks:
        """Running sums by output name; a strict one is NULL from the first missing value on, others skip missing values."""
        up_to_here = self._series().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        names = list(sums.items())
        rows = self.rows
        for i, (_, x) in enumerate(names):
            rows = rows.withColumns({f"_s{i}": F.sum(q(x)).over(up_to_here), f"_c{i}": F.count(q(x)).over(up_to_here)})
        totals = self.rows.groupBy("_key", "_block").agg(
            *[f(q(x)).alias(f"{name}{i}") for i, (_, x) in enumerate(names) for name, f in (("_ts", F.sum), ("_tc", F.count))],
        )
        earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            "_key", "_block",
            *[F.sum(f"_ts{i}").over(earlier).alias(f"_ps{i}") for i in range(len(names))],
            *[F.coalesce(F.sum(f"_tc{i}").over(earlier), F.lit(0)).alias(f"_pc{i}") for i in range(len(names))],
        )
        rows = rows.join(carry, ["_key", "_block"])
        out = {}
        for i, (name, _) in enumerate(names):
            total = F.coalesce(F.col(f"_ps{i}") + F.col(f"_s{i}"), F.col(f"_ps{i}"), F.col(f"_s{i}"))
            whole = F.col(f"_pc{i}") + F.col(f"_c{i}") == F.col("_pos") + 1
            out[name] = F.when(whole, total) if strict else total
        helpers = [f"{c}{i}" for i in range(len(names)) for c in ("_s", "_c", "_ps", "_pc")]
        return replace(self, rows=rows.withColumns(out).drop(*helpers))

    def frame(self) -> DataFrame:
        return self.rows.drop("_pos", "_block", "_key")
