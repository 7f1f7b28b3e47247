"""Rankings: top and bottom k with ties, last rows per group, ordinals, region lists."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from daypanel.operators.reshape import q
from daypanel.session import stage


def top_k_ties(df: DataFrame, k: int, weight: str, largest: bool = True) -> DataFrame:
    """The rows ranked at most ``k`` by weight, ties kept, missing weights dropped.

    The k-th weight comes from a per-task top-k, and one filter keeps every row that reaches it: no
    sort of the whole frame and no single-task window, however many rows tie.
    """
    kth = _kth_weight(df, k, weight, largest).scalar()
    return df.where(q(weight) >= kth if largest else q(weight) <= kth)


def _kth_weight(df: DataFrame, k: int, weight: str, largest: bool) -> DataFrame:
    present = df.where(q(weight).isNotNull()).select(q(weight).alias("w"))
    ordered = present.orderBy(F.desc("w") if largest else F.asc("w"))
    return ordered.limit(k).agg(F.min("w") if largest else F.max("w"))


def bottom_k_ties(df: DataFrame, k: int, weight: str) -> DataFrame:
    return top_k_ties(df, k, weight, largest=False)


def top_n_per(df: DataFrame, key: str | Sequence[str], n: int, weight: str, largest: bool = True) -> DataFrame:
    """Rows ranked at most ``n`` within their group, ties kept, missing weights dropped.

    Spark limits each group before the shuffle (WindowGroupLimit), so a large group sends few rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = q(weight).desc() if largest else q(weight).asc()
    ranked = df.where(q(weight).isNotNull()).withColumn(
        "_rank", F.rank().over(Window.partitionBy(*[q(k) for k in keys]).orderBy(order))
    )
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def last_rows(df: DataFrame, key: str, n: int, order: str, tie: str | None = None) -> DataFrame:
    """The last ``n`` rows of each group by ``order``; ``tie`` settles equal positions."""
    by = [q(order).desc()] + ([q(tie).desc()] if tie else [])
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(q(key)).orderBy(*by)))
    return numbered.where(F.col("_n") <= n).drop("_n")


def last_per_group(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each group, for groups with one row per position: an aggregation, no sort."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*[q(c) for c in rest]), q(order))
    return df.groupBy(q(key)).agg(last.alias("_last")).select(q(key), *[F.col("_last")[c].alias(c) for c in rest])


def nth_last(df: DataFrame, key: str, n: int, order: str, tie: str | None = None) -> DataFrame:
    """The n-th last row of each group (one is the last); groups with fewer rows have none; ``tie`` settles equal positions."""
    by = [q(order).desc()] + ([q(tie).desc()] if tie else [])
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(q(key)).orderBy(*by)))
    return numbered.where(F.col("_n") <= n).where(F.col("_n") == n).drop("_n")


def preview(df: DataFrame, n: int = 6) -> DataFrame:
    return df.limit(n)


def global_row_number(df: DataFrame, by: str, tie: str, out: str = "ordinal", descending: bool = False) -> DataFrame:
    """Position of every row in the whole sorted frame, from one; missing values come last.

    The frame is range-partitioned by (by, tie), sorted inside the partitions and written once, each row
    with its partition and place; the sizes of the partitions before give the shift. There are as many
    partitions as the session has for shuffles, so they grow with the cluster, also when most rows tie on ``by``.
    """
    order = [q(by).isNull().asc(), q(by).desc() if descending else q(by).asc(), q(tie).asc()]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id holds the partition above bit 33 and the place of the row below.
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    # One row per partition, so the unpartitioned window and the broadcast are bounded.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    numbered = placed.withColumn("_part", part).join(F.broadcast(shift), "_part")
    return numbered.withColumn(out, (F.col("_before") + place).cast("bigint")).drop("_at", "_part", "_before")


def pick_regions(
    panel: DataFrame,
    k: int = 10,
    weight: str = "conf",
    manual: Iterable[str] = (),
    region: str = "region",
    date: str = "date",
    largest: bool = True,
) -> DataFrame:
    """Region list: the first ``k`` by the weight on their last day, plus a manual list.

    A region in both appears twice, so use the list in a semi-join. The panel is read twice, once for the
    k-th weight; stage it when it is costly.
    """
    latest = panel.groupBy(q(region)).agg(F.max_by(q(weight), q(date)).alias("_weight"))
    w = F.col("_weight")
    kth = _kth_weight(latest, k, "_weight", largest).scalar()
    reached = (w >= kth) if largest else (w <= kth)
    names = list(manual)
    if not names:
        return latest.where(reached).select(region)
    times = q(region).isin(names).cast("int") + F.coalesce(reached, F.lit(False)).cast("int")
    return latest.select(F.explode(F.array_repeat(q(region), times)).alias(region))
