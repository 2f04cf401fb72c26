"""Places within groups of any size, pages of a listing, and a batch with its vouchers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipmill.sources.folders import written


def placed(rows: DataFrame, group: str, order: tuple[str, ...], name: str = "place") -> DataFrame:
    """rows with their place from 1 among those of their group (nulls are one), ascending by `order`, nulls first.

    Rows are sorted into ranges of (group, order), written once, and counted by range and group: the counts of earlier
    ranges are a range's offset. So a group may fill any number of tasks. The order should tell rows apart.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(sorted_.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "placed")
    per = dealt.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_g", "_r", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    both = dealt.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return both.select(*rows.columns, (F.col("_row") + F.col("_shift")).alias(name))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of a listing, counted from 1. Spark keeps number * size rows of each task for it: for deep pages use page_after."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, after: dict[str, object] | None, size: int, order: tuple[str, ...]) -> DataFrame:
    """The `size` rows that follow one in a listing of descending `order`, nulls last; the first page after None.

    after: the values of `order` of the last row that was shown. A page costs the same however deep it is, and doesn't
    shift when rows come in before it. The columns of order should tell rows apart.
    """
    listing = [F.col(c).desc_nulls_last() for c in order]
    if after is None:
        return rows.orderBy(*listing).limit(size)

    def later(c: str) -> Column:
        v = after[c]
        return F.lit(False) if v is None else (F.col(c) < F.lit(v)) | F.col(c).isNull()

    same = lambda c: F.col(c).isNull() if after[c] is None else F.col(c) == F.lit(after[c])
    follows = [reduce(lambda a, b: a & b, [same(x) for x in order[:i]], later(c)) for i, c in enumerate(order)]
    return rows.where(F.coalesce(reduce(lambda a, b: a | b, follows), F.lit(False))).orderBy(*listing).limit(size)


def batches_with_vouchers(batches: DataFrame, vouchers: DataFrame) -> DataFrame:
    """A row per voucher of each batch with the batch's own columns, and its place by creation, then by id.

    Batches without vouchers have one row without a voucher; vouchers of no batch of the table aren't there. Columns of
    vouchers: batch_id, voucher_id, created_at and others.
    """
    mine = placed(vouchers.where("batch_id IS NOT NULL"), "batch_id", ("created_at", "voucher_id"))
    return batches.join(mine, "batch_id", "left")
