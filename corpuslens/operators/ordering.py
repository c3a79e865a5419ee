"""Global order without a single-partition window.

Order is part of the data model (sentence order, token position, n-gram order),
so numbering and running totals over a whole table are needed often.  Both are
done in two levels: range-partition by the key, work inside each partition, and
add per-partition offsets (one row per partition, so safe to broadcast).

Range partitioning samples its input, so partition contents could differ between
two evaluations.  ``frozen_order`` therefore writes the ordered rows to the
shared checkpoint folder once; offsets and rows are then read from the same
files, also after executors were lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import checkpoint_dir

PARTITION, ROW = "_pid", "_row"
ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def frozen_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows range-partitioned and sorted by `order`, plus partition and row number."""
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.checkpoint(eager=True).select(
        "*",
        F.spark_partition_id().alias(PARTITION),
        F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1).alias(ROW),
    )


def _with_offset(rows: DataFrame, per_partition: DataFrame, measure: str) -> DataFrame:
    # One row per partition: the window and the broadcast are bounded by their number.
    before = Window.orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_partition.select(
        PARTITION, F.coalesce(F.sum(measure).over(before), F.lit(0)).alias("_offset")
    )
    return rows.join(F.broadcast(offsets), PARTITION)


def ordered_index(df: DataFrame, *order: Column | str, name: str = "idx", start: int = 0) -> DataFrame:
    """Adds dense numbers start, start+1, ... in `order`, which must be unique."""
    rows = frozen_order(df, *order)
    sizes = rows.groupBy(PARTITION).agg((F.max(ROW) + 1).alias("_n"))
    return _with_offset(rows, sizes, "_n").select(
        *df.columns, (F.col("_offset") + F.col(ROW) + start).cast("long").alias(name)
    )


def running_total(df: DataFrame, *order: Column | str, value: str, name: str = "start") -> DataFrame:
    """Adds the sum of `value` over all rows before this one in `order` (unique)."""
    rows = frozen_order(df, *order)
    sums = rows.groupBy(PARTITION).agg(F.sum(value).alias("_n"))
    inside = Window.partitionBy(PARTITION).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return _with_offset(rows.withColumn("_local", local), sums, "_n").select(
        *df.columns, (F.col("_offset") + F.col("_local")).cast("long").alias(name)
    )


def neighbours_by_kind(df: DataFrame, order: str, first: Column, value: Column) -> DataFrame:
    """Adds ``before`` and ``after``: `value` of the last row with `first` at or before this one in
    the order of (`order`, `first` rows first), and of the next row with `first` after it; null if none.

    An as-of match of two kinds of rows stacked in one table: they are sorted into ranges once,
    a range finds its own neighbours in one pass, and what a range passes on to the others is
    one row per range.
    """
    rows = frozen_order(df.withColumns({"_mark": F.when(first, value), "_kind": F.when(first, 0).otherwise(1)}), order, "_kind")
    # Both windows grow from their start, the second in reverse order: a frame that ends at the
    # partition's end would be summed up anew for each row.
    up_to = Window.partitionBy(PARTITION).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(PARTITION).orderBy(F.col(ROW).desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_b", F.last("_mark", True).over(up_to)).withColumn("_a", F.last("_mark", True).over(behind))
    ends = rows.groupBy(PARTITION).agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(ROW))).alias("_last"), F.min_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(ROW))).alias("_first"))
    earlier = Window.orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    later = Window.orderBy(F.col(PARTITION).desc()).rowsBetween(Window.unboundedPreceding, -1)
    passed = ends.select(PARTITION, F.last("_last", True).over(earlier).alias("_pb"), F.last("_first", True).over(later).alias("_pa"))
    joined = found.join(F.broadcast(passed), PARTITION)
    return joined.select(*df.columns, F.coalesce("_b", "_pb").alias("before"), F.coalesce("_a", "_pa").alias("after"))


def take(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows in `order` (unique), all of them when there are fewer.

    Spark takes a small limit as a top-k of every task and a large one from a sorted
    table, as ``spark.sql.execution.topKSortFallbackThreshold`` says.
    """
    return df.orderBy(*order).limit(n)
