"""How many tasks work on a table before CPU-heavy expressions run on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_count(df: DataFrame) -> int:
    """At least the configured shuffle partitions and one per core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def place(df: DataFrame, *keys: str, growth: int = 1) -> DataFrame:
    """Hash-partitions compact rows by `keys` before they are multiplied.

    The number is explicit: adaptive execution would merge partitions that are small
    now but large after the explode.  `growth` adds partitions for rows that will take
    that much more memory.
    """
    return df.repartition(task_count(df) * growth, *keys)


def spread_scan(scan: DataFrame, *keys: str) -> DataFrame:
    """A file scan as it is, or placed by key when it has fewer splits than cores.

    Large inputs have many splits and stay untouched.
    """
    splits = scan.rdd.getNumPartitions()
    return scan if splits > scan.sparkSession.sparkContext.defaultParallelism else place(scan, *keys)


def generate(df: DataFrame, keep: list, generator: Column, *names: str) -> DataFrame:
    """Rows of an outer generator (``posexplode_outer`` and the like) without its empty rows.

    The first name must be a column that the generator never makes null, such as a
    position: null elements are rows, only empty arrays are not.

    For a plain explode Spark infers a filter on the array's size and evaluates the
    array expression a second time for it; that doubles the cost of a tokenizer.
    """
    rows = df.select(*keep, generator.alias(*names))
    return rows.where(F.col(names[0]).isNotNull())
