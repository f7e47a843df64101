"""Running values down long groups without a group in one task.

Rows are range-partitioned by (group, order); each range is scanned on its own, and what a range
takes over from those before it in its group comes from a table of one row for each range and
group.  A group of any length is as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.sources.files import stored


def running(df: DataFrame, group: str, order: str, last: dict[str, Column] | None = None,
            total: dict[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with new columns: the ``last`` expressions' last non-null value, and the ``total`` expressions'
    sum, from the group's first row to this one.  ``order`` is distinct within a group."""
    last, total = last or {}, total or {}
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(df.withColumns(last | total).repartitionByRange(ranges, group, order)
                 .withColumn("_range", F.spark_partition_id()), "ranges")   # ranges are sampled: read them once
    ends = cut.groupBy("_range", group).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in last],
        *[F.sum(c).alias(f"_{c}") for c in total])
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.select("_range", group, *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in last],
                        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in total])
    here = Window.partitionBy("_range", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumns({c: F.last(c, ignorenulls=True).over(here) for c in last}
                          | {c: F.sum(c).over(here) for c in total})
    done = own.join(taken, ["_range", group]).withColumns(
        {c: F.coalesce(c, f"_{c}") for c in last} | {c: F.coalesce(c, F.lit(0)) + F.col(f"_{c}") for c in total})
    return done.select(*df.columns, *last, *total)


def first_codes(df: DataFrame, col: str, order: str) -> DataFrame:
    """(value, code): values numbered by the row that has them first (of one row, by value), nulls left out."""
    from quizloom.operators.sampling import global_position
    first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.min(order).alias("_first"))
    return global_position(first, ["_first", "value"]).select("value", F.col("position").alias("code"))
