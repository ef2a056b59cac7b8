"""Numbers and sums in a global order, without one task that sorts all rows or all rows of a
value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markweave.storage import saved


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in a written table, dealt to ranges of the columns, with the number of the range.
    No two rows should be equal in these, so that Spark's bounds can cut anywhere."""
    return saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")


def _bases(ranged: DataFrame, weight: Column) -> DataFrame:
    """(_part, _base): the weight of all ranges before; a row for each range, which the shuffle
    partitions bound."""
    sums = ranged.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_base"))


def sums_before(cells: DataFrame, order: list[str], weight: str, name: str = "_before") -> DataFrame:
    """Adds the sum (long) of `weight` over the rows that come before in the ascending order of
    the columns, NULL first. No two rows are equal in these columns: count equal ones first,
    so that a value of any frequency is one row."""
    ranged = _ranged(cells, order)
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_in", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    return inside.join(F.broadcast(_bases(ranged, F.col(weight))), "_part").withColumn(name, (F.col("_base") + F.col("_in")).cast("long")).drop("_part", "_in", "_base")


def numbered(rows: DataFrame, order: list[str], name: str = "_i") -> DataFrame:
    """Adds the place (long, from 0) of each row in the ascending order of the columns, NULL
    first; equal rows in any order.

    A row's number in the table that is written first parts equal rows, so a range may end
    among them and no value is one task's.
    """
    table = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ranged = _ranged(table, [*order, "_row"])
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order, "_row"))
    placed = ranged.withColumn("_in", inside).join(F.broadcast(_bases(ranged, F.lit(1))), "_part")
    return placed.withColumn(name, (F.col("_base") + F.col("_in") - 1).cast("long")).drop("_part", "_in", "_base", "_row")


def placed(rows: DataFrame, name: str = "_i", codec: str | None = None) -> DataFrame:
    """Adds a number (long, from 0, gapless) to each row, in the order of the table that is written
    first: for numbers that need no order, without a sort or a shuffle."""
    at = F.col("_row")
    # Spark numbers the rows of a partition from its number times 2^33.
    table = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "rows", codec).withColumn("_part", F.shiftright(at, 33).cast("int"))
    return table.join(F.broadcast(_bases(table, F.lit(1))), "_part").withColumn(name, F.col("_base") + at.bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_base", "_row")
