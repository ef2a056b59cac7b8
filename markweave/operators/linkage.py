"""One mark, several rows: keys, representatives and recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_key() -> Column:
    """D01."""
    return F.coalesce(F.nullif("application_number", F.lit("")), F.nullif("lineage_key", F.lit("")), F.col("id"))


def preference() -> list[Column]:
    """With a certificate, then granted, then the greatest id."""
    return [F.desc(F.col("certificate_number").isNotNull()), F.desc(F.col("vn_grant_date").isNotNull()), F.desc("id")]


def with_representative(marks: DataFrame, column: str = "is_representative", key: Column | None = None) -> DataFrame:
    """Adds the flag of the one row of each group that stands for it. key: a column
    that holds dedup_key(), by which the rows may be dealt already."""
    order = Window.partitionBy(dedup_key() if key is None else key).orderBy(*preference())
    return marks.withColumn(column, F.row_number().over(order) == 1)


def representatives(marks: DataFrame) -> DataFrame:
    """The rows that stand for their mark. Filter the result, not the input: a group
    keeps its row whatever is asked for. Marks that hold the flag already are taken as they are."""
    if "is_representative" in marks.columns:
        return marks.where("is_representative").drop("is_representative")
    return with_representative(marks).where("is_representative").drop("is_representative")


def best_of_each(rows: DataFrame, key: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def recompute(old: DataFrame, column: str = "is_representative") -> DataFrame:
    """Id and new value of the rows whose flag is to change."""
    new = with_representative(old, "_new")
    return new.where(~F.col(column).eqNullSafe(F.col("_new"))).select("id", F.col("_new").alias(column))


def recompute_scope(marks: DataFrame, keys: DataFrame, column: str = "is_representative") -> DataFrame:
    """Marks with the flag renewed for groups whose key is in keys (key) only."""
    keyed = marks.withColumn("_key", dedup_key())
    scope = keys.select(F.col("key").alias("_key"), F.lit(True).alias("_in")).distinct()
    # One pass over marks: the new flag stands beside the old one and counts inside the scope.
    rows = with_representative(keyed.join(scope, "_key", "left"), "_new", F.col("_key"))
    old = F.col(column) if column in marks.columns else F.lit(None).cast("boolean")
    return rows.withColumn(column, F.when(F.col("_in"), F.col("_new")).otherwise(old)).drop("_key", "_in", "_new")


def purge(marks: DataFrame, gazette_id: str) -> DataFrame:
    """Without a gazette's rows; groups that lose some choose again."""
    gone = marks.where(F.col("gazette_id") == gazette_id).select(dedup_key().alias("key"))
    return recompute_scope(marks.where(~F.col("gazette_id").eqNullSafe(gazette_id)), gone)


#: Shares that rows without a number are dealt to.
SALTS = 64


def with_record(rows: DataFrame, number: str, records: DataFrame, key: str) -> DataFrame:
    """rows (with an id) LEFT JOIN records ON number = key. A third of the rows may have no
    number, NULL or blank; they are dealt by their id too, not to one task."""
    none = F.coalesce(F.col(number) == "", F.lit(True))
    salt = lambda c: c.cast("int")
    left = rows.withColumn("_salt", salt(F.when(none, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0)))
    each = F.when(F.col(key) == "", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = records.withColumn("_share", F.explode(each))
    return left.join(right, (left[number] == right[key]) & (left["_salt"] == right["_share"]), "left").drop("_salt", "_share")


def others_of(marks: DataFrame, anchor_key: Column, same: Column) -> DataFrame:
    """One row for each other mark that meets `same`."""
    return representatives(marks).where(same & (dedup_key() != anchor_key))


def compare(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(changed rows of new, one row of scanned, updated, unchanged)."""
    before = old.select(F.col(key), *[F.col(c).alias(f"_old_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    joined = new.join(before, key).withColumn("_changed", differs)
    stats = joined.agg(F.count("*").alias("scanned"), F.count_if("_changed").alias("updated"), F.count_if(~F.col("_changed")).alias("unchanged"))
    return joined.where("_changed").select(*new.columns), stats
