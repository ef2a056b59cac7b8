"""Outputs: upserts by rewriting, CSV exports, split and batched writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markweave.operators.numbering import numbered

#: Excel's cell limit and what an export keeps of a longer one.
CELL_LIMIT, CELL_KEEP = 32_767, 32_500


def upsert(old: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """The rows of new over those of old, by key; the last by `order` of repeated new
    ones. Write the result to another path than old's."""
    ranked = old.withColumn("_s", F.lit(0)).withColumn("_o", F.lit(None).cast("long"))
    fresh = new.withColumn("_s", F.lit(1)).withColumn("_o", (F.lit(0) if order is None else order).cast("long")).select(*ranked.columns)
    w = Window.partitionBy(key).orderBy(F.desc("_s"), F.desc("_o"), *[F.col(c).cast("string") for c in old.columns if c != key])
    return ranked.unionByName(fresh).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_s", "_o")


def plan_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action) of insert, update or skip, by content_hash and parse_version."""
    a = old.select(key, F.col("content_hash").alias("_h"), F.col("parse_version").alias("_v"), F.lit(True).alias("_old"))
    same = F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("parse_version").eqNullSafe(F.col("_v"))
    return new.join(a, key, "left").select(key, F.when(F.col("_old").isNull(), "insert").when(same, "skip").otherwise("update").alias("action"))


def batches(df: DataFrame, order: list[str], size: int = 200) -> DataFrame:
    """A batch number for each row; one write takes them all."""
    return numbered(df, order).withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


def gazette_csv(sections: DataFrame, columns: list[str], keep_case: str, long_column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows for the CSV in fixed order, lower case but one column, long text cut;
    the full long texts by key)."""
    cells = [F.when(F.length(c) > CELL_LIMIT, F.substring(c, 1, CELL_KEEP)).otherwise(F.col(c)).alias(c) if c == long_column else F.col(c) for c in columns]
    table = sections.select(*cells)
    low = [F.lower(c).alias(c) if t == "string" and c != keep_case else F.col(c) for c, t in table.dtypes]
    return table.select(*low), sections.where(F.length(long_column) > CELL_LIMIT).select(key, long_column)


def split_by_kind(sections: DataFrame, madrid: str) -> tuple[DataFrame, DataFrame]:
    """(domestic, Madrid) sections by a number that isn't empty."""
    is_madrid = F.coalesce(F.col(madrid), F.lit("")) != ""
    return sections.where(~is_madrid), sections.where(is_madrid)


def unique_export(marks: DataFrame, enrichment: DataFrame, key: str, order: list[Column], limit: int = 32_000) -> DataFrame:
    """Each key with its enrichment and its best row; too long cells point elsewhere."""
    from markweave.operators.linkage import best_of_each

    best = best_of_each(marks.where(F.col(key).isNotNull()), [key], order)
    out = best.join(enrichment.withColumn("enriched", F.lit(True)), key, "left").withColumn("enriched", F.coalesce("enriched", F.lit(False)))
    cells = [F.when(F.length(c) > limit, F.concat(F.lit("see "), F.col(key))).otherwise(F.col(c)).alias(c) if t == "string" else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in out.dtypes]
    return out.select(*cells)


def image_links(files: DataFrame, root: str) -> DataFrame:
    """(name, path below root) of image files."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace("path", f"^.*?{root}/?", "").alias("relative"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
