"""Inputs: tables, registry CSV files, pages, files by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markweave.functions.text import blank_to_null, file_meta, short_year_date
from markweave.schemas import SCHEMAS


def table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A Parquet table, with its declared schema where it is one of the registry's."""
    reader = spark.read
    return (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).parquet(path)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """S02."""
    return df.where(F.col(key) == F.lit(value))


def _without_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """A CSV with a header; _file, _line: where a row stands in the file's order. Files are in
    the order of their names, and blocks of a file in that of their places in it."""
    raw = spark.read.csv(path, header=True, **options)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = raw.select("*", F.col("_metadata.file_name").alias("_file"), place.alias("_line"))
    return rows.toDF(*[c.lstrip("\ufeff").strip() for c in rows.columns])


def name_index(spark: SparkSession, path: str) -> DataFrame:
    """The CSV of application numbers, dates and samples; bad dates are NULL, rows
    without a number or sample go, the last row of a number wins."""
    raw = _lines(spark, path, multiLine=False, encoding="UTF-8")
    wanted = ("210 Application number", "220 Application submission date", "540 Trademark sample")
    if missing := [w for w in wanted if w not in raw.columns]:
        raise ValueError(f"the CSV has no {missing}")
    number, submitted, sample = (F.col(f"`{w}`") for w in wanted)
    rows = raw.select(blank_to_null(number).alias("application_number"), short_year_date(F.trim(submitted)).alias("submission_date"), blank_to_null(sample).alias("mark_sample"), F.struct("_file", "_line").alias("ordinal"))
    return last_of_each(rows.where("application_number IS NOT NULL AND mark_sample IS NOT NULL"), "application_number", "ordinal")


def last_of_each(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The row of each key with the greatest ordinal, which goes; taken before rows are
    shuffled, so a key of any frequency is a few rows."""
    rest = [c for c in rows.columns if c not in (key, ordinal)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("_r"))
    return best.select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in rows.columns if c != ordinal])


def madrid_id(c: Column) -> Column:
    """All-digit ids under seven digits get leading zeros."""
    return F.when(c.rlike(r"^\d{1,6}$"), F.lpad(c, 7, "0")).otherwise(c)


def per_file_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, sample, ordinal) from CSV files, whose names say which kind they
    are: A applications, B domestic certificates, or B Madrid numbers. Excel's errors are no
    values. The ordinal orders rows by file name, then by their place in the file."""
    rows = _lines(spark, path)
    name = F.col("_file")
    kind = F.when(name.rlike(r"(?i)madrid"), "madrid").when(name.rlike(r"^[Aa]_"), "application").when(name.rlike(r"^[Bb]_"), "certificate")
    first, second = (F.trim(F.col(f"`{c}`")) for c in rows.columns[:2])
    clean = F.when(~second.rlike(r"^#(N/A|NAME\?|REF!|VALUE!|DIV/0!|NULL!|NUM!)$") & (second != ""), second)
    out = rows.select(kind.alias("kind"), F.when(kind == "madrid", madrid_id(first)).otherwise(first).alias("key"), clean.alias("sample"), F.struct("_file", "_line").alias("ordinal"))
    return out.where("kind IS NOT NULL AND key <> '' AND sample IS NOT NULL")


def gazette_files(spark: SparkSession, path: str) -> DataFrame:
    """Files with their hash, size and what their names say."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), F.sha2("content", 256).alias("sha256"), "length", file_meta(name).alias("meta"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't known yet, one of each content."""
    fresh = files.join(known.select("sha256"), "sha256", "left_anti")
    first = Window.partitionBy("sha256").orderBy("path")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def cities(places: DataFrame, merged: dict[str, str], add: dict[str, list[str]], remove: dict[str, list[str]]) -> DataFrame:
    """(country, cities) from place rows (country, name, alternates): names of letters, in
    VN without the words for province and city; countries merged; overrides applied."""
    country = F.coalesce(F.create_map(*[F.lit(x) for kv in merged.items() for x in kv])[F.col("country")], F.col("country")) if merged else F.col("country")
    names = F.explode(F.concat(F.array("name"), F.split(F.coalesce("alternates", F.lit("")), ",")))
    rows = places.select(country.alias("country"), names.alias("n"))
    bare = F.when(F.col("country") == "VN", F.regexp_replace("n", r"(?iu)^(?:thành phố|tỉnh|tp\.?)\s+", "")).otherwise(F.col("n"))
    good = rows.select("country", F.trim(bare).alias("n")).where(F.col("n").rlike(r"^[\p{L}][\p{L} .'’-]{2,}$"))
    grouped = good.groupBy("country").agg(F.collect_set("n").alias("cities"))

    def lists(of: dict[str, list[str]]) -> Column:
        none = F.array().cast("array<string>")
        return F.coalesce(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("country")], none) if of else none

    return grouped.select("country", F.array_sort(F.array_except(F.array_union("cities", lists(add)), lists(remove))).alias("cities"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(key, html) of cached pages <key>.html."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html?$", 1).alias("key"), F.col("value").alias("html"))


def json_lists(spark: SparkSession, path: str) -> DataFrame:
    """Reference lists, one JSON document."""
    return spark.read.json(path, multiLine=True)


def seeded_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """N rows by the hash of key and seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, n: int) -> DataFrame:
    """The n rows that follow a key; rows with NULL keys are in no later page."""
    if after is not None:
        df = df.where(F.struct(*keys) > F.struct(*[F.lit(a) for a in after]))
        for k in keys:
            df = df.where(F.col(k).isNotNull())
    return df.orderBy(*keys).limit(n)


def source_type(name: Column, kinds: dict[str, str], forced: str | None = None) -> Column:
    """By file name prefix, else the first configured."""
    if forced:
        return F.lit(forced)
    out = F.lit(next(iter(kinds)))
    for kind, prefix in reversed(kinds.items()):
        out = F.when(F.lower(name).startswith(prefix.lower()), kind).otherwise(out)
    return out


def watchlist_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(watchlists, warnings) from a CSV whose header is matched in any case."""
    raw = _without_bom(spark.read.csv(path, header=True, quote='"', escape='"'))
    have = {c.lower(): c for c in raw.columns}
    get = lambda n: blank_to_null(F.col(f"`{have[n]}`")) if n in have else F.lit(None).cast("string")
    rows = raw.select(get("name").alias("name"), get("q").alias("q"), F.when(get("country").rlike("^[A-Za-z]{2}$"), F.upper(get("country"))).alias("country"), F.filter(F.split(F.coalesce(get("classes"), F.lit("")), r"[,;\s]+"), lambda x: x != "").alias("nice_class"))
    return rows.where("name IS NOT NULL"), rows.where("name IS NULL").withColumn("warning", F.lit("a row without a name"))
