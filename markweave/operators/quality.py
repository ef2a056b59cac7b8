"""Data-quality checks: each is the rows that look wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markweave.functions.text import nice_classes
from markweave.operators.facets import never_true, percent
from markweave.operators.linkage import dedup_key

#: How many rows of each check are known.
BASELINES = {"Q01": 14, "Q02": 7, "Q03": 31, "Q04": 7, "Q05": None, "Q06": 0, "Q07": 0, "Q09": 0, "Q10": 0}


def row_checks() -> dict[str, Column]:
    """Q01–Q07, Q09, Q10: the test of a suspect row."""
    c = F.col
    return {
        "Q01": c("applicant_name").rlike(r"^[0-9]{6,8}(\s+\([A-Z]{2}\))?\s*$"),
        "Q02": F.trim("applicant_name").rlike(r"(?iu)^\d+[-\s]?[a-z]{2,4}[,]|^(số|no\.\s*\d|apt\s|suite\s|floor\s|lô\s|lot\s)"),
        "Q03": (c("applicant_country_code") == "VN") & (F.coalesce("applicant_city", F.lit("")) == ""),
        "Q04": (F.coalesce("mark_sample", F.lit("")) == "") & c("logo_path").isNull(),
        "Q05": (c("record_type") == "B_domestic") & c("registration_date").isNull(),
        "Q06": F.exists("nice_classes", lambda x: ~F.coalesce(x.try_cast("int").between(1, 45), F.lit(False))),
        "Q07": ~c("nice_classes").eqNullSafe(nice_classes(c("nice_group_number"))),
        "Q09": c("mark_sample").rlike(r"\(\d{3}\)"),
        "Q10": c("publication_date").isNotNull() & ((c("year") != F.year("publication_date")) | (c("month") != F.month("publication_date"))),
    }


def suspects(marks: DataFrame, check: str) -> DataFrame:
    return marks.where(F.coalesce(row_checks()[check], F.lit(False)))


def groups_without_representative(marks: DataFrame) -> DataFrame:
    """Q08."""
    return never_true(marks, dedup_key(), "is_representative")


def audit(marks: DataFrame, baselines: dict[str, int | None] = BASELINES, examples: int = 5) -> DataFrame:
    """Q11: (check, suspects, baseline, delta, regression, examples) from one scan."""
    tests = {k: t for k, t in row_checks().items() if k in baselines}
    counts = [F.count_if(F.coalesce(t, F.lit(False))).alias(f"n_{k}") for k, t in tests.items()]
    row = marks.agg(*counts)
    table = row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"n_{k}").alias("suspects"), F.lit(baselines[k]).cast("long").alias("baseline")) for k in tests])))
    shown = reduce(DataFrame.unionByName, [marks.where(F.coalesce(t, F.lit(False))).select(F.lit(k).alias("check"), "id").orderBy("id").limit(examples) for k, t in tests.items()])
    return table.join(shown.groupBy("check").agg(F.sort_array(F.collect_list("id")).alias("examples")), "check", "left").select(
        "check", "suspects", "baseline", (F.col("suspects") - F.col("baseline")).alias("delta"), (F.col("suspects") > F.col("baseline")).alias("regression"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples")
    )


def enrichment_coverage(marks: DataFrame, domestic: DataFrame, missing: DataFrame) -> DataFrame:
    """(kind, n, pct): rows with a record, known to be missing, or not tried."""
    d, m = domestic.select("application_number", F.lit(True).alias("_d")), missing.select("application_number", F.lit(True).alias("_m"))
    rows = marks.where(F.col("application_number").isNotNull()).join(d, "application_number", "left").join(m, "application_number", "left")
    kinds = rows.groupBy(F.when(F.col("_d"), "enriched").when(F.col("_m"), "not_found").otherwise("not_tried").alias("kind")).agg(F.count("*").alias("n"))
    total = kinds.agg(F.sum("n").alias("_all"))
    return kinds.join(F.broadcast(total), F.lit(True)).select("kind", "n", percent(F.col("n"), F.col("_all")).alias("pct"))


def logo_misses(marks: DataFrame, placed: DataFrame) -> DataFrame:
    """Q13: marks without a logo whose number has an image on a page."""
    return marks.where(F.col("logo_path").isNull()).join(placed.select(F.col("label").alias("lineage_key")).distinct(), "lineage_key", "left_semi")


def census(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Q14: (check, passed, failed, rate) from found (probe, id, rank) and expected (probe,
    check, id): self recall at any rank, top five for C4."""
    hit = expected.join(found, ["probe", "id"], "left").withColumn("_ok", F.when(F.col("check") == "C4", F.col("rank") <= 5).otherwise(F.col("rank").isNotNull()))
    each = hit.groupBy("probe", "check").agg(F.bool_or(F.coalesce("_ok", F.lit(False))).alias("ok"))
    n, ok = F.count("*"), F.count_if("ok")
    return each.groupBy("check").agg(ok.alias("passed"), (n - ok).alias("failed"), F.round(ok / n, 4).alias("rate"))
