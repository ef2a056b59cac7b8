"""Derived columns as one projection over the marks and their two registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markweave.functions.phonetics import entity_norm
from markweave.functions.text import blank_to_null, clean_text, head_before_address, mark_category, lineage_key, nice_classes, strip_note
from markweave.operators.linkage import dedup_key, with_record, with_representative

DOMESTIC = ("domestic_application", "domestic_registration")
MADRID = ("madrid_registration", "madrid_renewal")


def enriched(marks: DataFrame, domestic: DataFrame, madrid: DataFrame) -> DataFrame:
    """Marks with the domestic record by application number and the Madrid one by
    lineage, as structs d and m."""
    d = domestic.select(F.col("application_number").alias("_da"), F.struct(*domestic.columns).alias("d"))
    m = madrid.select(F.col("irn").alias("_mi"), F.struct(*madrid.columns).alias("m"))
    return with_record(marks, "application_number", d, "_da").join(m, F.col("lineage_key") == F.col("_mi"), "left").drop("_da", "_mi")


def _enriched_by_key(marks: DataFrame, domestic: DataFrame, madrid: DataFrame) -> DataFrame:
    """enriched() with _key, for marks whose lineage_key is the first number that isn't blank: a
    row's application number and lineage, where it has them, are its dedup_key(), so rows are
    dealt by that once for both joins and the representatives. A blank number is none."""
    d = domestic.select(F.col("application_number").alias("_da"), F.struct(*domestic.columns).alias("d"))
    m = madrid.select(F.col("irn").alias("_mi"), F.struct(*madrid.columns).alias("m"))
    rows, own = marks.withColumn("_key", dedup_key()), lambda c: F.col(c).eqNullSafe(F.col("_key"))
    return rows.join(d, (F.col("_key") == F.col("_da")) & own("application_number"), "left").join(m, (F.col("_key") == F.col("_mi")) & own("lineage_key"), "left").drop("_da", "_mi")


def _gated(category: Column, domestic: Column, madrid: Column) -> Column:
    return F.when(category.isin(*DOMESTIC), domestic).when(category.isin(*MADRID), madrid)


def resolved_applicant(category: Column, domestic: Column, madrid: Column, gazette: Column) -> Column:
    """The first that isn't blank of the registry's and the gazette's names, without notes."""
    first = F.coalesce(blank_to_null(_gated(category, domestic, madrid)), blank_to_null(gazette))
    return clean_text(strip_note(first))


def resolved_representative(category: Column, domestic: Column, madrid: Column, gazette: Column) -> Column:
    """As the applicant; an address glued to a Madrid name goes."""
    name = F.coalesce(blank_to_null(_gated(category, domestic, head_before_address(madrid))), blank_to_null(F.when(category.isin(*MADRID), head_before_address(gazette)).otherwise(gazette)))
    return clean_text(name)


def derive(marks: DataFrame, domestic: DataFrame, madrid: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The derivations of the whole DAG, in order; the representative flag is last as it
    reads the grant date. names (application_number, mark_sample) fill empty samples."""
    base = marks.withColumn("mark_category", mark_category(*[F.col(c) for c in ("application_number", "certificate_number", "madrid_number")]))
    base = base.withColumn("lineage_key", lineage_key(*[F.col(c) for c in ("application_number", "certificate_number", "madrid_number")]))
    if names is not None:
        base = fill_sample(base, names)
    rows, c = _enriched_by_key(base, domestic, madrid), F.col("mark_category")
    rows = rows.withColumns(
        {
            "nice_classes": nice_classes(F.col("nice_group_number")),
            "registration_date": F.coalesce("registration_date", F.when(F.col("record_type") == "B_domestic", F.col("d.grant_date")).when(F.col("record_type") == "B_madrid", F.col("m.registration_date"))),
            "applicant_clean": resolved_applicant(c, F.col("d.applicant_name"), F.col("m.holder_name"), F.col("applicant_name")),
            "representative_clean": resolved_representative(c, F.col("d.representative"), F.col("m.representative"), F.col("ip_agency")),
            "vn_grant_date": _gated(c, F.col("d.grant_date"), F.when(F.col("m.vn_status") == "granted", F.col("m.vn_grant_date"))),
            "mark_name": F.coalesce(blank_to_null(F.col("mark_sample")), blank_to_null(_gated(c, F.col("d.mark_text"), F.col("m.mark_text")))),
        }
    ).drop("d", "m")
    rows = rows.withColumns({"applicant_norm": entity_norm(F.col("applicant_clean")), "representative_norm": entity_norm(F.col("representative_clean"))})
    return with_representative(rows, key=F.col("_key")).drop("_key")


def fill_sample(marks: DataFrame, names: DataFrame) -> DataFrame:
    """A sample from the reference where there is none. A number that repeats in
    names (name_index gives each once) has its greatest sample; marks are never doubled."""
    n = names.groupBy(F.col("application_number").alias("_a")).agg(F.max("mark_sample").alias("_s"))
    return with_record(marks, "application_number", n, "_a").withColumn("mark_sample", F.coalesce(blank_to_null(F.col("mark_sample")), "_s")).drop("_a", "_s")


def overwrite_sample(marks: DataFrame, pairs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(marks with the samples of pairs (key, sample, ordinal), one row of changed); the
    last pair of a key counts."""
    last = pairs.groupBy("key").agg(F.max_by("sample", "ordinal").alias("_s"))
    joined = marks.join(last, marks[key] == last["key"], "left")
    changed = F.col("_s").isNotNull() & ~F.col("_s").eqNullSafe(F.col("mark_sample"))
    return joined.withColumn("mark_sample", F.coalesce("_s", "mark_sample")).select(*marks.columns), joined.agg(F.count_if(changed).alias("changed"))
