"""One predicate builder for search, facets, lists and watchlists."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markweave.functions.scoring import code_matches


def normalize_request_code(code: str) -> str | None:
    """F08 for a request: two or three numeric parts without leading zeros, else None."""
    parts = code.strip().split(".")
    return ".".join(str(int(p)) for p in parts) if len(parts) in (2, 3) and all(p.isascii() and p.isdigit() for p in parts) else None


@dataclass(frozen=True)
class FilterSpec:
    """What a request may filter by; every field that is set adds a predicate.

    `q` is a LIKE pattern body: % and _ in it are wildcards, as the reference has them.
    """

    q: str | None = None
    country: str | None = None
    nice_class: tuple[str, ...] = ()
    nice_mode: str = "all"
    vienna: tuple[str, ...] = ()
    vienna_mode: str = "all"
    record_type: str | None = None
    mark_category: str | None = None
    applicant_type: str | None = None
    applicant: str | None = None
    ip_agency: str | None = None
    year: int | None = None
    month: int | None = None
    gazette_id: str | None = None
    designated_country: str | None = None
    vn_status: str | None = None
    granted: bool | None = None
    grant_from: date | None = None
    grant_to: date | None = None
    exclude: frozenset[str] = field(default_factory=frozenset)

    def without(self, *names: str) -> FilterSpec:
        """the same filters but a facet's own."""
        return replace(self, exclude=self.exclude | set(names))


def predicates(spec: FilterSpec) -> dict[str, Column]:
    """By field. Designations and status need their table: see apply."""
    out: dict[str, Column] = {}
    c = F.col
    if spec.q:
        like = f"%{spec.q.lower()}%"
        names = [F.lower(c(n)).like(like) for n in ("mark_sample", "mark_name")]
        numbers = [c(n).ilike(like) for n in ("application_number", "certificate_number", "madrid_number")]
        test = names[0]
        for t in names[1:] + numbers:
            test = test | t
        out["q"] = test
    if spec.country:
        out["country"] = c("applicant_country_code") == spec.country.upper()
    if spec.nice_class:
        wanted = F.array(*[F.lit(x) for x in spec.nice_class])
        out["nice_class"] = F.arrays_overlap("nice_classes", wanted) if spec.nice_mode == "any" else F.size(F.array_except(wanted, c("nice_classes"))) == 0
    codes = [n for n in map(normalize_request_code, spec.vienna) if n]
    if codes:
        test = code_matches(c("vienna_codes"), codes[0])
        for code in codes[1:]:
            more = code_matches(c("vienna_codes"), code)
            test = test | more if spec.vienna_mode == "any" else test & more
        out["vienna"] = test
    for name in ("record_type", "mark_category", "applicant_type", "year", "month", "gazette_id"):
        if (value := getattr(spec, name)) is not None:
            out[name] = c(name) == value
    if spec.applicant:
        out["applicant"] = c("applicant_name").ilike(f"%{spec.applicant}%")
    if spec.ip_agency:
        out["ip_agency"] = c("ip_agency").ilike(f"%{spec.ip_agency}%")
    if spec.granted:
        out["granted"] = c("vn_grant_date").isNotNull()
    if spec.grant_from:
        out["grant_from"] = c("vn_grant_date") >= F.lit(spec.grant_from)
    if spec.grant_to:
        out["grant_to"] = c("vn_grant_date") <= F.lit(spec.grant_to)
    return {k: v for k, v in out.items() if k not in spec.exclude}


def apply(marks: DataFrame, spec: FilterSpec, madrid: DataFrame | None = None) -> DataFrame:
    """Rows that meet the spec; F15, F16 are semi joins on the registry table."""
    for p in predicates(spec).values():
        marks = marks.where(p)
    if spec.designated_country and "designated_country" not in spec.exclude:
        hit = madrid.where(F.array_contains("designated_countries", spec.designated_country.upper()))
        marks = marks.join(hit.select(F.col("irn").alias("lineage_key")), "lineage_key", "left_semi")
    if spec.vn_status and "vn_status" not in spec.exclude:
        hit = madrid.where(F.col("vn_status") == spec.vn_status)
        marks = marks.join(hit.select(F.col("irn").alias("lineage_key")), "lineage_key", "left_semi")
    return marks


def around(anchor: Column, days: int = 60, column: str = "publication_date") -> Column:
    """F20."""
    return F.col(column).between(F.date_sub(anchor, days), F.date_add(anchor, days))


def opposition_open(today: Column, within: int | None = None, window: int = 150) -> Column:
    """published applications whose window is open, or closes within so many days."""
    left = F.datediff(F.date_add("publication_date", window), today)
    return (F.col("record_type") == "A") & ((left > 0) if within is None else left.between(0, within))


def changed(old: Column, new: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~old.eqNullSafe(new)
