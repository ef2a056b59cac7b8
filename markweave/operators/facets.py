"""Counts over marks: facets, portfolios, coverage and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markweave.functions.text import blank_to_null
from markweave.operators.filters import FilterSpec, apply
from markweave.operators.linkage import representatives
from markweave.operators.numbering import numbered, sums_before

#: Facet limits, the years' half-months and category labels.
LIMITS = {"country": 20, "nice": 45, "applicant": 8, "ip_agency": 8}
CATEGORY_LABELS = {
    "domestic_application": "Domestic application",
    "domestic_registration": "Domestic registration",
    "madrid_registration": "Madrid registration",
    "madrid_renewal": "Madrid renewal",
    "unknown": "Unknown",
}


def top_counts(rows: DataFrame, by: Column | str, limit: int | None = None) -> DataFrame:
    """(value, n) by count, then value; NULL values don't count."""
    c = F.col(by) if isinstance(by, str) else by
    out = rows.select(c.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if limit is None else out.limit(limit)


def facet(marks: DataFrame, by: Column | str, own: str, spec: FilterSpec = FilterSpec(), limit: int | None = 20, madrid: DataFrame | None = None) -> DataFrame:
    """Counts over representatives under all filters but the facet's own."""
    return top_counts(apply(representatives(marks), spec.without(own), madrid), by, limit)


def facet_nice(marks: DataFrame, spec: FilterSpec = FilterSpec(), limit: int | None = 45, labels: DataFrame | None = None) -> DataFrame:
    """Counts of exploded classes, with labels (code, label)."""
    rows = apply(representatives(marks), spec.without("nice_class"))
    out = top_counts(rows.select(F.explode("nice_classes").alias("c")), "c", limit)
    return out if labels is None else out.join(labels, out["value"] == labels["code"], "left").select("value", "n", "label")


def facet_category(marks: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """A06."""
    label = F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv])
    return facet(marks, "mark_category", "mark_category", spec, None).withColumn("label", label[F.col("value")])


def facet_vn_status(marks: DataFrame, madrid: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Counts of the registry's status."""
    rows = apply(representatives(marks), spec.without("vn_status"), madrid)
    return top_counts(rows.join(madrid, rows["lineage_key"] == madrid["irn"]), madrid["vn_status"])


def facet_granted(marks: DataFrame, spec: FilterSpec = FilterSpec()) -> DataFrame:
    """One row."""
    return apply(representatives(marks), spec.without("granted")).agg(F.count("vn_grant_date").alias("granted"))


def facets_all(marks: DataFrame, spec: FilterSpec = FilterSpec(), limits: dict[str, int] = LIMITS) -> DataFrame:
    """(facet, value, n) of six facets from one pass over the representatives.

    Each row gives its values to the facets whose filters, but their own, it meets; one
    aggregate counts them all, so the deduplication runs once.
    """
    from markweave.operators.filters import predicates

    reps, tests = representatives(marks), predicates(spec)

    def meets(own: str) -> Column:
        out = F.lit(True)
        for name, test in tests.items():
            if name != own:
                out = out & F.coalesce(test, F.lit(False))
        return out

    def values(name: str, own: str, arr: Column) -> Column:
        return F.when(meets(own), F.transform(arr, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value"))))

    one = lambda c: F.array(F.col(c))
    parts = [
        values("country", "country", one("applicant_country_code")),
        values("nice", "nice_class", F.col("nice_classes")),
        values("applicant", "applicant", one("applicant_name")),
        values("ip_agency", "ip_agency", one("ip_agency")),
        values("mark_category", "mark_category", one("mark_category")),
        values("granted", "granted", F.array(F.when(F.col("vn_grant_date").isNotNull(), "true"))),
    ]
    none = F.array().cast("array<struct<facet:string,value:string>>")
    each = reps.select(F.inline(F.concat(*[F.coalesce(p, none) for p in parts]))).where("value IS NOT NULL")
    counts = each.groupBy("facet", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    most = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("facet")], F.lit(1 << 30))
    return counts.withColumn("_p", place).where(F.col("_p") <= most).select("facet", "value", "n")


def year_streams(marks: DataFrame) -> DataFrame:
    """A10: counts by year and stream."""
    streams = {"applications": "domestic_application", "registrations": "domestic_registration", "madrid": "madrid_registration", "renewals": "madrid_renewal"}
    return marks.groupBy("year").agg(*[F.count_if(F.col("mark_category") == v).alias(k) for k, v in streams.items()])


def totals(counts: DataFrame, columns: list[str]) -> DataFrame:
    """A11."""
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def distinct_counts(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Distinct keys by group and over all (group NULL), which groups don't add up to."""
    return rows.groupBy(by).agg(F.count_distinct(key).alias("n")).unionByName(rows.agg(F.lit(None).cast("string").alias(by), F.count_distinct(key).alias("n")))


def top_spelling(rows: DataFrame, key: Column, raw: Column, limit: int = 10) -> DataFrame:
    """(key, display, n): each group's most frequent spelling, the least of ties."""
    pairs = rows.select(key.alias("key"), raw.alias("raw")).where("key IS NOT NULL").groupBy("key", "raw").agg(F.count("*").alias("c"))
    best = F.min_by("raw", F.struct(-F.col("c"), "raw"))
    return pairs.groupBy("key").agg(best.alias("display"), F.sum("c").alias("n")).orderBy(F.desc("n"), "key").limit(limit)


def top_entities(rows: DataFrame, key: Column, raw: Column, ordinal: Column, limit: int = 10) -> DataFrame:
    """As top_spelling, ties by what was seen first."""
    pairs = rows.select(key.alias("key"), raw.alias("raw"), ordinal.alias("o")).where("key IS NOT NULL AND key <> ''").groupBy("key", "raw").agg(F.count("*").alias("c"), F.min("o").alias("o"))
    return pairs.groupBy("key").agg(F.min_by("raw", F.struct(-F.col("c"), "o")).alias("display"), F.sum("c").alias("n")).orderBy(F.desc("n"), "key").limit(limit)


def histogram(rows: DataFrame, by: str, domain: list[str]) -> DataFrame:
    """Counts of all of a domain, zeros too."""
    all_of = rows.sparkSession.sql("SELECT explode(:d) AS value", args={"d": F.array(*[F.lit(d) for d in domain])})
    counts = rows.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("c"))
    return all_of.join(counts, "value", "left").select("value", F.coalesce("c", F.lit(0)).alias("n"))


def gaps(pairs: DataFrame, slots: int = 24, limit: int = 50) -> DataFrame:
    """(year, issue) missing between the first and last years, of 1..slots issues."""
    ends = pairs.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL")
    grid = ends.select(F.explode(F.sequence("a", "b")).alias("year")).select("year", F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("issue"))
    return grid.join(pairs.select("year", "issue").distinct(), ["year", "issue"], "left_anti").orderBy("year", "issue").limit(limit)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """NULL for a whole of zero."""
    return F.round(F.try_divide(100.0 * part, whole), digits)


def coverage(universe: DataFrame, validated: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """One row of unique, validated, pending (clamped), remaining and share."""
    keys = universe.where(F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct()
    flags = keys.join(validated.select(key).distinct().withColumn("_v", F.lit(1)), key, "left").join(pending.select(key).distinct().withColumn("_p", F.lit(1)), key, "left")
    n = flags.agg(F.count("*").alias("unique_keys"), F.count("_v").alias("validated"), F.count_if(F.col("_p").isNotNull() & F.col("_v").isNull()).alias("waiting"))
    left = F.greatest(F.lit(0), F.col("unique_keys") - F.col("validated"))
    return n.select("unique_keys", "validated", F.least("waiting", left).alias("pending"), left.alias("remaining"), percent(F.col("validated"), F.col("unique_keys")).alias("pct"))


def portfolio(marks: DataFrame, applicant: str) -> DataFrame:
    """Total, pending and active marks of an applicant."""
    a = F.col("record_type") == "A"
    return representatives(marks).where(F.col("applicant_name") == applicant).agg(F.count("*").alias("total"), F.count_if(a).alias("pending"), F.count_if(~a).alias("active"))


def watch_counts(marks: DataFrame, specs: dict[str, FilterSpec], today: Column, days: int = 30) -> DataFrame:
    """A22, ST11: (name, total, new) of all watchlists from one scan."""
    from markweave.operators.filters import predicates

    def all_of(spec: FilterSpec) -> Column:
        out = F.lit(True)
        for p in predicates(spec).values():
            out = out & F.coalesce(p, F.lit(False))
        return out

    fresh = F.coalesce(F.col("publication_date") >= F.date_sub(today, days), F.lit(False))
    names = list(specs)
    row = marks.agg(*[F.count_if(all_of(specs[n])).alias(f"t{i}") for i, n in enumerate(names)], *[F.count_if(all_of(specs[n]) & fresh).alias(f"n{i}") for i, n in enumerate(names)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"t{i}").alias("total"), F.col(f"n{i}").alias("new")) for i, n in enumerate(names)])))


def this_quarter(marks: DataFrame, today: Column) -> DataFrame:
    """Marks of this quarter, by year and month, and all of the year."""
    start = (F.quarter(today) - 1) * 3 + 1
    same = F.col("year") == F.year(today)
    return marks.agg(F.count_if(same & (F.col("month") >= start)).alias("quarter"), F.count_if(same).alias("year"))


def year_summary(gazettes: DataFrame, marks: DataFrame) -> DataFrame:
    """(year, issues, marks) with zeros for gazettes without rows."""
    counts = marks.groupBy("gazette_id").agg(F.count("*").alias("_c"))
    joined = gazettes.join(counts, gazettes["id"] == counts["gazette_id"], "left")
    return joined.groupBy("issue_year").agg(F.count_distinct("issue_number").alias("issues"), F.coalesce(F.sum("_c"), F.lit(0)).alias("marks"))


def percentile_at(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """The value at index min(n-1, floor(q n)) of each group's sorted values.

    Equal values are counted first, then each has the number of rows before it in one order of
    groups and values; a group's places follow from its first. So neither a group nor a
    value is sorted by one task, and a value costs one row however frequent it is.
    """
    cells = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    placed = sums_before(cells, [*by, value], "_c", "_at")
    groups = placed.groupBy(*by).agg(F.min("_at").alias("_first"), F.sum("_c").alias("_n")).select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], "_first", "_n")
    same = F.lit(True)
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_g{i}"))
    place = F.col("_at") - F.col("_first")
    at = lambda q: F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
    holds = lambda q: (place <= at(q)) & (at(q) < place + F.col("_c"))
    return placed.join(groups, same).groupBy(*by).agg(*[F.max(F.when(holds(q), F.col(value))).alias(k) for k, q in quantiles.items()])


def retrieval_scores(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Recall, precision and F1 by group from tp, fp, fn."""
    tp, fp, fn = (F.sum(c).cast("double") for c in ("tp", "fp", "fn"))
    r, p = F.try_divide(tp, tp + fn), F.try_divide(tp, tp + fp)
    return pairs.groupBy(*by).agg(F.round(r, 4).alias("recall"), F.round(p, 4).alias("precision"), F.round(F.try_divide(2 * r * p, r + p), 4).alias("f1"))


def saturation(levels: DataFrame, slo: float, error_limit: float = 0.01) -> DataFrame:
    """The first level with a p95 over the limit or too many errors."""
    return levels.where((F.col("p95") > slo) | (F.col("errors") / F.col("requests") > error_limit)).agg(F.min("level").alias("saturation"))


def hamming_histogram(rows: DataFrame, hash_column: str, order: str) -> DataFrame:
    """Differing bits of consecutive pairs, with a running share."""
    from markweave.functions.scoring import hamming_hex

    cells = numbered(rows.where(F.col(hash_column).isNotNull()), [order])
    pair = cells.groupBy(F.floor(F.col("_i") / 2).alias("_k")).agg(F.min_by(hash_column, "_i").alias("a"), F.max_by(hash_column, "_i").alias("b"), F.count("*").alias("_c")).where("_c = 2")
    bits = pair.groupBy(hamming_hex(F.col("a"), F.col("b")).alias("distance")).agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.orderBy("distance")) / F.sum("n").over(Window.partitionBy())
    return bits.select("distance", "n", F.round(100 * share, 2).alias("cumulative"))


def check_report(results: DataFrame) -> DataFrame:
    """Passes, fails, other and pass rate over pass and fail, by check."""
    ok, bad = F.count_if(F.col("status") == "pass"), F.count_if(F.col("status") == "fail")
    return results.groupBy("check").agg(ok.alias("passed"), bad.alias("failed"), (F.count("*") - ok - bad).alias("other"), F.round(F.try_divide(ok.cast("double"), ok + bad), 4).alias("rate"))


def never_true(rows: DataFrame, key: Column, flag: str) -> DataFrame:
    """Groups in which the flag is true nowhere."""
    return rows.groupBy(key.alias("key")).agg(F.bool_or(F.coalesce(F.col(flag), F.lit(False))).alias("_any")).where("NOT _any").select("key")


def unresolved(universe: DataFrame, known: list[DataFrame], key: str, order: list[Column], fetchable: Column, sample: int = 50) -> DataFrame:
    """First rows of keys in none of the known tables, malformed or fetchable; the
    sample is the feature."""
    from markweave.operators.linkage import best_of_each

    left = universe.where(blank_to_null(F.col(key)).isNotNull())
    for k in known:
        left = left.join(k.select(key).distinct(), key, "left_anti")
    return best_of_each(left, [key], order).withColumn("kind", F.when(fetchable.isNull(), "malformed").otherwise("fetchable")).orderBy("kind", key).limit(sample)
