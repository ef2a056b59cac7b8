"""Search, similar marks, comparison and watchlist findings over marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markweave.functions import phonetics
from markweave.functions.scoring import code_coverage, composite, semantic_score, set_overlap, text_score, text_trigrams, trigram_similarity, trigrams, visual_hash_score
from markweave.operators.filters import FilterSpec, apply, normalize_request_code
from markweave.operators.linkage import best_of_each, dedup_key, preference, representatives
from markweave.plans.name_postings import NameIndex
from markweave.storage import saved, scratch, sized

#: Candidates that a recall hands on, the trigram threshold, and the days before
#: and after an anchor that make its period.
RECALL, SIMILAR, FIGURATIVE, THRESHOLD, PERIOD = 1000, 50, 40, 0.15, 60


def by_publication(nulls_first: bool = False) -> list[Column]:
    """O01, O02."""
    return [F.desc_nulls_first("publication_date") if nulls_first else F.desc_nulls_last("publication_date"), F.asc("id")]


def sort_keys(sort: str) -> list[Column]:
    """O03, O04."""
    keys = {
        "similarity": [F.desc("score"), F.asc("id")],
        "date": by_publication(),
        "applicant": [F.asc_nulls_last("applicant_name"), F.asc("id")],
        "classes": [F.desc_nulls_last(F.size("nice_classes")), F.asc("id")],
    }
    return keys[sort]


def page(rows: DataFrame, keys: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in order."""
    return rows.orderBy(*keys).offset(offset).limit(limit)


def capped(rows: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The n first rows as they leave the recall, before a costly score."""
    return rows.orderBy(*keys).limit(n)


def overfetched(rows: DataFrame, keys: list[Column], limit: int, offset: int, kept: Column) -> DataFrame:
    """A page of what a score keeps of a window of twice the rows that it needs, so that
    a page costs the same however many rows there are; later rows are left to later pages."""
    return page(capped(rows, keys, 2 * max(limit + offset, limit)).where(kept), keys, limit, offset)


def deduped(rows: DataFrame) -> DataFrame:
    """Filter first, then one row of each mark."""
    return best_of_each(rows, [dedup_key()], preference())


def search_text(marks: DataFrame, q: str, spec: FilterSpec = FilterSpec(), threshold: float = 0.4) -> DataFrame:
    """Text mode: literal match, one row a mark, X15 scores over the threshold."""
    from dataclasses import replace

    hits = deduped(apply(marks, replace(spec, q=q)))
    names = [F.col("mark_sample"), F.col("mark_name")]
    numbers = [F.col(c) for c in ("application_number", "certificate_number", "madrid_number")]
    bag = F.concat_ws(" ", "applicant_name", "ip_agency")
    return hits.withColumn("score", text_score(q, names, numbers, bag)).where(F.col("score") >= threshold)


NAMES = ("mark_sample", "mark_name")


def names_of(marks: DataFrame) -> DataFrame:
    """(name) of each distinct name of marks, of which a NameIndex is built."""
    return marks.select(F.explode(F.array(*NAMES)).alias("name")).where("name IS NOT NULL").distinct()


def recall_names(marks: DataFrame, q: str, index: NameIndex | None = None) -> DataFrame:
    """Rows of marks with a name that shares trigrams with q or sounds like it,
    with _t, the best trigram similarity of the two names. Names are found once each in the
    lists of a NameIndex of marks or more; without one, one is built for the call. Marks meet
    the names that match in one pass, as long as these are few enough to broadcast."""
    spark = marks.sparkSession
    index = NameIndex.build(names_of(marks), scratch(spark, "names")) if index is None else index
    hits = sized(saved(index.recall(q, THRESHOLD), "hits"), 100)
    rows = marks
    for c in NAMES:
        rows = rows.join(hits.select(F.col("name").alias(f"_n_{c}"), F.col("t").alias(f"_t_{c}")), F.col(c) == F.col(f"_n_{c}"), "left")
    found = rows.where(F.coalesce(*[f"_t_{c}" for c in NAMES]).isNotNull())
    # A name that didn't match has a similarity of its own.
    grams = F.array(*map(F.lit, text_trigrams(q))).cast("array<string>")
    each = [F.when(F.col(c).isNotNull(), F.coalesce(f"_t_{c}", set_overlap(trigrams(F.col(c)), grams))) for c in NAMES]
    return found.withColumn("_t", F.greatest(*each)).select(*marks.columns, "_t")


def search_sound(marks: DataFrame, q: str, spec: FilterSpec = FilterSpec(), threshold: float = 0.4, index: NameIndex | None = None) -> DataFrame:
    """Phonetic mode: trigram or sound recall, one row a mark, X09 scores over the threshold."""
    recalled = recall_names(apply(marks, spec.without("q")), q, index)
    found = deduped(capped(recalled, [F.desc("_t"), F.asc("id")], RECALL)).drop("_t")
    score = F.greatest(*[phonetics.phonetic_similarity(F.lit(q), c) for c in NAMES])
    return found.withColumn("score", score).where(F.col("score") >= threshold)


def search_codes(marks: DataFrame, codes: list[str], spec: FilterSpec = FilterSpec()) -> DataFrame:
    """Vienna mode: representatives by the share of codes they have (X16); the threshold does
    not hold here, nor in the plain filter mode."""
    wanted = [c for c in map(normalize_request_code, codes) if c]
    return apply(representatives(marks), spec.without("q")).withColumn("score", code_coverage(F.col("vienna_codes"), wanted))


def search_filters(marks: DataFrame, spec: FilterSpec) -> DataFrame:
    """No target: representatives that meet the filters, at score 1."""
    return apply(representatives(marks), spec).withColumn("score", F.lit(1.0))


def result_total(found: DataFrame) -> DataFrame:
    """Text and sound modes count what passed dedup and threshold; the others count
    representatives, whatever the threshold."""
    return found.agg(F.count("*").alias("total"))


def pair_score(a: str, b: str, phonetic: Column, weights: dict | None = None) -> Column:
    """The struct of the five axes and the verdict for columns with prefixes a and b."""
    c = lambda p, n: F.col(f"{p}{n}")
    hashed = c(a, "logo_phash").isNotNull() & c(b, "logo_phash").isNotNull() & ~F.coalesce((c(a, "logo_kind") == "wordmark") | (c(b, "logo_kind") == "wordmark"), F.lit(False))
    visual = F.when(hashed, visual_hash_score(c(a, "logo_phash"), c(b, "logo_phash"))).otherwise(phonetics.token_similarity(c(a, "mark_sample"), c(b, "mark_sample")))
    semantic = semantic_score(c(a, "mark_embedding"), c(b, "mark_embedding"))
    classes, vienna = set_overlap(c(a, "nice_classes"), c(b, "nice_classes")), set_overlap(c(a, "vienna_codes"), c(b, "vienna_codes"))
    return F.struct(
        phonetic.alias("phonetic"),
        F.round(visual, 3).alias("visual"),
        semantic.alias("semantic"),
        classes.alias("classes"),
        vienna.alias("vienna"),
        composite(phonetic, visual, semantic, classes, vienna, hashed, weights).alias("result"),
    )


AXES = ("id", "mark_sample", "nice_classes", "vienna_codes", "logo_phash", "logo_kind", "mark_embedding")


def scored_pairs(pairs: DataFrame, weights: dict | None = None) -> DataFrame:
    """X21 for rows with a_ and b_ columns of AXES."""
    heard = pairs.withColumn("_p", phonetics.phonetic_similarity("a_mark_sample", "b_mark_sample"))
    return heard.withColumn("scores", pair_score("a_", "b_", F.col("_p"), weights)).drop("_p")


def similar_marks(marks: DataFrame, anchor_id: str, limit: int = 4, weights: dict | None = None, cap: int = SIMILAR, index: NameIndex | None = None) -> DataFrame:
    """Marks that conflict with the anchor, best first: those published within PERIOD days of
    it, recalled by name, or for an anchor without one by a common class; five axes; low risks
    go. The anchor is one row. An unknown anchor gives none."""
    word = F.trim(F.coalesce(F.nullif("mark_name", F.lit("")), F.col("mark_sample"), F.lit("")))
    anchor = marks.where(F.col("id") == anchor_id).select(*AXES, word.alias("word"), "publication_date").limit(1)
    a = anchor.first()
    pool = marks.where(F.col("id") != anchor_id)
    if a is None:
        pool = pool.limit(0)
    elif a.publication_date is not None:
        pool = pool.where(F.abs(F.datediff("publication_date", F.lit(a.publication_date))) <= PERIOD)
    if a is None or a.word:
        order = [F.desc("_t"), F.asc("id")]
        found = capped(recall_names(pool, a.word if a else "", index), order, cap)
    else:
        order = [F.desc_nulls_first("publication_date"), F.asc("id")]
        named = pool.where("mark_sample IS NOT NULL")
        found = capped(named.where(F.arrays_overlap("nice_classes", F.array(*map(F.lit, a.nice_classes)))) if a.nice_classes else named, order, FIGURATIVE)
    ranked = found.withColumn("_place", F.row_number().over(Window.orderBy(*order))).withColumn("mark_sample", word)  # at most cap rows
    left = anchor.withColumn("mark_sample", F.col("word")).select(*[F.col(c).alias(f"a_{c}") for c in AXES])
    pairs = ranked.select("_place", *[F.col(c).alias(f"b_{c}") for c in AXES]).join(F.broadcast(left), F.lit(True))
    risky = scored_pairs(pairs, weights).where("scores.result.verdict <> 'Low risk'")
    return risky.orderBy(F.desc("scores.result.score"), "_place").limit(limit).drop("_place")


def name_neighbours(names: DataFrame, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """J13 over a whole corpus: (a, b, similarity) of names with a < b, by a trigram prefix
    join. A pair at the threshold shares one of the |x| - ceil(t |x|) + 1 rarest trigrams of
    each name, so only those are posted; the rarest come first, which keeps posting lists
    short. At a low threshold most pairs of a corpus are its result, and no plan makes that
    small: NameIndex.neighbours() takes the names that are asked about."""
    grams = names.where(F.col(name).isNotNull()).select(F.col(name).alias("_n")).distinct()
    sets = grams.withColumn("_g", trigrams(F.col("_n"))).where(F.size("_g") > 0)
    freq = sets.select(F.explode("_g").alias("g")).groupBy("g").agg(F.count("*").alias("c"))
    ranked = sets.select("_n", F.size("_g").alias("s"), F.explode("_g").alias("g")).join(freq, "g")
    place = F.row_number().over(Window.partitionBy("_n").orderBy("c", "g"))
    posts = ranked.withColumn("p", place).where(F.col("p") <= F.col("s") - F.ceil(F.lit(threshold) * F.col("s")) + 1).select("g", "_n", "s", "p")
    x, y = (posts.select("g", F.col("_n").alias(n), F.col("s").alias(f"s{n}"), F.col("p").alias(f"p{n}")) for n in "ab")
    # The trigrams that both can still have, this one and those behind it, must be enough.
    left = 1 + F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb")) + F.least("pa", "pb") - 1
    enough = left >= (F.col("sa") + F.col("sb")) * threshold / (1 + threshold) - 1e-9
    near = (F.col("sa") >= F.lit(threshold) * F.col("sb")) & (F.col("sb") >= F.lit(threshold) * F.col("sa"))
    pairs = x.join(y, "g").where((F.col("a") < F.col("b")) & near & enough).select("a", "b").distinct()
    return pairs.withColumn("similarity", trigram_similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= threshold)


def compare_marks(marks: DataFrame, ids: list[str], anchor: str, weights: dict | None = None) -> DataFrame:
    """The anchor against each of two or three marks; the phone axis falls back to the
    applicant where a mark has no name."""
    if not 2 <= len(ids) <= 3 or anchor not in ids:
        raise ValueError("two or three ids, one of which is the anchor")
    named = marks.where(F.col("id").isin(ids)).withColumn("mark_sample", F.coalesce("mark_sample", "applicant_name")).select(*AXES)
    a = named.where(F.col("id") == anchor).limit(1).select(*[F.col(c).alias(f"a_{c}") for c in AXES])
    b = named.where(F.col("id") != anchor).select(*[F.col(c).alias(f"b_{c}") for c in AXES])
    return scored_pairs(b.join(F.broadcast(a), F.lit(True)), weights)


def co_marks(marks: DataFrame, applicant: str, anchor_key: str, limit: int = 6) -> DataFrame:
    """Other marks of an applicant, undated ones first."""
    from markweave.operators.linkage import others_of

    return others_of(marks, F.lit(anchor_key), F.col("applicant_name") == applicant).orderBy(*by_publication(nulls_first=True)).limit(limit)


def opposition_list(marks: DataFrame, today: Column, limit: int = 20, window: int = 150) -> DataFrame:
    """Open windows by the days left."""
    left = F.datediff(F.date_add("publication_date", window), today)
    rows = marks.where((F.col("record_type") == "A") & (left >= 0)).withColumn("days_left", left)
    return rows.orderBy("days_left", "id").limit(limit)


def findings(marks: DataFrame, watchlists: dict[str, FilterSpec], limit: int = 8) -> DataFrame:
    """Marks that a watchlist finds, by the first list that has them, best score first."""
    from functools import reduce

    from markweave.functions.scoring import placeholder_score

    lists = [apply(marks, spec).select("id", dedup_key().alias("key"), "publication_date", F.lit(i).alias("ordinal"), F.lit(name).alias("watchlist")) for i, (name, spec) in enumerate(watchlists.items())]
    every = reduce(DataFrame.unionByName, lists)
    first = best_of_each(every, ["key"], [F.asc("ordinal"), F.desc_nulls_first("publication_date"), F.asc("id")])
    return first.withColumn("score", placeholder_score(F.col("id"))).orderBy(F.desc("score"), "id").limit(limit)
