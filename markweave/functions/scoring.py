"""Similarity scores and conflict verdicts as Column arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five axes and their weights.
DEFAULT_WEIGHTS = {"phonetic": 0.35, "visual": 0.15, "semantic": 0.15, "class": 0.20, "vienna": 0.15}


def trigrams(c: Column) -> Column:
    """The set of trigrams of lower-cased alphanumeric words, padded by two blanks and one."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def text_trigrams(text: str) -> list[str]:
    """trigrams() of one given text, such as a query."""
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)})


def set_overlap(a: Column | str, b: Column | str) -> Column:
    """Jaccard of two sets; 0 if one is empty or NULL."""
    both, some = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.coalesce(F.size(a), F.lit(0)) == 0) | (F.coalesce(F.size(b), F.lit(0)) == 0), 0.0).otherwise(both / some)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard of trigram sets."""
    return set_overlap(trigrams(a), trigrams(b))


def best_trigram(query: Column, *columns: Column) -> Column:
    """X01 over several columns; a NULL column doesn't count."""
    scores = [F.when(c.isNotNull(), trigram_similarity(c, query)) for c in columns]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes."""
    return F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))


def visual_hash_score(a: Column, b: Column) -> Column:
    """X10, hash path: 1 at equal hashes down to 0 at ten differing bits."""
    return F.greatest(F.lit(0.0), 1 - hamming_hex(a, b) / 10)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; NULL stays, zero stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)


def semantic_score(a: Column, b: Column) -> Column:
    """X11: cosine of unit vectors from .5 to 1 as 0 to 1; 0 for missing or unequal ones."""
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fine, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) - 0.5) / 0.5)), 3)).otherwise(0.0)


def resolve_weights(overrides: dict | None) -> dict[str, float]:
    """Known, numeric, non-negative overrides over the defaults, at a sum of 1."""
    own = {k: float(v) for k, v in (overrides or {}).items() if k in DEFAULT_WEIGHTS and isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0}
    merged = DEFAULT_WEIGHTS | own
    total = sum(merged.values())
    return {k: v / total for k, v in merged.items()} if overrides and total > 0 else dict(DEFAULT_WEIGHTS)


def composite(phonetic: Column, visual: Column, semantic: Column, classes: Column, vienna: Column, by_hash: Column, weights: dict | None = None) -> Column:
    """struct(score, verdict, tone). A visual match by hash weighs double; goods count
    as far as the marks themselves are alike."""
    w = resolve_weights(weights)
    strong = by_hash & (visual >= 0.50)
    total = F.when(strong, 1.0 + w["visual"]).otherwise(1.0)
    vis = F.when(strong, 2 * w["visual"]).otherwise(w["visual"])
    mark = (w["phonetic"] * phonetic + vis * visual + w["semantic"] * semantic) / total
    alike = F.greatest(phonetic, semantic, F.when(by_hash, visual))
    ramp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (alike - 0.30) / 0.40))
    goods = (w["class"] * classes + w["vienna"] * vienna) / total * ramp
    score = F.bround(mark + goods, 3)  # ties as Python rounds them, to even
    likely, possible = _verdicts(score, alike, classes)
    return F.struct(
        score.alias("score"),
        F.when(likely, "Likely conflict").when(possible, "Possible conflict").otherwise("Low risk").alias("verdict"),
        F.when(likely, "stamp").when(possible, "warn").otherwise("ok").alias("tone"),
    )


def _verdicts(score: Column, alike: Column, classes: Column) -> tuple[Column, Column]:
    return ((score >= 0.70) & (alike >= 0.70) & (classes >= 0.30), (score >= 0.50) & (alike >= 0.50) & (classes >= 0.20))


def text_score(q: str, names: list[Column], numbers: list[Column], bag: Column) -> Column:
    """How a text search matched."""
    low = F.lit(q.strip().lower())
    same = lambda cs: [F.coalesce(F.lower(F.trim(c)) == low, F.lit(False)) for c in cs]
    inside = lambda cs: [F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in cs]

    def any_of(tests: list[Column]) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    first = [F.coalesce(F.substring(F.lower(c), 1, 3) == F.substring(low, 1, 3), F.lit(False)) for c in names]
    return (
        F.when(any_of(same(names + numbers)), 0.98)
        .when(any_of(inside(names + numbers)), 0.92)
        .when(F.coalesce(F.contains(F.lower(bag), low), F.lit(False)), 0.78)
        .when(any_of(first), 0.76)
        .otherwise(0.60)
    )


def code_matches(codes: Column, code: str) -> Column:
    """one code of the array is `code`, or below it while it has fewer than three parts."""
    test = (lambda c: (c == code) | c.startswith(f"{code}.")) if code.count(".") < 2 else (lambda c: c == code)
    return F.coalesce(F.exists(codes, test), F.lit(False))


def code_coverage(codes: Column, wanted: list[str]) -> Column:
    """Share of the wanted codes that the array has; 0 for none wanted."""
    if not wanted:
        return F.lit(0.0)
    hits = F.lit(0)
    for code in wanted:
        hits = hits + code_matches(codes, code).cast("int")
    return F.round(hits / len(wanted), 3)


def placeholder_score(key: Column, base: float = 0.78, spread: float = 0.1) -> Column:
    """A stable score from a key's hash, where no image score exists."""
    return F.round(F.lit(base) + (F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("double") / 65535 - 0.5) * spread, 3)


def wilson(passed: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high, half) of the Wilson interval; zeros for no trials."""
    p = F.try_divide(passed, n)
    bottom = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / bottom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / bottom
    zero = F.lit(0.0)
    some = n > 0
    return F.struct(
        F.when(some, F.greatest(zero, mid - half)).otherwise(zero).alias("low"),
        F.when(some, F.least(F.lit(1.0), mid + half)).otherwise(zero).alias("high"),
        F.when(some, half).otherwise(zero).alias("half"),
    )
