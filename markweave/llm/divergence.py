"""How far the sources of a language lie apart in the words that they use, term by term.

Words are counted where texts are read, and a task sends one row for each term of a group
that it met. A term's smoothed share in a group is an integer p; with z the p of a term that
the group never uses, the distance of two groups is a sum over terms of |p - p'|. Terms are
split by the number of groups that use them:

* light: each is in at most LIGHT groups, so its posting list makes a bounded number of pairs.
  What one group of a pair uses is corrected from its numbers of terms by frequency, as if
  the other used none of them, and what both use by posting pairs;
* heavy: dense numpy tiles, terms by groups, which are compared column by column. A tile
  holds a part of the terms and two parts of the groups.

The sum starts as if each term were used by neither group, |z - z'|, and both parts add how
much the terms in use differ from that. All are integers, so their total is exact in any order.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markweave.llm.common import saved, sized

#: A term is kept in a language that has it in so many documents; ranks of a group's own terms.
MIN_DOCS, TOP_TERMS = 30, 50
#: p = 1 + SCALE * (count + PRIOR) div (N + PRIOR * V).
SCALE, PRIOR = 1_000_000_000, 5
#: Groups that a light term is in at most; terms and groups of a tile on average.
LIGHT, TILE_TERMS, TILE_GROUPS = 8, 512, 64
#: Counts that a task holds before it sends them on; bytes of a text that are split at once.
HELD, SLICE = 300_000, 8 << 20
#: Bytes of UTF-8: letters, small ones for A-Z, and all of other scripts; the rest part terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts and numbers of documents. Each group that
    a task met also has a row of the term '', with the group's documents. A null text, lang
    or source is ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        met: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                terms, of = list(own), met[lang, source]
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    columns = [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([own[t] for t in part], pa.int64()), pa.array([of[t] for t in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            n.clear()
            met.clear()

        held = 0
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                words, at, flat = Counter(), 0, text.as_py()
                while at < len(flat):
                    # A slice ends where a term does.
                    end, part = at + SLICE, flat[at : at + SLICE].translate(TERM_BYTES)
                    if end < len(flat) and not part.endswith(b" "):
                        rest = flat[end:].translate(TERM_BYTES).partition(b" ")[0]
                        part, end = part + rest, end + len(rest)
                    words.update(part.split())
                    at = end
                own, of = n[lang, source], met[lang, source]
                held -= len(own)
                own.update(words)
                of.update(words.keys())
                own[b""] += 0
                of[b""] += 1
                held += len(own)
                if held > HELD:
                    yield from rows()
                    held = 0
        yield from rows()

    blank = lambda c: F.coalesce(docs[c], F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n: str, total: str, v: str = "v") -> Column:
    """p of a count among total of v terms, exact where a product of longs would not be; null
    where the language keeps no terms."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1L + (CAST({SCALE} AS decimal(18,0)) * (CAST({n} AS decimal(19,0)) + {PRIOR})) div (CAST({total} AS decimal(19,0)) + {PRIOR}L * {v}) END")


def group_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, groups, first): kept terms by group, with the language's
    count, the number of groups that use the term, and whether this is the first of them. A
    row of the term '' stands for each group."""
    # One shuffle, by language and term, serves the counts and what is said of the term.
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    marked = counts.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"), F.count("*").over(term).alias("groups"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return marked.where((F.col("term") == "") | (F.col("lang_docs") >= min_docs)).drop("lang_docs")


def groups_of(terms: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v, z): one row per group of group_terms()."""
    real = F.col("term") != ""
    langs = terms.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("lang_total"), F.count_if(real & F.col("first")).alias("v"))
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    return own.join(langs, F.col("lang") == F.col("_lang")).select("lang", "source", "total", "lang_total", "v", share("0", "total").alias("z"))


def light_pairs(shares: DataFrame) -> DataFrame:
    """(lang, a, b, value): corrections for terms that groups a < b both use, from posting
    lists of at most LIGHT groups."""
    lists = shares.where(f"groups BETWEEN 2 AND {LIGHT}").groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("l"))
    fix = "abs(x.p - y.p) - abs(x.p - y.z) - abs(x.z - y.p) + abs(x.z - y.z)"
    pairs = F.expr(f"flatten(transform(l, (x, i) -> transform(slice(l, i + 2, {LIGHT}), y -> struct(x.source AS a, y.source AS b, {fix} AS value))))")
    return lists.select("lang", F.inline(pairs)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def one_sided(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): corrections for the light terms that one group of a pair uses, as if
    the other did not, both ways. A group's terms of one frequency are one row; as p > z for
    a term in use, all but those under the other group's z are a plain difference."""
    used = shares.where(f"groups <= {LIGHT}").groupBy("lang", "source", "p", "z").agg(F.count("*").alias("m"))
    plain = used.groupBy("lang", F.col("source").alias("one")).agg(F.sum(F.expr("m * (p - z)")).alias("d"), F.sum("m").alias("m"), F.min("z").alias("z"))
    others = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("other"), F.col("z").alias("oz"))
    small = sized(others, F.lit(100))
    # m(|p - oz| - |z - oz|) = m(p - oz) + 2m max(0, oz - p) - m|z - oz|
    straight = plain.join(small, (F.col("lang") == F.col("_lang")) & (F.col("one") != F.col("other"))).select("lang", "one", "other", F.expr("d + m * (z - oz) - m * abs(z - oz)").alias("value"))
    above = used.join(small, (F.col("lang") == F.col("_lang")) & (F.col("source") != F.col("other")) & (F.col("p") < F.col("oz"))).select("lang", F.col("source").alias("one"), "other", F.expr("2 * m * (oz - p)").alias("value"))
    both = straight.unionByName(above)
    return both.groupBy("lang", F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).agg(F.sum("value").alias("value"))


def heavy_tiles(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the sums of |p - p'| - |z - z'| over the terms of more than LIGHT
    groups; terms that no group of a tile uses add nothing to it.

    A tile is a part of a language's terms against two parts of its groups, chosen by hashes.
    The groups' z fill the places of terms that they don't use."""
    heavy = shares.where(f"groups > {LIGHT}")
    sizes = heavy.where("first").groupBy("lang").count().join(groups.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("s")), F.col("lang") == F.col("_lang"))
    parts = sizes.select(F.col("_lang"), F.ceil(F.col("count") / TILE_TERMS).alias("term_parts"), F.ceil(F.col("s") / TILE_GROUPS).alias("group_parts"))
    small = sized(saved(parts, "tile-parts"), F.lit(50))
    rows = heavy.select("lang", "source", "term", "p").join(small, F.col("lang") == F.col("_lang")).withColumn("tile", F.pmod(F.xxhash64("term"), "term_parts"))
    fill = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("z").alias("p")).join(small, F.col("lang") == F.col("_lang")).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_parts") - 1)))
    part = F.pmod(F.xxhash64("source"), "group_parts")
    met = rows.unionByName(fill).withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_parts") - 1)))
    tiles = met.select("lang", "tile", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "source", "term", "p", "part")

    def compare(table: pa.Table) -> pa.Table:
        source, term = table.column("source").combine_chunks().dictionary_encode(), table.column("term").combine_chunks().dictionary_encode()
        names, at = source.dictionary.to_pylist(), source.indices.to_numpy()
        low, high, part = (table.column(c)[0].as_py() if c != "part" else table.column(c).to_numpy() for c in ("low", "high", "part"))
        p, z = table.column("p").to_numpy(), term.indices.is_null().to_numpy(zero_copy_only=False)
        dense = np.empty((len(term.dictionary), len(names)), np.int64)
        base = np.zeros(len(names), np.int64)
        base[at[z]] = p[z]
        dense[:] = base
        dense[term.indices.drop_null().to_numpy(), at[~z]] = p[~z]
        side = np.zeros(len(names), np.int64)
        side[at] = part
        out = ([], [], [])
        for i in np.flatnonzero(side == low):
            others = np.flatnonzero(side == high)
            others = others[others > i] if low == high else others
            apart = np.abs(dense[:, others] - dense[:, [i]]).sum(axis=0) - len(dense) * np.abs(base[others] - base[i])
            for j, v in zip(others, apart, strict=True):
                for column, x in zip(out, (*sorted((names[i], names[j])), int(v)), strict=True):
                    column.append(x)
        lang = pa.array([table.column("lang")[0].as_py()] * len(out[0]), pa.string())
        return pa.Table.from_arrays([lang, pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["lang", "a", "b", "value"])

    sums = tiles.groupBy("lang", "tile", "low", "high").applyInArrow(compare, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value (long), rank (int), for every group of a lang and source.

    part `pair`: item is each other source of the language, value the sum over the kept terms
    of |p - p'|; 0 where the language keeps none. part `term`: item is a term that the group
    uses more than its language does, value p less the language's p; the first top_terms.
    Rank is by value, the largest first, and item. A null text, lang or source is ''; every
    row is a document, also one that repeats another or its id; an empty table gives no
    rows. Other columns of docs are not used, whatever their names.
    """
    terms = saved(group_terms(docs, min_docs), "group-terms")
    groups = saved(groups_of(terms), "groups")
    stats = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "total", "lang_total", "v", "z")
    used = terms.where("term <> ''").join(sized(stats, F.octet_length("_lang") + F.octet_length("_source") + 60), (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
    shares = saved(used.select("lang", "source", "term", "groups", "first", "z", share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q")), "shares")
    own = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    a, b = groups.select("lang", F.col("source").alias("a"), "z", "v"), groups.select(F.col("lang").alias("_lang"), F.col("source").alias("b"), F.col("z").alias("oz"))
    start = a.join(sized(b, F.octet_length("b") + 40), (F.col("lang") == F.col("_lang")) & (F.col("a") < F.col("b"))).select("lang", "a", "b", F.coalesce(F.expr("v * abs(z - oz)"), F.lit(0).cast("long")).alias("value"))
    pairs = start.unionByName(light_pairs(shares)).unionByName(one_sided(shares, groups)).unionByName(heavy_tiles(shares, groups)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = pairs.select("lang", "value", F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.lit("pair").alias("part"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))])))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    best = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return ways.withColumn("rank", F.row_number().over(order)).unionByName(best).select("lang", "source", "part", "item", "value", "rank")
