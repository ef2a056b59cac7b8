"""Quality rules over whole texts, and cross-document line frequency.

Everything is DataFrame expressions. Per-document counts are one pass without a shuffle.
Line frequency hashes normalised lines (A-Z lower-cased, white space taken out), counts
distinct documents per host (`source`) and line with pre-aggregation, and removes a line
above its host's limit; a document that is left with too little is rejected. The first
document of a host that holds a line keeps it, so that of a family of copies, however
large, one stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markweave.llm.common import WS, saved, sized, text_of

WORD, SYMBOLS, RUN = rf"[^{WS}]+", r"[#*$%&|<>]", 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A line is above the limit in more than both: so many documents of its host, and such a share.
LINE_DOCS, LINE_SHARE = 10, 0.02
#: A document is depleted if removed lines leave less than this share of its word characters.
LEFT_SHARE = 0.3
COUNTS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rows of a table that may be broadcast (some 10 MB); a larger one is joined by a shuffle,
#: in which the lines of a hot key are dealt over so many tasks.
BROADCAST_ROWS, SALTS = 200_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, rf"[{WS}]+", -1), lambda w: w != "")


def _doc_key(docs: DataFrame) -> Column:
    """A document is an id with a text: rows that repeat both are one document."""
    return F.xxhash64(docs["doc_id"], text_of(docs), F.length(text_of(docs)))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)
    and doc_key of every row; a null text has no words and no lines with one."""
    base = docs.select(docs["doc_id"], docs["source"], text_of(docs).alias("_t"), _doc_key(docs).alias("doc_key"))
    split = base.select(
        "doc_id",
        "source",
        "doc_key",
        F.length(F.regexp_replace("_t", rf"[{WS}]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)).alias("_lines"),
        F.transform(_words(F.col("_t")), lambda w: F.xxhash64(w)).alias("_w"),
    )
    hashed = split.select(
        "doc_id",
        "source",
        "doc_key",
        F.size("_w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"""CASE WHEN size(_w) > {RUN} THEN transform(sequence(0, size(_w) - {RUN}),
            i -> xxhash64({', '.join(f'_w[i + {k}]' for k in range(RUN))})) ELSE cast(array() AS array<bigint>) END""").alias("_h"),
    )
    # Sorting (hash, place) brings repeats together; texts without any skip it.
    marked = hashed.withColumn(
        "_s",
        F.expr("""CASE WHEN size(array_distinct(_h)) < size(_h)
            THEN array_sort(transform(_h, (h, i) -> struct(h, i))) ELSE cast(array() AS array<struct<h:bigint,i:int>>) END"""),
    )
    near = marked.withColumn(
        "_at",
        F.expr("""array_sort(transform(filter(
            zip_with(zip_with(_s, slice(concat(array(cast(null AS struct<h:bigint,i:int>)), _s), 1, size(_s)), (x, y) -> struct(x.h AS h, x.i AS i, y.h AS p)),
                     concat(slice(_s, 2, size(_s)), array(cast(null AS struct<h:bigint,i:int>))),
                     (x, y) -> struct(x.h AS h, x.i AS i, x.p AS p, y.h AS n)),
            z -> z.h = z.p OR z.h = z.n), z -> z.i))"""),
    )
    covered = F.expr(f"""CASE WHEN size(_at) = 0 THEN 0L ELSE {RUN}L + aggregate(
        zip_with(slice(_at, 2, size(_at)), slice(_at, 1, size(_at) - 1), (x, y) -> least({RUN}, x - y)), 0L, (s, x) -> s + x) END""")
    return near.select("doc_id", "source", "doc_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, doc_key, pos, line_hash, chars): the lines with a word of each row, and
    a row without a line_hash for the row itself. chars: code points without white space."""
    text = F.translate(text_of(docs), UPPER + " \t\v\f\r", LOWER)
    line = lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x, F.length(x)).alias("line_hash"), F.length(x).alias("chars"))
    marker = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("line_hash"), F.lit(0).alias("chars"))
    lines = F.filter(F.transform(F.split(text, "\n", -1), line), lambda x: x["chars"] > 0)
    # The key is made below the generator: beside it, it would be made for each line.
    rows = docs.select(docs["doc_id"], docs["source"], _doc_key(docs).alias("doc_key"), F.array_append(lines, marker).alias("_lines"))
    return rows.select("doc_id", "source", "doc_key", F.inline("_lines"))


def frequent_lines(lines: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(source, line_hash, n_docs, first): the lines of document_lines() in more than line_docs
    documents and more than line_share of the documents of their host; first is the doc_key of
    the document with the least id (a null one before all) that holds it."""
    holders = lines.select("source", "line_hash", "doc_id", "doc_key").distinct()
    counts = holders.groupBy("source", "line_hash").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "doc_key")).alias("_f"))
    above = counts.where(F.col("line_hash").isNotNull() & (F.col("n_docs") > line_docs))
    hosts = counts.where("line_hash IS NULL").select(F.col("source").alias("_host"), F.col("n_docs").alias("n_host"))
    return (
        above.join(hosts, F.col("source").eqNullSafe(F.col("_host")))
        .where(F.col("n_docs") > F.lit(line_share) * F.col("n_host"))
        .select("source", "line_hash", "n_docs", F.col("_f")["doc_key"].alias("first"))
    )


def removed_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """(_d, _s, _k, places, _removed): documents that lose lines, by doc_id, source and doc_key,
    with the numbers of those lines and their characters."""
    lines = saved(document_lines(docs), "lines")
    frequent = saved(frequent_lines(lines, line_docs, line_share), "frequent-lines")
    keys = frequent.select(F.col("source").alias("_host"), F.col("line_hash").alias("_line"), "first")
    same = (F.col("line_hash") == F.col("_line")) & F.col("source").eqNullSafe(F.col("_host"))
    if frequent.count() <= BROADCAST_ROWS:
        hit = lines.join(F.broadcast(keys), same)
    else:
        salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.withColumn("_of", F.pmod("doc_key", F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_of") == F.col("_salt")))
    # Equal rows hold the same lines at the same places, which count once.
    lost = hit.where(F.col("doc_key") != F.col("first")).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("doc_key").alias("_k"))
    found = lost.agg(F.collect_set(F.struct("pos", "chars")).alias("_lost"))
    return found.select("_d", "_s", "_k", F.col("_lost")["pos"].alias("places"), F.aggregate("_lost", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("_removed"))


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, left_share: float = LEFT_SHARE) -> DataFrame:
    """document_counts with base_failed, n_removed_chars, kept (boolean) and places (numbers of
    the lines that go; null for none).

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows. Kept
    is false for those and for documents that removed lines leave with less than left_share
    of their word_chars. A null source is a host of its own. A document is a doc_id with a
    text, so rows that repeat both count once and are judged alike, and rows with one id and
    different texts, or a null id, by their own. An empty table gives no rows; columns of
    docs other than doc_id, source and text are not used. source and doc_key come along.
    """
    removed = removed_lines(docs, line_docs, line_share)
    counts = document_counts(docs)
    same = (counts["doc_key"] == F.col("_k")) & counts["doc_id"].eqNullSafe(F.col("_d")) & counts["source"].eqNullSafe(F.col("_s"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("word_chars") - F.col("n_removed_chars")
    return (
        counts.join(removed, same, "left")
        .withColumn("n_removed_chars", F.coalesce("_removed", F.lit(0)).cast("long"))
        .select(*COUNTS, "source", "doc_key", failed.alias("base_failed"), "n_removed_chars", (~failed & (left >= F.lit(left_share) * F.col("word_chars"))).alias("kept"), "places")
    )


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """The documents that judge() keeps, with their columns and without the lines that go."""
    verdict = judge(docs, **params).where("NOT kept OR places IS NOT NULL")
    edits = saved(verdict.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("doc_key").alias("_k"), F.col("kept").alias("_kept"), F.col("places").alias("_gone")).distinct(), "edits")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"].alias("_id"), docs["source"].alias("_host"), _doc_key(docs).alias("_key"))
    # The key is never null, so it is what a join can be dealt by.
    same = (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")) & F.col("_host").eqNullSafe(F.col("_s"))
    joined = rows.join(sized(edits, F.coalesce(F.size("_gone"), F.lit(0)) * 4 + 60), same, "left").where("coalesce(_kept, true)")
    stay = F.filter(F.split(F.col("_row")["text"], "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("_row")["text"]).otherwise(F.array_join(stay, "\n"))
    return joined.select(*[(text if c.lower() == "text" else F.col("_row")[c]).alias(c) for c in docs.columns])
