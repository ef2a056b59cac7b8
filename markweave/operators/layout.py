"""Pages to lines, lines to sections, labels to images."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markweave.functions.text import MARKER_CODES, break_markers, clean_text, first_marker, marker_value


def two_columned(words: DataFrame, width: Column | None = None) -> DataFrame:
    """(doc, page, two_columns): few words (doc, page, text, x0, x1, top) cross the middle."""
    pages = words.groupBy("doc", "page").agg(F.max("x1").alias("w"))
    joined = words.join(pages, ["doc", "page"])
    mid = F.col("w") / 2
    crossing = F.count_if((F.col("x0") < mid) & (F.col("x1") > mid))
    return joined.groupBy("doc", "page").agg((crossing <= F.greatest(F.lit(10.0), F.count("*") * 0.1)).alias("two_columns"))


def word_lines(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc, page, column, line_no, line): words of a column in reading order; the
    line of words within the tolerance of one top."""
    layout = two_columned(words)
    pages = words.groupBy("doc", "page").agg(F.max("x1").alias("w"))
    at = words.join(layout, ["doc", "page"]).join(pages, ["doc", "page"])
    at = at.withColumn("column", F.when(F.col("two_columns") & (F.col("x0") >= F.col("w") / 2), 1).otherwise(0)).withColumn("y", F.floor(F.col("top") / tolerance))
    rows = at.groupBy("doc", "page", "column", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda z: z["text"]), " ").alias("line"))
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("doc", "page").orderBy("column", "y"))).drop("y")


def entry_lines(words: DataFrame, width: Column | None = None, tolerance: float = 3.0) -> DataFrame:
    """(doc, page, line_no, line) of words (doc, page, text, x0, x1, top), entry by entry.

    A page of 30 words and more, of which few cross the middle, is cut where (111) or (116)
    stands in its left half. Of an entry come the left column, the right one, then all from
    (511) on over the full width; words above a first entry that starts at the very top (30
    at most) are the page's header and go. Other pages are read over their full width. A line
    goes on while tops are within the tolerance of its first word. width: the page's, or the
    end of its last word. Words without text or a place are left out.
    """
    page = Window.partitionBy("doc", "page")
    rows = words.where("text IS NOT NULL AND x0 IS NOT NULL AND top IS NOT NULL").withColumn("_mid", (F.max("x1").over(page) if width is None else width) / 2)
    marker = F.when(F.col("text").isin("(111)", "(116)") & (F.col("x0") < F.col("_mid")), F.col("top"))
    crossing = F.count_if((F.col("x0") < F.col("_mid")) & (F.col("x1") > F.col("_mid"))).over(page)
    n, first = F.count("*").over(page), F.min(marker).over(page)
    above = page.orderBy("top").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", ((n >= 30) & (crossing <= F.greatest(F.lit(10.0), n * 0.1)) & first.isNotNull()).alias("_cut"), F.coalesce(F.max(marker).over(above), F.when(first > 30, 0.0)).cast("double").alias("_start"))
    rows = rows.withColumn("_entry", F.when(F.col("_cut"), F.col("_start")).otherwise(0.0)).where("_entry IS NOT NULL")
    wide = F.min(F.when((F.col("text") == "(511)") & (F.col("x0") < F.col("_mid")), F.col("top"))).over(Window.partitionBy("doc", "page", "_entry"))
    rows = rows.withColumn("_wide", wide - 2)
    part = F.when(~F.col("_cut"), 0).when(F.col("top") >= F.col("_wide"), 2).when(F.col("x0") >= F.col("_mid"), 1).otherwise(0)
    # The words of a part of a page, a bounded number, are folded into lines in one array.
    inside = F.struct((F.bround(F.col("top") / tolerance) * tolerance).alias("row"), F.col("x0").cast("double").alias("x0"), F.col("top").cast("double").alias("top"), "text")
    parts = rows.groupBy("doc", "page", "_entry", part.alias("_part")).agg(F.array_sort(F.collect_list(inside)).alias("w"))
    lines = F.expr(f"""aggregate(w, CAST(NULL AS STRUCT<done: ARRAY<STRING>, now: STRING, y: DOUBLE>),
        (a, x) -> CASE WHEN a IS NULL THEN named_struct('done', CAST(array() AS ARRAY<STRING>), 'now', x.text, 'y', x.top)
                       WHEN abs(x.top - a.y) > {tolerance} THEN named_struct('done', concat(a.done, array(a.now)), 'now', x.text, 'y', x.top)
                       ELSE named_struct('done', a.done, 'now', concat(a.now, ' ', x.text), 'y', a.y) END,
        a -> concat(a.done, array(a.now)))""")
    placed = parts.select("doc", "page", "_entry", "_part", F.posexplode(lines).alias("_i", "line"))
    return placed.select("doc", "page", F.row_number().over(page.orderBy("_entry", "_part", "_i")).alias("line_no"), "line")


def marker_lines(pages: DataFrame) -> DataFrame:
    """(doc, line_no, line) of page texts (doc, page, text), a line for each marker,
    empty ones dropped."""
    split = pages.select("doc", "page", F.posexplode(F.split(break_markers(F.col("text")), "\n")).alias("i", "line")).where("trim(line) <> ''")
    order = Window.partitionBy("doc").orderBy("page", "i")
    return split.withColumn("line_no", F.row_number().over(order)).select("doc", "line_no", F.trim("line").alias("line"))


def sections(lines: DataFrame, starts: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc, section, code, value) from ordered lines (doc, kind, line_no, line).

    A section starts at 210 in kind A, at 111 or 116 in kind B. A marker's value goes on
    over the lines up to the next marker that counts: while 540 is read, 511 and 531 don't
    start, nor does 511 while 531 is read. The last value of a repeated marker wins.
    """
    starts = starts or {"A": ["210"], "B": ["111", "116"]}
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.lit(False)
    for kind, codes in starts.items():
        begins = begins | ((F.col("kind") == kind) & F.col("code").isin(codes))
    rows = lines.withColumn("code", first_marker(F.col("line"))).withColumn("section", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(order))
    # Which marker is read depends on the one before only through these three, so a running
    # "last marker" that ignores shadowed ones is exact: 540 shadows 511 and 531, 531 shadows 511.
    before = Window.partitionBy("doc", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("code").isNotNull() & ~F.col("code").isin("511", "531"), F.col("code")), True).over(before)
    seen531 = F.max(F.when(F.col("code") == "531", F.col("line_no"))).over(before)
    other = F.max(F.when(F.col("code").isNotNull() & ~F.col("code").isin("511", "531"), F.col("line_no"))).over(before)
    hidden = (F.col("code").isin("511", "531") & (F.coalesce(known, F.lit("")) == "540")) | ((F.col("code") == "511") & (F.coalesce(seen531, F.lit(-1)) > F.coalesce(other, F.lit(-1))))
    rows = rows.withColumn("_hidden", F.coalesce(hidden, F.lit(False)))
    upto = Window.partitionBy("doc", "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    counts = F.col("code").isNotNull() & ~F.col("_hidden")
    rows = rows.withColumn("_run", F.sum(counts.cast("int")).over(upto)).withColumn("_code", F.last(F.when(counts, F.col("code")), True).over(upto))
    value = F.lit(None).cast("string")
    for code in MARKER_CODES:
        value = F.when(F.col("code") == code, marker_value(F.col("line"), code)).otherwise(value)
    # A hidden marker's own line sets nothing and ends nothing.
    rows = rows.withColumn("_text", F.when(counts, value).when(~F.col("_hidden"), clean_text(F.col("line")))).where("_code IS NOT NULL AND section > 0")
    parts = rows.groupBy("doc", "section", "_code", "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_text"))), lambda z: z["_text"]), " ").alias("value"))
    return parts.groupBy("doc", "section", F.col("_code").alias("code")).agg(F.trim(F.max_by("value", "_run")).alias("value"))


def section_maps(parts: DataFrame) -> DataFrame:
    """One row a section, with a map of code to value."""
    return parts.groupBy("doc", "section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "value")))).alias("fields"))


def first_dates(sections_: DataFrame, date: str = "date") -> DataFrame:
    """The first date seen so far in the file, as month, year and whole."""
    order = Window.partitionBy("doc").orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(date, True).over(order)
    return sections_.withColumn("date_combined", first).withColumn("month", F.month(first)).withColumn("year", F.year(first))


def drop_blank_pages(pages: DataFrame) -> DataFrame:
    """Pages with text or an image."""
    return pages.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.coalesce("n_images", F.lit(0)) > 0))


def sector_count(pages: DataFrame, regex: str) -> DataFrame:
    """Matches over all pages of a document."""
    return pages.groupBy("doc").agg(F.sum(F.regexp_count("text", F.lit(regex))).alias("sectors"))


def marker_places(lines: DataFrame, marker: str) -> DataFrame:
    """Lines (block, line_no, line, y) where a match on the block's joined text starts."""
    order = Window.partitionBy("block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    spans = lines.withColumn("_end", F.sum(F.length("line") + 1).over(order)).withColumn("_start", F.col("_end") - F.length("line") - 1)
    joined = lines.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda z: z["line"]), " ").alias("t"))
    pieces, found = F.split("t", marker, -1), F.regexp_extract_all("t", F.lit(marker), F.lit(0))
    starts = F.transform(found, lambda m, i: F.aggregate(F.slice(F.col("_p"), F.lit(1), i + 1), F.lit(0), lambda s, x: s + F.length(x)) + F.aggregate(F.slice(F.col("_f"), F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)))
    hits = joined.withColumn("_p", pieces).withColumn("_f", found).select("block", F.explode(F.arrays_zip(found.alias("m"), starts.alias("s"))).alias("h"))
    return spans.join(hits.select("block", F.col("h.m").alias("match"), F.col("h.s").alias("at")), "block").where("at >= _start AND at < _end").drop("_start", "_end")


def label_above(images: DataFrame, labels: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """Each image (doc, page, image, top) with the nearest label (doc, page, label, y)
    at or above its top plus the tolerance, as an as-of join by one window."""
    both = images.select("doc", "page", (F.col("top") + tolerance).alias("y"), F.lit(1).alias("o"), "image", F.lit(None).cast("string").alias("label"))
    both = both.unionByName(labels.select("doc", "page", "y", F.lit(0).alias("o"), F.lit(None).cast("string").alias("image"), F.col("label").cast("string").alias("label")))
    order = Window.partitionBy("doc", "page").orderBy("y", "o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("owner", F.coalesce(F.last("label", True).over(order), F.lit("unknown"))).where("image IS NOT NULL").select("doc", "page", "image", "owner")


def image_slices(images: DataFrame, labels: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """(image, owner, from, to): labels inside a rectangle cut it into slices."""
    inside = images.join(labels, ["doc", "page"]).where("y > top AND y < bottom").select("doc", "page", "image", F.col("y").alias("start"), F.col("label").cast("string").alias("owner"), "bottom")
    head = label_above(images, labels, tolerance).join(images, ["doc", "page", "image"]).select("doc", "page", "image", F.col("top").alias("start"), "owner", "bottom")
    w = Window.partitionBy("doc", "page", "image").orderBy("start")
    return head.unionByName(inside).withColumn("end", F.coalesce(F.lead("start").over(w), "bottom")).where("end > start").select("doc", "page", "image", "owner", "start", "end")


def merge_rectangles(rects: DataFrame, gap: float = 20.0, passes: int = 10) -> DataFrame:
    """Rectangles (doc, page, x0, y0, x1, y1) of a page that overlap or lie within the gap
    become one, again until none do. The order of a page's rectangles matters, so a page is
    one group."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        boxes = page.sort_values(["y0", "x0", "y1", "x1"])[["x0", "y0", "x1", "y1"]].to_numpy(float).tolist()
        for _ in range(passes):
            out: list[list[float]] = []
            for b in boxes:
                near = next((o for o in out if b[0] <= o[2] + gap and o[0] <= b[2] + gap and b[1] <= o[3] + gap and o[1] <= b[3] + gap), None)
                if near is None:
                    out.append(list(b))
                else:
                    near[:] = [min(near[0], b[0]), min(near[1], b[1]), max(near[2], b[2]), max(near[3], b[3])]
            if len(out) == len(boxes):
                break
            boxes = out
        frame = pd.DataFrame(boxes, columns=["x0", "y0", "x1", "y1"])
        return frame.assign(doc=page["doc"].iloc[0], page=page["page"].iloc[0])[["doc", "page", "x0", "y0", "x1", "y1"]]

    kinds = dict(rects.dtypes)
    return rects.groupBy("doc", "page").applyInPandas(run, f"doc {kinds['doc']}, page {kinds['page']}, x0 double, y0 double, x1 double, y1 double")


def logo_path(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(id, logo_path) of rows (id and three numbers): the path of the file (stem, path)
    named by the first number that has one; a Madrid number also takes a letter behind it.
    Numbers and files meet once by number; only what belongs to rows with several numbers
    meets again by id (such rows of one id share a path). Rows are never joined back, and
    those without a number stay spread."""
    numbers = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(c).alias("stem")) for i, c in enumerate(("application_number", "certificate_number", "madrid_number"))])
    named = F.filter(numbers, lambda x: x["stem"] != "")
    item = lambda rank, stem, n: F.struct(rank.alias("rank"), stem.alias("stem"), n.alias("n"))
    none = F.array(item(F.lit(3), F.concat(F.lit("\0"), F.col("id").cast("string")), F.lit(0)))
    # n inside the item: a filter on it stays above what makes the rows, so both uses share that.
    items = F.when(F.size(named) > 0, F.transform(named, lambda x: item(x["rank"], x["stem"], F.size(named)))).otherwise(none)
    wanted = rows.select("id", F.posexplode(items).alias("at", "x")).select("id", "at", "x.rank", "x.stem", "x.n")
    lettered = F.col("stem").rlike(r"^\d+[A-Z]$")
    base = files.select(F.regexp_replace("stem", r"^(\d+)[A-Z]$", "$1").alias("stem"), F.when(~lettered, F.col("path")).alias("plain"), F.when(lettered, F.col("path")).alias("letter"))
    base = base.groupBy("stem").agg(F.min("plain").alias("plain"), F.min("letter").alias("letter"))
    path = F.coalesce("plain", F.when(F.col("rank") == 2, F.col("letter")))
    hits = wanted.join(base, "stem", "left").select("id", "n", "at", "rank", path.alias("path"))
    first = F.min(F.when(F.col("path").isNotNull(), F.struct("rank", "path")))["path"]
    best = hits.where("n > 1").groupBy("id").agg(first.alias("logo_path"), F.count_if(F.col("at") == 0).cast("int").alias("rows"))
    several = best.select("id", F.explode(F.array_repeat("logo_path", F.col("rows"))).alias("logo_path"))
    return hits.where("n < 2").select("id", F.col("path").alias("logo_path")).unionByName(several)


def inid_rows(marks: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(id, ordinal, code, label, value) of fields {code: (column, label)} that are set."""
    items = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(code).alias("code"), F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for i, (code, (c, label)) in enumerate(fields.items())])
    return marks.select("id", F.inline(items)).where("value IS NOT NULL AND value <> ''")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a compact table over all shuffle partitions, before steps that cost far more than
    reading: Spark cuts tasks by bytes, and a million short rows may be one task's."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
