"""Registry pages to records: Column expressions over the page's source."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markweave.functions.text import clean_text


def once(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it: Spark writes out
    a nullif as two copies of its argument, and copies inside copies double at each level."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def filled(c: Column) -> Column:
    """A text, NULL for an empty one."""
    return once(c, lambda x: F.nullif(x, F.lit("")))


def unescaped(c: Column) -> Column:
    """Character references as characters: the one step of a page that Python makes."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html.unescape(x) if x else x)

    return run(c)


def tag_text(page: Column) -> Column:
    """H01 without character references: scripts and styles go, breaks and closed blocks end
    lines, other tags are blanks."""
    c = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|tr|td|th|li|h[1-6]|table|ul|ol|section|title)\s*>", "\n")
    return F.regexp_replace(c, r"(?s)<[^>]*>", " ")


def lines(text: Column) -> Column:
    """Lines with one space for white space, without empty ones and repeats of the
    line before."""
    flat = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s ]+", " "))), lambda x: x != "")
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), flat), F.lit(1), F.greatest(F.size(flat), F.lit(0)))
    pairs = F.arrays_zip(flat.alias("x"), before.alias("p"))
    return F.transform(F.filter(pairs, lambda z: ~z["x"].eqNullSafe(z["p"])), lambda z: z["x"])


def value_after(all_lines: Column, code: str) -> Column:
    """What stands two lines below a code up to the next three-digit code, in one line."""

    def below(tail: Column) -> Column:
        stop = F.coalesce(F.array_min(F.transform(tail, lambda x, i: F.when(x.rlike(r"^\d{3}$"), i))), F.size(tail))
        return filled(F.trim(F.array_join(F.slice(tail, F.lit(1), stop), " ")))

    def behind(at: Column) -> Column:
        return F.when(at > 0, once(F.slice(all_lines, (at + 2).cast("int"), F.greatest(F.size(all_lines), F.lit(0))), below))

    return once(F.array_position(all_lines, code), behind)


def details(page: Column, label: str) -> Column:
    """Source of the value that follows a label, such as (541)."""
    return filled(F.regexp_extract(page, rf"(?is){label}[^<]*</div>\s*<div[^>]*product-form-details[^>]*>(.*?)(?=<div[^>]*product-form-label|</div></div></div>|\z)", 1))


def _numeric(c: Column, rx: str, base: int, lead: str) -> Column:
    value = lambda n: F.conv(n, base, 10).cast("int")
    # Halves of code points are no characters.
    sound = lambda n: (value(n) < 0xD800) | value(n).between(0xE000, 0xFFFF)
    point = lambda n: F.decode(F.unhex(F.lpad(F.conv(n, base, 16), 4, "0")), "UTF-16BE")
    numbers = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(rx), F.lit(1)))
    put = lambda t, n: F.replace(t, F.concat(F.lit(lead), n, F.lit(";")), point(n))
    return once(c, lambda x: F.when(F.contains(x, F.lit("&#")), F.aggregate(F.filter(numbers(x), sound), x, put)).otherwise(x))


def references(c: Column) -> Column:
    """The common named and the numeric character references of a fragment as characters, for
    use inside array expressions; unescaped() knows all names, but is a step of its own."""
    c = _numeric(_numeric(c, r"&#(\d{1,5});", 10, "&#"), r"&#x([0-9a-fA-F]{1,4});", 16, "&#x")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def flat(c: Column) -> Column:
    """A fragment's text in one line, NULL for none."""
    return filled(clean_text(F.replace(references(F.regexp_replace(c, r"(?s)<[^>]*>", " ")), F.lit("\u00a0"), F.lit(" "))))


def without_language(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\s*\([A-Za-z]{2}\)\s*", ""))


def dotted_date(c: Column) -> Column:
    """The first dd.mm.yyyy of a text."""
    return F.try_to_date(filled(F.regexp_extract(c, r"(\d{2}\.\d{2}\.\d{4})", 1)), "dd.MM.yyyy")


def domestic_record(page: Column) -> Column:
    """The struct of a domestic detail page."""
    name = filled(F.trim(F.regexp_extract(page, r"getOtherApplicants\('(.*?)'\)", 1)))
    owner = without_language(flat(details(page, r"\(730\)")))
    agent = without_language(flat(details(page, r"\(740\)")))
    goods = details(page, r"\(511\)")
    link = r"""(?is)<a[^>]*\brel="(\d{1,2})"[^>]*class="[^"]*external-link[^"]*"[^>]*>(.*?)</a>"""
    numbers = F.regexp_extract_all(goods, F.lit(link), F.lit(1))
    bodies = F.transform(F.regexp_extract_all(goods, F.lit(link), F.lit(2)), lambda b: F.coalesce(flat(F.regexp_extract(b, r"(?is)<div[^>]*col-md-10[^>]*>(.*?)</div>", 1)), F.lit("")))
    pairs = F.filter(F.zip_with(numbers, bodies, lambda n, b: F.struct(n.cast("int").alias("n"), b.alias("b"))), lambda p: p["n"].between(1, 45))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    classes = F.array_distinct(F.transform(pairs, lambda p: two(p["n"])))
    described = F.filter(pairs, lambda p: p["b"] != "")

    def by_class(rows: Column) -> Column:
        keys = F.array_distinct(F.transform(rows, lambda p: p["n"]))
        return F.map_from_arrays(F.transform(keys, two), F.transform(keys, lambda k: F.get(F.filter(rows, lambda p: p["n"] == k), F.lit(0))["b"]))

    spans = F.regexp_extract_all(details(page, r"\(531\)"), F.lit(r"(?is)<span[^>]*ext-link-text[^>]*>\s*(\d{2}\.\d{2}\.\d{2})"), F.lit(1))
    cells = F.filter(F.transform(F.regexp_extract_all(details(page, r"\(400\)"), F.lit(r"(?is)<div[^>]*col-md-4[^>]*>(.*?)</div>"), F.lit(1)), flat), lambda x: x.isNotNull())
    dates = F.filter(F.transform(cells, dotted_date), lambda d: d.isNotNull())
    scope = F.coalesce(filled(F.regexp_extract(page, r"(?is)events-section(.*?)(?:description-section|claims-section|</body>)", 1)), page)

    def row(r: Column) -> Column:
        def event(tds: Column) -> Column:
            at = lambda i: F.coalesce(F.get(tds, F.lit(i)), F.lit(""))
            return F.when((F.size(tds) >= 2) & ((at(0) != "") | (at(1) != "")), F.struct(at(0).alias("event"), at(1).alias("date"), at(2).alias("status")))

        return once(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: F.coalesce(flat(x), F.lit(""))), event)

    events = F.array_compact(F.transform(F.regexp_extract_all(scope, F.lit(r"(?is)<tr>(.*?)</tr>"), F.lit(1)), row))
    head = lambda c: F.split(c, " : ", 2)[0]
    return F.struct(
        filled(F.regexp_extract(page, r"VN\s*-?\s*(\d-\d{4}-\d{4,6})", 1)).alias("application_number"),
        filled(without_language(flat(F.split(details(page, r"\(541\)"), r"(?is)<br\s*/?>", 2)[0]))).alias("mark_text"),
        flat(details(page, r"\(550\)")).alias("mark_type"),
        flat(details(page, r"\(591\)")).alias("colors"),
        F.coalesce(name, filled(F.trim(head(owner)))).alias("applicant_name"),
        filled(F.trim(F.get(F.split(owner, " : ", 2), F.lit(1)))).alias("applicant_address"),
        filled(F.trim(head(agent))).alias("representative"),
        classes.alias("nice_classes"),
        once(described, by_class).alias("goods_services"),
        F.array_distinct(spans).alias("vienna_codes"),
        flat(F.regexp_extract(page, r"(?is)Tr[^<]*ng th[^<]*i</div>\s*<div[^>]*product-form-details[^>]*>(.*?)</div>", 1)).alias("status_code"),
        dotted_date(flat(details(page, r"\(200\)"))).alias("filing_date"),
        F.get(cells, F.lit(0)).alias("publication_no"),
        F.get(dates, F.lit(0)).alias("publication_date"),
        dotted_date(flat(details(page, r"\(100\)"))).alias("grant_date"),
        dotted_date(flat(details(page, r"\(180\)"))).alias("expiry_date"),
        filled(F.regexp_extract(page, r"""['"]([^'"]*?/trademarks/application/[^'"]*?/logo[^'"]*)['"]""", 1)).alias("logo_url"),
        events.alias("timeline"),
    )


def unrendered(page: Column) -> Column:
    """Placeholders outside scripts."""
    return F.contains(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", ""), F.lit("${"))


def page_state(page: Column) -> Column:
    """Ok, not_found or unrendered."""
    return F.when(unrendered(page), "unrendered").when(F.contains(page, F.lit("product-form-label")), "ok").otherwise("not_found")


#: A gazette's date line, with and without the gazette's number.
GAZETTE_DATE = r"^:?\s*\d{2}\.\d{2}\.\d{4},\s*\d{4}/\d+\s*(?:Gaz|LMi)"
EVENT_DATE = r"^:?\s*(\d{2}\.\d{2}\.\d{4})(?:,\s*(\d{4}/\d+)\s*(?:Gaz|LMi))?"
EVENTS = "array<struct<type:string,date:string,gazette:string,parties:array<string>,designations:array<string>>>"


def countries(c: Column) -> Column:
    """The two-letter codes of a text, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b([A-Z]{2})\b"), F.lit(1))


def madrid_events(all_lines: Column) -> Column:
    """Array of struct(type, date, gazette, parties, designations) from the lines of a
    history. An event starts with a line of a type and countries, before a gazette's date line
    one or two lines on, or with a type alone, then a colon and a date line. Its lines go up to
    the next start: parties are the type's countries, else those of its field 833;
    designations are those of its field 832."""

    def starts(x: Column, i: Column) -> Column:
        one, two = F.coalesce(F.get(all_lines, i + 1), F.lit("")), F.coalesce(F.get(all_lines, i + 2), F.lit(""))
        named = F.contains(x, F.lit(",")) & (one.rlike(GAZETTE_DATE) | two.rlike(GAZETTE_DATE))
        plain = ~F.contains(x, F.lit(",")) & (one == ":") & two.rlike(EVENT_DATE)
        return F.when((named | plain) & ~x.rlike(r"^\d{3}$") & ~x.rlike(EVENT_DATE) & ~x.isin(":", "Transaction History"), i)

    at = F.array_compact(F.transform(all_lines, starts))

    def event(i: Column, k: Column) -> Column:
        x = F.get(all_lines, i)
        one, two = F.get(all_lines, i + 1), F.get(all_lines, i + 2)
        named = F.contains(x, F.lit(","))
        dated = F.when(one.rlike(GAZETTE_DATE), one).otherwise(two)
        block = F.slice(all_lines, i + 1, F.coalesce(F.get(at, k + 1), F.size(all_lines)) - i)
        own = countries(F.regexp_replace(x, r"^[^,]*,", ""))
        none = F.array().cast("array<string>")
        return F.struct(
            F.regexp_replace(x, r"[ :]+$", "").alias("type"),
            F.regexp_replace(F.regexp_extract(dated, EVENT_DATE, 1), r"(\d{2})\.(\d{2})\.(\d{4})", "$3-$2-$1").alias("date"),
            F.nullif(F.regexp_extract(dated, EVENT_DATE, 2), F.lit("")).alias("gazette"),
            F.when(~named, none).when(F.size(own) > 0, own).otherwise(countries(value_after(block, "833"))).alias("parties"),
            F.when(named, countries(value_after(block, "832"))).otherwise(none).alias("designations"),
        )

    return F.when(F.size(all_lines) > 0, F.transform(at, event))


def _terms(page: Column) -> Column:
    """Map of class to goods of the basic list: the English term, else the first."""
    basic = filled(F.regexp_extract(page, r"(?is)<dl[^>]*\bBASICGS\b[^>]*>(.*?)</dl>", 1))
    scope, rx = F.coalesce(basic, page), r"""(?is)<p[^>]*\bgsterm\b[^>]*nice="(\d+)"[^>]*lang="([A-Za-z]{2})"[^>]*>(.*?)</p>"""
    part = lambda n: F.regexp_extract_all(scope, F.lit(rx), F.lit(n))
    rows = F.zip_with(F.zip_with(part(1), part(2), lambda c, g: F.struct(F.lpad(c, 2, "0").alias("c"), F.upper(g).alias("g"))), part(3), lambda x, t: F.struct(x["c"].alias("c"), x["g"].alias("g"), flat(t).alias("t")))
    told = F.filter(rows, lambda x: x["t"].isNotNull())

    def goods(told: Column) -> Column:
        keys = F.array_distinct(F.transform(told, lambda x: x["c"]))
        # The last English term of a class, else the first language's last one.
        best = lambda k: F.coalesce(F.element_at(_of(told, k, F.lit("EN")), -1), F.element_at(_of(told, k, F.get(F.filter(told, lambda x: x["c"] == k), F.lit(0))["g"]), -1))
        return F.map_from_arrays(keys, F.transform(keys, best))

    return once(told, goods)


def _of(told: Column, key: Column, language: Column) -> Column:
    own = F.transform(F.filter(told, lambda x: (x["c"] == key) & (x["g"] == language)), lambda x: x["t"])
    return F.when(F.size(own) > 0, own)


def madrid_records(pages: DataFrame, page: str, out: str = "record") -> DataFrame:
    """Pages with the struct of their international registration. Lines, summary
    and history are columns of their own on the way, so each is made once a page."""
    source = F.col(page)
    rows = pages.withColumn("_text", unescaped(tag_text(source))).withColumn("_ls", lines(F.col("_text")))
    rows = rows.withColumn("_start", F.array_max(F.transform("_ls", lambda x, i: F.when(x == "Transaction History", i))))
    rows = rows.withColumns(
        {
            "_summary": F.when(F.col("_start").isNotNull(), F.slice("_ls", F.lit(1), F.col("_start"))).otherwise(F.col("_ls")),
            "_tail": F.slice("_ls", F.coalesce("_start", F.size("_ls")) + 1, F.greatest(F.size("_ls"), F.lit(0))),
        }
    )
    summary, none = F.col("_summary"), F.lit("")
    fields = ("151", "180", "270", "511", "732", "740", "811", "812", "822", "842")
    rows = rows.withColumns({"_history": madrid_events(F.col("_tail")), "_at": F.array_position(summary, "732"), "_language": F.array_position("_ls", "270"), **{f"_v{c}": value_after(summary, c) for c in fields}})
    blocks = F.array_compact(F.transform(summary, lambda x, i: F.when(x == "832", i)))
    designated = F.flatten(F.transform(blocks, lambda i: countries(value_after(F.slice(summary, i + 1, F.greatest(F.size(summary), F.lit(0))), "832"))))
    more = F.flatten(F.transform(F.coalesce("_history", F.array().cast(EVENTS)), lambda e: F.concat(e["parties"], e["designations"])))
    first = F.coalesce(F.get(summary, F.col("_at").cast("int") + 1), none)
    first = F.when((F.col("_at") > 0) & ~first.rlike(r"^\d{3}$"), first).otherwise(none)
    address = F.when(F.startswith("_v732", first), F.trim(F.substring(F.col("_v732"), F.length(first) + 1, F.length("_v732")))).otherwise(F.col("_v732"))
    country = F.coalesce(F.nullif(F.upper(F.regexp_extract("_v732", r"\(([A-Za-z]{2})\)\s*$", 1)), none), F.upper(F.substring(F.coalesce("_v811", "_v812"), 1, 2)))
    cell = F.regexp_replace(F.regexp_extract(source, r"""(?is)<td[^>]*class="[^"]*\bnice\b[^"]*"[^>]*>(.*?)</td>""", 1), r"(?s)<[^>]+>", " ")
    listed = F.filter(F.regexp_extract_all(cell, F.lit(r"(\d{1,2})"), F.lit(1)), lambda x: x.cast("int").between(1, 45))
    scraped = F.slice(F.regexp_extract_all(F.regexp_replace(F.coalesce("_v511", none), r"NCL\([^)]*\)", " "), F.lit(r"\b(\d{2})\b"), F.lit(1)), 1, 1)
    titles = F.filter(F.transform(F.slice("_ls", 1, 30), lambda x: F.trim(F.regexp_extract(x, r"^\d{6,}\s*-\s*(.+)$", 1))), lambda x: x != "")
    record = F.struct(
        F.get(titles, F.lit(0)).alias("mark_text"),
        F.coalesce(F.nullif(F.regexp_replace(first, ",+$", ""), none), F.col("_v732")).alias("holder_name"),
        F.nullif(address, none).alias("holder_address"),
        country.alias("holder_country"),
        F.col("_v842").alias("holder_legal_status"),
        F.col("_v740").alias("representative"),
        dotted_date(F.col("_v151")).alias("registration_date"),
        dotted_date(F.col("_v180")).alias("expiration_date"),
        F.when(F.size(listed) > 0, F.array_distinct(F.transform(listed, lambda x: F.lpad(x, 2, "0")))).otherwise(scraped).alias("nice_classes"),
        _terms(source).alias("goods_services"),
        F.array_distinct(F.concat(designated, more)).alias("designated_countries"),
        F.col("_v822").alias("basic_registration"),
        F.coalesce("_v270", F.when(F.col("_language") > 0, F.get("_ls", F.col("_language").cast("int") + 1))).alias("language"),
        F.col("_history").alias("transaction_history"),
    )
    return rows.select(*[F.col(c) for c in pages.columns], record.alias(out))


def _typed(events: Column, country: str) -> Column:
    named = F.filter(events, lambda e: F.array_contains(e["parties"], country))
    return F.transform(named, lambda e: F.struct(F.lower(e["type"]).alias("t"), F.try_to_date(e["date"], "yyyy-MM-dd").alias("d")))


def designation_status(country: Column, events: Column) -> Column:
    """struct(status, date, gazette) of one country: the earliest grant or refusal that
    names it (no date comes first), else pending."""

    def kind(e: Column) -> Column:
        return F.when(F.contains(F.lower(e["type"]), F.lit("grant of protection")), "granted").when(F.contains(F.lower(e["type"]), F.lit("refusal")), "refused")

    own = F.filter(events, lambda e: F.array_contains(e["parties"], country) & kind(e).isNotNull())
    ranked = F.transform(own, lambda e, i: F.struct(F.coalesce(e["date"], F.lit("")).alias("k"), i.alias("i"), kind(e).alias("status"), e["date"].alias("date"), e["gazette"].alias("gazette")))
    best = F.array_min(ranked)
    return F.struct(F.coalesce(best["status"], F.lit("pending")).alias("status"), best["date"].alias("date"), best["gazette"].alias("gazette"))


def vn_status(events: Column, designated: Column, registered: Column, expires: Column, accepted: Column, country: str = "VN") -> Column:
    """struct(designated, status, grant_date, refusal_date) by the order of events."""
    own = F.coalesce(_typed(events, country), F.array().cast("array<struct<t:string,d:date>>"))
    granting = lambda t: t.rlike("grant of protection|statement of grant|the mark is protected|the mark is granted")
    refusal = lambda t: F.contains(t, F.lit("refusal"))
    final = lambda t: t.rlike("confirmation of total provisional refusal|final decision|invalidation") | (refusal(t) & t.rlike("total|final|confirm"))
    least = lambda test: F.array_min(F.transform(F.filter(own, lambda e: test(e["t"])), lambda e: e["d"]))
    grant, refused = least(granting), least(final)
    start = F.when(~F.exists(own, lambda e: refusal(e["t"])), least(lambda t: F.trim(t).rlike("^(subsequent designation|international registration)")))
    active = registered.isNotNull() & expires.isNotNull()
    is_in = accepted | F.coalesce(F.array_contains(designated, country), F.lit(False))
    is_refused = ~accepted & grant.isNull() & refused.isNotNull() & ~active
    status = F.when(accepted | grant.isNotNull(), "granted").when(is_refused, "refused").otherwise("pending")
    return F.struct(
        is_in.alias("designated"),
        F.when(is_in, status).alias("status"),
        F.when(is_in, F.when(accepted, F.coalesce(grant, start)).otherwise(grant)).alias("grant_date"),
        F.when(is_in & is_refused, refused).alias("refusal_date"),
    )


def country_events(events: Column, country: str, name: str) -> Column:
    """Events of a country, those without parties too, NULL dates first, the list of
    countries cut from their type."""
    own = F.filter(events, lambda e: (F.coalesce(F.size(e["parties"]), F.lit(0)) == 0) | F.array_contains(e["parties"], country) | e["type"].rlike(rf"\b{name}\b"))
    keyed = F.array_sort(F.transform(own, lambda e, i: F.struct(F.coalesce(e["date"], F.lit("")).alias("k"), i.alias("i"), e.alias("e"))))
    return F.transform(keyed, lambda x: F.struct(F.regexp_replace(x["e"]["type"], r"(?:,\s*[A-Z]{2})+$", "").alias("type"), x["e"]["date"].alias("date")))
