"""The registered queries of the registry operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from markweave import roles
from markweave.functions import html, images, phonetics, scoring
from markweave.functions import text as T
from markweave.operators import facets, filters, layout, linkage, quality
from markweave.operators.filters import FilterSpec
from markweave.plans import derive, search
from markweave.sources import readers, sinks
from markweave.streaming import incremental, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = date.fromisoformat(roles.TODAY)


def query(name: str, sql: str | None = None, marks: bool = True, days: str = ""):
    """Registers a query; sql is over the mark tables of roles.MARKS_DUCK, or the test tables.
    days: date columns of both, which are given as text, as clients type dates differently."""
    as_text = days.split()

    def put(f: Query) -> Query:
        QUERIES[name] = (lambda s, d: f(s, d).withColumns({c: F.col(c).cast("string") for c in as_text})) if as_text else f
        if sql is not None:
            full = f"WITH {roles.MARKS_DUCK} {sql}" if marks else sql
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'{c}::VARCHAR AS {c}' for c in as_text)}) FROM ({full})" if as_text else full
        return f

    return put


def _table(name: str):
    return lambda spark, d: readers.table(spark, f"{d.rstrip('/')}/{name}.parquet")


lineitem, orders, customer, part, events, documents, pages, embeddings, labels, nation, supplier = map(
    _table, "lineitem orders customer part events documents pages embeddings labels nation supplier".split()
)
marks, madrid, domestic, gazettes = roles.marks, roles.madrid, roles.domestic, roles.gazettes
col, lit = F.col, F.lit


# Scans, sources, sinks
@query("s01_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000", False)
def _(s, d):
    return orders(s, d).where("o_totalprice > 100000").select("o_orderkey", "o_orderstatus")


@query("s02_point_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77", False)
def _(s, d):
    return readers.by_key(customer(s, d), "c_custkey", 77).select("c_custkey", "c_name", "c_mktsegment")


@query(
    "s05_short_year_dates",
    """SELECT o_orderkey, make_date(CASE WHEN o_orderkey % 100 <= 68 THEN 2000 ELSE 1900 END + o_orderkey % 100, month(o_orderdate), least(day(o_orderdate), 28)) AS submission_date FROM orders""",
    False,
    days="submission_date",
)
def _(s, d):
    text = F.concat_ws("/", F.month("o_orderdate"), F.least(F.day("o_orderdate"), lit(28)), F.lpad((col("o_orderkey") % 100).cast("string"), 2, "0"))
    return orders(s, d).select("o_orderkey", T.short_year_date(text).alias("submission_date"))


@query("s06_madrid_ids", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE lpad(p_partkey::VARCHAR, 7, '0') END AS key FROM part", False)
def _(s, d):
    return part(s, d).select("p_partkey", readers.madrid_id(F.when(col("p_partkey") % 3 == 0, col("p_name")).otherwise(col("p_partkey").cast("string"))).alias("key"))


@query(
    "s07_file_meta",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'A' WHEN o_orderkey % 4 = 1 THEN 'B' WHEN o_orderkey % 4 = 2 THEN 'B' END AS type,
       CASE WHEN o_orderkey % 4 < 2 THEN (o_orderkey % 24)::INT END AS issue, CASE WHEN o_orderkey % 4 < 2 THEN year(o_orderdate)::INT END AS year FROM orders""",
    False,
)
def _(s, d):
    k = col("o_orderkey")
    name = F.when(k % 4 == 0, F.concat(lit("a_T"), k % 24, lit("_2_"), F.year("o_orderdate"), lit(".pdf"))).when(k % 4 == 1, F.concat(lit("B_T"), k % 24, lit("_"), F.year("o_orderdate"), lit(".pdf"))).when(k % 4 == 2, lit("b-file.pdf")).otherwise(lit("other.pdf"))
    return orders(s, d).select("o_orderkey", T.file_meta(name).alias("m")).select("o_orderkey", "m.*")


@query("s08_cities", "SELECT upper(substr(n_name, 1, 2)) AS country, list_sort(list_distinct(list_concat(list(c_name), ['Extra City']))) AS cities FROM (SELECT n_name, replace(c_mktsegment, '_', ' ') AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1", False)
def _(s, d):
    rows = customer(s, d).join(F.broadcast(nation(s, d)), col("c_nationkey") == col("n_nationkey")).select(F.upper(F.substring("n_name", 1, 2)).alias("country"), F.replace("c_mktsegment", lit("_"), lit(" ")).alias("name"), lit("").alias("alternates"))
    return readers.cities(rows, {}, {"NA": ["Extra City"]}, {"NA": ["Missing"]})


@query("s11_new_files", "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY 2", False)
def _(s, d):
    files = documents(s, d).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.lpad(col("doc_id").cast("string"), 12, "0").alias("path"))
    return readers.new_files(files, files.where("doc_id % 10 = 0")).select("doc_id", "sha256")


@query("s13_upsert", "SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS version FROM part", False)
def _(s, d):
    old = part(s, d).select("p_partkey", "p_name", lit(0).alias("version"))
    return sinks.upsert(old.where("p_partkey % 10 <> 0"), old.where("p_partkey % 5 = 0").withColumn("version", lit(1)), "p_partkey")


@query("s14_hash_upsert_plan", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'insert' WHEN p_partkey % 4 = 1 THEN 'update' ELSE 'skip' END AS action FROM part", False)
def _(s, d):
    base = part(s, d).select("p_partkey", F.md5("p_name").alias("content_hash"), lit(1).alias("parse_version"))
    old = base.where("p_partkey % 4 <> 0").withColumn("parse_version", F.when(col("p_partkey") % 4 == 1, 0).otherwise(1))
    return sinks.plan_upsert(old, base, "p_partkey")


@query("s15_gazette_csv", "SELECT doc_id, lower(lang) AS lang, text AS text, lower(source) AS source FROM documents WHERE length(text) <= 32767 UNION ALL SELECT doc_id, lower(lang), substr(text, 1, 32500), lower(source) FROM documents WHERE length(text) > 32767", False)
def _(s, d):
    return sinks.gazette_csv(documents(s, d), ["doc_id", "lang", "text", "source"], "text", "text", "doc_id")[0]


@query("s16_split_sinks", "SELECT CASE WHEN coalesce(madrid_number, '') <> '' THEN 'madrid' ELSE 'domestic' END AS sink, count(*) AS n FROM marks GROUP BY 1")
def _(s, d):
    a, b = sinks.split_by_kind(marks(s, d), "madrid_number")
    return a.agg(lit("domestic").alias("sink"), F.count("*").alias("n")).unionByName(b.agg(lit("madrid").alias("sink"), F.count("*").alias("n")))


@query(
    "s17_unique_export",
    """SELECT b.application_number, id, coalesce(d.application_number IS NOT NULL, FALSE) AS enriched, mark_text FROM
       (SELECT * FROM marks WHERE application_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY application_number ORDER BY publication_date DESC NULLS LAST, id) = 1) b
       LEFT JOIN domestic d ON b.application_number = d.application_number""",
)
def _(s, d):
    order = [F.desc_nulls_last("publication_date"), F.asc("id")]
    return sinks.unique_export(marks(s, d).select("application_number", "id", "publication_date"), domestic(s, d).select("application_number", "mark_text"), "application_number", order).select("application_number", "id", "enriched", "mark_text")


@query(
    "s19_purge_gazette",
    """SELECT id, row_number() OVER (PARTITION BY dkey ORDER BY (certificate_number IS NOT NULL) DESC, (vn_grant_date IS NOT NULL) DESC, id DESC) = 1 AS is_representative
       FROM keyed WHERE gazette_id <> 'g1995'""",
)
def _(s, d):
    return linkage.purge(linkage.with_representative(marks(s, d)), "g1995").select("id", "is_representative")


@query("s20_seeded_sample", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey::VARCHAR || 'seed'), o_orderkey LIMIT 50", False)
def _(s, d):
    return readers.seeded_sample(orders(s, d).select("o_orderkey", "o_orderstatus"), "o_orderkey", "seed", 50)


@query("s21_keyset_page", "SELECT application_number, id FROM marks WHERE (application_number, id) > ('4-2', '') ORDER BY application_number, id LIMIT 100")
def _(s, d):
    return readers.keyset_page(marks(s, d).select("application_number", "id"), ["application_number", "id"], ("4-2", ""), 100)


@query("s21_clustered_page", "SELECT publication_date, id FROM marks WHERE (publication_date IS NOT NULL) AND (publication_date < DATE '1996-03-01' OR (publication_date = DATE '1996-03-01' AND id > '5')) ORDER BY publication_date DESC, id LIMIT 100", days="publication_date")
def _(s, d):
    # Pages in the order of search: the latest publication first, then the id.
    late = (-F.unix_date("publication_date")).alias("late")
    table = roles.clustered(s, d, marks(s, d).where("publication_date IS NOT NULL").select(late, "id", "publication_date"), ["late", "id"])
    return table.page((-(date(1996, 3, 1) - date(1970, 1, 1)).days, "5"), 100)[0].select("publication_date", "id")


@query("s13_s14_keyed_merge", """SELECT o_orderkey, CASE WHEN k THEN 'merged' ELSE o_orderstatus END AS status FROM (SELECT o_orderkey, o_orderstatus, o_orderkey BETWEEN lo AND lo + (hi - lo) // 100 AS k FROM orders, (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders))
    UNION ALL SELECT -o_orderkey, 'new' FROM orders WHERE o_orderkey % 100 = 1""", False)
def _(s, d):
    # A hundredth of the keys is changed, rows that come twice among them, and new ones are added.
    from markweave.sources.keyed_table import KeyedTable
    from markweave.storage import scratch

    old = orders(s, d).select("o_orderkey", col("o_orderstatus").alias("status"))
    table = KeyedTable.create(old, scratch(s, "keyed"), ["o_orderkey"], 500)
    ends = old.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).first()
    part = old.where(col("o_orderkey").between(ends.lo, ends.lo + (ends.hi - ends.lo) // 100)).select("o_orderkey")
    new = part.select("o_orderkey", lit("early").alias("status"), lit(1).alias("o")).unionByName(part.select("o_orderkey", lit("merged").alias("status"), lit(2).alias("o")))
    table.merge(new.unionByName(old.where("o_orderkey % 100 = 1").select((-col("o_orderkey")).alias("o_orderkey"), lit("new").alias("status"), lit(1).alias("o"))), "o")
    return table.read()


@query("st01_whole_ingest", """SELECT 'g' || (o_orderkey % 4)::VARCHAR AS gazette_id, CASE WHEN o_orderkey % 4 = 2 THEN 'second' ELSE 'first' END AS attempt, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey % 4 <> 3 GROUP BY 1, 2""", False)
def _(s, d):
    # Four gazettes: one whole, one whole and offered again, one that fails first, one that fails.
    from markweave.storage import scratch
    from markweave.streaming.ingest import Ingest

    log = Ingest(s, scratch(s, "ingest"), "o_orderkey long, attempt string")

    def rows(k: int, attempt: str, fails: bool = False):
        def read() -> DataFrame:
            found = orders(s, d).where(col("o_orderkey") % 4 == k).select(col("o_orderkey").cast("long").alias("o_orderkey"), lit(attempt).alias("attempt"))
            last = found.agg(F.max("o_orderkey")).first()[0]
            return found.withColumn("attempt", F.when(col("o_orderkey") == last, F.raise_error(lit("page 47"))).otherwise(col("attempt"))) if fails else found

        return read

    for k, sha, attempt, fails in ((0, "a", "first", False), (1, "b", "first", False), (1, "b", "again", False), (2, "c", "first", True), (2, "c", "second", False), (3, "d", "first", True)):
        try:
            log.run(f"g{k}", sha, rows(k, attempt, fails))
        except Exception as e:
            if "page 47" not in str(e):
                raise
    return log.rows().groupBy("gazette_id", "attempt").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("s23_source_type", "SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'B' WHEN source LIKE 'src2%' THEN 'C' ELSE 'A' END AS kind FROM documents", False)
def _(s, d):
    return documents(s, d).select("doc_id", readers.source_type(col("source"), {"A": "src0", "B": "src1", "C": "src2"}).alias("kind"))


@query("s24_sector_count", "SELECT source AS doc, sum(len(regexp_extract_all(text, 'th[ae]')))::BIGINT AS sectors FROM documents GROUP BY 1", False)
def _(s, d):
    return layout.sector_count(documents(s, d).select(col("source").alias("doc"), "text"), "th[ae]")


@query("s22_drop_blank_pages", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR n_chars > 1000", False)
def _(s, d):
    p = documents(s, d).select("doc_id", F.when(col("n_chars") > 1000, col("text")).otherwise(" ").alias("text"), (col("doc_id") % 3 == 0).cast("int").alias("n_images"))
    return layout.drop_blank_pages(p).select("doc_id")


# Text to fields
@query("t01_clean_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\v ]+', ' ', 'g'))) AS h FROM documents", False)
def _(s, d):
    return documents(s, d).select("doc_id", F.md5(T.clean_text(col("text"))).alias("h"))


@query("t05_dmy_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'none' ELSE strftime(o_orderdate, '%m/%d/%Y') END AS mdy FROM orders", False)
def _(s, d):
    return orders(s, d).select("o_orderkey", T.dmy_to_mdy(F.when(col("o_orderkey") % 5 == 0, "none").otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))).alias("mdy"))


@query("t06_parse_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN o_orderdate::DATE END AS day FROM orders", False, days="day")
def _(s, d):
    k = col("o_orderkey") % 3
    return orders(s, d).select("o_orderkey", T.parse_date(F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("31.12")).alias("day"))


@query("t09_nice_classes", "SELECT id, nice_classes FROM marks")
def _(s, d):
    return marks(s, d).select("id", "nice_classes")


@query("t10_vienna_split", "SELECT id, [v1, v2] AS codes FROM marks")
def _(s, d):
    return marks(s, d).select("id", T.vienna_codes(F.concat_ws("; ", "v1", "v2")).alias("codes"))


@query("t12_country_code", "SELECT c_custkey, upper(substr(n_name, 1, 2)) AS country FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 2 = 1", False)
def _(s, d):
    codes, names = F.array(lit("NA")), F.array(lit("Nationland"))
    rows = customer(s, d).join(F.broadcast(nation(s, d)), col("c_nationkey") == col("n_nationkey"))
    text = F.concat(col("c_name"), lit(" (GZ) Road"), F.when(col("c_custkey") % 2 == 0, F.concat(lit(" ("), F.upper(F.substring("n_name", 1, 2)), lit(")"))).otherwise(""))
    return rows.select("c_custkey", T.country_code(text, codes, names).alias("country"))


@query("t14_applicant_type", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Company' ELSE 'Personal' END AS kind FROM customer", False)
def _(s, d):
    k = col("c_custkey") % 3
    return customer(s, d).select("c_custkey", T.applicant_type(F.concat(F.when(k == 1, lit("Nguyễn ")).otherwise(""), col("c_name"), F.when(k == 0, lit(" Co., Ltd")).otherwise(""))).alias("kind"))


@query("t15_agency", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'ABC-' || s_suppkey ELSE s_name END AS agency FROM supplier", False)
def _(s, d):
    even = F.concat(col("s_name"), lit(" (ABC-"), col("s_suppkey"), lit(")"))
    return supplier(s, d).select("s_suppkey", T.agency(F.when(col("s_suppkey") % 2 == 0, even).otherwise(F.concat(lit("Mr. "), "s_name", lit(" Suite 4 Long Road")))).alias("agency"))


@query("t17_sample_and_vienna", "SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN p_name ELSE '' END AS sample, CASE WHEN p_size % 3 = 1 THEN '1.2.3 ' || p_size || '.1.1' ELSE '1.2.3' END AS vienna FROM part", False)
def _(s, d):
    k = col("p_size") % 3
    sample = F.when(k == 0, col("p_partkey").cast("string")).when(k == 1, F.concat(col("p_size"), lit(".1.1"))).otherwise(col("p_name"))
    return part(s, d).select("p_partkey", T.sample_and_vienna(sample, lit("1.2.3")).alias("x")).select("p_partkey", "x.*")


@query("t18_t19_t20_keys", "SELECT id, record_type, mark_category, lineage_key FROM marks")
def _(s, d):
    m = marks(s, d)
    return m.select("id", T.record_type(F.substring("record_type", 1, 1), F.when(col("record_type") == "B_madrid", "1")).alias("record_type"), "mark_category", "lineage_key")


@query("t22_head_before_address", "SELECT irn, regexp_extract(representative, '^[^,0-9]*') AS head FROM madrid")
def _(s, d):
    return madrid(s, d).select("irn", T.head_before_address(col("representative")).alias("head"))


@query("t24_strip_note", "SELECT c_custkey, c_name AS name FROM customer", False)
def _(s, d):
    k = col("c_custkey") % 3
    note = F.when(k == 0, lit("(nhận tại VP2) ")).when(k == 1, lit("(gửi GCN 0948 456 705)(ghép) ")).otherwise("")
    return customer(s, d).select("c_custkey", T.strip_note(F.concat(note, "c_name")).alias("name"))


_DERIVED = """, j AS (SELECT k.*, d.applicant_name AS da, d.mark_text AS dm, d.grant_date AS dg, d.representative AS dr, m.holder_name AS ma, m.mark_text AS mm, m.vn_status, m.vn_grant_date AS mg, m.representative AS mr, m.registration_date AS mreg,
    mark_category LIKE 'domestic%' AS dom, mark_category LIKE 'madrid%' AS mad
    FROM keyed k LEFT JOIN domestic d ON k.application_number = d.application_number LEFT JOIN madrid m ON k.lineage_key = m.irn)"""


@query(
    "t23_t27_derive_dag",
    """SELECT id, coalesce(CASE WHEN dom THEN da WHEN mad THEN ma END, applicant_name) AS applicant_clean,
       trim(coalesce(CASE WHEN dom THEN dr WHEN mad THEN regexp_extract(mr, '^[^,0-9]*') END, CASE WHEN mad THEN regexp_extract(ip_agency, '^[^,0-9]*') ELSE ip_agency END)) AS representative_clean,
       coalesce(mark_sample, CASE WHEN dom THEN dm WHEN mad THEN mm END) AS mark_name,
       CASE WHEN dom THEN dg WHEN mad AND vn_status = 'granted' THEN mg END AS vn_grant_date,
       coalesce(registration_date, CASE record_type WHEN 'B_domestic' THEN dg WHEN 'B_madrid' THEN mreg END) AS registration_date,
       row_number() OVER (PARTITION BY dkey ORDER BY (certificate_number IS NOT NULL) DESC, ((CASE WHEN dom THEN dg WHEN mad AND vn_status = 'granted' THEN mg END) IS NOT NULL) DESC, id DESC) = 1 AS is_representative FROM j""",
    days="registration_date vn_grant_date",
)
def _(s, d):
    out = derive.derive(marks(s, d), domestic(s, d), madrid(s, d))
    return out.select("id", "applicant_clean", "representative_clean", "mark_name", "vn_grant_date", "registration_date", "is_representative")


ORACLE_SQL["t23_t27_derive_dag"] = ORACLE_SQL["t23_t27_derive_dag"].replace(" SELECT id, coalesce(CASE WHEN dom", f"{_DERIVED} SELECT id, coalesce(CASE WHEN dom", 1)


_NORM = "trim(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\t-\r ]+', ' ', 'g'))"
_FIRM = """CASE l_linenumber % 4 WHEN 0 THEN 'Straße  ' || l_suppkey WHEN 1 THEN 'STRASSE ' || l_suppkey || ' ' WHEN 2 THEN 'Cafe' || chr(769) || ' ' || l_suppkey ELSE 'CAFÉ ' || l_suppkey END"""


@query(
    "t21_derived_norms",
    f""", f AS (SELECT {_FIRM} AS owner FROM lineitem) SELECT {_NORM.format('owner')} AS applicant_norm, count(*) AS n FROM f GROUP BY 1""",
)
def _(s, d):
    # Firms in sharp and double s, composed and decomposed: two keys for each supplier.
    k = F.split(col("id"), "-")
    firm = F.when(k[1].cast("int") % 4 == 0, F.concat(lit("Straße  "), k[3])).when(k[1].cast("int") % 4 == 1, F.concat(lit("STRASSE "), k[3], lit(" "))).when(k[1].cast("int") % 4 == 2, F.concat(lit("Cafe\u0301 "), k[3])).otherwise(F.concat(lit("CAFÉ "), k[3]))
    rows = derive.derive(marks(s, d).withColumn("applicant_name", firm), domestic(s, d).limit(0), madrid(s, d).limit(0))
    return rows.groupBy("applicant_norm").agg(F.count("*").alias("n"))


@query(
    "s05_j11_last_sample_wins",
    """, k AS (SELECT application_number AS a, arg_max(v, o) AS v FROM (SELECT application_number, 'first ' || l AS v, 1 AS o FROM (SELECT application_number, mark_text AS l FROM domestic) UNION ALL
      SELECT application_number, 'last ' || l, 2 FROM (SELECT application_number, mark_text AS l FROM domestic) WHERE length(application_number) % 2 = 0) GROUP BY 1)
    SELECT id, coalesce(nullif(mark_sample, ''), v) AS mark_sample FROM marks LEFT JOIN k ON a = application_number""",
)
def _(s, d):
    # A CSV in which half of the numbers come twice, read as an import and used to fill samples.
    from markweave.storage import scratch

    number, text = "210 Application number", "540 Trademark sample"
    dom = domestic(s, d)
    lines = dom.select(F.array(F.struct(lit(1).alias("o"), F.concat(lit("first "), "mark_text").alias(text)), F.struct(lit(2).alias("o"), F.concat(lit("last "), "mark_text").alias(text))).alias("x"), col("application_number").alias(number))
    each = lines.select(number, F.inline("x")).where((col("o") == 1) | (F.length(number) % 2 == 0))
    path = scratch(s, "names-csv")
    each.repartitionByRange(4, "o", number).sortWithinPartitions("o", number).select(number, lit("1/2/03").alias("220 Application submission date"), text).write.option("header", True).csv(path)
    return derive.fill_sample(marks(s, d), readers.name_index(s, path)).select("id", "mark_sample")


@query("t29_fill_sample", "SELECT m.id, coalesce(m.mark_sample, d.mark_text) AS mark_sample FROM marks m LEFT JOIN domestic d ON m.application_number = d.application_number")
def _(s, d):
    names = domestic(s, d).select("application_number", col("mark_text").alias("mark_sample"))
    return derive.fill_sample(marks(s, d), names).select("id", "mark_sample")


@query(
    "t30_overwrite_sample",
    "SELECT count(*) FILTER (application_number IN (SELECT application_number FROM domestic) AND mark_sample IS DISTINCT FROM 'fixed')::BIGINT AS changed FROM marks",
)
def _(s, d):
    dom = domestic(s, d)
    pairs = dom.select(col("application_number").alias("key"), lit("old").alias("sample"), lit(1).cast("long").alias("ordinal")).unionByName(dom.select(col("application_number").alias("key"), lit("fixed").alias("sample"), lit(2).cast("long").alias("ordinal")))
    return derive.overwrite_sample(marks(s, d), pairs, "application_number")[1]


@query(
    "t31_display_status",
    f"""SELECT m.id, CASE WHEN d.status_code IS NOT NULL THEN d.status_code WHEN vn_grant_date IS NOT NULL THEN 'Granted' WHEN expiry_date < DATE '{roles.TODAY}' THEN 'Lapsed' ELSE 'Pending' END AS label,
        CASE WHEN vn_grant_date IS NOT NULL THEN 'ok' WHEN expiry_date < DATE '{roles.TODAY}' THEN 'mute' ELSE 'warn' END AS tone FROM marks m LEFT JOIN domestic d ON m.application_number = d.application_number""",
)
def _(s, d):
    rows = marks(s, d).join(domestic(s, d).select("application_number", "status_code"), "application_number", "left")
    return rows.select("id", T.display_status(col("status_code"), col("vn_grant_date"), col("expiry_date"), lit(TODAY)).alias("x")).select("id", "x.*")


@query("t33_fetch_id", "SELECT id, CASE WHEN length(regexp_replace(application_number, '[^0-9]', '', 'g')) >= 7 THEN 'VN' || regexp_replace(application_number, '-', '', 'g') END AS fetch_id FROM marks")
def _(s, d):
    return marks(s, d).select("id", T.fetch_id(col("application_number")).alias("fetch_id"))


def _back(c: str, n: int) -> str:
    m = f"(date_trunc('month', {c}) - INTERVAL {n} MONTH)"
    return f"make_date(year({m}), month({m}), least(day({c}), 28))"


@query(
    "t34_timeline",
    f"""SELECT id, e.kind AS kind, e.date AS date, e.done AS done FROM (SELECT id, unnest([
        {{'kind': 'filed', 'date': f, 'done': TRUE}}, {{'kind': 'formal', 'date': f + 28, 'done': f + 28 <= t}},
        {{'kind': 'exam', 'date': {_back('p', 3)}, 'done': {_back('p', 3)} <= t}}, {{'kind': 'published', 'date': p, 'done': p <= t}},
        {{'kind': 'opposition', 'date': CASE WHEN a THEN p + 150 END, 'done': p + 150 < t}}, {{'kind': 'registration', 'date': CASE WHEN a THEN p + 300 END, 'done': FALSE}},
        {{'kind': 'registered', 'date': CASE WHEN NOT a THEN registration_date END, 'done': TRUE}}, {{'kind': 'renewal', 'date': CASE WHEN NOT a THEN expiry_date END, 'done': expiry_date < t}}]) AS e
        FROM (SELECT *, coalesce(submission_date, {_back('publication_date', 8)}) AS f, publication_date AS p, record_type = 'A' AS a, DATE '{roles.TODAY}' AS t FROM marks)) WHERE e.date IS NOT NULL""",
    days="date",
)
def _(s, d):
    events_ = T.timeline(col("submission_date"), col("publication_date"), col("record_type"), col("registration_date"), col("expiry_date"), lit(TODAY))
    return marks(s, d).select("id", F.inline(events_))


_INID = {"111": ("certificate_number", "Certificate"), "116": ("madrid_number", "International registration"), "210": ("application_number", "Application"), "220": ("submission_date", "Submission"), "540": ("mark_sample", "Sample")}


@query(
    "t35_inid_rows",
    "SELECT id, u.o::INT AS ordinal, u.c AS code, u.l AS label, u.v AS value FROM (SELECT id, unnest(["
    + ", ".join(f"{{'o': {i}, 'c': '{c}', 'l': '{label}', 'v': {column}::VARCHAR}}" for i, (c, (column, label)) in enumerate(_INID.items()))
    + "]) AS u FROM marks) WHERE u.v <> ''",
)
def _(s, d):
    return layout.inid_rows(marks(s, d), _INID)


@query("t36_display_label", "SELECT id, coalesce(CASE WHEN length(trim(mark_name)) >= 2 THEN trim(mark_name) END, CASE WHEN length(trim(mark_sample)) >= 2 THEN trim(mark_sample) END, '[figurative mark]') AS label FROM marks")
def _(s, d):
    return marks(s, d).select("id", T.display_label(lit(None).cast("string"), col("mark_name"), col("mark_sample")).alias("label"))


@query(
    "t37_logo_path",
    "SELECT id, CASE WHEN regexp_extract(application_number, '4-([0-9]+)-', 1) <> '' AND regexp_extract(application_number, '4-([0-9]+)-', 1)::BIGINT % 2 = 0 THEN 'p/' || application_number || '.png' WHEN madrid_number IS NOT NULL AND madrid_number::BIGINT % 2 = 0 THEN 'p/' || madrid_number || 'A.png' END AS logo_path FROM marks",
)
def _(s, d):
    m = marks(s, d).select("id", "application_number", "certificate_number", "madrid_number")
    stems = lineitem(s, d).where("l_orderkey % 2 = 0").select(F.concat(lit("4-"), "l_orderkey", lit("-"), "l_linenumber").alias("stem")).unionByName(part(s, d).where("p_partkey % 2 = 0").select(F.concat(F.lpad(col("p_partkey").cast("string"), 7, "0"), lit("A")).alias("stem")))
    return layout.logo_path(m, stems.withColumn("path", F.concat(lit("p/"), "stem", lit(".png"))))


@query("t38_query_summary", "SELECT id, concat_ws(' · ', nullif(mark_sample, ''), 'country: ' || applicant_country_code) AS summary FROM marks")
def _(s, d):
    return marks(s, d).select("id", T.query_summary(q=col("mark_sample"), country=col("applicant_country_code")).alias("summary"))


@query("t39_classes", "SELECT doc_id, CASE WHEN regexp_matches(text, '[一-鿿぀-ヿ가-힯]') THEN 'cjk' WHEN regexp_matches(text, '[Ѐ-ӿ]') THEN 'cyrillic' WHEN regexp_matches(text, '[À-ỹ]') THEN 'vn_diacritic' ELSE 'latin' END AS script, CASE WHEN n_chars <= 4 THEN 'short' WHEN n_chars <= 12 THEN 'medium' ELSE 'long' END AS length FROM documents", False)
def _(s, d):
    return documents(s, d).select("doc_id", T.script_class(col("text")).alias("script"), T.length_class(col("text")).alias("length"))


@query("t40_logo_kind", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'figurative' WHEN p_size % 4 = 1 THEN NULL WHEN p_retailprice >= 1500 AND p_size <= 20 THEN 'wordmark' ELSE 'figurative' END AS kind FROM part", False)
def _(s, d):
    k = col("p_size") % 4
    return part(s, d).select("p_partkey", T.logo_kind(F.when(k == 0, F.array(lit("1.1"))), k != 1, col("p_retailprice") / 500, col("p_size") / 100).alias("kind"))


# Pages and events
@query("h01_page_lines")
def _(s, d):
    text = html.unescaped(html.tag_text(col("html")))
    return pages(s, d).select("page_id", text.alias("t")).select("page_id", F.posexplode(html.lines(col("t"))).alias("line_no", "line"))


@query("h10_page_state", "SELECT page_id, CASE WHEN contains(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gis'), '${') THEN 'unrendered' WHEN contains(html, 'product-form-label') THEN 'ok' ELSE 'not_found' END AS state FROM pages", False)
def _(s, d):
    return pages(s, d).select("page_id", html.page_state(col("html")).alias("state"))


def _histories(s, d):
    """Events per user as a registry history: type by event_type, date by day, parties."""
    kind = F.when(col("event_type") == "signup", "Grant of protection, VN").when(col("event_type") == "error", "Total provisional refusal, VN, US").when(col("event_type") == "purchase", "International Registration, VN, FR").otherwise("Renewal, US")
    parties = F.when(col("event_type") == "signup", F.array(lit("VN"))).when(col("event_type") == "error", F.array(lit("VN"), lit("US"))).when(col("event_type") == "purchase", F.array(lit("VN"), lit("FR"))).otherwise(F.array(lit("US")))
    e = events(s, d).select("user_id", kind.alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("g").alias("gazette"), parties.alias("parties"), "event_id")
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "type", "date", "gazette", "parties"))), lambda x: F.struct(x["type"].alias("type"), x["date"].alias("date"), x["gazette"].alias("gazette"), x["parties"].alias("parties"))).alias("history"))


@query("h05_designated", "SELECT user_id, list_sort(list_distinct(flatten(list(CASE event_type WHEN 'signup' THEN ['VN'] WHEN 'error' THEN ['VN', 'US'] WHEN 'purchase' THEN ['VN', 'FR'] ELSE ['US'] END)))) AS countries FROM events GROUP BY 1", False)
def _(s, d):
    return _histories(s, d).select("user_id", F.array_sort(F.array_distinct(F.flatten(F.transform("history", lambda e: e["parties"])))).alias("countries"))


@query(
    "h06_designation_status",
    """SELECT user_id, coalesce(first(CASE event_type WHEN 'signup' THEN 'granted' ELSE 'refused' END ORDER BY ts::DATE, event_id) FILTER (event_type IN ('signup', 'error')), 'pending') AS status,
       strftime(min(ts::DATE) FILTER (event_type IN ('signup', 'error')), '%Y-%m-%d') AS date FROM events GROUP BY 1""",
    False,
)
def _(s, d):
    return _histories(s, d).select("user_id", html.designation_status(lit("VN"), col("history")).alias("x")).select("user_id", "x.status", "x.date")


@query(
    "h11_vn_status",
    """SELECT user_id, day, CASE WHEN user_id % 2 = 0 OR g IS NOT NULL THEN 'granted' WHEN r IS NOT NULL THEN 'refused' ELSE 'pending' END AS status,
       CASE WHEN user_id % 2 = 0 THEN coalesce(g, CASE WHEN r IS NULL THEN p END) ELSE g END AS grant_date,
       CASE WHEN user_id % 2 = 1 AND g IS NULL THEN r END AS refusal_date
       FROM (SELECT user_id, ts::DATE AS day, min(ts::DATE) FILTER (event_type = 'signup') AS g, min(ts::DATE) FILTER (event_type = 'error') AS r, min(ts::DATE) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1, 2)""",
    False,
    days="day grant_date refusal_date",
)
def _(s, d):
    none = lit(None).cast("date")
    return _daily_histories(s, d).select("user_id", "day", html.vn_status(col("history"), F.array(lit("VN")), none, none, col("user_id") % 2 == 0).alias("x")).select("user_id", "day", "x.status", "x.grant_date", "x.refusal_date")


def _daily_histories(s, d):
    """As _histories, one for each user and day: short ones, with all outcomes."""
    kind = F.when(col("event_type") == "signup", "Grant of protection, VN").when(col("event_type") == "error", "Total provisional refusal, VN").when(col("event_type") == "purchase", "International Registration, VN").otherwise("Renewal, VN")
    e = events(s, d).select("user_id", F.to_date("ts").alias("day"), F.struct(kind.alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("date"), lit("g").alias("gazette"), F.array(lit("VN")).alias("parties")).alias("e"))
    return e.groupBy("user_id", "day").agg(F.collect_list("e").alias("history"))


# Filters
SPEC = FilterSpec(country="na", nice_class=("05", "12"), nice_mode="any", record_type="B_domestic", granted=True, grant_from=date(1993, 1, 1), grant_to=date(1999, 1, 1))


@query("f01_free_text", "SELECT id FROM marks WHERE lower(mark_sample) LIKE '%bolt%' OR lower(mark_name) LIKE '%bolt%' OR application_number ILIKE '%bolt%' OR certificate_number ILIKE '%bolt%' OR madrid_number ILIKE '%bolt%'")
def _(s, d):
    return filters.apply(marks(s, d), FilterSpec(q="Bolt")).select("id")


@query("f02_f18_filters", "SELECT id FROM marks WHERE applicant_country_code = 'NA' AND list_has_any(nice_classes, ['05', '12']) AND record_type = 'B_domestic' AND vn_grant_date BETWEEN DATE '1993-01-01' AND DATE '1999-01-01'")
def _(s, d):
    return filters.apply(marks(s, d), SPEC).select("id")


@query("f03_nice_all", "SELECT id FROM marks WHERE list_has_all(nice_classes, ['05', '12'])")
def _(s, d):
    return filters.apply(marks(s, d), FilterSpec(nice_class=("05", "12"))).select("id")


_CODE = "len(list_filter(vienna_codes, lambda c: c = '{0}' OR c LIKE '{0}.%')) > 0"


@query("f05_vienna_all", f"SELECT id FROM marks WHERE {_CODE.format('5.7')} AND {_CODE.format('7.6')}")
def _(s, d):
    return filters.apply(marks(s, d), FilterSpec(vienna=("05.07", "7.6"))).select("id")


@query("f06_vienna_any", f"SELECT id FROM marks WHERE {_CODE.format('5.7')} OR list_contains(vienna_codes, '22.8.6')")
def _(s, d):
    return filters.apply(marks(s, d), FilterSpec(vienna=("5.7", "22.08.06", "junk"), vienna_mode="any")).select("id")


@query("f05_vienna_all_lists", ORACLE_SQL["f05_vienna_all"], False)
def _(s, d):
    return roles.facet_index(s, d).ids(FilterSpec(vienna=("05.07", "7.6")))


@query("f06_vienna_any_lists", ORACLE_SQL["f06_vienna_any"], False)
def _(s, d):
    return roles.facet_index(s, d).ids(FilterSpec(vienna=("5.7", "22.08.06", "junk"), vienna_mode="any"))


@query("f02_f16_bitmap_filters", "SELECT id FROM reps WHERE applicant_country_code = 'NA' AND record_type = 'A' AND year = 1996 AND lower(applicant_name) LIKE '%customer#00000010%'")
def _(s, d):
    return roles.facet_index(s, d).ids(FilterSpec(country="na", record_type="A", year=1996, applicant="customer#00000010"), representatives=True)


@query("f08_normalize_code", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size || '.' || (p_size % 7) ELSE NULL END AS code FROM part", False)
def _(s, d):
    k = col("p_size") % 3
    return part(s, d).select("p_partkey", T.normalize_code(F.when(k == 0, F.concat(lit("0"), "p_size", lit(".0"), col("p_size") % 7)).when(k == 1, "26.a.1").otherwise("26")).alias("code"))


@query("f10_f14_equalities", "SELECT id FROM marks WHERE mark_category = 'domestic_application' AND applicant_type = 'Company' AND applicant_name ILIKE '%00001%' AND ip_agency ILIKE '%supplier%' AND year = 1996")
def _(s, d):
    return filters.apply(marks(s, d), FilterSpec(mark_category="domestic_application", applicant_type="Company", applicant="00001", ip_agency="SUPPLIER", year=1996)).select("id")


@query("f15_designated_country", "SELECT id FROM marks WHERE lineage_key IN (SELECT irn FROM madrid WHERE list_contains(designated_countries, 'VN'))")
def _(s, d):
    return filters.apply(marks(s, d), FilterSpec(designated_country="vn"), madrid(s, d)).select("id")


@query("f16_vn_status", "SELECT id FROM marks WHERE lineage_key IN (SELECT irn FROM madrid WHERE vn_status = 'refused')")
def _(s, d):
    return filters.apply(marks(s, d), FilterSpec(vn_status="refused"), madrid(s, d)).select("id")


@query("f19_exclude_own", "SELECT id FROM marks WHERE applicant_country_code = 'NA' AND record_type = 'B_domestic' AND vn_grant_date BETWEEN DATE '1993-01-01' AND DATE '1999-01-01'")
def _(s, d):
    return filters.apply(marks(s, d), SPEC.without("nice_class")).select("id")


@query("f20_around", "SELECT id FROM marks WHERE publication_date BETWEEN DATE '1996-06-15' - 60 AND DATE '1996-06-15' + 60")
def _(s, d):
    return marks(s, d).where(filters.around(lit(date(1996, 6, 15)))).select("id")


@query("f21_opposition_open", f"SELECT id, (publication_date + 150 - DATE '{roles.TODAY}') <= 14 AS closing FROM marks WHERE record_type = 'A' AND publication_date > DATE '{roles.TODAY}' - 150")
def _(s, d):
    return marks(s, d).where(filters.opposition_open(lit(TODAY))).select("id", F.coalesce(filters.opposition_open(lit(TODAY), 14), lit(False)).alias("closing"))


@query("f22_f24_scalars", "SELECT id FROM marks WHERE mark_sample IS DISTINCT FROM mark_name AND length(mark_sample) BETWEEN 3 AND 16 AND regexp_matches(mark_sample, '^[a-d]')")
def _(s, d):
    return marks(s, d).where(filters.changed(col("mark_sample"), col("mark_name")) & F.length("mark_sample").between(3, 16) & col("mark_sample").rlike("^[a-d]")).select("id")


# Joins and sets
@query("j01_inner", "SELECT m.id, g.issue_number FROM marks m JOIN gazettes g ON m.gazette_id = g.id AND m.month = g.issue_number")
def _(s, d):
    g = gazettes(s, d).withColumnRenamed("id", "gid")
    return marks(s, d).join(g, (col("gazette_id") == col("gid")) & (col("month") == col("issue_number"))).select("id", "issue_number")


@query("j02_left", "SELECT m.id, d.mark_text FROM marks m LEFT JOIN domestic d USING (application_number)")
def _(s, d):
    return linkage.with_record(marks(s, d), "application_number", domestic(s, d).select(col("application_number").alias("_number"), "mark_text"), "_number").select("id", "mark_text")


@query("j03_gated_joins", "SELECT m.id, CASE WHEN mark_category LIKE 'domestic%' THEN d.grant_date WHEN mark_category LIKE 'madrid%' THEN r.vn_grant_date END AS g FROM marks m LEFT JOIN domestic d USING (application_number) LEFT JOIN madrid r ON m.lineage_key = r.irn", days="g")
def _(s, d):
    rows = derive.enriched(marks(s, d), domestic(s, d), madrid(s, d))
    return rows.select("id", F.when(col("mark_category").startswith("domestic"), col("d.grant_date")).when(col("mark_category").startswith("madrid"), col("m.vn_grant_date")).alias("g"))


@query("j04_a25_year_summary", "SELECT issue_year, count(DISTINCT issue_number) AS issues, coalesce(sum(c), 0)::BIGINT AS marks FROM gazettes g LEFT JOIN (SELECT gazette_id, count(*) AS c FROM marks GROUP BY 1) m ON m.gazette_id = g.id GROUP BY 1")
def _(s, d):
    return facets.year_summary(gazettes(s, d), marks(s, d))


@query("j05_best_row", "SELECT dkey, id FROM keyed QUALIFY row_number() OVER (PARTITION BY dkey ORDER BY publication_date DESC NULLS LAST, id) = 1")
def _(s, d):
    rows = marks(s, d).withColumn("dkey", linkage.dedup_key())
    return linkage.best_of_each(rows, ["dkey"], [F.desc_nulls_last("publication_date"), F.asc("id")]).select("dkey", "id")


@query("j06_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')", False)
def _(s, d):
    return customer(s, d).join(orders(s, d).where("o_orderpriority LIKE '1%'").select(col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("j07_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", False)
def _(s, d):
    return orders(s, d).join(lineitem(s, d).select(col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("j08_work_list", "SELECT DISTINCT application_number FROM marks WHERE application_number <> '' AND application_number NOT IN (SELECT application_number FROM domestic) AND application_number NOT IN (SELECT application_number FROM marks WHERE application_number IS NOT NULL AND n1 % 5 = 0)")
def _(s, d):
    m = marks(s, d)
    missing = m.where("n1 % 5 = 0").select("application_number").where("application_number IS NOT NULL").distinct().withColumn("last_checked_at", F.to_timestamp(lit("2024-01-20")))
    return incremental.work_list(m, domestic(s, d), missing, "application_number", F.to_timestamp(lit("2024-02-01")))


@query("j09_q12_coverage", """, k AS (SELECT CASE WHEN d.application_number IS NOT NULL THEN 'enriched' WHEN x.application_number IS NOT NULL THEN 'not_found' ELSE 'not_tried' END AS kind FROM marks m LEFT JOIN domestic d USING (application_number)
      LEFT JOIN (SELECT DISTINCT application_number FROM marks WHERE n1 % 5 = 0) x USING (application_number) WHERE m.application_number IS NOT NULL)
    SELECT kind, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM k), 2) AS pct FROM k GROUP BY 1""")
def _(s, d):
    m = marks(s, d)
    return quality.enrichment_coverage(m, domestic(s, d), m.where("n1 % 5 = 0").select("application_number").distinct())


@query("j10_a07_vn_status_facet", "SELECT vn_status AS value, count(*) AS n FROM reps JOIN madrid ON lineage_key = irn GROUP BY 1")
def _(s, d):
    return facets.facet_vn_status(marks(s, d), madrid(s, d))


@query("j12_d04_scope", "SELECT id FROM keyed WHERE dkey IN (SELECT dkey FROM keyed WHERE gazette_id = 'g1996')")
def _(s, d):
    keyed = marks(s, d).withColumn("dkey", linkage.dedup_key())
    return keyed.join(keyed.where("gazette_id = 'g1996'").select("dkey").distinct(), "dkey", "left_semi").select("id")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_NAMES = f", n AS (SELECT DISTINCT p_name AS v, {_GRAMS.format('p_name')} AS g FROM part)"


@query("j13_similarity_join", f"{_NAMES} SELECT a.v AS a, b.v AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS similarity FROM n a JOIN n b ON a.v < b.v WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.15")
def _(s, d):
    return search.name_neighbours(part(s, d), "p_name").withColumn("similarity", F.round("similarity", 6))


@query(
    "j13_anchored_neighbours",
    f""", n AS (SELECT DISTINCT v, {_GRAMS.format('v')} AS g FROM (SELECT mark_sample AS v FROM marks UNION SELECT mark_name FROM marks) WHERE v IS NOT NULL),
    a AS (SELECT * FROM n WHERE v IN (SELECT p_name FROM part WHERE p_partkey % 20 = 0))
    SELECT a.v AS anchor, n.v AS name, round(len(list_intersect(a.g, n.g)) / (len(a.g) + len(n.g) - len(list_intersect(a.g, n.g))), 6) AS similarity FROM a JOIN n ON a.v <> n.v
    WHERE len(list_intersect(a.g, n.g)) / (len(a.g) + len(n.g) - len(list_intersect(a.g, n.g))) >= 0.15""",
)
def _(s, d):
    # The names that are asked about, against all names of all marks.
    names = marks(s, d).select(col("mark_sample").alias("anchor")).where("anchor IS NOT NULL").join(part(s, d).where("p_partkey % 20 = 0").select(col("p_name").alias("anchor")), "anchor", "left_semi")
    return roles.name_index(s, d).neighbours(names, search.THRESHOLD).withColumn("similarity", F.round("similarity", 6))


@query("f25_names_sharing", f""", n AS (SELECT DISTINCT v, {_GRAMS.format('v')} AS g FROM (SELECT mark_sample AS v FROM marks UNION SELECT mark_name FROM marks) WHERE v IS NOT NULL),
    q AS (SELECT {_GRAMS.format("'cold bolt'")} AS q) SELECT v AS name, round(len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))), 6) AS t FROM n, q
    WHERE len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))) >= 0.15""")
def _(s, d):
    return roles.name_index(s, d).sharing("cold bolt", search.THRESHOLD).withColumn("t", F.round("t", 6))


@query("j14_as_of", "SELECT e.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'view' AND b.event_id <= e.event_id) AS last_view FROM events e", False)
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(s, d).select("event_id", F.last(F.when(col("event_type") == "view", col("event_id")), True).over(w).alias("last_view"))


@query("u01_u03_sets", "SELECT application_number FROM marks WHERE n1 = 3 UNION SELECT application_number FROM marks WHERE n2 = 4")
def _(s, d):
    m = marks(s, d)
    return m.where("n1 = 3").select("application_number").union(m.where("n2 = 4").select("application_number")).distinct()


@query("u02_array_sets", "SELECT id, list_sort(list_distinct(list_concat(nice_classes, ['05']))) AS added, list_sort(list_filter(nice_classes, lambda x: x <> '05')) AS less FROM marks WHERE nice_classes IS NOT NULL")
def _(s, d):
    five = F.array(lit("05"))
    return marks(s, d).where("nice_classes IS NOT NULL").select("id", F.array_sort(F.array_union("nice_classes", five)).alias("added"), F.array_sort(F.array_except("nice_classes", five)).alias("less"))


# Aggregations
@query("a01_count", "SELECT count(*) AS n FROM marks")
def _(s, d):
    return marks(s, d).agg(F.count("*").alias("n"))


def _top(column: str, source: str = "reps", limit: int = 20) -> str:
    return f"SELECT {column} AS value, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT {limit}"


@query("a02_top_countries", _top("applicant_country_code", "marks", 10))
def _(s, d):
    return facets.top_counts(marks(s, d), "applicant_country_code", 10)


@query("a03_nice_counts", "SELECT value, count(*) AS n FROM (SELECT unnest(nice_classes) AS value FROM marks) GROUP BY 1")
def _(s, d):
    return facets.top_counts(marks(s, d).select(F.explode("nice_classes").alias("c")), "c")


@query("a04_facet_country", _top("applicant_country_code"))
def _(s, d):
    return facets.facet(marks(s, d), "applicant_country_code", "country")


@query("a04_facet_applicant", _top("applicant_name", "(SELECT * FROM reps WHERE record_type = 'A')", 8))
def _(s, d):
    return facets.facet(marks(s, d), "applicant_name", "applicant", FilterSpec(record_type="A", applicant="x"), 8)


@query("a05_facet_nice", "SELECT value, count(*) AS n FROM (SELECT unnest(nice_classes) AS value FROM reps) GROUP BY 1")
def _(s, d):
    return facets.facet_nice(marks(s, d))


@query("a06_facet_category", "SELECT mark_category AS value, count(*) AS n, CASE mark_category WHEN 'domestic_application' THEN 'Domestic application' WHEN 'domestic_registration' THEN 'Domestic registration' WHEN 'madrid_registration' THEN 'Madrid registration' ELSE 'Madrid renewal' END AS label FROM reps GROUP BY 1")
def _(s, d):
    return facets.facet_category(marks(s, d))


@query("a08_facet_granted", "SELECT count(vn_grant_date) AS granted FROM reps")
def _(s, d):
    return facets.facet_granted(marks(s, d))


@query(
    "a09_facets_all",
    f"""SELECT 'country' AS facet, * FROM ({_top('applicant_country_code')}) UNION ALL SELECT 'nice', value, count(*) FROM (SELECT unnest(nice_classes) AS value FROM reps) GROUP BY 2
        UNION ALL SELECT 'applicant', * FROM ({_top('applicant_name', limit=8)}) UNION ALL SELECT 'ip_agency', * FROM ({_top('ip_agency', limit=8)})
        UNION ALL SELECT 'mark_category', mark_category, count(*) FROM reps GROUP BY 2 UNION ALL SELECT 'granted', 'true', count(vn_grant_date) FROM reps""",
)
def _(s, d):
    return facets.facets_all(marks(s, d))


_FILTERED = "record_type = 'A' AND list_contains(nice_classes, '05')"


@query("a04_bitmap_country", _top("applicant_country_code"))
def _(s, d):
    return roles.facet_index(s, d).facet("country")


@query("a09_bitmap_facets", ORACLE_SQL["a09_facets_all"], False)
def _(s, d):
    return roles.facet_index(s, d).facets()


@query(
    "a09_f19_bitmap_filtered",
    f""", f AS (SELECT * FROM reps WHERE record_type = 'A') SELECT 'country' AS facet, * FROM ({_top('applicant_country_code', f"(SELECT * FROM reps WHERE {_FILTERED})")})
        UNION ALL SELECT 'nice', value, count(*) FROM (SELECT unnest(nice_classes) AS value FROM f) GROUP BY 2
        UNION ALL SELECT 'applicant', * FROM ({_top('applicant_name', f"(SELECT * FROM reps WHERE {_FILTERED})", 8)}) UNION ALL SELECT 'ip_agency', * FROM ({_top('ip_agency', f"(SELECT * FROM reps WHERE {_FILTERED})", 8)})
        UNION ALL SELECT 'mark_category', mark_category, count(*) FROM reps WHERE {_FILTERED} GROUP BY 2
        UNION ALL SELECT 'granted', 'true', count(vn_grant_date) FROM reps WHERE {_FILTERED} HAVING count(vn_grant_date) > 0""",
)
def _(s, d):
    return roles.facet_index(s, d).facets(FilterSpec(record_type="A", nice_class=("05",)))


_STREAMS = ", ".join(f"count(*) FILTER (mark_category = '{v}') AS {k}" for k, v in {"applications": "domestic_application", "registrations": "domestic_registration", "madrid": "madrid_registration", "renewals": "madrid_renewal"}.items())


@query("a10_year_streams", f"SELECT year, {_STREAMS} FROM marks GROUP BY 1")
def _(s, d):
    return facets.year_streams(marks(s, d))


def _rollup(s, d):
    """The marks taken in gazette by gazette, once for a session."""
    from markweave.operators.rollup import Rollup
    from markweave.storage import scratch

    key = f"markweave.rollup.{d.rstrip('/')}"
    if not s.conf.get(key, None):
        # The rows of a gazette come to it as a file of its own.
        path, files = scratch(s, "rollup"), scratch(s, "gazette-rows")
        Rollup.columns(marks(s, d), "gazette_id").write.partitionBy("gazette_id").parquet(files)
        rollup, m = Rollup(s, path), s.read.parquet(files)
        for r in m.select("gazette_id").distinct().collect():  # of some seven years
            rollup.put(r.gazette_id, m.where(col("gazette_id") == r.gazette_id))
        s.conf.set(key, path)
    return Rollup(s, s.conf.get(key))


@query("a10_rollup_streams", f"SELECT year, {_STREAMS} FROM marks GROUP BY 1")
def _(s, d):
    return _rollup(s, d).year_streams()


@query("a12_rollup_distinct", "SELECT record_type, count(DISTINCT dkey) AS n FROM keyed GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT dkey) FROM keyed")
def _(s, d):
    return _rollup(s, d).distinct_counts()


@query("a12_sketch_within", "SELECT record_type, true AS within FROM keyed GROUP BY 1 UNION ALL SELECT NULL, true")
def _(s, d):
    exact = _rollup(s, d).distinct_counts().select(col("record_type").alias("_r"), col("n").alias("_n"))
    both = _rollup(s, d).sketched_counts().join(exact, col("record_type").eqNullSafe(col("_r")))
    return both.select("record_type", (F.abs(col("n") - col("_n")) <= 0.03 * col("_n")).alias("within"))


@query("a11_totals", f"SELECT {_STREAMS} FROM marks")
def _(s, d):
    counts = facets.year_streams(marks(s, d))
    return facets.totals(counts, ["applications", "registrations", "madrid", "renewals"])


@query("a12_distinct_counts", "SELECT record_type, count(DISTINCT dkey) AS n FROM keyed GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT dkey) FROM keyed")
def _(s, d):
    return facets.distinct_counts(marks(s, d).withColumn("dkey", linkage.dedup_key()), "dkey", "record_type")


_PAIRS = ", p AS (SELECT lower(mark_sample) AS key, coalesce(mark_name, mark_sample) AS raw, count(*) AS c FROM marks WHERE mark_sample IS NOT NULL GROUP BY 1, 2)"


@query("a13_top_spelling", f"{_PAIRS} SELECT key, first(raw ORDER BY c DESC, raw) AS display, sum(c)::BIGINT AS n FROM p GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def _(s, d):
    return facets.top_spelling(marks(s, d), F.lower("mark_sample"), F.when(col("mark_sample").isNotNull(), F.coalesce("mark_name", "mark_sample")))


@query("a14_top_entities", ", p AS (SELECT lower(mark_sample) AS key, coalesce(mark_name, mark_sample) AS raw, count(*) AS c, min(id) AS o FROM marks WHERE mark_sample IS NOT NULL GROUP BY 1, 2) SELECT key, first(raw ORDER BY c DESC, o) AS display, sum(c)::BIGINT AS n FROM p GROUP BY 1 ORDER BY n DESC, key LIMIT 10")
def _(s, d):
    return facets.top_entities(marks(s, d), F.lower("mark_sample"), F.coalesce("mark_name", "mark_sample"), col("id"))


@query("a15_histogram", "SELECT v AS value, (SELECT count(*) FROM orders WHERE o_orderstatus = v) AS n FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS v)", False)
def _(s, d):
    return facets.histogram(orders(s, d), "o_orderstatus", ["F", "O", "P", "X"])


@query("a16_gaps", """, g AS (SELECT DISTINCT issue_year AS year, issue_number AS issue FROM gazettes WHERE (issue_year + issue_number) % 3 <> 0)
    SELECT y::INT AS year, i::INT AS issue FROM (SELECT unnest(range(min(year), max(year) + 1)) AS y FROM g), (SELECT unnest(range(1, 25)) AS i) WHERE (y, i) NOT IN (SELECT (year, issue) FROM g) ORDER BY 1, 2 LIMIT 50""")
def _(s, d):
    g = gazettes(s, d).where("(issue_year + issue_number) % 3 <> 0")
    return facets.gaps(g.select(col("issue_year").alias("year"), col("issue_number").alias("issue")))


@query("a17_never_true", "SELECT o_custkey::VARCHAR AS key FROM orders GROUP BY o_custkey HAVING NOT bool_or(o_orderstatus = 'P')", False)
def _(s, d):
    return facets.never_true(orders(s, d).withColumn("p", col("o_orderstatus") == "P"), col("o_custkey").cast("string"), "p")


@query("a19_coverage", """, u AS (SELECT DISTINCT application_number AS k, k2.application_number IS NOT NULL AS v, bool_or(n1 % 5 = 0) AS p FROM marks m LEFT JOIN (SELECT application_number FROM domestic) k2 USING (application_number) WHERE application_number <> '' GROUP BY 1, 2)
    SELECT count(*) AS unique_keys, count(*) FILTER (v) AS validated, least(count(*) FILTER (p AND NOT v), count(*) - count(*) FILTER (v)) AS pending, count(*) - count(*) FILTER (v) AS remaining, round(100.0 * count(*) FILTER (v) / count(*), 2) AS pct FROM u""")
def _(s, d):
    m = marks(s, d)
    return facets.coverage(m, domestic(s, d), m.where("n1 % 5 = 0"), "application_number")


@query("a20_unresolved", """, u AS (SELECT application_number, id FROM marks WHERE application_number <> '' AND application_number NOT IN (SELECT application_number FROM domestic) QUALIFY row_number() OVER (PARTITION BY application_number ORDER BY id) = 1)
    SELECT application_number, id, CASE WHEN length(regexp_replace(application_number, '[^0-9]', '', 'g')) >= 7 THEN 'fetchable' ELSE 'malformed' END AS kind FROM u ORDER BY kind, application_number LIMIT 50""")
def _(s, d):
    out = facets.unresolved(marks(s, d), [domestic(s, d)], "application_number", [F.asc("id")], T.fetch_id(col("application_number")))
    return out.select("application_number", "id", "kind")


@query("a21_portfolio", "SELECT count(*) AS total, count(*) FILTER (record_type = 'A') AS pending, count(*) FILTER (record_type <> 'A') AS active FROM reps WHERE applicant_name = 'Customer#000000255'")
def _(s, d):
    return facets.portfolio(marks(s, d), "Customer#000000255")


@query("a22_st11_watchlists", f"""SELECT 'bolts' AS name, count(*) AS total, count(*) FILTER (publication_date >= DATE '{roles.TODAY}' - 30) AS new FROM marks WHERE lower(mark_sample) LIKE '%bolt%' OR lower(mark_name) LIKE '%bolt%'
    UNION ALL SELECT 'class 5', count(*), count(*) FILTER (publication_date >= DATE '{roles.TODAY}' - 30) FROM marks WHERE list_contains(nice_classes, '05')""")
def _(s, d):
    return facets.watch_counts(marks(s, d), {"bolts": FilterSpec(q="bolt"), "class 5": FilterSpec(nice_class=("05",))}, lit(TODAY))


def _changes(s, d):
    """The marks as a stream of three micro-batches in another order, a tenth of them twice;
    once for a session."""
    from markweave.storage import saved, scratch

    key = f"markweave.changes.{d.rstrip('/')}"
    if not s.conf.get(key, None):
        watch = {"bolts": FilterSpec(q="bolt"), "class 5": FilterSpec(nice_class=("05",))}
        path, out = scratch(s, "events"), scratch(s, "changes")
        # A turn is a micro-batch of files that many tasks write.
        rows, turn, files = marks(s, d), lambda n: F.pmod(F.xxhash64("id") + n, lit(3)), int(s.conf.get("spark.sql.shuffle.partitions"))
        events = stateful.mark_events(rows, watch, lit(1)).withColumn("_again", F.split("id", "-")[2].cast("long") % 10 == 0)
        table = saved(events, "mark-events")
        for i in range(3):
            table.where((turn(0) == i) | ((turn(2) == i) & col("_again"))).drop("_again").repartition(files).write.mode("append").parquet(path)
        stream = s.readStream.schema(events.drop("_again").schema).option("maxFilesPerTrigger", files).parquet(path)
        stateful.mark_changes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(s, "stream")).trigger(availableNow=True).start().awaitTermination()
        s.conf.set(key, out)
    return s.read.schema(stateful.CHANGE).parquet(s.conf.get(key))


@query("d02_d04_streamed_flags", "SELECT id FROM reps")
def _(s, d):
    return stateful.representatives_of(_changes(s, d))


@query("a22_st11_streamed_counts", ORACLE_SQL["a22_st11_watchlists"], False)
def _(s, d):
    return stateful.watch_counts_of(_changes(s, d), lit(TODAY))


@query("a23_this_quarter", "SELECT count(*) FILTER (month >= 4) AS quarter, count(*) AS year FROM marks WHERE year = 1997")
def _(s, d):
    return facets.this_quarter(marks(s, d), lit(TODAY))


@query("a24_overview", "SELECT record_type, mark_category, count(*) AS n FROM marks GROUP BY 1, 2")
def _(s, d):
    return marks(s, d).groupBy("record_type", "mark_category").agg(F.count("*").alias("n"))


@query("a26_wilson", "SELECT source, round(greatest(0, (p + 1.9208 / n) / (1 + 3.8416 / n) - h), 6) AS low, round(h, 6) AS half FROM (SELECT source, p, n, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS h FROM (SELECT source, avg(quality) AS p, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1))", False)
def _(s, d):
    rows = labels(s, d).join(documents(s, d).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    return rows.select("source", scoring.wilson(col("k"), col("n")).alias("w")).select("source", F.round("w.low", 6).alias("low"), F.round("w.half", 6).alias("half"))


@query("a27_percentiles", "SELECT event_type, v[least(n, floor(0.5 * n)::INT + 1)] AS p50, v[least(n, floor(0.95 * n)::INT + 1)] AS p95 FROM (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)", False)
def _(s, d):
    return facets.percentile_at(events(s, d), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("a28_retrieval", "SELECT toxic, round(tp / (tp + fn), 4) AS recall, round(tp / (tp + fp), 4) AS precision, round(2 * tp / (2 * tp + fp + fn), 4) AS f1 FROM (SELECT toxic, sum(quality)::DOUBLE AS tp, sum((doc_id % 3 = 0)::INT)::DOUBLE AS fp, sum((doc_id % 4 = 0)::INT)::DOUBLE AS fn FROM labels GROUP BY 1)", False)
def _(s, d):
    rows = labels(s, d).select("toxic", col("quality").alias("tp"), (col("doc_id") % 3 == 0).cast("int").alias("fp"), (col("doc_id") % 4 == 0).cast("int").alias("fn"))
    return facets.retrieval_scores(rows, ["toxic"])


@query("a29_saturation", "SELECT min(level)::BIGINT AS saturation FROM (SELECT user_id % 10 AS level, quantile_disc(value, 0.95) AS p95, count(*) FILTER (event_type = 'error') / count(*) AS e FROM events GROUP BY 1) WHERE e > 0.01", False)
def _(s, d):
    levels = events(s, d).groupBy((col("user_id") % 10).alias("level")).agg(lit(0.0).alias("p95"), F.count_if(col("event_type") == "error").alias("errors"), F.count("*").alias("requests"))
    return facets.saturation(levels, 1e9)


@query("a30_hamming", """, c AS (SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 16))::UBIGINT AS h, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part),
    b AS (SELECT bit_count(xor(x.h, y.h))::INT AS distance, count(*) AS n FROM c x JOIN c y ON y.i = x.i + 1 AND x.i % 2 = 0 GROUP BY 1) SELECT distance, n, round(100.0 * sum(n) OVER (ORDER BY distance) / sum(n) OVER (), 2) AS cumulative FROM b""")
def _(s, d):
    return facets.hamming_histogram(part(s, d).select("p_partkey", F.substring(F.md5("p_name"), 1, 16).alias("h")), "h", "p_partkey")


@query("a31_check_report", "SELECT o_orderpriority AS check, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS other, round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) FILTER (o_orderstatus <> 'P'), 4) AS rate FROM orders GROUP BY 1", False)
def _(s, d):
    status = F.when(col("o_orderstatus") == "F", "pass").when(col("o_orderstatus") == "O", "fail").otherwise("skip")
    return facets.check_report(orders(s, d).select(col("o_orderpriority").alias("check"), status.alias("status")))


_OUTCOME = "CASE event_type WHEN 'error' THEN 'flaky' WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'block' ELSE 'success' END ELSE 'success' END"


def _outcomes(s, d):
    return events(s, d).select((col("user_id") % 7).alias("job"), "event_id", F.expr(_OUTCOME).alias("outcome"))


_TALLY = f""", o AS (SELECT user_id % 7 AS job, event_id, {_OUTCOME} AS outcome FROM events), w AS (SELECT job, outcome, ((row_number() OVER (PARTITION BY job ORDER BY event_id) - 1) // 20)::BIGINT AS "window" FROM o),
    t AS (SELECT job, "window", count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome = 'flaky') AS flaky, count(*) FILTER (outcome = 'block') AS block FROM w GROUP BY 1, 2),
    v AS (SELECT *, CASE WHEN block > 0 THEN 'block' WHEN success / (success + flaky + block) < 0.7 THEN 'ease' WHEN success / (success + flaky + block) >= 0.95 THEN 'probe' ELSE 'hold' END AS verdict FROM t)"""


@query("a32_window_tallies", f"{_TALLY} SELECT * FROM v")
def _(s, d):
    return incremental.window_tallies(_outcomes(s, d), ["job"], "event_id")


@query("st03_concurrency", f"""{_TALLY.replace(', o AS', 'WITH RECURSIVE o AS', 1)},
    fold(job, "window", level, blocked, given_up) AS (
      SELECT DISTINCT job, -1::BIGINT, {incremental.START}, 0, false FROM v
      UNION ALL
      SELECT job, "window", CASE WHEN f.given_up THEN f.level ELSE new END, CASE WHEN f.given_up THEN f.blocked ELSE bad END, f.given_up OR bad >= {incremental.GIVE_UP}
      FROM (SELECT v.job, v."window", f AS f, CASE v.verdict WHEN 'block' THEN greatest({incremental.FLOOR}, f.level // 2) WHEN 'ease' THEN greatest({incremental.FLOOR}, f.level - 1)
              WHEN 'probe' THEN least({incremental.CEILING}, f.level + 1) ELSE f.level END AS new, CASE WHEN v.verdict = 'block' THEN f.blocked + 1 ELSE 0 END AS bad
            FROM fold f JOIN v ON v.job = f.job AND v."window" = f."window" + 1))
    SELECT job, arg_max(level, "window")::INT AS level, arg_max(given_up, "window") AS given_up FROM fold GROUP BY 1""", False)
def _(s, d):
    return incremental.concurrency(incremental.window_tallies(_outcomes(s, d), ["job"], "event_id"), ["job"])


@query("w06_st07_streaks", """SELECT user_id, event_id, streak::BIGINT AS streak, streak >= 2 AS tripped FROM (SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, g ORDER BY event_id) AS streak
    FROM (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events))""", False)
def _(s, d):
    return incremental.streaks(events(s, d).select("user_id", "event_id", "event_type"), ["user_id"], "event_id", col("event_type") == "error", 2).select("user_id", "event_id", "streak", "tripped")


@query("w03_first_date", "SELECT user_id, event_id, first(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS first_seen FROM events", False)
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events(s, d).select("user_id", "event_id", F.first(F.when(col("event_type") == "purchase", col("ts")), True).over(w).alias("first_seen"))


ORACLE_SQL["w03_first_date"] = "SELECT user_id, event_id, first_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_seen FROM events"


# Linkage
@query("d01_dedup_key", "SELECT id, dkey FROM keyed")
def _(s, d):
    return marks(s, d).select("id", linkage.dedup_key().alias("dkey"))


@query("d02_w01_representative", "SELECT id, is_representative FROM ranked")
def _(s, d):
    return linkage.with_representative(marks(s, d)).select("id", "is_representative")


@query("d02_recompute_changes", "SELECT id, is_representative FROM ranked WHERE is_representative IS DISTINCT FROM (n1 % 2 = 0)")
def _(s, d):
    return linkage.recompute(marks(s, d).withColumn("is_representative", col("n1") % 2 == 0))


@query("d03_representatives", "SELECT id FROM reps WHERE applicant_country_code = 'NA' AND year = 1995")
def _(s, d):
    return linkage.representatives(marks(s, d)).where("applicant_country_code = 'NA' AND year = 1995").select("id")


@query("d05_filter_then_dedup", "SELECT id FROM keyed WHERE year = 1995 QUALIFY row_number() OVER (PARTITION BY dkey ORDER BY (certificate_number IS NOT NULL) DESC, (vn_grant_date IS NOT NULL) DESC, id DESC) = 1")
def _(s, d):
    return search.deduped(marks(s, d).where("year = 1995")).select("id")


@query("d06_co_marks", "SELECT id FROM reps WHERE applicant_name = 'Customer#000000255' AND dkey <> '4-1-1' ORDER BY publication_date DESC NULLS FIRST, id LIMIT 6")
def _(s, d):
    return search.co_marks(marks(s, d), "Customer#000000255", "4-1-1").select("id")


@query("d08_compare_stats", "SELECT count(*) AS scanned, count(*) FILTER (mark_sample IS DISTINCT FROM mark_name) AS updated, count(*) FILTER (mark_sample IS NOT DISTINCT FROM mark_name) AS unchanged FROM marks")
def _(s, d):
    m = marks(s, d)
    return linkage.compare(m.select("id", "mark_sample"), m.select("id", col("mark_name").alias("mark_sample")), "id", ["mark_sample"])[1]


# Scores
@query("x01_trigram", f"SELECT p_partkey, round(len(list_intersect({_GRAMS.format('p_name')}, {_GRAMS.format(chr(39) + 'cold bolt' + chr(39))})) / len(list_distinct(list_concat({_GRAMS.format('p_name')}, {_GRAMS.format(chr(39) + 'cold bolt' + chr(39))}))), 6) AS s FROM part", False)
def _(s, d):
    return part(s, d).select("p_partkey", F.round(scoring.trigram_similarity(col("p_name"), lit("cold bolt")), 6).alias("s"))


@query("x02_jaro_winkler", "SELECT p_partkey, round(jaro_winkler_similarity(p_name, 'cold bolt'), 6) AS s FROM part", False)
def _(s, d):
    names = part(s, d).select("p_name").distinct().withColumn("s", F.round(phonetics.jaro_winkler_similarity("p_name", lit("cold bolt")), 6))
    return part(s, d).join(names, "p_name").select("p_partkey", "s")


@query("x03_double_metaphone")
def _(s, d):
    return part(s, d).select("p_name").distinct().select("p_name", phonetics.double_metaphones(col("p_name")).alias("c")).select("p_name", "c.*")


@query("x04_fold_name", "SELECT doc_id, trim(regexp_replace(upper(strip_accents(replace(replace(replace(text, 'ß', 'ss'), 'đ', 'd'), 'Đ', 'D'))), '\\s+', ' ', 'g')) AS folded FROM documents", False)
def _(s, d):
    return documents(s, d).select("doc_id", phonetics.folded("text").alias("folded"))


@query("x08_vn_keys")
def _(s, d):
    n = part(s, d).select("p_name").distinct()
    return n.select("p_name", phonetics.vietnamese_key("p_name").alias("key"), phonetics.seems_vietnamese("p_name").alias("vietnamese"))


@query("x09_phonetic")
def _(s, d):
    n = part(s, d).select("p_name").distinct()
    return n.select("p_name", phonetics.phonetic_similarity("p_name", lit("cold bolt")).alias("score"))


@query("x10_visual_hash", "SELECT id, greatest(0.0, 1 - bit_count(xor(('0x' || logo_phash)::UBIGINT, ('0x' || substr(md5('cold bolt'), 1, 16))::UBIGINT)) / 10)::DOUBLE AS s FROM marks WHERE logo_phash IS NOT NULL")
def _(s, d):
    return marks(s, d).where("logo_phash IS NOT NULL").select("id", scoring.visual_hash_score(col("logo_phash"), F.substring(F.md5(lit("cold bolt")), 1, 16)).alias("s"))


@query("x11_semantic", "SELECT b.vec_id, round(greatest(0, least(1, (list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) - 0.5) / 0.5)), 3) AS s FROM embeddings a, embeddings b WHERE a.vec_id = 0", False)
def _(s, d):
    e = embeddings(s, d)
    anchor = e.where("vec_id = 0").select(col("embedding").alias("a")).limit(1)
    return e.join(F.broadcast(anchor), lit(True)).select("vec_id", scoring.semantic_score(col("a"), col("embedding")).alias("s"))


@query("x12_overlap", "SELECT id, round(len(list_intersect(nice_classes, ['05', '12'])) / len(list_distinct(list_concat(nice_classes, ['05', '12']))), 6) AS s FROM marks WHERE nice_classes IS NOT NULL UNION ALL SELECT id, 0 FROM marks WHERE nice_classes IS NULL")
def _(s, d):
    return marks(s, d).select("id", F.round(scoring.set_overlap(col("nice_classes"), F.array(lit("05"), lit("12"))), 6).alias("s"))


@query(
    "x14_composite",
    """, a AS (SELECT p_partkey, (p_partkey % 101) / 101 AS p, (p_size % 11) / 11 AS v, (p_partkey % 7) / 7 AS s, (p_partkey % 5) / 5 AS c, (p_size % 3) / 3 AS w, p_partkey % 2 = 0 AS h FROM part),
    b AS (SELECT *, CASE WHEN h AND v >= 0.5 THEN 1.15 ELSE 1 END AS t, CASE WHEN h AND v >= 0.5 THEN 0.3 ELSE 0.15 END AS wv, greatest(p, s, CASE WHEN h THEN v END) AS g FROM a),
    e AS (SELECT *, round((0.35 * p + wv * v + 0.15 * s) / t + (0.2 * c + 0.15 * w) / t * greatest(0, least(1, (g - 0.3) / 0.4)), 3) AS score FROM b)
    SELECT p_partkey, score, CASE WHEN score >= 0.7 AND g >= 0.7 AND c >= 0.3 THEN 'Likely conflict' WHEN score >= 0.5 AND g >= 0.5 AND c >= 0.2 THEN 'Possible conflict' ELSE 'Low risk' END AS verdict FROM e""",
)
def _(s, d):
    k, z = col("p_partkey"), col("p_size")
    x = scoring.composite(k % 101 / 101, z % 11 / 11, k % 7 / 7, k % 5 / 5, z % 3 / 3, k % 2 == 0)
    return part(s, d).select("p_partkey", x.alias("x")).select("p_partkey", "x.score", "x.verdict")


@query(
    "x15_text_search",
    """, h AS (SELECT * FROM keyed WHERE lower(mark_sample) LIKE '%cold b%' OR lower(mark_name) LIKE '%cold b%' QUALIFY row_number() OVER (PARTITION BY dkey ORDER BY (certificate_number IS NOT NULL) DESC, (vn_grant_date IS NOT NULL) DESC, id DESC) = 1)
    SELECT id, CASE WHEN lower(mark_sample) = 'cold b' OR lower(mark_name) = 'cold b' THEN 0.98 ELSE 0.92 END::DOUBLE AS score FROM h""",
)
def _(s, d):
    return search.search_text(marks(s, d), "cold b").select("id", "score")


@query("x16_code_coverage", f"SELECT id, round((({_CODE.format('5.7')})::INT + (list_contains(vienna_codes, '22.8.6'))::INT) / 2, 3) AS score FROM reps")
def _(s, d):
    return search.search_codes(marks(s, d), ["5.7", "22.8.6"]).select("id", "score")


@query("x17_filter_search", "SELECT id, 1.0::DOUBLE AS score FROM reps WHERE record_type = 'A' AND year = 1996")
def _(s, d):
    return search.search_filters(marks(s, d), FilterSpec(record_type="A", year=1996)).select("id", "score")


@query("x21_sound_search")
def _(s, d):
    return search.page(search.search_sound(marks(s, d), "cold bolt", index=roles.name_index(s, d)), search.sort_keys("similarity"), 50).select("id", "mark_sample", "score")


@query("x21_similar_marks")
def _(s, d):
    m = marks(s, d).withColumns({"logo_kind": lit(None).cast("string"), "mark_embedding": lit(None).cast("array<float>")})
    out = search.similar_marks(m, roles.first_mark(s, d), index=roles.name_index(s, d))
    return out.select("b_id", "scores.phonetic", "scores.result.score", "scores.result.verdict")


@query("x22_phash")
def _(s, d):
    # A vector of w numbers as a grey image: number i of it is pixel i, i + w and so on, each row of them brighter.
    grey = F.expr("transform(sequence(0, 1023), i -> double(embedding[i % size(embedding)]) * (i div size(embedding) + 1))")
    return embeddings(s, d).select("vec_id", images.phash(grey).alias("phash"))


@query("x23_l2_normalize", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS n FROM embeddings", False)
def _(s, d):
    scaled = embeddings(s, d).select("vec_id", F.transform("embedding", lambda x: (x * 3).cast("float")).alias("v"))
    return scaled.select("vec_id", F.round(scoring.dot(scoring.l2_normalize(col("v")), scoring.l2_normalize(col("v"))), 4).alias("n"))


# Order and pages
@query("o01_nulls_last", "SELECT id FROM marks ORDER BY publication_date DESC NULLS LAST, id LIMIT 40 OFFSET 20")
def _(s, d):
    return search.page(marks(s, d).select("id", "publication_date"), search.by_publication(), 40, 20).select("id")


@query("o02_nulls_first", "SELECT id FROM marks ORDER BY publication_date DESC NULLS FIRST, id LIMIT 40")
def _(s, d):
    return search.page(marks(s, d).select("id", "publication_date"), search.by_publication(True), 40).select("id")


@query("o03_by_classes", "SELECT id FROM marks ORDER BY len(nice_classes) DESC NULLS LAST, id LIMIT 40")
def _(s, d):
    return search.page(marks(s, d).select("id", "nice_classes"), search.sort_keys("classes"), 40).select("id")


@query("o06_capped_recall", "SELECT id FROM marks WHERE year = 1996 ORDER BY publication_date DESC NULLS LAST, id LIMIT 1000")
def _(s, d):
    return search.capped(marks(s, d).where("year = 1996").select("id", "publication_date"), search.by_publication(), 1000).select("id")


@query("o07_totals", "SELECT count(*) AS total FROM reps WHERE record_type = 'A' AND year = 1996")
def _(s, d):
    return search.result_total(search.search_filters(marks(s, d), FilterSpec(record_type="A", year=1996)))


@query(
    "o09_findings",
    """, l AS (SELECT dkey, id, publication_date, 0 AS o, 'bolts' AS watchlist FROM keyed WHERE lower(mark_sample) LIKE '%bolt%' OR lower(mark_name) LIKE '%bolt%' UNION ALL SELECT dkey, id, publication_date, 1, 'class 5' FROM keyed WHERE list_contains(nice_classes, '05')),
    f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY dkey ORDER BY o, publication_date DESC NULLS FIRST, id) = 1)
    SELECT id, watchlist, round(0.78 + (('0x' || substr(md5(id), 1, 4))::INT / 65535 - 0.5) * 0.1, 3) AS score FROM f ORDER BY score DESC, id LIMIT 8""",
)
def _(s, d):
    return search.findings(marks(s, d), {"bolts": FilterSpec(q="bolt"), "class 5": FilterSpec(nice_class=("05",))}).select("id", "watchlist", "score")


@query("o10_opposition", f"SELECT id, (publication_date + 150 - DATE '{roles.TODAY}')::INT AS days_left FROM marks WHERE record_type = 'A' AND publication_date + 150 >= DATE '{roles.TODAY}' ORDER BY 2, 1 LIMIT 20")
def _(s, d):
    return search.opposition_list(marks(s, d), lit(TODAY)).select("id", "days_left")


# Quality
_CHECKS = {
    "Q03": "applicant_country_code = 'NA' AND coalesce(applicant_city, '') = ''",
    "Q04": "coalesce(mark_sample, '') = '' AND logo_path IS NULL",
    "Q05": "record_type = 'B_domestic' AND registration_date IS NULL",
    "Q06": "FALSE",
    "Q07": "FALSE",
    "Q10": "publication_date IS NOT NULL AND (year <> year(publication_date) OR month <> month(publication_date))",
}


@query("q01_q11_audit", " UNION ALL ".join(f"SELECT '{k}' AS check, count(*) FILTER ({t if k != 'Q03' else 'FALSE'}) AS suspects, {quality.BASELINES[k] if quality.BASELINES[k] is not None else 'NULL'}::BIGINT AS baseline FROM marks" for k, t in _CHECKS.items()))
def _(s, d):
    known = {k: quality.BASELINES[k] for k in _CHECKS}
    return quality.audit(marks(s, d), known).select("check", "suspects", "baseline")


@query("q08_no_representative", "SELECT dkey AS key FROM ranked GROUP BY dkey HAVING NOT bool_or(is_representative AND n1 % 2 = 0)")
def _(s, d):
    flagged = linkage.with_representative(marks(s, d)).withColumn("is_representative", col("is_representative") & (col("n1") % 2 == 0))
    return quality.groups_without_representative(flagged)


@query("q14_census", "SELECT 'C1' AS check, count(*) AS passed, 0::BIGINT AS failed, 1.0::DOUBLE AS rate FROM (SELECT DISTINCT p_name FROM part) UNION ALL SELECT 'C4', count(*) FILTER (x < 5), count(*) FILTER (x >= 5), round(count(*) FILTER (x < 5) / count(*), 4) FROM (SELECT ascii(p_name) % 8 AS x FROM (SELECT DISTINCT p_name FROM part))", False)
def _(s, d):
    n = part(s, d).select(col("p_name").alias("probe"), col("p_name").alias("id")).distinct()
    found = n.withColumn("rank", F.ascii("probe") % 8 + 1)
    expected = n.withColumn("check", F.explode(F.array(lit("C1"), lit("C4"))))
    return quality.census(found, expected)


# Incremental
@query("st06_prune_missing", "SELECT p_partkey AS k FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)", False)
def _(s, d):
    cache = part(s, d).select(col("p_partkey").alias("k"))
    return incremental.prune_missing(cache, lineitem(s, d).select(col("l_partkey").alias("k")), "k")


@query("st05_note_missing", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END AS check_count FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0", False)
def _(s, d):
    p = part(s, d).select(col("p_partkey").alias("k"))
    then, now = F.to_timestamp(lit("2024-01-01")), F.to_timestamp(lit("2024-02-01"))
    missing = p.where("k % 2 = 0").select("k", then.alias("first_seen_at"), then.alias("last_checked_at"), lit(4).alias("check_count"))
    return incremental.note_missing(missing, p.where("k % 3 = 0"), "k", now).select("k", "check_count")


@query("st10_sample_until", """SELECT batch, n::BIGINT AS n, passed::BIGINT AS passed FROM (SELECT batch, sum(n) OVER (ORDER BY batch) AS n, sum(k) OVER (ORDER BY batch) AS passed FROM (SELECT doc_id // 50 AS batch, count(*) AS n, sum(quality) AS k FROM labels GROUP BY 1)) x
    WHERE n >= 1500 OR (n >= 200 AND 1.96 * sqrt((passed / n) * (1 - passed / n) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) <= 0.05) ORDER BY batch LIMIT 1""", False)
def _(s, d):
    b = labels(s, d).groupBy(F.floor(col("doc_id") / 50).alias("batch")).agg(F.count("*").alias("n"), F.sum("quality").alias("passed"))
    return incremental.sample_until(b, 0.05)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2", False)
def _(s, d):
    return incremental.tumbling_counts(events(s, d))


# Text pipelines on texts built from known values: the SQL gives the values back
@query("s12_batches", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 200)::BIGINT AS batch FROM orders", False)
def _(s, d):
    return sinks.batches(orders(s, d).select("o_orderkey"), ["o_orderkey"], 200)


@query("s18_image_links", "SELECT 'i' || p_partkey || '.png' AS name, 'a/i' || p_partkey || '.png' AS relative FROM part", False)
def _(s, d):
    return sinks.image_links(part(s, d).select(F.concat(lit("/data/images/a/i"), "p_partkey", lit(".png")).alias("path")), "images")


@query("t02_t03_markers", "SELECT p_partkey, '4-2020-' || p_partkey AS application, p_name AS sample, '01.02.20' || (10 + p_size % 10) AS filed, '' AS published FROM part", False)
def _(s, d):
    text = F.concat(lit("(210) 4-2020-"), "p_partkey", lit(" (540) "), "p_name", lit(" (220) 01.02.20"), 10 + col("p_size") % 10, lit(" (441) soon"))
    lines_ = part(s, d).select("p_partkey", F.explode(F.split(T.break_markers(text), "\n")).alias("line"))
    pick = lambda code: F.max(T.marker_value(F.trim("line"), code))
    return lines_.groupBy("p_partkey").agg(pick("210").alias("application"), pick("540").alias("sample"), pick("220").alias("filed"), pick("441").alias("published"))


def _section_lines(s, d):
    """Four lines of a B gazette for each part: certificate, classes over two lines, name."""
    p = part(s, d).select((col("p_partkey") % 20).cast("string").alias("doc"), "p_partkey", F.posexplode(F.array(F.concat(lit("(111) 4-"), "p_partkey"), F.concat(lit("(511) Nhóm "), col("p_size") % 45 + 1), lit("goes on"), F.concat(lit("(540) "), "p_name"))).alias("i", "line"))
    return p.select("doc", lit("B").alias("kind"), (col("p_partkey") * 4 + col("i")).alias("line_no"), "line")


@query(
    "t04_w02_sections",
    """SELECT (p_partkey % 20)::VARCHAR AS doc, (row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey))::BIGINT AS section, u.c AS code, u.v AS value
       FROM (SELECT *, unnest([{'c': '111', 'v': '4-' || p_partkey}, {'c': '511', 'v': 'Nhóm ' || (p_size % 45 + 1) || ' goes on'}, {'c': '540', 'v': p_name}]) AS u FROM part) QUALIFY TRUE""",
    False,
)
def _(s, d):
    return layout.sections(_section_lines(s, d))


ORACLE_SQL["t04_w02_sections"] = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey % 20 ORDER BY p_partkey) AS section FROM part)
    SELECT (p_partkey % 20)::VARCHAR AS doc, section::BIGINT AS section, u.c AS code, u.v AS value FROM (SELECT p_partkey, section, unnest([{'c': '111', 'v': '4-' || p_partkey}, {'c': '511', 'v': 'Nhóm ' || (p_size % 45 + 1) || ' goes on'}, {'c': '540', 'v': p_name}]) AS u FROM r)"""


@query("t07_repair_goods", "SELECT p_partkey, 'dịch vụ ' || p_name || '; phẩm; thuốc dược công nghiệp' AS goods FROM part", False)
def _(s, d):
    return part(s, d).select("p_partkey", T.repair_goods(F.concat(lit("dịc h vụ "), "p_name", lit("; phẩ m; thuốc d ược công nghiệp"))).alias("goods"))


@query("t08_nice_groups", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_size::VARCHAR, '05'] WHEN p_size <= 45 THEN [p_size::VARCHAR, '7'] ELSE ['7'] END AS groups FROM part", False)
def _(s, d):
    even = F.concat(lit("Nhóm "), "p_size", lit(": a; Nhóm 05: b"))
    return part(s, d).select("p_partkey", T.nice_groups(F.when(col("p_size") % 2 == 0, even).otherwise(F.concat_ws(", ", "p_size", lit("7")))).alias("groups"))


@query("t11_split_applicant", "SELECT c_custkey, c_name || ' (GZ) CO' AS name, 'CN' AS country, '1 Road' AS address FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, NULL, '2 Road' FROM customer WHERE c_custkey % 2 = 1", False)
def _(s, d):
    text = F.when(col("c_custkey") % 2 == 0, F.concat(lit("1. "), "c_name", lit(" (GZ) CO (CN) 1 Road 2. OTHER (VN) x"))).otherwise(F.concat("c_name", lit(", 2 Road")))
    return customer(s, d).select("c_custkey", T.split_applicant(text, F.array(lit("CN"), lit("VN"))).alias("x")).select("c_custkey", "x.*")


@query("t13_city", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Da Nang' WHEN 1 THEN 'Bắc Ninh' END AS city FROM customer", False)
def _(s, d):
    k = col("c_custkey") % 3
    text = F.when(k == 0, lit("12 Hue road, Hanoi, Da Nang")).when(k == 1, lit("xã A, tỉnh Bắc Ninh.")).otherwise("nowhere")
    return customer(s, d).select("c_custkey", T.city_in(text, ["Hanoi", "Da Nang", "Hue"], lit("VN")).alias("city"))


@query("t16_first_dates", "SELECT user_id::VARCHAR AS doc, event_id AS section, month(f)::INT AS month, year(f)::INT AS year FROM (SELECT user_id, event_id, first_value(CASE WHEN event_type = 'purchase' THEN ts::DATE END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM events)", False)
def _(s, d):
    rows = events(s, d).select(col("user_id").cast("string").alias("doc"), col("event_id").alias("section"), F.when(col("event_type") == "purchase", F.to_date("ts")).alias("date"))
    return layout.first_dates(rows).select("doc", "section", "month", "year")


@query("t32_domestic_status", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Granted' ELSE 'cấp bằng ' || o_orderstatus END AS label, o_orderstatus <> 'X' AS is_granted FROM orders", False)
def _(s, d):
    text = F.concat(lit("cấp bằng "), "o_orderstatus")
    return orders(s, d).select("o_orderkey", T.domestic_status(col("o_orderstatus"), text, lit(None).cast("date"), {"F": "Granted"}, "Cấp bằng").alias("x")).select("o_orderkey", "x.*")


@query("t43_goods_by_class", "SELECT p_partkey, p_name AS five, 'bán hàng' AS other FROM part", False)
def _(s, d):
    text = F.concat(lit("Nhóm 5: "), "p_name", lit("; Nhóm 35: bán hàng; Nhóm 7: "))
    return part(s, d).select("p_partkey", T.goods_by_class(text).alias("m")).select("p_partkey", F.element_at("m", "05").alias("five"), F.element_at("m", "35").alias("other"))


@query("t44_split_codes", "SELECT p_partkey, [p_size::VARCHAR, '1.2', '3'] AS codes FROM part", False)
def _(s, d):
    return part(s, d).select("p_partkey", T.split_codes(F.concat("p_size", lit(", 1.2;;3 "))).alias("codes"))


@query("t46_country_events", "SELECT user_id, count(*) FILTER (event_type IN ('signup', 'error', 'purchase')) AS n FROM events GROUP BY 1", False)
def _(s, d):
    return _histories(s, d).select("user_id", F.size(html.country_events(col("history"), "VN", "Viet Nam")).cast("long").alias("n"))


@query("h02_value_after", "SELECT p_partkey, p_name || ' ' || p_brand AS value FROM part", False)
def _(s, d):
    ls = F.array(lit("732"), lit("Holder"), col("p_name"), col("p_brand"), lit("811"), lit("x"))
    return part(s, d).select("p_partkey", html.value_after(ls, "732").alias("value"))


@query(
    "h03_h04_madrid_page",
    """SELECT p_partkey, p_name || ' & Co' AS mark, p_name AS holder, '1 rue ' || p_size || CASE WHEN p_size % 2 = 0 THEN ' (FR)' ELSE '' END AS address, CASE WHEN p_size % 2 = 0 THEN 'FR' ELSE 'DE' END AS country,
       'Company' AS legal, p_brand || ' Agents' AS agent, 'DE, ' || p_size AS basic, 'English' AS language, CASE WHEN p_size % 3 = 0 THEN ['09', '42'] ELSE ['21'] END AS classes, 'cups' AS goods,
       ['DE', 'IT', 'VN', 'US', 'EG', 'IN', 'CU'] AS designated, 4::BIGINT AS n_events, 'Grant of protection, VN' AS type, '2021-06-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS date,
       '1989/7' AS old_gazette, ['CU'] AS party, ['EG', 'IN'] AS later, 'Change of address' AS global_type FROM part""",
    False,
)
def _(s, d):
    p = lambda *x: F.concat(*[F.concat(lit("<p>"), c if isinstance(c, F.Column) else lit(c), lit("</p>")) for c in x])
    even = col("p_size") % 2 == 0
    page_ = F.concat(
        lit("<script>832 XX</script>"), p(F.concat(lit("1266721 - "), "p_name", lit(" &amp; Co")), "Transaction History", "732", "Holder", F.concat("p_name", lit(",")), F.concat(lit("1 rue "), "p_size"), F.when(even, "(FR)").otherwise("")),
        p("811", "Nationality", F.when(even, "XX").otherwise("de"), "842", "Legal", "Company", "740", "Agent", F.concat("p_brand", lit(" Agents")), "822", "Basic", F.concat(lit("DE, "), "p_size"), "511", "Class", "NCL(10-2015) 21 cups of 33"),
        F.when(col("p_size") % 3 == 0, '<td class="x nice">9, 42, 9, 77</td>').otherwise(""), lit('<dl class="BASICGS"><p class="gsterm GSTERMFR" nice="21" lang="FR">tasses</p><p class="gsterm GSTERMEN" nice="21" lang="EN"><b>cups</b></p></dl>'),
        p("832", "Under", "DE,", "IT", "999", "x", "Transaction History", "Grant of protection, VN", ":", F.concat(F.lpad((col("p_partkey") % 28 + 1).cast("string"), 2, "0"), lit(".06.2021, 2021/24 Gaz")), "270", "Language", "English"),
        p("International Registration, US, VN", "01.02.1989, 1989/7 LMi", "832", "Designated", "EG", "- IN"), p("Renewal, all", "02.02.1999, 1999/7 Gaz", "833", "Interested", "CU"), p("Change of address", ":", "05.06.2001"),
    )
    r = html.madrid_records(layout.spread(part(s, d)).select("p_partkey", page_.alias("page")), "page", "r").select("p_partkey", "r.*")
    e = lambda i: F.get("transaction_history", lit(i))
    return r.select(
        "p_partkey", col("mark_text").alias("mark"), col("holder_name").alias("holder"), col("holder_address").alias("address"), col("holder_country").alias("country"), col("holder_legal_status").alias("legal"),
        col("representative").alias("agent"), col("basic_registration").alias("basic"), "language", col("nice_classes").alias("classes"), col("goods_services")["21"].alias("goods"), col("designated_countries").alias("designated"),
        F.size("transaction_history").cast("long").alias("n_events"), e(0)["type"].alias("type"), e(0)["date"].alias("date"), e(1)["gazette"].alias("old_gazette"), e(2)["parties"].alias("party"), e(1)["designations"].alias("later"), e(3)["type"].alias("global_type"),
    )


@query("h07_h08_domestic_page", "SELECT p_partkey, '4-2026-' || lpad(p_partkey::VARCHAR, 5, '0') AS number, p_name AS mark, p_brand AS owner, ['09', '42'] AS classes, DATE '2026-01-08' AS filed, 'Filed' AS event FROM part", False, days="filed")
def _(s, d):
    box = lambda label, body: F.concat(lit(f'<div class="product-form-label">{label}</div><div class="product-form-details">'), *body, lit("</div>"))
    page_ = F.concat(
        lit("VN -4-2026-"), F.lpad(col("p_partkey").cast("string"), 5, "0"), box("(541)", [lit("<b>(VI)</b> "), col("p_name"), lit(" <br/>")]), box("(730)", [lit("(VI) "), col("p_brand"), lit(" : Road")]),
        box("(511)", [lit('<a rel="9" class="external-link"><div class="col-md-10">Apps</div></a><a rel="42" class="external-link">x</a>')]), box("(200)", [lit("08.01.2026")]), lit("<div id='events-section'><tr><td>Filed</td><td>1</td></tr></body>"),
    )
    x = layout.spread(part(s, d)).select("p_partkey", page_.alias("page")).select("p_partkey", html.domestic_record(col("page")).alias("r"))
    return x.select("p_partkey", col("r.application_number").alias("number"), col("r.mark_text").alias("mark"), col("r.applicant_name").alias("owner"), col("r.nice_classes").alias("classes"), col("r.filing_date").alias("filed"), col("r.timeline")[0]["event"].alias("event"))


@query("h09_unrendered", "SELECT p_partkey, p_size % 2 = 0 AS bad FROM part", False)
def _(s, d):
    page_ = F.concat(lit("<script>'${x}'</script><p>"), F.when(col("p_size") % 2 == 0, "${mk}").otherwise("mk"), lit("</p>"))
    return part(s, d).select("p_partkey", html.unrendered(page_).alias("bad"))


@query("q01_q02_q09_planted", "SELECT c_custkey, c_custkey % 4 = 0 AS q01, c_custkey % 4 = 1 AS q02, c_custkey % 4 = 2 AS q09 FROM customer", False)
def _(s, d):
    k = col("c_custkey") % 4
    rows = customer(s, d).select("c_custkey", F.when(k == 0, "1529250 (DE)").when(k == 1, "Số 12 Road").otherwise(col("c_name")).alias("applicant_name"), F.when(k == 2, "A (732) x").otherwise("A").alias("mark_sample"))
    checks = quality.row_checks()
    return rows.select("c_custkey", *[checks[q].alias(q.lower()) for q in ("Q01", "Q02", "Q09")])


@query("q13_logo_misses", "SELECT id FROM marks WHERE logo_path IS NULL AND lineage_key LIKE '00%'")
def _(s, d):
    m = marks(s, d)
    return quality.logo_misses(m, m.where("lineage_key LIKE '00%'").select(col("lineage_key").alias("label"))).select("id")


@query("x05_x06_tokens", "SELECT p_partkey, 1.0::DOUBLE AS s FROM part", False)
def _(s, d):
    return part(s, d).select("p_partkey", F.round(phonetics.token_similarity("p_name", F.regexp_replace("p_name", " ", "-")), 6).alias("s"))


@query("x18_placeholder", "SELECT p_partkey, round(0.78 + (('0x' || substr(md5(p_partkey::VARCHAR), 1, 4))::INT / 65535 - 0.5) * 0.1, 3) AS s FROM part", False)
def _(s, d):
    return part(s, d).select("p_partkey", scoring.placeholder_score(col("p_partkey").cast("string")).alias("s"))


@query("x20_relevant", "SELECT p_partkey, contains(p_name, 'cold') AS hit FROM part", False)
def _(s, d):
    return part(s, d).select("p_partkey", phonetics.relevant_match("p_name", F.when(F.contains("p_name", lit("cold")), "COLD").otherwise("zzzzzzzzzzzzzzzz")).alias("hit"))


@query("st02_chunk", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY 1 LIMIT 25", False)
def _(s, d):
    work = orders(s, d).join(lineitem(s, d).select(col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")
    return incremental.chunk(work, "o_orderkey", 25)


@query("st04_rate_level", "SELECT event_id, CASE WHEN value % 1 < 0.15 THEN 1 WHEN value % 1 >= 0.5 THEN 4 ELSE 3 END AS level FROM events", False)
def _(s, d):
    return events(s, d).select("event_id", incremental.rate_level(col("value") % 1, lit(3)).alias("level"))


@query("st09_transitions", "SELECT * FROM (VALUES ('idle', 'start', 'running'), ('running', 'pause', 'paused'), ('paused', 'resume', 'running'), ('running', 'stop', 'stopping'), ('paused', 'stop', 'idle'), ('stopping', 'done', 'idle'), ('running', 'done', 'idle')) t(status, action, next)", False)
def _(s, d):
    return incremental.transitions(s)


# Layout, ingest and pages over shapes built from the tables
@query("t21_entity_norm", "SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS norm FROM customer", False)
def _(s, d):
    return customer(s, d).select("c_custkey", phonetics.entity_norm(F.concat(lit("  "), "c_name", lit(" \t "), "c_mktsegment", lit(" "))).alias("norm"))


@query(
    "t28_registration_date",
    """SELECT m.id, coalesce(m.registration_date, CASE m.record_type WHEN 'B_domestic' THEN d.grant_date WHEN 'B_madrid' THEN x.registration_date END) AS registration_date
       FROM marks m LEFT JOIN domestic d ON m.application_number = d.application_number LEFT JOIN madrid x ON m.lineage_key = x.irn""",
    days="registration_date",
)
def _(s, d):
    return derive.derive(marks(s, d), domestic(s, d), madrid(s, d)).select("id", "registration_date")


def _block(size):
    return F.floor(col("p_partkey") / size).alias("block" if size == 10 else "doc")


@query(
    "t41_marker_places",
    """SELECT block, line_no, 'mark ' || nxt AS match FROM (SELECT p_partkey // 10 AS block, p_partkey % 10 AS line_no, p_partkey % 2 = 1 AS odd,
         CASE WHEN lead(p_partkey) OVER w % 2 = 0 THEN lead(p_size) OVER w END AS nxt FROM part WINDOW w AS (PARTITION BY p_partkey // 10 ORDER BY p_partkey)) WHERE odd AND nxt IS NOT NULL""",
    False,
)
def _(s, d):
    k = col("p_partkey") % 10
    line = F.when(k % 2 == 1, F.concat("p_name", lit(" mark"))).otherwise(F.concat(col("p_size").cast("string"), lit(" y")))
    rows = part(s, d).select(_block(10), k.alias("line_no"), line.alias("line"), (k * 12).alias("y"))
    return layout.marker_places(rows, r"mark\s+\d+").select("block", "line_no", "match")


_SLICED = """WITH l AS (SELECT p_partkey // 10 AS doc, p_partkey % 10 AS k, p_name AS label, (p_partkey % 10) * 100.0 + p_size AS y, p_size FROM part),
    h AS (SELECT doc, k, 'i' || k AS image, k * 100.0 AS start, CASE WHEN p_size <= 20 THEN label ELSE coalesce(lag(label) OVER (PARTITION BY doc ORDER BY k), 'unknown') END AS owner, y, label FROM l)"""


@query(
    "t42_image_slices",
    f"""{_SLICED} SELECT doc, image, owner, start::DOUBLE AS start, y::DOUBLE AS "end" FROM h WHERE y > start
        UNION ALL SELECT doc, image, label, y::DOUBLE, (start + 90)::DOUBLE FROM h""",
    False,
)
def _(s, d):
    k = (col("p_partkey") % 10).cast("double")
    at = part(s, d).select(F.floor(col("p_partkey") / 10).alias("doc"), lit(1).alias("page"), F.concat(lit("i"), (col("p_partkey") % 10).cast("string")).alias("image"), (k * 100).alias("top"), (k * 100 + 90).alias("bottom"), "p_name", (k * 100 + col("p_size")).alias("y"))
    return layout.image_slices(at.select("doc", "page", "image", "top", "bottom"), at.select("doc", "page", "y", col("p_name").alias("label"))).select("doc", "image", "owner", "start", "end")


@query(
    "j15_merge_rectangles",
    """SELECT doc, min(x0)::DOUBLE AS x0, max(x0 + 2 * p_size)::DOUBLE AS x1 FROM (SELECT *, sum(CASE WHEN x0 - before > 20 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY x0) AS run
       FROM (SELECT p_partkey // 10 AS doc, (p_partkey % 10) * 100 AS x0, p_size, lag((p_partkey % 10) * 100 + 2 * p_size) OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS before FROM part)) GROUP BY doc, run""",
    False,
)
def _(s, d):
    x0 = (col("p_partkey") % 10 * 100).cast("double")
    boxes = part(s, d).select(F.floor(col("p_partkey") / 10).alias("doc"), lit(1).alias("page"), x0.alias("x0"), lit(0.0).alias("y0"), (x0 + 2 * col("p_size")).alias("x1"), lit(10.0).alias("y1"))
    return layout.merge_rectangles(boxes).select("doc", "x0", "x1")


@query(
    "s03_word_lines",
    """WITH w AS (SELECT p_partkey // 20 AS doc, p_partkey % 20 AS k, p_name FROM part),
    b AS (SELECT doc, p_name, CASE WHEN doc % 2 = 0 THEN 10 ELSE k // 10 * 400 + k % 2 * 50 END AS x0, CASE WHEN doc % 2 = 0 THEN 590 ELSE k // 10 * 400 + k % 2 * 50 + 40 END AS x1,
            CASE WHEN doc % 2 = 0 THEN k * 30 ELSE k % 10 // 2 * 30 + k % 2 END AS top FROM w),
    p AS (SELECT doc, max(x1) / 2 AS mid FROM b GROUP BY 1),
    t AS (SELECT doc, mid, count(*) FILTER (x0 < mid AND x1 > mid) <= greatest(10, count(*) * 0.1) AS two FROM b JOIN p USING (doc) GROUP BY 1, 2),
    l AS (SELECT doc, CASE WHEN two AND x0 >= mid THEN 1 ELSE 0 END AS c, top // 3 AS y, string_agg(p_name, ' ' ORDER BY x0, p_name) AS line FROM b JOIN t USING (doc) GROUP BY 1, 2, 3)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY c, y)::INT AS line_no, line FROM l""",
    False,
)
def _(s, d):
    k, even = col("p_partkey") % 20, F.floor(col("p_partkey") / 20) % 2 == 0
    x0 = F.when(even, 10).otherwise(F.floor(k / 10) * 400 + k % 2 * 50)
    x1 = F.when(even, 590).otherwise(F.floor(k / 10) * 400 + k % 2 * 50 + 40)
    top = F.when(even, k * 30).otherwise(F.floor(k % 10 / 2) * 30 + k % 2)
    words = part(s, d).select(F.floor(col("p_partkey") / 20).alias("doc"), lit(1).alias("page"), col("p_name").alias("text"), x0.alias("x0"), x1.alias("x1"), top.alias("top"))
    return layout.word_lines(words).select("doc", "line_no", "line")


@query(
    "s03_entry_lines",
    """WITH b AS (SELECT p_partkey // 60 AS doc, p_partkey % 60 AS k, (p_partkey % 60) // 20 AS e, p_partkey % 20 AS j, p_name, count(*) OVER (PARTITION BY p_partkey // 60) AS n FROM part),
    p AS (SELECT *, doc % 3 = 2 AS wide, doc % 3 = 2 OR n < 30 AS plain, CASE WHEN j < 9 THEN j ELSE j - 9 END AS h FROM b),
    w AS (SELECT doc, CASE WHEN plain THEN 0 ELSE e END AS entry, CASE WHEN plain OR j < 9 THEN 0 WHEN j < 15 THEN 1 ELSE 2 END AS part,
            CASE WHEN wide THEN k * 10 WHEN j < 15 THEN 100 + e * 200 + h // 2 * 15 ELSE 200 + e * 200 END AS band,
            CASE WHEN wide OR j >= 15 THEN 0 ELSE h % 2 END AS low, CASE WHEN j = 15 THEN 40 WHEN j > 15 THEN 60 + 150 * (j - 16) WHEN j < 9 THEN 40 + h % 2 * 60 ELSE 400 + h % 2 * 60 END AS x0,
            CASE WHEN wide THEN p_name WHEN j = 0 THEN '(111)' WHEN j = 15 THEN '(511)' ELSE p_name END AS t FROM p)
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY entry, part, band)::INT AS line_no, string_agg(t, ' ' ORDER BY round((band + low) / 3), x0) AS line FROM w GROUP BY doc, entry, part, band""",
    False,
)
def _(s, d):
    # Pages of three entries in two columns, every third page over the full width.
    doc, k = F.floor(col("p_partkey") / 60), col("p_partkey") % 60
    j, top, wide = k % 20, 100 + F.floor(k / 20) * 200, doc % 3 == 2
    h = F.when(j < 9, j).otherwise(j - 9)
    x0 = F.when(wide, 10).when(j == 15, 40).when(j > 15, 60 + 150 * (j - 16)).otherwise(F.when(j < 9, 40).otherwise(400) + h % 2 * 60)
    x1 = F.when(wide, 590).when(j > 15, x0 + 130).otherwise(x0 + 50)
    y = F.when(wide, k * 10).when(j >= 15, top + 100).otherwise(top + F.floor(h / 2) * 15 + h % 2)
    text = F.when(wide, col("p_name")).when(j == 0, "(111)").when(j == 15, "(511)").otherwise(col("p_name"))
    words = part(s, d).select(doc.alias("doc"), lit(1).alias("page"), text.alias("text"), x0.alias("x0"), x1.alias("x1"), y.alias("top"))
    return layout.entry_lines(words).select("doc", "line_no", "line")


@query(
    "s04_marker_lines",
    """SELECT doc, (2 * r - 1)::INT AS line_no, '(210) 4-' || p_partkey AS line FROM (SELECT p_partkey // 3 AS doc, p_partkey, p_name, row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey) AS r FROM part)
       UNION ALL SELECT doc, (2 * r)::INT, '(540) ' || p_name FROM (SELECT p_partkey // 3 AS doc, p_partkey, p_name, row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey) AS r FROM part)""",
    False,
)
def _(s, d):
    text = F.concat(lit("(210) 4-"), "p_partkey", lit("  (540) "), "p_name")
    return layout.marker_lines(part(s, d).select(F.floor(col("p_partkey") / 3).alias("doc"), (col("p_partkey") % 3).alias("page"), text.alias("text")))


@query("o04_by_score", "SELECT id, n1 AS score FROM marks ORDER BY n1 DESC, id LIMIT 50 OFFSET 10")
def _(s, d):
    return search.page(marks(s, d).select("id", col("n1").alias("score")), search.sort_keys("similarity"), 50, 10)


@query(
    "o05_overfetched",
    """SELECT id FROM (SELECT id, publication_date, n1 FROM reps ORDER BY publication_date DESC NULLS LAST, id LIMIT 60) WHERE n1 % 3 <> 0
       ORDER BY publication_date DESC NULLS LAST, id LIMIT 20 OFFSET 10""",
)
def _(s, d):
    return search.overfetched(linkage.representatives(marks(s, d)), search.by_publication(), 20, 10, col("n1") % 3 != 0).select("id")


@query(
    "st01_ingest_plan",
    """SELECT o_orderkey AS gazette_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderstatus <> 'F' THEN 'retry' WHEN o_orderkey % 3 = o_orderkey % 2 THEN 'skip' ELSE 'replace' END AS action FROM orders""",
    False,
)
def _(s, d):
    content = lambda n: F.md5((col("o_orderkey") % n).cast("string")).alias("sha256")
    status = F.when(col("o_orderstatus") == "F", "completed").when(col("o_orderstatus") == "O", "failed").otherwise("processing")
    files = orders(s, d).select(col("o_orderkey").alias("gazette_id"), content(3))
    held = orders(s, d).where("o_orderkey % 4 <> 0").select(col("o_orderkey").alias("gazette_id"), content(2), status.alias("status"))
    return incremental.ingest_plan(files, held)


@query(
    "st01_purge_partial",
    "SELECT l_orderkey AS gazette_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')",
    False,
)
def _(s, d):
    plan = orders(s, d).select(col("o_orderkey").alias("gazette_id"), F.when(col("o_orderstatus") != "F", "retry").otherwise("skip").alias("action"))
    return incremental.purge_partial(lineitem(s, d).select(col("l_orderkey").alias("gazette_id"), "l_linenumber"), plan)
