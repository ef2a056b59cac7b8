"""The registry's tables as roles of the test tables, in SQL that Spark and DuckDB share.

Only arrays differ: they are columns of numbers or codes here, and become arrays in
marks(), or in the list expressions of MARKS_DUCK.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.functions.text import lineage_key, mark_category, nice_classes
from markweave.operators.facet_index import FacetIndex, held
from markweave.operators.linkage import with_representative
from markweave.plans import search
from markweave.plans.name_postings import NameIndex
from markweave.sources.keyed_table import KeyedTable
from markweave.storage import BROADCAST_BYTES, scratch, sized

TODAY = "1997-06-15"

_KEY = "CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)"
_MARK = f"""
  SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),
                   CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), CAST(CAST(round(l_discount * 100) AS BIGINT) AS STRING)) AS id,
    concat('g', CAST(year(o_orderdate) AS STRING)) AS gazette_id,
    CASE l_returnflag WHEN 'N' THEN 'A' WHEN 'R' THEN 'B_domestic' ELSE 'B_madrid' END AS record_type,
    CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE '' END ELSE concat('4-', {_KEY}) END AS application_number,
    CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND l_linenumber % 2 = 1) THEN concat('C', {_KEY}) END AS certificate_number,
    CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN lpad(CAST(l_partkey AS STRING), 7, '0') END AS madrid_number,
    CASE WHEN l_quantity > 3 THEN CAST(o_orderdate AS DATE) END AS submission_date,
    CASE WHEN l_linenumber <> 6 THEN CAST(l_shipdate AS DATE) END AS publication_date,
    CASE WHEN l_returnflag = 'R' AND l_tax > 0.02 THEN CAST(o_orderdate AS DATE) END AS registration_date,
    CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS vn_grant_date,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL '18' MONTH AS DATE) AS expiry_date,
    CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
    concat_ws(',', CAST(l_partkey % 50 AS STRING), CAST(l_suppkey % 47 AS STRING), CAST(l_partkey % 50 AS STRING)) AS nice_group_number,
    CAST(l_partkey % 50 AS INT) AS n1, CAST(l_suppkey % 47 AS INT) AS n2,
    concat_ws('.', CAST(l_partkey % 29 + 1 AS STRING), CAST(l_suppkey % 9 + 1 AS STRING), CAST(l_linenumber AS STRING)) AS v1,
    concat_ws('.', CAST(l_suppkey % 29 + 1 AS STRING), CAST(l_partkey % 9 + 1 AS STRING)) AS v2,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE p_name END AS mark_sample,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE upper(p_name) END AS mark_name,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE concat('logos/', CAST(l_partkey AS STRING), '.png') END AS logo_path,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE substr(md5(p_name), 1, 16) END AS logo_phash,
    c_name AS applicant_name, upper(substr(n_name, 1, 2)) AS applicant_country_code,
    CASE WHEN l_tax > 0.05 THEN n_name END AS applicant_city,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Personal' ELSE 'Company' END AS applicant_type, s_name AS ip_agency"""
MARKS = f"""{_MARK}
  FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey
    JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey"""
MADRID = """
  SELECT lpad(CAST(p_partkey AS STRING), 7, '0') AS irn, p_brand AS holder_name, p_name AS mark_text,
    CASE p_size % 3 WHEN 0 THEN 'granted' WHEN 1 THEN 'refused' ELSE 'pending' END AS vn_status,
    CASE WHEN p_size % 3 = 0 THEN DATE '1995-03-01' END AS vn_grant_date,
    CASE WHEN p_size % 2 = 0 THEN 'VN' ELSE 'FR' END AS d1, CASE WHEN p_size % 5 = 0 THEN 'US' ELSE 'DE' END AS d2,
    concat(p_type, ', 12 Long Road') AS representative, DATE '1994-01-01' AS registration_date
  FROM {part}"""
DOMESTIC = """
  SELECT concat('4-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS application_number,
    min(concat('Owner ', CAST(l_suppkey AS STRING))) AS applicant_name, min(concat('mark ', CAST(l_partkey AS STRING))) AS mark_text,
    min(concat('Agent ', CAST(l_suppkey AS STRING))) AS representative,
    CASE WHEN l_orderkey % 2 = 0 THEN 'Granted by registry' END AS status_code,
    CASE WHEN l_orderkey % 2 = 0 THEN CAST(min(l_shipdate) AS DATE) END AS grant_date
  FROM {lineitem} WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey, l_linenumber"""
GAZETTES = """
  SELECT DISTINCT concat('g', CAST(year(o_orderdate) AS STRING)) AS id, CAST(year(o_orderdate) AS INT) AS issue_year,
    CAST(month(o_orderdate) * 2 - CASE WHEN day(o_orderdate) <= 15 THEN 1 ELSE 0 END AS INT) AS issue_number
  FROM {orders} WHERE o_orderkey % 7 < 3"""

#: The mark tables of the SQL side, as common table expressions.
MARKS_DUCK = f"""
  raw AS ({MARKS.format(**{t: t for t in ('lineitem', 'orders', 'customer', 'nation', 'part', 'supplier')})}),
  marks AS (SELECT *, coalesce(nullif(application_number, ''), nullif(certificate_number, ''), nullif(madrid_number, '')) AS lineage_key,
    CASE WHEN nullif(application_number, '') IS NOT NULL AND nullif(certificate_number, '') IS NULL AND nullif(madrid_number, '') IS NULL THEN 'domestic_application'
      WHEN nullif(application_number, '') IS NOT NULL AND nullif(certificate_number, '') IS NOT NULL THEN 'domestic_registration'
      WHEN nullif(certificate_number, '') IS NOT NULL AND nullif(madrid_number, '') IS NULL THEN 'madrid_registration'
      WHEN nullif(madrid_number, '') IS NOT NULL AND nullif(certificate_number, '') IS NULL THEN 'madrid_renewal' ELSE 'unknown' END AS mark_category,
    CASE WHEN n1 BETWEEN 1 AND 45 AND n2 BETWEEN 1 AND 45 AND n1 <> n2 THEN [lpad(n1::VARCHAR, 2, '0'), lpad(n2::VARCHAR, 2, '0')]
      WHEN n1 BETWEEN 1 AND 45 THEN [lpad(n1::VARCHAR, 2, '0')] WHEN n2 BETWEEN 1 AND 45 THEN [lpad(n2::VARCHAR, 2, '0')] END AS nice_classes,
    [v1, v2] AS vienna_codes FROM raw),
  keyed AS (SELECT *, coalesce(nullif(application_number, ''), nullif(lineage_key, ''), id) AS dkey FROM marks),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY (certificate_number IS NOT NULL) DESC, (vn_grant_date IS NOT NULL) DESC, id DESC) = 1 AS is_representative FROM keyed),
  reps AS (SELECT * FROM ranked WHERE is_representative),
  madrid AS (SELECT *, [d1, d2] AS designated_countries FROM ({MADRID.format(part='part')})),
  domestic AS ({DOMESTIC.format(lineitem='lineitem')}),
  gazettes AS ({GAZETTES.format(orders='orders')})"""


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.conf.get(f"markweave.marks.{sf_dir.rstrip('/')}", None)
    if stored:
        return spark.read.parquet(stored)
    dims = _tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "part", "supplier")
    return _derived(spark.sql(MARKS, **dims))


def _derived(df: DataFrame) -> DataFrame:
    numbers = [F.col(c) for c in ("application_number", "certificate_number", "madrid_number")]
    return df.withColumns({"lineage_key": lineage_key(*numbers), "mark_category": mark_category(*numbers), "nice_classes": nice_classes(F.col("nice_group_number")), "vienna_codes": F.array("v1", "v2")})


def _with_key_in(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key is among those of a table, which are whole numbers and unique. Keys
    that lie close are sent as bitmaps, 4 KB for 32,768 of them, so rows aren't dealt by them."""
    there = keys.select(F.bitmap_bucket_number(name).alias("_b"), F.bitmap_bit_position(name).alias("_at"))
    if there.select("_b").distinct().count() * 4200 > BROADCAST_BYTES:
        return rows.join(keys.select(name), F.col(key) == F.col(name)).drop(name)
    maps = there.groupBy("_b").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    found = rows.withColumn("_b", F.bitmap_bucket_number(key)).join(F.broadcast(maps), "_b")
    return found.where(held(F.col("_bits"), F.bitmap_bit_position(key))).drop("_b", "_bits")


def marks_unnamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """marks() without names and logos, which only a join with part gives: the rows of lineitem
    are dealt once, by their order, and the tables beside it are sent to them if small."""
    if spark.conf.get(f"markweave.marks.{sf_dir.rstrip('/')}", None):
        return marks(spark, sf_dir)
    t = _tables(spark, sf_dir, "lineitem", "orders", "customer", "nation", "part", "supplier")
    who = t["customer"].select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").join(F.broadcast(t["nation"].select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = t["orders"].select("o_orderkey", "o_custkey", "o_orderdate").join(sized(who, 150), F.col("o_custkey") == F.col("c_custkey"))
    rows = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = _with_key_in(rows, "l_partkey", t["part"], "p_partkey")
    rows = rows.join(sized(t["supplier"].select("s_suppkey", "s_name"), 100), F.col("l_suppkey") == F.col("s_suppkey"))
    return _derived(spark.sql(f"{_MARK} FROM {{rows}}", rows=rows.withColumn("p_name", F.lit(None).cast("string"))).drop("mark_sample", "mark_name", "logo_phash"))


def store(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write marks with is_representative: what an ingest leaves behind, so that queries over
    the same sf_dir needn't join and number the rows again."""
    with_representative(marks(spark, sf_dir)).write.mode("overwrite").parquet(path)
    spark.conf.set(f"markweave.marks.{sf_dir.rstrip('/')}", path)


def name_index(spark: SparkSession, sf_dir: str, path: str | None = None) -> NameIndex:
    """The names of marks, indexed as an ingest would leave them: once for a session, in path or
    in the shared folder."""
    key = f"markweave.names.{sf_dir.rstrip('/')}"
    found = spark.conf.get(key, None)
    if found:
        return NameIndex(spark, found)
    index = NameIndex.build(search.names_of(marks(spark, sf_dir)), path or scratch(spark, "names"))
    spark.conf.set(key, index.root)
    return index


def facet_index(spark: SparkSession, sf_dir: str, path: str | None = None) -> FacetIndex:
    """The bitmaps and lists of marks, as an ingest would leave them: once for a session."""
    key = f"markweave.facets.{sf_dir.rstrip('/')}"
    found = spark.conf.get(key, None)
    if found:
        return FacetIndex(spark, found)
    index = FacetIndex.build(marks_unnamed(spark, sf_dir), path or scratch(spark, "facets"), madrid(spark, sf_dir))
    spark.conf.set(key, index.gens.root)
    return index


def clustered(spark: SparkSession, sf_dir: str, rows: DataFrame, key: list[str]) -> KeyedTable:
    """rows of marks in the order of a key, as an ingest would leave them: once for a session."""
    name = f"markweave.by-{'-'.join(key)}.{sf_dir.rstrip('/')}"
    found = spark.conf.get(name, None)
    table = KeyedTable(spark, found) if found else KeyedTable.create(rows, scratch(spark, "clustered"), key, 20_000)
    spark.conf.set(name, table.root)
    return table


def first_mark(spark: SparkSession, sf_dir: str) -> str:
    """The id of the first mark that has a name."""
    r = _tables(spark, sf_dir, "lineitem")["lineitem"].where("l_linenumber <> 5").orderBy("l_orderkey", "l_linenumber").first()
    return "-".join(map(str, (r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey, round(r.l_extendedprice * 100), round(r.l_discount * 100))))


def madrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MADRID, **_tables(spark, sf_dir, "part")).withColumn("designated_countries", F.array("d1", "d2"))


def domestic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOMESTIC, **_tables(spark, sf_dir, "lineitem"))


def gazettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GAZETTES, **_tables(spark, sf_dir, "orders"))
