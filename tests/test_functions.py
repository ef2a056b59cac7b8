from datetime import date

import pytest
from pyspark.sql import functions as F

from markweave.functions import html, phonetics, scoring
from markweave.functions import text as T

CODES = {
    "THOMAS": ("TMS", ""), "TOMAS": ("TMS", ""), "CAESAR": ("SSR", ""), "SEZAR": ("SSR", ""), "JOAQUIN": ("JKN", "AKN"), "WAKEEN": ("AKN", "FKN"),
    "MACHARIA": ("MKR", ""), "MAKARIA": ("MKR", ""), "SCHNEIDER": ("XNTR", "SNTR"), "SNYDER": ("SNTR", "XNTR"), "SMITH": ("SM0", "XMT"), "SCHMIDT": ("XMT", "SMT"),
    "NIKE": ("NK", ""), "ADIDAS": ("ATTS", ""), "XAVIER": ("SF", "SFR"), "KNIGHT": ("NT", ""), "WRIGHT": ("RT", ""), "PSYCHOLOGY": ("SXLJ", "SKLK"),
    "GIOVANNI": ("JFN", "KFN"), "CIABATTA": ("SPT", "XPT"), "GEMY": ("JM", "KM"), "KAVIN": ("KFN", ""), "SAVING": ("SFNK", ""), "POWER": ("PR", ""),
    "SULFANI": ("SLFN", ""), "VIET": ("FT", ""), "": ("", ""), "   ": ("", ""), "123": ("", ""), None: ("", ""),
}


@pytest.mark.parametrize("word,codes", CODES.items())
def test_double_metaphone(word, codes):
    assert phonetics.double_metaphone(word) == codes


@pytest.mark.parametrize(
    "a,b,score",
    [("Sulfani", "Sulfani", 1.0), ("Gemy", "KAVIN SAVING POWER", 0.019), ("VIET AGAROYAL", "VIET AGAROYAL GLOBAL", 0.556), ("Taseko", "Tabeko", 0.911), ("", "ABC", 0.0), ("CÔNG TY DƯỢC", "CÔNG TY DƯỢC PHẨM", 0.67), ("TRANG", "CHANG", 0.813)],
)
def test_phonetic_score(a, b, score):
    assert phonetics.phonetic_score(a, b) == score


def test_vietnamese_keys():
    k = phonetics.vn_key
    assert k("GIA") == k("DA") == k("RA") and k("TRANG") == k("CHANG") and k("SA") == k("XA") and k("CA") == k("KA") == k("QA")
    assert k("QUANG") != k("CANG") and "w" in k("QUANG") and k("MAI") == k("MAY") and k("MAI").endswith("j")
    assert k("TRANG").endswith("q") and k("AC").endswith("k") and k("ACH").endswith("k") and k("LAKA") == "laka" and k("LACCA") == "lakka"
    assert k("") == k("123") == ""
    seen = {t: phonetics.is_vietnamese(t) for t in ("GIA HƯNG", "CÔNG TY DƯỢC", "GIA HUNG", "TRANG", "BAO LONG", "SAMSUNG", "MAYBELLINE", "APPLE", "", None, "   ")}
    assert [t for t, v in seen.items() if v] == ["GIA HƯNG", "CÔNG TY DƯỢC", "GIA HUNG", "TRANG", "BAO LONG", "SAMSUNG"]


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "p,v,s,c,w,by_hash,score,verdict",
    [(0.60, 0.63, 0.0, 1.0, 0.0, True, 0.49, "Low risk"), (0.14, 0.63, 0.0, 1.0, 0.0, True, 0.35, "Low risk"), (0.90, 0.90, 0.0, 1.0, 1.0, True, 0.813, "Likely conflict"), (0.49, 0.20, 0.0, 1.0, 0.0, False, 0.296, "Low risk"), (0.16, 0.59, 0.0, 1.0, 0.0, True, 0.329, "Low risk"), (0.10, 0.10, 0.85, 1.0, 0.0, False, 0.378, "Low risk")],
)
def test_composite(spark, p, v, s, c, w, by_hash, score, verdict):
    got = one(spark, scoring.composite(*[F.lit(x) for x in (p, v, s, c, w, by_hash)]))
    assert (got.score, got.verdict) == (score, verdict)


def test_overlap_and_weights(spark):
    arrays = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    cases = [(["11"], ["11"], 1.0), (["11"], ["42"], 0.0), (["9", "42"], ["42"], 0.5), (["3"], ["3", "5"], 0.5), ([], ["1"], 0.0)]
    assert [one(spark, scoring.set_overlap(arrays(a), arrays(b))) for a, b, _ in cases] == [x for _, _, x in cases]
    assert scoring.resolve_weights(None) == scoring.DEFAULT_WEIGHTS == scoring.resolve_weights(dict.fromkeys(scoring.DEFAULT_WEIGHTS, 0))
    got = scoring.resolve_weights({"phonetic": 1, "visual": -1, "other": 3, "class": True})
    assert got["phonetic"] == pytest.approx(1 / 1.65) and sum(got.values()) == pytest.approx(1)


def test_semantic(spark):
    vec = lambda *x: F.array(*[F.lit(v).cast("float") for v in x])
    assert one(spark, scoring.semantic_score(vec(1, 0), vec(1, 0))) == 1.0 and one(spark, scoring.semantic_score(vec(1, 0), vec(0, 1))) == 0.0
    assert one(spark, scoring.semantic_score(vec(1, 0), vec(0.85, 0.5268))) == 0.7
    assert one(spark, scoring.semantic_score(vec(1, 0), F.lit(None).cast("array<float>"))) == 0.0 and one(spark, scoring.semantic_score(vec(1, 0), vec(1))) == 0.0
    assert one(spark, scoring.hamming_hex(F.lit("f" * 16), F.lit("0" * 15 + "f"))) == 60


@pytest.mark.parametrize("text,codes", [("35,41,35,09", ["35", "41", "09"]), ("99,03", ["03"]), ("99", None), ("5,12", ["05", "12"]), ("x, 7", ["07"]), (None, None), ("", None)])
def test_nice_classes(spark, text, codes):
    assert one(spark, T.nice_classes(F.lit(text).cast("string"))) == codes


@pytest.mark.parametrize("code,out", [("04.03.03", "4.3.3"), ("02.01", "2.1"), ("", None), ("26", None), ("26.1.1.1", None), ("26.a.1", None), ("26..1", None), ("abc", None)])
def test_normalize_code(spark, code, out):
    from markweave.operators.filters import normalize_request_code

    assert one(spark, T.normalize_code(F.lit(code))) == out == normalize_request_code(code)


def test_registry_text(spark):
    say = lambda c: one(spark, c)
    assert say(T.short_year_date(F.lit("1/2/68"))) == date(2068, 1, 2) and say(T.short_year_date(F.lit("1/2/69"))) == date(1969, 1, 2) and say(T.short_year_date(F.lit("13/45/70"))) is None
    assert say(T.parse_date(F.lit("12/31/2020"))) == date(2020, 12, 31) and say(T.parse_date(F.lit("31.12.2020"))) is None
    assert say(T.dmy_to_mdy(F.lit("5.1.2020"))) == "01/05/2020" and say(T.dmy_to_mdy(F.lit("soon"))) == "soon"
    assert say(T.break_markers(F.lit("(210) 4-2020-1 (540) ABC"))).split("\n")[1:] == ["(210) 4-2020-1", "(540) ABC"]
    assert say(T.marker_value(F.lit("(220) no date here"), "220")) == "" and say(T.marker_value(F.lit("(220) 01.02.2020"), "220")) == "01.02.2020" and say(T.marker_value(F.lit("x"), "220")) is None
    assert say(T.repair_goods(F.lit("dịc h vụ; phẩ m; thuốc d ược công nghiệp"))) == "dịch vụ; phẩm; thuốc dược công nghiệp"
    assert say(T.nice_groups(F.lit("Nhóm 35: a; Nhóm 05: b"))) == ["35", "05"] and say(T.nice_groups(F.lit("5, 99, 12"))) == ["5", "12"]
    codes, names = F.array(F.lit("CN"), F.lit("VN")), F.array(F.lit("China"), F.lit("Viet Nam"))
    x = say(T.split_applicant(F.lit("1. MEI (GZ) CO., LTD. (CN) 1 Road, City 2. OTHER (VN) x"), codes))
    assert (x.name, x.country, x.address) == ("MEI (GZ) CO., LTD.", "CN", "1 Road, City")
    assert say(T.country_code(F.lit("A (ZZ)"), codes, names)) is None and say(T.country_code(F.lit("Firm, china"), codes, names)) == "CN"
    assert say(T.city_in(F.lit("12 Hue road, Hanoi, Da Nang"), ["Hanoi", "Da Nang", "Hue"])) == "Da Nang"
    assert say(T.city_in(F.lit("xã A, tỉnh Bắc Ninh."), ["Hue"], F.lit("VN"))) == "Bắc Ninh"
    kinds = {"NGUYỄN COMPANY LIMITED": "Company", "INDUSTRIJA X": "Company", "Nguyễn Văn A": "Personal", "Zhang Wei": "Personal", "": ""}
    assert {k: say(T.applicant_type(F.lit(k))) for k in kinds} == kinds
    assert say(T.agency(F.lit("Firm Name (FIRM)"))) == "FIRM" and say(T.agency(F.lit("Mme. Ann Law (MI) 12 Road"))) == "Ann Law (MI)"
    assert say(T.strip_note(F.lit("(nhận tại VP2)(GCN) ACME"))) == "ACME" and say(T.strip_note(F.lit("(INC) ACME"))) == "(INC) ACME" and say(T.strip_note(F.lit("(gửi VB)"))) == "(gửi VB)"
    assert say(T.fetch_id(F.lit("4-2024-16348"))) == "VN4202416348" and say(T.fetch_id(F.lit("4-12"))) is None and say(T.fetch_id(F.lit("4-2024-x1234567"))) is None
    assert say(T.months_before(F.lit(date(2020, 1, 31)), 3)) == date(2019, 10, 28)
    assert say(T.goods_by_class(F.lit("Nhóm 5: thuốc; Nhóm 35: bán hàng. Nhóm 7: "))) == {"05": "thuốc", "35": "bán hàng."}
    assert tuple(say(T.file_meta(F.lit("b_T4_2_2023.pdf")))) == ("B", 4, 2023) and tuple(say(T.file_meta(F.lit("x.pdf")))) == (None, None, None)


PAGE = """<div class="product-form-label">(541) Mark</div> <div class="product-form-details"><b>(VI)</b> VTRAVEL <br/><b></b></div>
<div class="product-form-label">(730) Owner</div> <div class="product-form-details">(VI) ACME Co : 1 Road</div>
<div class="product-form-label">(511) Goods</div><div class="product-form-details"><a rel="9" class="external-link"><div class="col-md-10">Apps</div></a><a rel="42" class="external-link">x</a></div>
<div class="product-form-label">(531)</div><div class="product-form-details"><span class="ext-link-text">03.07.07 (7)</span></div>
<div class="product-form-label">(200)</div><div class="product-form-details">VN -4-2026-00774 08.01.2026</div>
<div id="events-section"><table><tr><td>Filed</td><td>08.01.2026</td><td>ok</td></tr></table></body>"""


def test_domestic_page(spark):
    x = one(spark, html.domestic_record(F.lit(PAGE)))
    assert (x.application_number, x.mark_text, x.applicant_name, x.applicant_address) == ("4-2026-00774", "VTRAVEL", "ACME Co", "1 Road")
    assert (x.nice_classes, x.goods_services, x.vienna_codes, x.filing_date) == (["09", "42"], {"09": "Apps"}, ["03.07.07"], date(2026, 1, 8))
    assert [tuple(e) for e in x.timeline] == [("Filed", "08.01.2026", "ok")]
    assert one(spark, html.page_state(F.lit(PAGE))) == "ok" and one(spark, html.page_state(F.lit("<p>${x}</p>"))) == "unrendered" and one(spark, html.page_state(F.lit("<script>'${'</script>"))) == "not_found"


def test_madrid_page(spark):
    page = "<p>151</p><p>Date</p><p>01.02.2020</p><p>732</p><p>Holder</p><p>ACME,</p><p>1 rue (FR)</p><p>832</p><p>Under</p><p>VN, US</p><p>999</p><h1>Transaction History</h1><p>Grant of protection, VN</p><p>:</p><p>05.06.2021, 2021/24 Gaz</p><p>Change of name</p><p>:</p><p>07.06.2021</p>"
    x = html.madrid_records(spark.createDataFrame([(page,)], "page string"), "page").first().record
    assert (x.holder_name, x.holder_country, x.registration_date, x.designated_countries) == ("ACME", "FR", date(2020, 2, 1), ["VN", "US"])
    assert [(e.type, e.date, e.parties) for e in x.transaction_history] == [("Grant of protection, VN", "2021-06-05", ["VN"]), ("Change of name", "2021-06-07", [])]


EVENT = "array<struct<type:string,date:string,gazette:string,parties:array<string>>>"


@pytest.mark.parametrize(
    "history,accepted,active,out",
    [
        ([("Provisional refusal, VN", "2020-01-01")], True, False, ("granted", None, None)),
        ([("Grant of protection, VN", "2020-03-01"), ("Statement of grant", "2020-02-01")], True, False, ("granted", date(2020, 2, 1), None)),
        ([("Statement … the mark is granted under Rule 18ter(2)(ii)", "2020-05-01")], False, False, ("granted", date(2020, 5, 1), None)),
        ([("Subsequent designation, VN", "2019-01-01")], True, False, ("granted", date(2019, 1, 1), None)),
        ([("Subsequent designation, VN", "2019-01-01"), ("Provisional refusal, VN", "2020-01-01")], True, False, ("granted", None, None)),
        ([("Renewal, VN", "2019-01-01")], True, False, ("granted", None, None)),
        ([("Replacement of national registration by an international registration, VN", "2019-01-01")], True, False, ("granted", None, None)),
        ([("Confirmation of total provisional refusal, VN", "2019-01-01")], False, False, ("refused", None, date(2019, 1, 1))),
        ([("Confirmation of total provisional refusal, VN", "2019-01-01")], False, True, ("pending", None, None)),
        ([], False, False, ("pending", None, None)),
    ],
)
def test_vn_status(spark, history, accepted, active, out):
    day = date(2018, 1, 1) if active else None
    df = spark.createDataFrame([([(t, d, None, ["VN"]) for t, d in history], ["VN"], day, day, accepted)], f"e {EVENT}, c array<string>, r date, x date, a boolean")
    x = df.select(html.vn_status(*[F.col(c) for c in "ecrxa"]).alias("s")).first().s
    assert (x.status, x.grant_date, x.refusal_date) == out


def test_wilson_and_udf_names(spark):
    w = one(spark, scoring.wilson(F.lit(0), F.lit(0)))
    assert (w.low, w.high) == (0.0, 0.0)
    phonetics.register(spark)
    assert spark.sql("SELECT phonetic_similarity('Taseko', 'Tabeko'), dmetaphone('Thomas'), entity_norm('  ẞ  A ')").first()[:] == (0.911, "TMS", "ss a")


def test_phash(spark):
    import math
    import random
    import statistics

    from markweave.functions.images import phash

    rng = random.Random(1)
    images = [[rng.random() * 255 for _ in range(1024)] for _ in range(5)] + [[float(i % 32) for i in range(1024)]]

    def plain(x):
        low = [sum(x[32 * r + c] * math.cos(math.pi * u * (2 * r + 1) / 64) * math.cos(math.pi * v * (2 * c + 1) / 64) for r in range(32) for c in range(32)) for u in range(8) for v in range(8)]
        middle = statistics.median(low)
        return f"{int(''.join('1' if y > middle else '0' for y in low), 2):016x}"

    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*images, None, [1.0]])], "i int, x array<double>").repartition(2)
    got = {r.i: r.h for r in rows.select("i", phash("x").alias("h")).collect()}
    assert {i: got[i] for i in range(5)} == {i: plain(x) for i, x in enumerate(images[:5])} and got[6] is None and got[7] is None and len(got[5]) == 16
