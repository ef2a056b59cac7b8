"""Small PDFs, made by hand, to words and lines."""

import random
import zlib

from markweave.operators import layout
from markweave.sources import pdf


def make(pages, fonts=None, packed=False, name="FlateDecode", tail=b""):
    """A file of pages, each the bytes of its content; packed: objects in an object stream."""
    fonts = fonts or b"<< /F1 << /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [" + b"500 " * 200 + b"] >> >>"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /MediaBox [0 0 600 800] /Resources << /Font " + fonts + b" >> /Kids [" + b" ".join(b"%d 0 R" % (10 + i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)}
    streams = {}
    for i, content in enumerate(pages):
        objects[10 + i] = b"<< /Type /Page /Parent 2 0 R /Contents [%d 0 R] >>" % (100 + i)
        data = zlib.compress(content)
        streams[100 + i] = b"<< /Length %d /Filter /%s >>\nstream\r\n" % (len(data), name.encode()) + data + b"\nendstream"
    if packed:
        body, heads = b"", b""
        for n, o in objects.items():
            heads, body = heads + b"%d %d " % (n, len(body)), body + o + b" "
        data = zlib.compress(heads + body)
        streams[50] = b"<< /Type /ObjStm /N %d /First %d /Filter [/FlateDecode] /Length %d >> stream\n" % (len(objects), len(heads), len(data)) + data + b"\nendstream"
        objects = {}
    return b"%PDF-1.5\n%\xe2\xe3\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in (objects | streams).items()) + tail + b"trailer << /Root 1 0 R >>\n%%EOF"


def text(lines):
    """Content with (x, top, string) lines at size 10."""
    return b"BT /F1 10 Tf " + b" ".join(b"1 0 0 1 %d %d Tm (%s) Tj" % (x, 790 - top, s.encode("latin-1")) for x, top, s in lines) + b" ET"


def found(data):
    return [x[:2] if x[5] is None else (x[0], x[5]) for x in pdf.file_words(data)]


def test_words_have_boxes():
    assert list(pdf.file_words(make([text([(50, 20, "cold bolt")])]))) == [(1, "cold", 50.0, 70.0, 20.0, None), (1, "bolt", 75.0, 95.0, 20.0, None)]
    for packed in (False, True):
        assert found(make([text([(50, 20, "a (b\\\\)"), (50, 40, "c")]).replace(b"(a (b", b"(a \\(b").replace(b"b\\\\)", b"b\\)"), b"", text([(1, 1, "z")])], packed=packed)) == [(1, "a"), (1, "(b)"), (1, "c"), (3, "z")]


def test_operators_place_text():
    # Kerning joins or parts words; lines move by T*, Td and quotes; cm scales what q saves.
    content = b"BT /F1 10 Tf 12 TL 10 700 Td [(co) -100 (ld) -600 (bo) 20 (lt)] TJ T* (\\101\\102) Tj 0 -30 Td (x) Tj (y) ' 2 0 (z w) \" ET q 2 0 0 2 0 0 cm BT /F1 5 Tf 50 100 Td <6162> Tj ET Q BT /F1 10 Tf 300 50 Td (end) Tj ET"
    rows = [(w, round(x, 1), round(top, 1)) for _, w, x, _, top, _ in pdf.file_words(make([content]))]
    assert rows == [("cold", 10, 90), ("bolt", 37, 90), ("AB", 10, 102), ("x", 10, 132), ("y", 10, 144), ("z", 10, 156), ("w", 22, 156), ("ab", 100, 590), ("end", 300, 740)]


def test_wide_fonts_through_their_maps():
    cmap = zlib.compress(b"1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<1EAD> <006400E1>] endbfrange")
    fonts = b"<< /F1 << /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 60 0 R /DescendantFonts [<< /Subtype /CIDFontType2 /DW 1000 /W [16 [600 700] 32 33 500] >>] >> >>"
    tail = b"60 0 obj << /Filter /FlateDecode >> stream\n" + cmap + b"\nendstream endobj\n"
    data = make([b"BT /F1 10 Tf 10 700 Td <00100011001200030020> Tj <0021> Tj ET"], fonts, tail=tail)
    assert [(w, x0, x1) for _, w, x0, x1, _, _ in pdf.file_words(data)] == [("ABC", 10.0, 33.0), ("ậdá", 43.0, 53.0)]


def test_what_cannot_be_read_is_a_row():
    assert found(make([text([(1, 1, "a")])], name="DCTDecode")) == [(1, "unsupported filter DCTDecode")]
    assert found(b"%PDF-1.4\n/Encrypt 5 0 R") == [(None, "encrypted")] and found(b"") == [(None, "no pages")] and found(b"\x00junk obj endobj") == [(None, "no pages")]
    broken = make([text([(1, 1, "a")]), text([(1, 1, "b")])])
    good = zlib.compress(text([(1, 1, "a")]))
    assert found(broken.replace(good, b"x" * len(good))) [0][0] == 1 and found(broken.replace(good, b"x" * len(good)))[1:] == [(2, "b")]


def test_lines_of_one_and_two_columns(spark, tmp_path):
    left = [(40, 20 + 15 * i, f"({210 + i}) left {i}") for i in range(12)]
    right = [(320, 20 + 15 * i, f"right {i} end") for i in range(12)]
    wide = [(40, 20 + 15 * i, f"line{i} {'over-the-middle-of-the-page-' * 2}word end") for i in range(14)]
    (tmp_path / "two.pdf").write_bytes(make([text([x for p in zip(left, right) for x in p]), text(left[:2])]))
    (tmp_path / "one.pdf").write_bytes(make([text([(40, top, s) for _, top, s in wide])], packed=True))
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    rows = pdf.words(spark, str(tmp_path)).cache()
    assert [(r.doc, r.page, r.error) for r in rows.where("error IS NOT NULL").collect()] == [("bad.pdf", None, "no pages")]
    lines = layout.word_lines(rows.where("error IS NULL").drop("error")).orderBy("doc", "page", "line_no").collect()
    assert [r.line for r in lines if r.doc == "two.pdf" and r.page == 1] == [s for _, _, s in left] + [s for _, _, s in right]
    assert [r.line for r in lines if r.doc == "one.pdf"] == [s for _, _, s in wide]
    by_entry = layout.entry_lines(rows.where("error IS NULL")).orderBy("doc", "page", "line_no").collect()
    assert [r.line for r in by_entry if r.doc == "one.pdf"] == [s for _, _, s in wide]
    # A page of few words is read over its full width.
    assert [r.line for r in by_entry if r.page == 2] == ["(210) left 0", "(211) left 1"]


def test_entry_lines_by_plain_python(spark):
    """Random pages: entries, columns, the full width from (511) on, headers that go."""
    rng = random.Random(7)

    def lines(words):
        out, y = [], None
        for top, x0, text in sorted(words, key=lambda w: (round(w[0] / 3) * 3, w[1])):
            if y is None or abs(top - y) > 3:
                out, y = [*out, []], top
            out[-1].append(text)
        return [" ".join(x) for x in out]

    def page(words):
        mid = max(w[2] for w in words) / 2
        crossing = sum(x0 < mid < x1 for _, x0, x1, _ in words)
        starts = sorted({top for top, x0, _, text in words if text in ("(111)", "(116)") and x0 < mid})
        if len(words) < 30 or crossing > max(10, len(words) / 10) or not starts:
            return lines([(t, a, s) for t, a, _, s in words])
        starts = ([0.0] if starts[0] > 30 else []) + starts + [1e9]
        out = []
        for low, high in zip(starts, starts[1:], strict=False):
            here = [w for w in words if low <= w[0] < high]
            cut = min((t for t, a, _, s in here if s == "(511)" and a < mid), default=1e9) - 2
            for side in (lambda t, a: t < cut and a < mid, lambda t, a: t < cut and a >= mid, lambda t, a: t >= cut):
                out += lines([(t, a, s) for t, a, _, s in here if side(t, a)])
        return out

    rows, want = [], []
    for n in range(60):
        size, words, spots = rng.choice((5, 29, 30, 60, 150)), [], set()
        while len(words) < size:
            top, x0 = float(rng.randrange(0, 780)), rng.choice((40.0, 90.0, 150.0, 320.0, 380.0, 450.0)) + rng.randrange(40)
            if (round(top / 3), x0) not in spots:
                spots.add((round(top / 3), x0))
                words.append((top, x0, x0 + rng.choice((10, 30, 30, 30, 200 if n % 3 else 30)), rng.choice(["(111)", "(116)", "(511)"] + [f"w{len(words)}"] * (8 if n % 4 else 0) + [f"v{len(words)}"] * 8)))
        rows += [(f"d{n // 2}", n % 2, s, a, b, t) for t, a, b, s in words]
        want += [(f"d{n // 2}", n % 2, i + 1, x) for i, x in enumerate(page(words))]
    made = spark.createDataFrame([*rows, ("d0", 0, None, 1.0, 2.0, 3.0)], "doc string, page int, text string, x0 double, x1 double, top double")
    assert sorted(map(tuple, layout.entry_lines(made).collect())) == sorted(want)
    assert layout.entry_lines(made.limit(0)).count() == 0
