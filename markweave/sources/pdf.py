"""The words of PDF pages with their boxes, as rows that layout.word_lines() takes.

Files come through Spark's binary source, so any store that Spark reads will do, and a task
has a file at a time (2 GB at most). A page's content is read by the text operators of the
format; what can't be read (another filter, encryption, a broken object) is a row with an
error, for that page only where the file allows it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "doc string, page int, text string, x0 double, x1 double, top double, error string"
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_TOKEN = re.compile(rb"%[^\r\n]*|(?P<mark><<|>>|\[|\])|/(?P<name>[^\s()<>\[\]{}/%]*)|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<open>\()|(?P<word>[A-Za-z'\"*][^\s()<>\[\]{}/%]*)")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A gap of more than this share of the font size parts words; widths where a font gives none.
GAP, WIDTH = 0.2, 500


class Name(str):
    """A /Name."""


class Ref(int):
    """A reference to an object."""


class Op(bytes):
    """An operator or keyword."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A (string) from behind its bracket, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            nxt = data[at + 1 : at + 2]
            if m := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                out.append(int(m.group(), 8) & 255)
                at = m.end()
                continue
            out += _ESCAPES.get(nxt, b"" if nxt in b"\r\n" else nxt)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def parse(data: bytes) -> Iterator[object]:
    """The values and operators of a piece of PDF syntax."""
    stack: list[list] = []
    at, held = 0, []  # values that a reference may still take back

    def put(x: object) -> Iterator[object]:
        if stack:
            stack[-1].append(x)
        else:
            held.append(x)
        return iter(())

    while m := _TOKEN.search(data, at):
        at = m.end()
        if m["mark"] in (b"<<", b"["):
            stack.append([m["mark"]])
        elif m["mark"] in (b">>", b"]") and stack:
            kind, *inside = stack.pop()
            put(dict(zip(inside[::2], inside[1::2], strict=False)) if kind == b"<<" else inside)
        elif m["name"] is not None:
            put(Name(m["name"].decode("latin-1")))
        elif m["hex"] is not None:
            digits = re.sub(rb"\s", b"", m["hex"])
            put(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif m["number"]:
            put(float(m["number"]) if b"." in m["number"] else int(m["number"]))
        elif m["open"]:
            text, at = _literal(data, at)
            put(text)
        elif m["word"]:
            here = stack[-1] if stack else held
            if m["word"] == b"R" and len(here) >= 2 and isinstance(here[-2], int):
                here[-2:] = [Ref(here[-2])]
            elif stack:
                put({b"true": True, b"false": False}.get(m["word"]))
            else:
                yield from held
                held = []
                yield Op(m["word"])
    yield from held


class Document:
    """The objects of a file."""

    def __init__(self, data: bytes):
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("encrypted")
        self.raw = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}  # the last of a number counts
        self.inner: dict[int, object] = {}
        for n in list(self.raw):
            if b"/ObjStm" in self.raw[n]:
                head, body = self.get(Ref(n)), self.stream(Ref(n))
                numbers = [x for x in parse(body[: head["First"]]) if isinstance(x, int)]
                for number, start in zip(numbers[::2], numbers[1::2], strict=False):
                    self.inner[number] = next(parse(body[head["First"] + start :]), None)

    def get(self, x: object) -> object:
        """The value of a reference, or the value itself."""
        if not isinstance(x, Ref):
            return x
        if x in self.inner:
            return self.inner[x]
        return next(parse(self.raw.get(x, b"null").partition(b"stream")[0]), None)

    def stream(self, x: Ref) -> bytes:
        head, _, body = self.raw[x].partition(b"stream")
        body = body[2:] if body[:2] == b"\r\n" else body[1:]
        body = body[: body.rfind(b"endstream")]
        filters = self.get(next(parse(head)).get("Filter", []))
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                raise ValueError(f"unsupported filter {f}")
            body = zlib.decompressobj().decompress(body)
        return body

    def pages(self) -> Iterator[dict]:
        """Page objects in order, with what they inherit."""
        root = next((v for n in [*self.raw, *self.inner] if isinstance(v := self.get(Ref(n)), dict) and v.get("Type") == "Catalog"), None)
        todo = [(root["Pages"], {})] if root else []
        while todo:
            ref, inherited = todo.pop()
            node = self.get(ref)
            if isinstance(node, dict):
                own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
                if "Kids" in node:
                    todo += [(k, own) for k in reversed(self.get(node["Kids"]))]
                else:
                    yield own | node


class Font:
    """Codes of a font to text and width."""

    def __init__(self, doc: Document, font: dict):
        self.wide = font.get("Subtype") == "Type0"
        self.text: dict[int, str] = {}
        if isinstance(font.get("ToUnicode"), Ref):
            self._map(doc.stream(font["ToUnicode"]))
        if self.wide:
            inner = doc.get(doc.get(font["DescendantFonts"])[0])
            self.default, self.width = inner.get("DW", 1000), {}
            w = list(doc.get(inner.get("W", [])))
            while len(w) >= 2:
                second = doc.get(w[1])
                if isinstance(second, list):
                    self.width |= {w[0] + i: x for i, x in enumerate(second)}
                    w = w[2:]
                else:
                    self.width |= dict.fromkeys(range(w[0], second + 1), w[2]) if len(w) > 2 else {}
                    w = w[3:]
        else:
            self.default = WIDTH
            self.width = {font.get("FirstChar", 0) + i: x for i, x in enumerate(doc.get(font.get("Widths", [])))}

    def _map(self, cmap: bytes) -> None:
        word = lambda b: b.decode("utf-16-be", "replace")
        values: list = []
        for x in parse(cmap):
            if x == b"endbfchar":
                self.text |= {int.from_bytes(c): word(t) for c, t in zip(values[::2], values[1::2], strict=False)}
            elif x == b"endbfrange":
                for low, high, to in zip(values[::3], values[1::3], values[2::3], strict=False):
                    for i in range(int.from_bytes(high) - int.from_bytes(low) + 1):
                        self.text[int.from_bytes(low) + i] = word(to[i]) if isinstance(to, list) else word(to[:-2] + (int.from_bytes(to[-2:]) + i).to_bytes(2))
            if isinstance(x, Op):
                values = []
            else:
                values.append(x)

    def show(self, data: bytes) -> Iterator[tuple[str, float]]:
        step = 2 if self.wide else 1
        for i in range(0, len(data), step):
            code = int.from_bytes(data[i : i + step])
            yield self.text.get(code, "" if self.wide else bytes([code]).decode("cp1252", "replace")), self.width.get(code, self.default) / 1000


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def page_words(doc: Document, page: dict) -> Iterator[tuple[str, float, float, float]]:
    """(text, x0, x1, top) of the words of a page, in the order of its content."""
    contents = doc.get(page.get("Contents", []))
    parts = contents if isinstance(contents, list) else [page["Contents"]] if "Contents" in page else []
    fonts = doc.get(doc.get(page.get("Resources", {})).get("Font", {}))
    box = doc.get(page.get("MediaBox", [0, 0, 612, 792]))
    known: dict[str, Font] = {}
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    here, saved, tm, line = one, [], one, one
    font, size, lead, char, space, scale = None, 1.0, 0.0, 0.0, 0.0, 1.0
    word: list = ["", 0.0, 0.0, 0.0]
    out: list[tuple[str, float, float, float]] = []

    def end() -> None:
        if word[0]:
            out.append(tuple(word))
        word[0] = ""

    def show(data: bytes) -> None:
        nonlocal tm
        for text, width in font.show(data) if font else ():
            at = _times(tm, here)
            height = abs(size * at[3]) or abs(size)
            top, x = box[3] - at[5] - height, at[4]
            tm = _times((1, 0, 0, 1, (width * size + char + (space if text == " " else 0)) * scale, 0), tm)
            if word[0] and (abs(top - word[3]) > height / 2 or not -height / 2 < x - word[2] < GAP * height):
                end()
            if not text.strip():
                end()
            else:
                if not word[0]:
                    word[1], word[3] = x, top
                word[0] += text
                word[2] = _times((1, 0, 0, 1, -char * scale, 0), _times(tm, here))[4]

    def down(x: float, y: float) -> None:
        nonlocal line, tm
        line = tm = _times((1, 0, 0, 1, x, y), line)

    args: list = []
    for x in parse(b"\n".join(doc.stream(p) for p in parts)):
        if not isinstance(x, Op):
            args.append(x)
            continue
        if x == b"q":
            saved.append(here)
        elif x == b"Q":
            here = saved.pop() if saved else here
        elif x == b"cm":
            here = _times(tuple(args[-6:]), here)
        elif x == b"BT":
            tm = line = one
        elif x == b"Tf":
            size = args[-1]
            if args[-2] not in known:
                known[args[-2]] = Font(doc, doc.get(fonts[args[-2]]))
            font = known[args[-2]]
        elif x in (b"Td", b"TD"):
            lead = -args[-1] if x == b"TD" else lead
            down(*args[-2:])
        elif x == b"Tm":
            tm = line = tuple(args[-6:])
        elif x == b"T*":
            down(0, -lead)
        elif x in (b"TL", b"Tc", b"Tw", b"Tz"):
            lead, char, space, scale = (args[-1] if x == b"TL" else lead), (args[-1] if x == b"Tc" else char), (args[-1] if x == b"Tw" else space), (args[-1] / 100 if x == b"Tz" else scale)
        elif x == b"Tj":
            show(args[-1])
        elif x == b"'":
            down(0, -lead)
            show(args[-1])
        elif x == b'"':
            space, char = args[-3], args[-2]
            down(0, -lead)
            show(args[-1])
        elif x == b"TJ":
            for y in args[-1]:
                if isinstance(y, bytes):
                    show(y)
                else:
                    tm = _times((1, 0, 0, 1, -y / 1000 * size * scale, 0), tm)
        args = []
    end()
    yield from out


def file_words(data: bytes) -> Iterator[tuple]:
    """(page, text, x0, x1, top, error) of a file; pages count from 1."""
    try:
        doc = Document(data)
        pages = list(doc.pages())
        if not pages:
            raise ValueError("no pages")
    except Exception as e:
        yield None, None, None, None, None, str(e) or type(e).__name__
        return
    for i, page in enumerate(pages):
        try:
            for word in page_words(doc, page):
                yield i + 1, *word, None
        except Exception as e:
            yield i + 1, None, None, None, None, str(e) or type(e).__name__


def words(spark: SparkSession, path: str) -> DataFrame:
    """(doc, page, text, x0, x1, top, error) of the PDF files under path. doc is the file's
    name; rows with an error have no word, and stand for a page, or for a file if page is
    NULL. A page without text gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
        names = [c.split()[0] for c in WORDS.split(", ")]
        for b in batches:
            for doc, data in zip(b.column(0), b.column(1), strict=True):
                rows = [(doc.as_py(), *r) for r in file_words(data.as_py())]
                for i in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 20_000], strict=True), fields, strict=True)], names)

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc"), "content").mapInArrow(run, WORDS)
