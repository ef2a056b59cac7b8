"""Personal data: the contract's patterns by plain regexes, disguises by round trips."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from markweave.llm import pii

#: The contract's patterns as they stand.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        total = 0
        for i, d in enumerate(reversed(digits)):
            n = int(d) * (1 + i % 2)
            total += n - 9 * (n > 9)
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, rx in PLAIN.items() for m in re.finditer(rx, text) if holds(k, m.group())]


def found(text):
    return [(pii.KINDS[k], s, e) for k, s, e in pii.find(text)[1]]


def test_base_spans_as_plain_regexes():
    rng = random.Random(2)
    kinds = ["a", "B", "é", "1", "23", "192", "255", "256", "0300", ".", "..", "@", "-", " ", "  ", "+", "(", ")", "_", "%", "\n", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+1 (555) 010-9999", "x@y.z", "1.2.3.4", "３", "．", "​", "&#64;"]
    for _ in range(20_000):
        text = "".join(rng.choice(kinds) for _ in range(rng.randrange(0, 14)))
        base, every = pii.find(text)
        assert [(pii.KINDS[k], s, e) for k, s, e in base] == brute(text), text
        assert set(base) <= set(every) and every == sorted(every)
        assert all(0 <= s < e <= len(text) for _, s, e in every)


@pytest.mark.parametrize(
    "text,kind,span",
    [
        ("write to jane.doe [at] mail [dot] example [dot] org now", "email", "jane.doe [at] mail [dot] example [dot] org"),
        ("jane(at)example(dot)com", "email", "jane(at)example(dot)com"),
        ("mail jane dot doe at example dot co dot uk today", "email", "jane dot doe at example dot co dot uk"),
        ("jane @ example punkt de", "email", "jane @ example punkt de"),
        ("jane arroba ejemplo punto es", "email", "jane arroba ejemplo punto es"),
        ("jane&#64;example&period;com", "email", "jane&#64;example&period;com"),
        ("jаne@exаmple.com", "email", "jаne@exаmple.com"),  # Cyrillic letters
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ!", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("ja​ne@exam­ple.com", "email", "ja​ne@exam­ple.com"),
        ("at 192[.]168[.]10[.]7 we", "ip", "192[.]168[.]10[.]7"),
        ("host 10 dot 0 dot 0 dot 255 is", "ip", "10 dot 0 dot 0 dot 255"),
        ("host one nine two dot one six eight dot zero dot one is", "ip", "one nine two dot one six eight dot zero dot one"),
        ("card ４１１１ １１１１ １１１１ １１１１.", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("card 4111–1111–1111–1111", "card", "4111–1111–1111–1111"),
        ("card four one one one, one one one one, one one one one, one one one one ok", "card", "four one one one, one one one one, one one one one, one one one one"),
        ("call plus four four two zero seven nine four six zero one two three soon", "phone", "plus four four two zero seven nine four six zero one two three"),
        ("call + one five five five double zero nine nine now", "phone", "+ one five five five double zero nine nine"),
        ("ruf null eins sieben drei fünf fünf fünf neun neun an", "phone", "null eins sieben drei fünf fünf fünf neun neun"),
        ("appelez zéro un quatre deux six sept huit neuf merci", "phone", "zéro un quatre deux six sept huit neuf"),
        ("+٤٤ ٢٠ ٧٩٤٦ ٠١٢٣", "phone", "+٤٤ ٢٠ ٧٩٤٦ ٠١٢٣"),
    ],
)
def test_disguises(text, kind, span):
    s = text.index(span)
    assert (kind, s, s + len(span)) in found(text), found(text)
    # The same place behind other characters, and behind another disguise.
    for head in ("日本語 𝒳 ", "a [at] b [dot] cd; ", "x​y. "):
        assert (kind, len(head) + s, len(head) + s + len(span)) in found(head + text)


def test_plain_words_stay():
    for text in ("Look at example.com or at home.", "We meet at noon. Dot com firms fell.", "one two three", "He came at one, two or three dot matrix printers", "option (a) foo.bar", "seven of nine at five", "pages 12–15 and 1990–1995", "10² m", "Смотри на example", "un deux trois et quatre cinq"):
        assert found(text) == []


def test_steps_map_back():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 20)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(0, 4))))
        edits = [(s, e, rng.choice(["", "X", "YZ"])) for s, e in zip(cuts[::2], cuts[1::2], strict=False) if e > s]
        step = pii.Step(text, edits)
        want = []
        for i, c in enumerate(text):
            edit = next((x for x in edits if x[0] <= i < x[1]), None)
            want += [(c, i, i + 1)] if edit is None else [(x, edit[0], edit[1]) for x in edit[2]] if edit[0] == i else []
        assert step.text == "".join(x[0] for x in want)
        for s in range(len(want)):
            for e in range(s + 1, len(want) + 1):
                assert step.back(s, e) == (want[s][1], want[e - 1][2])


@pytest.mark.parametrize("part", ["w", "1", "1.", "a@", "a dot ", "one ", "+1 (", "1 dot ", "a at b.c ", "(", "a [at] ", "1 ", "@a.", "four.", "é", "&#64;", "x dot y@", "​"])
def test_long_texts_take_time_in_proportion(part):
    began = time.process_time()
    pii.find(part * (400_000 // len(part)))
    assert time.process_time() - began < 8


def test_rows(spark, docs, empty, clashing):
    texts = ["mail a.b@c.de and +49 30 1234567, 4111 1111 1111 1111 or 1.2.3.4", None, "", "ü" * 300_000 + " a [at] b [dot] cd"]
    df = docs.unionByName(spark.createDataFrame([(None if i == 1 else 9000, t, None, None, None) for i, t in enumerate(texts)] * 2, docs.schema)).repartition(3)
    want = []
    for r in df.collect():
        base = brute(r.text or "")
        say = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        want.append((r.doc_id, *(sum(x[0] == k for x in base) for k in pii.KINDS), hashlib.sha256(say(base).encode()).hexdigest(), say(found(r.text or ""))))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r) for r in pii.report(df).collect()), key=key) == sorted(want, key=key)
    assert pii.report(empty).isEmpty() and pii.report(clashing).count() == docs.count()
    spans = [x for r in pii.scan(df).collect() for x in r.spans]
    assert {x.found for x in spans if not x.base} == {"a [at] b [dot] cd"}
    cleaned = pii.redact(df.withColumn("spans", F.lit("own")))
    assert cleaned.columns == [*df.columns, "spans"]
    out = [r.text for r in cleaned.collect()]
    assert out.count("mail <email> and <phone>, <card> or <ip>") == 2 and out.count("ü" * 300_000 + " <email>") == 2 and None in out
