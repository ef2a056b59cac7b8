"""Repeated passages by longest-previous-factor arrays, in buckets of suffix order.

A start is removed for `length` bytes if the string of that length also starts elsewhere:
its longest previous (or next) factor is at least `length` long. The suffixes of a bucket
are sorted by their bytes to that depth; neighbours' common prefixes, and the previous and
next smaller places in that order, give the longest previous factors, and with places
reversed the longest next ones. Without an earlier match a start is the first.

Buckets bring equal suffixes together without a global suffix array. Each window of
`length` bytes has a minimizer, the least hash among its grams of GRAM bytes, so equal
windows meet at equal minimizers, at an equal distance from them. Hashes of minimizers that
occur once are dropped at 8 bytes each; only around the others are slices of text sent: all
windows of one minimizer as one slice, equal slices pre-aggregated before the shuffle.
Hashes steer only what meets; matches are by bytes. A bucket with very many different slices
is dealt again by window, where windows of one MD5 digest are one row with the least place
(the previous smaller one of all others), so that no task holds the bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markweave.llm.common import few_rows, saved, sized, text_of

LENGTH, GRAM, SEGMENT, HOT_SLICES = 400, 128, 1 << 18, 5_000
#: A null doc_id stands before all others.
NO_ID = -(1 << 63)
#: Windows that are put into suffix order at once: 13 MB of bytes at full length.
WINDOWS = 1 << 15
_PLACE = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window of `size` bytes; two of equal bytes have equal ones."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[size:] - total[:-size]) * down[:n]
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the least, the leftmost of equals."""
    n = len(h) - width + 1
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(h)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)


def _runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first start, windows, minimizer place behind the start, hash) arrays:
    runs of windows with one minimizer. Texts are joined, and very long ones cut into
    segments that overlap, so arrays stay around SEGMENT bytes."""

    def groups() -> Iterator[list[tuple[int, int, bytes]]]:
        held, size = [], 0
        for i, t in enumerate(texts):
            if len(t) < length:
                continue
            for at in range(0, len(t) - length + 1, SEGMENT):
                part = t[at : at + SEGMENT + length - 1] if len(t) > SEGMENT else t
                if held and size + len(part) > SEGMENT + length:
                    yield held
                    held, size = [], 0
                held.append((i, at, part))
                size += len(part)
                if len(t) <= SEGMENT:
                    break
        if held:
            yield held

    for parts in groups():
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        gram = min(GRAM, max(1, length // 3))
        h = window_hashes(data, gram)
        least = _sliding_argmin(h, length - gram + 1)
        sizes = np.array([len(p) for _, _, p in parts])
        begins = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        owner = np.repeat(np.arange(len(parts)), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = least[begins[owner] + start]
        first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
        n = np.diff(np.append(first, len(place)))
        who = owner[first]
        number, offset = np.array([i for i, _, _ in parts])[who], np.array([a for _, a, _ in parts])[who]
        yield number, start[first] + offset, n, place[first] - begins[who] - start[first], h[place[first]]


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """tk: 16 bytes for the text; equal texts are one text from here on. tx: 8 bytes."""
    text = F.encode(text_of(docs), "UTF-8")
    return docs.select(*more, F.unhex(F.md5(text)).alias("tk"), F.xxhash64(text).alias("tx"), text.alias("bytes"))


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    """(h, tx, lo, hi): the minimizers of each text, with the least and the greatest of their
    places in the whole text. A text in several segments has a row of h for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            for number, s0, _, a, h in _runs(b.column(1).to_pylist(), length):
                place = s0 + a
                order = np.lexsort((place, h, number))
                number, h, place = number[order], h[order], place[order]
                edge = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (number[1:] != number[:-1])))
                last = np.append(edge[1:], len(h)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[edge].view(np.int64)), b.column(0).take(pa.array(number[edge].astype(np.int64))), pa.array(place[edge], pa.int64()), pa.array(place[last], pa.int64())], ["h", "tx", "lo", "hi"])

    return rows.select("tx", "bytes").mapInArrow(run, "h long, tx long, lo long, hi long")


def _slices(rows: DataFrame, length: int) -> DataFrame:
    """(h, tk, s0, n, a, slice) for the repeated minimizers `hs` of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            texts, wanted = b.column(1).to_pylist(), b.column(2).to_pylist()
            for number, s0, n, a, h in _runs(texts, length):
                signed = h.view(np.int64)
                keep = np.zeros(len(h), bool)
                edge = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
                for i, j in zip(edge, np.append(edge[1:], len(number)), strict=True):
                    keep[i:j] = np.isin(signed[i:j], np.array(wanted[number[i]], np.int64))
                number, s0, n, a, signed = number[keep], s0[keep], n[keep], a[keep], signed[keep]
                cut = [texts[k][s : s + m + length - 1] for k, s, m in zip(number.tolist(), s0.tolist(), n.tolist(), strict=True)]
                row = pa.array(number, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(signed), b.column(0).take(row), pa.array(s0), pa.array(n), pa.array(a), pa.array(cut, pa.binary())], ["h", "tk", "s0", "n", "a", "slice"])

    return rows.select("tk", "bytes", "hs").mapInArrow(run, "h long, tk binary, s0 long, n long, a long, slice binary")


def _nearest(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix in suffix order, what it shares with the nearest one before it whose
    place is smaller (the previous smaller value); 0 without one. lcp[r] is shared by r - 1
    and r, and 0 where a bucket starts. All walk back at once, each by the other's steps."""
    to, shared = np.arange(len(place)) - 1, lcp.copy()
    todo = np.flatnonzero(lcp)
    while True:
        todo = todo[(shared[todo] > 0) & (place[to[todo]] > place[todo])]
        if not len(todo):
            return shared
        over = to[todo]
        to[todo], shared[todo] = to[over], np.minimum(shared[todo], shared[over])


def factors(windows: np.ndarray, bucket: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest previous and the longest next factor of each window (a row of bytes) inside
    its bucket, to the depth of a row: the most bytes that it shares with one at a smaller,
    and at a greater place. Places differ inside a bucket; buckets are numbered under 2^32."""
    m, depth = windows.shape
    keyed = np.empty((m, 4 + depth), np.uint8)
    keyed[:, :4] = bucket.astype(">u4").view(np.uint8).reshape(-1, 4)
    keyed[:, 4:] = windows
    order = np.argsort(keyed.view(f"S{4 + depth}").ravel(), kind="stable")
    rows = windows[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.zeros(m, np.int64)
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), depth)
    lcp[1:][bucket[order][1:] != bucket[order][:-1]] = 0
    up, down = place[order], np.append(0, lcp[:0:-1])
    previous, following = np.empty(m, np.int64), np.empty(m, np.int64)
    for out, at in ((previous, up), (following, -up)):
        out[order] = np.maximum(_nearest(at, lcp), _nearest(at[::-1], down)[::-1])
    return previous, following


def _spans(flags: np.ndarray, number: np.ndarray, place: np.ndarray) -> dict[int, list[int]]:
    """[start, end, ...] of the runs of flagged places, by number."""
    out: dict[int, list[int]] = {}
    on = np.flatnonzero(flags)
    if len(on):
        first = np.flatnonzero(np.append(True, (np.diff(place[on]) != 1) | (np.diff(number[on]) != 0)))
        last = np.append(first[1:], len(on)) - 1
        for k, s, e in zip(number[on[first]].tolist(), place[on[first]].tolist(), place[on[last]].tolist(), strict=True):
            out.setdefault(k, []).extend((s, e + 1))
    return out


FOUND = "h long, sid binary, again array<int>, first array<int>"


def _judge(h: np.ndarray, a: np.ndarray, n: np.ndarray, doc: np.ndarray, s0: np.ndarray, many: np.ndarray, slices: list[bytes], length: int):
    """For each distinct slice of whole buckets: spans of its windows that occur again, and of
    those whose first occurrence is the slice's first."""
    data = np.frombuffer(b"".join(slices), np.uint8)
    sizes = np.array([len(s) for s in slices])
    begins = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(slices)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # Equal windows have the minimizer at equal distance, so a bucket is one for each distance.
    distance = a[number] - at
    order = np.lexsort((s0[number] + at, doc[number], distance, h[number]))
    key, near = h[number[order]], distance[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (near[1:] != near[:-1]))
    first, bucket = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    view, i = np.lib.stride_tricks.sliding_window_view(data, length), 0
    earlier, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    while i < len(order):  # whole buckets, WINDOWS rows at a time
        more = np.searchsorted(first, i + WINDOWS, "right") - 1
        j = max(int(first[more]), int(first[bucket[i] + 1]) if bucket[i] + 1 < len(first) else len(order)) if more < len(first) - 1 else len(order)
        part = order[i:j]
        previous, following = factors(view[begins[number[part]] + at[part]], bucket[i:j] - bucket[i], np.arange(j - i))
        earlier[part], later[part] = previous >= length, following >= length
        i = j
    return _spans(earlier | later | many[number], number, at), _spans(~earlier, number, at)


def _bucket_spans(distinct: DataFrame, length: int) -> DataFrame:
    """FOUND rows for the distinct slices (h, a, n, sid, slice, doc, s0, many), whole buckets
    at a time as the sorted rows of a partition stream by."""

    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        get = lambda c: t[c].to_numpy()
        again, first = _judge(get("h"), get("a"), get("n"), get("doc"), get("s0"), get("many"), t["slice"].to_pylist(), length)
        rows = sorted(again)
        ids = pa.array(rows, pa.int64())
        lists = lambda x: pa.array([x.get(i, []) for i in rows], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([t["h"].take(ids).combine_chunks(), t["sid"].take(ids).combine_chunks(), lists(again), lists(first)], ["h", "sid", "again", "first"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in few_rows(batches):
            h = b.column(0).to_numpy()
            change = np.flatnonzero(h[1:] != h[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != h[0]:
                yield search(held)
                held = []
            if len(change):
                held.append(b.slice(0, int(change[-1])))
                yield search(held)
                held = [b.slice(int(change[-1]))]
            else:
                held.append(b)
        if held:
            yield search(held)

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = distinct.select("h", "sid", "a", "n", "doc", "s0", "many", "slice")
    return rows.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, FOUND)


def _window_spans(distinct: DataFrame, length: int) -> DataFrame:
    """FOUND rows of buckets with very many slices: each window is a row with its hash, and
    equal ones meet in an aggregate, so no task holds a bucket."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, sid, a, n, doc, s0, many, cut = (b.column(k)[i].as_py() for k in range(8))
                win = [hashlib.md5(cut[k : k + length], usedforsecurity=False).digest() for k in range(n)]
                same = lambda x, kind, n=n: pa.array([x] * n, kind)
                yield pa.RecordBatch.from_arrays(
                    [same(h, pa.int64()), same(sid, pa.binary()), pa.array(range(n), pa.int32()), pa.array([a - k for k in range(n)], pa.int64()), pa.array(win, pa.binary()), same(doc, pa.int64()), pa.array([s0 + k for k in range(n)], pa.int64()), same(many, pa.bool_())],
                    ["h", "sid", "k", "o", "win", "doc", "at", "many"],
                )

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        k, again, first = (t[c].to_numpy() for c in ("k", "again", "first"))
        order = np.argsort(k)
        zero = np.zeros(len(k), np.int64)
        a, f = (_spans(x[order], zero, k[order]).get(0, []) for x in (again, first))
        return pa.table({"h": [key[0].as_py()], "sid": pa.array([key[1].as_py()], pa.binary()), "again": pa.array([a], pa.list_(pa.int32())), "first": pa.array([f], pa.list_(pa.int32()))})

    win = saved(distinct.select("h", "sid", "a", "n", "doc", "s0", "many", "slice").mapInArrow(explode, "h long, sid binary, k int, o long, win binary, doc long, at long, many boolean"), "windows")
    best = win.groupBy("h", "o", "win").agg(F.min(F.struct("doc", "at", "sid", "k")).alias("lo"), F.count("*").alias("c"))
    marked = win.join(best, ["h", "o", "win"]).select("h", "sid", "k", ((F.col("c") > 1) | F.col("many")).alias("again"), ((F.col("lo")["sid"] == F.col("sid")) & (F.col("lo")["k"] == F.col("k"))).alias("first"))
    return marked.groupBy("h", "sid").applyInArrow(gather, FOUND)


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot_slices: int = HOT_SLICES) -> DataFrame:
    """(tk, doc, copies, again, later) by distinct text with any: tk is its 16-byte key, doc
    its least doc_id, copies its number of rows; again holds [start, end, ...] of windows
    that occur elsewhere in other texts or this one, later those that do so before, both
    as starts, without what copies of the whole text add."""
    keyed = _keyed(docs, "doc_id")
    first = F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    texts = saved(keyed.groupBy("tk").agg(first.alias("doc"), F.count("*").alias("copies"), F.max(F.octet_length("bytes")).alias("size")), "texts")
    anchors = saved(_anchors(keyed, length), "anchors")
    # Copies of one text have one tx and the same places, so they alone make nothing repeated.
    spread = anchors.groupBy("h").agg(F.min("tx").alias("t0"), F.max("tx").alias("t1"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    repeated = spread.where("t0 <> t1 OR lo <> hi").select("h")
    lists = saved(anchors.join(repeated, "h").groupBy("tx").agg(F.collect_set("h").alias("hs")), "repeated")
    # One row of each text is enough to slice it; copies give the same slices, counted once.
    looked = keyed.select("tk", "tx", "bytes").join(sized(lists, F.size("hs") * 8 + 40), "tx")
    sid = F.unhex(F.md5(F.concat("slice", F.encode(F.col("a").cast("string"), "UTF-8"))))
    slices = saved(_slices(looked, length).withColumn("sid", sid).join(sized(texts, F.lit(60)).select("tk", "doc"), "tk"), "slices")
    place = F.struct("doc", "s0", "tk")
    distinct = saved(
        slices.groupBy("h", "sid").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("slice").alias("slice"))
        .select("h", "sid", "a", "n", F.col("lo")["doc"].alias("doc"), F.col("lo")["s0"].alias("s0"), (F.col("lo") != F.col("hi")).alias("many"), "slice"),
        "distinct-slices",
    )
    hot = saved(distinct.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > hot_slices).select("h"), "hot")
    if hot.isEmpty():
        found = _bucket_spans(distinct, length)
    else:
        found = _bucket_spans(distinct.join(hot, "h", "left_anti"), length).unionByName(_window_spans(distinct.join(hot, "h", "left_semi"), length))
    firsts = distinct.select("h", "sid", F.col("doc").alias("d0"), F.col("s0").alias("p0"))
    # One row a slice on this side, and one join of places with it, which Spark splits when skewed.
    found = saved(found.join(firsts, ["h", "sid"]), "found")
    spots = slices.select("h", "sid", "tk", "doc", "s0").distinct().join(found, ["h", "sid"])
    shifted = lambda c: F.transform(c, lambda x: x + F.col("s0"))
    is_first = F.col("doc").eqNullSafe(F.col("d0")) & (F.col("s0") == F.col("p0"))
    each = spots.select("tk", shifted(F.col("again")).alias("again"), F.when(is_first, shifted(F.col("first"))).otherwise(F.array().cast("array<long>")).alias("first"))
    by_text = each.groupBy("tk").agg(F.flatten(F.collect_list("again")).alias("again"), F.flatten(F.collect_list("first")).alias("first"))
    joined = texts.join(by_text, "tk", "left").where(F.col("again").isNotNull() | ((F.col("copies") > 1) & (F.col("size") >= length)))
    none = F.array().cast("array<long>")
    return joined.select("tk", "doc", "copies", F.coalesce("again", none).alias("again"), F.coalesce("first", none).alias("first"))


def _starts(spans: list[int], size: int) -> np.ndarray:
    """A flag for each start from [start, end, ...]."""
    step = np.zeros(size + 1, np.int32)
    if spans:
        pairs = np.array(spans, np.int64).reshape(-1, 2)
        np.add.at(step, pairs[:, 0], 1)
        np.add.at(step, pairs[:, 1], -1)
    return np.cumsum(step)[:size] > 0


def removed_bytes(size: int, length: int, again: list[int], first: list[int], copies: int, is_first: bool, keep_first: bool) -> list[tuple[int, int]]:
    """Maximal [start, end) to remove from a text of `size` bytes."""
    n = size - length + 1
    if n <= 0:
        return []
    flags = _starts(again, n)
    if keep_first and is_first:
        flags &= ~_starts(first, n)
    elif copies > 1:
        flags[:] = True
    on = np.flatnonzero(flags)
    if not len(on):
        return []
    gap = np.flatnonzero(np.diff(on) > length) + 1
    return [(int(on[i]), int(on[j - 1]) + length) for i, j in zip(np.append(0, gap), np.append(gap, len(on)), strict=True)]


def _whole_points(text: bytes, gone: list[tuple[int, int]]) -> str:
    """The text without the spans; a code point that loses a byte goes whole."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out, at = [], 0
    for s, e in gone:
        while inside(s):
            s -= 1
        while inside(e):
            e += 1
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, hot_slices: int = HOT_SLICES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), removed (start:end,... in bytes) and
    kept_text (string) of every row of docs.

    A byte goes if a string of `length` bytes that also starts elsewhere covers it. With
    keep_first a string stays where it starts first, by doc_id, then place. Strings are judged
    on the input, inside documents. kept is what is left byte by byte; in kept_text a code
    point that lost a byte is gone whole. Texts are UTF-8; a null one is empty; one under
    `length` stays whole. Rows with the same text are copies of each other, whatever their
    ids; a null doc_id comes before all others. An empty table gives no rows; columns besides
    doc_id and text are not used.
    """
    spans = sized(saved(repeated_spans(docs, length, hot_slices), "spans"), (F.size("again") + F.size("first")) * 8 + 60).withColumnRenamed("tk", "_tk")
    rows = _keyed(docs, "doc_id")
    joined = rows.join(spans, F.col("tk") == F.col("_tk"), "left").select("doc_id", "bytes", "doc", "copies", "again", "first")
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "removed": pa.string(), "kept_text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            out: dict[str, list] = {c: [] for c in kinds}
            for doc_id, t, doc, copies, again, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                is_first = (NO_ID if doc_id is None else doc_id) == doc
                gone = removed_bytes(len(t), length, again or [], first or [], copies, is_first, keep_first) if copies else []
                cuts = [0, *(x for span in gone for x in span), len(t)]
                kept = b"".join(t[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)) if gone else t
                row = (len(t), len(t) - len(kept), len(gone), kept, ",".join(f"{i}:{j}" for i, j in gone), _whole_points(t, gone))
                for column, x in zip(out.values(), row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[c], k) for c, k in kinds.items())], ["doc_id", *kinds])

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, removed string, kept_text string")


def digest(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, removed, kept_text of every
    document."""
    out = remove_repeats(docs, **params)
    left = (F.col("n_bytes") - F.col("n_removed")).alias("n_kept")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), left, "removed", "kept_text")
