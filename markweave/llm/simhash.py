"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are dealt by segments: two that differ in at most `bits` of 64 bits
agree on two of `bits` + 2 segments, so a table for each two segments holds every pair.
Inside a bucket the fingerprints are sorted by Gray rank; runs of them share bits, which
are factored out as a mask and pattern into upper nodes, level by level. The search
descends pairs of nodes, counting differences on bits that both share and were not counted
above, and drops whole groups when the sum passes the limit. A bucket gives the edges of a
forest, never its pairs. Where codes are only parts of longer fingerprints, rows carry more
bits of these (`check`), a pair is a candidate only if those are near too, and the forest is
the one of least distances. A candidate that is rejected later may have stood for links that
hold, so a second search (`_missed`) looks at all candidates whose ends the first one left in
different classes; what is in one class already is passed over in whole groups. Buckets above `bucket_rows` are dealt again on their free bits
(`bits` + 1 parts, one of which agrees), until FREE_BITS or fewer are free: a bucket of
distinct fingerprints then has at most 2^15 rows, whatever the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from markweave.llm.common import LOWER, few_rows, saved, sized, text_of
from markweave.llm.components import components

SEED, FREE_BITS = 42, 15
#: Columns with more bits of the fingerprint that a code is of.
CHECK = ("c0", "c1")
#: Behind them: the most of those bits by which a row differs from any that it goes on for; and,
#: in the second search, its class, and whether rows that it goes on for are in other ones.
REACH, CLASS = "reach", ("class", "mixed")


def fingerprint(text: str, words: int = 3) -> int:
    """64 majority bits over the XXH64 of all word shingles; 0 for a text without words."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return 0
    grams = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w]
    h = np.fromiter((xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # 4 MB of bits at a time
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_key, fp long) of every document; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "text_key", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_key"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def gray_rank(code: Column) -> Column:
    """The place of a code in the reflected Gray sequence (as unsigned bits)."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def _moved(code: Column, lead: int, at: int, size: int) -> Column:
    """Behind its first `lead` bits, brings the `size` bits at `at` to the front."""
    cut = lambda start, n: F.shiftrightunsigned(F.shiftleft(code, start), 64 - n) if n else F.lit(0).cast("long")
    out = F.shiftleft(cut(0, lead), 64 - lead) if lead else F.lit(0).cast("long")
    put = lead
    for start, n in ((at, size), (lead, at - lead), (at + size, 64 - at - size)):
        if n:
            out = out.bitwiseOR(F.shiftleft(cut(start, n), 64 - put - n))
            put += n
    return out


def _near_pairs(codes: np.ndarray, starts: np.ndarray, bits: int, fan: int = 16, kind: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) indices, a < b, of all pairs in a bucket with at most `bits` differences, many at a
    time. starts: where buckets begin; inside them codes are in Gray order. kind: pairs of
    one kind are left out, unless it is -1."""
    n = len(codes)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    mask, pattern, bucket_starts = [np.full(n, full)], [codes], starts
    kinds = [np.full(n, -1) if kind is None else kind]
    first_child: list[np.ndarray] = []
    while len(mask[-1]) > len(bucket_starts):
        size = np.diff(np.append(bucket_starts, len(mask[-1])))
        groups = -(-size // fan)
        offset = np.cumsum(groups) - groups
        begin = np.repeat(bucket_starts, groups) + fan * (np.arange(groups.sum()) - np.repeat(offset, groups))
        both = np.bitwise_and.reduceat(pattern[-1], begin)
        some = np.bitwise_or.reduceat(pattern[-1], begin)
        shared = np.bitwise_and.reduceat(mask[-1], begin) & ~(both ^ some)
        first_child.append(np.append(begin, len(mask[-1])))
        mask.append(shared)
        pattern.append(both & shared)
        least = np.minimum.reduceat(kinds[-1], begin)
        kinds.append(np.where(least == np.maximum.reduceat(kinds[-1], begin), least, -1))
        bucket_starts = offset
    top = len(mask) - 1
    roots = np.arange(len(mask[top]))
    zero = np.zeros(len(roots), np.int64)
    todo = [(top, roots, roots, zero, mask[top][roots] * 0)]
    while todo:
        level, a, b, spent, seen = todo.pop()
        if level == 0:
            keep = a < b
            yield a[keep], b[keep]
            continue
        kids = first_child[level - 1]
        na, nb = kids[a + 1] - kids[a], kids[b + 1] - kids[b]
        grown = np.cumsum(na * nb)
        if len(a) > 1 and grown[-1] > 1 << 20:
            cut = max(1, int(np.searchsorted(grown, grown[-1] // 2)))
            todo += [(level, a[x], b[x], spent[x], seen[x]) for x in (slice(cut), slice(cut, None))]
            continue
        pair = np.repeat(np.arange(len(a)), na * nb)
        within = np.arange(len(pair)) - np.repeat(grown - na * nb, na * nb)
        i = kids[a][pair] + within // nb[pair]
        j = kids[b][pair] + within % nb[pair]
        shared = mask[level - 1][i] & mask[level - 1][j]
        new = shared & ~seen[pair]
        cost = spent[pair] + np.bitwise_count((pattern[level - 1][i] ^ pattern[level - 1][j]) & new)
        of = kinds[level - 1]
        keep = (cost <= bits) & (i <= j) & ((of[i] != of[j]) | (of[i] < 0))
        if keep.any():
            todo.append((level - 1, i[keep], j[keep], cost[keep], shared[keep]))


def _candidates(pairs: Iterator[tuple[np.ndarray, np.ndarray]], check: np.ndarray, reach: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, distance) of the pairs that differ by at most `limit` bits of check, or for which
    two rows that they go on for may."""
    for a, b in pairs:
        apart = np.bitwise_count(check[a] ^ check[b]).sum(1, dtype=np.int64)
        near = apart <= limit + reach[a] + reach[b]
        yield a[near], b[near], apart[near]


def _tree_edges(codes: np.ndarray, starts: np.ndarray, bits: int, check: np.ndarray | None = None, reach: np.ndarray | None = None, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) indices: a forest of links of at most `bits` differences whose trees are what
    such links reach. starts: as in _near_pairs. check: longs of each code; then links are
    the _candidates, and the forest is the one of least distances in these."""
    n, pairs = len(codes), _near_pairs(codes, starts, bits)
    if check is None:
        labels, forest = np.arange(n), [(np.zeros(0, int), np.zeros(0, int))]
        for a, b in pairs:
            forest += _union(labels, a, b)
        return tuple(np.concatenate(x) for x in zip(*forest, strict=True))
    links = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))]
    for found in _candidates(pairs, check, reach, limit):
        links.append(found)
        if sum(len(x[0]) for x in links) > 1 << 21:
            links = [_least_forest(n, links)]
    return _least_forest(n, links)[:2]


def _least_forest(n: int, links: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(a, b, distance): the links of a spanning forest of least distances."""
    a, b, apart = (np.concatenate(x) for x in zip(*links, strict=True))
    labels, out = np.arange(n), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))]
    for d in np.unique(apart):
        at = apart == d
        out += [(x, y, np.full(len(x), d)) for x, y in _union(labels, a[at], b[at])]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hooks larger roots to smaller ones until a and b agree; labels stay flat. The pairs
    that hooked a root come back."""
    hooked = []
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        high, low = np.maximum(x, y), np.minimum(x, y)
        np.minimum.at(labels, high, low)
        won = np.flatnonzero(labels[high] == low)
        won = won[np.unique(high[won], return_index=True)[1]]
        hooked.append((a[won], b[won]))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up
    return hooked


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches as arrays, cut so that rows of one value of the first
    `keys` columns are together."""
    held: list[list[np.ndarray]] = []
    joined = lambda: [np.concatenate(x) for x in zip(*held, strict=True)]
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held and any(c[0] != h[-1] for c, h in zip(columns[:keys], held[-1], strict=False)):
            yield joined()
            held = []
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])) + 1
        if len(change):  # the last group may go on in the next batch
            held.append([c[: change[-1]] for c in columns])
            yield joined()
            held = []
        held.append([c[change[-1] if len(change) else 0 :] for c in columns])
    if held:
        yield joined()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin."""
    return np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def _bucket_edges(rows: DataFrame, lead: int, bits: int, limit: int) -> DataFrame:
    """(a, b) of the forest of each bucket (table, first `lead` bits of code), by fp. limit:
    of the bits in which the CHECK columns may differ, if there are any. With the CLASS
    columns all candidates that may join two classes, not a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, code, fp, *more in _whole_groups(batches, 2):
            codes, starts = code.view(np.uint64), _starts(table, first)
            check, reach = (np.stack(more[:2], 1).view(np.uint64), more[2]) if more else (None, None)
            if len(more) > 3:
                kind = np.where(more[4] == 0, np.unique(more[3], return_inverse=True)[1], -1)
                found = _candidates(_near_pairs(codes, starts, bits, kind=kind), check, reach, limit)
            else:
                found = [_tree_edges(codes, starts, bits, check, reach, limit)]
            for a, b, *_ in found:
                yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("table", F.shiftrightunsigned("code", 64 - lead).alias("lead"), "code", "fp", *_more(rows))
    # An unsigned order of ranks: the sign bit turned.
    rank = gray_rank(F.col("code")).bitwiseXOR(F.lit(-(1 << 63)))
    sorted_rows = keyed.repartition(parts, "table", "lead").sortWithinPartitions("table", "lead", rank)
    return sorted_rows.mapInArrow(run, "a long, b long")


def _more(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c in (*CHECK, REACH, *CLASS)]


def _dealt(rows: DataFrame, codes: list[Column], *keys: str) -> DataFrame:
    """Each row once for each code, under a table of its own for keys and that code."""
    each = F.array(*[F.struct(F.xxhash64(*keys, F.lit(i)).alias("table"), c.alias("code")) for i, c in enumerate(codes)])
    return rows.select("fp", *_more(rows), F.inline(each)).select("table", "code", "fp", *_more(rows))


def near_fingerprints(fps: DataFrame, bits: int = 2, bucket_rows: int = 4096) -> DataFrame:
    """(a, b) edges among distinct fingerprints fps (fp long), which differ in at most `bits`
    bits and whose components are those of all such pairs."""
    return near_codes(fps.select(F.lit(0).alias("table"), F.col("fp").alias("code"), "fp"), 64, bits, 2, bucket_rows)


def near_codes(rows: DataFrame, width: int, bits: int, agree: int, bucket_rows: int, limit: int = 0) -> DataFrame:
    """near_fingerprints for rows (table, code, fp) with distinct codes in a table, which are
    the first `width` bits of a long; edges name the fp. The code is cut into bits + agree
    segments, `agree` of which agree in a pair. With the CHECK columns and REACH a few rows may
    share a code, and links are _candidates within `limit`; with CLASS too, edges are all of
    these that may join two classes, some of them twice."""
    size = width // (bits + agree)
    if agree not in (1, 2) or size < 4:
        raise ValueError("segments of four bits and more, one or two of which agree")
    codes = []
    for chosen in combinations(range(bits + agree), agree):
        code = F.col("code")
        for i, x in enumerate(chosen):
            code = _moved(code, size * i, size * x, size)
        codes.append(code)
    level = _dealt(rows, codes, "table")
    out, lead = None, agree * size
    while True:
        bucket = F.shiftrightunsigned("code", 64 - lead)
        sizes = level.groupBy("table", bucket.alias("lead")).agg(F.count("*").alias("n")).where("n > 1")
        sizes = saved(sizes, "buckets")
        large = sizes.where(F.col("n") > bucket_rows)
        size = (width - lead) // (bits + 1)
        again = width - lead > FREE_BITS and size and not large.isEmpty()
        keyed = level.withColumn("lead", bucket)
        take = keyed.join(sizes.where(F.col("n") <= bucket_rows) if again else sizes, ["table", "lead"], "left_semi")
        edges = _bucket_edges(take, lead, bits, limit)
        out = edges if out is None else out.unionByName(edges)
        if not again:
            return out
        hot = keyed.join(large.select("table", "lead"), ["table", "lead"], "left_semi")
        level = saved(_dealt(hot, [_moved(F.col("code"), lead, lead + size * i, size) for i in range(bits + 1)], "table", "lead"), "hot-buckets")
        lead += size


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2, bucket_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least
    doc_id reachable over links of at most `bits` differing bits), kept (doc_id is it).

    Null, empty and word-free texts share fingerprint zero and link like others. Rows with
    the same doc_id and text are one class. Other columns of docs are not used.
    """
    return _classes(docs, words, bits, bucket_rows).drop("text_key")


def _classes(docs: DataFrame, words: int, bits: int, bucket_rows: int) -> DataFrame:
    fp = saved(fingerprints(docs, words), "fingerprints")
    distinct = saved(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    classes = _least_of(distinct, near_fingerprints(distinct, bits, bucket_rows))
    return fp.join(classes, "fp").select(
        "doc_id",
        "text_key",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _least_of(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id): the least document that each fingerprint reaches."""
    roots = components(edges)
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return saved(of.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")


#: Longs of a wide fingerprint; each half of one has a code of CODE_BITS, which is searched
#: for others within CODE_NEAR bits.
WIDE, CODE_BITS, CODE_NEAR = 12, 32, 2
_MIX = np.array([0x9E3779B97F4A7C15 * i % (1 << 64) for i in range(WIDE)], np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct XXH64 of the word shingles of a text; none without words."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    grams = zip(*(w[i:] for i in range(words)), strict=False) if len(w) >= words else [w] if w else []
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64))


def wide_fingerprint(text: str, words: int) -> np.ndarray:
    """64 * WIDE majority bits over the distinct shingles."""
    h, ones = shingles(text, words), np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), 255):  # sums of single bytes
        x = h[i : i + 255, None] + _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def bit_limits(similarity: float) -> tuple[int, int]:
    """Differing bits of two wide fingerprints up to which a pair is surely at the similarity
    (2.8 deviations below what is expected there), and up to which it may be (1.8 above)."""
    bits, p = 64 * WIDE, math.acos(2 * similarity / (1 + similarity)) / math.pi
    deviation = math.sqrt(p * (1 - p) / bits)
    return int((p - 2.8 * deviation) * bits), int((p + 1.8 * deviation) * bits)


def _wide(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([wide_fingerprint(t.as_py(), words) for t in b.column(2)], np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(fp[:, i])) for i in range(WIDE))], ["doc_id", "text_key", *(f"w{i}" for i in range(WIDE))])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_key"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, " + ", ".join(f"w{i} long" for i in range(WIDE)))


def check_limits(similarity: float) -> tuple[int, int]:
    """Differing bits of the CHECK columns up to which rows of one code are taken for one (what
    is expected halfway between the similarity and 1), and up to which rows may be linked:
    four deviations above what is expected at the similarity. Of chance meetings, which
    differ in half the bits, one in a million passes at 0.8."""
    bits, apart = 64 * len(CHECK), lambda x: math.acos(2 * x / (1 + x)) / math.pi
    p = apart(similarity)
    return int(bits * apart((1 + similarity) / 2)), int(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def _leaders(rows: DataFrame, similarity: float, bucket_rows: int, whole: bool) -> DataFrame:
    """rows (table, code, fp, CHECK, REACH) with `to`: the fp of a row of the same code that is
    nearly the same, and goes on for this one; null for rows that go on. Beyond bucket_rows
    rows that go on in one code, all that may be linked to one of them are taken for it.
    whole: rows are sorted by table and code; otherwise groups are those inside a batch."""
    close, linked = check_limits(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _whole_groups(batches, 2) if whole else ([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows)
        for columns in groups:
            if not whole:
                order = np.lexsort(columns[2::-1])
                columns = [c[order] for c in columns]
            fp, check, reach = columns[2], np.stack(columns[3:5], 1).view(np.uint64), columns[5].copy()
            first = _starts(*columns[:2])
            last = np.append(first[1:], len(fp))
            to, has = fp.copy(), np.zeros(len(fp), bool)
            for s, e in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
                stays = np.array([s])
                for i in range(s + 1, e):
                    apart = np.bitwise_count(check[stays] ^ check[i]).sum(1, dtype=np.int64)
                    k = int(apart.argmin())
                    if apart[k] <= (close if len(stays) < bucket_rows else linked):
                        to[i], has[i] = fp[stays[k]], True
                        reach[stays[k]] = max(reach[stays[k]], apart[k] + reach[i])
                    else:
                        stays = np.append(stays, i)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:5]), pa.array(reach), pa.array(to, mask=~has)], names)

    names = ["table", "code", "fp", *CHECK, REACH, "to"]
    return rows.select(names[:-1]).mapInArrow(run, "table int, code long, fp long, " + ", ".join(f"{c} long" for c in CHECK) + ", reach int, to long")


def _led(distinct: DataFrame, bucket_rows: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The codes that go on (table, code, fp, CHECK, REACH), and (table, fp, to) of the others.
    The next words of a fingerprint are a code's check. Of rows that have one code and nearly
    one fingerprint the first goes on: of those at hand where codes are made, then of all, so
    that a large family is few rows when it is shuffled."""
    top = lambda c: F.shiftleft(F.shiftrightunsigned(c, 64 - CODE_BITS), 64 - CODE_BITS)
    checks = lambda i: [F.col(f"w{(i + 1 + k) % WIDE}").alias(c) for k, c in enumerate(CHECK)]
    halves = [F.struct(F.lit(2 * i + k).alias("table"), top(F.col(f"w{i}") if k else F.shiftleft(f"w{i}", 32)).alias("code"), *checks(i)) for i in range(WIDE) for k in range(2)]
    codes = distinct.select("fp", F.inline(F.array(*halves))).select("table", "code", "fp", *CHECK, F.lit(0).alias(REACH))
    here = saved(_leaders(codes, similarity, bucket_rows, whole=False), "codes-here")
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = here.where("to IS NULL").repartition(parts, "table", "code").sortWithinPartitions("table", "code", "fp")
    first = saved(_leaders(dealt, similarity, bucket_rows, whole=True), "codes")
    return first.where("to IS NULL").drop("to"), here.unionByName(first).where("to IS NOT NULL").select("table", "fp", "to")


def _differing(pairs: DataFrame, distinct: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b, differ) whose wide fingerprints differ in at most `most` bits."""
    side = lambda x: distinct.select(F.col("fp").alias(x), *[F.col(f"w{i}").alias(f"{x}{i}") for i in range(WIDE)])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(WIDE)), F.lit(0))
    return both.select("a", "b", differ.alias("differ")).where(F.col("differ") <= most)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _missed(first: DataFrame, stars: DataFrame, tried: DataFrame, roots: DataFrame, bucket_rows: int, limit: int) -> DataFrame:
    """(a, b): the candidates that were not tried and whose ends are in different classes, from
    the codes that go on and those that don't (_led), the pairs tried and their classes
    (node, root). A row with any candidate is in a tree or a star of those tried. Rows that
    go on are searched again, to their limit and the reach of both; only pairs that are found
    and may join two classes are replaced by the rows that they go on for."""
    classes = tried.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    classes = saved(classes.select("fp", F.coalesce("root", "fp").alias("class")), "tried-classes")
    # A leader where codes were made may be led by another one.
    up = stars.select("table", F.col("fp").alias("to"), F.col("to").alias("over"))
    behind = stars.join(up, ["table", "to"], "left").select("fp", F.coalesce("over", "to").alias("lead")).distinct()
    behind = behind.unionByName(classes.select("fp", F.col("fp").alias("lead")))
    behind = saved(behind.join(sized(classes, F.lit(16)), "fp").select("lead", "fp", "class"), "behind")
    leads = behind.groupBy("lead").agg(F.min("class").alias("class"), (F.min("class") < F.max("class")).cast("int").alias("mixed"))
    leads = saved(leads.withColumnRenamed("lead", "fp"), "leads")
    again = saved(first.join(sized(leads, F.lit(20)), "fp").select("table", "code", "fp", *CHECK, REACH, *CLASS), "codes-again")
    found = near_codes(again, CODE_BITS, CODE_NEAR, 1, bucket_rows, limit)
    inside = leads.where("mixed = 1").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    pairs = saved(_ordered(found.unionByName(inside)), "leads-found")
    side = lambda x: behind.toDF(f"{x}_lead", x, f"{x}_class")
    every = pairs.toDF("a_lead", "b_lead").join(side("a"), "a_lead").join(side("b"), "b_lead").where("a_class <> b_class")
    return _ordered(every.select("a", "b")).join(tried, ["a", "b"], "left_anti")


def _verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose texts' shingles have a Jaccard similarity of at least `similarity`."""
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(distinct, "fp").select("fp", F.col("least").alias("_d"), F.col("text_key").alias("_x")), "wanted")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("t"))
    same = (F.xxhash64("t") == F.col("_x")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    texts = saved(rows.join(sized(wanted, F.lit(40)), same).select("fp", "t").dropDuplicates(["fp"]), "wanted-texts")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches, 200):
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = shingles(x.as_py(), words), shingles(y.as_py(), words)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket_rows: int = 4096) -> DataFrame:
    """One row per document: doc_id, text_key, component_id (the least doc_id reachable), kept.

    Links join texts whose sets of word shingles have a Jaccard similarity of at least
    `similarity`. Wide fingerprints say which pairs may be (bit_limits): codes of them that
    differ in few bits are found by the Gray-order index, and pairs that aren't surely as
    similar are verified by their texts (of pairs just below 0.8, one in 400 counts as sure;
    at 0.77, one in 20,000). A pair at 0.8 is found with a chance of some 0.92, at 0.85 of
    some 0.99; in a group of copies any chain of pairs is enough. Texts without words
    are one class, as are equal texts; a null text is empty. A null doc_id is kept only in a
    class of such. Other columns of docs are not used.
    """
    fp = saved(_wide(docs, words), "wide")
    w = [f"w{i}" for i in range(WIDE)]
    of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    distinct = saved(fp.groupBy(*w).agg(of.alias("_of")).select(F.xxhash64(*w).alias("fp"), *w, F.col("_of")["doc_id"].alias("least"), F.col("_of")["text_key"].alias("text_key")), "wide-distinct")
    surely, maybe = bit_limits(similarity)

    def links(pairs: DataFrame) -> DataFrame:
        pairs = saved(_differing(pairs, distinct, maybe), "pairs")
        sure = pairs.where(F.col("differ") <= surely).select("a", "b")
        return saved(sure.unionByName(_verified(pairs.where(F.col("differ") > surely).select("a", "b"), distinct, docs, words, similarity)), "edges")

    first, stars = _led(distinct, bucket_rows, similarity)
    limit = check_limits(similarity)[1]
    near = near_codes(first, CODE_BITS, CODE_NEAR, 1, bucket_rows, limit)
    tried = saved(_ordered(near.unionByName(stars.select(F.col("fp").alias("a"), F.col("to").alias("b")))), "tried")
    edges = links(tried)
    more = links(_missed(first, stars, tried, components(edges), bucket_rows, limit))
    classes = _least_of(distinct.select("fp", "least"), edges.unionByName(more))
    return fp.select("doc_id", "text_key", F.xxhash64(*w).alias("fp")).join(classes, "fp").select(
        "doc_id", "text_key", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket_rows: int = 4096) -> DataFrame:
    """The documents with the least doc_id of their class of near_copies; the columns stay. Rows
    that repeat an id and a text are one document and stay or go together."""
    gone = saved(near_copies(docs, words, similarity, bucket_rows).where("NOT kept").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_x")).distinct(), "gone")
    same = (F.xxhash64(text_of(docs)) == gone["_x"]) & docs["doc_id"].eqNullSafe(gone["_d"])
    return docs.join(sized(gone, F.lit(25)), same, "left_anti")
