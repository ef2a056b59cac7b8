"""The trie of conversation prefixes, with counts of its nodes and sums over its subtrees.

A turn is hashed once, where it is read, and only its digest is shuffled. Sorted by
conversation and turn, digests stream through tasks that chain them: the digest of d turns is
SHA-256 of the digest of d - 1 turns and of turn d, so equal prefixes have equal digests
whatever conversation holds them, and a task holds one conversation's state, however long
it is. Every prefix is a row; a group of rows by (depth, digest) is a node.

A node goes to all its ancestors, which are the prefixes of its smallest member. The nodes
of one smallest member are a tail of its own path (what holds it deeper down holds no
smaller one either), so their values are added up along the path before they are sent: a
prefix gets one row from a conversation, not one from each node below, and a conversation of
n turns makes n rows, not n * n / 2.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markweave.llm.common import WS, saved

#: Bytes kept of a SHA-256: two of 2^40 prefixes meet with a chance of 2^-49.
DIGEST = 16
ROOT = hashlib.sha256(b"").digest()[:DIGEST]
#: Ids of members that a row of the second step of their digest holds.
CHUNK = 256


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id long, turn, _role, _digest, _words) of every turn with a conv_id."""
    role, text = F.coalesce(conversations["role"], F.lit("")), F.coalesce(conversations["text"], F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].alias("turn"),
        role.alias("_role"),
        F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, DIGEST).alias("_digest"),
        F.regexp_count(text, F.lit(rf"[^{WS}]+")).cast("long").alias("_words"),
    )


def prefixes(conversations: DataFrame, family: int = 0, most: int = 4) -> DataFrame:
    """(conv_id, depth, digest, words, last): a row for each prefix of each conversation, from
    depth 0; words of its last turn; last where the conversation ends.

    family: conversation c begins with the first h turns of c - c % family in place of its
    own first h, where h is crc32 of its decimal id modulo `most`; 0 leaves conversations as
    they are. Turns come by number (null first), then role, then digest, so ties have a
    fixed order; a turn that repeats is there as often.
    """
    turns = turn_digests(conversations)
    base = F.col("conv_id") - F.col("conv_id") % family if family else F.col("conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [], [], [])
        at = own = taken = skip = None
        first: list[tuple[bytes, int]] = []  # the turns that others of the family may take
        depth = words = 0
        digest = ROOT

        def emit(last: bool) -> None:
            for column, x in zip(out, (own, depth, digest, words, last), strict=True):
                column.append(x)

        def step(turn: bytes, n: int) -> None:
            nonlocal depth, words, digest
            emit(False)
            depth, words, digest = depth + 1, n, hashlib.sha256(digest + turn).digest()[:DIGEST]

        def ready() -> pa.RecordBatch:
            nonlocal out
            done, out = out, ([], [], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(done, kinds, strict=True)], ["conv_id", "depth", "digest", "words", "last"])

        for b in batches:
            for of, conv, turn, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if conv != own or of != at:
                    if own is not None:
                        emit(True)
                    if of != at:
                        at, first = of, []
                    own, depth, words, digest, taken = conv, 0, 0, ROOT, 0
                    skip = crc32(str(conv).encode()) % most if family and conv != of else 0
                    for x in first[:skip]:
                        step(*x)
                taken += 1
                if conv == of and family and len(first) < most:
                    first.append((turn, n))
                if taken > skip:
                    step(turn, n)
            if len(out[0]) >= 4096:
                yield ready()
        if own is not None:
            emit(True)
        yield ready()

    # The base of a family comes before the others, so that its turns are at hand.
    rows = turns.withColumn("_base", base).repartition("_base")
    rows = rows.sortWithinPartitions("_base", F.col("conv_id") != F.col("_base"), "conv_id", F.asc_nulls_first("turn"), "_role", "_digest")
    return rows.select("_base", "conv_id", "_digest", "_words").mapInArrow(run, "conv_id long, depth long, digest binary, words long, last boolean")


def member_digests(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256): SHA-256 of the decimal conv_ids of each digest, ascending, joined
    by commas. Ids of a digest are joined by many tasks, each for a range of them; the last
    step reads the joined parts in order and keeps only the hash's state."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for b in batches:
            done: list[tuple[bytes, int, bytes]] = []
            for digest, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (digest != key or len(ids) >= CHUNK):
                    done.append((key, ids[0], ",".join(map(str, ids)).encode()))
                    ids = []
                key = digest
                ids.append(conv)
            yield rows(done)
        yield rows([(key, ids[0], ",".join(map(str, ids)).encode())] if ids else [])

    def rows(done: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        kinds = (("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for digest, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if digest == key:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = digest, hashlib.sha256()
                state.update(ids.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["digest", "ends_sha256"])
        last = [] if state is None else [(key, state.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in last], pa.binary()), pa.array([x[1] for x in last], pa.string())], ["digest", "ends_sha256"])

    by = ["digest", "conv_id"]
    parts = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(joined, "digest binary, first long, ids binary")
    return parts.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 0, most: int = 4) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens (long), ends_sha256, digest (hex).

    saved_tokens: over the node's subtree, its top included, (n_convs - 1) times the words of
    the node's last text, which is what one pass over a shared prefix saves. A null role or
    text is empty. Rows without a conv_id belong to no conversation and are left out; an
    empty table has no nodes. Other columns are not used, whatever their names. family and
    most: see prefixes().
    """
    rows = saved(prefixes(conversations, family, most), "prefixes")
    nodes = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("words").alias("words"), F.count_if("last").alias("n_ends"))
    zero = F.lit(0).cast("long")
    paths = rows.select("conv_id", "depth", "digest", F.lit(None).cast("long").alias("n"), zero.alias("value"), zero.alias("leaf"))
    owned = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), "n", ((F.col("n") - 1) * F.col("words")).alias("value"), (F.col("n") == F.col("n_ends")).cast("long").alias("leaf"))
    # Along a path from its end: rows of one depth are the prefix and the node that it owns.
    path = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    below, here, child, parent = (path.rangeBetween(*x) for x in ((Window.unboundedPreceding, 0), (0, 0), (-1, -1), (1, 1)))
    sent = (
        paths.unionByName(owned)
        .select(
            "conv_id",
            "depth",
            "digest",
            F.max("n").over(here).alias("n"),
            F.sum("value").over(below).alias("value"),
            F.sum("leaf").over(below).alias("leaf"),
            F.count("n").over(child).alias("child"),
            F.max("digest").over(parent).alias("parent"),
            (F.count("n").over(parent) > 0).alias("own_parent"),
        )
        .where("digest IS NOT NULL AND (n IS NOT NULL OR value > 0 OR leaf > 0 OR child > 0)")
    )
    own = lambda c: F.max(F.when(F.col("n").isNotNull(), F.col(c)))
    sums = sent.groupBy("depth", "digest").agg(
        own("conv_id").alias("conv_id"), F.max("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("value").alias("saved_tokens"), own("parent").alias("parent"), own("own_parent").alias("own_parent")
    )
    sums = saved(sums, "trie-nodes")
    # Most parents belong to the same conversation; only the first node of a tail looks its up.
    heads = sums.where("NOT own_parent AND depth > 0")
    above = sums.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = sums.where("own_parent OR depth = 0").withColumn("parent_conv_id", F.when(F.col("own_parent"), F.col("conv_id")))
    placed = known.unionByName(heads.join(above, ["depth", "parent"]).select(known.columns))
    ends = member_digests(rows.where("last"))
    none = hashlib.sha256(b"").hexdigest()
    return placed.join(ends, "digest", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest")
    )
