"""Reversible line dedup: sharded cuckoo filters over an exact reference table.

The reference table has a row for each line key and document that holds it, and a tally
(rows, least document) for each key, so that a line that all documents hold is counted
before it is shuffled. Keys are spread over shards; a shard's cuckoo filters hold a 16-bit mark of each of its live keys.
A batch brings its keys, counted, to the shards: a key that the filter doesn't know and
that the batch has in one document needs no lookup, every other one is a candidate, whose
exact count and least document come from the tallies. Deleting documents takes
their rows out of the table and marks of keys without rows out of the filters, so an
insertion followed by its deletion leaves the decisions as they were.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.llm.common import saved, text_of
from markweave.storage import Generations

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
MIN_CHARS, SHARD_KEYS, SLOTS = 10, 250_000, 4
#: A null doc_id stands before all others.
NO_ID = -(1 << 63)
STATE = "shard int, part int, bits int, marks binary"
TABLES = {"refs": "shard int, key binary, doc_id long", "tallies": "shard int, key binary, n long, first long", "filters": STATE, "candidates": "key binary"}


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """128 bits of the stripped, lower-cased line; None for one under min_chars."""
    key = line.strip(WHITE).translate(LOWER)
    return hashlib.md5(key.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() if len(key) >= min_chars else None


def _tallied(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


class CuckooFilter:
    """Buckets of four 16-bit marks; a key's second bucket follows from its first and its
    mark, so marks can move and be deleted without the key. All steps are vectorised."""

    def __init__(self, bits: int, marks: bytes | None = None):
        self.bits, self.mask = bits, np.int64((1 << bits) - 1)
        self.table = np.zeros((1 << bits, SLOTS), np.uint16) if marks is None else np.frombuffer(marks, np.uint16).reshape(-1, SLOTS).copy()

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(max(4, int(np.ceil(np.log2(max(1, n) / (SLOTS * 0.8))))))

    def room(self) -> int:
        return int(self.table.size * 0.85) - int(np.count_nonzero(self.table))

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = np.maximum(keys & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        return (keys >> np.uint64(16)).astype(np.int64) & self.mask, mark

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        b, mark = self._place(keys)
        return (self.table[b] == mark[:, None]).any(1) | (self.table[self._other(b, mark)] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Adds distinct keys; the marks that found no place are given back as a mask of the
        input, and only happen above the load that room() allows for."""
        if not len(keys):
            return np.zeros(0, bool)
        rng = np.random.default_rng(len(keys))
        bucket, mark = self._place(keys)
        before = self.table.copy()
        for _ in range(1000):
            for turn in range(2):
                free = self.table[bucket] == 0
                able = np.flatnonzero(free.any(1))
                _, first = np.unique(bucket[able], return_index=True)  # one for each bucket
                win = able[first]
                self.table[bucket[win], free[win].argmax(1)] = mark[win]
                bucket, mark = np.delete(bucket, win), np.delete(mark, win)
                if not len(bucket):
                    return np.zeros(len(keys), bool)
                bucket = self._other(bucket, mark)
                if turn == 0 and len(win):
                    continue
            _, win = np.unique(bucket, return_index=True)
            full = win[(self.table[bucket[win]] != 0).all(1)]
            slot = rng.integers(0, SLOTS, len(full))
            out = self.table[bucket[full], slot]
            self.table[bucket[full], slot] = mark[full]
            mark[full] = out
            bucket[full] = self._other(bucket[full], out)
        self.table = before
        return np.ones(len(keys), bool)

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Takes out one mark of each distinct key; true where there was one."""
        done = np.zeros(len(keys), bool)
        b, mark = self._place(keys)
        todo = np.arange(len(keys))
        for bucket in (b, self._other(b, mark)):
            left = todo[~done]
            while len(left):
                same = self.table[bucket[left]] == mark[left, None]
                able = left[same.any(1)]
                if not len(able):
                    break
                _, first = np.unique(bucket[able], return_index=True)
                win = able[first]
                self.table[bucket[win], (self.table[bucket[win]] == mark[win, None]).argmax(1)] = 0
                done[win] = True
                left = left[~done[left]]
        return done


def _longs(keys: pa.ChunkedArray) -> np.ndarray:
    """The first 8 bytes of each 16-byte key."""
    flat = b"".join(keys.to_pylist())
    return np.frombuffer(flat, np.uint64)[::2]


def _filters(state: pa.Table) -> list[CuckooFilter]:
    rows = sorted(state.to_pylist(), key=lambda r: r["part"])
    return [CuckooFilter(r["bits"], r["marks"]) for r in rows]


def _state_rows(shard: int, filters: list[CuckooFilter]) -> dict[str, list]:
    n = len(filters)
    return {"shard": [shard] * n, "part": list(range(n)), "bits": [f.bits for f in filters], "marks": [f.table.tobytes() for f in filters], "key": [None] * n}


OUT = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("bits", pa.int32()), ("marks", pa.binary()), ("key", pa.binary())])


def _add(filters: list[CuckooFilter], new: np.ndarray) -> None:
    """Puts keys into the last filter, or into one more where it has no room."""
    last = filters[-1] if filters and filters[-1].room() >= len(new) else None
    if len(new) and (last is None or last.insert(new).any()):
        filters.append(CuckooFilter.for_keys(len(new)))
        while filters[-1].insert(new).any():
            filters[-1] = CuckooFilter(filters[-1].bits + 1)


def _insert(key: tuple, batch: pa.Table, state: pa.Table) -> pa.Table:
    filters, shard = _filters(state), key[0].as_py()
    longs = _longs(batch["key"]) if batch.num_rows else np.zeros(0, np.uint64)
    known = np.zeros(len(longs), bool)
    for f in filters:
        known |= f.contains(longs)
    _add(filters, longs[~known])
    hit = np.flatnonzero(known | (batch["n"].to_numpy() > 1)) if batch.num_rows else []
    rows = _state_rows(shard, filters)
    found = batch["key"].take(pa.array(hit)).to_pylist() if len(hit) else []
    none = [None] * len(found)
    more = {"shard": [shard] * len(found), "part": none, "bits": none, "marks": none, "key": found}
    return pa.table({c: rows[c] + more[c] for c in OUT.names}, OUT)


def _delete(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
    """rows: keys, gone or not. A key that a filter took for another one has no mark of its
    own, so its deletion takes the other's, which then comes back."""
    filters, gone = _filters(state), rows["gone"].to_numpy() if rows.num_rows else np.zeros(0, bool)
    keys = _longs(rows["key"]) if rows.num_rows else np.zeros(0, np.uint64)
    todo, stay = keys[gone], keys[~gone]
    for f in filters:
        todo = todo[~f.delete(todo)]
    for f in filters:
        stay = stay[~f.contains(stay)]
    _add(filters, stay)
    return pa.table(_state_rows(key[0].as_py(), filters), OUT)


class LineIndex:
    """The state: refs (shard, key, doc_id), tallies (shard, key, n, first) of each batch of
    them, filters, and candidates (key) that may be in two documents or more. A new index has
    about one shard for SHARD_KEYS keys, so that a shard fits a task; compact() adds shards as
    keys grow. save() keeps an index in a folder, from which open() begins another session."""

    def __init__(self, spark: SparkSession, shards: int, min_chars: int = MIN_CHARS):
        self.spark, self.shards, self.min_chars = spark, shards, min_chars
        self.refs, self.tallies, self.filters, self.candidates = (spark.createDataFrame([], kind) for kind in TABLES.values())

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The index as it was last saved to path; ValueError if none was."""
        tables = Generations(spark, path)
        live = tables.live()
        if not live:
            raise ValueError(f"no line index in {path}")
        index = cls(spark, live[-1]["shards"], live[-1]["min_chars"])
        for name, kind in TABLES.items():
            setattr(index, name, tables.read(name, kind + ", gen string").drop("gen"))
        return index

    def save(self, path: str) -> None:
        """Write the index, compact, to path. It counts from one rename on: a writer that dies
        before leaves what was saved earlier, and of two writers one fails. The index goes on
        from the saved tables."""
        tables = Generations(self.spark, path)
        gen, before = tables.begin(), [e["gen"] for e in tables.live()]
        for name, df in self._compact().items():
            tables.write(gen, name, df)
        tables.publish(gen, before, shards=self.shards, min_chars=self.min_chars)
        for name, kind in TABLES.items():
            setattr(self, name, self.spark.read.schema(kind).parquet(f"{tables.root}/{name}/gen={gen}"))

    def _compact(self) -> dict[str, DataFrame]:
        """One tally a key, each candidate once."""
        tallies = self.tallies.groupBy("shard", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        return {"refs": self.refs, "tallies": tallies, "filters": self.filters, "candidates": self.candidates.distinct()}

    def compact(self, shard_keys: int = SHARD_KEYS) -> None:
        """What many insertions have left, in one table each; and more shards, with filters of
        their own, if there are more than shard_keys keys to one."""
        tables = {name: saved(df, name) for name, df in self._compact().items()}
        shards = -(-tables["tallies"].count() // shard_keys)
        if shards > self.shards:
            self.__init__(self.spark, shards, self.min_chars)
            self.insert_refs(tables["refs"].select("key", "doc_id"))
        else:
            for name, df in tables.items():
                setattr(self, name, df)

    def insert(self, docs: DataFrame) -> None:
        """Adds documents. One whose id the index holds lines of stays as it is there: to
        replace it, delete it first."""
        held = self.refs.select("doc_id").distinct()
        self.insert_refs(line_refs(docs, self.min_chars).join(held, "doc_id", "left_anti"))

    def insert_refs(self, refs: DataFrame) -> None:
        """refs: distinct (key, doc_id)."""
        refs = saved(refs.select(F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard"), "key", "doc_id"), "refs")
        keys = saved(_tallied(refs), "tallies")
        out = keys.select("shard", "key", "n").groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_insert, STATE + ", key binary")
        out = saved(out, "filters")
        self.filters = out.where("key IS NULL").drop("key")
        self.candidates = self.candidates.unionByName(out.where("key IS NOT NULL").select("key"))
        self.refs, self.tallies = self.refs.unionByName(refs), self.tallies.unionByName(keys)

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes documents (doc_id; null is NO_ID here) out again. Ids that the index doesn't
        hold change nothing."""
        ids = doc_ids.select("doc_id").distinct()
        left = saved(self.refs.join(ids, "doc_id", "left_anti").select("shard", "key", "doc_id"), "refs")
        # One row a key: gone unless a document that stays holds it.
        held = left.select("shard", "key", F.lit(False).alias("gone")).unionByName(self.refs.join(ids, "doc_id", "left_semi").select("shard", "key", F.lit(True).alias("gone")))
        keys = held.groupBy("shard", "key").agg(F.min("gone").alias("gone"))
        out = keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_delete, STATE + ", key binary")
        self.refs, self.filters, self.tallies = left, saved(out, "filters").drop("key"), saved(_tallied(left), "tallies")

    def shared(self) -> DataFrame:
        """(key, n_docs, first_doc) of each key in two documents or more: the exact counts of
        the candidates."""
        looked = self.tallies.join(self.candidates.distinct(), "key", "left_semi")  # a row a key and batch
        return looked.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first_doc")).where("n_docs > 1")

    def doomed(self) -> DataFrame:
        """(doc_id, keys): what each document loses, one list a document."""
        shared = saved(self.shared(), "shared").withColumnRenamed("key", "k")
        # One row a key on the right, and nothing else in the join's stage: a hot key's refs are split.
        lost = self.refs.join(shared, F.col("key") == F.col("k")).where(F.col("doc_id") != F.col("first_doc"))
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs with doomed lines taken out of their texts, plus n_lines and n_dropped."""
        lost = saved(self.doomed().toDF("__lost_from", "__lost_keys"), "doomed")
        rows = docs.withColumn("text", text_of(docs)).drop("n_lines", "n_dropped")
        # Lists grow with the corpus, so this is a shuffle of the texts at every size.
        joined = rows.join(lost.hint("merge"), F.coalesce(rows["doc_id"].cast("long"), F.lit(NO_ID)) == lost["__lost_from"], "left").drop("__lost_from")
        fields = [f for f in rows.schema.fields]
        at, least = rows.columns.index("text"), self.min_chars
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_lines long, n_dropped long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text, n_lines, n_dropped = [], [], []
                for t, keys in zip(b.column(at).to_pylist(), b.column(len(fields)).to_pylist(), strict=True):
                    lines, out = t.split("\n"), set(keys or ())
                    kept = [x for x in lines if line_key(x, least) not in out] if out else lines
                    text.append("\n".join(kept) if out else t)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                columns = b.columns[: len(fields)]
                columns[at] = pa.array(text, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*(f.name for f in fields), "n_lines", "n_dropped"])

        return joined.mapInArrow(run, schema)


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (key, doc_id) of all lines of min_chars and more; a null id as NO_ID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at = [], []
            for i, t in enumerate(b.column(1)):
                found = {line_key(x, min_chars) for x in t.as_py().split("\n")} - {None}
                keys += found
                at += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column(0).take(pa.array(at, pa.int64()))], ["key", "doc_id"])

    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, "key binary, doc_id long").distinct()


def dedup_lines(docs: DataFrame, batches: int = 2, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """All rows of docs, in which a line of min_chars and more that two documents hold stays
    in the one with the least doc_id only; plus n_lines (before) and n_dropped.

    The index is filled in batches by id, as it would be over time. A null or empty text
    is one empty line. Rows with one doc_id are one document, which comes before all others
    where the id is null. Columns n_lines and n_dropped
    of docs are replaced; all others come along.
    """
    refs = saved(line_refs(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "line-refs", "batch")
    index = LineIndex(docs.sparkSession, max(8, -(-refs.count() // shard_keys)), min_chars)
    for i in range(batches):
        index.insert_refs(refs.where(F.col("batch") == i).select("key", "doc_id"))
    return index.apply(docs)


def digest(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = dedup_lines(docs.select("doc_id", "text"), **params)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))
