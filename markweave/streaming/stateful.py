"""Representatives and watchlist counts of a stream of mark rows, as changes only.

The state holds what choosing a representative needs of each mark's rows: their ids, whether
they have a certificate and a grant, and their versions. Marks are dealt to buckets, whose rows
are one packed value of the state and are worked on as columns: a call for each mark would
cost a thousand times its few rows. A micro-batch puts out what it changed of the marks that it
has rows of: flags that turn, and how watchlist counts move.
A row that comes again or late, behind a newer version of its id, changes nothing. Added up,
the changes are what a batch over the last versions gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from markweave.operators.filters import FilterSpec, predicates
from markweave.operators.linkage import dedup_key

#: A change: flag rows have id and value, watch rows the list's name, a day and a delta. seq
#: orders the changes of a mark.
CHANGE = "key string, seq long, kind string, id string, value boolean, name string, day date, delta long"
HELD = pa.schema([("key", pa.string()), ("id", pa.string()), ("version", pa.int64()), ("alive", pa.bool_()), ("certificate", pa.bool_()), ("granted", pa.bool_()), ("lists", pa.string()), ("day", pa.int32())])
#: rows: those of HELD as a compressed Arrow stream.
STATE = "seq long, rows binary"
#: Buckets that marks are dealt to; one stream keeps its number. A bucket is rewritten when a
#: row of it comes, and should have some thousands of marks.
BUCKETS = 1024


def mark_events(marks: DataFrame, watchlists: dict[str, FilterSpec], version: Column, alive: Column | None = None) -> DataFrame:
    """Rows of marks as events: key, id, version, alive (false takes the row out), certificate,
    granted, lists (the watchlists that the row is on, by name) and day of publication."""

    def all_of(spec: FilterSpec) -> Column:
        out = F.lit(True)
        for p in predicates(spec).values():
            out = out & F.coalesce(p, F.lit(False))
        return out

    on = [F.when(all_of(spec), F.lit(name)) for name, spec in watchlists.items()]
    return marks.select(
        dedup_key().alias("key"),
        "id",
        version.cast("long").alias("version"),
        (F.lit(True) if alive is None else alive).alias("alive"),
        F.col("certificate_number").isNotNull().alias("certificate"),
        F.col("vn_grant_date").isNotNull().alias("granted"),
        (F.array_join(F.array_sort(F.array_compact(F.array(*on))), "\n") if on else F.lit("")).alias("lists"),
        F.unix_date("publication_date").alias("day"),
    )


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _best(rows: pd.DataFrame) -> pd.Series:
    """The id of each mark's representative, by key."""
    alive = rows[rows["alive"]].sort_values(["key", "certificate", "granted", "id"])
    return alive.drop_duplicates("key", keep="last").set_index("key")["id"]


def _moves(rows: pd.DataFrame, by: int) -> pd.DataFrame:
    on = rows.loc[rows["alive"] & (rows["lists"] != ""), ["key", "lists", "day"]]
    return on.assign(name=on["lists"].str.split("\n"), delta=by).explode("name")[["key", "name", "day", "delta"]]


def _changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, held = 0, HELD.empty_table()
    if state.exists:
        seq, packed = state.get
        held = pa.ipc.open_stream(packed).read_all()
    new = pa.concat_tables(pa.Table.from_pandas(b[HELD.names], HELD, preserve_index=False) for b in batches)
    touched = pc.is_in(held["key"], value_set=pc.unique(new["key"]))
    frame = lambda t: t.to_pandas(types_mapper={pa.int32(): pd.Int32Dtype()}.get)
    old = frame(held.filter(touched))
    # Of one version the row that came first counts: sorting is stable.
    last = pd.concat([old, frame(new)]).sort_values(["key", "id", "version"], ascending=[True, True, False], kind="stable").drop_duplicates(["key", "id"])
    rest = held.filter(pc.invert(touched))
    state.update((seq + 1, _packed(pa.concat_tables([rest, pa.Table.from_pandas(last, HELD, preserve_index=False)]))))
    best = pd.concat([_best(old).rename("old"), _best(last).rename("new")], axis=1).astype(object)
    best = best[best["old"].where(best["old"].notna(), "") != best["new"].where(best["new"].notna(), "")]
    flags = [best[c].dropna().rename("id").rename_axis("key").reset_index().assign(kind="flag", value=v) for c, v in (("old", False), ("new", True))]
    moved = pd.concat([_moves(old, -1), _moves(last, 1)]).groupby(["key", "name", "day"], dropna=False, as_index=False)["delta"].sum()
    moved = moved[moved["delta"] != 0].assign(kind="watch")
    out = pa.concat_tables([pa.Table.from_pandas(x.assign(seq=seq + 1), preserve_index=False) for x in (*flags, moved) if len(x)], promote_options="default") if len(best) or len(moved) else None
    if out is not None:
        found = {n: out[n] if n in out.column_names else pa.nulls(out.num_rows) for n in (c.split()[0] for c in CHANGE.split(", "))}
        yield pa.table(found | {"day": found["day"].cast(pa.int32()).cast(pa.date32())}).to_pandas(date_as_object=True)


def mark_changes(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The CHANGE rows of a stream of mark_events(). The state is a few numbers for each row
    of a mark; a row that went leaves its version, so that a late one doesn't bring it back."""
    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(_changes, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def representatives_of(changes: DataFrame) -> DataFrame:
    """(id) of the rows whose last flag is up."""
    flags = changes.where("kind = 'flag'").groupBy("id").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
    return flags.where("value").select("id")


def watch_counts_of(changes: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """A22, ST11: (name, total, new) as the changes add up."""
    fresh = F.coalesce(F.col("day") >= F.date_sub(today, days), F.lit(False))
    watch = changes.where("kind = 'watch'").groupBy("name")
    return watch.agg(F.sum("delta").alias("total"), F.sum(F.when(fresh, F.col("delta")).otherwise(0)).alias("new"))
