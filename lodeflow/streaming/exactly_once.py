"""Messages delivered more than once: exactly one copy of each, as a stream.

A keyed state store holds the identifiers seen. Keys are shards of the
identifiers' hash space, so that one state value holds many identifiers as
arrays and a batch is matched against it in bulk. An identifier leaves the
state when the event-time watermark has passed its time by another delay; what
stays of it is a place in a Bloom filter, with the period of its event time.
A row that is in the state is a copy; one in neither state nor filters is new;
one that only a filter knows arrives late or is a chance hit and is looked up
among the copies accepted earlier, of the periods its filters name and no
others. What a batch reads of the history thus depends on how far its late
copies reach back, not on the history's length.

State and output are committed together: both belong to a micro-batch's number,
a batch that is run again overwrites its own output folder and starts from the
state before it. Copies of one identifier are combined within each Arrow batch
before the shuffle, so one message that makes up a third of all rows reaches
its shard as few rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ACCEPTED, LOOK_UP, COPY = 0, 1, 2
#: ids: four rows (both hashes, time last seen, period); filters: BLOOM_BYTES each; spans: first and last period and number of identifiers of each filter.
_STATE = "newest bigint, ids binary, filters binary, spans binary"
#: A filter has 16 bits for each of its identifiers: about one chance hit in a thousand.
BLOOM_BITS, BLOOM_IDS, BLOOM_HASHES = 1 << 17, 1 << 13, 6
BLOOM_BYTES = BLOOM_BITS // 8
_NEVER = -(2**62)
_FIXED = ["_key", "_h1", "_h2", "_t", "_copies"]


@dataclass(frozen=True)
class Deduplicated:
    """The output folders of one run, as frames. rows: one per identifier; repeated: identifiers with more than one copy."""

    spark: SparkSession
    folder: str
    row_schema: StructType

    def _events(self) -> DataFrame:
        kinds = StructType([*self.row_schema.fields, *[StructField(n, t, True) for n, t in _types("_kind int, _from bigint, _to bigint, batch int, _period bigint")]])
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/events")

    def _known(self) -> DataFrame:
        return self.spark.read.schema("_key string, batch int").parquet(f"{self.folder}/known")

    @property
    def rows(self) -> DataFrame:
        """The accepted copies: _key and the payload."""
        e = self._events().where(F.col("_kind") != COPY)
        return e.join(self._known().withColumn("_kind", F.lit(LOOK_UP)), ["_key", "batch", "_kind"], "left_anti").drop("_kind", "_from", "_to", "_period", "batch", "_h1", "_h2", "_t", "_copies")

    @property
    def repeated(self) -> DataFrame:
        """_key of every identifier that came more than once."""
        again = self._events().where((F.col("_kind") == COPY) | (F.col("_copies") > 1)).select("_key")
        return again.unionByName(self._known().select("_key")).distinct()


def _types(ddl: str) -> list[tuple]:
    return [(f.name, f.dataType) for f in StructType.fromDDL(ddl).fields]


def _combine(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per identifier of an Arrow batch: the earliest, with the number of copies."""
    for b in batches:
        twice = b.duplicated(["_h1", "_h2"], keep=False)
        if twice.any():
            many = b[twice].sort_values(["_t", "_order"], kind="stable", na_position="last")
            n = many.groupby(["_h1", "_h2"])["_copies"].transform("sum")
            b = pd.concat([b[~twice], many.assign(_copies=n)[~many.duplicated(["_h1", "_h2"])]])
        yield b


def _places(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Bits of each identifier in a filter: one row per hash."""
    a, b = h2.astype(np.uint64), (h1.astype(np.uint64) >> np.uint64(20)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(BLOOM_BITS - 1) for i in range(BLOOM_HASHES)]).astype(np.int64)


class _Expired:
    """The filters of one shard: what left the state, and in which periods it was."""

    def __init__(self, filters: bytes = b"", spans: bytes = b"") -> None:
        self.filters = [np.frombuffer(filters, np.uint8, BLOOM_BYTES, i * BLOOM_BYTES).copy() for i in range(len(filters) // BLOOM_BYTES)]
        self.spans = [list(x) for x in np.frombuffer(spans, np.int64).reshape(-1, 3)]

    def add(self, h1: np.ndarray, h2: np.ndarray, period: np.ndarray) -> None:
        order = np.argsort(period, kind="stable")
        h1, h2, period = h1[order], h2[order], period[order]
        at = 0
        while at < len(h1):
            if not self.spans or self.spans[-1][2] >= BLOOM_IDS:
                self.filters.append(np.zeros(BLOOM_BYTES, np.uint8))
                self.spans.append([int(period[at]), int(period[at]), 0])
            span = self.spans[-1]
            part = slice(at, at + BLOOM_IDS - span[2])
            p = _places(h1[part], h2[part]).ravel()
            np.bitwise_or.at(self.filters[-1], p >> 3, (1 << (p & 7)).astype(np.uint8))
            span[0], span[1], span[2] = min(span[0], int(period[part].min())), max(span[1], int(period[part].max())), span[2] + len(h1[part])
            at += len(h1[part])

    def periods(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last period in which each identifier may have been; first above last where it was in none."""
        low, high = np.full(len(h1), 2**62), np.full(len(h1), _NEVER)
        if len(h1):
            p = _places(h1, h2)
            byte, bit = p >> 3, (1 << (p & 7)).astype(np.uint8)
            for f, (first, last, _) in zip(self.filters, self.spans, strict=True):
                hit = (f[byte] & bit).all(axis=0)
                low, high = np.where(hit, np.minimum(low, first), low), np.where(hit, np.maximum(high, last), high)
        return low, high

    def packed(self) -> tuple[bytes, bytes]:
        return b"".join(f.tobytes() for f in self.filters), np.array(self.spans, dtype=np.int64).tobytes()


def _unpack(ids: bytes) -> pd.DataFrame:
    a = np.frombuffer(ids, dtype=np.int64).reshape(4, -1)
    return pd.DataFrame({"_h1": a[0], "_h2": a[1], "_seen": a[2], "_first": a[3]})


def _match(key: tuple, batches: Iterable[pd.DataFrame], state, delay: int, columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one shard, each with its kind; puts the shard's new state."""
    newest, ids, filters, spans = state.get if state.exists else (_NEVER, b"", b"", b"")
    rows = pd.concat(list(batches), ignore_index=True)
    # A row without a time is as new as the newest one and comes after the others.
    timed = rows["_t"].notna()
    newest = max(newest, int(rows.loc[timed, "_t"].max()) if timed.any() else _NEVER)
    rows = rows.assign(_untimed=~timed, _t=rows["_t"].fillna(newest if newest > _NEVER else 0).astype("int64"))
    rows = rows.sort_values(["_untimed", "_t", "_order"], kind="stable").reset_index(drop=True)
    rows["_period"] = rows["_t"] // delay
    seen, expired = _unpack(ids), _Expired(filters, spans)
    rows = rows.merge(seen, on=["_h1", "_h2"], how="left")
    fresh = ~rows.duplicated(["_h1", "_h2"]) & rows["_seen"].isna()
    low, high = expired.periods(rows["_h1"].to_numpy(np.int64), rows["_h2"].to_numpy(np.int64))
    rows["_from"], rows["_to"] = low, high
    rows["_kind"] = np.where(fresh & (low <= high), LOOK_UP, np.where(fresh, ACCEPTED, COPY)).astype("int32")
    mine = rows.loc[:, ["_h1", "_h2", "_t", "_period"]].rename(columns={"_t": "_seen", "_period": "_first"})
    now = pd.concat([seen, mine]).groupby(["_h1", "_h2"], sort=False, as_index=False).agg(_seen=("_seen", "max"), _first=("_first", "first"))
    keep = (now["_seen"] + delay >= newest - delay).to_numpy()
    gone = now[~keep]
    expired.add(*[gone[c].to_numpy(np.int64) for c in ("_h1", "_h2", "_first")])
    state.update((newest, np.stack([now.loc[keep, c].to_numpy(np.int64) for c in ("_h1", "_h2", "_seen", "_first")]).tobytes(), *expired.packed()))
    yield rows[columns]


def deduplicate(stream: DataFrame, key: Column, event_time: str, order: str, payload: list[str], folder: str, delay_seconds: int, shards: int = 128) -> Deduplicated:
    """Run a stream to its present end; the result holds one row per identifier.

    key: text that identifies a message. Rows whose key is NULL are no messages
    and are left out. The copy kept is the one with the earliest event time of
    the batch in which the identifier first came, ties by `order` (bigint). A
    NULL event time counts as the newest one seen. delay_seconds: how far copies
    of a message may be apart for the state alone to find them; copies further
    apart are found by the look-up. Identifiers compare by a 128-bit hash. The
    folder must be one all executors share; running again with the same folder
    goes on where the last run ended.
    """
    spark = stream.sparkSession
    picked = stream.select(
        key.alias("_key"),
        F.xxhash64(key).alias("_h1"),
        F.xxhash64(F.lit("second"), key).alias("_h2"),
        F.unix_micros(F.col(event_time).cast("timestamp")).alias("_t"),
        F.lit(1).cast("bigint").alias("_copies"),
        F.col(order).cast("bigint").alias("_order"),
        *payload,
    ).where("_key IS NOT NULL")
    combined = picked.mapInPandas(_combine, picked.schema).withColumn("_shard", F.pmod(F.col("_h1"), F.lit(shards)).cast("int"))
    columns = [*_FIXED, *payload]
    row_schema = StructType([StructField(picked.schema[c].name, picked.schema[c].dataType, True) for c in columns])
    more = "_kind int, _from bigint, _to bigint, _period bigint"
    out = StructType([*row_schema.fields, *[StructField(n, t, True) for n, t in _types(more)]])
    match = functools.partial(_match, delay=delay_seconds * 1_000_000, columns=[*columns, "_kind", "_from", "_to", "_period"])
    kinds = combined.groupBy("_shard").applyInPandasWithState(match, out, StructType.fromDDL(_STATE), "append", "NoTimeout")

    everything = StructType([*[f for f in out.fields if f.name != "_period"], *[StructField(n, t, True) for n, t in _types("batch int, _period bigint")]])

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("_period").parquet(f"{folder}/events/batch={number}")
        events = s.read.schema(everything).parquet(f"{folder}/events")
        mine = events.where((F.col("batch") == number) & (F.col("_kind") == LOOK_UP)) if number else events.where("false")
        reach = mine.select(F.explode(F.sequence("_from", "_to")).alias("p")).distinct().collect() if number else []
        if number and not reach:
            return
        before = events.where((F.col("batch") < number) & F.col("_period").isin([r.p for r in reach]) & (F.col("_kind") != COPY)).select("_h1", "_h2")
        mine.select("_key", "_h1", "_h2").join(before, ["_h1", "_h2"], "left_semi").select("_key").write.mode("overwrite").parquet(f"{folder}/known/batch={number}")

    query = kinds.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return Deduplicated(spark, folder, row_schema)
