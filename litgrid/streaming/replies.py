"""Requests and the replies to them as two streams in one: who was answered in time, who was not, and what came too late.

State is kept with timers in event time, for the keys of a bucket together, so that a batch costs a few calls a bucket. A request waits until its deadline: the first reply that came by then
answers it, and when the watermark has passed the deadline without one it is not found. Replies after the deadline, further
ones, and those nobody asked for are set aside under their own status. What is known of a key is forgotten some time after its
deadline, so state does not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from litgrid.session import ready_workers

OK, MISSING, LATE, REPEATED, UNASKED = "ok", "not_found", "late", "repeated", "unasked"
OUT = "key long, status string, at_ms long"
STATE = "open binary, timer long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NONE = -(1 << 62)
#: What is known of a key: the deadline of its request (NONE without one), whether it is settled; of a reply that waits for its request its time (else NONE); and when it is forgotten.
COLUMNS = ("key", "deadline", "settled", "at_ms", "forget")


def _pack(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _rows(key, status: str, at) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series(key, dtype="int64"), "status": status, "at_ms": pd.Series(at, dtype="int64")})


class Waiting(StatefulProcessor):
    """The keys of a bucket, worked on together: one state and one timer, of the next deadline or forgetting, for all of them."""

    def __init__(self, within_ms: int, keep_ms: int) -> None:
        self.within, self.keep = within_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", STATE)

    def _load(self) -> tuple[pd.DataFrame, int]:
        found = self.state.get()
        if found is None or found[0] is None:
            return pd.DataFrame({c: pd.Series(dtype="bool" if c == "settled" else "int64") for c in COLUMNS}), NONE
        return pa.ipc.open_stream(bytes(found[0])).read_all().to_pandas(), int(found[1])

    def _save(self, known: pd.DataFrame, timer: int) -> None:
        waits = (known["deadline"] != NONE) & ~known["settled"]
        after = min([*known["deadline"][waits], *known["forget"]], default=NONE)
        if timer not in (NONE, after):
            self.handle.deleteTimer(timer)
        if after == NONE:
            self.state.clear()
            return
        if after != timer:
            self.handle.registerTimer(after)
        self.state.update((_pack(known), after))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        known, timer = self._load()
        requests, early = known[known["deadline"] != NONE], known[known["deadline"] == NONE]
        asked = new[new["is_request"]].groupby("key", as_index=False)["at_ms"].min()
        asked = asked[~asked["key"].isin(requests["key"])]
        deadline = asked["at_ms"] + self.within
        added = pd.DataFrame({"key": asked["key"], "deadline": deadline, "settled": False, "at_ms": NONE, "forget": deadline + self.keep})
        requests = pd.concat([requests, added], ignore_index=True) if len(requests) else added.reset_index(drop=True)
        replies = pd.concat([early[["key", "at_ms"]], new.loc[~new["is_request"], ["key", "at_ms"]]], ignore_index=True)
        said = replies.merge(requests[["key", "deadline", "settled", "forget"]], on="key", how="left").sort_values(["key", "at_ms"], kind="stable")
        stray, said = said[said["deadline"].isna()], said[said["deadline"].notna()]
        out = []
        if len(said):
            in_time = said["at_ms"] <= said["deadline"]
            first = in_time & ~said["settled"].astype(bool) & ~said[in_time].duplicated("key").reindex(said.index, fill_value=True)
            status = np.where(first, OK, np.where(in_time, REPEATED, np.where(said["at_ms"] <= said["forget"], LATE, UNASKED)))
            out = [pd.DataFrame({"key": said["key"], "status": status, "at_ms": said["at_ms"]})]
            requests["settled"] = requests["settled"].astype(bool) | requests["key"].isin(said["key"][first])
        if len(stray):
            last = stray.groupby("key")["at_ms"].transform("max") + self.keep
            stray = pd.DataFrame({"key": stray["key"], "deadline": NONE, "settled": False, "at_ms": stray["at_ms"], "forget": last})
            requests = pd.concat([requests, stray], ignore_index=True)
        self._save(requests, timer)
        yield pd.concat(out) if out else _rows([], OK, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known, _ = self._load()
        missing = (known["deadline"] != NONE) & ~known["settled"] & (known["deadline"] <= now)
        gone = known["forget"] <= now
        stray = gone & (known["deadline"] == NONE)
        out = [_rows(known["key"][missing], MISSING, known["deadline"][missing]), _rows(known["key"][stray], UNASKED, known["at_ms"][stray])]
        known["settled"] |= missing
        self._save(known[~gone], NONE)
        yield pd.concat(out)

    def close(self) -> None:
        pass


def settle(events: DataFrame, within: str, keep: str, delay: str, buckets: int = 512) -> DataFrame:
    """events: key (long), ts (timestamp), is_request; a stream or a table. Returns key, status, at_ms (the reply's time, or the deadline that passed).

    within: how long a request waits; keep: how long after its deadline a key is remembered, and how long a reply waits for its
    request; delay: how late rows may arrive in the stream; buckets: keys are dealt to so many, each with one state of all its open
    keys, which should stay at some thousands. Of several requests of a key the earliest counts. Rows without a
    key or a time are left out; later rows than `delay` allows are dropped by the watermark.
    """
    spark = events.sparkSession
    ready_workers(spark)
    spark.conf.set(PROVIDER, ROCKS)
    ms = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    rows = events.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("is_request", F.lit(False)).alias("is_request"))
    rows = rows.withWatermark("ts", delay).withColumns({"at_ms": F.unix_millis("ts"), "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets))})
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Waiting(ms(within), ms(keep)), outputStructType=OUT, outputMode="append", timeMode="EventTime")


def run_into(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Everything the stream has now, written to a table of files; a later run with the same checkpoint goes on from there.

    In complete mode the table is replaced by each batch's result.
    """
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    else:
        replace = lambda batch, _: batch.write.mode("overwrite").parquet(folder)
        query = stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
