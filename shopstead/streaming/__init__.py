"""Live forms of the windowed operators: fixed-window counters and duplicate suppression over streams of events."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def rate_windows(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Requests (key, ts) counted in epoch-aligned windows; a window is final once the watermark passes its end."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = ts.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "key").agg(F.count("*").alias("n"))
    return counts.select("key", F.unix_seconds("w.start").alias("window_start"), "n")


#: Rows of a key that are sorted at once, and rows of a sorted run that are in memory at once.
RUN, PART = 500_000, 10_000


def _sorted(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames).sort_values(["ts", "id"], kind="stable")


def _in_time_order(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows in order of (ts, id), in frames of bounded size: runs of RUN rows wait in the task's temporary folder and
    are merged part by part. Rows without a time are left out."""
    with tempfile.TemporaryDirectory() as folder:
        n_runs, held, n = 0, [], 0
        for frame in rows:
            held.append(frame[frame["ts"].notna()])
            n += len(held[-1])
            if n >= RUN:
                table = pa.Table.from_pandas(_sorted(held), preserve_index=False)
                with pa.ipc.new_file(f"{folder}/{n_runs}", table.schema) as out:
                    out.write_table(table, max_chunksize=PART)
                n_runs, held, n = n_runs + 1, [], 0
        rest = _sorted(held) if n else None
        if not n_runs:
            if n:
                yield rest
            return

        def parts(k: int) -> Iterator[pd.DataFrame]:
            with pa.ipc.open_file(f"{folder}/{k}") as run:
                for i in range(run.num_record_batches):
                    part = run.get_batch(i).to_pandas()
                    # the last row of a part that others follow names its run
                    yield part.assign(_run=np.r_[np.full(len(part) - 1, -1), k if i + 1 < run.num_record_batches else -1])

        runs = [parts(k) for k in range(n_runs)]
        pending = _sorted([*map(next, runs), *([rest.assign(_run=-1)] if n else [])])
        while len(pending):
            ends = np.flatnonzero(pending["_run"].to_numpy() >= 0)
            stop = ends[0] + 1 if len(ends) else len(pending)
            yield pending[:stop].drop(columns="_run")
            more = [next(runs[pending["_run"].iloc[ends[0]]])] if len(ends) else []
            pending = _sorted([pending[stop:], *more])


#: Buckets of keys. A call into Python and its questions to the state store cost milliseconds, so keys are not groups of
#: their own: a bucket is, and its state is read and written once a batch. Fixed for as long as a checkpoint lives.
BUCKETS = 4096


def _bucketed(events: DataFrame, key: str) -> DataFrame:
    """Events by bucket of their key, with the key as text under `key_text`."""
    return events.withColumns({"key_text": F.col(key).cast("string"), "key_bucket": F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS))})


def _micros(times: pd.Series) -> pd.Series:
    return (times if times.dt.tz is None else times.dt.tz_convert("UTC").dt.tz_localize(None)).astype("datetime64[us]").astype("int64")


class _Suppressor(StatefulProcessor):
    """Keeps the time of the last event let through for each key of a bucket; rows of a batch are taken in time order."""

    def __init__(self, seconds: int, columns: list[str]):
        self.micros, self.columns = seconds * 1_000_000, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "keys array<string>, micros array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = dict(zip(*(self.last.get() or ((), ()))))
        for part in _in_time_order(rows):
            keep = []
            for k, at in zip(part["key_text"], _micros(part["ts"])):
                ok = k not in kept or at - kept[k] > self.micros
                if ok:
                    kept[k] = at
                keep.append(ok)
            if any(keep):
                yield part.loc[keep, self.columns]
        if kept:
            self.last.update((list(kept), list(kept.values())))

    def close(self) -> None:
        pass


def suppress_duplicates(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """Events (id, key, ts) without those within `seconds` of the last one kept of their key; state is one timestamp a
    key. Needs the RocksDB state store."""
    by_bucket = _bucketed(events, key).groupBy("key_bucket")
    return by_bucket.transformWithStateInPandas(_Suppressor(seconds, events.columns), outputStructType=events.schema, outputMode="Append", timeMode="None")


class _Flight(StatefulProcessor):
    """Keeps the request in flight of each key of a bucket and when it began; a timer at the end of the bucket's first lease
    clears those that have lapsed."""

    def __init__(self, seconds: int):
        self.lease = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.flights = handle, handle.getValueState("flights", "keys array<string>, ids array<long>, micros array<long>, timer long")

    def _stored(self) -> tuple[dict, int | None]:
        keys, ids, micros, timer = self.flights.get() or ((), (), (), None)
        return dict(zip(keys, zip(ids, micros))), timer

    def _store(self, flights: dict, timer: int | None) -> None:
        """Writes the flights of the bucket and moves its timer, which stood at `timer`, to their first end."""
        first = min((began + self.lease) // 1000 for _, began in flights.values()) if flights else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is None:
            self.flights.clear()
            return
        if timer != first:
            self.handle.registerTimer(first)
        self.flights.update((list(flights), [i for i, _ in flights.values()], [began for _, began in flights.values()], first))

    @staticmethod
    def _told(rows: list[tuple]) -> pd.DataFrame:
        told = pd.DataFrame(rows, columns=["id", "key", "at", "verdict"])
        return told.assign(at=pd.to_datetime(told["at"], unit="us", utc=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flights, timer = self._stored()
        before = dict(flights)
        for part in _in_time_order(rows):
            told = []
            for i, k, at, finished in zip(part["id"], part["key_text"], _micros(part["ts"]), part["finished"]):
                now = flights.get(k)
                if now is not None and at >= now[1] + self.lease:
                    told.append((now[0], k, now[1] + self.lease, "lapsed"))
                    now = None
                    del flights[k]
                if finished:
                    flights.pop(k, None)
                elif now is None:
                    flights[k] = (int(i), at)
                    told.append((int(i), k, at, "accepted"))
            if told:
                yield self._told(told)
        if flights != before:
            self._store(flights, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """One timer stands for all leases of the bucket that the watermark has passed."""
        flights, timer = self._stored()
        expired, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        ended = {k: (i, began + self.lease) for k, (i, began) in flights.items() if (end := (began + self.lease) // 1000) <= expired or end < mark}
        # the timer that has expired is cleared by Spark
        self._store({k: f for k, f in flights.items() if k not in ended}, None if timer == expired else timer)
        if ended:
            yield self._told([(i, k, at, "lapsed") for k, (i, at) in ended.items()])

    def close(self) -> None:
        pass


def single_flight(events: DataFrame, lease: int, late: str = "1 hour") -> DataFrame:
    """(id, key, at, verdict): which requests of a stream (id, key, ts, finished) are taken up, and which lapse.

    A request of a key is accepted unless one is in flight already, which it then joins. An event with `finished` ends
    the key's flight; so does its lease, `lease` seconds after it began, which is told as lapsed. Events of one batch
    count in time order. Rows older than the watermark are left out before they get here. State is one request a key,
    and event-time timers clear it, so keys that fall silent leave nothing behind. Needs the RocksDB state store.
    """
    timed = events.select("id", "key", F.col("ts").cast("timestamp").alias("ts"), "finished").withWatermark("ts", late)
    by_bucket = _bucketed(timed, "key").groupBy("key_bucket")
    return by_bucket.transformWithStateInPandas(_Flight(lease), outputStructType="id long, key string, at timestamp, verdict string", outputMode="Append", timeMode="EventTime")


def drain(df: DataFrame, name: str, checkpoint: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over all input there is (in one or several batches) and returns the result as a table, which lies
    beside the checkpoint. With the keys of an aggregation, windows that the watermark has not closed yet are in it, too:
    every batch writes the rows it changes, and the last of each key counts."""
    spark, path = df.sparkSession, f"{checkpoint}-rows"
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")  # where there is no input

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    mode = "update" if keys else "append"
    q = df.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch long").parquet(path)
    if not keys:
        return rows.drop("batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), "batch").alias("last"))
    return last.select("last.*")


__all__ = ["drain", "rate_windows", "single_flight", "suppress_duplicates"]
