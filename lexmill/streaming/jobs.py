"""Structured Streaming jobs over event and document streams.

Aggregations use watermarks and mergeable buckets. Sequential rules keep a small state per key
(a bounded list or a few numbers) with ``applyInPandasWithState``; rows of a micro-batch are
ordered by event time inside their key before the rule sees them. ``maxFilesPerTrigger`` on the
source bounds what one batch, and therefore one key in it, can hold.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexmill.session import scratch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, glob: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def drain_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Append everything available now to a parquet table with a checkpoint; read it back."""
    spark = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKS)  # list state and timers need it; others may use it
    out, ckpt = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Update-mode results of every batch, reduced to the last value of each key."""
    spark = stream.sparkSession
    out, ckpt = scratch(spark, name), scratch(spark, f"{name}-checkpoint")

    def save(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own directory
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", ckpt)
        .outputMode("update").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    all_batches = spark.read.option("basePath", out).parquet(out)
    last = all_batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_r"))
    return last.select(*keys, "_r.*")


def windowed_latency(events: DataFrame, ts: str, stage: str, value: str, bounds, width: str, delay: str) -> DataFrame:
    """Per window and stage: count, sum, maximum, outcomes and cumulative buckets."""
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), stage)
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("longest"),
            F.count_if(F.col("verdict") != "ok").alias("not_ok"),
            *[F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
        )
        .select(F.unix_timestamp("w.start").alias("window_start"), stage, "n", "total", "longest", "not_ok",
                *[f"le_{i}" for i in range(len(bounds))])
    )


def keyed_scan(
    events: DataFrame, key: str, order: list[str], value_cols: list[str], out_schema: str, state_schema: str,
    start: Callable[[], tuple], step: Callable[[tuple, Any], tuple[tuple, tuple]],
) -> DataFrame:
    """Run ``step(state, row) -> (state, output)`` over the rows of every key in order.

    The output carries the key, the last column of ``order`` (the row id) and the step's values.
    """
    row_id = order[-1]
    names = [key, *order, *value_cols]
    types = dict(events.dtypes)
    full = f"{key} {types[key]}, {row_id} {types[row_id]}, {out_schema}"
    out_cols = [c.strip().split(" ")[0] for c in full.split(", ")]

    def run(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = tuple(state.get) if state.exists else start()
        rows = pd.concat(list(chunks)).sort_values(order)
        out = []
        for row in rows.itertuples(index=False):
            current, values = step(current, row)
            out.append((k[0], getattr(row, row_id), *values))
        state.update(current)
        yield pd.DataFrame(out, columns=out_cols)

    return events.select(*names).groupBy(key).applyInPandasWithState(
        run, full, state_schema, "append", GroupStateTimeout.NoTimeout
    )


class OrderedScan(StatefulProcessor):
    """Rows of a key wait in a list state until the watermark passes them and are then judged in order.

    One event-time timer per key stands at the earliest waiting row; when it fires, all rows the watermark has passed go through ``step`` and the
    timer moves on. A row that arrives late, but within the watermark's delay, is judged in its place. A pause of more than
    ``idle_ms`` starts a key anew, and the watermark removes the state of a key that stays away.
    """

    def __init__(self, order: list[str], names: list[str], kinds: str, state_schema: str, out_cols: list[str], start: Callable[[], tuple], step: Callable, idle_ms: int):
        self.order, self.names, self.kinds, self.state_schema, self.out_cols = order, names, kinds, state_schema, out_cols
        self.start, self.step, self.idle_ms = start, step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.kinds)
        self.current = handle.getValueState("current", self.state_schema)
        self.times = handle.getValueState("times", "timer bigint, last bigint")  # ms; -1: none

    def _set_timer(self, timer: int, last: int) -> None:
        old = self.times.get()[0] if self.times.exists() else -1
        if old != timer:
            if old >= 0:
                self.handle.deleteTimer(old)
            if timer >= 0:
                self.handle.registerTimer(timer)
        self.times.update((timer, last))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            batch = batch[self.names]
            least = -int(-batch[self.order[0]].min() // 1000)
            earliest = least if earliest is None else min(earliest, least)
            self.waiting.appendList([tuple(None if v is None or v != v else v for v in r) for r in batch.astype(object).itertuples(index=False, name=None)])
        timer, last = self.times.get() if self.times.exists() else (-1, -1)
        idle = last >= 0 and timer >= last + self.idle_ms  # the timer only waits to forget the key
        self._set_timer(earliest if timer < 0 or idle else min(earliest, timer), last)
        yield pd.DataFrame(columns=self.out_cols)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        _, last = self.times.get()
        at = [self.names.index(c) for c in self.order]
        rows = sorted(self.waiting.get(), key=lambda r: [r[i] for i in at]) if self.waiting.exists() else []
        due = [r for r in rows if r[at[0]] <= now * 1000]
        if not due and not rows and last + self.idle_ms <= now:
            for state in (self.waiting, self.current, self.times):
                state.clear()
            return
        current, out = tuple(self.current.get()) if self.current.exists() else self.start(), []
        row_type = namedtuple("Row", self.names)
        for r in due:
            if last >= 0 and r[at[0]] // 1000 - last > self.idle_ms:
                current = self.start()
            last = r[at[0]] // 1000
            current, values = self.step(current, row_type(*r))
            out.append((key[0], r[at[-1]], *values))
        rest = rows[len(due) :]
        if rest:
            self.waiting.put(rest)
        elif rows:
            self.waiting.clear()
        if due:
            self.current.update(current)
        self.times.update((-1, last))  # the timer that fired is gone
        self._set_timer(-int(-rest[0][at[0]] // 1000) if rest else last + self.idle_ms, last)
        if out:
            yield pd.DataFrame(out, columns=self.out_cols)

    def close(self) -> None:
        pass


def ordered_scan(
    events: DataFrame, key: str, order: list[str], value_cols: list[str], out_schema: str, state_schema: str,
    start: Callable[[], tuple], step: Callable[[tuple, Any], tuple[tuple, tuple]], delay: str = "0 seconds", idle_ms: int = 365 * 86_400_000,
) -> DataFrame:
    """``step`` over the rows of every key in event-time order across micro-batches; ``order`` begins with the time in microseconds.

    Rows come out when the watermark (``delay`` behind the latest row) has passed them. Needs the RocksDB state store:
    start it with :func:`drain_to_table`, or set the provider.
    """
    row_id, types = order[-1], dict(events.dtypes)
    names = [*order, *value_cols]
    full = f"{key} {types[key]}, {row_id} {types[row_id]}, {out_schema}"
    out_cols = [c.strip().split(" ")[0] for c in full.split(", ")]
    kinds = ", ".join(f"{n} {types[n]}" for n in names)
    scan = OrderedScan(order, names, kinds, state_schema, out_cols, start, step, idle_ms)
    at = F.timestamp_millis(F.ceil(F.col(order[0]) / 1000)).alias("_at")  # watermarks are whole milliseconds
    rows = events.select(key, at, *names).withWatermark("_at", delay)
    return rows.groupBy(key).transformWithStateInPandas(scan, full, "append", "EventTime")


# -- rules ---------------------------------------------------------------------------------


def last_n_percentiles(n: int):
    """(count, p50, p95) of the latest n values."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        recent = [*state[0], float(row.value)][-n:]
        ranked = sorted(recent)
        pick = lambda q: ranked[min(int(len(ranked) * q), len(ranked) - 1)]
        return (recent,), (len(recent), pick(0.5), pick(0.95))

    return "n int, p50 double, p95 double", "recent array<double>", (lambda: ([],)), step


def hold_alert(threshold: float, for_seconds: float):
    """OK, PENDING, FIRING, FIRING_CONTINUES, RESOLVED; state: since (us, -1 = none) and firing."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        since, firing = state
        if row.value <= threshold:
            return (-1, False), ("RESOLVED" if firing else "OK",)
        since = row.us if since < 0 else since
        if firing:
            return (since, True), ("FIRING_CONTINUES",)
        held = row.us - since >= for_seconds * 1_000_000
        return (since, held), ("FIRING" if held else "PENDING",)

    return "state string", "since bigint, firing boolean", (lambda: (-1, False)), step


def sliding_limit(limit: int, window_s: float):
    """allowed, remaining, retry_after_s; only allowed requests leave a mark."""
    span = int(window_s * 1_000_000)

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        if limit <= 0:
            return state, (True, 0, 0)
        marks = [int(m) for m in state[0] if row.us - m < span]
        if len(marks) < limit:
            marks.append(int(row.us))
            return (marks,), (True, limit - len(marks), 0)
        return (marks,), (False, 0, max(-int((row.us - marks[0] - span) // 1_000_000), 1))

    return "allowed boolean, remaining int, retry_after_s int", "marks array<bigint>", (lambda: ([],)), step


def cold_storm(n: int, threshold: float, max_cold: int):
    """Slow loads among the latest n."""

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        recent = [*state[0], bool(row.value > threshold)][-n:]
        return (recent,), (sum(recent), sum(recent) > max_cold)

    return "cold bigint, storm boolean", "recent array<boolean>", (lambda: ([],)), step


def route_by_health(floor: float = 0.9, ratio: float = 0.5, min_samples: int = 3, canary_every: int = 5):
    """Degraded verdict with a learned baseline and the route of each request.

    State: baseline (-1 = not learned), sticky slow verdict, requests since degraded.
    """

    def step(state: tuple, row) -> tuple[tuple, tuple]:
        baseline, slow, served = state
        spilled = row.gpu == row.gpu and row.gpu is not None and row.gpu < floor
        known = row.p50 is not None and row.p50 == row.p50 and row.samples >= min_samples
        if known and baseline < 0 and not spilled:
            baseline = float(row.p50)
        if known and baseline > 0:
            slow = bool(row.p50 < ratio * baseline)
        if not (spilled or slow):
            return (baseline, slow, 0), (False, "primary")
        served += 1
        return (baseline, slow, served), (True, "canary" if served % canary_every == 0 else "fallback")

    return "degraded boolean, route string", "baseline double, slow boolean, served bigint", (lambda: (-1.0, False, 0)), step


# -- sinks and ingest --------------------------------------------------------------------------


def log_sink(events: DataFrame, line: Column, path: str, checkpoint: str):
    """Append-only JSON lines with a checkpoint: each event is written exactly once."""
    return (
        events.select(line.alias("value")).writeStream.format("text").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def sessions(events: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Closed sessions per key; a session closes when the watermark passes its end."""
    s = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return s.select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "total")


def unsent(documents: DataFrame, keys: list[str], sent: str, delay: str = "30 days") -> DataFrame:
    """The stream without rows that come again, with the same ``keys``, within ``delay`` of the time ``sent``: files delivered twice."""
    return documents.withWatermark(sent, delay).dropDuplicatesWithinWatermark(keys).drop(sent)


def ingest(documents: DataFrame, prepare: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str):
    """Incremental ingest: every batch is prepared and written under its batch number, beside the documents (``key``) that it replaces.

    That list is written for documents without chunks as well, so that a text that got shorter, or empty, leaves nothing behind: a document
    counts as of its last batch only. A replayed batch overwrites itself. Read it with :func:`ingested`.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{out}/chunks/load_seq={batch_id}")
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{out}/replaced/load_seq={batch_id}")

    return (
        documents.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingested(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The chunks of every document's last batch. Rows of one batch with the same key are versions of their own and all stay."""
    last = spark.read.parquet(f"{out}/replaced").groupBy(key).agg(F.max("load_seq").alias("_last"))
    chunks = spark.read.parquet(f"{out}/chunks")
    met = chunks.join(last.withColumnRenamed(key, "_key"), chunks[key].eqNullSafe(F.col("_key")) & (F.col("load_seq") == F.col("_last")))
    return met.drop("_key", "_last", "load_seq")
