"""File-change streams: debounce, latest findings, bounded snapshot, re-review."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslens.constants import DEFAULT_IGNORES, WATCHED_FILES
from corpuslens.functions.ordered import next_value
from corpuslens.operators.scope import ignored

EVENT_SCHEMA = "seq long, ts timestamp, path string, kind string"
#: Folders of the stored report.
REPORT_BUCKETS = 64
RESULT_SCHEMA = "seq long, ts timestamp, project_id long, path string, n_findings long, errored boolean"


def change_stream(spark: SparkSession, folder: str, rules: list[str] | None = None, delay: str = "1 hour") -> DataFrame:
    """Add / change / unlink events from parquet files as they arrive, ignored paths left out."""
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(folder)
    return clean_events(events, rules).withWatermark("ts", delay)


def clean_events(events: DataFrame, rules: list[str] | None = None) -> DataFrame:
    e = events.withColumn("path", F.translate("path", "\\", "/"))
    return e.where(~ignored(F.col("path"), [*DEFAULT_IGNORES, *(rules or [])]))


def debounce(events: DataFrame, gap_ms: int, block: str = "day") -> DataFrame:
    """Fires of a finished event table: an add or change not followed within ``gap_ms``.

    A later event of any kind, an unlink too, cancels the pending fire; an event
    exactly ``gap_ms`` later still does. The following event is found by time
    blocks, so a busy file is spread.
    """
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = next_value(events, ["path"], F.date_trunc(block, "ts"), ["ts", "seq"], F.col("ts"), "next_ts")
    wait, gap = F.unix_micros("next_ts") - F.unix_micros("ts"), gap_ms * 1000
    return e.where(F.col("kind") != "unlink").where(F.col("next_ts").isNull() | (wait > gap)).select(
        "path", "seq", F.timestamp_micros(F.unix_micros("ts") + gap).alias("fire_ts")
    )


def debounce_stream(events: DataFrame, gap_ms: int) -> DataFrame:
    """The same on a stream: per path the pending event, fired by an event-time timer.

    State is one timestamp and one id per path with a pending event.
    """

    gap = gap_ms * 1000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fires = []
        if state.hasTimedOut:
            seq, at = state.get
            fires.append((key[0], seq, at + gap))
            state.remove()
        else:
            seq, at = state.get if state.exists else (0, None)
            rows = pd.concat(list(frames)).sort_values(["us", "seq"])
            for s, us, kind in rows[["seq", "us", "kind"]].itertuples(index=False):
                if at is not None and us - at > gap:
                    fires.append((key[0], seq, at + gap))
                seq, at = int(s), (int(us) if kind != "unlink" else None)
            due = None if at is None else (at + gap) // 1000 + 1
            if due is not None and due <= state.getCurrentWatermarkMs():
                fires.append((key[0], seq, at + gap))
                due = None
            if due is not None:
                state.update((seq, at))
                state.setTimeoutTimestamp(due)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(fires, columns=["path", "seq", "fire_us"]).astype({"seq": "int64", "fire_us": "int64"})

    fired = events.withColumn("us", F.unix_micros("ts")).groupBy("path").applyInPandasWithState(
        step, "path string, seq long, fire_us long", "seq long, at long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return fired.select("path", "seq", F.timestamp_micros("fire_us").alias("fire_ts"))


def latest_findings(results: DataFrame) -> DataFrame:
    """Current state per file: the last result that says something, if it has findings.

    A clean result removes the file, an errored empty one changes nothing.
    ``first_seen`` is the first result with findings since the file was last clean.
    """
    keys = ["project_id", "path"]
    decisive = results.where("n_findings > 0 OR NOT errored")
    order = F.struct("ts", "seq")
    now = decisive.groupBy(*keys).agg(
        F.max_by(F.struct("n_findings", "seq", "ts"), order).alias("now"),
        F.max(F.when(F.col("n_findings") == 0, order)).alias("cleaned"),
    )
    live = now.where("now.n_findings > 0")
    first = (
        decisive.where("n_findings > 0")
        .join(live.select(*keys, "cleaned"), keys)
        .where(F.col("cleaned").isNull() | (order > F.col("cleaned")))
        .groupBy(*keys)
        .agg(F.min(order).alias("first_seen"))
    )
    return live.join(first, keys).select(
        *keys, "now.n_findings", F.col("now.seq").alias("seq"), F.col("first_seen.ts").alias("first_seen"),
        F.col("first_seen.seq").alias("first_seq"),
    )


def _after(state: tuple, events: list) -> tuple:
    """``(n, seq, first_seq, first_us)`` of a file once these results, in order, have come."""
    n, seq, first_seq, first_us = state
    for us, s, found in events:
        if found and not n:
            first_seq, first_us = s, us
        n, seq = found, s
    return (n, seq, first_seq, first_us) if n else (0, seq, 0, 0)


def latest_stream(results: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``latest_findings`` kept up to date: a row per file whose state a micro-batch has changed.

    ``n_findings`` 0 says that the file is clean. Results may come in any order, across micro-batches too, as
    long as they are no more than ``delay`` behind the latest; those that are later still are left out. The
    state of a file is what was settled before the watermark, and the results after it in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *settled, open_, shown = state.get if state.exists else (0, 0, 0, 0, "[]", "[0, 0, 0, 0]")
        settled, events = tuple(settled), json.loads(open_)
        for r in pd.concat(list(frames)).itertuples():
            if r.n_findings > 0 or not r.errored:
                events.append([int(r.us), int(r.seq), int(max(r.n_findings, 0))])
        events.sort()
        now = _after(settled, events)
        before, shown = json.loads(shown), json.dumps(now)
        changed = before != json.loads(shown) and (before[0] > 0 or now[0] > 0)
        line = state.getCurrentWatermarkMs() * 1000
        past = [e for e in events if e[0] < line]
        settled, events = _after(settled, past), events[len(past) :]
        if settled[0] or events:
            state.update((*settled, json.dumps(events), shown))
        elif state.exists:
            state.remove()
        n, seq, first_seq, first_us = now
        rows = [(*key, n, seq, first_us, first_seq)] if changed else []
        yield pd.DataFrame(rows, columns=["project_id", "path", "n_findings", "seq", "first_us", "first_seq"])

    out = "project_id long, path string, n_findings long, seq long, first_us long, first_seq long"
    keyed = results.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).groupBy("project_id", "path")
    live = keyed.applyInPandasWithState(
        step, out, "n long, seq long, first_seq long, first_us long, open string, shown string", "update", GroupStateTimeout.EventTimeTimeout
    )
    return live.select("project_id", "path", "n_findings", "seq", F.timestamp_micros("first_us").alias("first_seen"), "first_seq")


def bound_files(latest: DataFrame, limit: int = WATCHED_FILES) -> DataFrame:
    """The ``limit`` most recently entered files per project; the oldest entries leave first."""
    w = Window.partitionBy("project_id").orderBy(F.desc("first_seen"), F.desc("first_seq"))
    return latest.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def current_report(findings: DataFrame) -> DataFrame:
    """Lines of the watch report, one per finding, in file and severity order keys."""
    at = F.when(F.col("line_start").isNotNull(), F.concat(F.lit(" (Line "), F.col("line_start").cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(
        F.lit("- **["), F.upper("severity"), F.lit("]** "), "title", at, F.lit("\n  - *"), "agent_name", F.lit("*: "), "description"
    )
    return findings.where("path IS NOT NULL").select("path", "seq", line.alias("value"))


def write_current_findings(snapshot: DataFrame, folder: str) -> None:
    """Replace the stored report by the given findings; files share ``REPORT_BUCKETS`` folders by hash."""
    bucket = F.pmod(F.xxhash64("path"), F.lit(REPORT_BUCKETS))
    rows = current_report(snapshot).withColumn("bucket", bucket).repartition("bucket")
    rows.write.partitionBy("bucket").mode("overwrite").parquet(folder)


def review_stream(
    fires: DataFrame, review: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Run ``review(changed_paths, batch_id)`` on the distinct files of every micro-batch.

    The batch operators are plain functions, so the callback can chunk, detect and
    merge the changed files exactly as a batch job would.
    """
    writer = fires.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: review(df.select("path").distinct(), batch_id)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
