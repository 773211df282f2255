"""Cycles as a stream: every micro-batch of fetched pages is one cycle (an extension).

The batch plan is used as it is; state lives in versioned snapshots, and a
batch's number is its run, so a replayed batch is recognised and skipped.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cycle import commit_crawl, crawl, stored_state
from ..rules import Rules
from ..sources.readers import Config
from ..sources.snapshots import Store


def run_batch(store: Store, pages: DataFrame, batch: int, rules: Rules, cfg: Config, now) -> int:
    """One cycle over a batch; returns the version it committed, or the current one for a replay."""
    note = f"batch {batch}"
    base, state = store.version(), stored_state(store)
    if state.runs.where(F.col("note") == note).limit(1).count():
        return base
    near = store.near if "sightings" in store.manifest()["tables"] else None
    after, parts = crawl(state, pages, rules, cfg, F.lit(now), near=near)
    runs = after.runs.withColumn("note", F.when(F.col("started_at") == F.lit(now), F.lit(note)).otherwise(F.col("note")))
    return commit_crawl(store, state, replace(after, runs=runs), parts, cfg, F.lit(now), base)


def start(stream: DataFrame, store: Store, rules: Rules, cfg: Config, clock, checkpoint: str, **trigger):
    """A streaming query over fetched pages; ``clock(batch)`` gives the time of a batch."""
    return (
        stream.writeStream.foreachBatch(lambda df, batch: run_batch(store, df, batch, rules, cfg, clock(batch)))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events in tumbling windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
