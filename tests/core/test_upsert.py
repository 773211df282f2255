"""Keyed state of a stream: replays, restarts and any cut into batches give the batch result."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkrisk.operators import sites
from linkrisk.streaming import upsert


def sightings(n=300, seed=1):
    r = random.Random(seed)
    base = dt.datetime(2026, 1, 1)
    word = lambda: r.choice(["", "", "x", "y", "z", "é"])
    return [(f"u{r.randint(0, 12)}", r.choice([10, 30, 30, 70]), r.choice("abc"), word(), word(), base + dt.timedelta(hours=r.randint(0, 40)), i) for i in range(n)]


def batch_result(spark, rows):
    """What the set-based merge makes of all sightings."""
    blank = F.lit("")
    df = spark.createDataFrame(rows, upsert.SIGHTING).select("*", blank.alias("category_label"), blank.alias("reasons"), blank.alias("redirect_from"), blank.alias("language"))
    df = df.withColumn("ord", F.struct("seen_at", "ord"))
    none = df.limit(0).select("*", F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"), F.lit(0).cast("long").alias("seen_count"))
    names = [c.split()[0] for c in upsert.SITE.split(", ")]
    return {r.url: tuple(r) for r in sites.merge_sites(none, df).select(*names).collect()}


def test_the_fold_does_not_depend_on_order():
    rows = [x[1:] for x in sightings() if x[0] == "u3"]
    frame = lambda xs: pd.DataFrame(xs, columns=["base_score", "category", "title", "matched_keywords", "seen_at", "ord"])
    want = upsert.folded(upsert.EMPTY, frame(rows))
    for seed in range(20):
        mixed = random.Random(seed).sample(rows, len(rows))
        state = upsert.EMPTY
        for k in range(0, len(mixed), 1 + seed):
            state = upsert.folded(state, frame(mixed[k : k + 1 + seed]))
        assert state == want


@pytest.fixture()
def stateful(spark):
    more = {upsert.PROVIDER[0]: upsert.PROVIDER[1], "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in more}
    for k, v in more.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run(spark, folder, checkpoint, seen, ttl=0):
    stream = spark.readStream.schema(upsert.SIGHTING).option("maxFilesPerTrigger", 1).parquet(folder)

    def take(df, batch):
        seen.append({r.url: tuple(r) for r in df.collect()})

    upsert.site_stream(stream, ttl).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_a_stream_that_stops_and_goes_on_gives_the_batch_result(stateful, tmp_path):
    spark, rows, folder, seen = stateful, sightings(), str(tmp_path / "in"), []
    write = lambda some: spark.createDataFrame(some, upsert.SIGHTING).coalesce(1).write.mode("append").parquet(folder)
    write(rows[:100]), time.sleep(0.05), write(rows[100:200])
    run(spark, folder, str(tmp_path / "ck"), seen)
    assert len(seen) == 2
    write([*rows[200:], (None, 1, "a", "", "", rows[0][5], 900), ("u1", None, "a", "", "", rows[0][5], 901)])
    run(spark, folder, str(tmp_path / "ck"), seen)  # a new query from the checkpoint
    assert len(seen) == 3
    last = {}
    for batch in seen:
        last.update(batch)
    assert last == batch_result(spark, rows)
    replayed = []
    run(spark, folder, str(tmp_path / "again"), replayed)  # all of it once more, from nothing
    last = {}
    for batch in replayed:
        last.update(batch)
    assert last == batch_result(spark, rows)


def test_state_with_a_time_to_live(stateful, tmp_path):
    """Processing time never ends, so such a query runs until it is stopped."""
    spark, rows, seen = stateful, sightings(60), []
    spark.createDataFrame(rows, upsert.SIGHTING).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(upsert.SIGHTING).parquet(str(tmp_path / "in"))
    query = upsert.site_stream(stream, 30).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.append({r.url: tuple(r) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        while not seen and query.isActive:
            time.sleep(0.2)
    finally:
        query.stop()
    assert seen[0] == batch_result(spark, rows)
