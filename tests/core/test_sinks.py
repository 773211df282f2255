"""Files of reports: feeds by parts, sheets and days on any file system; filters before joins."""

import csv
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkrisk.operators import frontier
from linkrisk.sources import sinks


def test_a_feed_is_what_the_csv_module_writes(spark, tmp_path):
    rows = [(i, f"a{i}", t) for i, t in enumerate(["", None, " lead", 'q"uote', "com,ma", "new\nline", "é가", "back\\slash", "\ttab"])]
    frame = spark.createDataFrame(rows, "id long, url string, text string").repartition(4).orderBy("id")
    target = str(tmp_path / "out" / "feed.csv")
    assert sinks.write_feed(frame, target) == target
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(frame.columns)
    writer.writerows([["" if v is None else v for v in r] for r in rows])
    assert Path(target).read_bytes() == b"\xef\xbb\xbf" + out.getvalue().encode()
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["feed.csv"]
    sinks.write_feed(frame.limit(1), f"file:{target}")  # replaced, by any name that Spark takes
    assert len(Path(target).read_text("utf-8-sig").splitlines()) == 2


def test_a_feed_or_report_that_fails_leaves_the_one_before(spark, tmp_path):
    good = spark.createDataFrame([(1, "x")], "id long, url string")
    bad = good.select("id", F.raise_error(F.lit("lost")).cast("string").alias("url"))
    target, folder = str(tmp_path / "feed.csv"), str(tmp_path / "sheets")
    sinks.write_feed(good, target)
    sinks.write_sheets({"a": good, "b": good}, folder)
    before = Path(target).read_bytes()
    with pytest.raises(Exception, match="lost"):
        sinks.write_feed(bad, target)
    with pytest.raises(Exception, match="lost"):
        sinks.write_sheets({"a": good.limit(0), "b": bad}, folder)
    assert Path(target).read_bytes() == before
    assert spark.read.option("header", True).csv(f"{folder}/a").count() == 1
    assert sorted(p.name for p in Path(folder).iterdir()) == ["a", "b"]
    sinks.write_sheets({"a": good.unionAll(good)}, folder)
    assert spark.read.option("header", True).csv(f"{folder}/a").count() == 2


def test_a_feed_that_cannot_be_replaced_gets_a_second_name(spark, tmp_path):
    target = tmp_path / "feed.csv"
    (target / "in the way").mkdir(parents=True)  # a folder with something in it can't be replaced
    frame = spark.createDataFrame([(1, "x")], "id long, url string")
    assert sinks.write_feed(frame, str(target)) == str(tmp_path / "feed-new.csv")
    assert (tmp_path / "feed-new.csv").exists() and (target / "in the way").exists()


def test_days_of_reports(spark, tmp_path):
    frame, folder = spark.createDataFrame([(1,)], "id long"), f"file:{tmp_path}/days"
    for day in ("2026-01-01", "2026-01-05", "2026-01-09"):
        left = sinks.write_snapshot({"a": frame}, folder, day, keep_days=4)
    assert left == ["2026-01-05", "2026-01-09"] and sorted(p.name for p in (tmp_path / "days").iterdir()) == left
    (tmp_path / "days" / "old.csv").write_text("x")
    assert sinks.prune_snapshots(spark, folder, 0, 4e9) == [] and sinks.prune_snapshots(spark, folder, 10, 4e9) == ["old.csv"]


def test_filters_lose_no_known_domain(spark, monkeypatch):
    known = spark.range(5000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain"))
    rows = spark.range(100_000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("domain"), "id").unionByName(spark.createDataFrame([(None, -1)], "domain string, id long"))
    left = frontier.maybe_known(rows, known)
    assert left.columns == rows.columns
    assert left.where("id < 5000").count() == 5000 and left.count() < 5000 + 95_000 / 8
    assert frontier.known_domains(rows, known).count() == 5000
    assert frontier.maybe_known(rows, known.limit(0)).count() == 0
    monkeypatch.setattr(frontier, "FILTER_BYTES", 1)
    assert frontier.maybe_known(rows, known).count() == 100_001
