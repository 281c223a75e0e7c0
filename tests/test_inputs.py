"""Inputs of the registered queries: the same rows from many tasks, and slices of equally many files."""

import pytest
from pyspark.sql import functions as F

from netlantern.operators import rollup
from netlantern.plans import topk
from netlantern.plans.sizing import written_once
from netlantern.sources.store import append_events
from netlantern.sources.summaries import refresh, summary_path
from workload import tables


@pytest.fixture
def log(spark, tmp_path, monkeypatch):
    """A log of 6,000 events over 30 days in one file of one block."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    rows = spark.range(6000).selectExpr(
        "id AS event_id", "CAST(TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7) AS TIMESTAMP_NTZ) AS ts",
        "id % 97 AS user_id",
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_lines_are_rendered_by_many_tasks(spark, log):
    found = tables.lines(spark, log)
    assert found.select(F.spark_partition_id()).distinct().count() > 30
    assert found.count() == found.select("id").distinct().count() == 6000


def test_slices_have_equally_many_files_and_all_rows(spark, log):
    late = "id % 50 = 7 AND received_at < TIMESTAMP '2024-01-09 00:00:00'"
    folder, files = tables.arrivals_with_late(spark, log, late)
    held = spark.read.parquet(folder)
    assert files == 1 and held.count() == held.select("id").distinct().count() == 6000
    ends = held.groupBy(F.col("_metadata.file_path")).agg(F.max("received_at").alias("end"), F.count_if(F.expr(late)).alias("late"))
    assert sum(r.late > 0 for r in ends.collect()) == 1
    whole = spark.read.parquet(tables.arrivals(spark, log))
    assert whole.exceptAll(tables.lines(spark, log)).isEmpty() and whole.count() == 6000
    assert len(whole.inputFiles()) == 16


def test_numbers_by_ranges(spark, monkeypatch):
    """Ranges of few rows, with keys that come often, null or twice."""
    monkeypatch.setattr(topk, "RANGE_ROWS", 50)
    df = spark.range(700).selectExpr("nullif(id % 9, 4) AS a", "id % 350 AS id").repartition(5)
    rows = topk.sequence_rows(df, ["a", "id"], "seq", 10).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(11, 711))
    keys = [(r.a is not None, r.a or 0, r.id) for r in rows]
    assert keys == sorted(keys)


def test_rows_written_once_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    with written_once(spark.range(30).mapInArrow(count, "id long"), "few") as rows:
        assert rows.count() == rows.filter("id >= 0").count() == 30
        path = rows.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert made.value == 30
    with pytest.raises(FileNotFoundError):
        open(path)


def test_a_folder_of_a_summary_is_one_file(spark, make_events, tmp_path):
    """However many tasks aggregate, each folder is written by one of them while it is small."""
    path = f"{tmp_path}/table"
    append_events(make_events([{"src_ip": f"10.0.0.{i % 60}", "minute": i * 20} for i in range(300)]), path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kind = rollup.TALKERS["src"].kind
        refresh(spark, path, kind)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(summary_path(path, kind)).inputFiles()
    assert len(files) == len({f.rsplit("/", 1)[0] for f in files}) > 4
