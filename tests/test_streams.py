"""Streams give the batch answer, over several batches."""

import pytest

from netlantern.operators.parse import parse_syslog
from netlantern.sources.lines import stream_lines
from netlantern.sources.store import read_events
from netlantern.streaming import feed
from workload import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arriving(spark):
    path = tables.arrivals(spark, SF)
    return lambda: stream_lines(spark, "parquet", {"path": path, "maxFilesPerTrigger": "1"})


def test_ingest_equals_batch(spark, arriving, tmp_path):
    feed.start_ingest(arriving(), str(tmp_path / "e"), str(tmp_path / "c"), None).awaitTermination()
    got = read_events(spark, str(tmp_path / "e"))
    want = parse_syslog(tables.lines(spark, SF)).drop("raw_message")
    assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count()


def test_feed_numbers_run_on_over_batches(spark, arriving, tmp_path):
    subs = tables.subscriptions(spark)
    out = str(tmp_path / "f")
    feed.live_feed(feed.parsed_stream(arriving()), subs, out, str(tmp_path / "c"), None).awaitTermination()
    rows = spark.read.parquet(out)
    want = feed.match_subscriptions(parse_syslog(tables.lines(spark, SF)), subs)
    assert rows.select("version").distinct().count() > 1
    assert rows.count() == want.count()
    assert sorted(r.seq for r in rows.select("seq").collect()) == list(range(1, rows.count() + 1))


def test_long_subscription_lists_match_the_same(spark, monkeypatch):
    ev = parse_syslog(tables.lines(spark, SF)).select("id", "event_type", "action")
    subs = tables.subscriptions(spark)
    small = feed.match_subscriptions(ev, subs)
    monkeypatch.setattr(feed, "is_small", lambda df: False)
    large = feed.match_subscriptions(ev, subs)
    key = lambda d: sorted((r.sub_id, r.id) for r in d.collect())
    assert key(small) == key(large)


def test_running_counts(spark, arriving, tmp_path):
    counts = feed.stream_type_counts(feed.parsed_stream(arriving()))
    out = str(tmp_path / "n")
    feed.start_table(counts, out, str(tmp_path / "c"), "complete", None).awaitTermination()
    got = {r.event_type: r["count"] for r in feed.read_table(spark, out, ["event_type"]).collect()}
    want = parse_syslog(tables.lines(spark, SF)).groupBy("event_type").count().collect()
    assert got == {r.event_type: r["count"] for r in want}


def test_text_lines(spark, tmp_path):
    line = "<13>Mar  7 07:25:08 h a: b"
    spark.createDataFrame([(line,), ("  ",), (line,)], "value STRING").coalesce(1).write.text(str(tmp_path / "t"))
    stream = stream_lines(spark, "text", {"path": str(tmp_path / "t")})
    feed.start_ingest(stream, str(tmp_path / "e"), str(tmp_path / "c"), None).awaitTermination()
    rows = read_events(spark, str(tmp_path / "e")).collect()
    assert [(r.hostname, r.message, r.severity) for r in rows] == [("h", "b", 5)] * 2
    assert rows[0].received_at is not None and len({r.id for r in rows}) == 2


def test_late_rows_are_set_apart(spark, make_events, tmp_path):
    """Counts and late rows together are the log; a batch that is repeated changes nothing."""
    rows = [dict(minute=m) for m in range(0, 600, 5)]
    ev = make_events(rows).select("id", "received_at", "event_type")
    src = tmp_path / "in"
    for k, some in enumerate(("id < 60 AND id % 10 > 0", "id >= 60", "id < 60 AND id % 10 = 0")):
        ev.filter(some).coalesce(1).write.mode("append").parquet(f"{src}/part={k}")
    stream = spark.readStream.schema("id LONG, received_at TIMESTAMP, event_type STRING, part INT")
    stream = stream.option("maxFilesPerTrigger", 1).parquet(str(src))
    out = str(tmp_path / "out")
    for state in ("c1", "c2"):  # the second run repeats all batches over what the first one wrote
        feed.start_timeline(stream, "1h", "4 hours", out, str(tmp_path / state), None).awaitTermination()
        late = sorted(r.id for r in feed.read_late(spark, out).collect())
        # The newest event of the first two batches is that of minute 595.
        assert late == [i for i in range(0, 60, 10) if i * 5 < 595 - 240]
        counted = feed.read_timeline(spark, out).agg({"total": "sum"}).first()[0]
        assert counted + len(late) == len(rows)
