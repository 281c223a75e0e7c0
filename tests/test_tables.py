"""Aggregates, search, enrichment, dossiers and storage on small hand-made tables."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from netlantern.functions import net
from netlantern.operators import enrich, events, hunt, stats
from netlantern.plans.skew import hot_keys, lookup
from netlantern.plans.topk import aggregate_with_latest, newest_per_key, sequence_rows
from netlantern.schema import EVENT_COLUMNS, INTEL_SCHEMA
from netlantern.sources import documents, store
from netlantern.sources.intel import append_intel, read_intel
from netlantern.sources.store import complete
from tests.conftest import T0

SINCE = T0 - dt.timedelta(days=1)


def intel_rows(spark, rows):
    full = [
        (ip, c, "city", 0.0, 1.0, s, h, False, when) for ip, c, s, h, when in rows
    ]
    return spark.createDataFrame(full, INTEL_SCHEMA)


def test_private_boundaries(spark):
    want = {
        "172.15.255.255": False, "172.16.0.0": True, "172.31.255.255": True, "172.32.0.0": False,
        "100.63.255.255": False, "100.64.0.0": True, "100.127.255.255": True, "100.128.0.0": False,
        "223.255.255.255": False, "224.0.0.1": True, "239.1.1.1": True, "240.0.0.1": False,
        "255.255.255.255": True, "0.0.0.0": True, "10.1.1.1": True, "127.0.0.1": True,
        "169.254.3.4": True, "192.168.1.1": True, "192.169.1.1": False, "::1": True, "": True,
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "ip STRING")
    got = {r.ip: r.p for r in df.select("ip", net.is_private(F.col("ip")).alias("p")).collect()}
    assert got == {**want, None: True}


def test_latest_values_and_ties(make_events):
    ev = make_events([
        dict(src_ip="b", src_geo_country="AA", src_hostname="x"),
        dict(src_ip="b"),
        dict(src_ip="a", src_geo_country="CC"),
        dict(src_ip="a", src_geo_country="DD"),
        dict(src_ip="c"),
    ])
    rows = [tuple(r) for r in stats.top_talkers(ev, SINCE).select("ip", "count", "country").collect()]
    assert rows == [("a", 2, "DD"), ("b", 2, None), ("c", 1, None)]


def test_since_and_until_are_inclusive(make_events):
    ev = make_events([{}, {}, {}])
    edge = T0 + dt.timedelta(minutes=1)
    assert events.filter_events(ev, since=edge).count() == 2
    assert events.filter_events(ev, until=edge).count() == 2


def test_search_is_literal(make_events):
    ev = make_events([dict(message="at 100% Now"), dict(message="at 1000"), dict(hostname="H_1")])
    assert [r.id for r in events.filter_events(ev, search="100% n").collect()] == [0]
    assert [r.id for r in events.filter_events(ev, search="h_1").collect()] == [2]


def test_numeric_filters(spark):
    df = spark.createDataFrame([("a", 5), ("b", 50), ("c", None)], "ip STRING, abuse_score INT")
    def keep(text):
        return {r.ip for r in events.filter_intel(df, {"abuse_score": text}).collect()}
    assert keep("5") == {"a", "b"} and keep(">5") == {"b"} and keep("= 5") == {"a"}
    assert keep("!0") == {"a", "b"} and keep("<=5") == {"a", "c"} and keep("5x") == set()
    assert keep("><5") == set()


def test_pages_cover_everything(make_events):
    ev = make_events([dict(minute=i // 3) for i in range(20)])
    seen, before = [], None
    while True:
        rows = events.page(ev, 7, before=before).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        before = (rows[-1].received_at.replace(tzinfo=dt.timezone.utc), rows[-1].id)
    assert seen == list(range(19, -1, -1))
    assert [r.id for r in events.page(ev, 7, 7).collect()] == seen[7:14]


def test_lookup_of_a_large_table_with_a_hot_key(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}" if i % 3 == 1 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "ip STRING, id BIGINT")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "ip STRING, v INT")
    assert "hot" in {r.ip for r in hot_keys(df, "ip").collect()}
    small = lookup(df, table, "ip", "f", small=True)
    large = lookup(df, table, "ip", "f", small=False)
    as_set = lambda d: sorted((r.id, r.ip, r.f.v if r.f else None) for r in d.collect())
    assert as_set(small) == as_set(large) and len(as_set(large)) == 3000
    some = lookup(df, table, "ip", "f", small=False, needed=F.col("id") % 2 == 0)
    assert {r.id % 2 for r in some.filter("f IS NOT NULL").collect()} == {0}


def test_range_lookup_against_brute_force(spark):
    rng = random.Random(5)
    points = sorted(rng.sample(range(1, 2**32), 400))
    ranges = [(points[i], points[i + 1] - 1, f"r{i}") for i in range(0, 398, 2)]
    ranges += [(2**31 - 2, 2**31 + 5, "edge")] if not any(a <= 2**31 + 5 and b >= 2**31 - 2 for a, b, _ in ranges) else []
    values = [rng.randrange(1, 2**32) for _ in range(500)] + [a for a, _, _ in ranges] + [b for _, b, _ in ranges]
    text = lambda v: ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    ips = spark.createDataFrame([(text(v),) for v in values] + [("::1",), (None,)], "ip STRING")
    table = spark.createDataFrame(ranges, "start_ip BIGINT, end_ip BIGINT, name STRING")
    got = {r.ip: r.name for r in enrich.range_lookup(ips, table).collect()}
    want = {text(v): next((n for a, b, n in ranges if a <= v <= b), None) for v in values}
    assert got == {**want, "::1": None}


def test_backfill_keeps_existing_and_caps(spark, make_events):
    ev = make_events(
        [dict(src_ip="1.1.1.1") for _ in range(6)]
        + [dict(src_ip="1.1.1.1", src_geo_country="OLD"), dict(src_ip="2.2.2.2", dst_ip="1.1.1.1"), {}]
    )
    intel = intel_rows(spark, [("1.1.1.1", "NEW", 7, None, T0), ("3.3.3.3", None, None, "h", T0)])
    full = {r.id: (r.src_geo_country, r.dst_geo_country) for r in enrich.enrich_events(ev, intel).collect()}
    assert full[0] == ("NEW", None) and full[6] == ("OLD", None) and full[7] == (None, "NEW")
    capped = enrich.enrich_events(ev, intel, max_rows_per_ip=2).collect()
    assert sorted(r.id for r in capped if r.src_geo_country == "NEW") == [4, 5]
    assert len(capped) == 9


def test_newest_per_key_of_a_hot_key(spark):
    df = spark.range(2000).select("id", F.lit("x").alias("ip"), F.timestamp_seconds("id").alias("received_at"))
    assert sorted(r.id for r in newest_per_key(df, "ip", 5).collect()) == list(range(1995, 2000))


def test_upsert_is_idempotent(spark):
    old = intel_rows(spark, [("a", "X", 1, None, T0), ("b", "Y", 2, None, T0)])
    new = intel_rows(spark, [("b", None, None, "h", T0), ("c", "Z", 3, None, T0)])
    once = enrich.upsert_intel(old, new)
    rows = lambda d: sorted(map(tuple, d.select("ip", "geo_country", "hostname").collect()))
    assert rows(once) == [("a", "X", None), ("b", None, "h"), ("c", "Z", None)]
    assert rows(enrich.upsert_intel(once, new)) == rows(once)


def test_intel_log_versions(spark, tmp_path):
    path = str(tmp_path / "log")
    append_intel(intel_rows(spark, [("a", "X", 1, None, T0)]), path, 0)
    for _ in range(2):
        append_intel(intel_rows(spark, [("a", "Y", 2, None, T0)]), path, 1)
    assert [r.geo_country for r in read_intel(spark, path).collect()] == ["Y"]
    assert [r.geo_country for r in read_intel(spark, path, before=1).collect()] == ["X"]


def test_pending_and_freshness(spark, make_events):
    ev = make_events([dict(src_ip="9.9.9.1", dst_ip="10.0.0.1"), dict(src_ip="9.9.9.2"), dict(src_ip="9.9.9.3"),
                      dict(src_ip="9.9.9.4"), dict(src_ip="9.9.9.5", event_type="wifi")])
    stale = T0 - dt.timedelta(hours=24, seconds=1)
    intel = intel_rows(spark, [("9.9.9.2", "A", 1, None, T0 - dt.timedelta(hours=24)),
                               ("9.9.9.3", "A", 1, None, stale), ("9.9.9.4", "A", None, None, T0)])
    found = lambda **k: sorted(r.ip for r in enrich.pending_ips(ev.withColumn("event_type", F.coalesce("event_type", F.lit("firewall"))), intel, T0, **k).collect())
    assert found() == ["9.9.9.1", "9.9.9.3", "9.9.9.4"]
    assert found(rescore=False) == ["9.9.9.1", "9.9.9.3"]


def test_resolve_precedence(spark):
    intel = intel_rows(spark, [("9.0.0.1", "KEEP", 5, "old", T0)])
    pending = spark.createDataFrame([("9.0.0.1",), ("9.0.0.2",), ("8.0.0.1",), ("10.0.0.1",)], "ip STRING")
    geo = spark.createDataFrame([(9 * 2**24, 9 * 2**24 + 9, "GG", "Town", 0.0, 0.0)],
                                "start_ip BIGINT, end_ip BIGINT, country STRING, city STRING, lat DOUBLE, lon DOUBLE")
    feed = spark.createDataFrame(
        [("8.0.0.1", 80, "FF", T0), ("8.0.0.1", 1, "EE", T0 - dt.timedelta(days=3)),
         ("9.0.0.2", 9, "EE", T0 - dt.timedelta(days=91))],
        "ip STRING, abuse_score INT, country_code STRING, reported_at TIMESTAMP")
    rows = {r.ip: r for r in enrich.resolve_intel(pending, intel, T0, geo, feed).collect()}
    assert (rows["9.0.0.1"].geo_country, rows["9.0.0.1"].abuse_score, rows["9.0.0.1"].hostname) == ("KEEP", 5, "old")
    assert (rows["9.0.0.2"].geo_country, rows["9.0.0.2"].geo_lat, rows["9.0.0.2"].abuse_score) == ("GG", 0.0, None)
    assert (rows["8.0.0.1"].geo_country, rows["8.0.0.1"].abuse_score) == ("FF", 80)
    assert rows["10.0.0.1"].is_private and not rows["8.0.0.1"].is_private
    ptr = spark.createDataFrame([("9.0.0.2", 1, "b"), ("9.0.0.2", 0, "z")], "ip STRING, ord INT, hostname STRING")
    named = {r.ip: r.hostname for r in enrich.resolve_intel(pending, intel, T0, ptr_records=ptr).collect()}
    assert named["9.0.0.2"] == "z" and named["9.0.0.1"] is None


def test_related_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"9.0.{i % 3}.{i}", "C", rng.choice([None, 0, 10, 90]), None, T0) for i in range(60)]
    intel = intel_rows(spark, rows)
    targets = spark.createDataFrame([(r[0],) for r in rows[:20]] + [("9.0.1.250",)], "target STRING")
    got = {}
    for r in enrich.related_ips(targets, intel, 4).orderBy("target", "rank").collect():
        got.setdefault(r.target, []).append(r.ip)
    score = {r[0]: -1 if r[2] is None else r[2] for r in rows}
    for target, ips in got.items():
        near = [ip for ip in score if ip.rsplit(".", 1)[0] == target.rsplit(".", 1)[0] and ip != target]
        assert ips == sorted(near, key=lambda ip: (-score[ip], ip))[:4]
    assert len(got) == 21


@pytest.fixture(scope="module")
def hunted(spark, make_events):
    ev = make_events([
        dict(src_ip="t", dst_ip="t", action="block", dst_port=22, src_port=9, protocol="TCP"),
        dict(src_ip="t", dst_ip="x", action="allow", dst_port=80, protocol="TCP"),
        dict(src_ip="y", dst_ip="t", event_type="threat", ids_signature="S", ids_classification="b"),
        dict(src_ip="y", dst_ip="t", event_type="threat", ids_signature="S", ids_classification="a"),
        dict(src_ip="y", dst_ip="z"),
    ])
    return ev, spark.createDataFrame([("t",), ("none",), ("t",)], "target STRING")


def test_dossier_counts_self_traffic_once(hunted):
    ev, targets = hunted
    one = lambda df: {r.target: r[1] for r in df.collect()}
    assert one(hunt.dossier_total(ev, targets)) == {"t": 4, "none": 0}
    assert one(hunt.dossier_targets_hit(ev, targets)) == {"t": 2, "none": 0}
    assert {(r.action, r["count"]) for r in hunt.dossier_by_action(ev, targets).collect()} == {("block", 1), ("allow", 1)}
    assert {(r.ip, r["count"]) for r in hunt.dossier_sources(ev, targets).collect()} == {("y", 2), ("t", 1)}
    sig = hunt.dossier_signatures(ev, targets).collect()
    assert [(r.ids_signature, r.ids_classification, r["count"]) for r in sig] == [("S", "a", 2)]


def test_long_target_lists_give_the_same_facts(hunted):
    ev, targets = hunted
    listed = targets.distinct()
    rows = lambda scope: sorted(map(str, hunt.dossier_facts(ev, scope).collect()))
    assert rows(hunt.Targets(listed, True)) == rows(hunt.Targets(listed, False))
    everyone = hunt.dossier_facts(ev, None, ("total",)).collect()
    assert {(r.target, r["count"]) for r in everyone} == {("t", 4), ("x", 1), ("y", 3), ("z", 1)}


def test_report_sections(spark, hunted):
    ev, targets = hunted
    intel = intel_rows(spark, [("t", "C", None, None, T0)])
    facts = hunt.dossier(ev, intel, targets)
    text = {r.target: r.report for r in hunt.dossier_report(facts).collect()}
    assert text["none"].splitlines() == [
        "## Target: none", "", "### Activity Summary", "- Total events: 0", "- First seen: N/A",
        "- Last seen: N/A", "- Unique targets hit: 0"]
    assert "- AbuseIPDB Score: Not scored/100" in text["t"]
    assert "### IDS/IPS Signatures Triggered\n- S (a): 2 events" in text["t"]
    assert "- First seen: 2024-01-10T00:00:00.000Z" in text["t"]


def test_nested_roundtrip_is_lossless(make_events):
    ev = make_events([
        dict(src_ip="a", src_port=0), dict(threat_type="x", event_type="threat"),
        dict(dhcp_interface="VLAN4", event_type="dhcp"), dict(wifi_ssid="s", event_type="client"),
        dict(src_geo_lat=0.0, dst_hostname="h"), {}])
    back = documents.from_nested(documents.to_nested(ev))
    assert back.columns == EVENT_COLUMNS
    key = lambda r: r.id
    assert sorted(back.collect(), key=key) == sorted(ev.select(*EVENT_COLUMNS).collect(), key=key)
    docs = {r.id: r for r in documents.to_nested(ev).collect()}
    assert docs[5].network is None and docs[0].network.src_port == 0 and docs[0].dns is None


def test_retention_rewrites_only_the_edge(spark, make_events, tmp_path):
    path = str(tmp_path / "ev")
    ev = make_events([dict(minute=i * 360) for i in range(40)])
    store.append_events(ev, path, bulk=True)
    as_of = T0 + dt.timedelta(days=10)
    want = sorted(r.id for r in store.apply_retention(ev, as_of, 6).collect())
    assert store.run_retention(spark, path, as_of + dt.timedelta(hours=7), 6) == 18
    left = sorted(r.id for r in store.read_events(spark, path).collect())
    assert left == list(range(18, 40)) and want[0] == 16
    assert store.run_retention(spark, path, as_of + dt.timedelta(hours=7), 6) == 0


def test_zero_fill(make_events):
    ev = make_events([dict(minute=0), dict(minute=50)])
    rows = stats.timeline(ev, T0, "15m", fill_until=T0 + dt.timedelta(minutes=60)).orderBy("ts").collect()
    assert [r.total for r in rows] == [1, 0, 0, 1, 0]


def test_sequence_is_dense(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), "id")
    rows = sequence_rows(df, ["a", "id"], "seq", 10).orderBy("a", "id").collect()
    assert [r.seq for r in rows] == list(range(11, 1011))


def test_share_and_markers(spark):
    df = spark.createDataFrame([("a", 4, 0, 1, 10), ("b", 2, 0, 0, 51), ("c", 1, 0, 0, None)],
                               "ip STRING, count BIGINT, threats BIGINT, blocked BIGINT, abuseScore INT")
    assert [r.share for r in stats.with_share(df).orderBy("ip").collect()] == [1.0, 0.5, 0.25]
    assert [r.marker for r in stats.with_markers(df).orderBy("ip").collect()] == ["blocked", "threat", "normal"]


# ---------------------------------------------------------------- the event store
def _hourly(spark, n, first_id=0, start="2024-01-01T00:30:00"):
    base = f"timestamp '{start}Z'"
    return complete(
        spark.range(n).selectExpr(
            f"id + {first_id} AS id", f"{base} + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS received_at",
            "'firewall' AS event_type", "concat('198.51.100.', id % 7) AS src_ip",
        )
    )


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo"])
def test_retention_counts_utc_days(spark, tmp_path, zone):
    path, before = str(tmp_path / "e"), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        store.append_events(_hourly(spark, 240), path, bulk=True)
        assert store.run_retention(spark, path, "2024-01-11T00:00:00Z", 5) == 120
        left = store.read_events(spark, path)
        assert left.count() == 120 and left.agg(F.min("id")).first()[0] == 120
        days = {str(r.event_date) for r in left.select("event_date").distinct().collect()}
        assert days == {f"2024-01-{d:02}" for d in range(6, 11)}
        assert store.run_retention(spark, path, "2024-01-11T00:00:00Z", 5) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_writers_share_a_table(spark, tmp_path):
    path = str(tmp_path / "e")
    store.append_events(_hourly(spark, 48), path, batch="stream-0")
    store.append_events(_hourly(spark, 48), path, batch="stream-0")
    store.append_events(_hourly(spark, 24, first_id=100), path, bulk=True)
    assert store.read_events(spark, path).count() == 72
    store.compact_day(spark, path, dt.date(2024, 1, 1))
    rows = store.read_events(spark, path)
    assert rows.count() == 72 and rows.filter("event_date = '2024-01-01'").count() == 48
    assert len(list((tmp_path / "e" / "event_date=2024-01-01").glob("gen=1/batch=*"))) == 1


def test_a_big_day_is_compacted_by_many_tasks(spark, tmp_path):
    path, day = str(tmp_path / "e"), dt.date(2024, 1, 1)
    store.append_events(_hourly(spark, 24), path, batch="a")
    store.append_events(_hourly(spark, 24, first_id=100), path, batch="b")
    sizes = {"advisoryPartitionSizeInBytes": "100b", "coalescePartitions.minPartitionSize": "1b"}
    for name, value in sizes.items():
        spark.conf.set(f"spark.sql.adaptive.{name}", value)
    try:
        store.compact_day(spark, path, day)
    finally:
        for name in sizes:
            spark.conf.unset(f"spark.sql.adaptive.{name}")
    assert len(list((tmp_path / "e" / f"event_date={day}").glob("gen=1/batch=*/*.parquet"))) > 1
    assert store.read_events(spark, path).count() == 48
    store.compact_day(spark, path, day)
    assert len(list((tmp_path / "e" / f"event_date={day}").glob("gen=2/batch=*/*.parquet"))) == 1


def _ids(spark, path):
    return sorted(r.id for r in store.read_events(spark, path).select("id").collect())


def test_a_replayed_batch_replaces_itself_after_a_rewrite(spark, tmp_path):
    path, day = str(tmp_path / "e"), dt.date(2024, 1, 1)
    for name, first in (("a", 0), ("b", 100)):
        store.append_events(_hourly(spark, 30, first_id=first), path, batch=name)
    want = [*range(30), *range(100, 130)]
    for _ in range(3):
        store.compact_day(spark, path, day)
        assert _ids(spark, path) == want
        store.append_events(_hourly(spark, 30), path, batch="a")  # the same epoch once more
        assert _ids(spark, path) == want
    store.append_events(_hourly(spark, 5, first_id=100), path, batch="b")  # replaced by fewer rows
    assert _ids(spark, path) == [*range(30), *range(100, 105), *range(124, 130)]
    store.compact_day(spark, path, day)
    store.clean_days(spark, path)
    assert _ids(spark, path) == [*range(30), *range(100, 105), *range(124, 130)]
    assert {p.parent.name for p in (tmp_path / "e" / f"event_date={day}").glob("gen=*/batch=*")} == {"gen=4"}


def test_batches_that_come_during_a_rewrite_count(spark, tmp_path, monkeypatch):
    path, day = str(tmp_path / "e"), dt.date(2024, 1, 1)
    store.append_events(_hourly(spark, 24), path, batch="a")
    before = store.read_events(spark, path)
    real = store._list

    def late(*args):
        store.append_events(_hourly(spark, 3, first_id=100), path, batch="new")
        assert _ids(spark, path) == [*range(24), 100, 101, 102]
        real(*args)
        assert _ids(spark, path) == [*range(5), 100, 101, 102]

    monkeypatch.setattr(store, "_list", late)
    store.rewrite_days(spark, path, [day], lambda ev: ev.filter("id < 5"))
    monkeypatch.undo()
    assert before.count() == 24  # who began to read before still can
    store.rewrite_days(spark, path, [day], lambda ev: ev.filter("id <> 101"))
    assert _ids(spark, path) == [*range(5), 100, 102]
    store.rewrite_days(spark, path, [day], lambda ev: ev.filter("id > 1000"))
    assert _ids(spark, path) == []
    store.append_events(_hourly(spark, 2, first_id=7), path, batch="a")
    assert _ids(spark, path) == [7, 8]


@pytest.mark.parametrize("step", ["write", "create", "rename", "second"])
def test_a_rewrite_may_be_killed_at_any_step(spark, tmp_path, monkeypatch, step):
    path, days = str(tmp_path / "e"), [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    store.append_events(_hourly(spark, 48), path, batch="a")
    real, calls = store._list, []

    def stop(spark_, path_, day):
        calls.append(day.day)
        if step == "second" and len(calls) == 1:
            return real(spark_, path_, day)
        if step == "rename":
            folder = tmp_path / "e" / f"event_date={day.day}" / f"gen={day.gen + 1}"
            (folder / "_batches.half").write_text("a")
        if step == "create":
            folder = tmp_path / "e" / f"event_date={day.day}" / f"gen={day.gen + 1}"
            (folder / "_batches").write_text("a")  # a list that was cut off
        raise RuntimeError("lost")

    def never(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_list", stop)
    if step == "write":
        monkeypatch.setattr(store, "_write", never)
    add = lambda ev: ev.withColumn("src_port", F.lit(9))
    with pytest.raises(RuntimeError):
        store.rewrite_days(spark, path, days, add)
    monkeypatch.undo()
    assert _ids(spark, path) == list(range(48))
    done = store.read_events(spark, path).filter("src_port = 9").count()
    assert done == (24 if step == "second" else 0)
    store.append_events(_hourly(spark, 48), path, batch="a")
    assert _ids(spark, path) == list(range(48))
    store.rewrite_days(spark, path, days, add)
    assert _ids(spark, path) == list(range(48))
    assert store.read_events(spark, path).filter("src_port = 9").count() == 48
    store.clean_days(spark, path)
    assert _ids(spark, path) == list(range(48))


def test_backfill_rewrites_lacking_days_in_one_job(spark, tmp_path):
    path = str(tmp_path / "e")
    ev = _hourly(spark, 96).withColumn("src_ip", F.when(F.col("id") < 72, F.col("src_ip")).otherwise("10.0.0.1"))
    store.append_events(ev, path, bulk=True)
    intel = spark.createDataFrame(
        [("198.51.100.3", "AA"), ("198.51.100.4", "BB")], "ip STRING, geo_country STRING"
    )
    intel = intel.select(*[
        (F.col(f.name) if f.name in intel.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in INTEL_SCHEMA.fields
    ])
    want = store.read_events(spark, path).filter("src_ip IN ('198.51.100.3', '198.51.100.4')")
    ids = sorted(r.id for r in want.select("id").collect())
    assert enrich.run_backfill(spark, path, intel, 2) == [dt.date(2024, 1, d) for d in (1, 2, 3)]
    rows = store.read_events(spark, path).filter("src_geo_country IS NOT NULL").collect()
    newest = [i for r in (3, 4) for i in [k for k in ids if k % 7 == r][-2:]]
    assert sorted(r.id for r in rows) == sorted(newest)  # the cap counts an address over all days
    assert enrich.run_backfill(spark, path, intel) == [dt.date(2024, 1, d) for d in (1, 2, 3)]
    assert enrich.run_backfill(spark, path, intel) == []
    rows = store.read_events(spark, path).filter("src_geo_country IS NOT NULL").collect()
    assert sorted(r.id for r in rows) == ids and _ids(spark, path) == list(range(96))


def test_newest_row_decides_on_equal_times(make_events):
    rows = make_events([
        dict(id=100, minute=11, src_ip="198.51.100.1", message="A"),
        dict(id=5, minute=12, src_ip="198.51.100.1", message="A"),
        dict(id=10, minute=12, src_ip="198.51.100.1", message="B"),
        dict(id=-3, minute=12, src_ip="198.51.100.1", message="C"),
    ])
    (got,) = aggregate_with_latest(rows, ["src_ip"], ["message"]).collect()
    assert (got.message, got["count"]) == ("B", 4)


def test_other_addresses_lie_in_no_range(spark):
    ips = spark.range(500).selectExpr("CASE WHEN id = 0 THEN '11.0.0.5' ELSE concat('fd00::', id) END AS ip")
    ranges = spark.createDataFrame([(11 << 24, (11 << 24) + 9, "X")], "start_ip LONG, end_ip LONG, country STRING")
    got = {r.ip: r.country for r in enrich.range_lookup(ips, ranges).collect()}
    assert len(got) == 500 and {ip for ip, c in got.items() if c} == {"11.0.0.5"}


def test_short_target_lists_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "e")
    store.append_events(_hourly(spark, 240), path, bulk=True)
    ev = store.read_events(spark, path)
    targets = spark.createDataFrame([("198.51.100.3",), (None,), ("no",)], "target STRING")
    facts = hunt.dossier_facts(ev, targets, ("total",), since="2024-01-05T00:00:00Z")
    (scan,) = re.findall(r"FileScan parquet.*", facts._jdf.queryExecution().executedPlan().toString())
    assert "src_ip" in scan.split("DataFilters:")[1] and "event_date" in scan.split("PartitionFilters:")[1]
    assert re.search(r"src_ip#\d+ IN|src_ip#\d+ =", scan)
    (row,) = facts.collect()
    assert row["count"] == ev.filter("src_ip = '198.51.100.3' AND received_at >= '2024-01-05'").count()
    none = hunt.dossier_facts(ev, targets.filter("target = 'x'"), ("total",))
    assert none.count() == 0


def test_row_limits_have_a_default_and_a_maximum():
    from netlantern.plans.topk import row_limit

    assert [row_limit(x, 10) for x in (None, "", 3, "7")] == [10, 10, 3, 7]
    assert row_limit(500, 10, 500) == 500 and row_limit(None, 10, 500) == 10
    with pytest.raises(ValueError, match="at most 500"):
        row_limit(501, 10, 500)
