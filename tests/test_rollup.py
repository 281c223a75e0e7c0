"""Stored summaries: same rows as the whole log, whatever was summarised, and what they save."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from netlantern.operators import rollup, stats
from netlantern.sources import store, summaries
from tests.conftest import T0


def _log(make_events, n=400, seed=3):
    rng = random.Random(seed)
    kinds = ["firewall", "firewall", "threat", "dns", "wifi"]
    rows = []
    for i in range(n):
        src = rng.choice([f"198.51.100.{rng.randrange(40)}", "198.51.100.7", "10.1.2.3", "fd00::1", "01.2.3.4", None])
        rows.append(
            dict(
                minute=rng.randrange(9 * 1440), event_type=rng.choice(kinds), src_ip=src,
                action=rng.choice(["allow", "block", None]), dst_ip=f"203.0.113.{rng.randrange(9)}",
                dst_port=rng.choice([22, 53, 443, None]), protocol=rng.choice(["tcp", None]),
                src_geo_country=rng.choice(["AA", "BB", None]), src_abuse_score=rng.choice([0, 1, 50, 77, None]),
                ids_signature=rng.choice(["s1", "s2", "s3"]), ids_classification=rng.choice(["c", "d"]),
            )
        )
    return make_events(rows)


SINCES = [T0, T0 + dt.timedelta(days=3, hours=5, minutes=7)]


def _same(a, b):
    rows = lambda df: sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=str)
    assert rows(a) == rows(b)


def _all(spark, path, ev, since):
    counted = rollup.slots(spark, path, since)
    _same(rollup.overview(counted), stats.overview(ev, since))
    _same(rollup.timeline(counted, "15m"), stats.timeline(ev, since, "15m"))
    _same(rollup.timeline_firewall(counted, "1h"), stats.timeline_firewall(ev, since, "1h"))
    _same(rollup.top(spark, path, rollup.TALKERS["src"], since, 5), stats.top_talkers(ev, since, "src", 5))
    _same(rollup.top(spark, path, rollup.THREATS, since, 2), stats.top_threats(ev, since, 2))
    _same(rollup.period_summary(spark, path, since), stats.period_summary(ev, since))


@pytest.mark.parametrize("since", SINCES)
def test_summaries_answer_as_the_log(spark, make_events, tmp_path, since):
    """Before any summary, with some, after a batch was written again, and after days were merged."""
    path, ev = str(tmp_path / "e"), _log(make_events)
    store.append_events(ev.filter("id % 3 > 0"), path, batch="a")
    rollup.refresh_all(spark, path)
    assert summaries.refresh(spark, path, rollup.SLOTS) == 0
    store.append_events(ev.filter("id % 3 = 0"), path, batch="b")
    whole = store.read_events(spark, path)
    _all(spark, path, whole, since)
    store.compact_day(spark, path, (T0 + dt.timedelta(days=4)).date())
    store.append_events(ev.filter("id % 3 = 0 AND id % 5 > 0"), path, batch="b")
    _same(rollup.overview(rollup.slots(spark, path, since)), stats.overview(store.read_events(spark, path), since))
    rollup.refresh_all(spark, path)
    _all(spark, path, store.read_events(spark, path), since)


def test_overview_of_closed_days_reads_no_event(spark, make_events, tmp_path):
    path, ev = str(tmp_path / "e"), _log(make_events, 100)
    store.append_events(ev, path, bulk=True)
    rollup.refresh_all(spark, path)
    for answer in (
        rollup.overview(rollup.slots(spark, path, T0)),
        rollup.period_summary(spark, path, T0),
        rollup.top(spark, path, rollup.TALKERS["src"], T0),
    ):
        files = {f for line in answer.inputFiles() for f in re.findall(r"/e[^/]*/", line)}
        assert files and all(f.startswith("/e-") for f in files)


@pytest.mark.parametrize("thin", [False, True])
def test_rankings_stop_early_and_are_exact(spark, make_events, tmp_path, thin):
    """Winners spread thin over days are found; where some stand out, few rows are looked at."""
    path, rng, rows = str(tmp_path / "e"), random.Random(1), []
    for day in range(6):
        for host in range(150):
            times = 1 + (host % 10 == 7) if thin else 40 if host < 3 else 1
            times += day == 0 and thin and host == 5 and 4
            rows += [
                dict(minute=day * 1440 + rng.randrange(1440), src_ip=f"198.51.100.{host}") for _ in range(times)
            ]
    store.append_events(make_events(rows), path, bulk=True)
    lists = summaries.partials(spark, path, rollup.TALKERS["src"].kind, T0)
    found, reading = rollup.ranked(lists, rollup.TALKERS["src"], 3)
    _same(found, stats.top_talkers(store.read_events(spark, path), T0, "src", 3))
    assert reading.of == 900 and (thin or reading.rows == 18)


def test_odd_addresses_count_as_written(spark, make_events, tmp_path):
    path = str(tmp_path / "e")
    ips = ["1.2.3.4", "01.2.3.4", "0.0.0.0", "255.255.255.255", "fd00::1", "1.2.3", "0.0.128.0", "0.0.128.1"]
    rows = [dict(src_ip=ip, src_geo_country="AA", src_abuse_score=60) for ip in ips * 2]
    store.append_events(make_events(rows), path, bulk=True)
    (got,) = rollup.period_summary(spark, path, T0).collect()
    assert (got.enriched, got.flagged, got.highThreat, got.countries) == (8, 8, 8, 1)
    assert summaries.partials(spark, path, rollup.HOSTS).filter(F.col("bits").isNotNull()).count() > 0


@pytest.mark.parametrize("asked", [dict(), dict(event_type="firewall", action="block")])
def test_deep_pages_read_their_slots_only(spark, make_events, tmp_path, asked):
    path, ev = str(tmp_path / "e"), _log(make_events, 300)
    store.append_events(ev, path, bulk=True)
    rollup.refresh_all(spark, path)
    every = [r for r in store.read_events(spark, path).collect()
             if all(r[k] == v for k, v in asked.items())]
    every.sort(key=lambda r: (r.received_at, r.id), reverse=True)
    for offset in (0, 7, len(every) - 5, len(every) + 3):
        page = rollup.page_at(spark, path, 10, offset, **asked)
        assert [r.id for r in page.collect()] == [r.id for r in every[offset : offset + 10]]
    page = rollup.page_at(spark, path, 5, len(every) // 2, **asked)
    (scan,) = re.findall(r"FileScan parquet.*", page._jdf.queryExecution().executedPlan().toString())
    assert "event_date" in scan.split("PartitionFilters:")[1].split("]")[0]


def test_days_of_an_address(spark, make_events, tmp_path):
    path = str(tmp_path / "e")
    rows = [dict(minute=1440 * d, src_ip=f"198.51.100.{d}", mac_src=f"02:00:00:00:00:0{d % 3}") for d in range(6)]
    store.append_events(make_events(rows), path, bulk=True)
    rollup.refresh_all(spark, path)
    of = lambda *names: rollup.days_of(
        spark, path, spark.createDataFrame([(n,) for n in names], "address string")
    )
    first = T0.date()
    day = lambda n: first + dt.timedelta(days=n)
    assert of("198.51.100.2") == [day(2)] and of("no") == [] == of(None)
    assert of("02:00:00:00:00:01", "198.51.100.0") == [day(0), day(1), day(4)]
