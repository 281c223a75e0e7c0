"""Dashboard aggregates (A, U)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netlantern.functions import net
from netlantern.functions.times import (
    DEFAULT_BUCKET,
    bucket,
    bucket_width,
    instant,
    parse_instant,
)
from netlantern.operators.events import exclude_private as drop_private
from netlantern.operators.events import geo_present, latest, since_filter
from netlantern.plans.topk import aggregate_with_latest, row_limit, top_k, top_k_per
from netlantern.schema import TIMELINE_TYPES

Moment = dt.datetime | str

# Rows of a report when no limit is given.
TOP_LIMIT, INTEL_LIMIT, GEO_LIMIT, RECENT_GEO_LIMIT = 10, 50, 500, 50


def is_type(name: str) -> Column:
    return F.col("event_type") == name


def was(action: str) -> Column:
    return F.coalesce(F.col("action") == action, F.lit(False))


# ---------------------------------------------------------------- counts
def event_count(ev: DataFrame) -> DataFrame:
    return ev.agg(F.count("*").alias("count"))


def start_of_day(as_of: Moment) -> dt.datetime:
    return parse_instant(as_of).replace(hour=0, minute=0, second=0, microsecond=0)


def count_today(ev: DataFrame, as_of: Moment, tz: str = "UTC") -> DataFrame:
    """Events received since midnight of ``as_of`` in a time zone."""
    local_midnight = F.date_trunc("day", F.from_utc_timestamp(instant(as_of), tz))
    midnight = F.to_utc_timestamp(local_midnight, tz)
    return ev.filter(F.col("received_at") >= midnight).agg(F.count("*").alias("count"))


def last_event_time(ev: DataFrame) -> DataFrame:
    return ev.agg(F.max("received_at").alias("last_event_at"))


def type_counts(ev: DataFrame, since: Moment | None = None) -> DataFrame:
    return since_filter(ev, since).groupBy("event_type").agg(F.count("*").alias("count"))


def overview(ev: DataFrame, since: Moment) -> DataFrame:
    """One row of totals, in one pass (A5); the counts by type are :func:`type_counts`."""
    return since_filter(ev, since).agg(
        F.count("*").alias("total"),
        F.count_if(is_type("firewall") & was("allow")).alias("allowed"),
        F.count_if(is_type("firewall") & was("block")).alias("blocked"),
        F.count_if(is_type("threat")).alias("threats"),
    )


def status_summary(ev: DataFrame, as_of: Moment) -> DataFrame:
    """Total, today, last event and counts by type in one pass (M2), one row per type."""
    today = F.col("received_at") >= instant(start_of_day(as_of))
    by_type = ev.groupBy("event_type").agg(
        F.count("*").alias("count"),
        F.count_if(today).alias("today"),
        F.max("received_at").alias("last_event_at"),
    )
    # At most one row per event type goes on, so the sums over all types are small work.
    listed = F.array_sort(F.collect_list(F.struct("event_type", "count")))
    return by_type.agg(
        F.sum("count").alias("events_total"),
        F.sum("today").alias("events_today"),
        F.max("last_event_at").alias("last_event_at"),
        listed.alias("_types"),
    ).select(
        "events_total",
        "events_today",
        "last_event_at",
        F.explode("_types").alias("_t"),
    ).select("events_total", "events_today", "last_event_at", "_t.event_type", "_t.count")


# ---------------------------------------------------------------- timelines
def _all_buckets(spark, since: Moment, until: Moment, width: str) -> DataFrame:
    first = bucket(instant(since), width)
    last = bucket(instant(until), width)
    step = F.expr(f"INTERVAL {bucket_width(width)}")
    return (
        spark.range(1)
        .select(first.alias("a"), F.lit(1).alias("one"))
        .withColumn("b", last)
        .select(F.explode(F.sequence("a", "b", step)).alias("ts"))
    )


def _bucketed(
    ev: DataFrame, since: Moment, width: str, measures: dict[str, Column], until: Moment | None
) -> DataFrame:
    counted = (
        since_filter(ev, since)
        .groupBy(F.window("received_at", bucket_width(width)).getField("start").alias("ts"))
        .agg(*[F.count_if(m).alias(n) for n, m in measures.items()])
    )
    if until is None:
        return counted
    filled = _all_buckets(ev.sparkSession, since, until, width).join(counted, "ts", "left")
    return filled.select("ts", *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])


def timeline(
    ev: DataFrame, since: Moment, bucket: str = DEFAULT_BUCKET, fill_until: Moment | None = None
) -> DataFrame:
    """Events per bucket: one column per charted type, and the total of all types.

    With ``fill_until``, buckets without events up to that time appear with zeros (A6a).
    """
    measures = {t: is_type(t) for t in TIMELINE_TYPES}
    return _bucketed(ev, since, bucket, {**measures, "total": F.lit(True)}, fill_until)


def timeline_firewall(
    ev: DataFrame, since: Moment, bucket: str = DEFAULT_BUCKET, fill_until: Moment | None = None
) -> DataFrame:
    """Allowed and blocked firewall events per bucket."""
    measures = {"allowed": was("allow"), "blocked": was("block")}
    return _bucketed(ev.filter(is_type("firewall")), since, bucket, measures, fill_until)


# ---------------------------------------------------------------- rankings
def _side(
    ev: DataFrame, since: Moment, direction: str, public_only: bool, names: dict[str, str]
) -> DataFrame:
    """Events of a period with the address of one side as ``ip`` and its facts renamed."""
    side = "dst" if direction == "dst" else "src"
    rows = since_filter(ev, since).select(
        F.col(f"{side}_ip").alias("ip"),
        "id",
        "received_at",
        "event_type",
        "action",
        *[F.col(f"{side}_{fact}").alias(name) for name, fact in names.items()],
    )
    rows = rows.filter(F.col("ip").isNotNull())
    return drop_private(rows, "ip") if public_only else rows


def top_talkers(
    ev: DataFrame,
    since: Moment,
    direction: str = "src",
    limit: int | None = None,
    exclude_private: bool = False,
) -> DataFrame:
    """Addresses with the most events, with country and host of their newest event."""
    names = {"country": "geo_country", "hostname": "hostname"}
    rows = _side(ev, since, direction, exclude_private, names)
    ranked = aggregate_with_latest(rows, ["ip"], list(names))
    return top_k(ranked, row_limit(limit, TOP_LIMIT), ["ip"]).select(
        "ip", "count", "lastSeen", "country", "hostname"
    )


def top_blocked(
    ev: DataFrame,
    since: Moment,
    direction: str = "src",
    limit: int | None = None,
    exclude_private: bool = False,
) -> DataFrame:
    """Addresses with the most blocked events."""
    names = {"country": "geo_country", "abuseScore": "abuse_score", "hostname": "hostname"}
    rows = _side(ev.filter(F.col("action") == "block"), since, direction, exclude_private, names)
    ranked = aggregate_with_latest(rows, ["ip"], list(names))
    return top_k(ranked, row_limit(limit, TOP_LIMIT), ["ip"]).select(
        "ip", "count", "lastSeen", "country", "abuseScore", "hostname"
    )


def top_ports(ev: DataFrame, since: Moment, limit: int | None = None) -> DataFrame:
    """Destination ports with the most events, by protocol (A10)."""
    counts = (
        since_filter(ev, since)
        .filter(F.col("dst_port").isNotNull())
        .groupBy(F.col("dst_port").alias("port"), "protocol")
        .agg(F.count("*").alias("count"))
    )
    return top_k(counts, row_limit(limit, TOP_LIMIT), ["port", "protocol"])


def top_clients(ev: DataFrame, since: Moment, limit: int | None = None) -> DataFrame:
    """Clients with the most events, by their first known MAC.

    Counted first per (MAC, alias, address) by hash aggregation; the highest alias and address,
    which need a sort-based aggregate, are taken from that smaller result.
    """
    rows = since_filter(ev, since).select(
        F.coalesce("client_mac", "wifi_client_mac", "dhcp_mac").alias("mac"),
        F.col("client_alias").alias("alias"),
        F.coalesce("client_ip", "dhcp_ip", "src_ip").alias("ip"),
        "event_type",
    )
    parts = (
        rows.filter(F.col("mac").isNotNull())
        .groupBy("mac", "alias", "ip")
        .agg(
            F.count("*").alias("eventCount"),
            F.count_if(is_type("wifi")).alias("wifiEvents"),
            F.count_if(is_type("dhcp")).alias("dhcpEvents"),
            F.count_if(is_type("firewall")).alias("firewallEvents"),
        )
    )
    counts = ["eventCount", "wifiEvents", "dhcpEvents", "firewallEvents"]
    clients = parts.groupBy("mac").agg(
        F.max("alias").alias("alias"),
        F.max("ip").alias("ip"),
        *[F.sum(c).alias(c) for c in counts],
    )
    return top_k(clients, row_limit(limit, TOP_LIMIT), ["mac"], count="eventCount")


def top_threats(ev: DataFrame, since: Moment, limit: int | None = None) -> DataFrame:
    """Signatures with the most hits, with the classification of the newest hit."""
    rows = (
        since_filter(ev, since)
        .filter(is_type("threat") & F.col("ids_signature").isNotNull())
        .select(
            F.col("ids_signature").alias("signature"),
            F.col("ids_classification").alias("classification"),
            "id",
            "received_at",
        )
    )
    ranked = aggregate_with_latest(rows, ["signature"], ["classification"])
    return top_k(ranked, row_limit(limit, TOP_LIMIT), ["signature"]).select(
        "signature", "classification", "count", "lastSeen"
    )


# ---------------------------------------------------------------- address intelligence
INTEL_NAMES = {
    "country": "geo_country",
    "city": "geo_city",
    "lat": "geo_lat",
    "lon": "geo_lon",
    "abuse_score": "abuse_score",
    "hostname": "hostname",
}


def both_sides(ev: DataFrame, names: dict[str, str], *carry: str) -> DataFrame:
    """Each event once per side, with that side's address as ``ip`` and its facts renamed.

    One scan: the two sides are exploded rather than read twice and united (U1, U2).
    """

    def one(side: str) -> Column:
        return F.struct(
            F.col(f"{side}_ip").alias("ip"),
            *[F.col(f"{side}_{fact}").alias(name) for name, fact in names.items()],
        )

    return ev.select(*carry, F.explode(F.array(one("src"), one("dst"))).alias("_s")).select(
        *carry, "_s.*"
    )


def _enriched_sides(ev: DataFrame, since: Moment, names: dict[str, str], *carry: str) -> DataFrame:
    rows = both_sides(since_filter(ev, since), names, *carry)
    return rows.filter(
        F.col("ip").isNotNull()
        & (F.col("country").isNotNull() | F.col("abuse_score").isNotNull())
    )


def enriched_addresses(ev: DataFrame, since: Moment) -> DataFrame:
    """All enriched addresses with their activity on either side, in no order."""
    rows = _enriched_sides(ev, since, INTEL_NAMES, "id", "received_at", "event_type", "action")
    ranked = aggregate_with_latest(
        rows,
        ["ip"],
        list(INTEL_NAMES),
        {"blocked_count": was("block"), "threat_count": is_type("threat")},
    )
    return ranked.withColumnRenamed("count", "event_count").select(
        "ip", *INTEL_NAMES, "event_count", "blocked_count", "threat_count", "lastSeen"
    )


def threat_intel(ev: DataFrame, since: Moment, limit: int | None = None) -> DataFrame:
    """Enriched addresses by activity on either side (A13), then by abuse score."""
    order = (F.desc("event_count"), F.desc_nulls_last("abuse_score"), F.asc("ip"))
    return enriched_addresses(ev, since).orderBy(*order).limit(row_limit(limit, INTEL_LIMIT))


def intel_summary(intel: DataFrame) -> DataFrame:
    """Totals over the intelligence table, expired rows included."""
    return intel.filter(~F.coalesce("is_private", F.lit(False))).agg(
        F.count("*").alias("totalEnriched"),
        F.count_if(F.col("abuse_score") > 0).alias("withAbuseScore"),
        F.count_if(F.col("abuse_score") >= 50).alias("highThreat"),
        F.count_distinct("geo_country").alias("countries"),
    )


def period_summary(ev: DataFrame, since: Moment, approximate: bool = False) -> DataFrame:
    """Distinct enriched, flagged and high-threat addresses and countries of a period.

    ``approximate`` replaces the exact distinct counts by sketches, for very long logs.
    """
    names = {"abuse_score": "abuse_score", "country": "geo_country"}
    facts = _enriched_sides(ev, since, names)
    if not approximate:
        facts = facts.distinct()
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return facts.agg(
        distinct("ip").alias("enriched"),
        distinct(F.when(F.col("abuse_score") > 0, F.col("ip"))).alias("flagged"),
        distinct(F.when(F.col("abuse_score") >= 50, F.col("ip"))).alias("highThreat"),
        distinct("country").alias("countries"),
    )


# ---------------------------------------------------------------- map
GEO_COLUMNS = (
    "ip country city lat lon abuseScore count blocked threats lastSeen direction"
).split()
RECENT_GEO_COLUMNS = (
    "id event_type action received_at src_ip src_geo_lat src_geo_lon src_geo_country "
    "src_geo_city src_abuse_score dst_ip dst_geo_lat dst_geo_lon dst_geo_country dst_geo_city "
    "dst_abuse_score message dst_port protocol"
).split()


GEO_FACTS = {
    "country": "geo_country",
    "city": "geo_city",
    "lat": "geo_lat",
    "lon": "geo_lon",
    "abuseScore": "abuse_score",
}


def located_addresses(ev: DataFrame, since: Moment) -> DataFrame:
    """Every located address of each side with its activity (U3), from one scan."""
    measures = {"blocked": was("block"), "threats": is_type("threat")}
    needed = ["id", "received_at", "action", "event_type"]
    ends = [
        F.struct(
            F.lit(side).alias("direction"),
            F.col(f"{side}_ip").alias("ip"),
            *[F.col(f"{side}_{c}").alias(n) for n, c in GEO_FACTS.items()],
        )
        for side in ("src", "dst")
    ]
    rows = since_filter(ev, since).select(*needed, F.explode(F.array(*ends)).alias("end"))
    rows = rows.select(*needed, "end.*").filter(
        F.col("ip").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )
    ranked = aggregate_with_latest(rows, ["direction", "ip"], list(GEO_FACTS), measures)
    return ranked.select(*GEO_COLUMNS)


def geo_events(ev: DataFrame, since: Moment, limit: int | None = None) -> DataFrame:
    """Located addresses of each side, half of the limit for each."""
    half = -(-row_limit(limit, GEO_LIMIT) // 2)
    best = top_k_per(located_addresses(ev, since), half, ["direction"], ["ip"])
    return best.select(*GEO_COLUMNS)


def recent_geo_events(ev: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest events with a located end."""
    located = geo_present(ev).select(*RECENT_GEO_COLUMNS)
    return latest(located, row_limit(limit, RECENT_GEO_LIMIT))


def geo_overlay(geo: DataFrame) -> DataFrame:
    """Totals shown over the map, private addresses left out."""
    return drop_private(geo, "ip").agg(
        F.count("*").alias("ips"),
        F.count_if(F.col("threats") > 0).alias("threat_ips"),
        F.count_if(F.col("blocked") > 0).alias("blocked_ips"),
        F.count_distinct(F.nullif("country", F.lit(""))).alias("countries"),
    )


def with_markers(geo: DataFrame) -> DataFrame:
    """Map marker class and size of each located address."""
    return geo.withColumns(
        {
            "marker": net.marker_class(F.col("threats"), F.col("blocked"), F.col("abuseScore")),
            "size": net.marker_size(F.col("count")),
        }
    )


def flow_lines(ev: DataFrame, limit: int = 30) -> DataFrame:
    """The newest events with both ends located, and how their line is drawn."""
    ends = ["src_geo_lat", "src_geo_lon", "dst_geo_lat", "dst_geo_lon"]
    located = ev.dropna(subset=ends).select("id", "received_at", "event_type", "action", *ends)
    return latest(located, limit).withColumn(
        "line", net.flow_class(F.col("event_type"), F.col("action"))
    )


def with_share(df: DataFrame, count: str = "count") -> DataFrame:
    """Each row's count relative to the highest one."""
    # The rows of a report: as many as its limit.
    top = F.max(count).over(W.partitionBy())
    return df.withColumn("share", F.col(count) / top)


def with_port_name(df: DataFrame, port: str = "port") -> DataFrame:
    """Well-known service name of a port, or NULL."""
    return df.withColumn("port_name", net.port_name(F.col(port)))
