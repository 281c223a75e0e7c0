"""The registered queries: each one a Spark callable and, where SQL can say it, checking SQL.

Both sides start from the driver's tables. Spark renders the log, parses it and runs the operator;
the SQL computes the event columns from the formulas and states the question again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netlantern.functions import net, times
from netlantern.operators import enrich, events, hunt, parse, rollup, stats
from netlantern.plans.sizing import fresh_path
from netlantern.plans.topk import top_k_per
from netlantern.schema import EVENT_COLUMNS, INTEL_SCHEMA, PARSED_COLUMNS, PORT_NAMES
from netlantern.sources import documents, lines, store
from netlantern.sources.intel import append_intel, usable_intel
from netlantern.streaming import feed
from workload import oracle, shapes, tables
from workload.tables import AS_OF, SINCE_7D, SINCE_30D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_times(df: DataFrame) -> DataFrame:
    """Times without zone (UTC), as the checking engine returns them."""
    return df.select(
        *[
            F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def register(name: str, sql: str | None = None, *ctes: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: plain_times(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = oracle.query(sql, *ctes)
        return fn

    return add


def register_again(name: str, other: str):
    """A query that must give the rows of another one."""

    def add(fn: Query) -> Query:
        register(name)(fn)
        ORACLES[name] = ORACLES[other]
        return fn

    return add


def ts(value: str) -> str:
    return f"TIMESTAMP '{value}'"


SINCE = f"received_at >= {ts(SINCE_30D)}"
SINCE7 = f"received_at >= {ts(SINCE_7D)}"
BRIEF = "id, received_at, event_type, action, src_ip, dst_ip, message"
BRIEF_COLUMNS = BRIEF.split(", ")



# ================================================================ sources and sinks (S)
@register(
    "s1_lines",
    "SELECT raw, 2 * count(*) AS lines, 2 * count(*) AS ids FROM lines GROUP BY raw",
    "lines",
)
def _(spark, sf):
    """Every line twice, with blanks around it and a blank line between."""
    path = fresh_path(spark, "text")
    padded = F.concat(F.lit("  "), "raw", F.lit("\t "))
    twice = tables.lines(spark, sf).select(
        F.explode(F.array(padded, F.lit("   "), padded)).alias("value")
    )
    twice.write.text(path)
    found = parse.with_ids(lines.read_lines(spark, path))
    return found.groupBy("raw").agg(
        F.count("*").alias("lines"), F.count_distinct("id").alias("ids")
    )


@register(
    "s2_append",
    "SELECT strftime(received_at, '%Y-%m-%d') AS event_date, event_type, count(*) AS count "
    "FROM parsed GROUP BY ALL",
    "parsed",
)
def _(spark, sf):
    path = fresh_path(spark, "append")
    store.append_events(tables.parsed(spark, sf), path, bulk=True)
    return (
        store.read_events(spark, path)
        .groupBy(F.col("event_date").cast("string").alias("event_date"), "event_type")
        .agg(F.count("*").alias("count"))
    )


@register(
    "s3_raw",
    "SELECT id, raw AS kept, CAST(NULL AS VARCHAR) AS dropped FROM lines",
    "lines",
)
def _(spark, sf):
    ev = tables.parsed(spark, sf)
    kept = store.with_raw(ev, keep=True).select("id", F.col("raw_message").alias("kept"))
    dropped = store.with_raw(kept.withColumnRenamed("kept", "raw_message").withColumn(
        "kept", F.col("raw_message")))
    return dropped.select("id", "kept", F.col("raw_message").alias("dropped"))


@register(
    "s4_scan",
    "SELECT id, received_at, event_type, hostname FROM ev WHERE received_at >= "
    f"{ts(SINCE_7D)} AND received_at <= TIMESTAMP '2024-01-28 12:00:00'",
    "ev",
)
def _(spark, sf):
    ev = tables.events(spark, sf)
    days = events.until_filter(events.since_filter(ev, SINCE_7D), "2024-01-28 12:00:00")
    return days.select("id", "received_at", "event_type", "hostname")


_TRIGGERS = {
    name: " OR ".join(f"{c} IS NOT NULL" for c in trigger)
    for name, (_, trigger) in documents.SUBDOCUMENTS.items()
}


@register(
    "s5_to_nested",
    "SELECT id, event_type, "
    + ", ".join(f"({t}) AS has_{n}" for n, t in _TRIGGERS.items())
    + ", src_ip AS network_src_ip, threat_type AS ids_threat_type, dhcp_interface, "
    "src_geo_country, dst_abuse_score FROM ev",
    "ev",
)
def _(spark, sf):
    docs = documents.to_nested(tables.events(spark, sf))
    return docs.select(
        "id",
        "event_type",
        *[F.col(n).isNotNull().alias(f"has_{n}") for n in documents.SUBDOCUMENTS],
        F.col("network.src_ip").alias("network_src_ip"),
        F.col("ids.threat_type").alias("ids_threat_type"),
        F.col("dhcp.interface").alias("dhcp_interface"),
        F.col("enrichment.src.geo_country").alias("src_geo_country"),
        F.col("enrichment.dst.abuse_score").alias("dst_abuse_score"),
    )


@register("s6_roundtrip", f"SELECT {', '.join(EVENT_COLUMNS)} FROM ev", "ev")
def _(spark, sf):
    return documents.from_nested(documents.to_nested(tables.events(spark, sf)))


@register("s7_usable_intel", "SELECT * FROM usable", "usable")
def _(spark, sf):
    return usable_intel(tables.intel(spark, sf))


_SUBS = ", ".join(
    f"('{name}', {[*kinds] or 'CAST([] AS VARCHAR[])'}, "
    + (f"'{action}'" if action else "CAST(NULL AS VARCHAR)") + ")"
    for name, kinds, action in tables.SUBSCRIPTIONS
)
FEED = (
    f"SELECT s.sub_id, p.id, p.received_at, p.event_type FROM parsed p JOIN (VALUES {_SUBS}) "
    "AS s(sub_id, types, action) ON (len(s.types) = 0 OR list_contains(s.types, p.event_type)) "
    "AND (s.action IS NULL OR s.action = p.action)"
)


@register(
    "s8_live",
    "SELECT row_number() OVER (ORDER BY received_at, id, sub_id) AS seq, sub_id, id "
    f"FROM ({FEED}) AS f",
    "parsed",
)
def _(spark, sf):
    path, state = fresh_path(spark, "feed"), fresh_path(spark, "state")
    stream = lines.stream_lines(spark, "parquet", {"path": tables.arrivals(spark, sf)})
    query = feed.live_feed(
        feed.parsed_stream(stream), tables.subscriptions(spark), path, state, every=None
    )
    query.awaitTermination()
    return spark.read.parquet(path).select("seq", "sub_id", "id")


@register(
    "s8_batches",
    f"SELECT count(*) AS rows, 1 AS first, count(*) AS last, count(*) AS numbers FROM ({FEED}) AS f",
    "parsed",
)
def _(spark, sf):
    """The feed over several batches: its numbers have no gap and none comes twice."""
    path, state = fresh_path(spark, "feed"), fresh_path(spark, "state")
    options = {"path": tables.arrivals(spark, sf), "maxFilesPerTrigger": "6"}
    stream = feed.parsed_stream(lines.stream_lines(spark, "parquet", options))
    feed.live_feed(stream, tables.subscriptions(spark), path, state, every=None).awaitTermination()
    return spark.read.parquet(path).agg(
        F.count("*").alias("rows"),
        F.min("seq").cast("int").alias("first"),
        F.max("seq").alias("last"),
        F.count_distinct("seq").alias("numbers"),
    )


# ================================================================ parse job (P)
@register("p1_header", "SELECT * FROM header", "header")
def _(spark, sf):
    return parse.with_header(tables.lines(spark, sf)).select(
        "id", "priority", "severity", "timestamp", "hostname", "mac_model", "message"
    )


@register(
    "p2_router",
    "SELECT id, CASE WHEN source_format IN ('cef', 'coredns') THEN source_format "
    "WHEN source_format = 'iptables' THEN 'firewall' WHEN source_format = 'suricata' THEN 'ids' "
    "WHEN source_format = 'dhcp-relay' THEN 'relay' WHEN source_format = 'hostapd' THEN 'wifi' "
    "ELSE event_type END AS fmt FROM parsed",
    "parsed",
)
def _(spark, sf):
    routed = parse.with_format(parse.with_header(tables.lines(spark, sf)))
    return routed.select("id", "fmt")


def _parse_query(name: str, columns: str, condition: str) -> None:
    head = "id, event_type, severity, hostname, timestamp, source_format, message"

    @register(name, f"SELECT {head}, {columns} FROM parsed WHERE {condition}", "parsed")
    def _(spark, sf):
        chosen = tables.parsed(spark, sf).filter(condition)
        return chosen.select(*head.split(", "), *columns.split(", "))


_parse_query(
    "p3_firewall",
    "action, direction, interface_in, interface_out, protocol, src_ip, src_port, dst_ip, "
    "dst_port, packet_length, ttl, tcp_flags, mac_src, mac_dst, rule_prefix",
    "event_type = 'firewall'",
)
_parse_query(
    "p4_ids",
    "action, protocol, src_ip, src_port, dst_ip, dst_port, ids_signature_id, ids_signature, "
    "ids_classification, ids_priority",
    "source_format = 'suricata'",
)
_parse_query(
    "p5_dhcp",
    "dhcp_action, dhcp_ip, dhcp_mac, dhcp_hostname, dhcp_interface",
    "source_format = 'dnsmasq' AND event_type = 'dhcp'",
)
_parse_query(
    "p6_relay",
    "dhcp_action, dhcp_ip, dhcp_mac, dhcp_hostname, dhcp_interface",
    "source_format = 'dhcp-relay'",
)
_parse_query(
    "p7_dns",
    "dns_action, dns_name, dns_type, dns_result, dns_client_ip, dst_ip",
    "event_type = 'dns'",
)
_parse_query(
    "p8_coredns",
    "action, protocol, src_ip, src_port, dst_ip, dst_port, dns_action, dns_name, dns_client_ip, "
    "dns_filter_type, dns_filter_category, client_mac",
    "source_format = 'coredns'",
)
_parse_query(
    "p9_wifi", "wifi_action, wifi_client_mac, wifi_radio", "source_format = 'hostapd'"
)
_parse_query(
    "p10_cef",
    "action, protocol, src_ip, src_port, dst_ip, dst_port, threat_type, threat_category, "
    "wifi_ssid, wifi_channel, wifi_rssi, cef_event_class_id, cef_name, cef_severity, "
    "unifi_category, unifi_subcategory, unifi_host, client_alias, client_mac, client_ip",
    "source_format = 'cef'",
)
_parse_query("p11_vpn", "action", "event_type = 'vpn'")
_parse_query("p12_system", "action", "event_type = 'system' AND source_format = 'raw'")

_MISFIT = " ".join(f"WHEN {k} THEN '{name}'" for k, name in shapes.MISFITS.items())


@register(
    "p13_rejects",
    f"SELECT id, received_at, CASE id % {shapes.SHAPE_COUNT} {_MISFIT} END AS format, "
    f"raw AS text FROM lines WHERE id % {shapes.SHAPE_COUNT} "
    f"IN ({', '.join(map(str, shapes.MISFITS))})",
    "lines",
)
def _(spark, sf):
    return parse.parse_rejects(tables.lines(spark, sf))


_PARSED = [c for c in PARSED_COLUMNS if c != "raw_message"]


@register("parse_all", f"SELECT {', '.join(_PARSED)} FROM parsed", "parsed")
def _(spark, sf):
    return tables.parsed(spark, sf).select(*_PARSED)


# ================================================================ filters (F)
def _filter_query(name: str, condition: str, **filters) -> None:
    @register(name, f"SELECT {BRIEF} FROM ev WHERE {condition}", "ev")
    def _(spark, sf):
        return events.filter_events(tables.events(spark, sf), **filters).select(*BRIEF_COLUMNS)


_HOT_MAC = "02:00:00:00:00:07"
_HOT_LAN = "172.16.7.8"
_filter_query("f1_types", "event_type IN ('firewall', 'threat')", event_type="firewall,threat")
_filter_query("f2_action", "action = 'block'", action="block")
_filter_query("f3_direction", "direction = 'inbound'", direction="inbound")
_filter_query("f4_severity", "severity IN (1, 4)", severity="1,4")
_filter_query("f5_src_ip", f"src_ip = '{_HOT_LAN}'", src_ip=_HOT_LAN)
_filter_query("f5_dst_ip", "dst_ip = '172.16.8.254'", dst_ip="172.16.8.254")
_filter_query("f6_dst_port", "dst_port = 443", dst_port="443")
_filter_query("f7_protocol", "protocol = 'UDP'", protocol="udp")
_filter_query(
    "f8_mac",
    f"'{_HOT_MAC}' IN (coalesce(client_mac, ''), coalesce(wifi_client_mac, ''), "
    "coalesce(dhcp_mac, ''), coalesce(mac_src, ''), coalesce(mac_dst, ''))",
    mac=_HOT_MAC,
)
_filter_query("f9_since", SINCE7, since=SINCE_7D)
_filter_query("f10_until", f"received_at <= {ts(SINCE_7D)}", until=SINCE_7D)
_filter_query(
    "f11_search",
    "contains(lower(message), '100% ok') OR contains(lower(hostname), '100% ok')",
    search="100% OK",
)
_filter_query(
    "f11_search_any",
    "contains(lower(coalesce(message, '')), 'ads.') OR contains(coalesce(src_ip, ''), 'ads.') "
    "OR contains(coalesce(dst_ip, ''), 'ads.') OR contains(lower(coalesce(dns_name, '')), 'ads.') "
    "OR contains(lower(coalesce(hostname, '')), 'ads.')",
    search="ADS.",
)
_filter_query(
    "f11_search_found",
    " OR ".join(f"contains(lower(coalesce({c}, '')), 'ethernet3')"
                for c in ("message", "src_ip", "dst_ip", "dns_name", "hostname")),
    search="Ethernet3",
)
_filter_query(
    "f_combined",
    f"event_type = 'firewall' AND action = 'block' AND dst_port = 22 AND {SINCE7}",
    event_type="firewall", action="block", dst_port=22, since=SINCE_7D,
)


@register(
    "f12_page",
    f"SELECT {', '.join(EVENT_COLUMNS)} FROM ev WHERE event_type = 'threat' "
    "ORDER BY received_at DESC, id DESC LIMIT 100",
    "ev",
)
def _(spark, sf):
    return events.query_events(tables.events(spark, sf), event_type="threat", limit="100")


@register("f13_by_id", f"SELECT {BRIEF} FROM ev WHERE id = 123", "ev")
def _(spark, sf):
    return events.event_by_id(tables.events(spark, sf), 123).select(*BRIEF_COLUMNS)


@register("f14_public", f"SELECT {BRIEF} FROM ev WHERE NOT {oracle.private('src_ip')}", "ev")
def _(spark, sf):
    return events.exclude_private(tables.events(spark, sf), "src_ip").select(*BRIEF_COLUMNS)


@register(
    "f15_period",
    " UNION ALL ".join(
        f"SELECT '{name}' AS period, count(*) AS count FROM ev WHERE received_at >= "
        f"{ts(AS_OF)} - INTERVAL '{int(span.total_seconds() // 3600)}' HOUR"
        for name, span in times.PERIODS.items()
    ),
    "ev",
)
def _(spark, sf):
    ev = tables.events(spark, sf)
    oldest = times.since_of(AS_OF, "30d")
    inside = [
        F.count_if(F.col("received_at") >= times.instant(times.since_of(AS_OF, p))).alias(p)
        for p in times.PERIODS
    ]
    counted = events.since_filter(ev, oldest).agg(*inside)
    return counted.unpivot([], list(times.PERIODS), "period", "count")


_INTEL_ROWS = f"""
    SELECT ip,
           arg_max_null(country, (received_at, id)) AS country,
           arg_max_null(city, (received_at, id)) AS city,
           arg_max_null(lat, (received_at, id)) AS lat,
           arg_max_null(lon, (received_at, id)) AS lon,
           arg_max_null(abuse_score, (received_at, id)) AS abuse_score,
           arg_max_null(hostname, (received_at, id)) AS hostname,
           count(*) AS event_count,
           count(*) FILTER (action = 'block') AS blocked_count,
           count(*) FILTER (event_type = 'threat') AS threat_count,
           max(received_at) AS "lastSeen"
    FROM (SELECT id, received_at, action, event_type, src_ip AS ip, src_geo_country AS country,
                 src_geo_city AS city, src_geo_lat AS lat, src_geo_lon AS lon,
                 src_abuse_score AS abuse_score, src_hostname AS hostname FROM ev
          UNION ALL
          SELECT id, received_at, action, event_type, dst_ip, dst_geo_country, dst_geo_city,
                 dst_geo_lat, dst_geo_lon, dst_abuse_score, dst_hostname FROM ev) AS b
    WHERE ip IS NOT NULL AND (country IS NOT NULL OR abuse_score IS NOT NULL) AND {SINCE}
    GROUP BY ip"""
_INTEL_SQL = _INTEL_ROWS + " ORDER BY event_count DESC, abuse_score DESC NULLS LAST, ip LIMIT 200"


@register(
    "f16_intel_filter",
    f"SELECT * FROM ({_INTEL_ROWS}) AS t WHERE coalesce(abuse_score, 0) > 20 AND event_count >= 1 "
    "AND lower(CASE WHEN city IS NOT NULL AND country IS NOT NULL THEN city || ', ' || country "
    "ELSE coalesce(country, '') END) LIKE '%nation%'",
    "ev",
)
def _(spark, sf):
    rows = stats.enriched_addresses(tables.events(spark, sf), SINCE_30D)
    return events.filter_intel(
        rows, {"abuse_score": "> 20", "event_count": "1", "country": "Nation"}
    )


@register(
    "f17_subscription",
    f"SELECT {BRIEF} FROM ev WHERE event_type IN ('firewall', 'dns_filter') AND action = 'block'",
    "ev",
)
def _(spark, sf):
    ev = tables.events(spark, sf)
    return events.subscription_filter(ev, ["firewall", "dns_filter"], "block").select(
        *BRIEF_COLUMNS
    )


@register(
    "f18_geo",
    f"SELECT {BRIEF} FROM ev WHERE src_geo_lat IS NOT NULL OR dst_geo_lat IS NOT NULL",
    "ev",
)
def _(spark, sf):
    return events.geo_present(tables.events(spark, sf)).select(*BRIEF_COLUMNS)


# ================================================================ aggregates (A, U, O)
@register("a1_count", "SELECT count(*) AS count FROM ev", "ev")
def _(spark, sf):
    return stats.event_count(tables.events(spark, sf))


@register(
    "a2_today",
    "SELECT count(*) AS count FROM ev WHERE received_at >= TIMESTAMP '2024-01-30 00:00:00'",
    "ev",
)
def _(spark, sf):
    return stats.count_today(tables.events(spark, sf), "2024-01-30 15:00:00")


@register("a3_last", "SELECT max(received_at) AS last_event_at FROM ev", "ev")
def _(spark, sf):
    return stats.last_event_time(tables.events(spark, sf))


@register(
    "a4_types",
    f"SELECT event_type, count(*) AS count FROM ev WHERE {SINCE7} GROUP BY event_type",
    "ev",
)
def _(spark, sf):
    return stats.type_counts(tables.events(spark, sf), SINCE_7D)


@register(
    "a5_overview",
    "SELECT count(*) AS total, "
    "count(*) FILTER (event_type = 'firewall' AND action = 'allow') AS allowed, "
    "count(*) FILTER (event_type = 'firewall' AND action = 'block') AS blocked, "
    f"count(*) FILTER (event_type = 'threat') AS threats FROM ev WHERE {SINCE}",
    "ev",
)
def _(spark, sf):
    return stats.overview(tables.events(spark, sf), SINCE_30D)


_TYPE_COUNTS = ", ".join(
    f'count(*) FILTER (event_type = \'{t}\') AS "{t}"' for t in stats.TIMELINE_TYPES
)


@register(
    "a6_timeline",
    "SELECT time_bucket(INTERVAL '15' MINUTE, received_at) AS ts, "
    f"{_TYPE_COUNTS}, count(*) AS total FROM ev WHERE {SINCE7} GROUP BY 1",
    "ev",
)
def _(spark, sf):
    return stats.timeline(tables.events(spark, sf), SINCE_7D, "15m")


@register(
    "a6_timeline_filled",
    f"SELECT t.ts, {_TYPE_COUNTS}, count(e.id) AS total FROM "
    f"(SELECT unnest(generate_series({ts(SINCE_7D)}, {ts(AS_OF)}, INTERVAL '1' HOUR)) AS ts) AS t "
    "LEFT JOIN ev e ON e.received_at >= t.ts AND e.received_at < t.ts + INTERVAL '1' HOUR "
    "GROUP BY t.ts",
    "ev",
)
def _(spark, sf):
    return stats.timeline(tables.events(spark, sf), SINCE_7D, "1h", fill_until=AS_OF)


@register(
    "a7_timeline_firewall",
    "SELECT date_trunc('day', received_at)::TIMESTAMP AS ts, count(*) FILTER (action = 'allow') AS allowed, "
    "count(*) FILTER (action = 'block') AS blocked FROM ev "
    f"WHERE event_type = 'firewall' AND {SINCE} GROUP BY 1",
    "ev",
)
def _(spark, sf):
    return stats.timeline_firewall(tables.events(spark, sf), SINCE_30D, "1d")


def _ranking_sql(side: str, extra: dict[str, str], condition: str, limit: int) -> str:
    latest = ", ".join(
        f'arg_max_null({side}_{c}, (received_at, id)) AS "{n}"' for n, c in extra.items()
    )
    return (
        f'SELECT {side}_ip AS ip, count(*) AS count, max(received_at) AS "lastSeen", {latest} '
        f"FROM ev WHERE {side}_ip IS NOT NULL AND {condition} GROUP BY {side}_ip "
        f"ORDER BY count DESC, ip LIMIT {limit}"
    )


_TALK = {"country": "geo_country", "hostname": "hostname"}
_BLOCK = {"country": "geo_country", "abuseScore": "abuse_score", "hostname": "hostname"}


@register("a8_top_talkers", _ranking_sql("src", _TALK, SINCE, 10), "ev")
def _(spark, sf):
    return stats.top_talkers(tables.events(spark, sf), SINCE_30D)


@register(
    "a8_top_destinations",
    _ranking_sql("dst", _TALK, f"{SINCE} AND NOT {oracle.private('dst_ip')}", 80),
    "ev",
)
def _(spark, sf):
    return stats.top_talkers(tables.events(spark, sf), SINCE_30D, "dst", 80, True)


@register(
    "a9_top_blocked",
    _ranking_sql("src", _BLOCK, f"action = 'block' AND {SINCE} AND NOT {oracle.private('src_ip')}", 50),
    "ev",
)
def _(spark, sf):
    return stats.top_blocked(tables.events(spark, sf), SINCE_30D, "src", 50, True)


@register("a9_top_blocked_dst", _ranking_sql("dst", _BLOCK, f"action = 'block' AND {SINCE7}", 20), "ev")
def _(spark, sf):
    return stats.top_blocked(tables.events(spark, sf), SINCE_7D, "dst", 20)


_PORTS = (
    "SELECT dst_port AS port, protocol, count(*) AS count FROM ev WHERE dst_port IS NOT NULL "
    f"AND {SINCE} GROUP BY dst_port, protocol ORDER BY count DESC, port, protocol NULLS FIRST LIMIT 10"
)


@register("a10_top_ports", _PORTS, "ev")
def _(spark, sf):
    return stats.top_ports(tables.events(spark, sf), SINCE_30D)


@register(
    "a11_top_clients",
    "SELECT coalesce(client_mac, wifi_client_mac, dhcp_mac) AS mac, max(client_alias) AS alias, "
    'max(coalesce(client_ip, dhcp_ip, src_ip)) AS ip, count(*) AS "eventCount", '
    "count(*) FILTER (event_type = 'wifi') AS \"wifiEvents\", "
    "count(*) FILTER (event_type = 'dhcp') AS \"dhcpEvents\", "
    "count(*) FILTER (event_type = 'firewall') AS \"firewallEvents\" FROM ev "
    f"WHERE coalesce(client_mac, wifi_client_mac, dhcp_mac) IS NOT NULL AND {SINCE} "
    'GROUP BY 1 ORDER BY "eventCount" DESC, mac LIMIT 25',
    "ev",
)
def _(spark, sf):
    return stats.top_clients(tables.events(spark, sf), SINCE_30D, 25)


@register(
    "a12_top_threats",
    "SELECT ids_signature AS signature, arg_max_null(ids_classification, (received_at, id)) "
    'AS classification, count(*) AS count, max(received_at) AS "lastSeen" FROM ev '
    f"WHERE event_type = 'threat' AND ids_signature IS NOT NULL AND {SINCE} "
    "GROUP BY ids_signature ORDER BY count DESC, signature LIMIT 10",
    "ev",
)
def _(spark, sf):
    return stats.top_threats(tables.events(spark, sf), SINCE_30D)


@register("a13_threat_intel", _INTEL_SQL, "ev")
def _(spark, sf):
    return stats.threat_intel(tables.events(spark, sf), SINCE_30D, 200)


@register(
    "a14_intel_summary",
    'SELECT count(*) AS "totalEnriched", count(*) FILTER (abuse_score > 0) AS "withAbuseScore", '
    'count(*) FILTER (abuse_score >= 50) AS "highThreat", count(DISTINCT geo_country) AS countries '
    "FROM intel WHERE NOT is_private",
    "intel",
)
def _(spark, sf):
    return stats.intel_summary(tables.intel(spark, sf))


_SIDES = " UNION {all} ".join(
    f"SELECT {s}_ip AS ip, {s}_abuse_score AS abuse_score, {s}_geo_country AS country FROM ev "
    f"WHERE {s}_ip IS NOT NULL AND ({s}_geo_country IS NOT NULL OR {s}_abuse_score IS NOT NULL) "
    f"AND {SINCE}"
    for s in ("src", "dst")
)


@register(
    "a15_period_summary",
    "SELECT count(DISTINCT ip) AS enriched, "
    "count(DISTINCT CASE WHEN abuse_score > 0 THEN ip END) AS flagged, "
    'count(DISTINCT CASE WHEN abuse_score >= 50 THEN ip END) AS "highThreat", '
    f"count(DISTINCT country) AS countries FROM ({_SIDES.format(all='')}) AS t",
    "ev",
)
def _(spark, sf):
    return stats.period_summary(tables.events(spark, sf), SINCE_30D)


def _geo_sql(half: int | None) -> str:
    names = {"country": "geo_country", "city": "geo_city", "lat": "geo_lat", "lon": "geo_lon",
             "abuseScore": "abuse_score"}
    sides = []
    for s in ("src", "dst"):
        latest = ", ".join(
            f'arg_max_null({s}_{c}, (received_at, id)) AS "{n}"' for n, c in names.items()
        )
        sides.append(
            f"(SELECT {s}_ip AS ip, {latest}, count(*) AS count, "
            "count(*) FILTER (action = 'block') AS blocked, "
            "count(*) FILTER (event_type = 'threat') AS threats, "
            f"max(received_at) AS \"lastSeen\", '{s}' AS direction FROM ev "
            f"WHERE {s}_geo_lat IS NOT NULL AND {s}_geo_lon IS NOT NULL AND {SINCE} "
            f"GROUP BY {s}_ip" + (f" ORDER BY count DESC, ip LIMIT {half})" if half else ")")
        )
    return " UNION ALL ".join(sides)


@register("a16_geo_events", _geo_sql(50), "ev")
def _(spark, sf):
    return stats.geo_events(tables.events(spark, sf), SINCE_30D, 99)


_RECENT = ", ".join(stats.RECENT_GEO_COLUMNS)


@register(
    "a17_recent_geo",
    f"SELECT {_RECENT} FROM ev WHERE src_geo_lat IS NOT NULL OR dst_geo_lat IS NOT NULL "
    "ORDER BY received_at DESC, id DESC LIMIT 50",
    "ev",
)
def _(spark, sf):
    return stats.recent_geo_events(tables.events(spark, sf))


@register(
    "a18_overlay",
    "SELECT count(*) AS ips, count(*) FILTER (threats > 0) AS threat_ips, "
    "count(*) FILTER (blocked > 0) AS blocked_ips, count(DISTINCT nullif(country, '')) AS countries "
    f"FROM ({_geo_sql(None)}) AS g WHERE NOT {oracle.private('ip')}",
    "ev",
)
def _(spark, sf):
    return stats.geo_overlay(stats.located_addresses(tables.events(spark, sf), SINCE_30D))


@register(
    "u1_union_all",
    "SELECT ip, count(*) AS count FROM (SELECT src_ip AS ip FROM ev UNION ALL "
    "SELECT dst_ip FROM ev) AS t WHERE ip IS NOT NULL GROUP BY ip",
    "ev",
)
def _(spark, sf):
    sides = stats.both_sides(tables.events(spark, sf), {})
    return sides.filter("ip IS NOT NULL").groupBy("ip").agg(F.count("*").alias("count"))


@register("u2_union", _SIDES.format(all=""), "ev")
def _(spark, sf):
    ev = events.since_filter(tables.events(spark, sf), SINCE_30D)
    names = {"abuse_score": "abuse_score", "country": "geo_country"}
    sides = stats.both_sides(ev, names).filter(
        "ip IS NOT NULL AND (country IS NOT NULL OR abuse_score IS NOT NULL)"
    )
    return sides.distinct()


@register(
    "o2_group_topk",
    "SELECT event_type, src_ip, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY "
    "event_type ORDER BY count DESC, src_ip) AS rank FROM (SELECT event_type, src_ip, "
    "count(*) AS count FROM ev WHERE src_ip IS NOT NULL GROUP BY ALL) AS c) AS r WHERE rank <= 3",
    "ev",
)
def _(spark, sf):
    counts = (
        tables.events(spark, sf)
        .filter("src_ip IS NOT NULL")
        .groupBy("event_type", "src_ip")
        .agg(F.count("*").alias("count"))
    )
    return top_k_per(counts, 3, ["event_type"], ["src_ip"]).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


@register(
    "o3_page",
    f"SELECT {BRIEF} FROM ev ORDER BY received_at DESC, id DESC LIMIT 50 OFFSET 150",
    "ev",
)
def _(spark, sf):
    return events.page(tables.events(spark, sf), 50, 150).select(*BRIEF_COLUMNS)


@register(
    "o3_keyset",
    f"SELECT {BRIEF} FROM ev WHERE received_at < {ts(SINCE_7D)} "
    "ORDER BY received_at DESC, id DESC LIMIT 700",
    "ev",
)
def _(spark, sf):
    return events.page(tables.events(spark, sf), 700, 0, (SINCE_7D, 0)).select(*BRIEF_COLUMNS)


@register(
    "o6_intel_sort",
    "SELECT ip, abuse_score, row_number() OVER (ORDER BY coalesce(abuse_score, -1) DESC, ip) "
    f"AS place FROM ({_INTEL_ROWS}) AS t ORDER BY place LIMIT 200",
    "ev",
)
def _(spark, sf):
    rows = stats.enriched_addresses(tables.events(spark, sf), SINCE_30D)
    best = events.sort_intel(rows, "abuse_score", "desc").limit(200)
    order = W.orderBy(F.coalesce("abuse_score", F.lit(-1)).desc(), F.asc("ip"))
    place = F.row_number().over(order).cast("bigint").alias("place")
    return best.select("ip", "abuse_score", place)


@register(
    "o7_latest",
    f"SELECT {BRIEF} FROM ev ORDER BY received_at DESC, id DESC LIMIT 500",
    "ev",
)
def _(spark, sf):
    return events.latest(tables.events(spark, sf)).select(*BRIEF_COLUMNS)


# ================================================================ scalar expressions (X)
_LONG = "CASE WHEN regexp_matches(ip, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN {} ELSE 0 END"


@register(
    "x2_private",
    "SELECT ip, "
    + _LONG.format(oracle.ip_long("ip"))
    + f" AS value, {oracle.private('ip')} AS private, "
    "regexp_replace(ip, '[.][0-9]+$', '') AS net FROM (SELECT src_ip AS ip FROM ev UNION "
    "SELECT dst_ip FROM ev) AS t WHERE ip IS NOT NULL",
    "ev",
)
def _(spark, sf):
    ips = enrich.event_addresses(tables.events(spark, sf))
    ip = F.col("ip")
    return ips.select(
        "ip",
        net.ip_to_long(ip).alias("value"),
        net.is_private(ip).alias("private"),
        net.subnet24(ip).alias("net"),
    )


@register(
    "x3_direction",
    "SELECT direction, interface_in, interface_out, count(*) AS count FROM ev "
    "WHERE event_type = 'firewall' GROUP BY ALL",
    "ev",
)
def _(spark, sf):
    ev = tables.events(spark, sf).filter("event_type = 'firewall'")
    again = net.direction(
        F.col("interface_in"), F.col("interface_out"),
        net.is_private(F.col("src_ip")), net.is_private(F.col("dst_ip")),
    )
    return (
        ev.withColumn("direction", again)
        .groupBy("direction", "interface_in", "interface_out")
        .agg(F.count("*").alias("count"))
    )


@register(
    "x6_band",
    "SELECT ip, CASE WHEN abuse_score >= 75 THEN 'critical' WHEN abuse_score >= 50 THEN 'high' "
    "WHEN abuse_score >= 25 THEN 'medium' WHEN abuse_score > 0 THEN 'low' END AS band FROM intel",
    "intel",
)
def _(spark, sf):
    return tables.intel(spark, sf).select("ip", net.abuse_band(F.col("abuse_score")).alias("band"))


@register(
    "x7_marker",
    "SELECT ip, direction, CASE WHEN threats > 0 OR \"abuseScore\" > 50 THEN 'threat' "
    "WHEN blocked > 0 THEN 'blocked' ELSE 'normal' END AS marker, "
    "round(greatest(4.0, least(14.0, 3 * log2(count + 1)))::DOUBLE, 6) AS size "
    f"FROM ({_geo_sql(None)}) AS g",
    "ev",
)
def _(spark, sf):
    geo = stats.with_markers(stats.located_addresses(tables.events(spark, sf), SINCE_30D))
    return geo.select("ip", "direction", "marker", F.round("size", 6).alias("size"))


@register(
    "x7_flow",
    "SELECT id, received_at, event_type, action, src_geo_lat, src_geo_lon, dst_geo_lat, "
    "dst_geo_lon, CASE WHEN action = 'block' OR event_type = 'threat' THEN 'threat' "
    "ELSE 'normal' END AS line FROM ev WHERE src_geo_lat IS NOT NULL AND src_geo_lon IS NOT NULL "
    "AND dst_geo_lat IS NOT NULL AND dst_geo_lon IS NOT NULL "
    "ORDER BY received_at DESC, id DESC LIMIT 30",
    "ev",
)
def _(spark, sf):
    return stats.flow_lines(tables.events(spark, sf))


@register(
    "x8_severity",
    "SELECT id, CASE severity WHEN 0 THEN 'Emergency' WHEN 1 THEN 'Alert' WHEN 2 THEN 'Critical' "
    "WHEN 3 THEN 'Error' WHEN 4 THEN 'Warning' WHEN 5 THEN 'Notice' WHEN 6 THEN 'Info' "
    "WHEN 7 THEN 'Debug' END AS label FROM ev",
    "ev",
)
def _(spark, sf):
    ev = tables.events(spark, sf)
    return ev.select("id", net.severity_label(F.col("severity")).alias("label"))


@register(
    "x9_share",
    f"SELECT *, CAST(count AS DOUBLE) / max(count) OVER () AS share FROM ({_PORTS}) AS p",
    "ev",
)
def _(spark, sf):
    return stats.with_share(stats.top_ports(tables.events(spark, sf), SINCE_30D))


# ================================================================ joins (J)
@register(
    "j1_attach",
    'SELECT a.ip, a.count, i.geo_country AS country, i.hostname, i.abuse_score AS "abuseScore" '
    "FROM (SELECT src_ip AS ip, count(*) AS count FROM plain WHERE src_ip IS NOT NULL GROUP BY 1) a "
    "LEFT JOIN (SELECT * FROM intel WHERE NOT is_private) i ON i.ip = a.ip",
    "plain", "intel",
)
def _(spark, sf):
    counts = (
        tables.plain_events(spark, sf)
        .filter("src_ip IS NOT NULL")
        .groupBy(F.col("src_ip").alias("ip"))
        .agg(F.count("*").alias("count"))
    )
    return enrich.attach_intel(counts, tables.intel(spark, sf))


@register(
    "j2_geo_inner",
    "SELECT a.ip, a.count, i.geo_country AS country, i.geo_city AS city, i.geo_lat AS lat, "
    'i.geo_lon AS lon, i.abuse_score AS "abuseScore" '
    "FROM (SELECT src_ip AS ip, count(*) AS count FROM plain WHERE src_ip IS NOT NULL GROUP BY 1) a "
    "JOIN intel i ON i.ip = a.ip WHERE NOT i.is_private AND i.geo_lat IS NOT NULL "
    "AND i.geo_lon IS NOT NULL",
    "plain", "intel",
)
def _(spark, sf):
    counts = (
        tables.plain_events(spark, sf)
        .filter("src_ip IS NOT NULL")
        .groupBy(F.col("src_ip").alias("ip"))
        .agg(F.count("*").alias("count"))
    )
    return enrich.locate(counts, tables.intel(spark, sf))


_LOCATED = "(SELECT * FROM intel WHERE NOT is_private AND geo_lat IS NOT NULL)"


@register(
    "j3_two_sided",
    "SELECT e.id, e.event_type, e.action, e.received_at, e.src_ip, s.geo_lat AS src_geo_lat, "
    "s.geo_lon AS src_geo_lon, s.geo_country AS src_geo_country, s.geo_city AS src_geo_city, "
    "s.abuse_score AS src_abuse_score, e.dst_ip, d.geo_lat AS dst_geo_lat, "
    "d.geo_lon AS dst_geo_lon, d.geo_country AS dst_geo_country, d.geo_city AS dst_geo_city, "
    "d.abuse_score AS dst_abuse_score, e.message, e.dst_port, e.protocol FROM plain e "
    f"LEFT JOIN {_LOCATED} s ON s.ip = e.src_ip LEFT JOIN {_LOCATED} d ON d.ip = e.dst_ip "
    "WHERE s.ip IS NOT NULL OR d.ip IS NOT NULL "
    "ORDER BY e.received_at DESC, e.id DESC LIMIT 200",
    "plain", "intel",
)
def _(spark, sf):
    return enrich.recent_geo(tables.plain_events(spark, sf), tables.intel(spark, sf), 200)


_ENRICHED_COLUMNS = [
    "id", "src_ip", "dst_ip",
    *[f"{s}_{f}" for s in ("src", "dst") for f in oracle.FACTS],
]


@register(
    "j4_backfill",
    f"SELECT {', '.join(_ENRICHED_COLUMNS)} FROM ({oracle.enriched('ev', 'usable')}) AS t",
    "ev", "usable",
)
def _(spark, sf):
    full = enrich.enrich_events(tables.events(spark, sf), tables.intel(spark, sf))
    return full.select(*_ENRICHED_COLUMNS)


_CAP = 20


def _capped_sql() -> str:
    sides = []
    for s, alias in (("src", "s"), ("dst", "d")):
        use = f"(e.{s}_geo_country IS NULL AND {alias}.ip IS NOT NULL AND e.{s}_rank <= {_CAP})"
        sides += [
            f"CASE WHEN {use} THEN {alias}.{f} ELSE e.{s}_{f} END AS {s}_{f}" for f in oracle.FACTS
        ]
    ranks = ", ".join(
        f"row_number() OVER (PARTITION BY {s}_ip, {s}_geo_country IS NULL "
        f"ORDER BY received_at DESC, id DESC) AS {s}_rank"
        for s in ("src", "dst")
    )
    return (
        f"SELECT e.id, e.src_ip, e.dst_ip, {', '.join(sides)} FROM (SELECT *, {ranks} FROM ev) e "
        "LEFT JOIN usable s ON s.ip = e.src_ip LEFT JOIN usable d ON d.ip = e.dst_ip"
    )


@register("j4a_capped", _capped_sql(), "ev", "usable")
def _(spark, sf):
    capped = enrich.enrich_events(
        tables.events(spark, sf), tables.intel(spark, sf), max_rows_per_ip=_CAP
    )
    return capped.select(*_ENRICHED_COLUMNS)


@register(
    "j5_geo_range",
    "SELECT x.ip, g.country, g.city, g.lat, g.lon FROM (SELECT DISTINCT ip FROM (SELECT src_ip AS ip "
    "FROM plain UNION SELECT dst_ip FROM plain) AS u WHERE ip IS NOT NULL) AS x "
    f"LEFT JOIN geo_ranges g ON {oracle.ip_long('x.ip')} BETWEEN g.start_ip AND g.end_ip",
    "plain", "geo_ranges",
)
def _(spark, sf):
    ips = enrich.event_addresses(tables.plain_events(spark, sf))
    return enrich.geo_lookup(ips, tables.lookup_table(spark, sf, "geo_ranges"))


@register(
    "j6_reputation",
    "SELECT x.ip, f.reported_at, f.abuse_score, f.total_reports, f.country_code, f.isp, f.domain "
    "FROM seen x LEFT JOIN feed f ON f.ip = x.ip",
    "seen", "feed",
)
def _(spark, sf):
    seen = _seen(spark, sf)
    return enrich.reputation(seen, tables.lookup_table(spark, sf, "abuse_feed"), AS_OF)


@register(
    "j7_rdns", "SELECT x.ip, p.hostname FROM seen x LEFT JOIN ptr p ON p.ip = x.ip", "seen", "ptr"
)
def _(spark, sf):
    return enrich.rdns(_seen(spark, sf), tables.lookup_table(spark, sf, "ptr_records"))


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    wanted = tables.plain_events(spark, sf).filter(
        F.col("event_type").isin(enrich.ENRICHABLE_TYPES)
    )
    return events.exclude_private(enrich.event_addresses(wanted), "ip")


@register("j8_pending", "SELECT ip FROM pending", "pending")
def _(spark, sf):
    return enrich.pending_ips(tables.plain_events(spark, sf), tables.seed_intel(spark, sf), AS_OF)


_INTEL_COLUMNS = ", ".join(INTEL_SCHEMA.fieldNames())


@register("j9_fresh", f"SELECT {_INTEL_COLUMNS} FROM fresh", "fresh")
def _(spark, sf):
    return enrich.fresh_intel(tables.seed_intel(spark, sf), AS_OF)


@register("j10_resolve", f"SELECT {_INTEL_COLUMNS} FROM resolved", "resolved")
def _(spark, sf):
    return tables.resolved(spark, sf)


@register(
    "j11_upsert",
    f"SELECT {_INTEL_COLUMNS} FROM intel_updates UNION ALL SELECT {_INTEL_COLUMNS} FROM intel_seed "
    "WHERE ip NOT IN (SELECT ip FROM intel_updates)",
    "intel_updates", "intel_seed",
)
def _(spark, sf):
    return enrich.upsert_intel(
        tables.seed_intel(spark, sf), tables.lookup_table(spark, sf, "intel_updates")
    )


@register(
    "j11_mark_private",
    f"SELECT ip, {', '.join('CAST(NULL AS VARCHAR) AS ' + f if f in ('geo_country', 'geo_city', 'hostname') else 'CAST(NULL AS ' + ('INTEGER' if f == 'abuse_score' else 'DOUBLE') + ') AS ' + f for f in oracle.FACTS)}, "
    f"true AS is_private, {ts(AS_OF)} AS updated_at FROM (SELECT src_ip AS ip FROM plain UNION "
    f"SELECT dst_ip FROM plain) AS t WHERE ip IS NOT NULL AND {oracle.private('ip')}",
    "plain",
)
def _(spark, sf):
    return enrich.mark_private(enrich.event_addresses(tables.plain_events(spark, sf)), AS_OF)


_RELATED = (
    "SELECT target, rank, ip, abuse_score, geo_country, hostname FROM (SELECT t.target, "
    "CAST(row_number() OVER (PARTITION BY t.target ORDER BY coalesce(i.abuse_score, -1) DESC, i.ip) "
    "AS INTEGER) AS rank, i.ip, i.abuse_score, i.geo_country, i.hostname FROM ({targets}) t "
    "JOIN intel i ON regexp_replace(i.ip, '[.][0-9]+$', '') = "
    "regexp_replace(t.target, '[.][0-9]+$', '') AND i.ip <> t.target AND NOT i.is_private) AS r "
    "WHERE rank <= 10"
)


@register("j12_related", _RELATED.format(targets="SELECT ip AS target FROM intel"), "intel")
def _(spark, sf):
    known = tables.intel(spark, sf)
    return enrich.related_ips(known.select(F.col("ip").alias("target")), known)


_PORT_NAMES = ", ".join(f"({p}, '{n}')" for p, n in PORT_NAMES.items())


@register(
    "j13_ports",
    "SELECT dst_port AS port, n.name AS port_name, count(*) AS count FROM ev "
    f"LEFT JOIN (VALUES {_PORT_NAMES}) AS n(port, name) ON n.port = ev.dst_port "
    "WHERE dst_port IS NOT NULL GROUP BY ALL",
    "ev",
)
def _(spark, sf):
    counts = (
        tables.events(spark, sf)
        .filter("dst_port IS NOT NULL")
        .groupBy(F.col("dst_port").alias("port"))
        .agg(F.count("*").alias("count"))
    )
    return stats.with_port_name(counts).select("port", "port_name", "count")


# ================================================================ dossiers (H)
_ENDS = (
    "(SELECT t.target, e.* FROM targets t JOIN ev e ON e.src_ip = t.target OR e.dst_ip = t.target)"
)
_AS_SRC = "(SELECT t.target, e.* FROM targets t JOIN ev e ON e.src_ip = t.target)"
_AS_DST = "(SELECT t.target, e.* FROM targets t JOIN ev e ON e.dst_ip = t.target)"


def _top_sql(rows: str, keys: str, name: str, condition: str, k: int, order: str) -> str:
    return (
        f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY count DESC, "
        f"{order}) AS INTEGER) AS rank FROM (SELECT target, {keys}, count(*) AS count FROM {rows} AS r "
        f"WHERE {condition} GROUP BY target, {name}) AS c) AS x WHERE rank <= {k}"
    )


def _hunt(fn) -> Query:
    return lambda spark, sf: fn(
        tables.events(spark, sf), tables.lookup_table(spark, sf, "targets")
    )


@register(
    "h1_intel",
    f"SELECT t.target, {', '.join('i.' + f for f in INTEL_SCHEMA.fieldNames()[1:])}, "
    "i.ip IS NOT NULL AS known FROM targets t LEFT JOIN intel i ON i.ip = t.target",
    "targets", "intel",
)
def _(spark, sf):
    return hunt.dossier_intel(tables.lookup_table(spark, sf, "targets"), tables.intel(spark, sf))


register(
    "h2_total",
    "SELECT t.target, count(e.id) AS total FROM targets t LEFT JOIN ev e ON e.src_ip = t.target "
    "OR e.dst_ip = t.target GROUP BY t.target",
    "targets", "ev",
)(_hunt(hunt.dossier_total))
register(
    "h3_by_action",
    f"SELECT target, action, count(*) AS count FROM {_ENDS} AS e WHERE action IS NOT NULL GROUP BY ALL",
    "targets", "ev",
)(_hunt(hunt.dossier_by_action))
register(
    "h4_by_type",
    f"SELECT target, event_type, count(*) AS count FROM {_ENDS} AS e GROUP BY ALL",
    "targets", "ev",
)(_hunt(hunt.dossier_by_type))
register(
    "h5_dst_ports",
    _top_sql(_AS_SRC, "dst_port, protocol", "dst_port, protocol", "dst_port IS NOT NULL", 20,
             "dst_port, protocol NULLS FIRST"),
    "targets", "ev",
)(_hunt(hunt.dossier_dst_ports))
register(
    "h6_src_ports",
    _top_sql(_AS_DST, "src_port, protocol", "src_port, protocol", "src_port IS NOT NULL", 10,
             "src_port, protocol NULLS FIRST"),
    "targets", "ev",
)(_hunt(hunt.dossier_src_ports))
register(
    "h7_timeline",
    "SELECT target, strftime(received_at, '%Y-%m-%dT%H:00:00Z') AS hour, count(*) AS count "
    f"FROM {_ENDS} AS e GROUP BY ALL",
    "targets", "ev",
)(_hunt(hunt.dossier_timeline))
register(
    "h8_seen",
    "SELECT t.target, min(e.received_at) AS first_seen, max(e.received_at) AS last_seen "
    "FROM targets t LEFT JOIN ev e ON e.src_ip = t.target OR e.dst_ip = t.target GROUP BY t.target",
    "targets", "ev",
)(_hunt(hunt.dossier_seen))


@register("h9_related", _RELATED.format(targets="SELECT target FROM targets"), "targets", "intel")
def _(spark, sf):
    return enrich.related_ips(
        tables.lookup_table(spark, sf, "targets"), tables.intel(spark, sf)
    )


register(
    "h10_signatures",
    _top_sql(_ENDS, "ids_signature, min(ids_classification) AS ids_classification",
             "ids_signature", "ids_signature IS NOT NULL", 10, "ids_signature"),
    "targets", "ev",
)(_hunt(hunt.dossier_signatures))
register(
    "h11_destinations",
    _top_sql(_AS_SRC, "dst_ip AS ip", "dst_ip", "dst_ip IS NOT NULL", 20, "ip"),
    "targets", "ev",
)(_hunt(hunt.dossier_destinations))
register(
    "h12_targets_hit",
    "SELECT t.target, count(DISTINCT e.dst_ip) AS targets_hit FROM targets t "
    "LEFT JOIN ev e ON e.src_ip = t.target GROUP BY t.target",
    "targets", "ev",
)(_hunt(hunt.dossier_targets_hit))
register(
    "h13_sources",
    _top_sql(_AS_DST, "src_ip AS ip", "src_ip", "src_ip IS NOT NULL", 20, "ip"),
    "targets", "ev",
)(_hunt(hunt.dossier_sources))


@register(
    "h_all_by_type",
    "SELECT target, event_type, count(*) AS count FROM (SELECT src_ip AS target, event_type FROM ev "
    "UNION ALL SELECT dst_ip, event_type FROM ev WHERE dst_ip IS DISTINCT FROM src_ip) AS x "
    "WHERE target IS NOT NULL GROUP BY ALL",
    "ev",
)
def _(spark, sf):
    return hunt.dossier_by_type(tables.events(spark, sf), None)


def _report(spark, sf) -> DataFrame:
    targets = tables.lookup_table(spark, sf, "targets")
    facts = hunt.dossier(tables.events(spark, sf), tables.intel(spark, sf), targets)
    owners = enrich.owner_lookup(
        targets,
        tables.lookup_table(spark, sf, "asn_ranges"),
        tables.lookup_table(spark, sf, "ptr_records"),
    )
    return hunt.dossier_report(facts, owners)


def _section(title: str, source: str, line: str, order: str) -> str:
    return (
        f"(SELECT target, concat(chr(10), chr(10), '### {title}', chr(10), "
        f"string_agg({line}, chr(10) ORDER BY {order})) AS text FROM ({source}) AS z GROUP BY target)"
    )


def _report_sql() -> str:
    number = "format('{:,}', count)"
    parts = {
        "intel_part": (
            "(SELECT i.ip AS target, concat(chr(10), chr(10), '### Enrichment Data', chr(10), "
            "'- Country: ', coalesce(i.geo_country, 'Unknown'), chr(10), '- City: ', "
            "coalesce(i.geo_city, 'Unknown'), chr(10), '- AbuseIPDB Score: ', "
            "coalesce(CAST(i.abuse_score AS VARCHAR), 'Not scored'), '/100', chr(10), "
            "'- Hostname: ', coalesce(i.hostname, 'None')) AS text FROM intel i)"
        ),
        "owner_part": (
            "(SELECT t.target, concat(chr(10), chr(10), '### Network Info (WHOIS)', chr(10), "
            "'- Organization: ', a.org, chr(10), '- Hostname: ', coalesce(p.hostname, 'None'), "
            "chr(10), '- Location: ', concat_ws(', ', a.city, a.region, a.country)) AS text "
            "FROM targets t JOIN asn_ranges a ON "
            f"{oracle.ip_long('t.target')} BETWEEN a.start_ip AND a.end_ip "
            "LEFT JOIN ptr p ON p.ip = t.target)"
        ),
        "sum_part": (
            "(SELECT t.target, concat(chr(10), chr(10), '### Activity Summary', chr(10), "
            "'- Total events: ', format('{:,}', count(e.id)), chr(10), '- First seen: ', "
            "coalesce(strftime(min(e.received_at), '%Y-%m-%dT%H:%M:%S.%gZ'), 'N/A'), chr(10), "
            "'- Last seen: ', coalesce(strftime(max(e.received_at), '%Y-%m-%dT%H:%M:%S.%gZ'), 'N/A'), "
            "chr(10), '- Unique targets hit: ', CAST(count(DISTINCT CASE WHEN e.src_ip = t.target "
            "THEN e.dst_ip END) AS VARCHAR)) AS text FROM targets t LEFT JOIN ev e "
            "ON e.src_ip = t.target OR e.dst_ip = t.target GROUP BY t.target)"
        ),
        "action_part": _section(
            "Actions",
            f"SELECT target, action, count(*) AS count FROM {_ENDS} AS e WHERE action IS NOT NULL GROUP BY ALL",
            f"concat('- ', action, ': ', {number})", "count DESC, action"),
        "type_part": _section(
            "Event Types",
            f"SELECT target, event_type, count(*) AS count FROM {_ENDS} AS e GROUP BY ALL",
            f"concat('- ', event_type, ': ', {number})", "count DESC, event_type"),
        "port_part": _section(
            "Top Destination Ports Targeted",
            _top_sql(_AS_SRC, "dst_port, protocol", "dst_port, protocol", "dst_port IS NOT NULL",
                     20, "dst_port, protocol NULLS FIRST"),
            "concat('- ', coalesce(protocol, 'null'), '/', CAST(dst_port AS VARCHAR), ': ', "
            "CAST(count AS VARCHAR), ' events')", "rank"),
        "sig_part": _section(
            "IDS/IPS Signatures Triggered",
            _top_sql(_ENDS, "ids_signature, min(ids_classification) AS ids_classification",
                     "ids_signature", "ids_signature IS NOT NULL", 10, "ids_signature"),
            "concat('- ', ids_signature, ' (', ids_classification, '): ', CAST(count AS VARCHAR), "
            "' events')", "rank"),
        "rel_part": _section(
            "Related IPs (Same /24 Subnet)",
            _RELATED.format(targets="SELECT target FROM targets"),
            "concat('- ', ip, ' — Abuse: ', coalesce(CAST(abuse_score AS VARCHAR), 'N/A'), "
            "', Country: ', coalesce(geo_country, '?'), ', Host: ', coalesce(hostname, 'N/A'))",
            "rank"),
        "hour_part": _section(
            "Activity Timeline (Hourly)",
            "SELECT target, strftime(received_at, '%Y-%m-%dT%H:00:00Z') AS hour, count(*) AS count "
            f"FROM {_ENDS} AS e GROUP BY ALL",
            "concat('- ', hour, ': ', CAST(count AS VARCHAR), ' events')", "hour"),
    }
    pieces = ", ".join(f"coalesce({n}.text, '')" for n in parts)
    joins = " ".join(f"LEFT JOIN {sql} AS {n} ON {n}.target = t.target" for n, sql in parts.items())
    return (
        f"SELECT t.target, concat('## Target: ', t.target, {pieces}) AS report "
        f"FROM targets t {joins}"
    )


register("h14_report", _report_sql(), "targets", "ev", "intel", "asn_ranges", "ptr")(_report)


@register(
    "h15_owner",
    "SELECT t.target, a.org, a.city, a.region, a.country, a.timezone, p.hostname "
    "FROM (SELECT DISTINCT ip AS target FROM intel) t LEFT JOIN asn_ranges a "
    f"ON {oracle.ip_long('t.target')} BETWEEN a.start_ip AND a.end_ip "
    "LEFT JOIN ptr p ON p.ip = t.target",
    "intel", "asn_ranges", "ptr",
)
def _(spark, sf):
    known = tables.intel(spark, sf).select(F.col("ip").alias("target"))
    return enrich.owner_lookup(
        known,
        tables.lookup_table(spark, sf, "asn_ranges"),
        tables.lookup_table(spark, sf, "ptr_records"),
    )


# ================================================================ streams (T)
def _arriving(spark: SparkSession, sf: str) -> DataFrame:
    return lines.stream_lines(
        spark, "parquet", {"path": tables.arrivals(spark, sf), "maxFilesPerTrigger": "16"}
    )


@register("t1_ingest", f"SELECT {', '.join(_PARSED)} FROM parsed", "parsed")
def _(spark, sf):
    path, state = fresh_path(spark, "ingest"), fresh_path(spark, "state")
    feed.start_ingest(_arriving(spark, sf), path, state, every=None).awaitTermination()
    return store.read_events(spark, path).select(*_PARSED)


@register("t2_type_counts", "SELECT event_type, count(*) AS count FROM parsed GROUP BY 1", "parsed")
def _(spark, sf):
    path, state = fresh_path(spark, "counts"), fresh_path(spark, "state")
    counts = feed.stream_type_counts(feed.parsed_stream(_arriving(spark, sf)))
    feed.start_table(counts, path, state, "complete", None).awaitTermination()
    return feed.read_table(spark, path, ["event_type"])


@register("t3_live", FEED, "parsed")
def _(spark, sf):
    path, state = fresh_path(spark, "feed"), fresh_path(spark, "state")
    matched = feed.match_subscriptions(
        feed.parsed_stream(_arriving(spark, sf)), tables.subscriptions(spark)
    ).select("sub_id", "id", "received_at", "event_type")
    writer = matched.writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", state).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(path)


@register(
    "t4_timeline",
    "SELECT time_bucket(INTERVAL '1' HOUR, received_at) AS ts, "
    f"{_TYPE_COUNTS}, count(*) AS total FROM parsed GROUP BY 1",
    "parsed",
)
def _(spark, sf):
    path, state = fresh_path(spark, "timeline"), fresh_path(spark, "state")
    ev = feed.parsed_stream(_arriving(spark, sf))
    # Longer than one slice of the arrival folder, within which files come in any order.
    running = feed.stream_timeline(ev, "1h", "30 days")
    feed.start_table(running, path, state, "update", None).awaitTermination()
    return feed.read_table(spark, path, ["ts"])


@register(
    "t5_enrich",
    f"SELECT {', '.join(_ENRICHED_COLUMNS)} FROM ({oracle.enriched('plain', 'usable')}) AS t",
    "plain", "usable",
)
def _(spark, sf):
    path, state = fresh_path(spark, "arrived"), fresh_path(spark, "state")
    ev = feed.parsed_stream(_arriving(spark, sf))
    feed.stream_enrich(
        ev, lambda: tables.intel(spark, sf), path, state, every=None
    ).awaitTermination()
    return store.read_events(spark, path).select(*_ENRICHED_COLUMNS)


@register("t6_pending", f"SELECT {_INTEL_COLUMNS} FROM intel", "intel")
def _(spark, sf):
    path, state = fresh_path(spark, "intel-log"), fresh_path(spark, "state")
    append_intel(tables.seed_intel(spark, sf), path, 0)
    ev = feed.parsed_stream(_arriving(spark, sf))
    feed.start_enrichment(
        ev, path, AS_OF, state, every=None, **tables.sources(spark, sf)
    ).awaitTermination()
    return feed.read_intel(spark, path)


LATE = "id % 50 = 7 AND received_at < TIMESTAMP '2024-01-09 00:00:00'"


@register(
    "t4_late",
    "SELECT time_bucket(INTERVAL '1' HOUR, received_at) AS ts, "
    f"count(*) FILTER (NOT ({LATE} AND received_at < newest - INTERVAL '2' DAY)) AS in_time, "
    f"count(*) FILTER ({LATE} AND received_at < newest - INTERVAL '2' DAY) AS late "
    "FROM parsed, (SELECT max(received_at) AS newest FROM parsed "
    f"WHERE received_at < TIMESTAMP '2024-01-23 00:00:00' AND NOT ({LATE})) AS m GROUP BY 1",
    "parsed",
)
def _(spark, sf):
    """Slices of time arrive in order, but a few rows of the first come with the last one."""
    path, state = fresh_path(spark, "late"), fresh_path(spark, "state")
    folder, files = tables.arrivals_with_late(spark, sf, LATE)
    stream = lines.stream_lines(spark, "parquet", {"path": folder, "maxFilesPerTrigger": str(files)})
    feed.start_timeline(
        feed.parsed_stream(stream), "1h", "2 days", path, state, every=None
    ).awaitTermination()
    came = feed.read_timeline(spark, path).select("ts", F.col("total").alias("in_time"))
    late = feed.timeline_counts(feed.read_late(spark, path), "1h").select("ts", F.col("total").alias("late"))
    joined = came.join(late, "ts", "full")
    return joined.select("ts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("in_time", "late")])


@register("t1_replayed", f"SELECT {', '.join(_PARSED)} FROM parsed", "parsed")
def _(spark, sf):
    """A stream's batches come again from its start after days were compacted; nothing is added twice."""
    path = fresh_path(spark, "replayed")
    state, copy = fresh_path(spark, "state"), fresh_path(spark, "state")
    feed.start_ingest(_arriving(spark, sf), path, state, every=None).awaitTermination()
    for day in store.stored_days(spark, path)[5:9]:
        store.compact_day(spark, path, day)
    feed.start_ingest(_arriving(spark, sf), path, copy, every=None, name=state).awaitTermination()
    return store.read_events(spark, path).select(*_PARSED)


@register("s4_during_rewrite", f"SELECT {BRIEF} FROM ev", "ev")
def _(spark, sf):
    """What readers see when days were rewritten and the new generation of some was never listed."""
    path = fresh_path(spark, "rewritten")
    store.append_events(tables.events(spark, sf), path, bulk=True)
    days = store.stored_days(spark, path)
    store.rewrite_days(spark, path, days[:6], lambda ev: ev)
    files, root = store._folder(spark, path)
    for day in days[3:6]:
        listed = f"{store.DAY}={day}/{store.GEN}=1/{store.LISTED}"
        files.delete(store._child(spark, root, listed), False)
    return store.read_events(spark, path).select(*BRIEF_COLUMNS)


# ================================================================ stored summaries (A)
ODD_SINCE = "2024-01-10 07:40:00"


def _counted(spark, sf, since):
    return rollup.slots(spark, tables.summarised(spark, sf), since)


@register(
    "a4_rollup",
    f"SELECT event_type, count(*) AS count FROM ev WHERE received_at >= {ts(ODD_SINCE)} GROUP BY 1",
    "ev",
)
def _(spark, sf):
    return rollup.type_counts(_counted(spark, sf, ODD_SINCE))


@register_again("a5_rollup", "a5_overview")
def _(spark, sf):
    return rollup.overview(_counted(spark, sf, SINCE_30D))


@register(
    "a6_rollup",
    "SELECT time_bucket(INTERVAL '15' MINUTE, received_at) AS ts, "
    f"{_TYPE_COUNTS}, count(*) AS total FROM ev WHERE received_at >= {ts(ODD_SINCE)} GROUP BY 1",
    "ev",
)
def _(spark, sf):
    return rollup.timeline(_counted(spark, sf, ODD_SINCE), "15m")


@register_again("a7_rollup", "a7_timeline_firewall")
def _(spark, sf):
    return rollup.timeline_firewall(_counted(spark, sf, SINCE_30D), "1d")


@register("a8_rollup", _ranking_sql("src", _TALK, f"received_at >= {ts(ODD_SINCE)}", 10), "ev")
def _(spark, sf):
    return rollup.top(spark, tables.summarised(spark, sf), rollup.TALKERS["src"], ODD_SINCE)


@register_again("a9_rollup", "a9_top_blocked")
def _(spark, sf):
    return rollup.top(spark, tables.summarised(spark, sf), rollup.BLOCKED["src"], SINCE_30D, 50, True)


@register_again("a10_rollup", "a10_top_ports")
def _(spark, sf):
    return rollup.top(spark, tables.summarised(spark, sf), rollup.PORTS, SINCE_30D)


@register_again("a12_rollup", "a12_top_threats")
def _(spark, sf):
    return rollup.top(spark, tables.summarised(spark, sf), rollup.THREATS, SINCE_30D)


@register_again("a15_rollup", "a15_period_summary")
def _(spark, sf):
    return rollup.period_summary(spark, tables.summarised(spark, sf), SINCE_30D)


# ================================================================ maintenance (M)
@register(
    "m1_retention",
    f"SELECT {BRIEF} FROM ev WHERE received_at >= {ts(AS_OF)} - INTERVAL '10' DAY",
    "ev",
)
def _(spark, sf):
    path = fresh_path(spark, "kept")
    store.append_events(tables.events(spark, sf), path, bulk=True)
    store.run_retention(spark, path, AS_OF, 10)
    return store.read_events(spark, path).select(*BRIEF_COLUMNS)


def _first_days(spark, sf, last: int):
    stream = _arriving(spark, sf)
    return stream.filter(F.dayofmonth("received_at") <= last)


@register(
    "m1_after_stream",
    f"SELECT {BRIEF} FROM plain WHERE received_at >= {ts(AS_OF)} - INTERVAL '18' DAY",
    "plain",
)
def _(spark, sf):
    """A stream and a batch add to one table; retention then cuts a day that both wrote."""
    path, state = fresh_path(spark, "shared"), fresh_path(spark, "state")
    hours = F.hour("received_at") < 12
    early = _first_days(spark, sf, 20).filter(hours)
    feed.start_ingest(early, path, state, every=None).awaitTermination()
    rest = tables.lines(spark, sf).filter(~((F.dayofmonth("received_at") <= 20) & hours))
    store.append_events(store.with_raw(parse.parse_syslog(rest)), path, bulk=True)
    store.run_retention(spark, path, AS_OF, 18)
    store.run_retention(spark, path, AS_OF, 18)
    return store.read_events(spark, path).select(*BRIEF_COLUMNS)


@register(
    "m1_after_enrich",
    f"SELECT {', '.join(_ENRICHED_COLUMNS)} FROM ({oracle.enriched('plain', 'usable')}) AS t "
    f"WHERE received_at >= {ts(AS_OF)} - INTERVAL '10' DAY",
    "plain", "usable",
)
def _(spark, sf):
    path, state = fresh_path(spark, "arrived"), fresh_path(spark, "state")
    ev = feed.parsed_stream(_arriving(spark, sf))
    load = lambda: tables.intel(spark, sf)
    feed.stream_enrich(ev, load, path, state, every=None).awaitTermination()
    store.run_retention(spark, path, AS_OF, 10)
    return store.read_events(spark, path).select(*_ENRICHED_COLUMNS)


@register(
    "j4_written",
    f"SELECT {', '.join(_ENRICHED_COLUMNS)} FROM ({oracle.enriched('ev', 'usable')}) AS t",
    "ev", "usable",
)
def _(spark, sf):
    """The backfill written into the stored table; the second run finds nothing left to do."""
    path = fresh_path(spark, "filled")
    store.append_events(tables.events(spark, sf), path, bulk=True)
    enrich.run_backfill(spark, path, tables.intel(spark, sf))
    if enrich.run_backfill(spark, path, tables.intel(spark, sf)):
        raise AssertionError("a finished backfill rewrote days")
    return store.read_events(spark, path).select(*_ENRICHED_COLUMNS)


@register(
    "m1_deleted",
    f"SELECT count(*) FILTER (received_at >= {ts(AS_OF)} - INTERVAL '10' DAY) AS kept, "
    f"count(*) FILTER (received_at < {ts(AS_OF)} - INTERVAL '10' DAY) AS deleted FROM ev",
    "ev",
)
def _(spark, sf):
    return store.retention_report(tables.events(spark, sf), AS_OF, 10)


@register(
    "m2_status",
    "SELECT t.events_total, t.events_today, t.last_event_at, c.event_type, c.count FROM "
    "(SELECT count(*) AS events_total, CAST(count(*) FILTER (received_at >= "
    "TIMESTAMP '2024-01-30 00:00:00') AS BIGINT) AS events_today, max(received_at) AS last_event_at "
    "FROM ev) AS t, (SELECT event_type, count(*) AS count FROM ev GROUP BY 1) AS c",
    "ev",
)
def _(spark, sf):
    return stats.status_summary(tables.events(spark, sf), "2024-01-30 15:00:00")


@register(
    "o3_deep_page",
    "SELECT id, received_at, event_type, message FROM ev ORDER BY received_at DESC, id DESC LIMIT 50 OFFSET 900",
    "ev",
)
def _(spark, sf):
    return rollup.page_at(spark, tables.summarised(spark, sf), 50, 900).select(
        "id", "received_at", "event_type", "message"
    )


@register(
    "f5_days_of",
    f"SELECT {BRIEF} FROM ev WHERE src_ip IN (SELECT target FROM targets) "
    "OR dst_ip IN (SELECT target FROM targets)",
    "targets", "ev",
)
def _(spark, sf):
    """Events of the targets, from the days on which they occur."""
    targets = tables.lookup_table(spark, sf, "targets").select(F.col("target").alias("address"))
    path = tables.summarised(spark, sf)
    wanted = [r.address for r in targets.collect()]  # six
    ev = rollup.events_of(spark, path, targets)
    found = ev.filter(F.col("src_ip").isin(wanted) | F.col("dst_ip").isin(wanted))
    return found.select(*BRIEF_COLUMNS)


@register_again("m2_rollup", "m2_status")
def _(spark, sf):
    return rollup.status_summary(_counted(spark, sf, None), "2024-01-30 15:00:00")
