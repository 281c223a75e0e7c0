"""Checking SQL: the same tables computed from the formulas, without parsing any line."""

from __future__ import annotations

from netlantern.schema import EVENT_SCHEMA, PARSED_COLUMNS
from workload import shapes
from workload.tables import AS_OF, BACKFILLED_UNTIL, LANS, LOOKUPS, OWNERS, USERS

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE"}
FACTS = "geo_country geo_city geo_lat geo_lon abuse_score hostname".split()


def typed(expr: str, column: str) -> str:
    return f"CAST({expr} AS {_SQL_TYPES[EVENT_SCHEMA[column].dataType.simpleString()]}) AS {column}"


def _parsed() -> str:
    out = []
    for name in PARSED_COLUMNS:
        if name == "id":
            out.append("e AS id")
        elif name == "received_at":
            out.append("ts AS received_at")
        elif name == "raw_message":
            out.append("CAST(NULL AS VARCHAR) AS raw_message")
        else:
            values = [s.expect.get(name, "NULL") for s in shapes.SHAPES]
            out.append(typed(shapes.by_shape(values), name))
    return f"SELECT {', '.join(out)} FROM base"


def _header() -> str:
    out = ["e AS id"]
    for name in ("priority", "severity", "timestamp", "hostname", "mac_model", "message"):
        values = [s.header.get(name, "NULL") for s in shapes.SHAPES]
        kind = "INTEGER" if name in ("priority", "severity") else "VARCHAR"
        out.append(f"CAST({shapes.by_shape(values)} AS {kind}) AS {name}")
    return f"SELECT {', '.join(out)} FROM base"


def ip_long(ip: str) -> str:
    part = [f"TRY_CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"((({part[0]} * 256 + {part[1]}) * 256 + {part[2]}) * 256 + {part[3]})"


def private(ip: str) -> str:
    a, b = (f"TRY_CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in (1, 2))
    return (
        f"({ip} IS NULL OR NOT regexp_matches({ip}, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') "
        f"OR {a} = 10 OR {a} = 127 OR {a} BETWEEN 224 AND 239 OR ({a} = 192 AND {b} = 168) "
        f"OR ({a} = 172 AND {b} BETWEEN 16 AND 31) OR ({a} = 169 AND {b} = 254) "
        f"OR ({a} = 100 AND {b} BETWEEN 64 AND 127) OR {ip} IN ('0.0.0.0', '255.255.255.255'))"
    )


def enriched(events: str, intel: str, condition: str = "TRUE") -> str:
    """Events with both sides filled from an intelligence table where the condition holds."""
    sets = []
    for side, alias in (("src", "s"), ("dst", "d")):
        use = f"(e.{side}_geo_country IS NULL AND {alias}.ip IS NOT NULL AND ({condition}))"
        sets += [
            f"CASE WHEN {use} THEN {alias}.{f} ELSE e.{side}_{f} END AS {side}_{f}" for f in FACTS
        ]
    keep = ", ".join(f"e.{c}" for c in PARSED_COLUMNS)
    return (
        f"SELECT {keep}, {', '.join(sets)} FROM {events} e "
        f"LEFT JOIN {intel} s ON s.ip = e.src_ip LEFT JOIN {intel} d ON d.ip = e.dst_ip"
    )


_NO_FACTS = ", ".join(
    typed("NULL", f"{side}_{f}") for side in ("src", "dst") for f in FACTS
)
FRESH = f"updated_at >= TIMESTAMP '{AS_OF}' - INTERVAL '24' HOUR"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "numbered": (
        f"SELECT event_id AS e, {shapes.TIME} AS ts, {shapes.USER} AS u, "
        f"event_id % {shapes.SHAPE_COUNT} AS k FROM events",
        (),
    ),
    "base": (
        f"SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in shapes.PIECES.items())} "
        "FROM numbered",
        ("numbered",),
    ),
    "lines": (f"SELECT e AS id, ts AS received_at, {shapes.RAW} AS raw FROM base", ("base",)),
    "header": (_header(), ("base",)),
    "parsed": (_parsed(), ("base",)),
    "users": (USERS, ()),
    "owners": (OWNERS, ("users",)),
    "lans": (LANS, ("users",)),
    **{
        name: (sql, tuple(t for t in ("owners", "lans") if f"FROM {t}" in sql))
        for name, sql in LOOKUPS.items()
    },
    "plain": (f"SELECT *, {_NO_FACTS} FROM parsed", ("parsed",)),
    "fresh": (f"SELECT * FROM intel_seed WHERE {FRESH}", ("intel_seed",)),
    "seen": (
        "SELECT DISTINCT ip FROM (SELECT src_ip AS ip FROM parsed WHERE event_type IN "
        "('firewall', 'threat', 'dns_filter') UNION ALL SELECT dst_ip FROM parsed "
        "WHERE event_type IN ('firewall', 'threat', 'dns_filter')) AS x "
        f"WHERE ip IS NOT NULL AND NOT {private('ip')}",
        ("parsed",),
    ),
    "pending": (
        "SELECT ip FROM seen WHERE ip NOT IN (SELECT ip FROM fresh) "
        "UNION SELECT seen.ip FROM seen JOIN fresh ON seen.ip = fresh.ip "
        "WHERE fresh.abuse_score IS NULL",
        ("seen", "fresh"),
    ),
    "geo": (
        "SELECT x.ip, g.country, g.city, g.lat, g.lon FROM seen x LEFT JOIN geo_ranges g "
        f"ON {ip_long('x.ip')} BETWEEN g.start_ip AND g.end_ip",
        ("seen", "geo_ranges"),
    ),
    "feed": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY reported_at DESC) "
        f"AS rn FROM abuse_feed WHERE reported_at >= TIMESTAMP '{AS_OF}' - INTERVAL '90' DAY) AS x "
        "WHERE rn = 1",
        ("abuse_feed",),
    ),
    "ptr": (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ord, hostname) AS rn "
        "FROM ptr_records) AS x WHERE rn = 1",
        ("ptr_records",),
    ),
    "resolved": (
        "SELECT p.ip, CASE WHEN o.geo_country IS NOT NULL THEN o.geo_country "
        "WHEN g.city IS NOT NULL AND g.country IS NOT NULL THEN g.country "
        "ELSE f.country_code END AS geo_country, "
        "CASE WHEN o.geo_country IS NULL AND g.city IS NOT NULL THEN g.city ELSE o.geo_city END AS geo_city, "
        "CASE WHEN o.geo_country IS NULL AND g.city IS NOT NULL THEN g.lat ELSE o.geo_lat END AS geo_lat, "
        "CASE WHEN o.geo_country IS NULL AND g.city IS NOT NULL THEN g.lon ELSE o.geo_lon END AS geo_lon, "
        "CASE WHEN f.ip IS NOT NULL THEN f.abuse_score ELSE o.abuse_score END AS abuse_score, "
        "ptr.hostname AS hostname, false AS is_private, "
        f"TIMESTAMP '{AS_OF}' AS updated_at "
        "FROM pending p LEFT JOIN fresh o ON o.ip = p.ip LEFT JOIN geo g ON g.ip = p.ip "
        "LEFT JOIN feed f ON f.ip = p.ip LEFT JOIN ptr ON ptr.ip = p.ip",
        ("pending", "fresh", "geo", "feed", "ptr"),
    ),
    "intel": (
        "SELECT * FROM resolved UNION ALL "
        "SELECT * FROM intel_seed WHERE ip NOT IN (SELECT ip FROM resolved)",
        ("resolved", "intel_seed"),
    ),
    "usable": (
        f"SELECT ip, {', '.join(FACTS)} FROM intel WHERE NOT is_private "
        "AND (geo_country IS NOT NULL OR abuse_score IS NOT NULL)",
        ("intel",),
    ),
    "ev": (
        enriched("plain", "usable", f"e.received_at < TIMESTAMP '{BACKFILLED_UNTIL}'"),
        ("plain", "usable"),
    ),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][1]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def query(sql: str, *names: str) -> str:
    """A statement over the derived tables it names."""
    ctes = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in _needed(names))
    return f"WITH {ctes} {sql}" if ctes else sql
