"""Activity dossiers for any set of addresses (H)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlantern.operators.enrich import related_ips
from netlantern.operators.events import since_filter
from netlantern.plans.sizing import checkpointed, is_small
from netlantern.plans.skew import keep_listed
from netlantern.plans.topk import top_k_per

# Rows of each list when nothing else is asked for.
DST_PORTS, SRC_PORTS, SIGNATURES, PEERS = 20, 10, 10, 20
HOUR = "yyyy-MM-dd'T'HH:00:00'Z'"
INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


# A list of at most this many addresses goes to the scan as a condition.
FEW = 100


@dataclass(frozen=True)
class Targets:
    """A distinct list of addresses, whether it was found small enough to broadcast, and its members
    if they are few."""

    listed: DataFrame | None
    small: bool = False
    few: tuple[str, ...] | None = None

    def near(self, ev: DataFrame) -> DataFrame:
        """Events with an end on a short list: the scan skips what cannot hold any."""
        if self.few is None:
            return ev
        return ev.filter(F.col("src_ip").isin(*self.few) | F.col("dst_ip").isin(*self.few))

    def before(self, rows: DataFrame) -> DataFrame:
        if self.listed is not None and self.small:
            return keep_listed(rows, self.listed, "target")
        return rows

    def after(self, facts: DataFrame) -> DataFrame:
        """A long list is applied to aggregated facts, where no target has many rows."""
        if self.listed is not None and not self.small:
            return facts.join(self.listed, "target", "left_semi")
        return facts


def targets_of(targets: DataFrame | Targets | None) -> Targets:
    """Check a target list once; ``None`` profiles every address."""
    if isinstance(targets, Targets):
        return targets
    if targets is None:
        return Targets(None)
    listed = targets.select("target").distinct()
    first = [r.target for r in listed.limit(FEW + 1).collect()]
    if len(first) <= FEW:
        return Targets(listed, True, tuple(t for t in first if t is not None))
    return Targets(listed, is_small(listed))


def role_rows(ev: DataFrame) -> DataFrame:
    """Each event once per end, seen from that end.

    ``once`` is false on the second row of an event whose two ends are the same address, so that
    either-side figures count it once.
    """

    def end(mine: str, other: str) -> Column:
        return F.struct(
            F.col(f"{mine}_ip").alias("target"),
            F.lit(mine).alias("role"),
            F.col(f"{other}_ip").alias("peer"),
            F.col(f"{other}_port").alias("port"),
        )

    shared = ["protocol", "action", "event_type", "received_at", "ids_signature",
              "ids_classification"]
    rows = ev.select(F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("_e"), *shared)
    again = (F.col("role") == "dst") & F.col("target").eqNullSafe(F.col("peer"))
    return (
        rows.select("_e.*", *shared)
        .filter(F.col("target").isNotNull())
        .withColumn("once", ~again)
    )


# Fact name -> (rows that count, first key, second key)
def _fact_keys() -> dict[str, tuple[Column, Column, Column]]:
    none = F.lit(None).cast("string")
    once, src, dst = F.col("once"), F.col("role") == "src", F.col("role") == "dst"
    port = F.col("port").cast("string")
    return {
        "total": (once, none, none),
        "action": (once & F.col("action").isNotNull(), F.col("action"), none),
        "type": (once, F.col("event_type"), none),
        "dst_port": (src & port.isNotNull(), port, F.col("protocol")),
        "src_port": (dst & port.isNotNull(), port, F.col("protocol")),
        "hour": (once, F.date_format(F.date_trunc("hour", "received_at"), HOUR), none),
        "signature": (
            once & F.col("ids_signature").isNotNull(),
            F.col("ids_signature"),
            F.col("ids_classification"),
        ),
        "destination": (src & F.col("peer").isNotNull(), F.col("peer"), none),
        "source": (dst & F.col("peer").isNotNull(), F.col("peer"), none),
    }


FACTS = (
    "total", "action", "type", "dst_port", "src_port", "hour", "signature", "destination", "source"
)


def dossier_facts(
    ev: DataFrame,
    targets: DataFrame | Targets | None,
    wanted: tuple[str, ...] = FACTS,
    since: dt.datetime | str | None = None,
) -> DataFrame:
    """All wanted counts of all targets in one scan: ``target, fact, key, detail, count,
    first_seen, last_seen``. With ``since``, older events don't count and their days aren't read.

    Each row names the facts it counts for; one hash aggregate adds them up, with partial counts
    before the shuffle, so a target that owns a third of the log is no burden to one task.
    """
    scope = targets_of(targets)
    keys = _fact_keys()
    marks = [
        F.when(
            keys[name][0],
            F.struct(
                F.lit(name).alias("fact"),
                keys[name][1].alias("key"),
                keys[name][2].alias("detail"),
            ),
        )
        for name in wanted
    ]
    rows = scope.before(role_rows(scope.near(since_filter(ev, since))))
    counted = (
        rows.select("target", "received_at", F.explode(F.array(*marks)).alias("_f"))
        .filter(F.col("_f").isNotNull())
        .groupBy("target", "_f.fact", "_f.key", "_f.detail")
        .agg(
            F.count("*").alias("count"),
            F.min("received_at").alias("first_seen"),
            F.max("received_at").alias("last_seen"),
        )
    )
    return scope.after(counted)


def _only(facts: DataFrame, fact: str) -> DataFrame:
    return facts.filter(F.col("fact") == fact)


def _for_all(scope: Targets, facts: DataFrame) -> DataFrame:
    """One row per target, also for targets without events."""
    if scope.listed is None:
        return facts
    return scope.listed.join(facts, "target", "left")


# ---------------------------------------------------------------- facts in table form
def _total(scope: Targets, facts: DataFrame) -> DataFrame:
    rows = _for_all(scope, _only(facts, "total").select("target", "count"))
    return rows.select("target", F.coalesce("count", F.lit(0)).alias("total"))


def _seen(scope: Targets, facts: DataFrame) -> DataFrame:
    return _for_all(scope, _only(facts, "total").select("target", "first_seen", "last_seen"))


def _targets_hit(scope: Targets, facts: DataFrame) -> DataFrame:
    hits = _only(facts, "destination").groupBy("target").agg(F.count("*").alias("_n"))
    rows = _for_all(scope, hits)
    return rows.select("target", F.coalesce("_n", F.lit(0)).alias("targets_hit"))


def _counts(facts: DataFrame, fact: str, name: str) -> DataFrame:
    return _only(facts, fact).select("target", F.col("key").alias(name), "count")


def _ports(facts: DataFrame, fact: str, k: int) -> DataFrame:
    rows = _only(facts, fact).select(
        "target",
        F.col("key").cast("int").alias(fact),
        F.col("detail").alias("protocol"),
        "count",
    )
    return top_k_per(rows, k, ["target"], [fact, "protocol"])


def _peers(facts: DataFrame, fact: str, k: int) -> DataFrame:
    return top_k_per(_counts(facts, fact, "ip"), k, ["target"], ["ip"])


def _signatures(facts: DataFrame, k: int) -> DataFrame:
    by_name = (
        _only(facts, "signature")
        .groupBy("target", F.col("key").alias("ids_signature"))
        .agg(F.min("detail").alias("ids_classification"), F.sum("count").alias("count"))
    )
    return top_k_per(by_name, k, ["target"], ["ids_signature"])


def dossier_intel(targets: DataFrame, intel: DataFrame) -> DataFrame:
    """Intelligence row of each target, expired ones included (H1)."""
    listed = targets.select("target").distinct()
    known = intel.withColumnRenamed("ip", "target").withColumn("known", F.lit(True))
    return listed.join(known, "target", "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def dossier_total(ev: DataFrame, targets: DataFrame | None) -> DataFrame:
    scope = targets_of(targets)
    return _total(scope, dossier_facts(ev, scope, ("total",)))


def dossier_by_action(ev: DataFrame, targets: DataFrame | None) -> DataFrame:
    return _counts(dossier_facts(ev, targets, ("action",)), "action", "action")


def dossier_by_type(ev: DataFrame, targets: DataFrame | None) -> DataFrame:
    return _counts(dossier_facts(ev, targets, ("type",)), "type", "event_type")


def dossier_dst_ports(ev: DataFrame, targets: DataFrame | None, k: int = DST_PORTS) -> DataFrame:
    return _ports(dossier_facts(ev, targets, ("dst_port",)), "dst_port", k)


def dossier_src_ports(ev: DataFrame, targets: DataFrame | None, k: int = SRC_PORTS) -> DataFrame:
    return _ports(dossier_facts(ev, targets, ("src_port",)), "src_port", k)


def dossier_timeline(ev: DataFrame, targets: DataFrame | None) -> DataFrame:
    return _counts(dossier_facts(ev, targets, ("hour",)), "hour", "hour")


def dossier_seen(ev: DataFrame, targets: DataFrame | None) -> DataFrame:
    scope = targets_of(targets)
    return _seen(scope, dossier_facts(ev, scope, ("total",)))


def dossier_signatures(ev: DataFrame, targets: DataFrame | None, k: int = SIGNATURES) -> DataFrame:
    return _signatures(dossier_facts(ev, targets, ("signature",)), k)


def dossier_destinations(ev: DataFrame, targets: DataFrame | None, k: int = PEERS) -> DataFrame:
    return _peers(dossier_facts(ev, targets, ("destination",)), "destination", k)


def dossier_sources(ev: DataFrame, targets: DataFrame | None, k: int = PEERS) -> DataFrame:
    return _peers(dossier_facts(ev, targets, ("source",)), "source", k)


def dossier_targets_hit(ev: DataFrame, targets: DataFrame | None) -> DataFrame:
    scope = targets_of(targets)
    return _targets_hit(scope, dossier_facts(ev, scope, ("destination",)))


def dossier(
    ev: DataFrame,
    intel: DataFrame,
    targets: DataFrame,
    *,
    dst_ports: int = DST_PORTS,
    src_ports: int = SRC_PORTS,
    signatures: int = SIGNATURES,
    peers: int = PEERS,
    since: dt.datetime | str | None = None,
) -> dict[str, DataFrame]:
    """Every fact table of the targets, with the given lengths of its lists. The events are scanned
    once: the counts go through a reliable checkpoint, which all the tables read."""
    scope = targets_of(targets)
    facts = checkpointed(dossier_facts(ev, scope, since=since))
    return {
        "intel": dossier_intel(scope.listed, intel),
        "total": _total(scope, facts),
        "seen": _seen(scope, facts),
        "targets_hit": _targets_hit(scope, facts),
        "by_action": _counts(facts, "action", "action"),
        "by_type": _counts(facts, "type", "event_type"),
        "dst_ports": _ports(facts, "dst_port", dst_ports),
        "src_ports": _ports(facts, "src_port", src_ports),
        "timeline": _counts(facts, "hour", "hour"),
        "signatures": _signatures(facts, signatures),
        "destinations": _peers(facts, "destination", peers),
        "sources": _peers(facts, "source", peers),
        "related": related_ips(scope.listed, intel),
    }


# ---------------------------------------------------------------- report text
def _or(col: Column | str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(col) if isinstance(col, str) else col, F.lit("")), F.lit(default))


def _line(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _number(col: str) -> Column:
    return F.format_number(F.col(col), 0)


def _plain(col: str) -> Column:
    return F.col(col).cast("string")


def report_lines(facts: dict[str, DataFrame], owners: DataFrame | None = None) -> DataFrame:
    """The dossier as rows ``target, section, place, line``; a section without rows is absent.

    Fixed values: the headings and line formats of the report.
    """
    parts: list[DataFrame] = []

    def block(
        section: int, rows: DataFrame, lines: list[Column], order: list[Column] | None = None
    ) -> None:
        listed = F.posexplode(F.array(*lines)).alias("_i", "line")
        place = F.struct(
            *[(order or [F.lit(0).cast("bigint"), F.lit("")])[i].alias(n) for i, n in
              enumerate(("a", "b"))]
        )
        kept = rows.select("target", place.alias("_p"), listed)
        parts.append(
            kept.select("target", F.lit(section).alias("section"), "_p.a", "_p.b", "_i", "line")
        )

    def heading(section: int, rows: DataFrame, title: str) -> None:
        block(section, rows.select("target").distinct(), [_line(f"\n### {title}")],
              [F.lit(-(2**62)), F.lit("")])

    def table(section: int, rows: DataFrame, title: str, line: Column, order: list[Column]) -> None:
        heading(section, rows, title)
        block(section, rows, [line], order)

    every = facts["total"].join(facts["seen"], "target").join(facts["targets_hit"], "target")
    block(0, every, [_line("## Target: ", F.col("target"))])

    known = facts["intel"].filter("known")
    block(1, known, [
        _line("\n### Enrichment Data"),
        _line("- Country: ", _or("geo_country", "Unknown")),
        _line("- City: ", _or("geo_city", "Unknown")),
        _line("- AbuseIPDB Score: ", F.coalesce(_plain("abuse_score"), F.lit("Not scored")), "/100"),
        _line("- Hostname: ", _or("hostname", "None")),
    ])
    if owners is not None:
        place = F.concat_ws(
            ", ", *[F.nullif(c, F.lit("")) for c in ("city", "region", "country")]
        )
        block(2, owners.filter(F.col("org").isNotNull()), [
            _line("\n### Network Info (WHOIS)"),
            _line("- Organization: ", _or("org", "Unknown")),
            _line("- Hostname: ", _or("hostname", "None")),
            _line("- Location: ", _or(place, "Unknown")),
        ])
    block(3, every, [
        _line("\n### Activity Summary"),
        _line("- Total events: ", _number("total")),
        _line("- First seen: ", F.coalesce(F.date_format("first_seen", INSTANT), F.lit("N/A"))),
        _line("- Last seen: ", F.coalesce(F.date_format("last_seen", INSTANT), F.lit("N/A"))),
        _line("- Unique targets hit: ", _plain("targets_hit")),
    ])
    most = -F.col("count")
    table(4, facts["by_action"], "Actions",
          _line("- ", F.col("action"), ": ", _number("count")), [most, F.col("action")])
    table(5, facts["by_type"], "Event Types",
          _line("- ", F.col("event_type"), ": ", _number("count")), [most, F.col("event_type")])
    rank = [F.col("rank").cast("bigint"), F.lit("")]
    table(6, facts["dst_ports"], "Top Destination Ports Targeted",
          _line("- ", _or("protocol", "null"), "/", _plain("dst_port"), ": ", _plain("count"),
                " events"), rank)
    table(7, facts["signatures"], "IDS/IPS Signatures Triggered",
          _line("- ", F.col("ids_signature"), " (", _or("ids_classification", "null"), "): ",
                _plain("count"), " events"), rank)
    table(8, facts["related"], "Related IPs (Same /24 Subnet)",
          _line("- ", F.col("ip"), " — Abuse: ", F.coalesce(_plain("abuse_score"), F.lit("N/A")),
                ", Country: ", _or("geo_country", "?"), ", Host: ", _or("hostname", "N/A")), rank)
    table(9, facts["timeline"], "Activity Timeline (Hourly)",
          _line("- ", F.col("hour"), ": ", _plain("count"), " events"),
          [F.lit(0).cast("bigint"), F.col("hour")])

    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("target", F.struct("section", "a", "b", "_i").alias("place"), "line")


def dossier_report(facts: dict[str, DataFrame], owners: DataFrame | None = None) -> DataFrame:
    """One text per target.

    A target has at most a few hundred lines (the lists are cut at their k, types and actions are
    closed sets) plus one line per active hour of the retained log.
    """
    lines = report_lines(facts, owners)
    listed = F.array_sort(F.collect_list(F.struct("place", "line")))
    return lines.groupBy("target").agg(listed.alias("_l")).select(
        "target", F.array_join(F.col("_l.line"), "\n").alias("report")
    )
