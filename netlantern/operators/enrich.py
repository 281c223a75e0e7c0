"""Address enrichment: lookups, freshness, upsert, backfill (J)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netlantern.functions import net
from netlantern.functions.times import instant, parse_instant
from netlantern.operators.events import exclude_private, geo_present, latest, since_filter
from netlantern.operators.stats import RECENT_GEO_COLUMNS, RECENT_GEO_LIMIT
from netlantern.plans.sizing import broadcast_if_small, checkpointed, is_small
from netlantern.plans.skew import lookup
from netlantern.plans.topk import newest_per_key, row_limit, top_k_per
from netlantern.schema import ENRICHABLE_TYPES, INTEL_FACTS, INTEL_SCHEMA
from netlantern.sources.intel import latest_intel, usable_intel
from netlantern.sources.store import DAY, read_events, rewrite_days

Moment = dt.datetime | str
TTL = dt.timedelta(hours=24)
FEED_AGE = dt.timedelta(days=90)
SIDES = ("src", "dst")


# ---------------------------------------------------------------- aggregates with intelligence
def attach_intel(agg: DataFrame, intel: DataFrame, ip: str = "ip") -> DataFrame:
    """Country, host and score of each aggregated address (J1); one row per address on both sides."""
    facts = intel.filter(~F.coalesce("is_private", F.lit(False))).select(
        F.col("ip").alias(ip),
        F.col("geo_country").alias("country"),
        "hostname",
        F.col("abuse_score").alias("abuseScore"),
    )
    return agg.join(broadcast_if_small(facts), ip, "left")


def locate(agg: DataFrame, intel: DataFrame, ip: str = "ip") -> DataFrame:
    """Aggregated addresses that have coordinates, with their place and score."""
    located = intel.filter(
        ~F.coalesce("is_private", F.lit(False))
        & F.col("geo_lat").isNotNull()
        & F.col("geo_lon").isNotNull()
    ).select(
        F.col("ip").alias(ip),
        F.col("geo_country").alias("country"),
        F.col("geo_city").alias("city"),
        F.col("geo_lat").alias("lat"),
        F.col("geo_lon").alias("lon"),
        F.col("abuse_score").alias("abuseScore"),
    )
    return agg.join(broadcast_if_small(located), ip, "inner")


# ---------------------------------------------------------------- events with intelligence
def _with_side(
    ev: DataFrame,
    facts: DataFrame,
    side: str,
    needed: Column,
    small: bool,
) -> DataFrame:
    """Copy the facts of one side's address onto the events that need them."""
    ip, found = f"{side}_ip", "_found"
    table = facts.withColumnRenamed("ip", ip)
    joined = lookup(ev, table, ip, found, needed=needed, small=small)
    apply = F.col(found).isNotNull()
    if "_from" in facts.columns:
        place = F.struct("received_at", "id")
        newest = F.col(f"{found}._from").isNull() | (place >= F.col(f"{found}._from"))
        apply = apply & newest
    updated = {
        f"{side}_{fact}": F.when(apply, F.col(f"{found}.{fact}")).otherwise(F.col(f"{side}_{fact}"))
        for fact in INTEL_FACTS
    }
    return joined.withColumns(updated).select(*ev.columns)


def enrich_events(
    ev: DataFrame, intel: DataFrame, max_rows_per_ip: int | None = None
) -> DataFrame:
    """Fill the enrichment columns of events that have no country yet (J4), both sides.

    With ``max_rows_per_ip`` only the newest that many events per address and side are filled
    (J4a): the place of the last of them travels with the address, so no join on event ids is
    needed.
    """
    usable = usable_intel(intel)
    small = is_small(usable)
    out = ev
    for side in SIDES:
        needed = F.col(f"{side}_geo_country").isNull()
        facts = usable
        if max_rows_per_ip is not None:
            rows = ev.filter(needed & F.col(f"{side}_ip").isNotNull()).select(
                F.col(f"{side}_ip").alias("ip"), "received_at", "id"
            )
            if small:  # rows of addresses without facts needn't be ranked
                rows = rows.join(F.broadcast(usable.select("ip")), "ip", "left_semi")
            cut = (
                newest_per_key(rows, "ip", max_rows_per_ip)
                .filter(F.col("_rank") == max_rows_per_ip)
                .select("ip", F.struct("received_at", "id").alias("_from"))
            )
            facts = usable.join(cut, "ip", "left")
        out = _with_side(out, facts, side, needed, small)
    return out


def lacking_days(ev: DataFrame, intel: DataFrame) -> list[dt.date]:
    """The days of stored events ``ev`` with an event that lacks facts the table has, in order.

    A day is known by one of its rows, so each task passes on a row for each of its days.
    """
    usable = usable_intel(intel)
    small = is_small(usable)
    lacking = []
    for side in SIDES:
        ip, country = F.col(f"{side}_ip"), F.col(f"{side}_geo_country")
        rows = ev.filter(country.isNull() & ip.isNotNull())
        rows = rows.select("id", DAY, f"{side}_ip", *[f"{side}_{f}" for f in INTEL_FACTS])
        table = usable.withColumnRenamed("ip", f"{side}_ip")
        found = lookup(rows, table, f"{side}_ip", "_found", small=small)
        other = F.lit(False)
        for fact in INTEL_FACTS:
            other = other | ~F.col(f"_found.{fact}").eqNullSafe(F.col(f"{side}_{fact}"))
        lacking.append(found.filter(F.col("_found").isNotNull() & other).select(DAY).distinct())
    return sorted(r[DAY] for r in lacking[0].union(lacking[1]).distinct().collect())


def run_backfill(
    spark: SparkSession, path: str, intel: DataFrame, max_rows_per_ip: int | None = None
) -> list[dt.date]:
    """Fill stored events from the intelligence table (J4, T6); the days it rewrote, all in one job.

    Only days with an event that still lacks facts the table has are rewritten. A run that was cut
    short can be repeated: until a day's new files are listed, its old ones count. A cap counts an
    address's rows on each side over all days that are rewritten.
    """
    days = lacking_days(read_events(spark, path), intel)
    rewrite_days(spark, path, days, lambda ev: enrich_events(ev, intel, max_rows_per_ip))
    return days


def recent_geo(ev: DataFrame, intel: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest events with a located end, coordinates taken from the intelligence table.

    Which events those are needs no facts: the newest with a known source, a known destination or
    coordinates of their own are found first, from their ids, times and addresses alone. Whole events are
    then read of the time since the oldest of these few, and facts are attached to them.
    """
    rows = row_limit(limit, RECENT_GEO_LIMIT)
    located = intel.filter(
        ~F.coalesce("is_private", F.lit(False)) & F.col("geo_lat").isNotNull()
    ).select("ip", *INTEL_FACTS)
    place = ["id", "received_at"]
    found = latest(geo_present(ev).select(*place), rows)
    for side in SIDES:
        ips = located.select(F.col("ip").alias(f"{side}_ip"))
        ends = ev.select(*place, f"{side}_ip").join(ips, f"{side}_ip", "left_semi")
        found = found.unionByName(latest(ends.select(*place), rows))
    few = checkpointed(found.distinct())  # at most three rows for each one asked for
    oldest = few.agg(F.min("received_at")).first()[0]
    if oldest is None:
        return _with_facts(ev.limit(0), located, rows)
    out = since_filter(ev, oldest.astimezone(dt.timezone.utc))
    out = out.join(F.broadcast(few), place, "left_semi").select(*ev.columns)
    return _with_facts(out.dropDuplicates(["id"]), located, rows)


def _with_facts(few: DataFrame, located: DataFrame, rows: int) -> DataFrame:
    """The newest located of a few events."""
    # At most six addresses for each row asked for.
    ips = few.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct()
    facts = located.join(F.broadcast(ips), "ip", "left_semi")
    for side in SIDES:
        few = _with_side(few, facts, side, F.lit(True), True)
    return latest(geo_present(few).select(*RECENT_GEO_COLUMNS), rows)


# ---------------------------------------------------------------- lookup tables
def range_lookup(ips: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """Facts of the address range each distinct address lies in, NULL outside all ranges.

    ``ranges`` has ``start_ip, end_ip`` and facts; ranges do not overlap. They are cut at /16
    borders (at most 65,536 extra rows for all of IPv4). Within a /16 the last range that starts
    at or before an address is the only candidate, so one sorted pass finds it: the work grows
    with addresses plus ranges, never with their product, and no /16 holds more than 65,536
    distinct addresses. Texts that aren't IPv4 lie in no range and take no part in that pass.
    """
    facts = [c for c in ranges.columns if c not in ("start_ip", "end_ip")]
    block = 65536
    addresses = (
        ips.select(ip)
        .filter(F.col(ip).isNotNull())
        .distinct()
        .withColumn("_at", net.ip_to_long(F.col(ip)))
    )
    first = F.expr("start_ip div 65536")
    last = F.expr("end_ip div 65536")
    pieces = ranges.select(
        F.explode(F.sequence(first, last)).alias("_block"), "start_ip", "end_ip", *facts
    ).select(
        "_block",
        F.greatest("start_ip", F.col("_block") * block).alias("_at"),
        F.lit(None).cast("string").alias(ip),
        F.struct("end_ip", *facts).alias("_range"),
    )
    placed, others = addresses.filter("_at > 0"), addresses.filter("coalesce(_at, 0) <= 0")
    merged = pieces.unionByName(
        placed.withColumn("_block", F.expr("_at div 65536")), allowMissingColumns=True
    )
    # Pieces sort before addresses at the same place, because their address is NULL.
    up_to_here = (
        W.partitionBy("_block")
        .orderBy(F.asc("_at"), F.asc_nulls_first(ip))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    candidate = F.last("_range", ignorenulls=True).over(up_to_here)
    inside = F.col("_candidate.end_ip") >= F.col("_at")
    found = (
        merged.withColumn("_candidate", candidate)
        .filter(F.col(ip).isNotNull())
        .select(ip, *[F.when(inside, F.col(f"_candidate.{c}")).alias(c) for c in facts])
    )
    return found.unionByName(others.select(ip), allowMissingColumns=True)


def geo_lookup(ips: DataFrame, geo_ranges: DataFrame) -> DataFrame:
    """Country, city and coordinates of each distinct address."""
    return range_lookup(ips, geo_ranges.select("start_ip", "end_ip", "country", "city", "lat", "lon"))


def owner_lookup(targets: DataFrame, asn_ranges: DataFrame, ptr: DataFrame) -> DataFrame:
    """Network owner and first host name of each target."""
    ips = targets.select(F.col("target").alias("ip")).distinct()
    owners = range_lookup(ips, asn_ranges)
    return owners.join(rdns(ips, ptr), "ip", "left").withColumnRenamed("ip", "target")


def reputation(
    ips: DataFrame, abuse_feed: DataFrame, as_of: Moment, max_age: dt.timedelta = FEED_AGE
) -> DataFrame:
    """Newest feed row, of the last 90 days, of each distinct address."""
    facts = [c for c in abuse_feed.columns if c not in ("ip", "reported_at")]
    recent = abuse_feed.filter(F.col("reported_at") >= instant(parse_instant(as_of) - max_age))
    newest = (
        recent.groupBy("ip")
        .agg(F.max_by(F.struct("reported_at", *facts), "reported_at").alias("_row"))
        .select("ip", "_row.*")
    )
    return ips.select("ip").distinct().join(newest, "ip", "left")


def rdns(ips: DataFrame, ptr_records: DataFrame) -> DataFrame:
    """First host name of each distinct address."""
    first = ptr_records.groupBy("ip").agg(
        F.min_by("hostname", F.struct("ord", "hostname")).alias("hostname")
    )
    return ips.select("ip").distinct().join(first, "ip", "left")


# ---------------------------------------------------------------- keeping intelligence current
def fresh_intel(intel: DataFrame, as_of: Moment, ttl: dt.timedelta = TTL) -> DataFrame:
    """Rows that have not expired."""
    return intel.filter(F.col("updated_at") >= instant(parse_instant(as_of) - ttl))


def event_addresses(ev: DataFrame) -> DataFrame:
    """Distinct addresses of either side."""
    return (
        ev.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
        .filter(F.col("ip").isNotNull())
        .distinct()
    )


def pending_ips(
    ev: DataFrame,
    intel: DataFrame,
    as_of: Moment,
    ttl: dt.timedelta = TTL,
    rescore: bool = True,
) -> DataFrame:
    """Public addresses of enrichable events that need a lookup.

    An address needs one when it has no fresh row, or (``rescore``, when a reputation source is
    configured) when its fresh row has no score.
    """
    wanted = ev.filter(F.col("event_type").isin(ENRICHABLE_TYPES))
    seen = exclude_private(event_addresses(wanted), "ip")
    known = fresh_intel(intel, as_of, ttl)
    if rescore:
        known = known.filter(F.col("abuse_score").isNotNull())
    return seen.join(known.select("ip"), "ip", "left_anti")


def resolve_intel(
    pending: DataFrame,
    intel: DataFrame,
    as_of: Moment,
    geo_ranges: DataFrame | None = None,
    abuse_feed: DataFrame | None = None,
    ptr_records: DataFrame | None = None,
    ttl: dt.timedelta = TTL,
) -> DataFrame:
    """Intelligence row of each pending address, from the sources that are configured.

    A fresh country stays; else the range table gives the place; else the feed gives the country.
    The feed's score replaces the old one; the host is the first PTR name when that source is
    used. Private addresses come out as rows marked private.
    """
    # Several lookups and the result need it, and finding it reads the log.
    ips = checkpointed(pending.select("ip").distinct())
    known = fresh_intel(intel, as_of, ttl).select("ip", F.struct(*INTEL_FACTS).alias("_old"))
    rows = ips.join(known, "ip", "left")

    def place(name: str) -> Column:
        return F.col(f"_old.{name}")

    country, city = place("geo_country"), place("geo_city")
    lat, lon, score = place("geo_lat"), place("geo_lon"), place("abuse_score")
    host = place("hostname")
    if geo_ranges is not None:
        geo = geo_lookup(ips, geo_ranges).withColumn(
            "_geo",
            F.when(
                F.coalesce(F.col("country"), F.col("city"), F.col("lat").cast("string")).isNotNull(),
                F.struct("country", "city", "lat", "lon"),
            ),
        )
        rows = rows.join(geo.select("ip", "_geo"), "ip", "left")
        use = country.isNull() & F.col("_geo").isNotNull()
        city = F.when(use, F.col("_geo.city")).otherwise(city)
        lat = F.when(use, F.col("_geo.lat")).otherwise(lat)
        lon = F.when(use, F.col("_geo.lon")).otherwise(lon)
        country = F.when(use, F.col("_geo.country")).otherwise(country)
    if abuse_feed is not None:
        feed = reputation(ips, abuse_feed, as_of).filter(F.col("reported_at").isNotNull())
        rows = rows.join(
            feed.select("ip", F.struct("abuse_score", "country_code").alias("_feed")), "ip", "left"
        )
        reported = F.col("_feed").isNotNull()
        score = F.when(reported, F.col("_feed.abuse_score")).otherwise(score)
        country = F.coalesce(country, F.col("_feed.country_code"))
    if ptr_records is not None:
        names = rdns(ips, ptr_records).withColumnRenamed("hostname", "_ptr")
        rows = rows.join(names, "ip", "left")
        host = F.col("_ptr")
    values = dict(zip(INTEL_FACTS, (country, city, lat, lon, score, host)))
    private = net.is_private(F.col("ip"))
    return rows.select(
        "ip",
        *[
            F.when(~private, value).cast(INTEL_SCHEMA[name].dataType).alias(name)
            for name, value in values.items()
        ],
        private.alias("is_private"),
        instant(as_of).alias("updated_at"),
    )


def mark_private(ips: DataFrame, as_of: Moment) -> DataFrame:
    """Intelligence rows that mark the private addresses among ``ips``."""
    private = ips.select("ip").distinct().filter(net.is_private(F.col("ip")))
    return private.select(
        "ip",
        *[F.lit(None).cast(INTEL_SCHEMA[f].dataType).alias(f) for f in INTEL_FACTS],
        F.lit(True).alias("is_private"),
        instant(as_of).alias("updated_at"),
    )


def upsert_intel(intel: DataFrame, updates: DataFrame) -> DataFrame:
    """The table with updated rows replaced and new ones added, one row per address."""
    names = INTEL_SCHEMA.fieldNames()
    rows = intel.select(*names, F.lit(0).alias("_new")).unionByName(
        updates.select(*names, F.lit(1).alias("_new"))
    )
    return latest_intel(rows, "_new")


def related_ips(targets: DataFrame, intel: DataFrame, k: int = 10) -> DataFrame:
    """Known public neighbours of each target in its /24, highest score first.

    Only the best ``k + 1`` addresses of a /24 can be among the best ``k`` neighbours of any of
    its members, so the /24 is cut down before the join.
    """
    known = intel.filter(~F.coalesce("is_private", F.lit(False))).select(
        net.subnet24(F.col("ip")).alias("_net"),
        "ip",
        "abuse_score",
        "geo_country",
        "hostname",
        F.coalesce("abuse_score", F.lit(-1)).alias("_order"),
    )
    best = top_k_per(known, k + 1, ["_net"], ["ip"], count="_order").drop("rank")
    wanted = targets.select("target").distinct().withColumn("_net", net.subnet24(F.col("target")))
    pairs = wanted.join(best, "_net").filter(F.col("ip") != F.col("target"))
    return top_k_per(pairs, k, ["target"], ["ip"], count="_order").select(
        "target", "rank", "ip", "abuse_score", "geo_country", "hostname"
    )
