"""Dashboard answers from stored summaries: same rows as the operators over the whole log.

Counts come from slots of five minutes by type and action (A1, A3-A7, M2, deep pages), rankings from lists of counts by
day folder (A8-A10, A12), distinct addresses from bitmaps that merge (A15), and the days of an address from
lists of those seen.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from netlantern.functions import net
from netlantern.functions.times import bucket, instant, utc_day
from netlantern.operators import stats
from netlantern.operators.events import exclude_private as drop_private
from netlantern.plans.sizing import broadcast_if_small
from netlantern.plans.topk import row_limit, top_k
from netlantern.schema import TIMELINE_TYPES
from netlantern.sources.store import DAY, read_events
from netlantern.sources.summaries import Kind, partials, refresh

Moment = dt.datetime | str


# ---------------------------------------------------------------- counts
def _slots(rows: DataFrame, folder: list[str]) -> DataFrame:
    return rows.groupBy(*folder, bucket(F.col("received_at"), "5m").alias("slot"), "event_type", "action").agg(
        F.count("*").alias("count"), F.max("received_at").alias("last")
    )


SLOTS = Kind("slots", _slots)


def slots(spark: SparkSession, path: str, since: Moment | None = None) -> DataFrame:
    """``slot, event_type, action, count, last`` of the events of a period."""
    return partials(spark, path, SLOTS, since)


def _total(condition: Column | None = None) -> Column:
    counted = F.col("count") if condition is None else F.when(condition, F.col("count"))
    return F.coalesce(F.sum(counted), F.lit(0))


def type_counts(counted: DataFrame) -> DataFrame:
    """As :func:`stats.type_counts` (A4), from :func:`slots`."""
    return counted.groupBy("event_type").agg(F.sum("count").alias("count"))


def overview(counted: DataFrame) -> DataFrame:
    """As :func:`stats.overview` (A5)."""
    firewall = stats.is_type("firewall")
    return counted.agg(
        _total().alias("total"),
        _total(firewall & stats.was("allow")).alias("allowed"),
        _total(firewall & stats.was("block")).alias("blocked"),
        _total(stats.is_type("threat")).alias("threats"),
    )


def timeline(counted: DataFrame, width: str) -> DataFrame:
    """As :func:`stats.timeline` (A6): all bucket widths are multiples of a slot."""
    return counted.groupBy(bucket(F.col("slot"), width).alias("ts")).agg(
        *[_total(stats.is_type(t)).alias(t) for t in TIMELINE_TYPES], _total().alias("total")
    )


def timeline_firewall(counted: DataFrame, width: str) -> DataFrame:
    """As :func:`stats.timeline_firewall`."""
    rows = counted.filter(stats.is_type("firewall"))
    return rows.groupBy(bucket(F.col("slot"), width).alias("ts")).agg(
        _total(stats.was("allow")).alias("allowed"), _total(stats.was("block")).alias("blocked")
    )


def status_summary(counted: DataFrame, as_of: Moment) -> DataFrame:
    """As :func:`stats.status_summary` (M2); midnight begins a slot."""
    today = F.col("slot") >= instant(stats.start_of_day(as_of))
    by_type = counted.groupBy("event_type").agg(
        F.sum("count").alias("count"), _total(today).alias("today"), F.max("last").alias("last")
    )
    total = by_type.agg(
        F.sum("count").alias("events_total"),
        F.sum("today").alias("events_today"),
        F.max("last").alias("last_event_at"),
    )
    return total.crossJoin(F.broadcast(by_type.select("event_type", "count")))  # one row with each type


# ---------------------------------------------------------------- rankings
@dataclass(frozen=True)
class Ranking:
    """Keys ranked by their events, with facts as they were at a key's newest event."""

    name: str
    wanted: Callable[[], Column]
    keys: dict[str, str]
    facts: dict[str, str] = field(default_factory=dict)

    @property
    def kind(self) -> Kind:
        return Kind(f"top-{self.name}", self._build, ("band",))

    def _build(self, rows: DataFrame, folder: list[str]) -> DataFrame:
        """One row for each key of a folder. ``band`` is the number of bits of its count."""
        some = rows.filter(self.wanted()).select(
            *folder,
            "received_at",
            "id",
            *[F.col(c).alias(n) for n, c in {**self.keys, **self.facts}.items()],
        )
        keys = [*folder, *self.keys]
        micros = F.unix_micros("received_at").cast("decimal(19,0)")
        place = micros * F.lit(str(2**64)).cast("decimal(20,0)") + F.col("id").cast("decimal(19,0)")
        # Facts take few values for a key, so hash aggregation does the heavy part.
        versions = some.groupBy(*keys, *self.facts).agg(
            F.count("*").alias("count"), F.max(place).alias("at"), F.max("received_at").alias("lastSeen")
        )
        found = versions.groupBy(*keys).agg(
            F.sum("count").alias("count"),
            F.max("at").alias("at"),
            F.max("lastSeen").alias("lastSeen"),
            F.max_by(F.struct(F.lit(0).alias("_"), *self.facts), "at").alias("facts"),
        )
        return found.withColumn("band", F.length(F.bin("count")))


def _side(side: str, blocked: bool) -> Ranking:
    facts = {"country": f"{side}_geo_country", "hostname": f"{side}_hostname"}
    if blocked:
        facts["abuseScore"] = f"{side}_abuse_score"

    def wanted() -> Column:
        here = F.col(f"{side}_ip").isNotNull()
        return here & stats.was("block") if blocked else here

    return Ranking(f"{'blocked' if blocked else 'talkers'}-{side}", wanted, {"ip": f"{side}_ip"}, facts)


TALKERS = {side: _side(side, False) for side in ("src", "dst")}
BLOCKED = {side: _side(side, True) for side in ("src", "dst")}
PORTS = Ranking("ports", lambda: F.col("dst_port").isNotNull(), {"port": "dst_port", "protocol": "protocol"})
THREATS = Ranking(
    "threats",
    lambda: stats.is_type("threat") & F.col("ids_signature").isNotNull(),
    {"signature": "ids_signature"},
    {"classification": "ids_classification"},
)


@dataclass
class Reading:
    """What a threshold search looked at: the lowest band read whole, and the rows of that and higher ones."""

    band: int
    rows: int
    of: int


def ranked(lists: DataFrame, ranking: Ranking, k: int) -> tuple[DataFrame, Reading]:
    """The k keys with the most events over all lists, and what had to be read for them.

    Threshold algorithm, exact: bands of high counts are read first. A key that none of them holds has less
    than ``2 ** (band - 1)`` in each list, so once that many times the lists is below the k-th best sum so
    far, only keys already seen can win, and of those only the ones that could still reach it; these are
    then summed over all bands. ``lists`` has few rows in high bands and most in low ones.
    """
    keys = list(ranking.keys)
    sizes = lists.groupBy("band").agg(F.count("*").alias("n")).collect()  # at most 64 rows
    n_lists = lists.select("event_date", "gen", "batch").distinct().count()
    bands = sorted((r.band for r in sizes), reverse=True)
    held = {r.band: r.n for r in sizes}
    every = sum(held.values())
    seen = 0
    for place, band in enumerate(bands):
        seen += held[band]
        lower = 2 ** (band - 1) - 1 if place + 1 < len(bands) else 0
        if seen < k and lower:
            continue
        high = lists.filter(F.col("band") >= band).groupBy(*keys).agg(
            F.sum("count").alias("low"), F.count("*").alias("met")
        )
        best = high.orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("least"), F.count("*").alias("n"))
        least, n = best.first()
        if lower == 0 or (n == k and n_lists * lower < least):
            break
    else:
        return _merged(lists, ranking), Reading(0, 0, 0)
    if lower:
        able = high.filter(F.col("low") + (n_lists - F.col("met")) * lower >= least).select(*keys)
        able = broadcast_if_small(able)
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
        where = same[0]
        for other in same[1:]:
            where = where & other
        lists = lists.alias("l").join(able.alias("r"), where, "left_semi")
    return top_k(_merged(lists, ranking), k, keys), Reading(band, seen, every)


def _merged(lists: DataFrame, ranking: Ranking) -> DataFrame:
    keys = list(ranking.keys)
    found = lists.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.max("lastSeen").alias("lastSeen"), F.max_by("facts", "at").alias("f")
    )
    seen = ["lastSeen"] if ranking.facts else []
    return found.select(*keys, "count", *seen, *[F.col(f"f.{c}").alias(c) for c in ranking.facts])


def top(
    spark: SparkSession,
    path: str,
    ranking: Ranking,
    since: Moment | None = None,
    limit: int | None = None,
    exclude_private: bool = False,
) -> DataFrame:
    """The keys with the most events (A8, A9, A10, A12), from the summaries of a stored table."""
    lists = partials(spark, path, ranking.kind, since)
    if exclude_private:
        lists = drop_private(lists, "ip")
    return ranked(lists, ranking, row_limit(limit, stats.TOP_LIMIT))[0]


# ---------------------------------------------------------------- distinct addresses
#: Levels of an address: enriched, with an abuse score, with one of at least 50.
LEVELS = (None, 1, 50)


def _hosts(rows: DataFrame, folder: list[str]) -> DataFrame:
    """Bitmaps of IPv4 addresses by level; other addresses, and countries, as they are written."""
    sides = stats.both_sides(rows, {"abuse_score": "abuse_score", "country": "geo_country"}, *folder)
    sides = sides.filter(
        F.col("ip").isNotNull() & (F.col("country").isNotNull() | F.col("abuse_score").isNotNull())
    ).distinct()
    levels = [F.lit(0)] + [F.when(F.col("abuse_score") >= s, k) for k, s in enumerate(LEVELS) if s]
    each = sides.select(*folder, "ip", F.explode(F.array_compact(F.array(*levels))).alias("level")).distinct()
    octets = F.split("ip", r"\.")
    number = net.ip_to_long(F.col("ip"))
    # Only the usual spelling of a number stands for itself.
    usual = F.concat_ws(".", *[F.pmod(F.shiftright(number, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])
    plain = (F.size(octets) == 4) & (usual == F.col("ip"))
    each = each.withColumn("number", F.when(F.coalesce(plain, F.lit(False)), number))
    maps = each.filter("number IS NOT NULL").groupBy(
        *folder, "level", F.bitmap_bucket_number("number").alias("bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    none = F.lit(None)
    others = each.filter("number IS NULL").select(
        *folder, "level", none.cast("long").alias("bucket"), none.cast("binary").alias("bits"), F.col("ip").alias("name")
    )
    countries = sides.filter("country IS NOT NULL").select(*folder, "country").distinct()
    countries = countries.select(
        *folder, F.lit(-1).alias("level"), none.cast("long").alias("bucket"),
        none.cast("binary").alias("bits"), F.col("country").alias("name"),
    )
    return maps.withColumn("name", none.cast("string")).unionByName(others).unionByName(countries)


HOSTS = Kind("hosts", _hosts)


def period_summary(spark: SparkSession, path: str, since: Moment | None = None) -> DataFrame:
    """As :func:`stats.period_summary` (A15): exact distinct counts, merged from bitmaps."""
    found = partials(spark, path, HOSTS, since)
    maps = found.filter("bits IS NOT NULL").groupBy("level", "bucket").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")
    )
    names = found.filter("name IS NOT NULL").select("level", "name").distinct()
    counts = maps.select("level", "n").unionByName(names.select("level", F.lit(1).cast("long").alias("n")))
    of = lambda level: F.coalesce(F.sum(F.when(F.col("level") == level, F.col("n"))), F.lit(0))
    return counts.groupBy("level").agg(F.sum("n").alias("n")).agg(
        of(0).alias("enriched"), of(1).alias("flagged"), of(2).alias("highThreat"), of(-1).alias("countries")
    )


# ---------------------------------------------------------------- deep pages
def page_at(
    spark: SparkSession,
    path: str,
    limit: int,
    offset: int,
    event_type: str | None = None,
    action: str | None = None,
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the log, newest first (O3), without sorting those before.

    Slots say how many events each time holds, so only the slots that the page lies in are read. Their
    counts come to the driver for whole days, and then for the slots of the days that the page is in.
    """
    wanted = F.lit(True)
    if event_type:
        wanted = wanted & (F.col("event_type") == event_type)
    if action:
        wanted = wanted & (F.col("action") == action)
    counted = slots(spark, path).filter(wanted)
    days = counted.groupBy(utc_day(F.col("slot")).alias("at")).agg(F.sum("count").alias("n"))
    before, some = _within(days.collect(), offset, limit)
    if not some:
        return read_events(spark, path).limit(0)
    own = counted.filter(utc_day(F.col("slot")).isin(some))
    micros = F.unix_micros("slot").alias("at")
    more, found = _within(own.groupBy(micros).agg(F.sum("count").alias("n")).collect(), offset - before, limit)
    first, last = F.timestamp_micros(F.lit(min(found))), F.timestamp_micros(F.lit(max(found)))
    at = F.col("received_at")
    rows = read_events(spark, path).filter(F.col("event_date").isin(some) & wanted)
    rows = rows.filter((at >= first) & (at < last + F.expr("INTERVAL 5 MINUTES")))
    return rows.orderBy(F.desc("received_at"), F.desc("id")).offset(offset - before - more).limit(limit)


def _within(counts: list[Row], offset: int, limit: int) -> tuple[int, list]:
    """(rows before, newest first) of the times that rows ``offset`` to ``offset + limit`` lie in."""
    before, seen, found = 0, 0, []
    for row in sorted(counts, key=lambda r: r.at, reverse=True):
        if seen + row.n <= offset:
            before += row.n
        elif seen < offset + limit:
            found.append(row.at)
        seen += row.n
    return before, found


# ---------------------------------------------------------------- days of an address
ADDRESSES = ("src_ip", "dst_ip", "client_mac", "wifi_client_mac", "dhcp_mac", "mac_src", "mac_dst")


def _seen(rows: DataFrame, folder: list[str]) -> DataFrame:
    names = F.explode(F.array_distinct(F.array_compact(F.array(*ADDRESSES)))).alias("address")
    return rows.select(*folder, names).distinct()


SEEN = Kind("seen", _seen)


def days_of(spark: SparkSession, path: str, addresses: DataFrame) -> list[dt.date]:
    """The days on which any of ``addresses(address)``, an IP or a MAC, occurs."""
    found = partials(spark, path, SEEN).select(DAY, "address")
    found = found.join(broadcast_if_small(addresses.select("address").distinct()), "address", "left_semi")
    return sorted(r[DAY] for r in found.select(DAY).distinct().collect())


def events_of(spark: SparkSession, path: str, addresses: DataFrame) -> DataFrame:
    """The stored events of the days on which any of the addresses occurs; other days aren't read."""
    return read_events(spark, path).filter(F.col(DAY).isin(days_of(spark, path, addresses)))


KINDS = (
    SLOTS, HOSTS, SEEN, PORTS.kind, THREATS.kind,
    *(r.kind for r in TALKERS.values()), *(r.kind for r in BLOCKED.values()),
)


def refresh_all(spark: SparkSession, path: str) -> None:
    """Bring all summaries of a stored table up to date."""
    for kind in KINDS:
        refresh(spark, path, kind)
