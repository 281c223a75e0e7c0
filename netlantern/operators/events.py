"""Event search: filters, lookups, paging (F, O)."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlantern.functions import net
from netlantern.functions.times import instant, parse_instant
from netlantern.plans.topk import row_limit
from netlantern.schema import EVENT_COLUMNS

Moment = dt.datetime | str

# The columns a MAC filter and a text search look at, and the rows of a page.
MAC_COLUMNS = ["client_mac", "wifi_client_mac", "dhcp_mac", "mac_src", "mac_dst"]
SEARCH_COLUMNS = ["message", "src_ip", "dst_ip", "dns_name", "hostname"]
PAGE_ROWS = 50


def since_filter(df: DataFrame, since: Moment | None) -> DataFrame:
    """``received_at >= since``; on a stored table it also prunes whole days."""
    if since is None:
        return df
    kept = df.filter(F.col("received_at") >= instant(since))
    if "event_date" in df.columns:
        kept = kept.filter(F.col("event_date") >= F.lit(parse_instant(since).date()))
    return kept


def until_filter(df: DataFrame, until: Moment | None) -> DataFrame:
    """``received_at <= until``, inclusive."""
    if until is None:
        return df
    kept = df.filter(F.col("received_at") <= instant(until))
    if "event_date" in df.columns:
        kept = kept.filter(F.col("event_date") <= F.lit(parse_instant(until).date()))
    return kept


def contains_text(columns: list[str], term: str) -> Column:
    """Literal substring in any of the columns, upper and lower case alike."""
    needle = term.lower()
    hits = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in columns]
    return reduce(or_, hits)


def filter_events(
    ev: DataFrame,
    *,
    event_type: str | None = None,
    action: str | None = None,
    direction: str | None = None,
    severity: str | None = None,
    src_ip: str | None = None,
    dst_ip: str | None = None,
    dst_port: int | str | None = None,
    protocol: str | None = None,
    mac: str | None = None,
    since: Moment | None = None,
    until: Moment | None = None,
    search: str | None = None,
) -> DataFrame:
    """All given conditions together (F1-F11); an empty or missing one does not filter."""
    out = until_filter(since_filter(ev, since), until)
    if event_type:
        out = out.filter(F.col("event_type").isin(event_type.split(",")))
    if severity:
        out = out.filter(F.col("severity").isin([int(s) for s in severity.split(",")]))
    for name, value in (
        ("action", action),
        ("direction", direction),
        ("src_ip", src_ip),
        ("dst_ip", dst_ip),
        ("protocol", protocol.upper() if protocol else None),
    ):
        if value:
            out = out.filter(F.col(name) == value)
    if dst_port:
        out = out.filter(F.col("dst_port") == int(dst_port))
    if mac:
        out = out.filter(reduce(or_, [F.col(c) == mac for c in MAC_COLUMNS]))
    if search:
        out = out.filter(contains_text(SEARCH_COLUMNS, search))
    return out


def page(
    ev: DataFrame,
    limit: int | str | None = None,
    offset: int | str | None = 0,
    before: tuple[Moment, int] | None = None,
) -> DataFrame:
    """Newest first (O3). ``before`` continues after a row already seen, without counting rows."""
    if before is not None:
        at, last = instant(before[0]), before[1]
        ev = until_filter(ev, before[0]).filter(
            (F.col("received_at") < at) | ((F.col("received_at") == at) & (F.col("id") < last))
        )
    ordered = ev.orderBy(F.desc("received_at"), F.desc("id"))
    skip = int(offset or 0)
    ordered = ordered.offset(skip) if skip else ordered
    return ordered.limit(row_limit(limit, PAGE_ROWS))


def query_events(ev: DataFrame, limit=None, offset=0, before=None, **filters) -> DataFrame:
    """One page of the whole event rows that pass the filters."""
    chosen = filter_events(ev, **filters)
    columns = [c for c in EVENT_COLUMNS if c in chosen.columns]
    return page(chosen, limit, offset, before).select(*columns)


def latest(ev: DataFrame, n: int = 500) -> DataFrame:
    """The newest n events: the ring buffer of the live feed."""
    return ev.orderBy(F.desc("received_at"), F.desc("id")).limit(n)


def event_by_id(ev: DataFrame, event_id: int) -> DataFrame:
    return ev.filter(F.col("id") == event_id)


def exclude_private(df: DataFrame, ip_col: str) -> DataFrame:
    """Keep rows whose address is public."""
    return df.filter(net.is_public(F.col(ip_col)))


def geo_present(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("src_geo_lat").isNotNull() | F.col("dst_geo_lat").isNotNull())


def subscription_filter(ev: DataFrame, types: list[str] | None, action: str | None) -> DataFrame:
    """Events of one subscriber (F17); no types or no action means all of them."""
    out = ev.filter(F.col("event_type").isin(list(types))) if types else ev
    return out.filter(F.col("action") == action) if action else out


# ---------------------------------------------------------------- intel table view
NUMERIC = {"abuse_score", "event_count", "blocked_count", "threat_count"}
_COMPARISON = re.compile(r"([><=!]+)?\s*(\d+)")


def _numeric_condition(name: str, text: str) -> Column:
    value = F.coalesce(F.col(name), F.lit(0))
    fit = _COMPARISON.fullmatch(text)
    if fit:
        number = int(fit.group(2))
        tests = {
            ">": value > number,
            "<": value < number,
            ">=": value >= number,
            "<=": value <= number,
            "=": value == number,
            "==": value == number,
            "!=": value != number,
            "!": value != number,
        }
        chosen = tests.get(fit.group(1) or ">=")
        if chosen is not None:
            return chosen
    return F.coalesce(F.col(name).cast("string"), F.lit("")).contains(text)


def filter_intel(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Column filters of the intel table (F16): ``>50``, ``<=3``, ``!0`` or a substring."""
    for name, text in filters.items():
        if not text or name not in rows.columns:
            continue
        if name in NUMERIC:
            rows = rows.filter(_numeric_condition(name, text))
        elif name == "country":
            place = F.when(
                F.col("city").isNotNull() & F.col("country").isNotNull(),
                F.concat_ws(", ", "city", "country"),
            ).otherwise(F.coalesce("country", F.lit("")))
            rows = rows.filter(F.lower(place).contains(text.lower()))
        else:
            shown = F.coalesce(F.col(name).cast("string"), F.lit(""))
            rows = rows.filter(F.lower(shown).contains(text.lower()))
    return rows


def sort_intel(rows: DataFrame, column: str, direction: str = "desc") -> DataFrame:
    """Order the intel table by a column (O6): no number counts as -1, no time as earliest."""
    if column in NUMERIC:
        key = F.coalesce(F.col(column), F.lit(-1))
    elif column == "lastSeen":
        key = F.coalesce(F.col(column), F.timestamp_micros(F.lit(-(2**62) // 1000)))
    else:
        key = F.coalesce(F.col(column).cast("string"), F.lit("-1"))
    return rows.orderBy(key.desc() if direction == "desc" else key.asc(), F.asc("ip"))
