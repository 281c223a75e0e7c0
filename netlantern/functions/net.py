"""Address, interface, severity and map-marker expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from netlantern.schema import PORT_NAMES, SEVERITY_LABELS, WAN_INTERFACES


def _octet(ip: Column, i: int) -> Column:
    text = F.substring_index(F.substring_index(ip, ".", i + 1), ".", -1)
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def _four_parts(ip: Column) -> Column:
    return F.length(ip) - F.length(F.replace(ip, F.lit("."), F.lit(""))) == 3


def ip_to_long(ip: Column) -> Column:
    """Unsigned value of a dotted IPv4 text; 0 for anything that has not four parts."""
    value = ((_octet(ip, 0) * 256 + _octet(ip, 1)) * 256 + _octet(ip, 2)) * 256 + _octet(ip, 3)
    return F.when(_four_parts(ip), value).otherwise(F.lit(0).cast("bigint"))


# Space that never belongs to a public host. Whole /8 blocks (10, loopback,
# multicast), /16 blocks (link-local, 192.168, 172.16/12, the shared 100.64/10), single hosts.
PRIVATE_FIRST = [10, 127, *range(224, 240)]
PRIVATE_FIRST_TWO = [
    169 * 256 + 254,
    192 * 256 + 168,
    *range(172 * 256 + 16, 172 * 256 + 32),
    *range(100 * 256 + 64, 100 * 256 + 128),
]
PRIVATE_HOSTS = [0, 2**32 - 1]


def is_private(ip: Column) -> Column:
    """True for private, shared, loopback, link-local and multicast space, and for no address.

    Written so that each octet appears few times: a filter has no shared subexpressions.
    """
    inside = (
        _octet(ip, 0).isin(PRIVATE_FIRST)
        | (_octet(ip, 0) * 256 + _octet(ip, 1)).isin(PRIVATE_FIRST_TWO)
        | ip_to_long(ip).isin(PRIVATE_HOSTS)
    )
    return F.when(_four_parts(ip), inside).otherwise(F.lit(True))


def is_public(ip: Column) -> Column:
    return ~is_private(ip)


def direction(
    interface_in: Column,
    interface_out: Column,
    src_private: Column,
    dst_private: Column,
    wan: Iterable[str] = tuple(WAN_INTERFACES),
) -> Column:
    """Traffic direction from the interfaces and from which ends are private."""
    wan = list(wan)
    from_wan = F.coalesce(interface_in.isin(wan), F.lit(False))
    return (
        F.when(interface_out.isNull(), "local")
        .when(from_wan & dst_private, "inbound")
        .when(src_private & interface_out.isin(wan), "outbound")
        .when(src_private & dst_private, "inter-vlan")
        .otherwise("outbound")
    )


def subnet24(ip: Column) -> Column:
    return F.substring_index(ip, ".", 3)


def abuse_band(score: Column) -> Column:
    return (
        F.when(score >= 75, "critical")
        .when(score >= 50, "high")
        .when(score >= 25, "medium")
        .when(score > 0, "low")
    )


def severity_label(severity: Column) -> Column:
    labels = F.array(*[F.lit(x) for x in SEVERITY_LABELS])
    return F.get(labels, severity)


def port_name(port: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in PORT_NAMES.items() for x in pair])
    return F.try_element_at(names, port)


def marker_class(threats: Column, blocked: Column, score: Column) -> Column:
    alarming = (threats > 0) | (F.coalesce(score, F.lit(0)) > 50)
    return F.when(alarming, "threat").when(blocked > 0, "blocked").otherwise("normal")


def marker_size(count: Column) -> Column:
    return F.greatest(F.lit(4.0), F.least(F.lit(14.0), F.log2(count + 1) * 3))


def flow_class(event_type: Column, action: Column) -> Column:
    hostile = F.coalesce(action == "block", F.lit(False)) | (event_type == "threat")
    return F.when(hostile, "threat").otherwise("normal")
