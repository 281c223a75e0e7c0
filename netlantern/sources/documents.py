"""Flat events to nested documents and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlantern.schema import EVENT_SCHEMA, INTEL_FACTS
from netlantern.sources.store import complete

# Each sub-document, the event columns it holds (member = column), and the columns
# of which at least one must be present for the sub-document to exist.
SUBDOCUMENTS: dict[str, tuple[dict[str, str], list[str]]] = {
    "network": (
        {
            c: c
            for c in (
                "action direction interface_in interface_out protocol src_ip src_port dst_ip "
                "dst_port packet_length ttl tcp_flags mac_src mac_dst rule_prefix"
            ).split()
        },
        ["action", "src_ip", "dst_ip", "protocol"],
    ),
    "ids": (
        {
            "signature_id": "ids_signature_id",
            "signature": "ids_signature",
            "classification": "ids_classification",
            "priority": "ids_priority",
            "threat_type": "threat_type",
            "threat_category": "threat_category",
        },
        ["ids_signature_id", "ids_signature", "threat_type", "threat_category"],
    ),
    "dhcp": (
        {m: f"dhcp_{m}" for m in ("action", "ip", "mac", "hostname", "interface")},
        ["dhcp_action", "dhcp_ip", "dhcp_mac", "dhcp_interface"],
    ),
    "dns": (
        {
            m: f"dns_{m}"
            for m in ("action", "name", "type", "result", "client_ip", "filter_type",
                      "filter_category")
        },
        ["dns_action", "dns_name"],
    ),
    "wifi": (
        {m: f"wifi_{m}" for m in ("action", "client_mac", "radio", "ssid", "channel", "rssi")},
        ["wifi_action", "wifi_client_mac", "wifi_ssid", "wifi_channel", "wifi_rssi"],
    ),
    "cef": (
        {
            "event_class_id": "cef_event_class_id",
            "name": "cef_name",
            "severity": "cef_severity",
            "category": "unifi_category",
            "subcategory": "unifi_subcategory",
            "host": "unifi_host",
        },
        ["cef_event_class_id", "cef_name"],
    ),
    "client": (
        {m: f"client_{m}" for m in ("alias", "mac", "ip")},
        ["client_alias", "client_mac", "client_ip"],
    ),
}
TOP_LEVEL = (
    "id event_type severity hostname source_format message timestamp received_at raw_message"
).split()
SIDES = ("src", "dst")


def _present(columns: list[str]):
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def to_nested(ev: DataFrame) -> DataFrame:
    """One document per event; a sub-document exists only when its trigger columns do."""
    flat = complete(ev)
    parts = []
    for name, (members, triggers) in SUBDOCUMENTS.items():
        body = F.struct(*[F.col(c).alias(m) for m, c in members.items()])
        parts.append(F.when(_present(triggers), body).alias(name))
    sides = []
    for side in SIDES:
        columns = [f"{side}_{fact}" for fact in INTEL_FACTS]
        body = F.struct(*[F.col(c).alias(m) for c, m in zip(columns, INTEL_FACTS)])
        sides.append(F.when(_present(columns), body).alias(side))
    enrichment = F.struct(*sides).alias("enrichment")
    return flat.select(*TOP_LEVEL, *parts, enrichment)


def from_nested(docs: DataFrame) -> DataFrame:
    """The flat event of each document."""
    columns = {c: F.col(c) for c in TOP_LEVEL}
    for name, (members, _) in SUBDOCUMENTS.items():
        columns.update({c: F.col(f"{name}.{m}") for m, c in members.items()})
    for side in SIDES:
        columns.update({f"{side}_{m}": F.col(f"enrichment.{side}.{m}") for m in INTEL_FACTS})
    return docs.select(*[columns[f.name].alias(f.name) for f in EVENT_SCHEMA.fields])
