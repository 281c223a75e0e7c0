"""Parse job: raw log lines to typed events, as column expressions only (batch and streams).

The work is laid out as a few projections, so that every pattern runs once per line:
header groups, then the format of the line, then the groups of that format's own pattern,
then one output expression per column that only looks up array elements.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlantern.functions import net
from netlantern.functions.text import (
    MARK,
    absent_if_empty,
    hide_marks,
    last_value,
    leading_int,
    match_text,
    not_blank,
    pair_text,
    show_marks,
    split_match,
    strip_blanks,
)
from netlantern.plans.barrier import filters_stay_above, lineage_ends
from netlantern.schema import EVENT_SCHEMA, PARSED_COLUMNS, WAN_INTERFACES

# ---------------------------------------------------------------- fixed values: line patterns
STAMP = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
DEVICE = r"[0-9a-f]{12},[A-Za-z0-9._-]+\+\d+"
LEVELS = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
# Syslog facility numbers whose lines carry a text ``facility.severity`` word.
FACILITIES = {"kern": 0, "user": 1, "daemon": 3}

DEVICE_FIRST = (
    rf"^({DEVICE}):?\s*(?:({STAMP})\s+)?(?:(\S+)\s+)?"
    rf"(?:([a-z]+\.(?:{'|'.join(LEVELS)}))\s+)?((?s:.*))"
)
PRIORITY_FIRST = (
    rf"^(?:<(\d{{1,3}})>)?(?:({STAMP})\s+)?(?:(\S+)\s+)?(?:({DEVICE}):?\s*)?(?:\3 )?((?s:.*))"
)

CEF = r"CEF:(\d+)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(\d+)\|(.*)\z"
CEF_PAIR = r"\b([a-zA-Z]\w*)=(.*?)(?=\s+[a-zA-Z]\w+=|\z)"

RULE = r"\[([A-Z0-9_]+-[A-Z]-[A-Z0-9_-]*?\d*)\]"
FIREWALL_PAIR = r"\b([A-Z]+)=(\S+)"
DESCR = r'DESCR="([^"]*)"'
FLAGS = r"(?<!\S)(?:SYN|ACK|FIN|RST|PSH|URG|ECE|CWR|DF)(?!\S)"

IPV4 = r"\d+\.\d+\.\d+\.\d+"
ALERT = (
    r"\[(\d+:\d+:\d+)\]\s+(.+?)\s+\[\*\*\]\s+\[Classification:\s*(.+?)\]\s+\[Priority:\s*(\d+)\]"
    rf"\s+\{{(\w+)\}}\s+({IPV4}):(\d+)\s+->\s+({IPV4}):(\d+)"
)
LEASE = (
    r"(?i)dnsmasq-dhcp\[\d+\]:\s+(DHCP(?:ACK|DISCOVER|OFFER|REQUEST|RELEASE|NAK|INFORM))"
    rf"\((\S+)\)\s+({IPV4})?\s*([0-9a-f:]{{17}})?\s*(.*)?"
)
RELAY_ACK = (
    rf"(?i)ACK received:\s+ifname\s+(\S+),\s+src_ip\s+{IPV4},\s+src_mac\s+[0-9a-f:]+,"
    rf"\s+chaddr\s+([0-9a-f:]+),\s+yiaddr\s+({IPV4})"
)
RELAY_VLAN = r"(?i)DHCP (?:\w+ packet|packet with source IP \S+) received on VLAN (\d+)"
DNS_QUERY = r"dnsmasq\[\d+\]:\s+query\[(\w+)\]\s+(\S+)\s+from\s+(\S+)"
DNS_REPLY = r"dnsmasq\[\d+\]:\s+reply\s+(\S+)\s+is\s+(\S+)"
DNS_FORWARD = r"dnsmasq\[\d+\]:\s+forwarded\s+(\S+)\s+to\s+(\S+)"
STATION = r"hostapd\[\d+\]:\s+(\S+):\s+STA\s+([0-9a-f:]{17})\s+"
WIFI_TEXT = rf"(?i){STATION}IEEE 802\.11:\s+(.+)"
WIFI_AP = r"(?i)hostapd\[\d+\]:\s+(\S+):\s+AP-STA-(CONNECTED|DISCONNECTED)\s+([0-9a-f:]{17})"
WIFI_WPA = rf"(?i){STATION}WPA:\s+(.+)"
PROCESS = r"^(\S+?)(?:\[(\d+)\])?:\s*(.*)"

FIREWALL_KEYS = "IN OUT MAC SRC DST LEN TTL PROTO SPT DPT".split()
CEF_KEYS = (
    "src spt dst dpt proto msg UNIFIcategory UNIFIsubCategory UNIFIhost UNIFIutcTime "
    "UNIFIthreatType UNIFIthreatCategory UNIFIclientAlias UNIFIclientMac UNIFIclientIp "
    "UNIFIwifiName UNIFIwifiChannel UNIFIWiFiRssi"
).split()

JSON_FIELDS = [
    "timestamp", "type", "category", "domain", "ip", "mac",
    "src_ip", "src_port", "dst_ip", "dst_port", "protocol",
]
STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# A firewall pair holds no white space, a CEF pair no line break: safe separators.
FW_SEP, CEF_SEP = " ", "\n"

# Columns whose values are this module's own words.
SET_HERE = {"event_type", "source_format", "action", "direction", "tcp_flags"}


# ---------------------------------------------------------------- header
def with_header(lines: DataFrame) -> DataFrame:
    """Add ``priority, severity, timestamp, hostname, mac_model, message`` to raw lines.

    Blank lines are dropped; the first word of a line without a header is its host.
    """
    texts = ("raw", "timestamp", "hostname", "mac_model", "message")
    return hidden_header(lines).withColumns({c: show_marks(F.col(c)) for c in texts})


def hidden_header(lines: DataFrame) -> DataFrame:
    """The same with the parse job's separator hidden in every text."""
    raw = F.col("raw")
    clean = lines.filter(not_blank(raw)).withColumn("raw", hide_marks(strip_blanks(raw)))
    # The comma is where a leading device tag must have it: most lines need no pattern here.
    device_first = (F.substring(raw, 13, 1) == ",") & raw.rlike(rf"^{DEVICE}")
    matched = clean.withColumn("_device", device_first).withColumn(
        "_h",
        F.when(F.col("_device"), match_text(raw, [("device", DEVICE_FIRST, 5)])).otherwise(
            match_text(raw, [("priority", PRIORITY_FIRST, 5)])
        ),
    )
    parts = matched.withColumn("_h", split_match(F.col("_h")))

    def part(i: int) -> Column:
        return absent_if_empty(F.get("_h", F.lit(i + 1)))

    priority, severity = severity_cols(F.col("_device"), F.get("_h", F.lit(2)), part(4))
    return parts.select(
        *lines.columns,
        priority.alias("priority"),
        severity.alias("severity"),
        part(2).alias("timestamp"),
        part(3).alias("hostname"),
        F.when(F.col("_device"), part(1)).otherwise(part(4)).alias("mac_model"),
        F.get("_h", F.lit(6)).alias("message"),
    )


def severity_cols(device_first: Column, number: Column, word: Column) -> tuple[Column, Column]:
    """Priority and severity, from ``<N>`` or from a ``facility.severity`` word."""
    facility, level = F.substring_index(word, ".", 1), F.substring_index(word, ".", -1)
    level_no = F.lit(None).cast("int")
    for i, name in enumerate(LEVELS):
        level_no = F.when(level == name, i).otherwise(level_no)
    base = F.lit(None).cast("int")
    for name, code in FACILITIES.items():
        base = F.when(facility == name, code * 8).otherwise(base)
    priority = absent_if_empty(number).try_cast("int")
    return (
        F.when(device_first, base + level_no).otherwise(priority),
        F.when(device_first, level_no).otherwise(priority.bitwiseAND(F.lit(7))),
    )


# ---------------------------------------------------------------- router
def line_format(raw: Column, message: Column) -> Column:
    """Name of the first format, in fixed order, that claims the line."""

    def any_of(*needles: str) -> Column:
        found = F.lit(False)
        for needle in needles:
            found = found | message.contains(needle)
        return found

    firewall = (
        raw.contains("IN=")
        & raw.contains("SRC=")
        & raw.rlike(RULE)
        & raw.rlike(r"\bIN=")
        & raw.rlike(r"\bSRC=")
    )
    dnsmasq = any_of("dnsmasq[", "dnsmasq:") & ~message.contains("dnsmasq-dhcp")
    return (
        F.when(raw.contains("CEF:") & raw.rlike(CEF), "cef")
        .when(
            message.contains("coredns[") | (raw.contains("coredns[") & message.contains("{")),
            "coredns",
        )
        .when(firewall, "firewall")
        .when(any_of("suricata[", "suricata:"), "ids")
        .when(any_of("dnsmasq-dhcp[", "dnsmasq-dhcp:"), "dhcp")
        .when(any_of("dhcp_relay#dhcpsnpd", "dhcpsnpd["), "relay")
        .when(dnsmasq, "dns")
        .when(any_of("hostapd[", "hostapd:"), "wifi")
        .when(any_of("wireguard:", "EVT_VPN"), "vpn")
        .otherwise("system")
    )


def with_format(hdr: DataFrame) -> DataFrame:
    routed = hdr.withColumn("fmt", line_format(F.col("raw"), F.col("message")))
    return filters_stay_above(routed)


# ---------------------------------------------------------------- per-format pieces
def strip_tag(message: Column, process: str) -> Column:
    """The text after the last ``process[pid]:`` tag, or the whole message."""
    return F.regexp_replace(message, rf"^.*{process}\[\d+\]:\s*", "")


def fw_action(rule: Column) -> Column:
    return F.when(
        rule.contains("-D-") | rule.rlike("(?i)DROP|BLOCK|DENY|REJECT"), "block"
    ).otherwise("allow")


def tcp_flags(raw: Column) -> Column:
    found = F.regexp_extract_all(raw, F.lit(FLAGS), F.lit(0))
    return absent_if_empty(F.array_join(found, ","))


def fw_macs(mac: Column) -> tuple[Column, Column]:
    """(source, destination) of a link-layer field of at least twelve octets."""
    enough = F.length(mac) - F.length(F.replace(mac, F.lit(":"), F.lit(""))) >= 11
    source = F.substring_index(F.substring_index(mac, ":", 12), ":", -6)
    return F.when(enough, source), F.when(enough, F.substring_index(mac, ":", 6))


def cef_event_type(category: Column, subcategory: Column, class_id: Column) -> Column:
    category = F.lower(F.coalesce(category, F.lit("")))
    subcategory = F.lower(F.coalesce(subcategory, F.lit("")))
    hundreds = F.floor(leading_int(class_id) / 100)
    return (
        F.when(subcategory.isin("threat", "security"), "threat")
        .when(subcategory.isin("admin", "device", "wifi", "client", "vpn"), subcategory)
        .when(category == "audit", "admin")
        .when(category == "security", "threat")
        .when(category == "client devices", "client")
        .when(hundreds == 2, "threat")
        .when(hundreds == 3, "device")
        .when(hundreds == 4, "wifi")
        .when(hundreds == 5, "admin")
        .otherwise("system")
    )


def json_readings(text: Column) -> dict[str, Column]:
    """Read a text twice, as a list element and as an object member.

    The JSON reader ignores what follows the first value; no trailing text passes both readings.
    """
    ddl = ", ".join(f"`{name}` STRING" for name in JSON_FIELDS)
    listed = F.concat(F.lit("["), text, F.lit("]"))
    member = F.concat(F.lit('{"v":'), text, F.lit(',"end":1}'))
    return {
        "_listed": F.from_json(listed, f"ARRAY<STRUCT<{ddl}>>", STRICT_JSON),
        "_member": F.from_json(member, "`end` INT", STRICT_JSON),
    }


def json_record() -> Column:
    """Fields of a text that is exactly one JSON object, else NULL."""
    whole = (F.size("_listed") == 1) & (F.col("_member.end") == 1)
    return F.when(whole, F.get("_listed", F.lit(0)))


# ---------------------------------------------------------------- the parse job
def with_fields(fmt: DataFrame) -> DataFrame:
    """Add ``_g`` (matched groups), ``_v`` (which pattern matched), ``_x`` (values of the format's
    key list), ``_json`` (record)."""
    raw, message = F.col("raw"), F.col("message")

    def when_format(cases: dict[str, Column]) -> Column:
        out = F
        for name, value in cases.items():
            out = out.when(F.col("fmt") == name, value)
        return out

    process = match_text(message, [("process", PROCESS, 3)])
    matched = when_format(
        {
            "cef": match_text(raw, [("cef", CEF, 8)]),
            "firewall": F.concat_ws(
                MARK,
                F.lit(""),
                F.lit("firewall"),
                F.regexp_extract(raw, RULE, 1),
                F.regexp_extract(raw, DESCR, 1),
                F.coalesce(tcp_flags(raw), F.lit("")),
            ),
            "ids": match_text(message, [("alert", ALERT, 9)]),
            "dhcp": match_text(message, [("lease", LEASE, 5)]),
            "relay": match_text(message, [("ack", RELAY_ACK, 3), ("vlan", RELAY_VLAN, 1)]),
            "dns": match_text(
                message,
                [("query", DNS_QUERY, 3), ("reply", DNS_REPLY, 2), ("forwarded", DNS_FORWARD, 2)],
            ),
            "wifi": match_text(
                message, [("text", WIFI_TEXT, 3), ("ap", WIFI_AP, 3), ("wpa", WIFI_WPA, 3)]
            ),
            "vpn": process,
            "system": process,
        }
    )
    body = F.when(
        (F.col("fmt") == "coredns") & message.contains("{"),
        F.substr(message, F.instr(message, "{")),
    )
    grouped = (
        fmt.withColumns({"_m": matched, "_body": body})
        .withColumns({"_g": split_match(F.col("_m")), **json_readings(F.col("_body"))})
        .withColumns({"_v": F.get("_g", F.lit(1)), "_json": json_record()})
    )
    extension = F.substring_index(F.get("_g", F.lit(9)), " msg=", 1)
    pairs = when_format(
        {
            "cef": pair_text(extension, CEF_PAIR, CEF_SEP),
            "firewall": pair_text(raw, FIREWALL_PAIR, FW_SEP),
        }
    )
    values = when_format(
        {
            "cef": F.array(
                *[strip_blanks(last_value(F.col("_kv"), key, CEF_SEP)) for key in CEF_KEYS]
            ),
            "firewall": F.array(
                *[last_value(F.col("_kv"), key, FW_SEP) for key in FIREWALL_KEYS]
            ),
        }
    )
    staged = (
        grouped.withColumn("_kv", pairs)
        .withColumn("_x", values)
        .drop("_m", "_body", "_listed", "_member", "_kv", "priority", "mac_model")
    )
    return lineage_ends(staged)


def fw_value(key: str) -> Column:
    """Last non-empty ``KEY=value`` of a firewall line."""
    return F.get("_x", F.lit(FIREWALL_KEYS.index(key)))


def cef_text(key: str) -> Column:
    return F.get("_x", F.lit(CEF_KEYS.index(key)))


def cef_ext(key: str) -> Column:
    """Trimmed extension value of a CEF line; an empty value is absent."""
    return absent_if_empty(cef_text(key))


def parse_syslog(lines: DataFrame, wan: Iterable[str] = tuple(WAN_INTERFACES)) -> DataFrame:
    """Raw lines (``raw, received_at`` and optionally ``id``) to parsed events."""
    staged = with_fields(with_format(hidden_header(with_ids(lines))))
    return _events(staged, list(wan))


def with_ids(lines: DataFrame) -> DataFrame:
    """Keep the key of the input; without one, derive it from the line and where it came from.

    A source and a place in it tell lines apart by themselves. Lines without a source are told apart
    by when their batch was received and their place in that.
    """
    if "id" in lines.columns:
        return lines
    where = [c for c in ("source", "partition", "offset") if c in lines.columns]
    when = [] if "source" in where and "offset" in where else ["received_at"]
    return lines.withColumn("id", F.xxhash64("raw", *when, *where))


def parse_rejects(lines: DataFrame) -> DataFrame:
    """Lines claimed by a format whose own pattern they do not fit.

    They still become message-only events; this side table is for looking at them.
    """
    staged = with_fields(with_format(hidden_header(with_ids(lines))))
    fmt = F.col("fmt")
    misfit = (
        fmt.isin("ids", "dhcp", "relay", "dns", "wifi") & F.col("_v").isNull()
        | (fmt == "coredns") & F.col("_json").isNull()
        | (fmt != "cef") & F.col("raw").contains("CEF:")
    )
    return filters_stay_above(staged).filter(misfit).select(
        "id", "received_at", fmt.alias("format"), show_marks(F.col("raw")).alias("text")
    )


def _events(staged: DataFrame, wan: list[str]) -> DataFrame:
    fmt, kind, message = F.col("fmt"), F.col("_v"), F.col("message")

    def text(i: int) -> Column:
        return F.get("_g", F.lit(i + 1))

    def group(i: int) -> Column:
        return absent_if_empty(text(i))

    def json(name: str) -> Column:
        return absent_if_empty(F.col(f"_json.{name}"))

    def json_int(name: str) -> Column:
        return json(name).try_cast("double").try_cast("int")

    # One projection for the columns that other columns are built from.
    cef, firewall, coredns = fmt == "cef", fmt == "firewall", fmt == "coredns"
    blocked_name = F.col("_json").isNotNull()
    staged = staged.withColumns(
        {
            "unifi_category": F.when(cef, cef_ext("UNIFIcategory")),
            "unifi_subcategory": F.when(cef, cef_ext("UNIFIsubCategory")),
        }
    )
    category, subcategory = F.col("unifi_category"), F.col("unifi_subcategory")
    ends = staged.select(
        "*",
        F.when(cef, cef_event_type(category, subcategory, text(5))).alias("_cef_type"),
        F.when(firewall, fw_value("IN")).alias("interface_in"),
        F.when(firewall, fw_value("OUT")).alias("interface_out"),
        F.when(firewall, fw_value("MAC")).alias("_mac"),
        F.when(firewall, fw_value("SRC"))
        .when(kind == "alert", group(6))
        .when(cef, cef_ext("src"))
        .when(coredns, json("src_ip"))
        .alias("src_ip"),
        F.when(firewall, fw_value("DST"))
        .when(kind == "alert", group(8))
        .when(cef, cef_ext("dst"))
        .when(coredns, json("dst_ip"))
        .when(kind == "forwarded", group(2))
        .alias("dst_ip"),
    )
    mac_src, mac_dst = fw_macs(F.col("_mac"))
    is_threat = (kind == "alert") | (F.col("_cef_type") == "threat")
    dhcp_note = F.concat_ws(" ", text(1), text(3), text(4), text(5))
    blocked_note = F.concat(
        *[
            F.coalesce(piece, F.lit(""))
            for piece in (
                json("type"), F.lit(": "), json("domain"), F.lit(" ("), json("category"),
                F.lit(") from "), F.coalesce(json("ip"), json("src_ip")),
            )
        ]
    )
    # Text after the first " msg=" is kept as it is; a leading msg pair wins over it.
    after_msg = F.when(
        text(8).contains(" msg="), F.substr(text(8), F.instr(text(8), " msg=") + F.lit(5))
    )
    cef_note = F.coalesce(
        absent_if_empty(
            F.coalesce(cef_text("msg"), after_msg)
        ),
        text(6),
    )
    wifi_state = (
        F.when(kind == "text", strip_blanks(text(3)))
        .when(kind == "wpa", "handshake")
        .when(kind == "ap", F.when(text(2) == "CONNECTED", "connected").otherwise("disconnected"))
    )
    wifi_client = F.when(kind == "ap", group(3)).when(kind.isin("text", "wpa"), group(2))
    note = (
        F.when(cef, cef_note)
        .when(blocked_name, blocked_note)
        .when(firewall, F.coalesce(group(2), text(1)))
        .when(kind == "alert", text(2))
        .when(kind == "lease", strip_blanks(dhcp_note))
        .when(kind == "ack", F.concat(F.lit("DHCPACK relay "), text(3), F.lit(" "), text(2),
                                      F.lit(" via "), text(1)))
        .when(kind == "query", F.concat(F.lit("query["), text(1), F.lit("] "), text(2),
                                        F.lit(" from "), text(3)))
        .when(kind == "reply", F.concat(F.lit("reply "), text(1), F.lit(" is "), text(2)))
        .when(kind == "forwarded", F.concat(F.lit("forwarded "), text(1), F.lit(" to "), text(2)))
        .when(kind.isin("text", "ap"), F.concat(F.lit("STA "), wifi_client, F.lit(" "), wifi_state))
        .when(kind == "wpa", F.concat(F.lit("STA "), text(2), F.lit(" WPA: "), text(3)))
        .when(kind == "process", text(3))
        .when(fmt == "dhcp", strip_tag(message, "dnsmasq-dhcp"))
        .when(fmt == "relay", strip_tag(message, "dhcpsnpd"))
        .when(fmt == "dns", strip_tag(message, "dnsmasq"))
        .when(fmt == "wifi", strip_tag(message, "hostapd"))
        .otherwise(message)
    )
    columns = {
        "id": F.col("id"),
        "timestamp": F.when(cef, F.coalesce(cef_ext("UNIFIutcTime"), F.col("timestamp")))
        .when(coredns, F.coalesce(json("timestamp"), F.col("timestamp")))
        .otherwise(F.col("timestamp")),
        "received_at": F.col("received_at"),
        "raw_message": F.col("raw"),
        "event_type": F.when(cef, F.col("_cef_type"))
        .when(firewall, "firewall")
        .when(kind == "alert", "threat")
        .when(coredns, "dns_filter")
        .when(fmt.isin("dhcp", "relay"), "dhcp")
        .when(fmt.isin("dns", "wifi", "vpn"), fmt)
        .otherwise("system"),
        "severity": F.col("severity"),
        "hostname": F.when(cef, F.coalesce(F.col("hostname"), cef_ext("UNIFIhost"))).otherwise(
            F.col("hostname")
        ),
        "source_format": F.when(fmt.isin("cef", "coredns"), fmt)
        .when(firewall, "iptables")
        .when(fmt == "ids", "suricata")
        .when(fmt.isin("dhcp", "dns"), "dnsmasq")
        .when(fmt == "relay", "dhcp-relay")
        .when(fmt == "wifi", "hostapd")
        .otherwise("raw"),
        "message": F.coalesce(note, F.col("raw")),
        "action": F.when(firewall, fw_action(text(1))).when(is_threat | blocked_name, "block"),
        "direction": F.when(
            firewall,
            net.direction(
                F.col("interface_in"), F.col("interface_out"),
                net.is_private(F.col("src_ip")), net.is_private(F.col("dst_ip")), wan,
            ),
        ),
        "protocol": F.when(firewall, fw_value("PROTO"))
        .when(kind == "alert", group(5))
        .when(cef, cef_ext("proto"))
        .when(coredns, F.upper(json("protocol"))),
        "src_port": F.when(firewall, leading_int(fw_value("SPT")))
        .when(kind == "alert", leading_int(text(7)))
        .when(cef, leading_int(cef_ext("spt")))
        .when(coredns, json_int("src_port")),
        "dst_port": F.when(firewall, leading_int(fw_value("DPT")))
        .when(kind == "alert", leading_int(text(9)))
        .when(cef, leading_int(cef_ext("dpt")))
        .when(coredns, json_int("dst_port")),
        "packet_length": F.when(firewall, leading_int(fw_value("LEN"))),
        "ttl": F.when(firewall, leading_int(fw_value("TTL"))),
        "tcp_flags": F.when(firewall, group(3)),
        "mac_src": mac_src,
        "mac_dst": mac_dst,
        "rule_prefix": F.when(firewall, text(1)),
        "ids_signature_id": F.when(kind == "alert", text(1)),
        "ids_signature": F.when(kind == "alert", text(2)),
        "ids_classification": F.when(kind == "alert", text(3)),
        "ids_priority": F.when(kind == "alert", leading_int(text(4))),
        "threat_type": F.when(cef, cef_ext("UNIFIthreatType")),
        "threat_category": F.when(cef, cef_ext("UNIFIthreatCategory")),
        "dhcp_action": F.when(kind == "lease", text(1)).when(kind == "ack", "DHCPACK"),
        "dhcp_ip": F.when(kind.isin("lease", "ack"), group(3)),
        "dhcp_mac": F.when(kind == "lease", group(4)).when(kind == "ack", group(2)),
        "dhcp_hostname": F.when(kind == "lease", absent_if_empty(strip_blanks(text(5)))),
        "dhcp_interface": F.when(kind == "lease", text(2))
        .when(kind == "ack", text(1))
        .when(kind == "vlan", F.concat(F.lit("VLAN"), text(1))),
        "dns_action": F.when(blocked_name, "blocked").when(fmt == "dns", kind),
        "dns_name": F.when(coredns, json("domain"))
        .when(kind == "query", text(2))
        .when(kind.isin("reply", "forwarded"), text(1)),
        "dns_type": F.when(kind == "query", text(1)),
        "dns_result": F.when(kind == "reply", text(2)),
        "dns_client_ip": F.when(coredns, F.coalesce(json("ip"), json("src_ip"))).when(
            kind == "query", text(3)
        ),
        "dns_filter_type": F.when(coredns, json("type")),
        "dns_filter_category": F.when(coredns, json("category")),
        "wifi_action": wifi_state,
        "wifi_client_mac": wifi_client,
        "wifi_radio": F.when(kind.isin("text", "ap", "wpa"), text(1)),
        "wifi_ssid": F.when(cef, cef_ext("UNIFIwifiName")),
        "wifi_channel": F.when(cef, leading_int(cef_ext("UNIFIwifiChannel"))),
        "wifi_rssi": F.when(cef, leading_int(cef_ext("UNIFIWiFiRssi"))),
        "cef_event_class_id": F.when(cef, text(5)),
        "cef_name": F.when(cef, text(6)),
        "cef_severity": F.when(cef, leading_int(text(7))),
        "unifi_category": category,
        "unifi_subcategory": subcategory,
        "unifi_host": F.when(cef, cef_ext("UNIFIhost")),
        "client_alias": F.when(cef, cef_ext("UNIFIclientAlias")),
        "client_mac": F.when(cef, cef_ext("UNIFIclientMac")).when(coredns, json("mac")),
        "client_ip": F.when(cef, cef_ext("UNIFIclientIp")),
    }
    for name in ("interface_in", "interface_out", "src_ip", "dst_ip"):
        columns[name] = F.col(name)
    parsed = filters_stay_above(
        ends.select(*[columns[n].cast(EVENT_SCHEMA[n].dataType).alias(n) for n in PARSED_COLUMNS])
    )
    texts = {n for n in PARSED_COLUMNS if EVENT_SCHEMA[n].dataType == T.StringType()} - SET_HERE
    return parsed.select(
        *[show_marks(F.col(n)).alias(n) if n in texts else F.col(n) for n in PARSED_COLUMNS]
    )
