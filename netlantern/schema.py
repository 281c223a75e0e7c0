"""Table schemas and closed vocabularies shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The event columns, in storage order, grouped as they are documented.
IDENTITY = "id timestamp received_at raw_message"
COMMON = "event_type severity hostname source_format message"
NETWORK = (
    "action direction interface_in interface_out protocol src_ip src_port dst_ip dst_port "
    "packet_length ttl tcp_flags mac_src mac_dst rule_prefix"
)
IDS = (
    "ids_signature_id ids_signature ids_classification ids_priority threat_type threat_category"
)
DHCP = "dhcp_action dhcp_ip dhcp_mac dhcp_hostname dhcp_interface"
DNS = (
    "dns_action dns_name dns_type dns_result dns_client_ip dns_filter_type dns_filter_category"
)
WIFI = "wifi_action wifi_client_mac wifi_radio wifi_ssid wifi_channel wifi_rssi"
CEF = (
    "cef_event_class_id cef_name cef_severity unifi_category unifi_subcategory unifi_host "
    "client_alias client_mac client_ip"
)
ENRICHMENT = (
    "src_geo_country src_geo_city src_geo_lat src_geo_lon "
    "dst_geo_country dst_geo_city dst_geo_lat dst_geo_lon "
    "src_abuse_score dst_abuse_score src_hostname dst_hostname"
)

# Every column that is not text.
_TYPES = {
    "id": T.LongType(),
    "received_at": T.TimestampType(),
    **dict.fromkeys(
        "severity src_port dst_port packet_length ttl ids_priority wifi_channel wifi_rssi "
        "cef_severity src_abuse_score dst_abuse_score".split(),
        T.IntegerType(),
    ),
    **dict.fromkeys(
        "src_geo_lat src_geo_lon dst_geo_lat dst_geo_lon".split(), T.DoubleType()
    ),
}


def _struct(names: str) -> T.StructType:
    required = {"received_at", "event_type"}
    return T.StructType(
        [T.StructField(n, _TYPES.get(n, T.StringType()), n not in required) for n in names.split()]
    )


PARSED_COLUMNS = " ".join([IDENTITY, COMMON, NETWORK, IDS, DHCP, DNS, WIFI, CEF]).split()
ENRICHMENT_COLUMNS = ENRICHMENT.split()
EVENT_COLUMNS = PARSED_COLUMNS + ENRICHMENT_COLUMNS
EVENT_SCHEMA = _struct(" ".join(EVENT_COLUMNS))

INTEL_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.StringType()),
        T.StructField("geo_country", T.StringType()),
        T.StructField("geo_city", T.StringType()),
        T.StructField("geo_lat", T.DoubleType()),
        T.StructField("geo_lon", T.DoubleType()),
        T.StructField("abuse_score", T.IntegerType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("is_private", T.BooleanType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
# The six facts about an address that are copied onto each side of an event.
INTEL_FACTS = ["geo_country", "geo_city", "geo_lat", "geo_lon", "abuse_score", "hostname"]

# Closed vocabularies.
EVENT_TYPES = [
    "firewall", "threat", "dhcp", "dns", "dns_filter", "wifi",
    "admin", "device", "client", "vpn", "system",
]
TIMELINE_TYPES = ["firewall", "threat", "dhcp", "dns_filter", "wifi", "admin", "system"]
ENRICHABLE_TYPES = ["firewall", "threat", "dns_filter"]
SEVERITY_LABELS = [
    "Emergency", "Alert", "Critical", "Error", "Warning", "Notice", "Info", "Debug",
]
WAN_INTERFACES = [
    "eth0", "eth8", "eth9", "pppoe0", "pppoe1", "wg0", "wg1", "wgsts1000",
]
PORT_NAMES = {
    20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP",
    53: "DNS", 67: "DHCP", 68: "DHCP", 80: "HTTP", 110: "POP3",
    123: "NTP", 143: "IMAP", 161: "SNMP", 443: "HTTPS", 445: "SMB",
    465: "SMTPS", 514: "Syslog", 587: "SMTP", 993: "IMAPS", 995: "POP3S",
    1194: "OpenVPN", 1723: "PPTP", 3306: "MySQL", 3389: "RDP",
    5060: "SIP", 5353: "mDNS", 5432: "PostgreSQL", 6379: "Redis",
    7000: "AirPlay", 8080: "HTTP-Alt", 8443: "HTTPS-Alt", 8883: "MQTT-TLS",
    9100: "Printing", 27017: "MongoDB", 51820: "WireGuard",
}
