"""Golden lines: each format, each fallback, and the header's corner cases."""

import pytest
from pyspark.sql import functions as F

from netlantern.operators.parse import parse_rejects, parse_syslog, with_header

FW = (
    '<13>Mar  7 07:25:08 gw [LAN_X-A-1] DESCR="a b" IN=br4 OUT=br10 '
    "MAC=60:22:32:80:f9:e0:02:00:00:00:00:07:08:00 SRC=172.16.4.5 DST=172.16.10.9 LEN=64 TTL=63 "
    "DF PROTO=TCP SPT=1034 DPT=7000 ACK=0 SYN URGP=0"
)
STD = "<30>Mar  7 07:25:08 gw gw "
JSON = '{"timestamp":"T1","type":"t","category":"C","domain":"d","ip":"1.1.1.1","src_ip":"2.2.2.2","src_port":0,"protocol":"udp"}'
CEF = "Mar 07 07:26:58 gw CEF:0|V|P|1|{cls}|Name|{sev}|{ext}"

CASES = [
    (FW, dict(event_type="firewall", source_format="iptables", action="allow",
              direction="inter-vlan", message="a b", severity=5, hostname="gw", src_port=1034,
              dst_port=7000, packet_length=64, ttl=63, tcp_flags="DF,SYN", protocol="TCP",
              mac_src="02:00:00:00:00:07", mac_dst="60:22:32:80:f9:e0", rule_prefix="LAN_X-A-1")),
    (FW.replace("LAN_X-A-1", "WAN-R-REJECT_1").replace("OUT=br10", "OUT="),
     dict(action="block", direction="local", interface_out=None)),
    (FW.replace("SRC=172.16.4.5", "SRC=9.9.9.9 SRC=8.8.8.8"),
     dict(src_ip="8.8.8.8", direction="outbound")),
    (FW.replace("IN=br4", "IN=eth8"), dict(direction="inbound")),
    (FW.replace("OUT=br10", "OUT=eth9"), dict(direction="outbound")),
    (FW.replace(":02:00:00:00:00:07:08:00", ""), dict(mac_src=None, mac_dst=None)),
    (FW.replace("SPT=1034", "NOTE=x,SPT=99 SPT=80x"), dict(src_port=80)),
    (FW.replace("SYN URGP", "URGP").replace(" DF ", " "), dict(tcp_flags=None)),
    ("<1>Mar  7 07:25:08 gw suricata[1]: [1:2:3] Sig nature [**] [Classification: Bad] [Priority: 2]"
     " {UDP} 1.2.3.4:5 -> 6.7.8.9:53",
     dict(event_type="threat", action="block", ids_signature_id="1:2:3", ids_signature="Sig nature",
          ids_classification="Bad", ids_priority=2, src_port=5, dst_ip="6.7.8.9", severity=1)),
    ("<1>Mar  7 07:25:08 gw suricata[1]: [1:2:3] broken",
     dict(event_type="system", source_format="suricata", message="suricata[1]: [1:2:3] broken")),
    (STD + "dnsmasq-dhcp[3]: DHCPACK(br4) 172.16.4.6 aa:bb:cc:dd:ee:ff name here",
     dict(event_type="dhcp", dhcp_action="DHCPACK", dhcp_ip="172.16.4.6", dhcp_hostname="name here",
          dhcp_mac="aa:bb:cc:dd:ee:ff", dhcp_interface="br4",
          message="DHCPACK 172.16.4.6 aa:bb:cc:dd:ee:ff name here")),
    (STD + "dnsmasq-dhcp[3]: DHCPDISCOVER(br8) aa:bb:cc:dd:ee:ff",
     dict(message="DHCPDISCOVER  aa:bb:cc:dd:ee:ff", dhcp_ip=None, dhcp_hostname=None)),
    (STD + "dnsmasq-dhcp[3]: DHCP, IP range 1", dict(event_type="dhcp", message="DHCP, IP range 1")),
    ("942a6f40d752,SW-1.0+8 Mar  7 07:25:08 sw daemon.info dhcp_relay#dhcpsnpd[3]: ACK received: "
     "ifname E46, src_ip 1.1.1.1, src_mac aa:bb, chaddr cc:dd, yiaddr 2.2.2.2.",
     dict(source_format="dhcp-relay", dhcp_action="DHCPACK", dhcp_interface="E46",
          dhcp_ip="2.2.2.2", dhcp_mac="cc:dd", severity=6, hostname="sw",
          message="DHCPACK relay 2.2.2.2 cc:dd via E46")),
    ("942a6f40d752,SW-1.0+8 Mar  7 07:25:08 sw auth.err dhcpsnpd[3]: DHCP OFFER packet received on VLAN 4",
     dict(dhcp_interface="VLAN4", message="DHCP OFFER packet received on VLAN 4", severity=3)),
    (STD + "dnsmasq[3]: query[AAAA] a.b from 1.1.1.1",
     dict(event_type="dns", dns_action="query", dns_type="AAAA", dns_name="a.b",
          dns_client_ip="1.1.1.1", message="query[AAAA] a.b from 1.1.1.1")),
    (STD + "dnsmasq[3]: reply a.b is 9.9.9.9", dict(dns_action="reply", dns_result="9.9.9.9")),
    (STD + "dnsmasq[3]: forwarded a.b to 9.9.9.9", dict(dns_action="forwarded", dst_ip="9.9.9.9")),
    (STD + "dnsmasq[3]: other text", dict(dns_action=None, message="other text")),
    (STD + "coredns[2]: " + JSON,
     dict(event_type="dns_filter", timestamp="T1", action="block", dns_action="blocked",
          dns_client_ip="1.1.1.1", src_ip="2.2.2.2", src_port=0, protocol="UDP",
          message="t: d (C) from 1.1.1.1")),
    (STD + "coredns[2]: " + JSON + " tail", dict(action=None, dns_name=None)),
    (STD + "coredns[2]: " + JSON + ",\"x\":1}", dict(action=None)),
    (STD + "coredns[2]: " + JSON + "] x}", dict(action=None)),
    (STD + "coredns[2]: " + JSON[:-1], dict(action=None, event_type="dns_filter")),
    (STD + "coredns[2]: {'type':'t'}", dict(action=None)),
    (STD + "coredns[2]: {\"type\":\"t\"}", dict(message="t:  () from ", action="block")),
    ("<14>Mar  7 07:25:08 ap 28704e551ced,U7-8.5+1: hostapd[1]: w2: STA aa:bb:cc:dd:ee:ff IEEE 802.11: associated (aid 1)",
     dict(event_type="wifi", wifi_action="associated (aid 1)", wifi_radio="w2",
          wifi_client_mac="aa:bb:cc:dd:ee:ff", message="STA aa:bb:cc:dd:ee:ff associated (aid 1)")),
    (STD + "hostapd[1]: w2: AP-STA-DISCONNECTED aa:bb:cc:dd:ee:ff", dict(wifi_action="disconnected")),
    (STD + "hostapd[1]: w2: STA aa:bb:cc:dd:ee:ff WPA: key done",
     dict(wifi_action="handshake", message="STA aa:bb:cc:dd:ee:ff WPA: key done")),
    (STD + "hostapd[1]: w2: else", dict(wifi_action=None, message="w2: else")),
    (CEF.format(cls=201, sev=7, ext="src=1.1.1.1 spt=5 UNIFIcategory=Security UNIFIsubCategory=Threat "
                "UNIFIthreatCategory=Command and Control msg=bad x=1"),
     dict(event_type="threat", action="block", src_port=5, threat_category="Command and Control",
          message="bad x=1", severity=None, cef_severity=7, cef_event_class_id="201")),
    (CEF.format(cls=402, sev=1, ext="UNIFIcategory=Client Devices UNIFIclientAlias=My Phone"),
     dict(event_type="client", client_alias="My Phone", message="Name", action=None)),
    (CEF.format(cls=402, sev=1, ext="a=1"), dict(event_type="wifi")),
    (CEF.format(cls=301, sev=1, ext="src= dst=2.2.2.2"), dict(event_type="device", src_ip=None, dst_ip="2.2.2.2")),
    (CEF.format(cls="5x", sev=1, ext="UNIFIcategory=Audit"), dict(event_type="admin")),
    (CEF.format(cls="x", sev=1, ext=""), dict(event_type="system", message="Name")),
    (STD + "app: text with CEF: inside", dict(event_type="system", source_format="raw", message="text with CEF: inside")),
    (STD + "udapi[2]: wireguard: up", dict(event_type="vpn", source_format="raw", message="wireguard: up")),
    (STD + "kernel: [1.2] br0: up", dict(event_type="system", message="[1.2] br0: up")),
    ("hello there world", dict(event_type="system", hostname="hello", message="there world", severity=None)),
    ("single", dict(event_type="system", hostname=None, message="single")),
    ("\t <13>Mar  7 07:25:08 h text \r\n", dict(severity=5, hostname="h", message="text")),
]


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id BIGINT, raw STRING")
    lines = lines.withColumn("received_at", F.timestamp_seconds(F.lit(0)))
    return {r["id"]: r.asDict() for r in parse_syslog(lines).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_line(parsed, i):
    want = CASES[i][1]
    assert {k: parsed[i][k] for k in want} == want


def test_blank_lines_are_dropped(spark):
    lines = spark.createDataFrame([(1, "  "), (2, "\t\r\n"), (3, ""), (4, "x y")], "id BIGINT, raw STRING")
    assert [r.id for r in with_header(lines).collect()] == [4]


def test_header_parts(spark):
    raw = [
        "942a6f40d752,SW-1.0+8: Mar  7 07:25:08 sw auth.err body text",
        "<191>h 28704e551ced,U7-8.5+1: body",
        "<13>Mar  7 07:25:08 gw gw gw x",
    ]
    lines = spark.createDataFrame(list(enumerate(raw)), "id BIGINT, raw STRING")
    got = {r.id: (r.priority, r.severity, r.hostname, r.mac_model, r.message)
           for r in with_header(lines).collect()}
    assert got[0] == (None, 3, "sw", "942a6f40d752,SW-1.0+8", "body text")
    assert got[1] == (191, 7, "h", "28704e551ced,U7-8.5+1", "body")
    assert got[2] == (13, 5, "gw", None, "gw x")


def test_rejects_and_missing_key(spark):
    lines = spark.createDataFrame(
        [(STD + "dnsmasq[3]: other",), (STD + "kernel: ok",), (STD + "hostapd[1]: else",)], "raw STRING"
    ).withColumn("received_at", F.timestamp_seconds(F.lit(0)))
    rows = parse_rejects(lines).collect()
    assert sorted(r.format for r in rows) == ["dns", "wifi"]
    assert len({r.id for r in parse_syslog(lines).collect()}) == 3


def test_odd_characters_stay(spark):
    texts = [
        "<13>Mar  7 07:25:08 gw proc[1]: hello \uffff world \ufffe tail \ufdd1",
        "\uffff<13>Mar  7 07:25:08 gw proc[1]: x",
        "<1>Mar  7 07:25:08 gw suricata[1]: [1:5:1] Bad \uffff thing [**] [Classification: C] "
        "[Priority: 2] {UDP} 1.2.3.4:5 -> 5.6.7.8:53",
        "<13>Mar  7 07:25:08 gw suricata[1]: " + "long " * 300 + "end",
    ]
    lines = spark.createDataFrame(list(enumerate(texts)), "id LONG, raw STRING").selectExpr(
        "id", "current_timestamp() AS received_at", "raw"
    )
    rows = {r.id: r for r in parse_syslog(lines).collect()}
    assert rows[0].message == "hello \uffff world \ufffe tail \ufdd1"
    assert rows[1].raw_message == texts[1]
    assert (rows[2].ids_signature, rows[2].src_ip, rows[2].event_type) == ("Bad \uffff thing", "1.2.3.4", "threat")
    assert rows[3].message.endswith("end")
    (reject,) = parse_rejects(lines).collect()
    assert reject.text == texts[3]
