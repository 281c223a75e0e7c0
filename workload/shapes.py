"""Log-line shapes derived from the driver's ``events`` table.

Every shape has a line (what Spark renders and then parses) and the event columns the line stands
for (what the checking SQL computes straight from the formulas, without parsing anything). The
fragments are SQL text that means the same in Spark SQL and in DuckDB.

Names: ``e`` event id, ``u`` user, ``k`` shape number, ``ts`` the receive time. One user owns a
third of all rows, so that every query meets a hot key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

HOT_USER = 7
SHAPE_COUNT = 37  # prime, so that shape, hot rows (e % 3) and port (e % 5) are independent

USER = f"CASE WHEN event_id % 3 = 0 THEN {HOT_USER} ELSE user_id END"


# A third of the rows share their receive time with others, so that "newest" has ties to decide.
TIME = "CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) ELSE ts END"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def ext_ip(u: str) -> str:
    """Public address of a user; users 40 apart share a /24."""
    g = f"({u}) % 40"
    turn = f"CAST((({u}) - ({u}) % 5080) / 5080 AS BIGINT)"
    return (
        f"concat({text(f'11 + ({g}) % 25')}, '.', {text(f'(({g}) * 7 + {turn}) % 256')}, '.', "
        f"{text(f'(({g}) * 13) % 256')}, '.', {text(f'1 + ({u}) % 254')})"
    )


def lan_ip(u: str) -> str:
    return f"concat('172.16.', {text(f'({u}) % 16')}, '.', {text(f'1 + ({u}) % 254')})"


def mac(u: str) -> str:
    octets = f"lpad(lower(hex(({u}) % 65536)), 4, '0')"
    return f"concat('02:00:00:00:', substr({octets}, 1, 2), ':', substr({octets}, 3, 2))"


def port(u: str) -> str:
    return f"1024 + (({u}) * 37) % 64000"


def two(expr: str) -> str:
    return f"lpad({text(expr)}, 2, '0')"


CLOCK = f"concat({two('hour(ts)')}, ':', {two('minute(ts)')}, ':', {two('second(ts)')})"
STAMP = (
    "concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(ts) - 2, 3), ' ', "
    f"lpad({text('day(ts)')}, 2, ' '), ' ', {CLOCK})"
)
ISO = f"concat({text('year(ts)')}, '-', {two('month(ts)')}, '-', {two('day(ts)')}, 'T', {CLOCK}, 'Z')"

# Pieces that several shapes use: computed once per row, then referred to by name.
PIECES = {
    "ext": ext_ip("u"),
    "ext_peer": ext_ip("u * 11 + e % 13"),
    "lan": lan_ip("u"),
    "lan_peer": lan_ip("u + 1"),
    "mac": mac("u"),
    "sport": port("u"),
    "dport": "CASE e % 5 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 ELSE 7000 END",
    "stamp": STAMP,
    "iso": ISO,
    "domain": f"concat('host', {text('u % 50')}, '.example.org')",
    "phone": f"concat('phone-', {text('u % 20')})",
}
EXT, EXT_PEER, LAN, LAN_PEER, MAC = "ext", "ext_peer", "lan", "lan_peer", "mac"
SPORT, DPORT, STAMP, ISO, DOMAIN, PHONE = "sport", "dport", "stamp", "iso", "domain", "phone"
AID = "1 + u % 9"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@dataclass
class Shape:
    """A line, the header it starts with, the event it stands for, and the format that claims it
    though its own pattern doesn't fit."""

    line: list[str]
    header: dict[str, str]
    expect: dict[str, str] = field(default_factory=dict)
    misfit: str = ""


def _make(lead: list[str], rest: list[str], common: dict, own: dict) -> Shape:
    event = {c: v for c, v in common.items() if c in ("timestamp", "hostname", "severity")}
    header = {**common, "message": join(rest)}
    return Shape([*lead, *rest], header, {**event, **own})


def _std(pri: int | None, host: str, doubled: bool = False, device: str = ""):
    """Header with ``<N>``, stamp and host."""
    head = f"<{pri}>" if pri is not None else ""
    tail = f" {host} " + (f"{host} " if doubled else "") + (f"{device}: " if device else "")
    common = {"timestamp": STAMP, "hostname": q(host)}
    if pri is not None:
        common |= {"severity": str(pri % 8), "priority": str(pri)}
    if device:
        common["mac_model"] = q(device)
    return [q(head), STAMP, q(tail)], common


def _switch(host: str):
    tag = "5ca1ab1e0001,Rack48-1.9.7+40"
    common = {"timestamp": STAMP, "hostname": q(host), "severity": "5", "priority": "13",
              "mac_model": q(tag)}
    return [q(f"{tag} "), STAMP, q(f" {host} user.notice ")], common


def _firewall(pri, rule, descr, in_if, out_if, src, dst, action, direction, repeat=None, proto="TCP"):
    lead, common = _std(pri, "edge")
    flags, gate = (" PSH" if proto == "TCP" else ""), "02:ed:9e:00:00:01"
    line = [
        q(f'[{rule}] DESCR="{descr}" IN={in_if} OUT={out_if} MAC={gate}:'), MAC,
        q(":08:00" + (f" SRC={repeat}" if repeat else "") + " SRC="), src, q(" DST="), dst,
        q(" LEN="), text("40 + u % 9"), q(" TTL="), text("200 + u % 16"),
        q(f" DF PROTO={proto} SPT="), text(SPORT), q(" DPT="), text(DPORT),
        q(f" ACK=0 RES=0x00{flags} URGP=0"),
    ]
    own = {
        "event_type": q("firewall"), "source_format": q("iptables"), "message": q(descr or rule),
        "action": q(action), "direction": q(direction), "interface_in": q(in_if),
        "interface_out": q(out_if) if out_if else "NULL", "protocol": q(proto),
        "src_ip": src, "src_port": SPORT, "dst_ip": dst, "dst_port": DPORT,
        "packet_length": "40 + u % 9", "ttl": "200 + u % 16",
        "tcp_flags": q("DF,PSH" if flags else "DF"),
        "mac_src": MAC, "mac_dst": q(gate), "rule_prefix": q(rule),
    }
    return _make(lead, line, common, own)


def _alert(sid, rev, name, cls, prio, proto, src, dst, dport):
    lead, common = _std(1, "edge")
    line = [
        q(f"suricata[77]: [1:{sid}:{rev}] {name} [**] [Classification: {cls}] "
          f"[Priority: {prio}] {{{proto}}} "),
        src, q(":"), text(SPORT), q(" -> "), dst, q(":"), text(dport),
    ]
    own = {
        "event_type": q("threat"), "source_format": q("suricata"), "message": q(name),
        "action": q("block"), "protocol": q(proto), "src_ip": src, "src_port": SPORT,
        "dst_ip": dst, "dst_port": dport, "ids_signature_id": q(f"1:{sid}:{rev}"),
        "ids_signature": q(name), "ids_classification": q(cls), "ids_priority": str(prio),
    }
    return _make(lead, line, common, own)


def _lease(verb, iface, ip, name):
    lead, common = _std(30, "edge", doubled=True)
    line = [q(f"dnsmasq-dhcp[5]: {verb}({iface}) ")]
    note = [q(f"{verb} ")]
    own = {
        "event_type": q("dhcp"), "source_format": q("dnsmasq"), "dhcp_action": q(verb),
        "dhcp_mac": MAC, "dhcp_interface": q(iface),
    }
    if ip:
        line += [ip, q(" ")]
        note += [ip]
        own["dhcp_ip"] = ip
    line += [MAC]
    note += [q(" "), MAC]
    if name:
        line += [q(" "), name]
        note += [q(" "), name]
        own["dhcp_hostname"] = name
    own["message"] = join(note)
    return _make(lead, line, common, own)


def join(parts: list[str]) -> str:
    return f"concat({', '.join(parts)})"


def _filter_log(kind, category, domain):
    lead, common = _std(13, "edge", doubled=True)
    line = [
        q(f'coredns[8]: {{"type":"{kind}","domain":"{domain}","timestamp":"'), ISO,
        q(f'","protocol":"tcp","category":"{category}","src_ip":"'), LAN, q('","src_port":'),
        text(SPORT), q(',"dst_ip":"10.9.8.7","dst_port":5353,"mac":"'), MAC, q('","ip":"'), LAN,
        q('"}'),
    ]
    own = {
        "event_type": q("dns_filter"), "source_format": q("coredns"), "timestamp": ISO,
        "message": join([q(f"{kind}: {domain} ({category}) from "), LAN]),
        "action": q("block"), "protocol": q("TCP"), "src_ip": LAN, "src_port": SPORT,
        "dst_ip": q("10.9.8.7"), "dst_port": "5353", "dns_action": q("blocked"),
        "dns_name": q(domain), "dns_client_ip": LAN, "dns_filter_type": q(kind),
        "dns_filter_category": q(category), "client_mac": MAC,
    }
    return _make(lead, line, common, own)


def _wifi(host, tail, own):
    lead, common = _std(14, host, device="0badcafe0002,Ceiling6-2.0.1+9")
    base = {
        "event_type": q("wifi"), "source_format": q("hostapd"), "wifi_radio": q("radio5g"),
        "wifi_client_mac": MAC,
    }
    return _make(lead, [q("hostapd[61]: radio5g: "), *tail], common, {**base, **own})


def _cef(class_id, name, sev, ext, own):
    lead, common = _std(None, "edge")
    line = [q(f"CEF:0|Example|Controller|4.5|{class_id}|{name}|{sev}|"), *ext]
    base = {
        "source_format": q("cef"), "cef_event_class_id": q(str(class_id)), "cef_name": q(name),
        "cef_severity": str(sev),
    }
    return _make(lead, line, common, {**base, **own})


def _plain(pri, text_in, expect, kind="system", fmt="raw", misfit=""):
    lead, common = _std(pri, "edge", doubled=True)
    own = {"event_type": q(kind), "source_format": q(fmt), "message": join(expect)}
    shape = _make(lead, text_in, common, own)
    shape.misfit = misfit
    return shape


def _dns(tail, own):
    lead, common = _std(30, "edge", doubled=True)
    base = {"event_type": q("dns"), "source_format": q("dnsmasq"), "message": join(tail)}
    return _make(lead, [q("dnsmasq[12]: "), *tail], common, {**base, **own})


CUT_JSON = 'coredns[8]: {"type":"categoryBlock","domain":"late.example.net"} tail'
# A character that no text should hold, and that anyone may send.
ODD = "￿"
LONG = " ".join(f"part{i}" for i in range(120))


def _shapes() -> list[Shape]:
    """Grouped by the format that reads them; each takes another way through its pattern."""
    sta = [q("STA "), MAC]
    relay_lead, relay_common = _switch("rack")
    gone = f"exporter{ODD}[3]: wrote {ODD}{ODD} lines"
    return [
        # free text
        _make([q("probe-"), text("u % 6"), q(" ")],
              [q("up for "), text("e % 90"), q(" days 100% ok")],
              {"hostname": join([q("probe-"), text("u % 6")])},
              {"event_type": q("system"), "source_format": q("raw"),
               "message": join([q("up for "), text("e % 90"), q(" days 100% ok")])}),
        _plain(14, [q("agentd[40]: inventory: wrote 12 rows")], [q("inventory: wrote 12 rows")]),
        _plain(14, [q(gone)], [q(f"wrote {ODD}{ODD} lines")]),
        _make(relay_lead, [q("portd#main[9]: [4][NOTE] Port: Ethernet3, Status: UP")],
              relay_common, {"event_type": q("system"), "source_format": q("raw"),
                             "message": q("[4][NOTE] Port: Ethernet3, Status: UP")}),
        _plain(14, [q("export[9]: wrote CEF: records for "), LAN],
               [q("wrote CEF: records for "), LAN], misfit="system"),
        # tunnels
        _plain(14, [q("tunneld[31]: wireguard: Peer "), EXT, q(" handshake done")],
               [q("wireguard: Peer "), EXT, q(" handshake done")], kind="vpn"),
        # names
        _dns([q("forwarded "), DOMAIN, q(" to 192.0.2.53")],
             {"dns_action": q("forwarded"), "dns_name": DOMAIN, "dst_ip": q("192.0.2.53")}),
        _dns([q("query[AAAA] "), DOMAIN, q(" from "), LAN],
             {"dns_action": q("query"), "dns_type": q("AAAA"), "dns_name": DOMAIN,
              "dns_client_ip": LAN}),
        _dns([q("reply "), DOMAIN, q(" is "), EXT],
             {"dns_action": q("reply"), "dns_name": DOMAIN, "dns_result": EXT}),
        _plain(30, [q("dnsmasq[12]: using nameserver 192.0.2.53#53")],
               [q("using nameserver 192.0.2.53#53")], kind="dns", fmt="dnsmasq", misfit="dns"),
        _filter_log("categoryBlock", "GAMBLING", "bets.example.net"),
        _filter_log("listBlock", "TRACKERS", f"pixel{ODD}.example.org"),
        _plain(13, [q(CUT_JSON)], [q(CUT_JSON)], kind="dns_filter", fmt="coredns",
               misfit="coredns"),
        # leases
        _lease("DHCPDISCOVER", "br20", None, None),
        _lease("DHCPOFFER", "br6", LAN, None),
        _lease("DHCPACK", "br6", LAN, join([q("box-"), text("u % 30")])),
        _plain(30, [q("dnsmasq-dhcp[5]: no address range for "), LAN],
               [q("no address range for "), LAN], kind="dhcp", fmt="dnsmasq", misfit="dhcp"),
        _make(relay_lead,
              [q("dhcp_relay#dhcpsnpd[6]: DHCP packet with source IP 0.0.0.0 received on VLAN "),
               text("20 + u % 8")],
              relay_common,
              {"event_type": q("dhcp"), "source_format": q("dhcp-relay"),
               "dhcp_interface": join([q("VLAN"), text("20 + u % 8")]),
               "message": join([q("DHCP packet with source IP 0.0.0.0 received on VLAN "),
                                text("20 + u % 8")])}),
        _make(relay_lead,
              [q("dhcp_relay#dhcpsnpd[6]: ACK received: ifname Ethernet11, src_ip 10.1.1.1, "
                 "src_mac 02:ed:9e:00:00:01, chaddr "), MAC, q(", yiaddr "), LAN, q(".")],
              relay_common,
              {"event_type": q("dhcp"), "source_format": q("dhcp-relay"),
               "dhcp_action": q("DHCPACK"), "dhcp_interface": q("Ethernet11"), "dhcp_ip": LAN,
               "dhcp_mac": MAC,
               "message": join([q("DHCPACK relay "), LAN, q(" "), MAC, q(" via Ethernet11")])}),
        # wireless
        _wifi("hall", [*sta, q(" WPA: group key handshake completed")], {
            "wifi_action": q("handshake"),
            "message": join([*sta, q(" WPA: group key handshake completed")])}),
        _wifi("hall", [q("AP-STA-DISCONNECTED "), MAC], {
            "wifi_action": q("disconnected"), "message": join([*sta, q(" disconnected")])}),
        _wifi("roof", [q("AP-STA-CONNECTED "), MAC], {
            "wifi_action": q("connected"), "message": join([*sta, q(" connected")])}),
        _wifi("roof", [*sta, q(" IEEE 802.11: deauthenticated, reason "), text(AID)], {
            "wifi_action": join([q("deauthenticated, reason "), text(AID)]),
            "message": join([*sta, q(" deauthenticated, reason "), text(AID)])}),
        _wifi("roof", [*sta, q(" IEEE 802.11: authenticated")], {
            "wifi_action": q("authenticated"), "message": join([*sta, q(" authenticated")])}),
        _plain(14, [q(f"hostapd[61]: radio5g: {LONG}")], [q(f"radio5g: {LONG}")], kind="wifi",
               fmt="hostapd", misfit="wifi"),
        # controller records
        _cef(308, "Device Offline", 6, [q("UNIFIhost=rack-lab UNIFIutcTime="), ISO],
             {"event_type": q("device"), "unifi_host": q("rack-lab"), "timestamp": ISO,
              "message": q("Device Offline")}),
        _cef(233, f"Attack Stopped {ODD}", 9,
             [q("UNIFIcategory=Security UNIFIthreatType=Worm UNIFIsubCategory=Threat "
                f"UNIFIthreatCategory=Remote {ODD} Code proto=UDP dpt=8443 dst="), EXT_PEER,
              q(" spt="), text(SPORT), q(" src="), LAN, q(" UNIFIutcTime="), ISO,
              q(" msg=Worm traffic stopped")],
             {"event_type": q("threat"), "action": q("block"), "protocol": q("UDP"),
              "src_ip": LAN, "src_port": SPORT, "dst_ip": EXT_PEER, "dst_port": "8443",
              "unifi_category": q("Security"), "unifi_subcategory": q("Threat"),
              "threat_type": q("Worm"), "threat_category": q(f"Remote {ODD} Code"),
              "timestamp": ISO, "message": q("Worm traffic stopped")}),
        _cef(417, "Client Joined", 2,
             [q("UNIFIwifiChannel=36 UNIFIwifiName=Lab Net UNIFIWiFiRssi=-"), text("50 + u % 40"),
              q(" UNIFIclientIp="), LAN, q(" UNIFIclientMac="), MAC, q(" UNIFIclientAlias="), PHONE,
              q(" UNIFIcategory=Client Devices UNIFIhost=edge UNIFIutcTime="), ISO,
              q(" msg="), PHONE, q(" joined")],
             {"event_type": q("client"), "unifi_category": q("Client Devices"),
              "unifi_host": q("edge"), "client_alias": PHONE, "client_mac": MAC,
              "client_ip": LAN, "wifi_ssid": q("Lab Net"), "wifi_channel": "36",
              "wifi_rssi": "-(50 + u % 40)", "timestamp": ISO,
              "message": join([PHONE, q(" joined")])}),
        _cef(533, "Settings Saved", 3,
             [q("cnt=2 UNIFIhost=edge UNIFIcategory=Audit src="), LAN, q(" UNIFIutcTime="), ISO],
             {"event_type": q("admin"), "src_ip": LAN, "unifi_category": q("Audit"),
              "unifi_host": q("edge"), "timestamp": ISO, "message": q("Settings Saved")}),
        _cef(510, "Operator Signed In", 4,
             [q("UNIFIutcTime="), ISO, q(" UNIFIadmin=Noor UNIFIhost=edge UNIFIcategory=Audit src="),
              LAN, q(" msg=Noor signed in. y=2 From: "), LAN],
             {"event_type": q("admin"), "src_ip": LAN, "unifi_category": q("Audit"),
              "unifi_host": q("edge"), "timestamp": ISO,
              "message": join([q("Noor signed in. y=2 From: "), LAN])}),
        # alerts
        _alert(9000031, 1, f"LOCAL {ODD} sweep of ports", "Network Scan", 3, "TCP", EXT, LAN, DPORT),
        _alert(9000207, 5, "LOCAL lookup of a listed name", "Policy Notice", 2, "UDP", EXT,
               EXT_PEER, "53"),
        _plain(1, [q("suricata[77]: flow table is full")], [q("suricata[77]: flow table is full")],
               fmt="suricata", misfit="ids"),
        # packets
        _firewall(4, "NET_HOME-R-DENY_7", "", "eth9", "br6", EXT, LAN, "block", "inbound",
                  repeat="198.51.100.9", proto="UDP"),
        _firewall(4, "NET_GATE-D-31", "Closed from outside", "eth9", "", EXT,
                  q("172.16.8.254"), "block", "local"),
        _firewall(6, "HOME_NET-A-12", "Open to outside", "br6", "eth9", LAN, EXT_PEER,
                  "allow", "outbound"),
        _firewall(13, "HOME_LAB-A-7", f"Home {ODD} to lab", "br6", "br20", LAN, LAN_PEER,
                  "allow", "inter-vlan"),
    ]


SHAPES = _shapes()
assert len(SHAPES) == SHAPE_COUNT

# Shapes that a format claims but whose own pattern does not fit, with the name of the format.
MISFITS = {k: shape.misfit for k, shape in enumerate(SHAPES) if shape.misfit}


def by_shape(values: list[str]) -> str:
    """``CASE`` over the shape number; equal neighbours are not merged, to keep it plain."""
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values) if v != "NULL")
    return f"CASE k {cases} END" if cases else "NULL"


RAW = by_shape([join(s.line) for s in SHAPES])
