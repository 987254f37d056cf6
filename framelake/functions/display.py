"""What numbers stand for, where a reader should see a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, from the registries of the protocols; by field.
TABLES: dict[str, dict[int, str]] = {
    "eth.type": {0x0800: "IPv4", 0x0806: "ARP", 0x8100: "802.1Q", 0x86DD: "IPv6", 0x88A8: "802.1ad"},
    "ip.proto": {1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP", 41: "IPv6", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 89: "OSPF", 132: "SCTP"},
    "arp.opcode": {1: "request", 2: "reply", 3: "reverse request", 4: "reverse reply"},
    "icmp.type": {0: "Echo reply", 3: "Destination unreachable", 5: "Redirect", 8: "Echo request", 11: "Time exceeded", 12: "Parameter problem", 13: "Timestamp request", 14: "Timestamp reply"},
    "icmpv6.type": {1: "Destination unreachable", 2: "Packet too big", 3: "Time exceeded", 4: "Parameter problem", 128: "Echo request", 129: "Echo reply", 133: "Router solicitation", 134: "Router advertisement", 135: "Neighbor solicitation", 136: "Neighbor advertisement", 137: "Redirect"},
    "dns.qry.type": {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 43: "DS", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 65: "HTTPS", 255: "ANY"},
    "dns.flags.rcode": {0: "No error", 1: "Format error", 2: "Server failure", 3: "No such name", 4: "Not implemented", 5: "Refused"},
    "dns.flags.opcode": {0: "Query", 1: "Inverse query", 2: "Status", 4: "Notify", 5: "Update"},
    "dhcp.option.dhcp": {1: "Discover", 2: "Offer", 3: "Request", 4: "Decline", 5: "ACK", 6: "NAK", 7: "Release", 8: "Inform"},
    "tls.record.content_type": {20: "Change cipher spec", 21: "Alert", 22: "Handshake", 23: "Application data", 24: "Heartbeat"},
    "tls.record.version": {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"},
    "tls.handshake.type": {0: "Hello request", 1: "Client hello", 2: "Server hello", 4: "New session ticket", 8: "Encrypted extensions", 11: "Certificate", 12: "Server key exchange", 13: "Certificate request", 14: "Server hello done", 15: "Certificate verify", 16: "Client key exchange", 20: "Finished"},
    "http2.frame.type": {0: "DATA", 1: "HEADERS", 2: "PRIORITY", 3: "RST_STREAM", 4: "SETTINGS", 5: "PUSH_PROMISE", 6: "PING", 7: "GOAWAY", 8: "WINDOW_UPDATE", 9: "CONTINUATION"},
    "websocket.opcode": {0: "Continuation", 1: "Text", 2: "Binary", 8: "Close", 9: "Ping", 10: "Pong"},
    "someip.msgtype": {0x00: "Request", 0x01: "Request no return", 0x02: "Notification", 0x80: "Response", 0x81: "Error", 0x20: "TP request", 0x21: "TP request no return", 0x22: "TP notification", 0xA0: "TP response", 0xA1: "TP error"},
    "frame.link_type": {1: "Ethernet", 113: "Linux cooked v1", 210: "FlexRay", 212: "LIN", 227: "SocketCAN", 276: "Linux cooked v2"},
}
TABLES["dns.resp.type"] = TABLES["dns.qry.type"]
TABLES["ipv6.nxt"] = TABLES["ip.proto"]


def shown(value: Column, field: str) -> Column:
    """The name of a value, null where it has none."""
    table = TABLES.get(field)
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k).cast("bigint"), F.lit(v))]), value.cast("bigint"))


def labelled(value: Column, field: str) -> Column:
    """`number (name)`, or the number alone."""
    return F.concat(value.cast("string"), F.coalesce(F.concat(F.lit(" ("), shown(value, field), F.lit(")")), F.lit("")))
