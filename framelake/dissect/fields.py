"""The declared fields of the layers above the fixed headers: what a catalog needs to know before any byte is read."""

from __future__ import annotations

from framelake.types import FieldType as T

#: By protocol: the fields of each type. Containers have no value; flags are booleans.
FIELDS: dict[str, dict[T, tuple[str, ...]]] = {
    "dns": {
        T.U64: ("dns.id", "dns.flags", "dns.flags.opcode", "dns.flags.rcode", "dns.count.queries", "dns.count.answers", "dns.count.auth_rr", "dns.count.add_rr", "dns.qry.name.len", "dns.qry.type", "dns.qry.class", "dns.resp.type", "dns.resp.class", "dns.resp.ttl", "dns.resp.len", "dns.mx.preference", "dns.soa.serial", "dns.soa.refresh", "dns.soa.retry", "dns.soa.expire", "dns.soa.minimum", "dns.opt.udp_size", "dns.opt.rcode", "dns.opt.version", "dns.nsec.type", "dns.srv.priority", "dns.srv.weight", "dns.srv.port"),
        T.BOOL: ("dns.flags.response", "dns.flags.authoritative", "dns.flags.truncated", "dns.flags.recdesired", "dns.flags.recavail", "dns.opt.do"),
        T.STRING: ("dns.qry.name", "dns.resp.name", "dns.ns", "dns.cname", "dns.ptr.domain_name", "dns.mx.mail_exchange", "dns.txt", "dns.soa.mname", "dns.soa.rname", "dns.nsec.next", "dns.srv.name"),
        T.IPV4: ("dns.a",),
        T.IPV6: ("dns.aaaa",),
        T.NONE: ("dns.qry", "dns.resp"),
    },
    "dhcp": {
        T.U64: ("dhcp.type", "dhcp.hw.type", "dhcp.hw.len", "dhcp.hops", "dhcp.id", "dhcp.secs", "dhcp.flags", "dhcp.cookie", "dhcp.option.type", "dhcp.option.length", "dhcp.option.lease_time", "dhcp.option.dhcp"),
        T.IPV4: ("dhcp.ip.client", "dhcp.ip.your", "dhcp.ip.server", "dhcp.ip.relay", "dhcp.option.subnet_mask", "dhcp.option.router", "dhcp.option.dns_server", "dhcp.option.requested_ip", "dhcp.option.dhcp_server_id"),
        T.MAC: ("dhcp.hw.mac_addr",),
        T.STRING: ("dhcp.option.hostname", "dhcp.option.vendor_class_id"),
        T.BYTES: ("dhcp.option",),
    },
    "dhcpv6": {
        T.U64: ("dhcpv6.msgtype", "dhcpv6.xid", "dhcpv6.option.code", "dhcpv6.option.length", "dhcpv6.option.elapsed_time", "dhcpv6.option.status_code"),
        T.BOOL: ("dhcpv6.option.rapid_commit",),
        T.IPV6: ("dhcpv6.option.dns_server",),
        T.BYTES: ("dhcpv6.option", "dhcpv6.option.value"),
    },
    "http": {
        T.U64: ("http.response.code", "http.content_length"),
        T.BOOL: ("http.response", "http.request"),
        T.STRING: ("http.response.version", "http.response.phrase", "http.request.method", "http.request.uri", "http.request.version", "http.header.name", "http.header.value", "http.host", "http.user_agent", "http.content_type_value", "http.transfer_encoding", "http.content_encoding", "http.upgrade", "http.connection"),
        T.BYTES: ("http.payload", "http.payload.decoded"),
        T.NONE: ("http.header",),
    },
    "tls": {
        T.U64: ("tls.record.content_type", "tls.record.version", "tls.record.length", "tls.alert.level", "tls.alert.description", "tls.handshake.type", "tls.handshake.length", "tls.handshake.certificate.length", "tls.handshake.version", "tls.handshake.ciphersuite", "tls.handshake.extension.type", "tls.handshake.extensions.supported_group", "tls.handshake.extensions.sig_hash_alg", "tls.handshake.extensions.supported_version", "tls.handshake.extensions.key_share.group"),
        T.STRING: ("tls.handshake.extensions.server_name", "tls.handshake.extensions.alpn_str"),
        T.BYTES: ("tls.handshake.certificate.data", "tls.handshake.random", "tls.handshake.session_id", "tls.handshake.extensions.key_share.key_exchange"),
        T.NONE: ("tls.record", "tls.handshake", "tls.handshake.certificate", "tls.handshake.extension", "tls.handshake.extensions.key_share.entry"),
    },
    "json": {
        T.F64: ("json.value.number",),
        T.STRING: ("json.key", "json.value.string"),
        T.BOOL: ("json.value.true", "json.value.false"),
        T.NONE: ("json.object", "json.array", "json.member", "json.value.null"),
    },
    "websocket": {
        T.U64: ("websocket.opcode", "websocket.payload_length"),
        T.BOOL: ("websocket.fin", "websocket.mask", "websocket.rsv1"),
        T.BYTES: ("websocket.payload", "websocket.payload.decoded"),
        T.NONE: ("websocket.frame",),
    },
    "http2": {
        T.U64: ("http2.frame.length", "http2.frame.type", "http2.frame.flags", "http2.frame.stream_id", "http2.settings.id", "http2.settings.value", "http2.window_update.increment", "http2.rst_stream.error_code", "http2.goaway.last_stream_id", "http2.goaway.error_code"),
        T.BOOL: ("http2.frame.flags.ack", "http2.frame.flags.end_stream", "http2.frame.flags.end_headers", "http2.frame.flags.padded", "http2.frame.flags.priority"),
        T.BYTES: ("http2.magic", "http2.ping.opaque", "http2.goaway.debug_data", "http2.frame.payload"),
        T.NONE: ("http2.frame", "http2.settings"),
    },
    "someip": {
        T.U64: ("someip.serviceid", "someip.methodid", "someip.length", "someip.clientid", "someip.sessionid", "someip.protocol_version", "someip.ifversion", "someip.msgtype", "someip.returncode"),
        T.BYTES: ("someip.payload",),
    },
    "someip_sd": {
        T.U64: ("someip_sd.entry.type", "someip_sd.entry.serviceid", "someip_sd.entry.instanceid", "someip_sd.entry.major", "someip_sd.entry.ttl", "someip_sd.entry.minor", "someip_sd.entry.counter", "someip_sd.entry.eventgroupid", "someip_sd.option.type", "someip_sd.option.protocol", "someip_sd.option.port"),
        T.BOOL: ("someip_sd.flags.reboot", "someip_sd.flags.unicast"),
        T.STRING: ("someip_sd.entry.kind", "someip_sd.option.config", "someip_sd.option.address"),
        T.BYTES: ("someip_sd.option.data",),
        T.NONE: ("someip_sd.entry", "someip_sd.option"),
    },
    "someip_tp": {T.U64: ("someip_tp.offset",), T.BOOL: ("someip_tp.more",), T.BYTES: ("someip_tp.data",)},
    "pdu_transport": {T.U64: ("pdu_transport.id", "pdu_transport.length"), T.BYTES: ("pdu_transport.payload",)},
    "can": {
        T.U64: ("can.id", "can.len", "can.xl.sdt", "can.xl.vcid", "can.xl.af", "can.xl.priority"),
        T.BOOL: ("can.flags.xtd", "can.flags.rtr", "can.flags.err", "can.flags.fd", "can.flags.brs", "can.flags.esi", "can.flags.xl", "can.flags.sec"),
        T.BYTES: ("can.data",),
    },
    "lin": {
        T.U64: ("lin.message_format", "lin.pid", "lin.id", "lin.parity", "lin.length", "lin.checksum", "lin.errors"),
        T.BOOL: ("lin.parity.valid",),
        T.STRING: ("lin.message_type", "lin.checksum_type", "lin.checksum.status"),
        T.BYTES: ("lin.data",),
    },
    "flexray": {
        T.U64: ("flexray.frame_id", "flexray.payload_length", "flexray.hcrc", "flexray.cycle"),
        T.BOOL: ("flexray.fcrc_err", "flexray.hcrc_err", "flexray.fes_err", "flexray.cod_err", "flexray.tss_viol", "flexray.ppi", "flexray.nfi", "flexray.sfi", "flexray.stfi"),
        T.STRING: ("flexray.channel",),
        T.BYTES: ("flexray.data",),
    },
    "dtls": {
        T.U64: ("dtls.record.content_type", "dtls.record.version", "dtls.record.epoch", "dtls.record.sequence_number", "dtls.record.length", "dtls.handshake.type", "dtls.handshake.length", "dtls.handshake.message_seq", "dtls.handshake.fragment_offset", "dtls.handshake.fragment_length"),
        T.NONE: ("dtls.record", "dtls.handshake"),
    },
    "sll": {T.U64: ("sll.pkttype", "sll.hatype", "sll.halen", "sll.etype"), T.MAC: ("sll.src.eth",)},
    "sll2": {T.U64: ("sll2.etype", "sll2.reserved", "sll2.if_index", "sll2.hatype", "sll2.pkttype", "sll2.halen"), T.MAC: ("sll2.src.eth",)},
    "llc": {T.U64: ("llc.dsap", "llc.ssap", "llc.control", "llc.type"), T.BYTES: ("llc.oui",)},
    "text": {T.STRING: ("text.line",)},
}

#: Layers that stand inside another one, whose presence says where to look for them.
CARRIER = {"someip_sd": "someip", "someip_tp": "someip"}


def kinds() -> dict[str, T]:
    return {name: kind for groups in FIELDS.values() for kind, names in groups.items() for name in names}


def owner(name: str) -> str:
    return next(p for p, groups in FIELDS.items() if any(name in names for names in groups.values()))


def declare(protocol: str, fields: dict[T, tuple[str, ...]], carrier: str | None = None) -> None:
    """Adds a protocol's fields, for dissectors that are registered from outside."""
    FIELDS[protocol] = fields
    if carrier:
        CARRIER[protocol] = carrier
