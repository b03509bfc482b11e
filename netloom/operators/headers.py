"""Fixed-offset numbers of packets, whole Arrow batches at a time.

Each step reads one number of every packet of a batch. All numbers on the wire are
unsigned, so ``NONE`` marks those that a packet does not have."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

NONE = -1
Numbers = np.ndarray

#: What ``headers`` returns, in order.
FIELDS = {
    "has_trailer": "boolean", "uid": "bigint", "app_name": "string", "fcs": "bigint", "size": "int",
    "l2": "string", "l2_truncated": "boolean", "ethertype": "bigint", "packet_type": "int", "l3_at": "int", "l3": "string",
    "ip_version": "int", "l3_ok": "boolean", "ip_protocol": "bigint", "src_ip": "string", "dst_ip": "string", "l4_at": "int", "l4": "string",
    "l3_truncated": "boolean", "l4_ok": "boolean", "src_port": "int", "dst_port": "int", "tcp_seq": "bigint", "tcp_ack": "bigint",
    "tcp_flags": "int", "tcp_window": "int", "udp_length": "int", "icmp_type": "int", "icmp_code": "int", "payload_at": "int",
    "payload_len": "int", "l4_truncated": "boolean", "l7": "string", "tls_type": "int", "tls_version": "int", "tls_length": "int",
    "tls_handshake": "int", "tls_handshake_length": "int", "tls_cipher": "int", "quic_type": "int", "quic_version": "bigint",
    "quic_dcid_length": "int", "quic_scid_length": "int", "quic_token_length": "bigint", "quic_length": "bigint", "quic_body_at": "int",
}
SCHEMA = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
_ARROW = {"boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_DECIMALS = pa.array([str(i) for i in range(256)])


class Packets:
    """The bytes of a batch end to end, and where each packet lies in them."""

    def __init__(self, data: pa.Array) -> None:
        data = data.cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        raw = data.buffers()[2]
        held = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.bytes = held if len(held) >= 64 else np.concatenate([held, np.zeros(64, np.uint8)])
        self.start, self.size = offsets[:-1], np.diff(offsets)

    def read(self, at: Numbers | int, n: int, where: Numbers | bool = True) -> Numbers:
        """The big-endian number of ``n`` bytes at ``at``; NONE outside the packet or where
        ``where`` is false."""
        ok = where & (np.asarray(at) >= 0) & (at + n <= self.size)
        place = np.where(ok, self.start + at, 0)
        value = np.zeros(len(self.size), np.int64)
        for i in range(n):
            value = (value << 8) | self.bytes[place + i]
        return np.where(ok, value, NONE)

    def rows(self, at: Numbers, n: int) -> Numbers:
        """``n`` bytes from ``at`` of each of the packets, as a matrix; ``at`` is absolute."""
        return self.bytes[at[:, None] + np.arange(n)]


def _choice(code: Numbers, values: tuple[int, ...], otherwise: int = NONE) -> Numbers:
    """``values[code]``; ``otherwise`` where the code is NONE."""
    return np.where(code >= 0, np.array(values)[code], otherwise)


def _named(code: Numbers, names: tuple[str, ...]) -> pa.Array:
    return pa.array(names).take(pa.array(code, mask=code < 0))


@lru_cache(maxsize=65536)
def ipv6_text(address: bytes) -> str:
    """Groups without leading zeros; the longest run of two or more zero groups, the first of
    equals, becomes ``::``."""
    groups = [address[i : i + 2].hex().lstrip("0") or "0" for i in range(0, 16, 2)]
    runs = [(0, 0)]
    for i, g in enumerate(groups):
        size, begin = runs[-1] if i and groups[i - 1] == "0" else (0, i)
        runs.append((size + 1, begin) if g == "0" else (0, i))
    size, begin = max(runs, key=lambda r: (r[0], -r[1]))
    if size < 2:
        return ":".join(groups)
    return ":".join(groups[:begin]) + "::" + ":".join(groups[begin + size :])


def _addresses(p: Packets, version: Numbers, at: Numbers, step: int) -> pa.Array:
    """Source (``step`` 0) or destination (1) as text."""
    four = [p.read(at + 12 + 4 * step + i, 1, version == 4) for i in range(4)]
    text = pc.binary_join_element_wise(*[_DECIMALS.take(pa.array(x, mask=x < 0)) for x in four], ".")
    six = np.flatnonzero(version == 6)
    if not len(six):
        return text
    long = [ipv6_text(x.tobytes()) for x in p.rows(p.start[six] + at[six] + 8 + 16 * step, 16)]
    return pc.replace_with_mask(text, pa.array(version == 6), pa.array(long, pa.string()))


def _trailer(p: Packets) -> dict:
    """The capturing app's trailer, recognised by its magic; it is no part of the packet."""
    at = p.size - C.TRAILER_BYTES
    found = p.read(at, 4) == int(C.TRAILER_MAGIC, 16)
    uid = p.read(at, 8, found) & 0xFFFFFFFF
    names = [None] * len(found)
    for i in np.flatnonzero(found):
        begin = p.start[i] + at[i] + 8
        names[i] = p.bytes[begin : begin + 20].tobytes().split(b"\0")[0].decode("utf-8", "replace").rstrip("�")
    out = {
        "has_trailer": found,
        "uid": pa.array(np.where(uid >= 1 << 31, uid - (1 << 32), uid), mask=~found),
        "app_name": pa.array(names, pa.string()),
        "fcs": p.read(at + 28, 4, found),
    }
    p.size = np.where(found, at, p.size)
    return out | {"size": p.size}


_L2, _L3 = (C.ETHERNET, C.SLL, C.SLL2), (C.IPV4, C.IPV6)
_L4, _L7 = (C.ICMP, C.TCP, C.UDP, C.ICMPV6), (C.HTTP, C.TLS, C.QUIC, C.DNS)
_ICMP, _TCP, _UDP, _ICMPV6 = range(4)
_HTTP, _TLS, _QUIC, _DNS = range(4)
#: The first bytes of an HTTP message, as the leading bits of a 64-bit number.
_STARTS = [(x, 8 * (8 - len(x))) for x in (b"HTTP/", *(m.encode() + b" " for m in C.HTTP_METHODS))]


def _coded(value: Numbers, codes: tuple[int, ...]) -> Numbers:
    """The position of each value among ``codes``, or NONE."""
    out = np.full(len(value), NONE)
    for i, x in enumerate(codes):
        out[value == x] = i
    return out


def _network(p: Packets, link: Numbers) -> dict:
    """Link and network layers. Fragments are read like whole packets."""
    l2 = _coded(link, (1, 113, 276))
    raw_ip = link == 101
    l3_at = np.where(raw_ip, 0, _choice(l2, (14, 16, 20)))
    cut_off = (l2 >= 0) & (p.size < l3_at)
    ethertype = p.read(_choice(l2, (12, 14, 0)), 2, ~cut_off)
    kind = np.where(link == 276, p.read(10, 1, ~cut_off), p.read(0, 2, ~cut_off & (link == 113)))
    nibble = p.read(0, 1, raw_ip) >> 4
    inside = (l3_at >= 0) & (p.size > l3_at)
    four = np.where(raw_ip, nibble == 4, (ethertype == 0x0800) & inside)
    six = np.where(raw_ip, nibble == 6, (ethertype == 0x86DD) & inside)
    l3 = np.where(four, 0, np.where(six, 1, NONE))
    ihl = (p.read(l3_at, 1, four) & 15) * 4
    whole = [four & (l3_at + 20 <= p.size) & (ihl >= 20) & (l3_at + ihl <= p.size), six & (l3_at + 40 <= p.size)]
    version = np.where(whole[0], 4, np.where(whole[1], 6, NONE))
    ok = version > 0
    protocol = p.read(l3_at + np.where(version == 4, 9, 6), 1, ok)
    l4_at = np.where(ok, l3_at + np.where(version == 4, ihl, 40), NONE)
    l4 = np.where(ok & (l4_at < p.size), _coded(protocol, (1, 6, 17, 58)), NONE)
    skipped = six & ok & ~np.isin(protocol, (1, 6, 17, 58, 59))
    return {
        "l2": l2, "l2_truncated": cut_off, "ethertype": ethertype, "packet_type": kind, "l3_at": l3_at, "l3": l3, "ip_version": version,
        "l3_ok": ok, "ip_protocol": protocol, "src_ip": _addresses(p, version, l3_at, 0), "dst_ip": _addresses(p, version, l3_at, 1),
        "l4_at": l4_at, "l4": l4, "l3_truncated": ((l3 >= 0) & ~ok) | skipped,
    }


def _transport(p: Packets, at: Numbers, l4: Numbers) -> dict:
    """TCP, UDP, ICMP and ICMPv6. The payload reaches to the end of the captured packet."""
    tcp, udp = l4 == _TCP, l4 == _UDP
    header = (p.read(at + 12, 1, tcp) >> 4) * 4
    tcp &= (at + 20 <= p.size) & (header >= 20) & (at + header <= p.size)
    udp &= at + 8 <= p.size
    icmp = ((l4 == _ICMP) | (l4 == _ICMPV6)) & (at + 4 <= p.size)
    ports = tcp | udp
    payload_at = np.where(tcp, at + header, np.where(udp, at + 8, NONE))
    flags = p.read(at + 12, 2, tcp)
    return {
        "l4_ok": ports | icmp, "src_port": p.read(at, 2, ports), "dst_port": p.read(at + 2, 2, ports), "tcp_seq": p.read(at + 4, 4, tcp),
        "tcp_ack": p.read(at + 8, 4, tcp), "tcp_flags": np.where(tcp, flags & 0x1FF, NONE), "tcp_window": p.read(at + 14, 2, tcp),
        "udp_length": p.read(at + 4, 2, udp), "icmp_type": p.read(at, 1, icmp), "icmp_code": p.read(at + 1, 1, icmp), "payload_at": payload_at,
        "payload_len": np.where(ports, np.maximum(p.size - payload_at, 0), NONE), "l4_truncated": (l4 >= 0) & ~(ports | icmp),
    }


def _varint(p: Packets, at: Numbers, where: Numbers) -> tuple[Numbers, Numbers]:
    """QUIC variable-length integers and where they end; NONE beyond the packet's end."""
    size = 1 << np.maximum(p.read(at, 1, where) >> 6, 0)
    value = np.full(len(size), NONE)
    for n in (1, 2, 4, 8):
        # The two leading bits say the size; in eight bytes they must not reach the sign.
        read = p.read(at, min(n, 4), where & (size == n)) & ((1 << (8 * min(n, 4) - 2)) - 1)
        if n == 8:
            read = (read << 32) | p.read(at + 4, 4, where & (size == n))
        value = np.where(where & (at + n <= p.size) & (size == n), read, value)
    return value, np.where(value >= 0, at + size, NONE)


def _applications(p: Packets, h: dict) -> dict:
    """Routing, by well-known port, in which case nothing else is tried, else by probing the
    payload; TCP never carries DNS here. Then the numbers of TLS records and QUIC long
    headers."""
    at, full = h["payload_at"], h["payload_len"] > 0
    tcp, udp = full & (h["l4"] == _TCP), full & (h["l4"] == _UDP)
    end = at + h["payload_len"]
    first = np.zeros(len(at), np.uint64)
    for i in range(8):
        first = (first << np.uint64(8)) | np.maximum(p.read(at + i, 1, tcp), 0).astype(np.uint64)
    http = tcp & np.any([first >> np.uint64(s) == int.from_bytes(x, "big") for x, s in _STARTS], axis=0)
    record, of = p.read(at, 1, tcp), p.read(at + 1, 2, tcp)
    tls = (h["payload_len"] >= 5) & (record >= 20) & (record <= 23) & (of >= 0x300) & (of <= 0x304)
    dcid = p.read(at + 5, 1, udp)
    scid = p.read(at + dcid + 6, 1, udp & (dcid >= 0))
    version = p.read(at + 1, 4, udp)
    known = np.isin(version, (0, 1, C.QUIC_V2)) | ((version >> 24) == 0xFF)
    long = (p.read(at, 1, udp) >= 0xC0) & known & (dcid >= 0) & (scid >= 0) & (at + dcid + 7 + scid <= end) & (h["payload_len"] >= 7)

    def port(ports: tuple[int, ...]) -> Numbers:
        return np.isin(h["src_port"], ports) | np.isin(h["dst_port"], ports)

    probed = np.where(tls, _TLS, np.where(http, _HTTP, NONE))
    over_tcp = np.where(port(C.HTTP_PORTS), np.where(http, _HTTP, NONE), np.where(port(C.TLS_PORTS), np.where(tls, _TLS, NONE), probed))
    over_udp = np.where(port(C.DNS_PORTS), _DNS, np.where(long, _QUIC, NONE))
    l7 = np.where(tcp, over_tcp, np.where(udp, over_udp, NONE))

    tls, quic = l7 == _TLS, l7 == _QUIC
    shake = tls & (record == 22) & (h["payload_len"] >= 9)
    kind, shake_length = p.read(at + 5, 1, shake), p.read(at + 6, 3, shake)
    session = p.read(at + 43, 1, shake & (kind == 2))
    suite_at = at + 44 + session
    suite = p.read(suite_at, 2, (session >= 0) & (suite_at + 2 <= at + 9 + shake_length))
    form = (p.read(at, 1, quic) >> 4) & 3
    initial = quic & (form == 0)
    token, behind = _varint(p, at + 7 + dcid + scid, quic)
    length, body = _varint(p, behind + token, quic & (token >= 0))
    return {
        "l7": l7, "tls_type": np.where(tls, record, NONE), "tls_version": np.where(tls, of, NONE), "tls_length": p.read(at + 3, 2, tls),
        "tls_handshake": kind, "tls_handshake_length": shake_length, "tls_cipher": suite, "quic_type": np.where(quic, form, NONE),
        "quic_version": np.where(quic, version, NONE), "quic_dcid_length": np.where(quic, dcid, NONE), "quic_scid_length": np.where(quic, scid, NONE),
        "quic_token_length": np.where(initial, token, NONE), "quic_length": np.where(initial, length, NONE), "quic_body_at": np.where(initial & (body >= 0), body - at, NONE),
    }


def _headers(data: pa.Array, link_type: pa.Array) -> pa.Array:
    p = Packets(data)
    h = _trailer(p)
    h |= _network(p, link_type.fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64))
    h |= _transport(p, h["l4_at"], h["l4"])
    h |= _applications(p, h)
    names = {"l2": _L2, "l3": _L3, "l4": _L4, "l7": _L7}
    out = []
    for field, kind in FIELDS.items():
        value = h[field]
        if field in names:
            value = _named(value, names[field])
        elif isinstance(value, np.ndarray) and kind != "boolean":
            value = pa.array(value, mask=value < 0)
        out.append((pa.array(value) if isinstance(value, np.ndarray) else value).cast(_ARROW[kind]))
    return pa.StructArray.from_arrays(out, list(FIELDS))


def headers(data: Column, link_type: Column) -> Column:
    """``FIELDS`` of each packet; a null packet counts as empty.

    Declared nondeterministic, so that the optimiser neither moves a filter on these values
    below them, where all would be computed a second time, nor merges them into what uses them;
    unused columns around them are pruned as ever."""
    return F.arrow_udf(_headers, SCHEMA).asNondeterministic()(data, link_type)
