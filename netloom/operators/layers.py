"""The protocol tree: layers with fields, values as shown and the bytes they come from.

Built only for detail views; lists, filters and aggregates use the flat columns. The tree is one
SQL expression over those, put together as text: as many single column objects would take
longer to plan than to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bytes import cut, hex_lower, named_sql
from ..schema import FIELD, LAYER
from .dissect import flag_names_sql

_UNKNOWN = "'Unknown'"
_CHILD = "array<struct<name:string,value:string,start:int,end:int>>"


def _leaf(name: str, value: str, start: str | None = None, size: int | str = 1) -> str:
    """A field without children as SQL; ``name`` is text, the others are SQL."""
    place = "CAST(NULL AS INT) AS start, CAST(NULL AS INT) AS end" if start is None else f"CAST({start} AS INT) AS start, CAST({start} + {size} - 1 AS INT) AS end"
    return f"struct('{name}' AS name, CAST({value} AS STRING) AS value, {place})"


def _field(name: str, value: str, start: str, size: int | str = 1, *children: str) -> str:
    return f"{_leaf(name, value, start, size)[:-1]}, CAST(array({', '.join(children)}) AS {_CHILD}) AS children)"


def _fields(*fields: str) -> str:
    """Those that are not null."""
    return f"array_compact(array({', '.join(fields)}))"


def _layer(name: str, start: str, end: str, summary: str, truncated: str, fields: str) -> str:
    return (
        f"CAST(struct({name} AS protocol, CAST({start} AS INT) AS start, CAST({end} AS INT) AS end, {summary} AS summary, {truncated} AS truncated, "
        f"coalesce({fields}, CAST(array() AS array<{FIELD}>)) AS fields) AS {LAYER})"
    )


def _number(at: str, n: int, data: str = "body") -> str:
    """The big-endian number of ``n`` bytes at an offset."""
    return f"CAST(conv(hex(substring({data}, {at} + 1, {n})), 16, 10) AS BIGINT)"


def _hexed(value: str, digits: int) -> str:
    return f"concat('0x', lpad(lower(hex({value})), {digits}, '0'))"


def _coded(code: str, names: dict[int, str], otherwise: str = "'Unknown'") -> str:
    return f"concat({code}, ' (', {named_sql(code, names, otherwise)}, ')')"


def _mac(at: int) -> str:
    return f"rtrim(':', regexp_replace(lower(hex(substring(body, {at + 1}, 6))), '(..)', '$1:'))"


def _link() -> str:
    kind = f"concat({_hexed('ethertype', 4)}, ' (', {named_sql('ethertype', C.ETHERTYPES, _UNKNOWN)}, ')')"
    ethernet = _fields(_field("Destination MAC", _mac(0), "0", 6), _field("Source MAC", _mac(6), "6", 6), _field("EtherType", kind, "12", 2))
    cooked1 = _fields(
        _field("Packet type", "sll_packet", "0", 2),
        _field("Link-layer address type", _number("2", 2), "2", 2),
        _field("Link-layer address length", _number("4", 2), "4", 2),
        _field("Protocol", _hexed("ethertype", 4), "14", 2),
    )
    cooked2 = _fields(
        _field("Protocol", _hexed("ethertype", 4), "0", 2),
        _field("Interface index", _number("4", 4), "4", 4),
        _field("Link-layer address type", _number("8", 2), "8", 2),
        _field("Packet type", "sll_packet", "10"),
    )
    fields = f"CASE WHEN l2_truncated THEN NULL WHEN l2 = '{C.ETHERNET}' THEN {ethernet} WHEN l2 = '{C.SLL}' THEN {cooked1} ELSE {cooked2} END"
    end, summary = "IF(l2_truncated, greatest(size - 1, 0), l3_at - 1)", f"IF(l2 <> '{C.SLL2}', l2_info, NULL)"
    return f"IF(l2 IS NULL, NULL, {_layer('l2', '0', end, summary, 'l2_truncated', fields)})"


def _network() -> str:
    at, word, first = "l3_at", _number("l3_at + 6", 2), _number("l3_at", 4)

    def bit(n: int) -> str:
        return f"IF({word} & {1 << n} <> 0, 'true', 'false')"

    four = _fields(
        _field("Version", "4", at),
        _field("Header length", "concat(l4_at - l3_at, ' bytes (IHL=', (l4_at - l3_at) div 4, ')')", at),
        _field("Total length", _number(f"{at} + 2", 2), f"{at} + 2", 2),
        _field("Identification", _hexed(_number(f"{at} + 4", 2), 4), f"{at} + 4", 2),
        _field("Flags", _hexed(f"shiftright({word}, 13)", 1), f"{at} + 6", 1, _leaf("Don\\'t fragment", bit(14)), _leaf("More fragments", bit(13))),
        _field("Fragment offset", f"{word} & 8191", f"{at} + 6", 2),
        _field("TTL", _number(f"{at} + 8", 1), f"{at} + 8"),
        _field("Protocol", _coded("ip_protocol", C.IP_PROTOCOLS), f"{at} + 9"),
        _field("Header checksum", _hexed(_number(f"{at} + 10", 2), 4), f"{at} + 10", 2),
        _field("Source", "src_ip", f"{at} + 12", 4),
        _field("Destination", "dst_ip", f"{at} + 16", 4),
    )
    six = _fields(
        _field("Version", "6", at),
        _field("Traffic class", _hexed(f"shiftright({first}, 20) & 255", 2), at, 2),
        _field("Flow label", _hexed(f"{first} & 1048575", 5), f"{at} + 1", 3),
        _field("Payload length", _number(f"{at} + 4", 2), f"{at} + 4", 2),
        _field("Next header", _coded("ip_protocol", C.IPV6_NEXT), f"{at} + 6"),
        _field("Hop limit", _number(f"{at} + 7", 1), f"{at} + 7"),
        _field("Source", "src_ip", f"{at} + 8", 16),
        _field("Destination", "dst_ip", f"{at} + 24", 16),
    )
    fields = f"CASE WHEN NOT l3_ok THEN NULL WHEN l3 = '{C.IPV4}' THEN {four} ELSE {six} END"
    end = "IF(l3_ok, l4_at - 1, greatest(size - 1, l3_at))"
    return f"IF(l3 IS NULL, NULL, {_layer('l3', at, end, 'l3_info', 'l3_truncated', fields)})"


def _transport() -> str:
    at = "l4_at"
    bits = [_leaf(n, f"shiftright(tcp_flags, {8 - i}) & 1") for i, n in enumerate(reversed(C.TCP_FLAGS))]
    ports = [_field("Source port", "src_port", at, 2), _field("Destination port", "dst_port", f"{at} + 2", 2)]
    tcp = _fields(
        *ports,
        _field("Sequence number", "tcp_seq", f"{at} + 4", 4),
        _field("Acknowledgement number", "tcp_ack", f"{at} + 8", 4),
        _field("Header length", "concat(payload_at - l4_at, ' bytes')", f"{at} + 12"),
        _field("Flags", flag_names_sql("tcp_flags"), f"{at} + 12", 2, *bits),
        _field("Window size", "tcp_window", f"{at} + 14", 2),
        _field("Checksum", _hexed(_number(f"{at} + 16", 2), 4), f"{at} + 16", 2),
    )
    udp = _fields(*ports, _field("Length", "udp_length", f"{at} + 4", 2), _field("Checksum", _hexed(_number(f"{at} + 6", 2), 4), f"{at} + 6", 2))
    kinds = [_coded("icmp_type", names, "concat('Type ', icmp_type)") for names in (C.ICMP_TYPES, C.ICMPV6_TYPES)]
    icmp = _fields(
        _field("Type", f"IF(l4 = '{C.ICMP}', {kinds[0]}, {kinds[1]})", at),
        _field("Code", "icmp_code", f"{at} + 1"),
        _field("Checksum", _hexed(_number(f"{at} + 2", 2), 4), f"{at} + 2", 2),
    )
    fields = f"CASE WHEN NOT l4_ok THEN NULL WHEN l4 = '{C.TCP}' THEN {tcp} WHEN l4 = '{C.UDP}' THEN {udp} ELSE {icmp} END"
    return f"IF(l4 IS NULL, NULL, {_layer('l4', at, f'greatest(coalesce(payload_at, size) - 1, {at})', 'l4_info', 'l4_truncated', fields)})"


def _http() -> str:
    nowhere = f"CAST(NULL AS INT) AS start, CAST(NULL AS INT) AS end, CAST(array() AS {_CHILD}) AS children"
    header = (
        "struct(IF(instr(x, ':') > 0, left(x, instr(x, ':') - 1), x) AS name, IF(instr(x, ':') > 0, trim(substr(x, instr(x, ':') + 1)), '') AS value, "
        f"{nowhere})"
    )
    first = (
        "struct(IF(startswith(http_first, 'HTTP/'), 'Status line', 'Request line') AS name, coalesce(http_first, '') AS value, payload_at AS start, "
        f"payload_at + length(http_first) - 1 AS end, CAST(array() AS {_CHILD}) AS children)"
    )
    rest = "slice(http_lines, 2, greatest(size(http_lines), 1))"
    return f"CAST(concat(array({first}), transform({rest}, x -> {header})) AS array<{FIELD}>)"


def _tls() -> str:
    at = "payload_at"
    kind = named_sql("tls_handshake", C.TLS_HANDSHAKES, "concat('Type', tls_handshake)")
    cipher = f"concat({_hexed('tls_cipher', 4)}, ' (', {named_sql('tls_cipher', C.TLS_CIPHERS, _UNKNOWN)}, ')')"
    side = f"struct(IF(tls_handshake = 1, 'Client random', 'Server random') AS name, tls_random AS value, CAST({at} + 11 AS INT) AS start, CAST({at} + 42 AS INT) AS end)"
    inner = _fields(
        _leaf("Handshake type", f"concat(tls_handshake, ' (', {kind}, ')')", f"{at} + 5"),
        _leaf("Length", "tls_handshake_length", f"{at} + 6", 3),
        f"IF(tls_random IS NULL, NULL, {side})",
        f"IF(sni IS NULL, NULL, {_leaf('Server Name Indication', 'sni')})",
        f"IF(tls_cipher IS NULL, NULL, {_leaf('Cipher suite', cipher)})",
    )
    shake = (
        f"struct('Handshake' AS name, {kind} AS value, CAST({at} + 5 AS INT) AS start, CAST(least({at} + 8 + tls_handshake_length, size - 1) AS INT) AS end, "
        f"CAST({inner} AS {_CHILD}) AS children)"
    )
    return _fields(
        _field("Content type", _coded("tls_type", C.TLS_RECORDS), at),
        _field("Version", named_sql("tls_version", C.TLS_VERSIONS, _hexed("tls_version", 4)), f"{at} + 1", 2),
        _field("Length", "tls_length", f"{at} + 3", 2),
        f"IF(tls_handshake IS NULL, NULL, {shake})",
    )


def _dns() -> str:
    at = "payload_at"
    opcode, code = "shiftright(dns.flags, 11) & 15", "dns.flags & 15"
    other_opcode, other_code = f"concat('Op', {opcode})", f"concat('R', {code})"
    flags = (
        f"concat({_hexed('dns.flags', 4)}, IF(dns.flags >= 32768, ' (response, opcode=', ' (query, opcode='), "
        f"{named_sql(opcode, C.DNS_OPCODES, other_opcode)}, ', rcode=', {named_sql(code, C.DNS_RCODES, other_code)}, ')')"
    )

    def record(of: str, name: str, start: str, rest: str, *more: str) -> str:
        kind = named_sql(f"{of}.type", C.DNS_TYPES, f"concat('TYPE', {of}.type)")
        klass = f"IF({of}.class = 1, 'IN', concat('CLASS', {of}.class))"
        children = (_leaf("Name", f"{of}.name"), _leaf("Type", f"concat({of}.type, ' (', {kind}, ')')"), _leaf("Class", f"concat({of}.class, ' (', {klass}, ')')"), *more)
        shown = f"concat({of}.name, '  ', {kind}, '  ', {klass if rest == '' else rest})"
        return f"IF({of} IS NULL, NULL, {_field(name, shown, f'{at} + {start}', f'({of}.next - {start})', *children)})"

    a = "dns.answer"
    counts = [("Questions", "questions"), ("Answer RRs", "answers"), ("Authority RRs", "authority"), ("Additional RRs", "additional")]
    fields = _fields(
        _field("Transaction ID", _hexed("dns.id", 4), at, 2),
        _field("Flags", flags, f"{at} + 2", 2),
        *[_field(n, f"dns.{k}", f"{at} + {4 + 2 * i}", 2) for i, (n, k) in enumerate(counts)],
        record("dns.query", "Query", "12", ""),
        record(
            a, "Answer", "coalesce(dns.query.next, 12)", f"{a}.data, '  TTL=', {a}.ttl",
            _leaf("TTL", f"{a}.ttl"), _leaf("Data length", f"{a}.length"), _leaf("Data", f"{a}.data"),
        ),
    )
    return f"IF(dns.truncated, NULL, {fields})"


def _quic() -> str:
    at, dcid, scid = "payload_at", "length(quic_dcid) div 2", "length(quic_scid) div 2"
    hexed = _hexed("quic_version", 8)
    version = named_sql("quic_version", {0: "Version Negotiation", 1: "v1", C.QUIC_V2: "v2"}, hexed)
    return _fields(
        _field("Header form", "'Long (1)'", at),
        _field("Packet type", _coded("quic_type", C.QUIC_PACKETS), at),
        _field("Version", f"concat({hexed}, ' (', {version}, ')')", f"{at} + 1", 4),
        _field("DCID length", dcid, f"{at} + 5"),
        _field("Destination CID", "quic_dcid", f"{at} + 6", dcid),
        _field("SCID length", scid, f"{at} + 6 + {dcid}"),
        _field("Source CID", "quic_scid", f"{at} + 7 + {dcid}", scid),
        f"IF(quic_token_length IS NULL, NULL, {_field('Token length', 'quic_token_length', f'{at} + 7 + {dcid} + {scid}')})",
        f"IF(quic_length IS NULL, NULL, {_field('Length', 'quic_length', f'{at} + 8 + {dcid} + {scid}')})",
    )


def _application() -> str:
    fields = f"CASE l7 WHEN '{C.HTTP}' THEN {_http()} WHEN '{C.TLS}' THEN {_tls()} WHEN '{C.DNS}' THEN {_dns()} WHEN '{C.QUIC}' THEN {_quic()} END"
    end = f"IF(l7 = '{C.TLS}', least(payload_at + 4 + tls_length, size - 1), size - 1)"
    return f"IF(l7 IS NULL, NULL, {_layer('l7', 'payload_at', end, 'l7_info', 'l7_truncated', fields)})"


def _metadata() -> str:
    fields = _fields(
        _field("Magic", f"'0x{C.TRAILER_MAGIC}'", "size", 4),
        _field("UID", "uid", "size + 4", 4),
        _field("App name", "app_name", "size + 8", 20),
        _field("FCS (CRC32)", _hexed("fcs", 8), "size + 28", 4),
    )
    return f"IF(has_trailer, {_layer(_METADATA, 'size', f'size + {C.TRAILER_BYTES - 1}', _SUMMARY, 'FALSE', fields)}, NULL)"


_METADATA = f"'{C.APP_METADATA}'"
_SUMMARY = "concat(app_name, ' (UID ', uid, ')')"


def with_layers(frames: DataFrame) -> DataFrame:
    """The packets with ``layers``: protocol, byte range, summary, truncation and fields, each
    with its value as shown, its byte range and its children."""
    layers = ", ".join((_link(), _network(), _transport(), _application(), _metadata()))
    return frames.selectExpr("*", f"array_compact(array({layers})) AS layers")


def field_bytes(data: Column, field: Column) -> Column:
    """The bytes a field's range covers, in lower-case hexadecimal."""
    return hex_lower(cut(data, field["start"], field["end"] - field["start"] + 1))
