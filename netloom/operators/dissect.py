"""Packet bytes to typed columns: links, networks, transports and applications.

The numbers come from two Arrow stages (``headers``, ``names``); texts are made of them by
column expressions, so that a query computes only those it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bytes import named, named_sql
from ..shared import written
from . import headers as H
from .names import dns, sni


def flag_names_sql(flags: str) -> str:
    """``[SYN,ACK]``, or ``[none]``."""
    each = ", ".join(f"IF({flags} & {1 << i} <> 0, '{name}', NULL)" for i, name in enumerate(C.TCP_FLAGS))
    return f"concat('[', IF({flags} & {(1 << len(C.TCP_FLAGS)) - 1} = 0, 'none', concat_ws(',', {each})), ']')"


def dns_type(code: Column) -> Column:
    return named(code, C.DNS_TYPES, F.concat(F.lit("TYPE"), code.cast("string")))


def _lower_layers(raw: DataFrame) -> DataFrame:
    """All numbers, the packet without its trailer (``body``), and the payload."""
    read = raw.withColumn("_h", H.headers(F.col("data"), F.col("link_type"))).select(*raw.columns, "_h.*")
    packet = named_sql("packet_type", C.SLL_PACKETS, "concat('Unknown (', packet_type, ')')")
    return read.selectExpr(
        "*",
        "IF(has_trailer, substring(data, 1, size), data) AS body",
        "IF(payload_len > 0, substring(data, payload_at + 1, payload_len), NULL) AS payload",
        f"{packet} AS sll_packet",
    ).drop("packet_type")


def _http(rows: DataFrame, head_limit: int | None) -> DataFrame:
    """The head of an HTTP message: its lines, and what a request asks for."""
    seen = "payload" if head_limit is None else f"substring(payload, 1, {head_limit})"
    rows = rows.selectExpr("*", f"IF(l7 = '{C.HTTP}', decode({seen}, 'ISO-8859-1'), NULL) AS _text")
    rows = rows.selectExpr("*", r"instr(_text, '\r\n\r\n') AS _crlf", r"instr(_text, '\n\n') AS _lf")
    rows = rows.selectExpr(
        "*",
        r"array_remove(split(left(_text, CASE WHEN _crlf > 0 THEN _crlf + 3 WHEN _lf > 0 THEN _lf + 1 ELSE length(_text) END), '\r\n|\n'), '') AS http_lines",
        "_crlf = 0 AND _lf = 0 AS http_truncated",
    ).drop("_text", "_crlf", "_lf")
    rows = rows.selectExpr("*", "try_element_at(http_lines, 1) AS http_first")
    request = "split(IF(startswith(http_first, 'HTTP/'), NULL, http_first), ' ', 3)"
    host = "try_element_at(filter(slice(http_lines, 2, greatest(size(http_lines), 1)), x -> regexp_like(x, '^(?i:host)(?::|$)')), 1)"
    return rows.selectExpr(
        "*",
        f"try_element_at({request}, 1) AS http_method",
        f"try_element_at({request}, 2) AS http_path",
        f"trim(regexp_replace({host}, '^[^:]*:?', '')) AS http_host",
    )


def _records(rows: DataFrame, most_jumps: int | None) -> DataFrame:
    """What TLS, QUIC and DNS add to their numbers."""
    names = {"sni": sni(F.expr("IF(tls_handshake = 1, payload, NULL)")), "dns": dns(F.expr(f"IF(l7 = '{C.DNS}', payload, NULL)"), most_jumps)}
    return rows.withColumns(names).selectExpr(
        "*",
        "IF(tls_handshake IN (1, 2) AND payload_len >= 43, lower(hex(substring(payload, 12, 32))), NULL) AS tls_random",
        "lower(hex(substring(payload, 7, quic_dcid_length))) AS quic_dcid",
        "lower(hex(substring(payload, quic_dcid_length + 8, quic_scid_length))) AS quic_scid",
        f"IF(l7 = '{C.DNS}', array_compact(array(dns.query.name, dns.answer.name)), CAST(array() AS ARRAY<STRING>)) AS dns_names",
    ).drop("quic_dcid_length", "quic_scid_length")


def _infos() -> dict[str, str]:
    """A line for each layer of a packet."""
    mac = "rtrim(':', regexp_replace(lower(hex(substring(data, {}, 6))), '(..)', '$1:'))"
    tls = "'TLS Handshake: ', " + named_sql("tls_handshake", C.TLS_HANDSHAKES, "concat('Type', tls_handshake)")
    version = named_sql("quic_version", {0: "Version Negotiation", 1: "v1", C.QUIC_V2: "v2"}, "concat('0x', lpad(lower(hex(quic_version)), 8, '0'))")
    rcode = named_sql("dns.flags & 15", C.DNS_RCODES, "concat('R', dns.flags & 15)")
    asked = named_sql("dns.query.type", C.DNS_TYPES, "concat('TYPE', dns.query.type)")
    cut_off = "IF(http_truncated, '  (headers truncated)', '')"
    return {
        "l2_info": f"""CASE WHEN l2 = '{C.ETHERNET}' AND NOT l2_truncated THEN concat({mac.format(7)}, ' → ', {mac.format(1)})
            WHEN l2 = '{C.SLL}' THEN sll_packet END""",
        "l3_info": "IF(l3_ok, concat(src_ip, ' → ', dst_ip), NULL)",
        "l4_info": f"""CASE
            WHEN tcp_flags IS NOT NULL THEN concat(src_port, ' → ', dst_port, '  ', {flag_names_sql('tcp_flags')}, ' Seq=', tcp_seq,
                IF(tcp_flags & 16 <> 0, concat(' Ack=', tcp_ack), ''), ' Win=', tcp_window, ' Len=', payload_len)
            WHEN udp_length IS NOT NULL THEN concat(src_port, ' → ', dst_port, ' len=', udp_length)
            WHEN icmp_type IS NULL THEN NULL
            WHEN l4 = '{C.ICMP}' THEN {named_sql('icmp_type', C.ICMP_TYPES, "concat('Type ', icmp_type)")}
            ELSE {named_sql('icmp_type', C.ICMPV6_TYPES, "concat('Type ', icmp_type)")} END""",
        "l7_info": f"""CASE
            WHEN l7 = '{C.HTTP}' AND startswith(http_first, 'HTTP/') THEN concat('HTTP Response: ', left(trim(substr(http_first, 6)), 40), {cut_off})
            WHEN l7 = '{C.HTTP}' THEN concat('HTTP Request: ', left(coalesce(http_first, ''), 60), {cut_off})
            WHEN l7 = '{C.TLS}' AND tls_handshake = 1 THEN concat('TLS Client Hello', coalesce(concat(' (SNI=', sni, ')'), ''))
            WHEN l7 = '{C.TLS}' AND tls_handshake = 2 THEN 'TLS Server Hello'
            WHEN l7 = '{C.TLS}' AND tls_handshake IS NOT NULL THEN concat({tls})
            WHEN l7 = '{C.TLS}' THEN concat('TLS ', {named_sql('tls_type', C.TLS_RECORDS, "'?'")})
            WHEN l7 = '{C.DNS}' AND dns.truncated THEN NULL
            WHEN l7 = '{C.DNS}' AND dns.flags >= 32768 AND dns.answer IS NOT NULL THEN concat('A: ', dns.answer.name, ' → ', dns.answer.data)
            WHEN l7 = '{C.DNS}' AND dns.flags >= 32768 THEN concat('Response (rcode=', {rcode}, ')')
            WHEN l7 = '{C.DNS}' AND dns.query IS NOT NULL THEN concat('Q: ', dns.query.name, ' ', {asked})
            WHEN l7 = '{C.DNS}' THEN 'DNS'
            WHEN quic_length IS NOT NULL THEN concat('QUIC Initial v=', {version}, ' DCID=', left(quic_dcid, 16), '…')
            WHEN l7 = '{C.QUIC}' THEN concat('QUIC ', {named_sql('quic_type', C.QUIC_PACKETS, "'?'")}) END""",
    }


def frames(raw: DataFrame, head_limit: int | None = None, most_jumps: int | None = None) -> DataFrame:
    """Raw packets (see ``schema.RAW_FRAMES``) with one flat column per decoded value. No
    shuffle; columns that a query does not use are not computed. A null packet counts as empty.

    ``head_limit`` reads HTTP heads only so many bytes into a packet, and ``most_jumps`` follows
    only so many compression pointers of a DNS name; neither is bounded by default."""
    rows = _records(_http(_lower_layers(raw), head_limit), most_jumps)
    short = f"""CASE l7 WHEN '{C.HTTP}' THEN http_truncated WHEN '{C.TLS}' THEN tls_length + 5 > payload_len WHEN '{C.DNS}' THEN dns.truncated END"""
    rows = rows.selectExpr("*", *[f"{v} AS {k}" for k, v in _infos().items()], f"coalesce({short}, FALSE) AS l7_truncated")
    shown = ", ".join(f"nullif({x}_info, '')" for x in ("l7", "l4", "l3", "l2"))
    return rows.selectExpr(
        "*",
        "timestamp_micros(ts_ns div 1000) AS ts",
        f"array_compact(array(l2, l3, l4, l7, IF(has_trailer, '{C.APP_METADATA}', NULL))) AS protocols",
        f"coalesce(l7, l4, l3, l2, '{C.RAW}') AS top_protocol",
        f"coalesce({shown}, '') AS info",
        "l2_truncated OR l3_truncated OR l4_truncated OR l7_truncated AS any_truncated",
    )


def frames_once(raw: DataFrame) -> DataFrame:
    """``frames(raw)`` written to the shared folder, for uses that read packets more than once: as
    they stand and joined to what their sessions tell. Parquet keeps columns apart, so each use
    reads only its own."""
    return written(frames(raw), "packets")
