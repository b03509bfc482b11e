"""Captures made from tables: rows become real packet bytes.

Values come from SQL expressions over the table; headers are laid out by one Arrow stage,
a batch at a time."""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RAW_FRAMES

_RAW = [x.split()[0] for x in RAW_FRAMES.split(", ")]
TCP, UDP, ICMP, ICMPV6 = 6, 17, 1, 58
#: Addresses as numbers, in SQL.
NET_10 = "167772160"


def address(text: str) -> int:
    """A dotted address as a number."""
    return int.from_bytes(bytes(map(int, text.split("."))), "big")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out first where it has fewer files than the cluster has cores."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found if len(found.inputFiles()) >= cores else found.repartition(cores)


def _fields(rows: int, size: int, *fields: tuple[int, int, np.ndarray | int]) -> pa.Array:
    """Records of ``size`` bytes with big-endian numbers (offset, width, value)."""
    out = np.zeros((rows, size), np.uint8)
    for at, width, value in fields:
        for i in range(width):
            out[:, at + i] = np.asarray(value) >> (8 * (width - 1 - i)) & 255
    return pa.Array.from_buffers(pa.binary(size), rows, [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _packets(link: pa.Array, version: pa.Array, protocol: pa.Array, src: pa.Array, dst: pa.Array, sport: pa.Array, dport: pa.Array, seq: pa.Array, ack: pa.Array, flags: pa.Array, payload: pa.Array) -> pa.Array:
    """Link, network and transport headers around payloads. Addresses are numbers; under
    version 6 they end ``2001:db8::``. ICMP has no header here: it is all payload."""
    n = len(payload)
    link, version, protocol, src, dst, sport, dport, seq, ack, flags = (
        x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (link, version, protocol, src, dst, sport, dport, seq, ack, flags)
    )
    sizes = pc.binary_length(payload).to_numpy(zero_copy_only=False).astype(np.int64)
    tcp = _fields(n, 20, (0, 2, sport), (2, 2, dport), (4, 4, seq), (8, 4, ack), (12, 2, 0x5000 | flags), (14, 2, 64240))
    udp = _fields(n, 8, (0, 2, sport), (2, 2, dport), (4, 2, sizes + 8))
    none = pa.array([b""] * n, pa.binary())
    choose = lambda test, a, b: pc.if_else(pa.array(test), a, b)
    inner = pc.binary_join_element_wise(choose(protocol == TCP, tcp, choose(protocol == UDP, udp, none)), payload, b"")
    sizes = pc.binary_length(inner).to_numpy(zero_copy_only=False).astype(np.int64)
    four = _fields(n, 20, (0, 2, 0x4500), (2, 2, sizes + 20), (6, 2, 0x4000), (8, 1, 64), (9, 1, protocol), (12, 4, src), (16, 4, dst))
    net = (0x2001, 0x0DB8)
    six = _fields(
        n, 40, (0, 4, 0x60000000), (4, 2, sizes), (6, 1, protocol), (7, 1, 64), *[(8 + 2 * i, 2, x) for i, x in enumerate(net)], (20, 4, src),
        *[(24 + 2 * i, 2, x) for i, x in enumerate(net)], (36, 4, dst),
    )
    kind = np.where(version == 6, 0x86DD, 0x0800)
    ethernet = _fields(n, 14, (0, 6, 0xAAAAAAAAAAAA), (6, 6, 0xBBBBBBBBBBBB), (12, 2, kind))
    cooked1 = _fields(n, 16, (0, 2, 4), (2, 2, 1), (4, 2, 6), (14, 2, kind))
    cooked2 = _fields(n, 20, (0, 2, kind), (4, 4, 1), (8, 2, 1), (10, 1, 4), (11, 1, 6))
    outer = choose(link == 1, ethernet, choose(link == 113, cooked1, choose(link == 276, cooked2, none)))
    return pc.binary_join_element_wise(outer, choose(version == 6, six, four), inner, b"")


def raw_packets(rows: DataFrame) -> DataFrame:
    """Raw packets of rows with ``capture_id, frame_index, ts_ns, protocol, src, dst, payload``
    and, where they differ from the defaults, ``link_type, version, sport, dport, seq, ack,
    flags, extra`` (bytes not captured) and ``trailer``."""
    defaults = {"link_type": "1", "version": "4", "sport": "0", "dport": "0", "seq": "1", "ack": "1", "flags": "24", "extra": "0", "trailer": "X''"}
    rows = rows.selectExpr("*", *[f"{v} AS {k}" for k, v in defaults.items() if k not in rows.columns])
    names = ("link_type", "version", "protocol", "src", "dst", "sport", "dport", "seq", "ack", "flags", "payload")
    packet = F.arrow_udf(_packets, "binary")(*map(F.col, names))
    rows = rows.withColumn("packet", packet).selectExpr("*", "concat(packet, trailer) AS data")
    return rows.selectExpr(
        "capture_id", "CAST(frame_index AS BIGINT) AS frame_index", "CAST(ts_ns AS BIGINT) AS ts_ns", "octet_length(data) AS cap_len",
        "CAST(octet_length(data) + extra AS BIGINT) AS orig_len", "CAST(link_type AS INT) AS link_type", "data",
    ).select(*_RAW)


def client_hello(host: str) -> bytes:
    """A TLS record with a ClientHello that names ``host``. A first extension that is not the
    name makes the reader walk."""
    name = host.encode()
    entry = struct.pack(">BH", 0, len(name)) + name
    server = struct.pack(">HHH", 0, len(entry) + 2, len(entry)) + entry
    extensions = bytes.fromhex("002B0003020304") + server
    body = b"\x03\x03" + b"\x11" * 32 + b"\0" + bytes.fromhex("0002002F0100") + struct.pack(">H", len(extensions)) + extensions
    return b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body


def dns_message(ident: int, host: str, address: int | None) -> bytes:
    """A query; with an address, its answer, whose name points back at the question."""
    labels = b"".join(bytes([len(x)]) + x.encode() for x in host.split(".")) + b"\0"
    head = bytes.fromhex("01000001000000000000" if address is None else "81800001000100000000")
    answer = b"" if address is None else bytes.fromhex("C00C000100010000012C0004") + address.to_bytes(4, "big")
    return struct.pack(">H", ident % 65536) + head + labels + b"\0\x01\0\x01" + answer


def _event_payload(kind: pa.Array, ident: pa.Array, host: pa.Array, server: pa.Array, back: pa.Array) -> pa.Array:
    makers = {
        "click": lambda i, h, s, b: f"GET /item/{i} HTTP/1.1\r\nHost: {h}\r\nAccept: */*\r\n\r\n".encode(),
        "view": lambda i, h, s, b: client_hello(h),
        "purchase": lambda i, h, s, b: dns_message(i, h, s if i % 2 else None),
        "signup": lambda i, h, s, b: bytes.fromhex("C00000000108") + i.to_bytes(8, "big") + bytes.fromhex("000040100A0B0C0D0E0F10111213141516171819"),
        "error": lambda i, h, s, b: bytes([0 if b else 8]) + bytes.fromhex("00000000010001"),
    }
    rows = zip(*(x.to_pylist() for x in (kind, ident, host, server, back)), strict=True)
    return pa.array([makers[k](*rest) for k, *rest in rows], pa.binary())


def event_packets(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """One packet per event: click HTTP, view TLS, purchase DNS (every second one an
    answer), signup QUIC, error ICMP. Every third is sent by the server; every fourth
    has the capturing app's trailer. ``columns`` replace those of ``raw_packets`` by SQL."""
    e = _table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "ts", "concat('site', user_id % 10, '.example.com') AS host", "event_id % 3 = 0 AS back",
        f"IF(event_id % 2 = 0, {address('198.51.100.0')}, {address('1.0.0.0')}) + event_id % 8 AS server", f"{NET_10} + user_id % 16777216 AS client",
        "CASE event_type WHEN 'click' THEN 80 WHEN 'purchase' THEN 53 ELSE 443 END AS service", "40000 + user_id % 20000 AS port",
    )
    payload = F.arrow_udf(_event_payload, "binary")(*map(F.col, ("event_type", "event_id", "host", "server", "back")))
    made = {
        "capture_id": "'events'", "frame_index": "event_id + 1", "ts_ns": "unix_micros(CAST(ts AS TIMESTAMP)) * 1000",
        "protocol": "CASE WHEN event_type IN ('click', 'view') THEN 6 WHEN event_type = 'error' THEN 1 ELSE 17 END",
        "src": "IF(back, server, client)", "dst": "IF(back, client, server)", "sport": "IF(back, service, port)", "dport": "IF(back, port, service)",
        "seq": "event_id * 100", "ack": "event_id", "flags": "CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 18 ELSE 24 END", "payload": "payload",
        "extra": "event_id % 7",
        "trailer": "IF(event_id % 4 = 0, concat(X'01072021', unhex(lpad(hex(user_id), 8, '0')), rpad(CAST(concat('app', user_id % 5) AS BINARY), 20, X'00'), X'DEADBEEF'), X'')",
    } | columns
    return raw_packets(e.withColumn("payload", payload).selectExpr(*[f"{v} AS {k}" for k, v in made.items()]))


def dialogue_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP dialogues of ``conversations``: a session per conversation, a segment per turn,
    numbered by the bytes its sender has sent. Turns divisible by four are sent twice,
    and each repetition carries the next packet number."""
    before = "ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    c = _table(spark, sf_dir, "conversations").selectExpr("*", "role = 'user' AS up", "octet_length(text) AS size")
    c = c.selectExpr(
        "*", f"coalesce(sum(size) OVER (PARTITION BY conv_id, up {before}), 0) AS sent", f"coalesce(sum(size) OVER (PARTITION BY conv_id {before}), 0) AS total",
        f"{address('10.1.0.0')} + conv_id % 65536 AS client", f"{address('192.0.2.9')} AS server", "20000 + conv_id % 20000 AS port",
    ).selectExpr("*", "explode(IF(turn % 4 = 0, array(0, 1), array(0))) AS copy").selectExpr("*", "conv_id * 1000 + turn * 2 + copy AS n")
    return raw_packets(
        c.selectExpr(
            "'dialogues' AS capture_id", "n AS frame_index", "n * 1000000 AS ts_ns", "6 AS protocol", "IF(up, client, server) AS src", "IF(up, server, client) AS dst",
            "IF(up, port, 7777) AS sport", "IF(up, 7777, port) AS dport", "IF(up, 1000, 5000) + sent AS seq", "IF(up, 5000, 1000) + total - sent AS ack",
            "CAST(text AS BINARY) AS payload",
        )
    )


PAGE_SEGMENT = 1400


def _members(body: bytes) -> bytes:
    return gzip.compress(body[: len(body) // 2]) + gzip.compress(body[len(body) // 2 :])


def _compressed(kind: pa.Array, body: pa.Array) -> pa.Array:
    made = {
        "gzip": gzip.compress, "deflate": zlib.compress, "members": _members, "cut": lambda b: gzip.compress(b)[:-12], "tail": lambda b: gzip.compress(b) + b"behind it",
    }
    return pa.array([made[k](b) for k, b in zip(kind.to_pylist(), body.to_pylist(), strict=True)], pa.binary())


#: How ``page_packets`` codes a page: as it says, or damaged and joined gzip bodies too.
CODED = "IF(page_id % 2 = 1, 'deflate', 'gzip')"
ODDLY_CODED = "element_at(array('members', 'cut', 'tail', 'deflate'), CAST(page_id % 4 + 1 AS INT))"


def page_packets(spark: SparkSession, sf_dir: str, coded: str | None = None) -> DataFrame:
    """HTTP exchanges of ``pages``: a request for the URL, then the page in segments of
    ``PAGE_SEGMENT`` bytes, with Content-Length or, where the id is odd, in one chunk.
    ``coded`` pages are compressed, as that SQL expression says."""
    line = "HTTP/1.1 200 OK\\r\\n"
    p = _table(spark, sf_dir, "pages").selectExpr(
        "page_id", "regexp_replace(url, '^[a-z]+://[^/]+', '') AS path", "regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host", "coalesce(html, '') AS html"
    )
    if coded:
        zipped = F.arrow_udf(_compressed, "binary")(F.expr(coded), F.expr("CAST(html AS BINARY)"))
        head = rf"CAST(concat('{line}Content-Encoding: ', IF(({coded}) = 'deflate', 'deflate', 'gzip'), '\r\nContent-Length: ', octet_length(zipped), '\r\n\r\n') AS BINARY)"
        p = p.withColumn("zipped", zipped).withColumn("coded", F.expr(f"concat({head}, zipped)"))
    p = p.selectExpr(
        "*", r"CAST(concat('GET ', path, ' HTTP/1.1\r\nHost: ', host, '\r\n\r\n') AS BINARY) AS ask",
        rf"""CAST(IF(page_id % 2 = 1, concat('{line}Transfer-Encoding: chunked\r\n\r\n', lower(hex(octet_length(html))), '\r\n', html, '\r\n0\r\n\r\n'),
            concat('{line}Content-Length: ', octet_length(html), '\r\n\r\n', html)) AS BINARY) AS answer""",
    ).withColumn("answer", F.col("coded" if coded else "answer"))
    pieces = f"transform(sequence(0, CAST((octet_length(answer) - 1) / {PAGE_SEGMENT} AS INT)), i -> substring(answer, i * {PAGE_SEGMENT} + 1, {PAGE_SEGMENT}))"
    rows = p.selectExpr("page_id", "octet_length(ask) AS asked", f"posexplode(concat(array(ask), {pieces})) AS (n, payload)").selectExpr(
        "*", "n = 0 AS up", "page_id * 1000 + n AS i", f"{address('10.2.0.0')} + page_id % 65536 AS client", f"{address('192.0.2.80')} AS server", "30000 + page_id % 20000 AS port"
    )
    return raw_packets(
        rows.selectExpr(
            "'pages' AS capture_id", "i AS frame_index", "i * 1000 AS ts_ns", "6 AS protocol", "IF(up, client, server) AS src", "IF(up, server, client) AS dst",
            "IF(up, port, 80) AS sport", "IF(up, 80, port) AS dport", f"IF(up, 1, 1 + (n - 1) * {PAGE_SEGMENT}) AS seq", "IF(up, 1, 1 + asked) AS ack", "payload",
        )
    )


def document_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw-IP UDP packet per document, with the text as payload."""
    d = _table(spark, sf_dir, "documents")
    return raw_packets(
        d.selectExpr(
            "'documents' AS capture_id", "doc_id AS frame_index", "doc_id * 1000 AS ts_ns", "101 AS link_type", "17 AS protocol",
            f"{address('10.3.0.0')} + doc_id % 65536 AS src", f"{address('192.0.2.7')} AS dst", "6000 AS sport", "6001 AS dport", "CAST(coalesce(text, '') AS BINARY) AS payload",
        )
    )


def order_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disordered TCP traffic of ``orders``: a session per customer, a packet per order, with
    SYNs, repetitions, gaps, overlaps and bare acknowledgements by the order's key."""
    o = _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey % 2 = 0 AS up", f"{address('10.4.0.0')} + o_custkey % 65536 AS client", f"{address('192.0.2.5')} AS server",
        "10000 + o_custkey div 65536 AS port",
    )
    return raw_packets(
        o.selectExpr(
            "'orders' AS capture_id", "k AS frame_index", "k * 1000 AS ts_ns", "6 AS protocol", "IF(up, client, server) AS src", "IF(up, server, client) AS dst",
            "IF(up, port, 22) AS sport", "IF(up, 22, port) AS dport", "4294967000 + (k * 7) % 23 * 8 AS seq", "(k * 3) % 4 * 100 AS ack",
            "CASE k % 11 WHEN 0 THEN 2 WHEN 1 THEN 18 ELSE 16 END AS flags",
            "CAST(substring(repeat(concat(k, '-'), 40), 1, CAST((k * 13) % 5 * 8 AS INT)) AS BINARY) AS payload",
        )
    )
