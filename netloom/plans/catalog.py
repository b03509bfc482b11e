"""The registered queries: each runs the engine over packets made from a table, and the
SQL computes the same answer from the table itself."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bytes import mostly_text, printable
from ..functions.render import format_bytes, hex_dump, occurrences
from ..operators import conversations as conv
from ..operators import decrypt, keys, tcp
from ..operators.dissect import frames
from ..operators.filters import filter_frames
from ..operators.http_stream import http_messages
from ..operators.layers import field_bytes, with_layers
from ..operators.listing import list_rows, sort_frames
from ..operators.ranks import ranked_frames
from ..shared import shared_path, written
from ..sources.keylog import latest_secrets, parse_keylog
from ..streaming.blocks import parse_in_blocks
from ..streaming.live import read_spool, spool_table
from . import synth

Query = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(synth.event_packets(spark, sf_dir))


def _events(*columns: str) -> Query:
    return lambda spark, d: events(spark, d).select(*columns)


def _matching(text: str, source: Callable = synth.event_packets) -> Query:
    return lambda spark, d: filter_frames(frames(source(spark, d)), text).select("capture_id", "frame_index")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of the TCP packets that have nothing to do with port 53."""
    return conv.conversations(filter_frames(events(spark, sf_dir), "tcp and not port 53"))


# The packets of ``events``, from the table alone.
EV = """
    e AS (
        SELECT *, event_id % 3 = 0 AS back,
            (CASE WHEN event_id % 2 = 0 THEN '198.51.100.' ELSE '1.0.0.' END) || (event_id % 8) AS server,
            '10.' || ((user_id // 65536) % 256) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS client,
            CASE event_type WHEN 'click' THEN 80 WHEN 'purchase' THEN 53 ELSE 443 END AS service,
            CAST(40000 + user_id % 20000 AS INT) AS port,
            'site' || (user_id % 10) || '.example.com' AS host
        FROM events
    ),
    p AS (
        SELECT e.*, 'events' AS capture_id, event_id + 1 AS frame_index, epoch_us(ts) * 1000 AS ts_ns,
            CASE WHEN back THEN server ELSE client END AS src_ip, CASE WHEN back THEN client ELSE server END AS dst_ip,
            CASE WHEN event_type = 'error' THEN NULL WHEN back THEN service ELSE port END AS src_port,
            CASE WHEN event_type = 'error' THEN NULL WHEN back THEN port ELSE service END AS dst_port,
            CASE WHEN event_type IN ('click', 'view') THEN 'TCP' WHEN event_type = 'error' THEN 'ICMP' ELSE 'UDP' END AS l4,
            CASE event_type WHEN 'click' THEN 'HTTP' WHEN 'view' THEN 'TLS' WHEN 'purchase' THEN 'DNS' WHEN 'signup' THEN 'QUIC' END AS l7,
            CASE event_type
                WHEN 'click' THEN length('GET /item/' || event_id || ' HTTP/1.1') + 2 + length('Host: ' || host) + 2 + 11 + 4
                WHEN 'view' THEN 68 + length(host)
                WHEN 'purchase' THEN 18 + length(host) + CASE WHEN event_id % 2 = 0 THEN 0 ELSE 16 END
                WHEN 'signup' THEN 34 ELSE 0 END AS payload_len,
            CASE WHEN event_type IN ('click', 'view') THEN 20 ELSE 8 END AS l4_header,
            CASE WHEN event_id % 4 = 0 THEN 'app' || (user_id % 5) END AS app_name
        FROM e
    ),
    f AS (
        SELECT *, CAST(34 + l4_header + payload_len + CASE WHEN app_name IS NULL THEN 0 ELSE 32 END AS BIGINT) AS cap_len,
            CAST(34 + l4_header + payload_len + CASE WHEN app_name IS NULL THEN 0 ELSE 32 END + event_id % 7 AS BIGINT) AS orig_len
        FROM p
    ),
    c AS (
        SELECT *, (src_ip, src_port) <= (dst_ip, dst_port) AS from_a FROM f WHERE src_port IS NOT NULL
    ),
    k AS (
        SELECT *, CASE WHEN from_a THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN from_a THEN src_port ELSE dst_port END AS port_a,
            CASE WHEN from_a THEN dst_ip ELSE src_ip END AS ip_b, CASE WHEN from_a THEN dst_port ELSE src_port END AS port_b
        FROM c
    )
"""


def _ev(select: str) -> str:
    return f"WITH {EV} {select}"


def _where(condition: str) -> str:
    return _ev(f"SELECT capture_id, frame_index FROM f WHERE {condition}")


def _conversations_sql(where: str = "TRUE") -> str:
    return _ev(f"""
        SELECT capture_id, l4, ip_a, port_a, ip_b, port_b, count(*) AS packets, CAST(sum(orig_len) AS BIGINT) AS bytes,
            min(frame_index) AS first_frame, max(frame_index) AS last_frame,
            arg_min(app_name, frame_index) FILTER (WHERE app_name IS NOT NULL) AS app_name
        FROM k WHERE {where} GROUP BY ALL""")


# Dialogues: a packet per turn, every fourth twice.
DIALOGUES = """
    d AS (
        SELECT conv_id, turn, role = 'user' AS up, text, strlen(text) AS size,
            coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent,
            coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total
        FROM conversations
    ),
    t AS (
        SELECT 'dialogues' AS capture_id, conv_id * 1000 + turn * 2 + copy AS idx, conv_id, turn, copy, up, text, size AS plen,
            CAST(CASE WHEN up THEN 1000 ELSE 5000 END + sent AS BIGINT) AS seq,
            CAST(CASE WHEN up THEN 5000 ELSE 1000 END + total - sent AS BIGINT) AS ack, 24 AS flags,
            '10.1.' || ((conv_id // 256) % 256) || '.' || (conv_id % 256) || ':' || (20000 + conv_id % 20000) AS client, '192.0.2.9:7777' AS server
        FROM d, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR turn % 4 = 0
    ),
    t0 AS (SELECT *, CASE WHEN up THEN client ELSE server END AS src, least(client, server) || ' ' || greatest(client, server) AS sk FROM t)
"""
ORDERS = """
    t AS (
        SELECT 'orders' AS capture_id, o_orderkey AS idx, o_orderkey % 2 = 0 AS up, CAST((o_orderkey * 13) % 5 * 8 AS BIGINT) AS plen,
            4294967000 + (o_orderkey * 7) % 23 * 8 AS seq, (o_orderkey * 3) % 4 * 100 AS ack,
            CASE o_orderkey % 11 WHEN 0 THEN 2 WHEN 1 THEN 18 ELSE 16 END AS flags,
            '10.4.' || ((o_custkey // 256) % 256) || '.' || (o_custkey % 256) || ':' || (10000 + o_custkey // 65536) AS client, '192.0.2.5:22' AS server
        FROM orders
    ),
    t0 AS (SELECT *, CASE WHEN up THEN client ELSE server END AS src, least(client, server) || ' ' || greatest(client, server) AS sk FROM t)
"""
ANALYSIS = """
    a1 AS (
        SELECT *, flags & 2 <> 0 AS syn, flags & 16 <> 0 AS ak, plen > 0 AS hp, row_number() OVER (PARTITION BY sk, src ORDER BY idx) AS rn FROM t0
    ),
    a2 AS (
        SELECT *, coalesce(arg_min(src, idx) FILTER (WHERE syn AND NOT ak) OVER (PARTITION BY sk), first_value(src) OVER (PARTITION BY sk ORDER BY idx)) AS client_ep FROM a1
    ),
    a3 AS (
        SELECT *, src = client_ep AS fc, ak AND NOT hp AND NOT syn AS pa,
            last_value(CASE WHEN src = client_ep AND ((syn AND NOT ak) OR rn = 1) THEN seq END IGNORE NULLS) OVER w AS cisn,
            last_value(CASE WHEN src <> client_ep AND (syn OR rn = 1) THEN seq END IGNORE NULLS) OVER w AS sisn
        FROM a2 WINDOW w AS (PARTITION BY sk ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ),
    a4 AS (
        SELECT *, (seq - CASE WHEN fc THEN cisn ELSE sisn END) & 4294967295 AS rel_seq,
            CASE WHEN ak THEN (ack - CASE WHEN fc THEN sisn ELSE cisn END) & 4294967295 END AS rel_ack,
            hp AND row_number() OVER (PARTITION BY sk, src, hp, seq, plen ORDER BY idx) > 1 AS retransmission,
            max(CASE WHEN hp THEN seq + plen END) OVER (PARTITION BY sk, src ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest,
            CASE WHEN lag(ack) OVER (PARTITION BY sk, src, pa ORDER BY idx) = ack THEN 0 ELSE 1 END AS changed
        FROM a3
    ),
    a5 AS (SELECT *, sum(changed) OVER (PARTITION BY sk, src, pa ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM a4),
    a6 AS (
        SELECT *, coalesce(hp AND NOT retransmission AND seq < highest, FALSE) AS out_of_order,
            CAST(CASE WHEN pa THEN row_number() OVER (PARTITION BY sk, src, pa, island ORDER BY idx) - 1 ELSE 0 END AS INT) AS dup_ack
        FROM a5
    )
"""
REASSEMBLY = """
    r1 AS (
        SELECT *, flags & 2 <> 0 AS syn, CASE WHEN flags & 2 <> 0 THEN (seq + 1) & 4294967295 ELSE seq END AS q,
            sum(CASE WHEN flags & 2 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sk, src ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ep
        FROM t0
    ),
    r2 AS (
        SELECT *, coalesce(CASE WHEN syn THEN q END, max(CASE WHEN plen > 0 THEN q + plen WHEN syn THEN q END)
            OVER (PARTITION BY sk, src, ep ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q) AS expected
        FROM r1
    ),
    r3 AS (SELECT *, CASE WHEN plen = 0 THEN 0 ELSE least(greatest(q + plen - greatest(q, expected), 0), plen) END AS fresh FROM r2),
    r4 AS (
        SELECT *, CAST(coalesce(sum(fresh) OVER (PARTITION BY sk, src ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_offset
        FROM r3
    )
"""


#: Packet numbers of a block in the queries that cut sessions: so few that every table gives many blocks.
FEW = 512


def _analysed(source: Callable, *columns: str, how: Callable = tcp.analyse) -> Query:
    return lambda spark, d: how(frames(source(spark, d))).select("capture_id", "session", "frame_index", "src", *columns)


def _analysis_sql(table: str, columns: str) -> str:
    return f"WITH {table}, {ANALYSIS} SELECT capture_id, sk AS session, idx AS frame_index, src, {columns} FROM a6"


def _chunks(source: Callable, how: Callable = tcp.reassemble) -> Query:
    return lambda spark, d: how(frames(source(spark, d))).select(
        "capture_id", "session", "src", "frame_index", "chunk_seq", "data_offset", F.col("fresh").cast("long").alias("fresh")
    )


def _chunks_sql(table: str) -> str:
    return f"""WITH {table}, {REASSEMBLY}
        SELECT capture_id, sk AS session, src, idx AS frame_index, greatest(q, expected) AS chunk_seq, data_offset, CAST(fresh AS BIGINT) AS fresh
        FROM r4 WHERE fresh > 0"""


def streams_digest(spark: SparkSession, d: str) -> DataFrame:
    return tcp.stream_digests(tcp.reassemble(frames(synth.dialogue_packets(spark, d)))).drop("capture_id")


def follow(spark: SparkSession, d: str) -> DataFrame:
    found = tcp.follow_stream(synth.dialogue_packets(spark, d), "dialogues", 1000)
    return found.select("frame_index", "from_client", "payload_len", F.decode("payload", "UTF-8").alias("text"))


def search(spark: SparkSession, d: str) -> DataFrame:
    chunks = tcp.reassemble(frames(synth.dialogue_packets(spark, d)))
    found = chunks.select("session", "frame_index", F.posexplode(occurrences(F.decode("chunk", "UTF-8"), "The")).alias("nth", "at"))
    return found.select("session", "frame_index", "nth", "at")


def bodies(spark: SparkSession, d: str) -> DataFrame:
    found = http_messages(tcp.reassemble(frames(synth.page_packets(spark, d))))
    answers = found.where(F.startswith("first_line", F.lit("HTTP/")))
    return answers.select(
        "frame_index", "raw_length", F.md5("body").alias("body_md5"), F.col("spans_frames").cast("long").alias("spans_frames"), "body_info"
    )


def _ranked(by: str, descending: bool) -> Query:
    """The packets in one of the list's orders with their rank: a sort's order is no property of a
    result, so the rank shows it."""
    return lambda spark, d: ranked_frames(events(spark, d), by, descending).select("rank", "frame_index", "orig_len", "top_protocol", "info")


def _ranked_sql(order: str) -> str:
    return _ev(f"SELECT row_number() OVER (ORDER BY {order}) AS rank, frame_index, orig_len, coalesce(l7, l4) AS top_protocol, {INFO} AS info FROM f")


def text_ratio(spark: SparkSession, d: str) -> DataFrame:
    found = frames(synth.document_packets(spark, d)).where("payload_len > 0")
    return found.select("frame_index", printable(F.col("payload")).cast("long").alias("printable"), mostly_text(F.col("payload")).alias("is_text"))


def _dumped(packets: DataFrame) -> DataFrame:
    found = packets.select("frame_index", F.explode(hex_dump(F.col("body"))).alias("row"))
    return found.select("frame_index", F.col("row.at").alias("pos"), F.col("row.line").alias("line"))


def hex_rows(spark: SparkSession, d: str) -> DataFrame:
    return _dumped(events(spark, d).where("l4 = 'ICMP'"))


def document_hex_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every packet of the documents as a whole, however long."""
    return _dumped(frames(synth.document_packets(spark, d)))


def dns_answers(spark: SparkSession, d: str) -> DataFrame:
    found = events(spark, d).where("dns.answer is not null")
    return found.select("frame_index", F.col("dns.answer.name").alias("name"), F.col("dns.answer.data").alias("address"), F.col("dns.answer.ttl").alias("ttl"))


def app_traffic(spark: SparkSession, d: str) -> DataFrame:
    found = events(spark, d).where("has_trailer").groupBy("app_name", "uid").agg(F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"))
    return found.withColumn("shown", F.when(F.col("bytes") < 1024, format_bytes(F.col("bytes"))).otherwise("large"))


HTTP_INFO = "'HTTP Request: GET /item/' || event_id || ' HTTP/1.1'"
INFO = f"""CASE event_type WHEN 'click' THEN {HTTP_INFO} WHEN 'view' THEN 'TLS Client Hello (SNI=' || host || ')'
    WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'Q: ' || host || ' A' ELSE 'A: ' || host || ' → ' || server END
    WHEN 'signup' THEN 'QUIC Initial v=v1 DCID=' || printf('%016x', event_id) || '…'
    ELSE CASE WHEN back THEN 'Echo Reply' ELSE 'Echo Request' END END"""
_PAGE_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
_PAGE_PATH = "regexp_replace(url, '^[a-z]+://[^/]+', '')"


#: The packets of ``documents`` as hexadecimal digits.
DOCUMENT_BYTES = """
        b AS (SELECT doc_id AS frame_index, '4500' || printf('%04x', (strlen(text) + 28) % 65536) || '0000400040110000' || '0a03' || printf('%02x', (doc_id // 256) % 256)
                || printf('%02x', doc_id % 256) || 'c0000207' || '17701771' || printf('%04x', (strlen(text) + 8) % 65536) || '0000' || lower(hex(encode(text))) AS h
            FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""


def _pages(condition: str) -> str:
    return f"SELECT 'pages' AS capture_id, page_id * 1000 AS frame_index FROM pages WHERE {condition}"


QUERIES: dict[str, tuple[Query, str]] = {
    "flagship": (flagship, _conversations_sql("l4 = 'TCP' AND src_port <> 53 AND dst_port <> 53")),
    "frame_scan": (
        _events("capture_id", "frame_index", "ts_ns", "cap_len", "orig_len", "top_protocol", "any_truncated"),
        _ev("SELECT capture_id, frame_index, ts_ns, CAST(cap_len AS INT) AS cap_len, orig_len, coalesce(l7, l4) AS top_protocol, FALSE AS any_truncated FROM f"),
    ),
    "packet_info": (_events("frame_index", "info"), _ev(f"SELECT frame_index, {INFO} AS info FROM f")),
    "l4_ports": (
        _events("frame_index", "l4", "src_port", "dst_port", "payload_len"),
        _ev("SELECT frame_index, l4, src_port, dst_port, CAST(CASE WHEN l4 <> 'ICMP' THEN payload_len END AS INT) AS payload_len FROM f"),
    ),
    "ip_endpoints": (_events("frame_index", "src_ip", "dst_ip"), _ev("SELECT frame_index, src_ip, dst_ip FROM f")),
    "tcp_flags": (
        lambda s, d: events(s, d).where("tcp_flags is not null").select("frame_index", "tcp_flags", "tcp_seq", "tcp_ack", "tcp_window"),
        _ev("SELECT frame_index, CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 18 ELSE 24 END AS tcp_flags, event_id * 100 AS tcp_seq, event_id AS tcp_ack, 64240 AS tcp_window FROM f WHERE l4 = 'TCP'"),
    ),
    "icmp_types": (
        lambda s, d: events(s, d).where("l4 = 'ICMP'").groupBy("icmp_type").agg(F.count("*").alias("packets")),
        _ev("SELECT CASE WHEN back THEN 0 ELSE 8 END AS icmp_type, count(*) AS packets FROM f WHERE l4 = 'ICMP' GROUP BY 1"),
    ),
    "protocol_histogram": (
        lambda s, d: conv.protocol_histogram(events(s, d)),
        _ev("SELECT protocol, count(*) AS packets FROM (SELECT unnest(['Ethernet', 'IPv4', l4, l7, CASE WHEN app_name IS NOT NULL THEN 'PCAPdroid metadata' END]) AS protocol FROM f) WHERE protocol IS NOT NULL GROUP BY 1"),
    ),
    "filter_protocol": (_matching("tls or quic"), _where("l7 IN ('TLS', 'QUIC')")),
    "filter_port": (_matching("port 53"), _where("coalesce(src_port = 53 OR dst_port = 53, FALSE)")),
    "filter_host": (_matching("host 1.0.0.3"), _where("src_ip = '1.0.0.3' OR dst_ip = '1.0.0.3'")),
    "filter_not_null_safe": (_matching("not sni site1"), _where("NOT coalesce(l7 = 'TLS' AND contains(host, 'site1'), FALSE)")),
    "filter_precedence": (_matching("tcp or udp and port 53"), _where("l4 = 'TCP' OR (l4 = 'UDP' AND (src_port = 53 OR dst_port = 53))")),
    "filter_parentheses": (_matching("(tcp or udp) and not (port 53 or http)"), _where("l4 <> 'ICMP' AND l7 NOT IN ('DNS', 'HTTP')")),
    "filter_sni": (_matching("sni SITE3"), _where("l7 = 'TLS' AND contains(host, 'site3')")),
    "filter_dns_name": (_matching("dns.name site4.example"), _where("l7 = 'DNS' AND contains(host, 'site4.example')")),
    "filter_app": (_matching("app APP2"), _where("app_name = 'app2'")),
    "filter_http_method": (_matching("http.method get"), _where("l7 = 'HTTP'")),
    "filter_http_host": (_matching("http.host EXAMPLE.org", synth.page_packets), _pages(f"contains(lower({_PAGE_HOST}), 'example.org')")),
    "filter_http_path": (_matching("http.path /en/", synth.page_packets), _pages(f"contains(lower({_PAGE_PATH}), '/en/')")),
    "filter_url": (_matching("url com/fr", synth.page_packets), _pages(f"contains(lower({_PAGE_HOST} || {_PAGE_PATH}), 'com/fr')")),
    "filter_text": (
        _matching("text ß", synth.document_packets),
        # As in any capture, the whole packet is searched, headers too, byte by byte as Latin-1 of any case: C3 9F or E3 9F.
        f"WITH {DOCUMENT_BYTES} SELECT 'documents' AS capture_id, frame_index FROM b WHERE regexp_matches(h, '^(?:..)*[ce]39f')",
    ),
    "frames_sorted": (_ranked("length", True), _ranked_sql("orig_len DESC, frame_index DESC")),
    "frames_by_length": (_ranked("length", False), _ranked_sql("orig_len, frame_index")),
    "frames_by_time": (_ranked("time", True), _ranked_sql("ts_ns DESC, frame_index DESC")),
    "frames_by_protocol": (_ranked("protocol", False), _ranked_sql("coalesce(l7, l4), frame_index")),
    "frames_by_info": (_ranked("info", True), _ranked_sql(f"{INFO} DESC, frame_index DESC")),
    "conversations": (lambda s, d: conv.conversations(events(s, d)), _conversations_sql()),
    "conversation_stats": (
        lambda s, d: conv.conversation_stats(events(s, d)),
        _ev("""SELECT capture_id, l4, ip_a, port_a, ip_b, port_b, count(*) FILTER (WHERE from_a) AS packets_ab, count(*) FILTER (WHERE NOT from_a) AS packets_ba,
            CAST(coalesce(sum(orig_len) FILTER (WHERE from_a), 0) AS BIGINT) AS bytes_ab, CAST(coalesce(sum(orig_len) FILTER (WHERE NOT from_a), 0) AS BIGINT) AS bytes_ba,
            max(ts_ns) - min(ts_ns) AS duration_ns FROM k GROUP BY ALL"""),
    ),
    "conversation_frames": (
        lambda s, d: (lambda e: conv.conversation_frames(e, conv.conversations(e).where("packets >= 2")))(
            written(events(s, d).select("capture_id", "frame_index", *conv.READ), "packets")
        ).select("frame_index", "ip_a", "ip_b"),
        _ev("SELECT frame_index, ip_a, ip_b FROM k QUALIFY count(*) OVER (PARTITION BY l4, ip_a, port_a, ip_b, port_b) >= 2"),
    ),
    "app_traffic": (
        app_traffic,
        _ev("SELECT app_name, user_id AS uid, count(*) AS packets, CAST(sum(orig_len) AS BIGINT) AS bytes, CASE WHEN sum(orig_len) < 1024 THEN sum(orig_len) || 'B' ELSE 'large' END AS shown FROM f WHERE app_name IS NOT NULL GROUP BY app_name, user_id"),
    ),
    "dns_answers": (
        dns_answers,
        _ev("SELECT frame_index, host AS name, server AS address, CAST(300 AS BIGINT) AS ttl FROM f WHERE l7 = 'DNS' AND event_id % 2 = 1"),
    ),
    "tcp_relative_seq": (_analysed(synth.dialogue_packets, "client", "rel_seq", "rel_ack"), _analysis_sql(DIALOGUES, "client_ep AS client, rel_seq, rel_ack")),
    "tcp_retransmissions": (_analysed(synth.dialogue_packets, "retransmission"), _analysis_sql(DIALOGUES, "retransmission")),
    "tcp_analysis": (
        _analysed(synth.order_packets, "client", "rel_seq", "rel_ack", "retransmission", "out_of_order", "dup_ack"),
        _analysis_sql(ORDERS, "client_ep AS client, rel_seq, rel_ack, retransmission, out_of_order, dup_ack"),
    ),
    "tcp_analysis_blocks": (
        _analysed(synth.order_packets, "client", "rel_seq", "rel_ack", "retransmission", "out_of_order", "dup_ack", how=lambda p: tcp.analyse_blocks(p, FEW)),
        _analysis_sql(ORDERS, "client_ep AS client, rel_seq, rel_ack, retransmission, out_of_order, dup_ack"),
    ),
    "tcp_chunks_blocks": (_chunks(synth.order_packets, lambda p: tcp.reassemble_blocks(p, FEW)), _chunks_sql(ORDERS)),
    "tcp_chunks": (_chunks(synth.order_packets), _chunks_sql(ORDERS)),
    "tcp_chunks_dialogues": (_chunks(synth.dialogue_packets), _chunks_sql(DIALOGUES)),
    "tcp_streams_digest": (
        streams_digest,
        f"WITH {DIALOGUES} SELECT sk AS session, src, CAST(sum(plen) AS BIGINT) AS bytes, sha256(string_agg(text, '' ORDER BY idx)) AS sha256 FROM t0 WHERE copy = 0 GROUP BY sk, src",
    ),
    "follow_stream": (
        follow,
        f"WITH {DIALOGUES} SELECT idx AS frame_index, up = (SELECT up FROM t0 WHERE idx = 1000) AS from_client, CAST(plen AS INT) AS payload_len, text FROM t0 WHERE conv_id = 1 AND plen > 0",
    ),
    "stream_search": (
        search,
        f"""WITH {DIALOGUES}, s AS (SELECT sk, idx, string_split(lower(text), 'the') AS parts FROM t0 WHERE copy = 0),
            n AS (SELECT sk, idx, parts, unnest(range(0, len(parts) - 1)) AS nth FROM s)
            SELECT sk AS session, idx AS frame_index, CAST(nth AS INT) AS nth,
                CAST(list_sum(list_transform(parts[1:nth + 1], lambda x: length(x))) + 3 * nth AS INT) AS at FROM n""",
    ),
    "http_bodies": (
        bodies,
        f"""WITH h AS (SELECT page_id, html, strlen(html) AS n, page_id % 2 = 1 AS chunked,
                CASE WHEN page_id % 2 = 1 THEN 47 + length(printf('%x', strlen(html))) + 2 + strlen(html) + 7 ELSE 37 + length(CAST(strlen(html) AS VARCHAR)) + strlen(html) + 0 END AS total FROM pages)
            SELECT page_id * 1000 + 1 AS frame_index, CAST(n AS INT) AS raw_length, md5(html) AS body_md5,
                CAST(ceil(total / {synth.PAGE_SEGMENT}.0) AS BIGINT) AS spans_frames,
                CASE WHEN chunked THEN 'chunked → ' ELSE '' END || n || 'B across ' || CAST(ceil(total / {synth.PAGE_SEGMENT}.0) AS BIGINT) || ' frame(s)' AS body_info
            FROM h""",
    ),
    "payload_text_ratio": (
        text_ratio,
        r"""WITH x AS (SELECT doc_id, strlen(text) AS n, strlen(regexp_replace(text, '[^\x20-\x7e\x09\x0a\x0d]', '', 'g')) AS printable FROM documents WHERE text <> '')
            SELECT doc_id AS frame_index, CAST(printable AS BIGINT) AS printable, printable * 5 >= n * 4 AS is_text FROM x""",
    ),
    "hexdump_rows": (hex_rows, "WITH " + EV + """
        , b AS (SELECT frame_index, 'aaaaaaaaaaaabbbbbbbbbbbb0800' || '4500001c0000400040010000' || array_to_string(list_transform(string_split(src_ip, '.'), lambda x: printf('%02x', CAST(x AS INT))), '')
                || array_to_string(list_transform(string_split(dst_ip, '.'), lambda x: printf('%02x', CAST(x AS INT))), '') || CASE WHEN back THEN '00' ELSE '08' END || '00000000010001' AS h FROM f WHERE l4 = 'ICMP'),
        r AS (SELECT frame_index, unnest(range(0, length(h) // 2, 8)) AS pos, h FROM b),
        q AS (SELECT frame_index, CAST(pos AS INT) AS pos, substr(h, CAST(2 * pos + 1 AS BIGINT), 16) AS part FROM r),
        y AS (SELECT frame_index, pos, part, list_transform(range(0, length(part) // 2), lambda i: substr(part, CAST(2 * i + 1 AS BIGINT), 2)) AS pairs FROM q)
        SELECT frame_index, pos, printf('%04x', pos) || '  ' || rpad(array_to_string(pairs, ' '), 23, ' ') || '  '
            || array_to_string(list_transform(pairs, lambda v: CASE WHEN v >= '20' AND v <= '7e' THEN chr(CAST('0x' || v AS INT)) ELSE '.' END), '') AS line FROM y"""),
    "hexdump_documents": (document_hex_rows, f"WITH {DOCUMENT_BYTES}" + """,
        q AS (SELECT frame_index, unnest(regexp_extract_all(h, '.{1,16}')) AS part, unnest(range(0, length(h) // 2, 8)) AS pos FROM b),
        y AS (SELECT frame_index, CAST(pos AS INT) AS pos, part, regexp_extract_all(part, '..') AS pairs FROM q)
        SELECT frame_index, pos, printf('%04x', pos) || '  ' || rpad(array_to_string(pairs, ' '), 23, ' ') || '  '
            || array_to_string(list_transform(pairs, lambda v: CASE WHEN v >= '20' AND v <= '7e' THEN chr(CAST('0x' || v AS INT)) ELSE '.' END), '') AS line FROM y"""),
}


def live(spark: SparkSession, d: str) -> DataFrame:
    """The events' packets spooled as datagrams and read back as a stream until it is dry."""
    out = shared_path(spark, "live")

    def use(packets: DataFrame, number: int) -> None:
        found = frames(packets.where("not malformed").drop("malformed"))
        found.select("capture_id", "ts_ns", "cap_len", "orig_len", "top_protocol").write.mode("overwrite").parquet(f"{out}/trigger={number}")

    read_dry(spark, spool_table(synth.event_packets(spark, d)), use)
    return spark.read.parquet(out).drop("trigger")


def read_dry(spark: SparkSession, datagrams: DataFrame, use: Callable[[DataFrame, int], None]) -> None:
    """Spools datagrams, in a file per core but no more than a trigger reads, and parses them as a stream to its end."""
    spool = shared_path(spark, "spool")
    datagrams.repartition(min(64, max(4, spark.sparkContext.defaultParallelism))).write.parquet(spool)
    sink = parse_in_blocks(read_spool(spark, spool), shared_path(spark, "standing"), use).option("checkpointLocation", shared_path(spark, "state"))
    sink.trigger(availableNow=True).start().awaitTermination()


def keylog_lines(spark: SparkSession, d: str) -> DataFrame:
    """Key-log lines made of users: good ones, comments, wrong counts and bad digits."""
    e = spark.read.parquet(f"{d}/events.parquet")
    random, secret = F.sha2(F.col("user_id").cast("string"), 256), F.sha2(F.col("event_id").cast("string"), 256)
    kind = F.col("event_id") % 7
    line = (
        F.when(kind == 0, F.concat(F.lit("# "), random))
        .when(kind == 1, F.concat(F.lit("CLIENT_RANDOM "), random))
        .when(kind == 2, F.concat(F.lit("CLIENT_RANDOM "), random, F.lit(" "), F.substring(secret, 1, 63)))
        .when(kind == 3, F.concat(F.lit("CLIENT_RANDOM "), F.substring(random, 1, 60), F.lit(" "), secret))
        .otherwise(F.concat(F.lit("  CLIENT_RANDOM\t"), random, F.lit("  "), secret))
    )
    return e.select(F.col("event_id").alias("line_no"), line.alias("value"))


def keylog(spark: SparkSession, d: str) -> DataFrame:
    found = latest_secrets(parse_keylog(keylog_lines(spark, d)))
    return found.select(F.lower(F.hex("client_random")).alias("client_random"), "label", F.lower(F.hex("secret")).alias("secret"))


#: Events whose record comes a second time later, comes damaged first, or is missing.
FAULTS = {"repeated": "event_id % 5 = 0 AND event_id % 31 <> 5", "damaged": "event_id % 7 = 3 AND event_id % 31 <> 5", "lost": "event_id % 31 = 5"}
#: Packet numbers of one handshake's packets: far more than events.
EPOCH = 1_000_000_000_000
#: Users of one capture (the numbers of their hellos come before all data), and of one client address (a port each).
USERS, PORTS = 5_000_000, 40_000


def sealed_sessions(
    spark: SparkSession, d: str, version13: bool, chacha: bool = False, suites: tuple[int, ...] = (), handshakes: int = 1, faulty: bool = False
) -> tuple[DataFrame, DataFrame]:
    """TLS sessions of users with a hello from either side and sealed application data
    from the client, and their key log. A user has an address and port of their own. With ``handshakes``, a user's events are dealt to so many
    sessions on the same ports, one after the other. ``faulty`` captures hold damaged records in front of the
    good ones, repeat others later, and lack some."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'view'")
    e = e.select("event_id", "user_id", (F.col("event_id") % handshakes).alias("epoch"))
    rank = F.row_number().over(Window.partitionBy("user_id", "epoch").orderBy("event_id"))
    e = e.withColumn("seq", (rank - 1).cast("long"))
    user = F.concat(F.col("user_id").cast("string"), F.when(F.col("epoch") > 0, F.concat(F.lit("/"), F.col("epoch").cast("string"))).otherwise(""))
    random, server_random = F.sha2(F.concat(user, F.lit("c")), 256), F.sha2(F.concat(user, F.lit("s")), 256)
    suites = suites or ((0x1303 if chacha else 0x1301) if version13 else 0xC02F,)
    suite = F.element_at(F.array(*map(F.lit, suites)), (F.col("user_id") % len(suites) + 1).cast("int"))
    users = e.select("user_id", "epoch").distinct()
    secret = F.unhex(F.sha2(F.concat(user, F.lit("k")), 256))
    master = F.concat(secret, F.unhex(F.lit("22" * 16)))
    if version13:  # a secret is as long as its suite's hash
        secret = F.when(suite == 0x1302, master).otherwise(secret)
        users = users.select("user_id", "epoch", keys.tls13_keys(secret, suite).alias("k"))
    else:
        users = users.select("user_id", "epoch", keys.tls12_keys(master, F.unhex(random), F.unhex(server_random), suite)["client"].alias("k"))
    plain = F.concat(F.lit("GET /secret/").cast("binary"), F.col("event_id").cast("string").cast("binary"))
    number = F.lpad(F.hex("seq"), 16, "0")
    if version13:
        inner = F.concat(plain, F.unhex(F.lit("17")))
        header = F.concat(F.unhex(F.lit("170303")), F.unhex(F.lpad(F.hex(F.octet_length(inner) + 16), 4, "0")))
        nonce = decrypt.number_in_iv(F.col("k.iv"), F.col("seq"))
        body = F.substr(F.aes_encrypt(inner, F.col("k.key"), F.lit("GCM"), F.lit("DEFAULT"), nonce, header), F.lit(13))
        if chacha:
            body = F.arrow_udf(_chacha_sealed, "binary")(F.col("k.key"), nonce, inner, header)
    else:
        nonce = F.concat(F.col("k.iv"), F.unhex(number))
        aad = F.concat(F.unhex(number), F.unhex(F.lit("170303")), F.unhex(F.lpad(F.hex(F.octet_length(plain)), 4, "0")))
        body = F.substr(F.aes_encrypt(plain, F.col("k.key"), F.lit("GCM"), F.lit("DEFAULT"), nonce, aad), F.lit(5))
        if chacha:
            body = F.arrow_udf(_chacha_sealed, "binary")(F.col("k.key"), decrypt.number_in_iv(F.col("k.iv"), F.col("seq")), plain, aad)
        header = F.concat(F.unhex(F.lit("170303")), F.unhex(F.lpad(F.hex(F.octet_length(body)), 4, "0")))
    data = e.join(users, ["user_id", "epoch"]).select("event_id", "user_id", "epoch", F.lit(True).alias("up"), F.hex(F.concat(header, body)).alias("payload"))
    data = data.withColumn("at", F.col("event_id") + 10_000_000)
    if faulty:
        again = data.where(FAULTS["repeated"]).withColumn("at", F.expr("10000000 + 4 * event_id + 37"))
        bad = data.where(FAULTS["damaged"]).selectExpr("event_id", "user_id", "epoch", "up", "concat(left(payload, length(payload) - 2), IF(right(payload, 2) = '00', '01', '00')) AS payload", "10000000 + 4 * event_id - 1 AS at")
        data = data.where(f"NOT ({FAULTS['lost']})").withColumn("at", F.expr("10000000 + 4 * event_id")).unionByName(again).unionByName(bad)
    data = data.drop("event_id").withColumn("at", F.col("at") + F.col("epoch") * EPOCH)
    hello = F.concat(F.lit("16030100290100002503" + "03"), random, F.lit("00" + "0002002F"))
    answer = F.concat(F.lit("160303002C02000028" + "0303"), server_random, F.lit("00"), F.lpad(F.hex(suite), 4, "0"), F.lit("000000"))
    ones = e.select("user_id", "epoch").distinct()
    at = F.col("user_id") % USERS * 2 + F.col("epoch") * EPOCH
    hellos = ones.select("user_id", "epoch", at.alias("at"), F.lit(True).alias("up"), hello.alias("payload")).unionByName(
        ones.select("user_id", "epoch", (at + 1).alias("at"), F.lit(False).alias("up"), answer.alias("payload"))
    )
    rows = hellos.unionByName(data)
    rows = rows.selectExpr("*", f"{synth.address('10.9.0.0')} + user_id div {PORTS} AS client", f"{synth.address('192.0.2.44')} AS server", f"20000 + user_id % {PORTS} AS port")
    raw = synth.raw_packets(
        rows.selectExpr(
            f"concat('tls', user_id div {USERS}) AS capture_id", "at AS frame_index", "at * 1000 AS ts_ns", "6 AS protocol", "IF(up, client, server) AS src", "IF(up, server, client) AS dst",
            "IF(up, port, 443) AS sport", "IF(up, 443, port) AS dport", "unhex(payload) AS payload",
        )
    )
    labels = ("CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0") if version13 else ("CLIENT_RANDOM",)
    log = ones.select(F.col("user_id").alias("line_no"), F.explode(F.array(*map(F.lit, labels))).alias("label"), F.unhex(random).alias("client_random"), (secret if version13 else master).alias("secret"))
    return raw, log


def _chacha_sealed(*columns: pa.Array) -> pa.Array:
    return pa.array(keys.chacha_seal_all(list(zip(*(c.to_pylist() for c in columns), strict=True))), pa.binary())


def _decrypted(version13: bool, chacha: bool = False, **more) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        raw, log = sealed_sessions(spark, d, version13, chacha, **more)
        return decrypt.decrypt_tls(frames(raw), log).select("frame_index", "status", "text")

    return query


_PLAIN = "SELECT event_id + 10000000 AS frame_index, '✓ ApplicationData (' || length('GET /secret/' || event_id) || 'B)' AS status, 'GET /secret/' || event_id AS text FROM events WHERE event_type = 'view'"
QUERIES |= {
    "live_equals_batch": (
        live,
        _ev("SELECT capture_id, (ts_ns // 1000) * 1000 AS ts_ns, CAST(cap_len AS INT) AS cap_len, orig_len, coalesce(l7, l4) AS top_protocol FROM f"),
    ),
    "keylog_sessions": (
        keylog,
        """SELECT sha256(CAST(user_id AS VARCHAR)) AS client_random, 'CLIENT_RANDOM' AS label, arg_max(sha256(CAST(event_id AS VARCHAR)), event_id) AS secret
            FROM events WHERE event_id % 7 >= 4 GROUP BY user_id""",
    ),
    "tls13_decrypt": (_decrypted(True), _PLAIN),
    "tls12_decrypt": (_decrypted(False), _PLAIN),
    "tls13_chacha": (_decrypted(True, True), _PLAIN),
    "tls13_suites": (_decrypted(True, suites=(0x1301, 0x1302)), _PLAIN),
    "tls12_suites": (_decrypted(False, suites=(0xC02F, 0xC02B, 0x009C, 0xC030, 0xC02C, 0x009D)), _PLAIN),
    "tls12_chacha": (_decrypted(False, True, suites=(0xCCA8, 0xCCA9, 0xCCAA)), _PLAIN),
    "tls_two_handshakes": (
        _decrypted(True, handshakes=2),
        _PLAIN.replace("event_id + 10000000 AS", f"event_id + 10000000 + event_id % 2 * {EPOCH} AS"),
    ),
    "tls_failed_records": (
        _decrypted(True, faulty=True),
        f"""WITH v AS (SELECT *, min(CASE WHEN {FAULTS['lost']} THEN event_id END) OVER (PARTITION BY user_id) AS gap FROM events WHERE event_type = 'view'),
            r AS (
                SELECT event_id, 10000000 + 4 * event_id AS frame_index, event_id < coalesce(gap, event_id + 1) AS ok FROM v WHERE NOT ({FAULTS['lost']})
                UNION ALL SELECT event_id, 10000000 + 4 * event_id + 37, FALSE FROM v WHERE {FAULTS['repeated']}
                UNION ALL SELECT event_id, 10000000 + 4 * event_id - 1, FALSE FROM v WHERE {FAULTS['damaged']})
            SELECT frame_index, CASE WHEN ok THEN '✓ ApplicationData (' || length('GET /secret/' || event_id) || 'B)' ELSE '✗ auth failed' END AS status,
                CASE WHEN ok THEN 'GET /secret/' || event_id END AS text FROM r""",
    ),
}


def layer_fields(spark: SparkSession, d: str) -> DataFrame:
    """How many layers and fields the protocol trees have."""
    rows = with_layers(events(spark, d)).select(F.explode("layers").alias("layer"))
    return rows.groupBy("layer.protocol").agg(F.count("*").alias("layers"), F.sum(F.size("layer.fields")).alias("fields"))


def ttl_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The TTL as shown and the byte it comes from."""
    rows = with_layers(events(spark, d)).select("frame_index", "data", F.explode(F.col("layers")[1]["fields"]).alias("field")).where("field.name = 'TTL'")
    return rows.select("frame_index", F.col("field.value").alias("shown"), field_bytes(F.col("data"), F.col("field")).alias("bytes"))


QUERIES |= {
    "layer_fields": (
        layer_fields,
        _ev("""SELECT protocol, count(*) AS layers, CAST(sum(CASE protocol WHEN 'Ethernet' THEN 3 WHEN 'IPv4' THEN 11 WHEN 'TCP' THEN 8 WHEN 'UDP' THEN 4 WHEN 'ICMP' THEN 3
                WHEN 'HTTP' THEN 3 WHEN 'TLS' THEN 4 WHEN 'QUIC' THEN 9 WHEN 'PCAPdroid metadata' THEN 4 ELSE 7 + event_id % 2 END) AS BIGINT) AS fields
            FROM (SELECT event_id, unnest(['Ethernet', 'IPv4', l4, l7, CASE WHEN app_name IS NOT NULL THEN 'PCAPdroid metadata' END]) AS protocol FROM f)
            WHERE protocol IS NOT NULL GROUP BY protocol"""),
    ),
    "field_bytes": (ttl_bytes, _ev("SELECT frame_index, '64' AS shown, '40' AS bytes FROM f")),
}


QUERIES |= {
    "list_rows": (
        lambda s, d: list_rows(events(s, d)),
        _ev(f"""SELECT capture_id, frame_index, (ticks // 10000) || '.' || lpad(CAST(ticks % 10000 AS VARCHAR), 4, '0') AS time, coalesce(l7, l4) AS top_protocol, orig_len AS length,
                CASE WHEN app_name IS NOT NULL THEN '[' || app_name || '] ' ELSE '' END || {INFO} AS info
            FROM (SELECT *, (ts_ns - first_value(ts_ns) OVER (ORDER BY frame_index) + 50000) // 100000 AS ticks FROM f)"""),
    ),
    "latest_packets": (
        lambda s, d: sort_frames(events(s, d), "length").limit(20).select("frame_index", "orig_len"),
        _ev("SELECT frame_index, orig_len FROM f ORDER BY orig_len DESC, frame_index DESC LIMIT 20"),
    ),
}
