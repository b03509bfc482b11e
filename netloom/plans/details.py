"""Further registered queries: other links and versions, files, whole sessions joined back to
packets, and what a viewer shows of one packet or stream."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import format_bytes, format_duration, occurrences
from ..operators import conversations as conv
from ..operators import decrypt, enrich, filters, keys, listing, tcp
from ..operators.dissect import frames, frames_once
from ..operators.http_stream import attach_bodies, http_messages
from ..operators.layers import with_layers
from ..shared import shared_path
from ..sources.keylog import count_sessions, parse_keylog
from ..sources.pcap import read_pcap, write_pcap
from ..sources.pcap_index import index_captures, search_captures
from ..streaming.live import read_spool, spool_table
from ..streaming.ordered import ordered_datagrams
from . import synth
from .catalog import ANALYSIS, DIALOGUES, EV, INFO, Query, events, keylog_lines, read_dry, sealed_sessions

_HEX6 = "'2001:db8::' || printf('%x', {0} // 65536) || ':' || printf('%x', {0} % 65536)"
_V6 = f"""WITH {EV}, v AS (
    SELECT *, (CASE WHEN event_id % 2 = 0 THEN {synth.address('198.51.100.0')} ELSE {synth.address('1.0.0.0')} END) + event_id % 8 AS s6,
        {synth.address('10.0.0.0')} + user_id % 16777216 AS c6 FROM f)"""


def version6(spark: SparkSession, d: str) -> DataFrame:
    kinds = "CASE WHEN event_type IN ('click', 'view') THEN 6 WHEN event_type = 'error' THEN 58 ELSE 17 END"
    return frames(synth.event_packets(spark, d, version="6", protocol=kinds)).select("frame_index", "ip_version", "src_ip", "dst_ip", "l4", "l7", "icmp_type")


def other_links(spark: SparkSession, d: str) -> DataFrame:
    packets = synth.event_packets(spark, d, link_type="element_at(array(1, 101, 113, 276), CAST(event_id % 4 + 1 AS INT))")
    return frames(packets).select("frame_index", "link_type", "l2", "l3_at", "sll_packet", "src_ip", "top_protocol", "info")


def files(spark: SparkSession, d: str) -> DataFrame:
    """The events' packets written as capture files and read back in stretches of 64 kB."""
    folder = shared_path(spark, "captures")
    write_pcap(synth.event_packets(spark, d), folder)
    found = frames(read_pcap(spark, f"{folder}/*.pcap", splitBytes=1 << 16))
    return found.select("ts_ns", "cap_len", "orig_len", "link_type", "src_ip", "top_protocol")


def captures_of_one_name(spark: SparkSession, d: str) -> DataFrame:
    """Packets dealt out to captures of the same names in two folders, read back together: packets and
    different numbers of each, and the sessions found in it."""
    root = shared_path(spark, "captures")
    for half in (0, 1):
        own = {"capture_id": "concat('c', event_id div 2 % 4)", "frame_index": "event_id div 8 + 1"}
        write_pcap(synth.event_packets(spark, d, **own).where(f"(ts_ns div 1000000) % 2 = {half}"), f"{root}/half{half}")
    found = frames(read_pcap(spark, f"{root}/*/*.pcap", splitBytes=1 << 16))
    place = F.regexp_extract("capture_id", r"^half(\d)/c(\d)", 1), F.regexp_extract("capture_id", r"^half(\d)/c(\d)", 2)
    return found.groupBy(place[0].alias("half"), place[1].alias("part")).agg(
        F.count("*").alias("packets"), F.count_distinct("capture_id", "frame_index").alias("numbers"), F.sum("orig_len").alias("bytes")
    )


def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The events' packets as files with an index, searched by host and port: stretches without a match
    are not read."""
    folder, index = shared_path(spark, "captures"), shared_path(spark, "index")
    write_pcap(synth.event_packets(spark, d), folder)
    index_captures(spark, f"{folder}/*.pcap", index, 1 << 14)
    found = search_captures(spark, f"{folder}/*.pcap", index, "port 53 and (host 10.0.0.7 or host 198.51.100.2 or not udp)")
    return found.select("ts_ns", "cap_len", "src_ip", "dst_ip", "top_protocol")


def _quic_sealed(*columns: pa.Array) -> pa.Array:
    """Header and sealed payload with the packet number's and first byte's masks applied."""

    def one(head: bytes, sealed: bytes, mask: bytes) -> bytes:
        number = bytes(a ^ b for a, b in zip(head[-2:], mask[1:3], strict=True))
        return bytes([head[0] ^ (mask[0] & 15)]) + head[1:-2] + number + sealed

    return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], pa.binary())


def _hello(event_id: pa.Array) -> pa.Array:
    """A CRYPTO frame of eight bytes (a ClientHello's type and the event's number) and padding."""
    return pa.array([b"\x06\x00\x08\x01" + i.to_bytes(7, "big") + bytes(20) for i in event_id.to_pylist()], pa.binary())


def quic_packets(spark: SparkSession, d: str) -> DataFrame:
    """A sealed QUIC Initial per signup event, from a client of its own."""
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'signup'").select("event_id")
    e = e.withColumns({"plain": F.arrow_udf(_hello, "binary")("event_id"), "k": keys.quic_initial_keys(F.expr("unhex(lpad(hex(event_id), 16, '0'))"))["client"]})
    number = "lpad(hex(event_id % 1000), 4, '0')"
    e = e.withColumn("head", F.expr(f"unhex(concat('C10000000108', lpad(hex(event_id), 16, '0'), '0000', lpad(hex(16384 + 2 + octet_length(plain) + 16), 4, '0'), {number}))"))
    nonce = decrypt.number_in_iv(F.col("k.iv"), F.expr("event_id % 1000"))
    e = e.withColumn("sealed", F.substr(F.aes_encrypt("plain", F.col("k.key"), F.lit("GCM"), F.lit("DEFAULT"), nonce, F.col("head")), F.lit(13)))
    e = e.withColumn("mask", F.aes_encrypt(F.substring("sealed", 3, 16), F.col("k.hp"), F.lit("ECB"), F.lit("PKCS")))
    return synth.raw_packets(
        e.withColumn("payload", F.arrow_udf(_quic_sealed, "binary")("head", "sealed", "mask")).selectExpr(
            "'quic' AS capture_id", "event_id AS frame_index", "event_id * 1000 AS ts_ns", "17 AS protocol", f"{synth.NET_10} + event_id AS src",
            f"{synth.address('192.0.2.43')} AS dst", "50000 AS sport", "443 AS dport", "payload",
        )
    )


def quic_opened(spark: SparkSession, d: str) -> DataFrame:
    found = decrypt.decrypt_quic_initials(frames(quic_packets(spark, d)))
    crypto = F.col("crypto")[0]
    return found.select("frame_index", "packet_number", crypto["offset"].alias("at"), crypto["length"].alias("size"), F.lower(F.hex(crypto["data"])).alias("data"))


def coded_bodies(spark: SparkSession, d: str) -> DataFrame:
    found = http_messages(tcp.reassemble(frames(synth.page_packets(spark, d, synth.CODED)))).where("coding is not null")
    return found.select("frame_index", "coding", "decompress_ok", F.octet_length("body").cast("long").alias("size"), F.md5("body").alias("body_md5"))


def odd_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of two gzip members, cut off, and with something behind; what failed stays as it came."""
    found = http_messages(tcp.reassemble(frames(synth.page_packets(spark, d, synth.ODDLY_CODED)))).where("coding is not null")
    whole = F.col("decompress_ok")
    return found.select("frame_index", "coding", "decompress_ok", F.when(whole, F.octet_length("body")).cast("long").alias("size"), F.when(whole, F.md5("body")).alias("body_md5"))


def document_search(spark: SparkSession, d: str) -> DataFrame:
    """A letter in every packet of the documents, however many places a text has; none where there is no payload."""
    text = F.coalesce(F.decode("payload", "UTF-8"), F.lit(""))
    packets = frames(synth.document_packets(spark, d)).select("frame_index", occurrences(text, "E").alias("at"))
    return packets.select(
        "frame_index", F.size("at").alias("places"), F.try_element_at("at", F.lit(1)).alias("first"), F.try_element_at("at", F.lit(-1)).alias("last"),
        F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
    )


def shown_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Bytes and durations of the dialogues' conversations as a viewer shows them."""
    found = conv.conversation_stats(frames(synth.dialogue_packets(spark, d)))
    size = F.col("bytes_ab") + F.col("bytes_ba")
    return found.select("ip_a", "port_a", "ip_b", "port_b", format_bytes(size).alias("size"), format_duration(F.col("duration_ns")).alias("duration"))


def attached(spark: SparkSession, d: str) -> DataFrame:
    packets = frames_once(synth.page_packets(spark, d))
    found = attach_bodies(packets, http_messages(tcp.reassemble(packets))).where("http_bodies is not null")
    return found.select("frame_index", F.array_join("http_bodies", "; ").alias("bodies"))


UNREADABLE = {
    "garbage": ("UnknownToken", "garbage"), "port abc": ("ExpectedDigit", "abc"), "port 99999": ("PortOutOfRange", "99999"), "host": ("MissingArgument", "host"),
    "tcp and": ("UnexpectedEnd", ""), "tcp foobar": ("ExtraToken", "foobar"), "(tcp": ("MissingRightParen", ""), "(tcp udp": ("ExpectedRightParen", "udp"),
}


def filter_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with expressions, and how many packets are left where an unreadable one
    matches everything."""
    packets, found = events(spark, d), []
    for text in UNREADABLE:
        try:
            filters.match_filter(text)
        except filters.FilterError as e:
            shown = F.count_if(filters.match_filter(text, on_error="match_all"))
            found.append(F.struct(F.lit(text).alias("text"), F.lit(type(e).__name__).alias("error"), F.lit("" if e.got is None else str(e.got)).alias("got"), shown.alias("shown")))
    return packets.agg(F.array(*found).alias("rows")).select(F.inline("rows"))


TEXTS = ("tcp or quic", "port 53 and not host 1.0.0.3", "sni site3", "http.path item/1", "http.method GET and http.host site2", "url site4", "dns.name SITE5", "app app1", "not (udp or icmp)", "")


def filters_agree(spark: SparkSession, d: str) -> DataFrame:
    """Each expression over the flat columns and over the protocol tree: matches of each, and
    packets about which they differ."""
    rows = with_layers(events(spark, d))
    both = [(filters.match_filter(t), filters.match_filter(t, tree=True)) for t in TEXTS]
    counts = rows.agg(*[F.struct(F.count_if(a).alias("flat"), F.count_if(b).alias("tree"), F.count_if(a != b).alias("differ")).alias(str(i)) for i, (a, b) in enumerate(both)])
    each = F.array(*[F.struct(F.lit(t).alias("text"), F.col(str(i)).alias("n")) for i, t in enumerate(TEXTS)])
    return counts.select(F.explode(each).alias("x")).select("x.text", "x.n.*")


def live_headless(spark: SparkSession, d: str) -> DataFrame:
    """A spool whose header was missed, with a datagram too short and one that claims too
    much after every hundredth packet: packets as guessed, and the malformed ones."""
    out = shared_path(spark, "live")
    rows = spool_table(synth.event_packets(spark, d)).where("arrival > 0").selectExpr("capture_id", "arrival * 3 AS arrival", "datagram")
    bad = rows.where("arrival % 300 = 0").selectExpr("capture_id", "inline(array(struct(arrival + 1, X'0102'), struct(arrival + 2, concat(substring(datagram, 1, 8), X'FFFFFF7F', X'00000000', X'00'))))")

    def use(parsed: DataFrame, number: int) -> None:
        parsed.select("malformed", "link_type", "frame_index").write.mode("overwrite").parquet(f"{out}/trigger={number}")

    read_dry(spark, rows.unionByName(bad.toDF(*rows.columns)), use)
    return spark.read.parquet(out).groupBy("malformed", "link_type").agg(F.count("*").alias("datagrams"), F.count_distinct("frame_index").alias("numbers"))


def live_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    """The events' datagrams in eight files by a hash, read two a trigger, so that few arrive in order."""
    spool, out = shared_path(spark, "spool"), shared_path(spark, "live")
    spool_table(synth.event_packets(spark, d)).withColumn("file", F.pmod(F.xxhash64("arrival"), F.lit(8))).repartition("file").drop("file").write.parquet(spool)
    cores, partitions = spark.sparkContext.defaultParallelism, "spark.sql.shuffle.partitions"
    # A store per core is enough for one capture, whose packets are dealt out again to be dissected.
    own = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        partitions: str(min(cores, int(spark.conf.get(partitions)))),
    }
    before = {key: spark.conf.get(key) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        stream = frames(ordered_datagrams(read_spool(spark, spool, 2)).where("not malformed").drop("malformed").repartition(cores))
        sink = stream.select("capture_id", "frame_index", "cap_len", "orig_len", "top_protocol").writeStream.format("parquet").option("path", out)
        query = sink.option("checkpointLocation", shared_path(spark, "state")).start()
        # Timers always leave a next trigger, so the query ends when all that was spooled is done.
        total, seen = spark.read.parquet(spool).count(), {}
        while query.isActive and sum(seen.values()) < total:
            seen |= {p.batchId: p.numInputRows for p in query.recentProgress}
            time.sleep(0.1)
        if query.exception():
            raise query.exception()
        query.stop()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.parquet(out)


def _layer_fields(tree: DataFrame, protocol: str, *names: str) -> DataFrame:
    """The fields of those names in the protocol's layer, as one text per packet."""
    layer = F.try_element_at(F.filter("layers", lambda x: x["protocol"] == protocol), F.lit(1))
    own = F.filter(layer["fields"], lambda f: f["name"].isin(*names))
    shown = F.array_join(F.transform(own, lambda f: F.concat(f["name"], F.lit("="), f["value"])), "; ")
    return tree.select("frame_index", shown.alias("fields"), layer["summary"].alias("summary")).where("fields <> ''")


def tcp_tree(spark: SparkSession, d: str) -> DataFrame:
    packets = frames_once(synth.dialogue_packets(spark, d))
    return _layer_fields(enrich.with_tcp_analysis(with_layers(packets), tcp.analyse(packets)), "TCP", "Relative Seq", "Relative Ack", "TCP Analysis").select(
        "frame_index", "fields", F.regexp_extract("summary", r"\[TCP .*\]$", 0).alias("tail")
    )


def tls_tree(spark: SparkSession, d: str) -> DataFrame:
    raw, log = sealed_sessions(spark, d, True)
    packets = frames_once(raw)
    tree = enrich.with_tls_plaintext(with_layers(packets), decrypt.decrypt_tls(packets, log))
    return _layer_fields(tree, "TLS", "Decryption", "Decrypted (hex)", "Decrypted (text)").drop("summary")


def quic_tree(spark: SparkSession, d: str) -> DataFrame:
    packets = frames_once(quic_packets(spark, d))
    tree = enrich.with_quic_plaintext(with_layers(packets), decrypt.decrypt_quic_initials(packets))
    return _layer_fields(tree, "QUIC", "Initial decryption", "CRYPTO frame", "CRYPTO data (hex)", "Handshake").drop("summary")


def payload_summary(spark: SparkSession, d: str) -> DataFrame:
    found = listing.frame_payload(frames(synth.dialogue_packets(spark, d)))
    return found.select("frame_index", F.octet_length("rest").alias("size"), F.md5("rest").alias("rest_md5"), F.substring_index("rest_summary", " · ", 2).alias("kind"))


def stream_matches(spark: SparkSession, d: str) -> DataFrame:
    return tcp.search_stream(tcp.follow_stream(synth.dialogue_packets(spark, d), "dialogues", 1000), "e")


def stream_totals(spark: SparkSession, d: str) -> DataFrame:
    return tcp.stream_totals(tcp.follow_stream(synth.dialogue_packets(spark, d), "dialogues", 1000))


_HTTP_PAGES = "SELECT page_id * 1000 + 1 AS frame_index, page_id, coalesce(html, '') AS html FROM pages"
_FRAMES_OF = "(octet_length(encode({0})) + 1399) // 1400"
QUERIES: dict[str, tuple[Query, str]] = {
    "version6": (
        version6,
        f"""{_V6} SELECT frame_index, 6 AS ip_version, CASE WHEN back THEN {_HEX6.format('s6')} ELSE {_HEX6.format('c6')} END AS src_ip,
            CASE WHEN back THEN {_HEX6.format('c6')} ELSE {_HEX6.format('s6')} END AS dst_ip, CASE WHEN l4 = 'ICMP' THEN 'ICMPv6' ELSE l4 END AS l4, l7,
            CASE WHEN l4 = 'ICMP' THEN CASE WHEN back THEN 0 ELSE 8 END END AS icmp_type FROM v""",
    ),
    "other_links": (
        other_links,
        f"""WITH {EV} SELECT frame_index, [1, 101, 113, 276][CAST(event_id % 4 + 1 AS INT)] AS link_type,
            ['Ethernet', NULL, 'Linux cooked v1', 'Linux cooked v2'][CAST(event_id % 4 + 1 AS INT)] AS l2, [14, 0, 16, 20][CAST(event_id % 4 + 1 AS INT)] AS l3_at,
            CASE WHEN event_id % 4 >= 2 THEN 'Outgoing' END AS sll_packet, src_ip, coalesce(l7, l4) AS top_protocol, {INFO} AS info FROM f""",
    ),
    "capture_files": (
        files,
        f"WITH {EV} SELECT (ts_ns // 1000) * 1000 AS ts_ns, CAST(cap_len AS INT) AS cap_len, orig_len, 1 AS link_type, src_ip, coalesce(l7, l4) AS top_protocol FROM f",
    ),
    "captures_of_one_name": (
        captures_of_one_name,
        f"""WITH {EV} SELECT CAST((ts_ns // 1000000) % 2 AS VARCHAR) AS half, CAST((event_id // 2) % 4 AS VARCHAR) AS part, count(*) AS packets, count(*) AS numbers,
            CAST(sum(orig_len) AS BIGINT) AS bytes FROM f GROUP BY ALL""",
    ),
    "indexed_search": (
        indexed_search,
        f"""WITH {EV} SELECT (ts_ns // 1000) * 1000 AS ts_ns, CAST(cap_len AS INT) AS cap_len, src_ip, dst_ip, coalesce(l7, l4) AS top_protocol FROM f
            WHERE 53 IN (src_port, dst_port) AND ('10.0.0.7' IN (src_ip, dst_ip) OR '198.51.100.2' IN (src_ip, dst_ip) OR l4 <> 'UDP')""",
    ),
    "quic_initial": (
        quic_opened,
        """SELECT event_id AS frame_index, event_id % 1000 AS packet_number, CAST(0 AS BIGINT) AS at, CAST(8 AS BIGINT) AS size, '01' || printf('%014x', event_id) AS data
            FROM events WHERE event_type = 'signup'""",
    ),
    "http_coded_bodies": (
        coded_bodies,
        f"""SELECT frame_index, CASE WHEN page_id % 2 = 1 THEN 'deflate' ELSE 'gzip' END AS coding, TRUE AS decompress_ok, strlen(html) AS size, md5(html) AS body_md5
            FROM ({_HTTP_PAGES})""",
    ),
    "http_odd_bodies": (
        odd_bodies,
        f"""SELECT frame_index, CASE WHEN page_id % 4 = 3 THEN 'deflate' ELSE 'gzip' END AS coding, page_id % 4 <> 1 AS decompress_ok,
                CASE WHEN page_id % 4 <> 1 THEN strlen(html) END AS size, CASE WHEN page_id % 4 <> 1 THEN md5(html) END AS body_md5 FROM ({_HTTP_PAGES})""",
    ),
    "document_search": (
        document_search,
        """WITH c AS (SELECT doc_id, string_split(coalesce(text, ''), '') AS chars FROM documents),
            p AS (SELECT doc_id, list_filter(list_transform(chars, lambda x, i: CASE WHEN lower(x) = 'e' THEN i - 1 END), lambda x: x IS NOT NULL) AS found FROM c)
            SELECT doc_id AS frame_index, CAST(len(found) AS INT) AS places, CAST(found[1] AS INT) AS first, CAST(found[-1] AS INT) AS last, CAST(coalesce(list_sum(found), 0) AS BIGINT) AS total FROM p""",
    ),
    "conversation_shown": (
        shown_conversations,
        f"""WITH {DIALOGUES}, k AS (
                SELECT split_part(sk, ' ', 1) AS a, split_part(sk, ' ', 2) AS b, CAST(sum(plen + 54) AS BIGINT) AS n, max(idx) - min(idx) AS ms FROM t0 GROUP BY sk),
            o AS (SELECT *, split_part(a, ':', 1) AS ip1, CAST(split_part(a, ':', 2) AS INT) AS port1, split_part(b, ':', 1) AS ip2, CAST(split_part(b, ':', 2) AS INT) AS port2 FROM k),
            s AS (SELECT *, (ip1, port1) <= (ip2, port2) AS same FROM o)
            SELECT CASE WHEN same THEN ip1 ELSE ip2 END AS ip_a, CASE WHEN same THEN port1 ELSE port2 END AS port_a, CASE WHEN same THEN ip2 ELSE ip1 END AS ip_b, CASE WHEN same THEN port2 ELSE port1 END AS port_b,
                CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', floor(n * 10 / 1024 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1fMB', floor(n * 10 / 1048576 + 0.5) / 10)
                    ELSE printf('%.2fGB', floor(n * 100 / 1073741824 + 0.5) / 100) END AS size,
                CASE WHEN ms <= 0 THEN '—' WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.2fs', ((ms + 5) // 10) / 100) WHEN ms < 3600000 THEN ((ms + 500) // 1000) || 's'
                    ELSE printf('%.1fh', ((ms + 180000) // 360000) / 10) END AS duration FROM s""",
    ),
    "http_attached": (
        attached,
        f"""WITH p AS ({_HTTP_PAGES}),
            a AS (SELECT frame_index, page_id, strlen(html) AS n, strlen('HTTP/1.1 200 OK') + 2 + CASE WHEN page_id % 2 = 1
                THEN strlen('Transfer-Encoding: chunked') + 4 + strlen(printf('%x', strlen(html))) + 2 + strlen(html) + 2 + 3 + 2
                ELSE strlen('Content-Length: ' || strlen(html)) + 4 + strlen(html) END AS total FROM p)
            SELECT frame_index, CASE WHEN page_id % 2 = 1 THEN 'chunked → ' ELSE '' END || n || 'B across ' || ((total + 1399) // 1400) || ' frame(s)' AS bodies FROM a
            UNION ALL SELECT page_id * 1000, '0B across 1 frame(s)' FROM a""",
    ),
    "filter_errors": (
        filter_errors,
        "SELECT *, (SELECT count(*) FROM events) AS shown FROM (VALUES " + ", ".join(f"('{t}', '{e}', '{g}')" for t, (e, g) in UNREADABLE.items()) + ") AS v(text, error, got)",
    ),
    "filters_agree": (
        filters_agree,
        f"""WITH {EV}, x AS (SELECT unnest([
                {{'text': '{TEXTS[0]}', 'n': count(*) FILTER (WHERE l4 = 'TCP' OR l7 = 'QUIC')}},
                {{'text': '{TEXTS[1]}', 'n': count(*) FILTER (WHERE coalesce(src_port = 53 OR dst_port = 53, FALSE) AND src_ip <> '1.0.0.3' AND dst_ip <> '1.0.0.3')}},
                {{'text': '{TEXTS[2]}', 'n': count(*) FILTER (WHERE l7 = 'TLS' AND contains(host, 'site3'))}},
                {{'text': '{TEXTS[3]}', 'n': count(*) FILTER (WHERE l7 = 'HTTP' AND starts_with(CAST(event_id AS VARCHAR), '1'))}},
                {{'text': '{TEXTS[4]}', 'n': count(*) FILTER (WHERE l7 = 'HTTP' AND contains(host, 'site2'))}},
                {{'text': '{TEXTS[5]}', 'n': count(*) FILTER (WHERE l7 IN ('HTTP', 'TLS') AND contains(host, 'site4'))}},
                {{'text': '{TEXTS[6]}', 'n': count(*) FILTER (WHERE l7 = 'DNS' AND contains(host, 'site5'))}},
                {{'text': '{TEXTS[7]}', 'n': count(*) FILTER (WHERE app_name = 'app1')}},
                {{'text': '{TEXTS[8]}', 'n': count(*) FILTER (WHERE l4 = 'TCP')}},
                {{'text': '{TEXTS[9]}', 'n': count(*)}}]) AS r FROM f)
            SELECT r.text AS text, r.n AS flat, r.n AS tree, CAST(0 AS BIGINT) AS differ FROM x""",
    ),
    "filter_counts": (
        lambda s, d: listing.counted(events(s, d), "tcp and port 443"),
        f"WITH {EV} SELECT capture_id, count(*) FILTER (WHERE l4 = 'TCP' AND (src_port = 443 OR dst_port = 443)) AS shown, count(*) AS total FROM f GROUP BY capture_id",
    ),
    "live_out_of_order": (
        live_out_of_order,
        f"WITH {EV} SELECT capture_id, frame_index, CAST(cap_len AS INT) AS cap_len, orig_len, coalesce(l7, l4) AS top_protocol FROM f",
    ),
    "live_headless": (
        live_headless,
        """SELECT FALSE AS malformed, 1 AS link_type, count(*) AS datagrams, count(*) AS numbers FROM events
            UNION ALL SELECT TRUE, NULL, n, n FROM (SELECT 2 * count(*) AS n FROM events WHERE (event_id + 1) % 100 = 0) WHERE n > 0""",
    ),
    "tcp_tree": (
        tcp_tree,
        f"""WITH {DIALOGUES}, {ANALYSIS},
            t9 AS (SELECT *, list_filter([CASE WHEN retransmission THEN 'TCP Retransmission' END, CASE WHEN out_of_order THEN 'TCP Out-Of-Order' END,
                CASE WHEN dup_ack > 0 THEN 'TCP Dup ACK #' || dup_ack END], lambda x: x IS NOT NULL) AS tags FROM a6)
            SELECT idx AS frame_index, 'Relative Seq=' || rel_seq || coalesce('; Relative Ack=' || rel_ack, '') || CASE WHEN len(tags) > 0 THEN '; TCP Analysis=' || array_to_string(tags, ', ') ELSE '' END AS fields,
                CASE WHEN len(tags) > 0 THEN '[' || array_to_string(tags, ', ') || ']' ELSE '' END AS tail FROM t9""",
    ),
    "tls_tree": (
        tls_tree,
        """SELECT event_id + 10000000 AS frame_index, 'Decryption=✓ ApplicationData (' || length('GET /secret/' || event_id) || 'B); Decrypted (hex)='
            || lower(hex(encode('GET /secret/' || event_id))) || '; Decrypted (text)=GET /secret/' || event_id AS fields FROM events WHERE event_type = 'view'""",
    ),
    "quic_tree": (
        quic_tree,
        """SELECT event_id AS frame_index, 'Initial decryption=✓ pn=' || (event_id % 1000) || ' (31B plaintext); CRYPTO frame=offset=0 length=8; CRYPTO data (hex)=01'
            || printf('%014x', event_id) || '; Handshake=1 (Client Hello)' AS fields FROM events WHERE event_type = 'signup'""",
    ),
    "payload_summary": (
        payload_summary,
        f"""WITH {DIALOGUES} SELECT idx AS frame_index, CAST(nullif(size, 0) AS INT) AS size, CASE WHEN size > 0 THEN md5(text) END AS rest_md5, CASE WHEN size > 0 THEN size || CASE size WHEN 1 THEN ' byte' ELSE ' bytes' END || ' · '
            || CASE WHEN len(regexp_replace(text, '[^\\x20-\\x7e\\t\\n\\r]', '', 'g')) * 5 >= size * 4 THEN 'UTF-8' ELSE 'binary' END END AS kind
            FROM (SELECT *, plen AS size FROM t0)""",
    ),
    "stream_matches": (
        stream_matches,
        f"""WITH {DIALOGUES}, s AS (SELECT idx AS frame_index, lower(text) AS x FROM t0 WHERE conv_id = 1 AND plen > 0),
            m AS (SELECT frame_index, CAST(unnest(list_filter(range(0, length(x)), lambda i: substr(x, CAST(i + 1 AS BIGINT), 1) = 'e')) AS INT) AS pos FROM s),
            n AS (SELECT frame_index, pos, CAST(row_number() OVER (ORDER BY frame_index, pos) - 1 AS INT) AS nth, CAST(count(*) OVER () AS INT) AS total FROM m)
            SELECT *, (nth + 1) % total AS next, (nth + total - 1) % total AS previous FROM n""",
    ),
    "stream_totals": (stream_totals, f"WITH {DIALOGUES} SELECT count(*) AS segments, CAST(sum(plen) AS BIGINT) AS bytes FROM t0 WHERE conv_id = 1 AND plen > 0"),
    "keylog_counts": (
        lambda s, d: count_sessions(parse_keylog(keylog_lines(s, d))),
        "SELECT count(DISTINCT user_id) AS sessions, count(DISTINCT user_id) AS secrets FROM events WHERE event_id % 7 >= 4",
    ),
}
