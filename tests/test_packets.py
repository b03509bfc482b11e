"""Dissection, routing, filters, TCP, HTTP, keys and live captures on hand-made packets."""

import gzip
import random
import struct
import time
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from netloom import constants as C
from netloom.functions.render import format_bytes, format_duration, hex_dump, occurrences
from netloom.operators import decrypt, filters, keys, tcp
from netloom.operators.conversations import conversations
from netloom.operators.dissect import frames
from netloom.operators.http_stream import Direction, _decoded, attach_bodies, http_messages
from netloom.operators.names import Overrun, read_name
from netloom.schema import RAW_FRAMES
from netloom.sources.keylog import latest_secrets, parse_keylog, read_keylog
from netloom.sources.pcap import MAGICS, CaptureError, PcapSource, read_header, read_pcap
from netloom.streaming.live import LiveCapture, Progress, parse_datagram


def ip4(proto, inner, src="10.0.0.1", dst="8.8.8.8"):
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(inner), 0, 0x4000, 64, proto, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split(".")))) + inner


def seg(sp, dp, payload=b"", seq=1, ack=1, flags=0x18):
    return struct.pack(">HHIIHHHH", sp, dp, seq, ack, 0x5000 | flags, 64240, 0, 0) + payload


def dgram(sp, dp, payload=b""):
    return struct.pack(">HHHH", sp, dp, 8 + len(payload), 0) + payload


def eth(inner, kind=0x0800):
    return b"\xaa" * 6 + b"\xbb" * 6 + struct.pack(">H", kind) + inner


def hello(host=b"example.com"):
    name = b"\0" + struct.pack(">H", len(host)) + host
    names = struct.pack(">H", len(name)) + name
    ext = b"\0\0" + struct.pack(">H", len(names)) + names
    body = b"\x03\x03" + bytes(32) + b"\0" + b"\0\x02\0\x2f" + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(shake)) + shake


QUERY = bytes.fromhex("123401000001000000000000076578616d706c6503636f6d0000010001")
ANSWER = bytes.fromhex("123481800001000100000000076578616d706c6503636f6d0000010001C00C000100010000012C00045DB8D822")
LOOP = bytes.fromhex("123401000001000000000000C00C00010001")
GET = b"GET /index.html HTTP/1.1\r\nHost: example.com\r\nUser-Agent: x\r\nAccept: */*\r\n\r\n"
INITIAL = bytes.fromhex("C000000001088394c8f03e515708000040100a0b0c0d0e0f10111213141516171819")
TRAILER = bytes.fromhex("01072021") + struct.pack(">I", 10123) + "Läden".encode().ljust(20, b"\0") + bytes.fromhex("DEADBEEF")


def table(spark, packets, link=1):
    rows = [("t", i, 1_700_000_000_000_000_000 + i, len(p), len(p), link, bytearray(p)) for i, p in enumerate(packets, 1)]
    return spark.createDataFrame(rows, RAW_FRAMES)


@pytest.fixture(scope="module")
def mixed(spark):
    packets = [
        eth(ip4(17, dgram(51000, 53, QUERY))),
        eth(ip4(6, seg(51000, 80, GET))),
        eth(ip4(6, seg(51000, 443, hello()))),
        eth(ip4(17, dgram(51000, 443, INITIAL))),
        eth(ip4(6, seg(50000, 60000, b"random payload"))),
        eth(ip4(6, seg(51000, 9443, hello()))),
        eth(ip4(6, seg(51000, 12345, GET))),
        eth(ip4(6, seg(51000, 80, hello()))),
        eth(ip4(6, seg(51234, 80, seq=0, flags=2))),
        eth(ip4(1, b"\x08\0\0\0")),
        eth(b"\0" * 8, 0x0806),
        eth(b"\x45" * 18),
        eth(ip4(17, dgram(53, 51000, ANSWER))) + TRAILER,
        eth(ip4(17, dgram(53, 51000, LOOP))),
        b"\xaa" * 5,
        eth(ip4(6, seg(80, 51000, b"HTTP/1.1 200 OK\r\nServer: x\r\n"))),
        eth(b"\x60" + bytes(5) + b"\x3a\x40" + bytes.fromhex("20010db8000000000001000000000001") + bytes(15) + b"\x01" + b"\x80\0\0\0", 0x86DD),
        eth(b"\x60" + bytes(5) + b"\x00\x40" + bytes(32) + b"\x80\0\0\0", 0x86DD),
    ]
    return {r["frame_index"]: r for r in frames(table(spark, packets)).collect()}, packets


def test_layers(mixed):
    rows, _ = mixed
    e4 = ["Ethernet", "IPv4"]
    want = [
        [*e4, "UDP", "DNS"], [*e4, "TCP", "HTTP"], [*e4, "TCP", "TLS"], [*e4, "UDP", "QUIC"], [*e4, "TCP"], [*e4, "TCP", "TLS"], [*e4, "TCP", "HTTP"],
        [*e4, "TCP"], [*e4, "TCP"], [*e4, "ICMP"], ["Ethernet"], e4, [*e4, "UDP", "DNS", C.APP_METADATA], [*e4, "UDP", "DNS"], ["Ethernet"],
        [*e4, "TCP", "HTTP"], ["Ethernet", "IPv6", "ICMPv6"], ["Ethernet", "IPv6"],
    ]
    assert [rows[i]["protocols"] for i in sorted(rows)] == want
    assert [i for i in rows if rows[i]["any_truncated"]] == [12, 14, 15, 16, 18]


def test_values(mixed):
    rows, _ = mixed
    assert rows[1]["info"] == "Q: example.com A" and rows[1]["dns_names"] == ["example.com"]
    assert rows[2]["http_host"] == "example.com" and rows[2]["http_path"] == "/index.html" and rows[2]["http_method"] == "GET"
    assert rows[3]["sni"] == rows[6]["sni"] == "example.com"
    assert rows[4]["quic_dcid"] == "8394c8f03e515708" and rows[4]["info"].startswith("QUIC Initial v=v1")
    assert rows[5]["info"] == "50000 → 60000  [PSH,ACK] Seq=1 Ack=1 Win=64240 Len=14"
    assert rows[9]["info"] == "51234 → 80  [SYN] Seq=0 Win=64240 Len=0"
    assert rows[10]["info"] == "Echo Request"
    assert rows[11]["info"] == "bb:bb:bb:bb:bb:bb → aa:aa:aa:aa:aa:aa"
    assert rows[12]["src_ip"] is None and rows[12]["top_protocol"] == "IPv4"
    assert rows[13]["info"] == "A: example.com → 93.184.216.34" and rows[13]["dns"]["answer"]["ttl"] == 300
    assert rows[13]["app_name"] == "Läden" and rows[13]["uid"] == 10123
    assert rows[14]["dns"]["truncated"] and rows[14]["dns_names"] == []
    assert rows[16]["info"] == "HTTP Response: 1.1 200 OK  (headers truncated)" and rows[16]["http_method"] is None
    assert rows[17]["src_ip"] == "2001:db8::1:0:0:1" and rows[17]["dst_ip"] == "::1" and rows[17]["info"] == "Echo Request"


def test_link_types(spark):
    raw = ip4(17, dgram(1, 2))
    v1 = struct.pack(">HHHQH", 4, 1, 6, 0, 0x0800) + raw
    v2 = struct.pack(">HHIHBBQ", 0x0800, 0, 1, 1, 0, 6, 0) + raw
    for link, packet, first in ((101, raw, "IPv4"), (113, v1, C.SLL), (276, v2, C.SLL2), (7, raw, None)):
        row = frames(table(spark, [packet], link)).first()
        assert (row["protocols"][0] if row["protocols"] else None) == first
        assert row["top_protocol"] == ("UDP" if first else "Raw")
    assert frames(table(spark, [v1], 113)).first()["l2_info"] == "Outgoing"


@pytest.mark.parametrize(
    "text,error,got",
    [
        ("garbage", filters.UnknownToken, "garbage"), ("port abc", filters.ExpectedDigit, "abc"), ("port 99999", filters.PortOutOfRange, 99999),
        ("port -1", filters.PortOutOfRange, -1), ("host", filters.MissingArgument, "host"), ("tcp and", filters.UnexpectedEnd, None),
        ("tcp foobar", filters.ExtraToken, "foobar"), ("(tcp", filters.MissingRightParen, None), ("(tcp udp", filters.ExpectedRightParen, "udp"),
        ("()", filters.UnknownToken, ")"),
    ],
)
def test_filter_errors(spark, text, error, got):
    with pytest.raises(error) as e:
        filters.match_filter(text)
    assert type(e.value) is error and e.value.got == got


def test_filters(spark, mixed):
    _, packets = mixed
    df = frames(table(spark, packets))
    cases = {
        "": set(range(1, 19)), "dns": {1, 13, 14}, "DNS or quic": {1, 4, 13, 14}, "port 53": {1, 13, 14}, "host 8.8.8.8 and http": {2, 7, 16},
        "sni EXAMPLE": {3, 6}, "not sni example and tcp and not http": {5, 8, 9}, "http.host example.COM": {2, 7}, "http.path index": {2, 7}, "http.method get": {2, 7},
        "url com/index": {2, 7}, "url example": {2, 3, 6, 7}, "dns.name EXAMPLE": {1, 13}, "app LÄD": {13}, "text RANDOM": {5}, "text Lä": {13},
        "not (tcp or udp)": {10, 11, 12, 15, 17, 18}, "tcp or udp and port 53": {1, 2, 3, 5, 6, 7, 8, 9, 13, 14, 16}, "not not icmp": {10}, "icmpv6": {17},
    }
    tests = [F.when(filters.match_filter(t), F.col("frame_index")).alias(str(i)) for i, t in enumerate(cases)]
    rows = df.select(*tests).collect()
    for i, (text, want) in enumerate(cases.items()):
        assert {r[i] for r in rows} - {None} == want, text
    assert filters.filter_frames(df, "garbage", on_error="match_all").count() == len(packets)


def test_conversations_order_both_ways(spark):
    packets = [eth(ip4(6, seg(80, 9, b"x"), "10.0.0.2", "10.0.0.10")), eth(ip4(6, seg(9, 80, b"yy"), "10.0.0.10", "10.0.0.2")), eth(ip4(17, dgram(9, 80), "10.0.0.10", "10.0.0.2"))]
    got = {r["l4"]: r for r in conversations(frames(table(spark, packets))).collect()}
    assert got["TCP"]["packets"] == 2 and (got["TCP"]["ip_a"], got["TCP"]["port_a"]) == ("10.0.0.10", 9)
    assert got["UDP"]["packets"] == 1 and got["TCP"]["bytes"] == 2 * 54 + 3


def flow(*parts, up=True):
    ends = ("10.0.0.1", "10.0.0.2", 5000, 9999)
    out = []
    for seq, payload, flags, mine in parts:
        a, b, sp, dp = ends if mine else (ends[1], ends[0], ends[3], ends[2])
        out.append(eth(ip4(6, seg(sp, dp, payload, seq, 1, flags), a, b)))
    return out


def test_tcp_traces(spark):
    rows = {r["frame_index"]: r for r in tcp.analyse(frames(table(spark, flow((1000, b"", 2, True), (1001, b"hello", 24, True), (1001, b"hello", 24, True), (900, b"old", 24, True))))).collect()}
    assert [rows[i]["rel_seq"] for i in (1, 2)] == [0, 1]
    assert rows[3]["tags"] == ["TCP Retransmission"] and rows[4]["tags"] == ["TCP Out-Of-Order"]
    assert rows[3]["tcp_info"].endswith("  [TCP Retransmission]")

    def joined(*parts):
        chunks = tcp.reassemble(frames(table(spark, flow(*parts))))
        return {r["src"].split(":")[1]: (bytes(r["stream"]), [p["data_offset"] for p in r["pieces"]]) for r in tcp.streams(chunks).collect()}

    assert joined((0, b"", 2, True), (1, b"GET ", 24, True), (5, b"/index.html", 24, True), (16, b" HTTP/1.1\r\n", 24, True))["5000"] == (b"GET /index.html HTTP/1.1\r\n", [0, 4, 15])
    assert joined((1, b"AAAA", 24, True), (1, b"AAAA", 24, True), (5, b"BBBB", 24, True))["5000"] == (b"AAAABBBB", [0, 4])
    assert joined((1, b"AAAA", 24, True), (3, b"AABB", 24, True))["5000"][0] == b"AAAABB"
    assert joined((100, b"GET /", 2, True))["5000"][0] == b"GET /"
    both = joined((1, b"ping", 24, True), (1, b"pong", 24, False))
    assert both["5000"][0] == b"ping" and both["9999"][0] == b"pong"


def test_http_bodies(spark):
    zipped = gzip.compress(b"hello gzip world")
    cases = [
        [b"HTTP/1.1 200 OK\r\nContent-Length: 26\r\n\r\n", b"abcdefghijklmnopq", b"rstuvwxyz"],
        [b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Length: %d\r\n\r\n" % len(zipped) + zipped],
        [b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n7\r\nMozilla\r\n9;x=1\r\nDeveloper\r\n7\r\nNetwork\r\n0\r\n\r\n"],
        [b"HTTP/1.1 204 No Content\r\nContent-Length: 0\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nHello"],
    ]
    packets = []
    for n, parts in enumerate(cases):
        seq = 1
        for p in parts:
            packets.append(eth(ip4(6, seg(80, 4000 + n, p, seq), "10.0.0.9", "10.0.0.1")))
            seq += len(p)
    df = frames(table(spark, packets))
    found = http_messages(tcp.reassemble(df))
    rows = sorted((r["session"], r["first_line"], r["body_info"], r["preview"]) for r in found.collect())
    assert [r[2] for r in rows] == ["26B across 3 frame(s)", "gzip → 16B decoded across 1 frame(s)", "chunked → 23B across 1 frame(s)", "5B across 1 frame(s)", "0B across 1 frame(s)"]
    assert [r[3] for r in rows] == ["abcdefghijklmnopqrstuvwxyz", "hello gzip world", "MozillaDeveloperNetwork", "Hello", None]
    attached = {r["frame_index"]: r["http_bodies"] for r in attach_bodies(df, found).collect() if r["http_bodies"]}
    assert attached[1] == ["26B across 3 frame(s)"] and len(attached[6]) == 2


def read(data, cuts=(), **limits):
    direction = Direction(**{"most_messages": None, "most_chunks": None} | limits)
    bounds = [0, *cuts, len(data)]
    out = [m for n, (a, b) in enumerate(zip(bounds, bounds[1:])) for m in direction.feed(data[a:b], n)]
    return out + list(direction.close())


def test_http_messages_in_any_pieces():
    zipped = zlib.compress(b"deflated " * 50)
    answer = b"HTTP/1.1 200 OK\r\n"
    parts = [
        answer + b"Content-Length: 5\r\n\r\nHello", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n",
        answer + b"Transfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n6;a=b\r\npedia \r\n0\r\nExpires: never\r\n\r\n",
        answer + b"Content-Encoding: deflate\r\nContent-Length: %d\r\n\r\n" % len(zipped) + zipped,
        answer + b"content-encoding: gzip\r\ncontent-length: 3\r\n\r\nbad", answer + b"Content-Length: 90\r\n\r\ncut off",
    ]
    data = b"".join(parts)
    whole = read(data)
    assert [m["body"] for m in whole] == [b"Hello", b"", b"Wikipedia ", b"deflated " * 50, b"bad", b"cut off"]
    assert [m["decompress_ok"] for m in whole] == [None, None, None, True, False, None]
    rng = random.Random(4)
    for _ in range(60):
        cuts = sorted(rng.sample(range(1, len(data)), rng.randint(1, 40)))
        got = read(data, cuts)
        at = 0
        for m, part, want in zip(got, parts, whole, strict=True):
            assert {**m, "frame_index": 0, "spans_frames": 1} == want | {"frame_index": 0, "spans_frames": 1}
            bounds = [0, *cuts, len(data)]
            inside = [n for n, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < at + len(part) and b > at]
            assert (m["frame_index"], m["spans_frames"]) == (inside[0], len(inside))
            at += len(part)


def test_http_messages_without_bounds():
    many = b"HTTP/1.1 204 No Content\r\n\r\n" * 3000
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"1\r\nx\r\n" * 12_000 + b"0\r\n\r\n"
    assert len(read(many)) == 3000 and len(read(many, most_messages=1000)) == 1000
    assert read(chunked)[0]["raw_length"] == 12_000 and read(chunked, most_chunks=10_000)[0]["raw_length"] == 10_000
    assert read(b"\r\n\r\nHTTP/1.1 200 OK\r\n\r\n") == [] and read(b"no head") == []
    broken = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nab\r\nzz\r\n"
    assert read(broken)[0]["body"] == b"ab"


def test_long_heads_and_names(spark):
    get = b"GET / HTTP/1.1\r\nX-Long: " + b"y" * 6000 + b"\r\nHost: late.example\r\n\r\n"
    df = table(spark, [eth(ip4(6, seg(51000, 80, get)))])
    assert frames(df).first()["http_host"] == "late.example"
    cut_off = frames(df, head_limit=4096).first()
    assert cut_off["http_host"] is None and cut_off["http_truncated"]
    # Twenty pointers in a row, then a label.
    hops = b"".join(struct.pack(">H", 0xC000 | (12 + 2 * i + 2)) for i in range(20))
    message = QUERY[:12] + hops + b"\x02ok\0\0\x01\0\x01"
    assert read_name(message, 12) == ("ok", 14)
    with pytest.raises(Overrun):
        read_name(message, 12, most_jumps=16)


def test_key_derivation_vectors():
    prk = bytes.fromhex("077709362c2e32df0ddc3f0dc47bba6390b6c73bb50f9c3122ec844ad7c2b3e5")
    okm = "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    assert keys.hkdf_expand(prk, bytes.fromhex("f0f1f2f3f4f5f6f7f8f9"), 42).hex() == okm
    key = bytes(range(0x80, 0xA0))
    nonce, aad = bytes.fromhex("070000004041424344454647"), bytes.fromhex("50515253c0c1c2c3c4c5c6c7")
    plain = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    sealed = keys.chacha_seal(key, nonce, plain, aad)
    assert sealed[-16:].hex() == "1ae10b594f09e26a7e902ecbd0600691"
    assert keys.chacha_open(key, nonce, sealed, aad) == plain and keys.chacha_open(key, nonce, sealed[:-1] + b"\0", aad) is None


def test_quic_initial_keys(spark):
    df = spark.createDataFrame([(bytearray.fromhex("8394c8f03e515708"),)], "cid binary")
    row = df.select(keys.quic_initial_keys("cid").alias("k")).first()["k"]
    assert bytes(row["client"]["key"]).hex() == "1f369613dd76d5467730efcbe3b1a22d"
    assert bytes(row["client"]["iv"]).hex() == "fa044b2f42a3fd3b46fb255c"
    assert bytes(row["client"]["hp"]).hex() == "9f50449e04a0e810283a1e9933adedd2"


def test_quic_initial_opens(spark):
    df = spark.createDataFrame([(1,)], "x int")
    k = df.select(keys.quic_initial_keys(F.unhex(F.lit("8394c8f03e515708"))).alias("k")).first()["k"]["client"]
    crypto = b"\x06\x00\x05\x01\x00\x00\x00\x00"
    plain = crypto + bytes(30)
    header = bytes.fromhex("c000000001088394c8f03e5157080000") + struct.pack(">H", 0x4000 | (1 + len(plain) + 16)) + b"\x02"
    nonce = bytes(k["iv"])[:11] + bytes([bytes(k["iv"])[11] ^ 2])
    one = spark.createDataFrame([(bytearray(plain), bytearray(k["key"]), bytearray(nonce), bytearray(header), bytearray(k["hp"]))], "p binary, k binary, n binary, a binary, hp binary")
    sealed = bytes(one.select(F.aes_encrypt("p", "k", F.lit("GCM"), F.lit("DEFAULT"), F.col("n"), F.col("a"))).first()[0])[12:]
    sample = bytearray(sealed[3:19])
    mask = bytes(one.withColumn("s", F.lit(bytes(sample))).select(F.aes_encrypt("s", "hp", F.lit("ECB"), F.lit("PKCS"))).first()[0])[:5]
    packet = bytes([header[0] ^ (mask[0] & 15)]) + header[1:-1] + bytes([2 ^ mask[1]]) + sealed
    got = decrypt.decrypt_quic_initials(frames(table(spark, [eth(ip4(17, dgram(5000, 443, packet)))]))).collect()
    assert len(got) == 1 and got[0]["packet_number"] == 2 and bytes(got[0]["plain"]) == plain
    assert [(c["offset"], c["length"], bytes(c["data"])) for c in got[0]["crypto"]] == [(0, 5, crypto[3:])]


def test_tls13_chacha_and_failures(spark):
    secret = bytes(i * 7 % 256 for i in range(32))
    key, iv = keys.expand_label(secret, "key", 32), keys.expand_label(secret, "iv", 12)

    def record(seq, text):
        body = text + b"\x17\0"
        head = b"\x17\x03\x03" + struct.pack(">H", len(body) + 16)
        return head + keys.chacha_seal(key, iv[:4] + (int.from_bytes(iv[4:], "big") ^ seq).to_bytes(8, "big"), body, head)

    server = b"\x02" + (38).to_bytes(3, "big") + b"\x03\x03" + bytes(32) + b"\0" + b"\x13\x03" + b"\0"
    answer = b"\x16\x03\x03" + struct.pack(">H", len(server)) + server
    ends = ("10.0.0.1", "10.0.0.2")
    up = lambda p: eth(ip4(6, seg(5000, 443, p), *ends))
    bad = bytearray(record(1, b"lost"))
    bad[-1] ^= 1
    packets = [up(hello()), eth(ip4(6, seg(443, 5000, answer), *ends[::-1])), up(record(0, b"GET / HTTP/1.1")), up(bytes(bad)), up(record(1, b"second"))]
    log = [(1, "CLIENT_TRAFFIC_SECRET_0"), (2, "SERVER_TRAFFIC_SECRET_0")]
    keylog = spark.createDataFrame([(n, label, bytearray(32), bytearray(secret)) for n, label in log], "line_no long, label string, client_random binary, secret binary")
    df = frames(table(spark, packets))
    got = {r["frame_index"]: (r["status"], r["text"]) for r in decrypt.decrypt_tls(df, keylog).collect()}
    assert got == {3: ("✓ ApplicationData (14B)", "GET / HTTP/1.1"), 4: ("✗ auth failed", None), 5: ("✓ ApplicationData (6B)", "second")}
    none = {r["status"] for r in decrypt.decrypt_tls(df, keylog.limit(0)).collect()}
    assert none == {"✗ no key for this session"}


def test_keylog(spark):
    good = "ab" * 32
    lines = ["# c", "", f"CLIENT_RANDOM {good} 0102", f"CLIENT_RANDOM {good} 0304", "garbage", "a b", f"L {good} zz", f"L {good} 012", f"L {'ab' * 30} 01"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    rows = latest_secrets(parse_keylog(df)).collect()
    assert [(r["label"], bytes(r["secret"]).hex()) for r in rows] == [("CLIENT_RANDOM", "0304")]


def test_keylog_files_in_order(spark, tmp_path):
    random_ = "cd" * 32
    for name, secrets in (("a", range(300)), ("b", range(300, 310))):
        (tmp_path / name).write_text("".join(f"CLIENT_RANDOM {random_} {i:04x}\n" for i in secrets))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert [bytes(r["secret"]).hex() for r in latest_secrets(read_keylog(spark, str(tmp_path / "a"))).collect()] == ["012b"]
        assert [bytes(r["secret"]).hex() for r in latest_secrets(read_keylog(spark, str(tmp_path))).collect()] == ["0135"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("magic", list(MAGICS))
def test_pcap_files(spark, tmp_path, magic):
    order, unit = MAGICS[magic]
    bodies = [bytes([i]) * (20 + i) for i in range(50)]
    content = magic + struct.pack(order + "HHIIII", 2, 4, 0, 0, 65535, 1)
    for i, b in enumerate(bodies):
        content += struct.pack(order + "IIII", 1_700_000_000 + i, 5, len(b), len(b) + 1) + b
    path = tmp_path / "a.pcap"
    path.write_bytes(content + b"\0" * 7)
    rows = read_pcap(spark, str(path), splitBytes="300").orderBy("frame_index").collect()
    assert [bytes(r["data"]) for r in rows] == bodies
    assert [r["frame_index"] for r in rows] == list(range(1, 51))
    assert rows[3]["ts_ns"] == (1_700_000_003) * 10**9 + 5 * unit and rows[3]["orig_len"] == 24
    path.write_bytes(content[:-3])
    assert read_pcap(spark, str(path)).count() == 49
    with pytest.raises(Exception, match="cut off"):
        read_pcap(spark, str(path), mode="FAILFAST").count()


def test_pcap_headers():
    with pytest.raises(CaptureError, match="pcapng"):
        read_header(b"\x0a\x0d\x0d\x0a" + bytes(30))
    with pytest.raises(CaptureError):
        read_header(b"\xd4\xc3\xb2\xa1")


def test_datagrams():
    head = bytes.fromhex("d4c3b2a1020004000000000000000000ffff000065000000")
    body = ip4(17, dgram(1, 2))
    record = struct.pack("<IIII", 7, 8, len(body), len(body)) + body
    state, packet = parse_datagram(head, None)
    assert packet is None and state[:4] == ("<", 1000, 101, 1)
    state, packet = parse_datagram(record, state)
    assert packet == (1, 7_000_008_000, len(body), len(body), 101, body)
    state, packet = parse_datagram(record[:20], state)
    assert packet is None and state[3:] == (2, 1)
    assert parse_datagram(record, None)[1][4] == 101
    assert parse_datagram(struct.pack("<IIII", 7, 8, 14, 14) + b"\xaa" * 14, None)[1][4] == 1


def test_rendering(spark):
    df = spark.createDataFrame([(500, 0), (1536, 5 * 10**8), (3 * 1024**2, 90 * 10**9), (5 * 1024**3, 2 * 3600 * 10**9)], "n long, d long")
    rows = df.select(format_bytes(F.col("n")), format_duration(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [("500B", "—"), ("1.5KB", "500ms"), ("3.0MB", "90s"), ("5.00GB", "2.0h")]
    one = spark.createDataFrame([(bytearray(b"GET /\x00\xffabc"), "The the THE\\E x\\e")], "b binary, t string")
    dump = one.select(hex_dump(F.col("b"))).first()[0]
    assert dump[0]["line"] == "0000  47 45 54 20 2f 00 ff 61  GET /..a" and dump[1]["line"].startswith("0008  62 63")
    assert one.select(occurrences(F.col("t"), "the")).first()[0] == [0, 4, 8]
    assert one.select(occurrences(F.col("t"), "\\E")).first()[0] == [11, 15]


def test_search_keeps_places_and_is_linear(spark):
    texts = ["İxe E", "ẞe", "", None, "eE" * 50_000, "Straße STRASSE strasse", "ΣΑΣ σας"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    got = {r["i"]: r["at"] for r in df.select("i", occurrences(F.col("t"), "E").alias("at")).collect()}
    assert got == {0: [2, 4], 1: [1], 2: [], 3: None, 4: list(range(100_000)), 5: [5, 13, 21], 6: []}
    assert df.where("i = 5").select(occurrences(F.col("t"), "ss")).first()[0] == [11, 19]
    assert df.where("i = 6").select(occurrences(F.col("t"), "σ")).first()[0] == [0, 2, 4]
    assert df.where("i = 0").select(occurrences(F.col("t"), "i")).first()[0] == [0] and df.where("i = 0").select(occurrences(F.col("t"), "")).first()[0] == []
    big = "The quick " * 80_000
    df.limit(1).select(occurrences(F.lit("a"), "a")).first()  # the worker has started
    begun = time.time()
    assert len(df.limit(1).select(occurrences(F.lit(big), "the")).first()[0]) == 80_000
    assert time.time() - begun < 5


def test_gzip_members_and_bounds():
    one, two = gzip.compress(b"first"), gzip.compress(b"second" * 100)
    assert _decoded(one + two, "gzip") == b"first" + b"second" * 100
    assert _decoded(one + b"junk", "gzip") == b"first" and _decoded(one + b"\x1f\x8b\x08junk", "gzip") is None
    assert _decoded(one[:-3], "gzip") is None and _decoded(one + two[:-12], "gzip") is None
    assert _decoded(zlib.compress(b"x") + b"junk", "deflate") == b"x" and _decoded(zlib.compress(b"x" * 99)[:-5], "deflate") is None
    bomb = gzip.compress(bytes(1 << 20))
    assert _decoded(bomb, "gzip", (1 << 20) - 1) is None and _decoded(bomb, "gzip", 1 << 20) == bytes(1 << 20)
    assert _decoded(one + bomb, "gzip", 1 << 20) is None and _decoded(b"", "gzip") is None and _decoded(b"x", "br") is None


def test_a_direction_without_a_head_is_let_go():
    reader = Direction(most_head=1000)
    for i in range(200):
        assert not list(reader.feed(b"\x17" * 100, i))
        assert len(reader.data.held) <= 1100
    late = Direction(most_head=100)
    assert not list(late.feed(b"x" * 101 + b"\r\n\r\n", 1)) and late.done
    kept = Direction(most_head=None)
    assert not list(kept.feed(b"x" * 5000, 1)) and [m["first_line"] for m in kept.feed(b"\r\n\r\n", 2)] == ["x" * 5000]


def test_hex_dump_beyond_four_digits(spark):
    one = spark.createDataFrame([(bytearray(b"a" * 0x10009),)], "b binary")
    dump = one.select(hex_dump(F.col("b"))).first()[0]
    assert [r["line"][:7] for r in (dump[0], dump[0x200], dump[0x1FFF], dump[0x2000], dump[0x2001])] == ["0000  6", "1000  6", "fff8  6", "10000  ", "10008  "]
    assert [r["at"] for r in dump] == list(range(0, 0x10009, 8)) and len({r["line"] for r in dump}) == len(dump)


def test_live_capture_over_a_socket(spark):
    import socket
    import time

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    told = []
    listener = Progress(told.append)
    spark.streams.addListener(listener)
    capture = LiveCapture(spark, port, "127.0.0.1")
    try:
        for n in (40, 3):  # the second start begins anew
            folder = capture.start(lambda p: p.select("frame_index", "top_protocol").writeStream.format("memory").queryName(f"live{n}").start())
            record = lambda body: struct.pack("<IIII", 1, 2, len(body), len(body)) + body
            time.sleep(0.5)
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as sender:
                sender.sendto(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1), ("127.0.0.1", port))
                for _ in range(n):
                    sender.sendto(record(eth(ip4(17, dgram(51000, 53, QUERY)))), ("127.0.0.1", port))
                sender.sendto(b"short", ("127.0.0.1", port))
            end = time.time() + 20
            while sum(pq.read_metadata(f).num_rows for f in Path(folder.removeprefix("file:")).glob("[!.]*.parquet")) < n + 2 and time.time() < end:
                time.sleep(0.1)
            capture.stop()
            rows = spark.table(f"live{n}").collect()
            assert sorted(r["frame_index"] for r in rows) == list(range(1, n + 1)) and {r["top_protocol"] for r in rows} == {"DNS"}
        end = time.time() + 10
        while not told and time.time() < end:
            time.sleep(0.1)
        assert told
    finally:
        capture.stop()
        spark.streams.removeListener(listener)


def test_progress_ticks():
    told = []
    progress = Progress(told.append)
    event = lambda n: type("E", (), {"progress": type("P", (), {"numInputRows": n})})
    for n in (0, 1, 20, 10, 1, 0, 64):
        progress.onQueryProgress(event(n))
    assert told == [1, 32, 96]


def test_pcap_source_and_names(spark, tmp_path):
    content = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 1, 2, 3, 3) + b"abc"
    (tmp_path / "a b.pcap").write_bytes(content)
    (tmp_path / "c.pcap").write_bytes(content)
    assert read_pcap(spark, str(tmp_path)).count() == 2
    spark.dataSource.register(PcapSource)
    rows = spark.read.format("pcap").load(path=str(tmp_path / "*.pcap")).collect()
    assert sorted((r["capture_id"], r["frame_index"], bytes(r["data"])) for r in rows) == [("a b.pcap", 1, b"abc"), ("c.pcap", 1, b"abc")]
    with pytest.raises(Exception, match="more than"):
        read_pcap(spark, str(tmp_path), maxBytes=10).count()
    (tmp_path / "d.pcap").write_bytes(b"\x0a\x0d\x0d\x0a" + bytes(30))
    with pytest.raises(Exception, match="pcapng"):
        read_pcap(spark, str(tmp_path)).count()


def test_null_packets_and_empty_tables(spark):
    rows = [("t", 1, 1, 0, 0, 1, None), ("t", 2, 1, 0, 0, None, bytearray(b"abc")), ("t", 3, 1, 0, 0, 1, bytearray())]
    found = {r["frame_index"]: r for r in frames(spark.createDataFrame(rows, RAW_FRAMES)).collect()}
    assert found[1]["l2_truncated"] and found[3]["l2_truncated"] and found[2]["top_protocol"] == "Raw"
    assert frames(spark.createDataFrame([], RAW_FRAMES)).count() == 0
