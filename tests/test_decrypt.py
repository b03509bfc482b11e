"""Record numbers guessed in parallel against a plain walk; handshakes one after the other."""

import random
import struct

import pytest
from test_packets import eth, hello, ip4, seg, table

from netloom.operators import decrypt, keys
from netloom.operators.dissect import frames

ENDS = ("10.0.0.1", "10.0.0.2")


def secret(n, side):
    return bytes((i * 7 + n * 3 + side) % 256 for i in range(32))


def sealed(n, side, seq, text):
    own = secret(n, side)
    key, iv = keys.expand_label(own, "key", 32), keys.expand_label(own, "iv", 12)
    body = text + b"\x17"
    head = b"\x17\x03\x03" + struct.pack(">H", len(body) + 16)
    return head + keys.chacha_seal(key, iv[:4] + (int.from_bytes(iv[4:], "big") ^ seq).to_bytes(8, "big"), body, head)


def answer():
    server = b"\x02" + (38).to_bytes(3, "big") + b"\x03\x03" + bytes(32) + b"\0" + b"\x13\x03" + b"\0"
    return b"\x16\x03\x03" + struct.pack(">H", len(server)) + server


def greeting(n):
    """A ClientHello whose random tells the handshake."""
    data = bytearray(hello())
    at = data.index(b"\x03\x03", 6) + 2
    data[at : at + 32] = bytes([n]) * 32
    return bytes(data)


def packet(side, payload):
    return eth(ip4(6, seg(5000, 443, payload) if side == 0 else seg(443, 5000, payload), *(ENDS if side == 0 else ENDS[::-1])))


def capture(seed, sessions, most):
    """Packets, and for each of application data its handshake, side, number and whether it is intact."""
    rng, packets, said = random.Random(seed), [], []
    for n in range(sessions):
        for payload, side in ((greeting(n), 0), (answer(), 1)):
            packets.append(packet(side, payload))
            said.append(None)
        seq, sent = [0, 0], []
        for _ in range(most):
            side = rng.randint(0, 1)
            what = rng.choices(["good", "copy", "damaged", "lost", "short"], [14, 3, 2, 0.4, 1])[0]
            if what == "copy" and sent:
                side, number, data, fine = rng.choice(sent)
            else:
                number, fine = seq[side], what in ("good", "lost")
                data = sealed(n, side, number, f"{n} {side} {number}".encode())
                if what == "damaged":  # the good one follows under the same number
                    data = data[:-1] + bytes([data[-1] ^ 1])
                elif what == "short":
                    data = b"\x17\x03\x03\x00\x10" + bytes(16)
                else:
                    seq[side] += 1
                if what == "lost":
                    continue
                if what != "short":
                    sent.append((side, number, data, fine))
            packets.append(packet(side, data))
            said.append((n, side, number, fine, what, f"{n} {side} {number}"))
            if what == "short":
                said[-1] = "short"
    return packets, said


def walked(said):
    """Each record under the number of those opened before it."""
    out, opened = {}, {}
    for i, x in enumerate(said, 1):
        if x is None or x == "short":
            continue
        n, side, number, fine, _, text = x
        ok = fine and number == opened.get((n, side), 0)
        opened[n, side] = opened.get((n, side), 0) + ok
        out[i] = (f"✓ ApplicationData ({len(text)}B)", text) if ok else ("✗ auth failed", None)
    return out


@pytest.mark.parametrize(("seed", "sessions", "most", "block"), [(1, 1, 60, 8), (2, 3, 40, 1 << 16), (3, 2, 50, 5), (4, 1, 3, 1)])
def test_numbers_against_a_walk(spark, monkeypatch, seed, sessions, most, block):
    monkeypatch.setattr(decrypt, "BLOCK", block)
    packets, said = capture(seed, sessions, most)
    log = [(2 * n + side, label, bytearray([n]) * 32, bytearray(secret(n, side))) for n in range(sessions) for side, label in enumerate(("CLIENT_TRAFFIC_SECRET_0", "SERVER_TRAFFIC_SECRET_0"))]
    keylog = spark.createDataFrame(log, "line_no long, label string, client_random binary, secret binary")
    got = {r["frame_index"]: (r["status"], r["text"]) for r in decrypt.decrypt_tls(frames(table(spark, packets)), keylog).collect()}
    want = walked(said)
    assert got == want and (most < 10 or len({x for x, _ in want.values()}) > 1)


def test_nothing_to_open(spark):
    empty = spark.createDataFrame([], "line_no long, label string, client_random binary, secret binary")
    assert decrypt.decrypt_tls(frames(table(spark, [packet(0, b"plain")])), empty).collect() == []
    got = decrypt.decrypt_tls(frames(table(spark, [packet(0, sealed(0, 0, 0, b"before any hello")), packet(0, greeting(1)), packet(0, sealed(1, 0, 0, b"no answer"))])), empty)
    assert got.collect() == []


def test_records_before_the_second_hello_are_kept(spark):
    packets, said = capture(7, 2, 4)
    keylog = spark.createDataFrame([(1, "CLIENT_TRAFFIC_SECRET_0", bytearray([1]) * 32, bytearray(secret(1, 0))), (2, "SERVER_TRAFFIC_SECRET_0", bytearray([1]) * 32, bytearray(secret(1, 1)))], "line_no long, label string, client_random binary, secret binary")
    got = {r["frame_index"]: r["status"] for r in decrypt.decrypt_tls(frames(table(spark, packets)), keylog).collect()}
    first = {i for i, x in enumerate(said, 1) if isinstance(x, tuple) and x[0] == 0}
    assert {got[i] for i in first} == {"✗ no key for this session"}
    assert any(s.startswith("✓") for i, s in got.items() if i not in first)
