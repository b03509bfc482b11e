"""Key derivation for TLS and QUIC, and ChaCha20-Poly1305, which Spark lacks. Derivation
runs on session tables, once per direction, not per packet."""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cipher suites with key length, IV length and hash.
TLS13_SUITES = {0x1301: (16, 12, "sha256"), 0x1302: (32, 12, "sha384"), 0x1303: (32, 12, "sha256")}
TLS12_SUITES = (
    dict.fromkeys((0xC02F, 0xC02B, 0x009C), (16, 4, "sha256"))
    | dict.fromkeys((0xC030, 0xC02C, 0x009D), (32, 4, "sha384"))
    | dict.fromkeys((0xCCA8, 0xCCA9, 0xCCAA), (32, 12, "sha256"))
)
CHACHA_SUITES = (0x1303, 0xCCA8, 0xCCA9, 0xCCAA)
#: RFC 9001 section 5.2.
QUIC_V1_SALT = bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a")


def hkdf_expand(secret: bytes, info: bytes, length: int, algorithm: str = "sha256") -> bytes:
    """RFC 5869 section 2.3."""
    out, block, i = b"", b"", 1
    while len(out) < length:
        block = hmac.new(secret, block + info + bytes([i]), algorithm).digest()
        out, i = out + block, i + 1
    return out[:length]


def expand_label(secret: bytes, label: str, length: int, algorithm: str = "sha256", context: bytes = b"") -> bytes:
    """RFC 8446 section 7.1."""
    name = b"tls13 " + label.encode()
    return hkdf_expand(secret, struct.pack(">HB", length, len(name)) + name + bytes([len(context)]) + context, length, algorithm)


def tls12_prf(secret: bytes, label: bytes, seed: bytes, length: int, algorithm: str) -> bytes:
    """RFC 5246 section 5."""
    seed, out = label + seed, b""
    a = seed
    while len(out) < length:
        a = hmac.new(secret, a, algorithm).digest()
        out += hmac.new(secret, a + seed, algorithm).digest()
    return out[:length]


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_KEYS = _struct(key=T.BinaryType(), iv=T.BinaryType())


@F.pandas_udf(_KEYS)
def tls13_keys(secrets: pd.Series, suites: pd.Series) -> pd.DataFrame:
    """Key and IV of a traffic secret; null where its length does not fit the suite."""
    rows = []
    for secret, suite in zip(secrets, suites):
        kind = TLS13_SUITES.get(suite)
        if secret is None or kind is None or len(secret) != hashlib.new(kind[2]).digest_size:
            rows.append((None, None))
        else:
            rows.append((expand_label(secret, "key", kind[0], kind[2]), expand_label(secret, "iv", kind[1], kind[2])))
    return pd.DataFrame(rows, columns=["key", "iv"])


@F.pandas_udf(_struct(client=_KEYS, server=_KEYS))
def tls12_keys(masters: pd.Series, clients: pd.Series, servers: pd.Series, suites: pd.Series) -> pd.DataFrame:
    """Both directions' key and IV, cut from the key block."""
    rows = []
    for master, client, server, suite in zip(masters, clients, servers, suites):
        kind = TLS12_SUITES.get(suite)
        if kind is None or any(x is None for x in (master, client, server)) or len(master) != 48:
            rows.append(({"key": None, "iv": None},) * 2)
            continue
        k, v, algorithm = kind
        block = tls12_prf(master, b"key expansion", server + client, 2 * (k + v), algorithm)
        keys, ivs = (block[:k], block[k : 2 * k]), (block[2 * k : 2 * k + v], block[2 * k + v :])
        rows.append(tuple({"key": a, "iv": b} for a, b in zip(keys, ivs)))
    return pd.DataFrame(rows, columns=["client", "server"])


_QUIC = _struct(key=T.BinaryType(), iv=T.BinaryType(), hp=T.BinaryType())


@F.pandas_udf(_struct(client=_QUIC, server=_QUIC))
def quic_initial_keys(ids: pd.Series) -> pd.DataFrame:
    """The Initial keys of both directions from a connection id (RFC 9001)."""
    rows = []
    for cid in ids:
        initial = hmac.new(QUIC_V1_SALT, cid or b"", "sha256").digest()
        sides = (expand_label(initial, f"{side} in", 32) for side in ("client", "server"))
        rows.append(
            tuple({n: expand_label(s, f"quic {n}", size) for n, size in (("key", 16), ("iv", 12), ("hp", 16))} for s in sides)
        )
    return pd.DataFrame(rows, columns=["client", "server"])


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def _chacha_blocks(key: np.ndarray, counter: np.ndarray, nonce: np.ndarray) -> np.ndarray:
    """Blocks of 64 bytes (RFC 8439 section 2.3) for rows of eight key words, a counter and three nonce words, side by
    side; a row of the four-by-four state is one array, and diagonals are columns of turned rows."""
    first = np.repeat(np.array([[0x61707865], [0x3320646E], [0x79622D32], [0x6B206574]], np.uint32), len(counter), axis=1)
    begin = (first, key[:, :4].T, key[:, 4:].T, np.vstack([counter[None], nonce.T]))
    a, b, c, d = (x.astype(np.uint32) for x in begin)
    for turn in (1, -1) * 10:
        for r, s in ((16, 12), (8, 7)):
            a += b
            d = _rotated(d ^ a, r)
            c += d
            b = _rotated(b ^ c, s)
        b, c, d = (np.roll(x, -turn * i, axis=0) for i, x in enumerate((b, c, d), 1))
    words = np.vstack([x + y for x, y in zip((a, b, c, d), begin)])
    return np.ascontiguousarray(words.T.astype("<u4")).view(np.uint8)


#: Blocks that are made at once: their state stays in a processor's cache.
BLOCKS = 4096


def _chacha_streams(rows: list[tuple[bytes, bytes, int]]) -> Iterator[bytes]:
    """For each key, nonce and number of bytes: the block with counter zero, and those for the bytes."""
    keys, nonces = (np.frombuffer(b"".join(row[i] for row in rows), "<u4").reshape(len(rows), -1) for i in (0, 1))
    counts = np.array([1 + (size + 63) // 64 for _, _, size in rows])
    of = np.repeat(np.arange(len(rows)), counts)
    counter = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts = [_chacha_blocks(keys[x], counter[i : i + BLOCKS], nonces[x]) for i in range(0, len(of), BLOCKS) for x in [of[i : i + BLOCKS]]]
    held, at = memoryview(np.concatenate(parts)).cast("B"), 0
    for n in counts.tolist():
        yield bytes(held[at : at + 64 * n])
        at += 64 * n


def _grouped(rows: list[tuple], size: Callable[[tuple], int]) -> Iterator[tuple[tuple, bytes]]:
    """Rows that begin with key and nonce, each with its stream; streams of about ``BLOCKS`` blocks are held at once."""
    group, blocks = [], 0
    for i, row in enumerate(rows, 1):
        group.append(row)
        blocks += 2 + size(row) // 64
        if blocks >= BLOCKS or i == len(rows):
            yield from zip(group, _chacha_streams([(*x[:2], size(x)) for x in group]))
            group, blocks = [], 0


def _poly1305(key: bytes, data: bytes) -> bytes:
    r = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF
    total = 0
    for i in range(0, len(data), 16):
        total = (total + int.from_bytes(data[i : i + 16] + b"\1", "little")) * r % ((1 << 130) - 5)
    return ((total + int.from_bytes(key[16:], "little")) & ((1 << 128) - 1)).to_bytes(16, "little")


def _xor(data: bytes, stream: bytes) -> bytes:
    n = len(data)
    return (int.from_bytes(data, "big") ^ int.from_bytes(stream[:n], "big")).to_bytes(n, "big")


def _chacha_tag(key: bytes, sealed: bytes, aad: bytes) -> bytes:
    def padded(x: bytes) -> bytes:
        return x + bytes(-len(x) % 16)

    return _poly1305(key, padded(aad) + padded(sealed) + struct.pack("<QQ", len(aad), len(sealed)))


def chacha_open_all(rows: list[tuple[bytes, bytes, bytes, bytes]]) -> list[bytes | None]:
    """RFC 8439 section 2.8, for rows of key, nonce, sealed bytes and additional data together; null where the tag
    does not fit."""
    out = []
    for (_, _, sealed, aad), stream in _grouped(rows, lambda row: max(len(row[2]) - 16, 0)):
        fits = len(sealed) >= 16 and hmac.compare_digest(_chacha_tag(stream[:32], sealed[:-16], aad), sealed[-16:])
        out.append(_xor(sealed[:-16], stream[64:]) if fits else None)
    return out


def chacha_seal_all(rows: list[tuple[bytes, bytes, bytes, bytes]]) -> list[bytes]:
    """The reverse, of plain bytes."""
    out = []
    for (_, _, plain, aad), stream in _grouped(rows, lambda row: len(row[2])):
        body = _xor(plain, stream[64:])
        out.append(body + _chacha_tag(stream[:32], body, aad))
    return out


def chacha_open(key: bytes, nonce: bytes, sealed: bytes, aad: bytes) -> bytes | None:
    return chacha_open_all([(key, nonce, sealed, aad)])[0]


def chacha_seal(key: bytes, nonce: bytes, plain: bytes, aad: bytes) -> bytes:
    return chacha_seal_all([(key, nonce, plain, aad)])[0]
