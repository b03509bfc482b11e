"""TLS records and QUIC Initial packets opened with supplied or derived keys.

Secrets are columns of session tables; nothing here caches, checkpoints or logs them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import constants as C
from ..functions.bytes import cut, hex_lower, hex_number, mostly_text, unsigned, utf8_text
from ..shared import written
from . import keys
from .tcp import tcp_packets

SESSION = ["capture_id", "session"]
DIRECTION = [*SESSION, "epoch", "src"]
#: Consecutive packet numbers that are counted together; longer sessions are several blocks.
BLOCK = 1 << 16
_SECRETS = {"CLIENT_TRAFFIC_SECRET_0": "client_secret", "SERVER_TRAFFIC_SECRET_0": "server_secret", "CLIENT_RANDOM": "master"}


def tls_records(frames: DataFrame) -> DataFrame:
    """What decryption needs of a capture: hellos, and application data as ``record`` with
    ``size`` and ``mark`` (a hash). Written to the shared folder, so that a capture is dissected once
    however often these rows are read, and counting reads only their narrow columns."""
    rows = tcp_packets(frames.where(F.col("l7") == C.TLS)).where("tls_handshake IN (1, 2) OR tls_type = 23")
    end = F.least(5 + F.col("tls_length"), F.octet_length("payload"))
    record = F.when(F.col("tls_type") == 23, cut(F.col("payload"), 0, end))
    rows = rows.select(
        *SESSION, "frame_index", "src", F.col("tls_handshake").alias("hello"), F.col("tls_random").alias("random"), F.col("tls_cipher").alias("cipher"),
        record.alias("record"),
    )
    return written(rows.withColumns({"size": F.octet_length("record"), "mark": F.xxhash64("record")}), "tls-records")


def _before(sums: DataFrame, by: list[str], *names: str) -> DataFrame:
    """Of sums per block, what the blocks before it hold, for each of ``names``."""
    window = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(window), F.lit(0)) for n in names}).drop(*names)


def tls_epochs(records: DataFrame) -> DataFrame:
    """The rows (without the records) behind a ClientHello, with ``epoch``, the number of
    ClientHellos of their session so far, and ``fresh``: whether no equal record came
    before in the epoch's direction. One port pair may carry any number of handshakes.

    Hellos are counted inside blocks of packet numbers, and the blocks' sums added up: no window holds a whole
    session."""
    rows = records.drop("record").withColumn("block", F.expr(f"frame_index div {BLOCK}"))
    own = F.coalesce((F.col("hello") == 1).cast("long"), F.lit(0))
    starts = _before(rows.groupBy(*SESSION, "block").agg(F.sum(own).alias("hellos")), SESSION, "hellos")
    inside = Window.partitionBy(*SESSION, "block").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("epoch", F.sum(own).over(inside)).join(starts, [*SESSION, "block"])
    rows = rows.withColumn("epoch", F.col("epoch") + F.col("hellos_before")).where("epoch > 0").drop("hellos_before")
    copies = Window.partitionBy(*DIRECTION, "mark", "size").orderBy("frame_index")
    return written(rows.withColumn("fresh", F.row_number().over(copies) == 1), "tls-epochs")


def tls_sessions(epochs: DataFrame, keylog: DataFrame) -> DataFrame:
    """Each handshake's client, randoms, cipher suite, keys of both directions and, where
    it cannot be opened, why."""

    def last(value: Column, kind: int) -> Column:
        return F.max_by(value, F.when(F.col("hello") == kind, F.col("frame_index")))

    found = epochs.where("hello IS NOT NULL").groupBy(*SESSION, "epoch").agg(
        last(F.col("src"), 1).alias("client"),
        F.unhex(last(F.col("random"), 1)).alias("client_random"),
        F.unhex(last(F.col("random"), 2)).alias("server_random"),
        last(F.col("cipher"), 2).alias("cipher"),
    )
    # One row per random; a session without keys joins to nothing.
    secrets = keylog.groupBy("client_random").agg(
        *[F.max_by("secret", F.when(F.col("label") == label, F.col("line_no"))).alias(name) for label, name in _SECRETS.items()],
        F.lit(True).alias("known"),
    )
    rows = found.join(secrets, "client_random", "left")
    cipher = F.col("cipher")
    is13, is12 = cipher.isin(*keys.TLS13_SUITES), cipher.isin(*keys.TLS12_SUITES)
    status = (
        F.when(cipher.isNull() | F.col("client_random").isNull(), None)
        .when(~is13 & ~is12, F.concat(F.lit("unsupported cipher "), hex_number(cipher, 4)))
        .when(is12 & F.col("server_random").isNull(), "missing server_random")
        .when(F.col("known").isNull(), "no key for this session")
        .when(is13 & (F.col("client_secret").isNull() | F.col("server_secret").isNull()), "key log lacks a traffic secret")
        .when(is12 & F.col("master").isNull(), "key log lacks CLIENT_RANDOM")
    )
    rows = rows.withColumn("status", status)
    rows = rows.select(
        *SESSION, "epoch", "client", "cipher", "status", is13.alias("tls13"),
        keys.tls13_keys("client_secret", "cipher").alias("c13"),
        keys.tls13_keys("server_secret", "cipher").alias("s13"),
        keys.tls12_keys("master", "client_random", "server_random", "cipher").alias("k12"),
    )
    side = {
        "client": F.when(F.col("tls13"), F.col("c13")).otherwise(F.col("k12")["client"]),
        "server": F.when(F.col("tls13"), F.col("s13")).otherwise(F.col("k12")["server"]),
    }
    return rows.select(
        *SESSION, "epoch", "client", "cipher", "tls13",
        *[side[s][p].alias(f"{s}_{p}") for s in side for p in ("key", "iv")],
        F.when(F.col("status").isNull() & F.col("cipher").isNotNull() & side["client"]["key"].isNull(), "secret of a wrong length")
        .otherwise(F.col("status")).alias("status"),
    )


def _number(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def number_in_iv(iv: Column, value: Column) -> Column:
    """The IV with its last eight bytes combined with a number."""
    low = unsigned(iv, 8, 4).bitwiseXOR(value.bitwiseAND(F.lit(0xFFFFFFFF)))
    high = unsigned(iv, 4, 4).bitwiseXOR(F.shiftrightunsigned(value, 32))
    return F.concat(cut(iv, 0, 4), F.unhex(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0"))))


def _opened(record: Column, key: Column, iv: Column, tls13: Column, seq: Column) -> Column:
    """One AES-GCM record; null where authentication fails."""
    body = F.substr(record, F.lit(6))
    nonce12 = F.concat(iv, cut(body, 0, 8))
    size12 = F.lpad(F.hex(F.octet_length(body) - 24), 4, "0")
    aad12 = F.concat(F.unhex(_number(seq)), cut(record, 0, 3), F.unhex(size12))
    sealed = F.when(tls13, F.concat(number_in_iv(iv, seq), body)).otherwise(F.concat(nonce12, F.substr(body, F.lit(9))))
    aad = F.when(tls13, cut(record, 0, 5)).otherwise(aad12)
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


@F.pandas_udf(T.BinaryType())
def _chacha(record: pd.Series, key: pd.Series, iv: pd.Series, tls13: pd.Series, seq: pd.Series) -> pd.Series:
    """ChaCha20 records, which Spark's functions cannot open; null in, null out."""

    def sealed(record: bytes, key: bytes, iv: bytes, tls13: bool, seq: int) -> tuple[bytes, bytes, bytes, bytes]:
        body = record[5:]
        nonce = iv[:4] + (int.from_bytes(iv[4:], "big") ^ seq).to_bytes(8, "big")
        aad = record[:5] if tls13 else seq.to_bytes(8, "big") + record[:3] + (len(body) - 16).to_bytes(2, "big", signed=True)
        return key, nonce, body, aad

    there = record.notna().to_numpy()
    found = pd.Series([None] * len(record), dtype=object)
    found[there] = keys.chacha_open_all([sealed(*row) for row in zip(record[there], key[there], iv[there], tls13[there], seq[there])])
    return found


def _tried(seq: Column) -> Column:
    """A row's record opened under a number; null where authentication fails."""
    record, key, iv, tls13 = map(F.col, ("record", "key", "iv", "tls13"))
    chacha = F.col("cipher").isin(*keys.CHACHA_SUITES)
    slow = _chacha(F.when(chacha, record), key, iv, tls13, seq)
    return F.when(chacha, slow).otherwise(_opened(record, key, iv, tls13, seq))


def tls_numbers(epochs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Application data of ``sessions``: ``place`` in its direction, and
    ``number``, how many records before it are fresh, each among the records that are long enough to be whole
    (``whole``); with the direction's key and IV. Counted by blocks like ``tls_epochs``."""
    rows = epochs.where("size IS NOT NULL")
    # A record's least size depends on the version, which is known only beside the sums.
    tests = {f"{name}{least}": (F.col("size") >= least) & more for least in (22, 30) for name, more in (("place", F.lit(True)), ("number", F.col("fresh")))}
    counts = {n: t.cast("long") for n, t in tests.items()}
    by = [*DIRECTION, "block"]
    sums = _before(rows.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in counts.items()]), DIRECTION, *tests).join(sessions, [*SESSION, "epoch"])
    inside = Window.partitionBy(*by).orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in counts.items()}).drop("cipher", "hello", "random")
    rows = rows.join(sums, by)

    def chosen(name: str) -> Column:
        return F.when(F.col("tls13"), F.col(f"{name}22") + F.col(f"{name}22_before")).otherwise(F.col(f"{name}30") + F.col(f"{name}30_before")).alias(name)

    ours = F.col("src") == F.col("client")
    return rows.select(
        *DIRECTION, "frame_index", "fresh", "cipher", "tls13", chosen("place"), chosen("number"),
        (F.col("size") >= F.when(F.col("tls13"), 22).otherwise(30)).alias("whole"),
        F.when(ours, F.col("client_key")).otherwise(F.col("server_key")).alias("key"),
        F.when(ours, F.col("client_iv")).otherwise(F.col("server_iv")).alias("iv"),
    )


def decrypt_tls(frames: DataFrame, keylog: DataFrame) -> DataFrame:
    """A row per application-data packet of a session with a known cipher: ``status``,
    ``content_type``, ``plain`` and ``text`` (where mostly printable). ``keylog`` is parsed
    entries. Each ClientHello of a port pair begins a session of its own.

    A record's number counts the records opened before it in its direction. That is guessed:
    each fresh record opens, each copy of an earlier one does not. All records are opened in
    parallel under their guessed numbers; a direction is right up to its first surprise, and only
    what follows there is tried again, under two guesses (as before from the surprise on, and that nothing opens
    any more), until none is left. A gap in the capture costs one more round, a run of records that fail
    and then open again two; no direction is gathered anywhere.

    Not lazy: the dissector's TLS rows and the opened records are written to the shared folder, keys are not.
    """
    records = tls_records(frames)
    epochs = tls_epochs(records)
    sessions = tls_sessions(epochs, keylog).where("cipher IS NOT NULL")
    shut = sessions.where("status IS NOT NULL").select(*SESSION, "epoch", "tls13", "status")
    closed = epochs.where("size IS NOT NULL").join(shut, [*SESSION, "epoch"])
    closed = closed.select("capture_id", "frame_index", "tls13", F.lit(None).cast("binary").alias("plain"), "status")
    numbers = tls_numbers(epochs, sessions.where("status IS NULL"))
    rows = numbers.where("whole").drop("whole").join(records.select("capture_id", "frame_index", "record"), ["capture_id", "frame_index"])
    kept = [*DIRECTION, "frame_index", "tls13", "place", "number", "fresh"]
    first = written(rows.select(*kept, _tried(F.col("number")).alias("plain")), "tls-opened")
    opened, state = _settled(first)
    results = [opened]
    while not state.isEmpty():
        again = rows.join(state, DIRECTION).where("place >= start")
        guess = F.col("seq") + F.col("number") - F.col("base")
        tried = written(again.select(*kept, "start", "seq", "base", _tried(guess).alias("go"), _tried(F.col("seq")).alias("halt")), "tls-opened")
        opened, state = _resettled(tried)
        results.append(opened)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return _described(found.withColumn("status", F.lit(None).cast("string")).unionByName(closed))


_OPENED = ["capture_id", "frame_index", "tls13", "plain"]


def _surprise(plain: str) -> Column:
    """The first place at which a record does otherwise than guessed, with what comes behind."""
    number, opens = F.col("number") + F.col("fresh").cast("long"), F.col(plain).isNotNull()
    return F.min(F.when(opens != F.col("fresh"), F.struct("place", "number", number.alias("after"), opens.alias("opens"))))


def _settled(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the first round decides, and of directions with a surprise where to go on: place
    ``start``, number ``seq``, and the guessed number there (``base``)."""
    found = first.groupBy(*DIRECTION).agg(_surprise("plain").alias("x")).where("x IS NOT NULL")
    state = written(found.select(*DIRECTION, (F.col("x.place") + 1).alias("start"), (F.col("x.number") + F.col("x.opens").cast("long")).alias("seq"), F.col("x.after").alias("base")), "tls-state")
    if state.isEmpty():
        return first.select(*_OPENED), state
    done = first.join(state, DIRECTION, "left").where("start IS NULL OR place < start")
    return done.select(*_OPENED), state


def _resettled(tried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of a further round, by the guess that holds longer."""
    number, opens = F.col("number") + F.col("fresh").cast("long"), F.col("halt").isNotNull()
    halts = F.min(F.when(opens, F.struct("place", number.alias("after"))))
    own = [F.first(c).alias(c) for c in ("seq", "base")]
    found = tried.groupBy(*DIRECTION).agg(_surprise("go").alias("go_at"), halts.alias("halt_at"), *own)
    go = F.expr("go_at IS NULL OR (halt_at IS NOT NULL AND go_at.place >= halt_at.place)")
    ahead = F.col("seq") + F.col("go_at.number") - F.col("base") + F.col("go_at.opens").cast("long")
    found = found.select(
        *DIRECTION, go.alias("goes"), F.when(go, F.col("go_at.place")).otherwise(F.col("halt_at.place")).alias("last"),
        F.when(go, ahead).otherwise(F.col("seq") + 1).alias("seq"), F.when(go, F.col("go_at.after")).otherwise(F.col("halt_at.after")).alias("base"),
    )
    verdict = written(found, "tls-state")
    done = tried.drop("seq", "base").join(verdict.select(*DIRECTION, "goes", "last"), DIRECTION).where("last IS NULL OR place <= last")
    state = verdict.where("last IS NOT NULL").select(*DIRECTION, (F.col("last") + 1).alias("start"), "seq", "base")
    return done.withColumn("plain", F.when(F.col("goes"), F.col("go")).otherwise(F.col("halt"))).select(*_OPENED), state


def _described(rows: DataFrame) -> DataFrame:
    """Inner content type and data of TLS 1.3: trailing zeros go, then the last byte is
    the type."""
    inner = F.regexp_replace(hex_lower(F.col("plain")), "(00)+$", "")
    # An odd cut cannot happen: zeros are removed in pairs from an even length.
    trimmed = F.when(F.length(inner) % 2 == 1, F.concat(inner, F.lit("0"))).otherwise(inner)
    rows = rows.withColumn("inner", F.when(F.col("tls13"), F.unhex(trimmed)))
    size = F.octet_length("inner")
    data = F.when(F.col("tls13"), cut(F.col("inner"), 0, size - 1)).otherwise(F.col("plain"))
    kind = F.when(F.col("tls13"), unsigned(F.col("inner"), size - 1, 1)).otherwise(F.lit(23))
    name = F.when(kind == 23, "ApplicationData").when(kind == 22, "Handshake").when(kind == 21, "Alert").otherwise(F.concat(F.lit("Type"), kind.cast("string")))
    rows = rows.select("capture_id", "frame_index", "status", "plain", "tls13", size.alias("size"), data.alias("data"), kind.cast("int").alias("content_type"), name.alias("name"))
    status = (
        F.when(F.col("status").isNotNull(), F.concat(F.lit("✗ "), "status"))
        .when(F.col("plain").isNull(), "✗ auth failed")
        .when(F.col("tls13") & (F.col("size") == 0), "✓ but empty plaintext")
        .otherwise(F.concat(F.lit("✓ "), "name", F.lit(" ("), F.octet_length("data").cast("string"), F.lit("B)")))
    )
    text = F.when((F.octet_length("data") > 0) & mostly_text(F.col("data")), utf8_text(F.col("data")))
    return rows.select("capture_id", "frame_index", status.alias("status"), "content_type", F.col("data").alias("plain"), text.alias("text"))


def quic_initials(frames: DataFrame) -> DataFrame:
    """QUIC v1 Initial packets that are whole: session, sender, connection id, the
    packet's bytes and where its number begins."""
    src = F.concat_ws(":", "src_ip", F.col("src_port").cast("string"))
    dst = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    rows = frames.where((F.col("l7") == C.QUIC) & (F.col("quic_type") == 0) & (F.col("quic_version") == 1))
    rows = rows.select(
        "capture_id", "frame_index", src.alias("src"), F.concat_ws("|", F.least(src, dst), F.greatest(src, dst)).alias("session"), "payload",
        "quic_dcid", F.col("quic_length").alias("length"), F.col("quic_body_at").alias("pn_at"),
    )
    return rows.where("pn_at + length <= octet_length(payload) and length >= 20").withColumn("packet", cut(F.col("payload"), 0, (F.col("pn_at") + F.col("length")).cast("int")))


_CRYPTO = T.ArrayType(
    T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("data", T.BinaryType())])
)


@F.pandas_udf(_CRYPTO)
def crypto_frames(plain: pd.Series) -> pd.Series:
    """CRYPTO frames of an Initial's plaintext; padding and pings are skipped, anything
    else ends the walk."""

    def number(b: bytes, at: int) -> tuple[int, int]:
        size = 1 << (b[at] >> 6)
        if at + size > len(b):
            raise IndexError
        return int.from_bytes(b[at : at + size], "big") & ((1 << (8 * size - 2)) - 1), at + size

    def walk(b: bytes | None) -> list[dict]:
        out, at = [], 0
        try:
            while b and at < len(b):
                if b[at] in (0, 1):
                    at += 1
                    continue
                if b[at] != 6:
                    break
                offset, to = number(b, at + 1)
                length, to = number(b, to)
                if to + length > len(b):
                    break
                out.append({"offset": offset, "length": length, "data": b[to : to + length]})
                at = to + length
        except IndexError:
            pass
        return out

    return plain.map(walk)


def decrypt_quic_initials(frames: DataFrame) -> DataFrame:
    """A row per Initial that opens: ``packet_number``, ``plain`` and its ``crypto`` frames.
    Keys come from the connection id of the session's first Initial, whose sender is
    the client; packets are independent of each other."""
    rows = quic_initials(frames)
    first = F.min(F.struct("frame_index", "src", "quic_dcid"))
    sessions = rows.groupBy("capture_id", "session").agg(first.alias("one"))
    sessions = sessions.select(
        "capture_id", "session", F.col("one.src").alias("client"), keys.quic_initial_keys(F.unhex("one.quic_dcid")).alias("k")
    )
    rows = rows.join(sessions, ["capture_id", "session"]).withColumn(
        "k", F.when(F.col("src") == F.col("client"), F.col("k.client")).otherwise(F.col("k.server"))
    )
    packet, at = F.col("packet"), F.col("pn_at")
    mask = F.substring(F.aes_encrypt(cut(packet, at + 4, 16), F.col("k.hp"), F.lit("ECB"), F.lit("PKCS")), 1, 5)
    rows = rows.withColumn("mask", mask)
    first_byte = unsigned(packet, 0, 1).bitwiseXOR(unsigned(F.col("mask"), 0, 1).bitwiseAND(F.lit(15)))
    rows = rows.withColumns({"b0": first_byte, "pn_size": (first_byte.bitwiseAND(F.lit(3)) + 1).cast("int")})
    shift = 8 * (4 - F.col("pn_size"))
    whole = unsigned(packet, at, 4).bitwiseXOR(unsigned(F.col("mask"), 1, 4))
    rows = rows.withColumn("packet_number", F.call_function("shiftright", whole, shift.cast("int")))
    header = F.concat(
        F.unhex(F.lpad(F.hex("b0"), 2, "0")), cut(packet, 1, at - 1), F.unhex(F.expr("right(lpad(hex(packet_number), 8, '0'), 2 * pn_size)"))
    )
    rows = rows.withColumn("header", header)
    sealed = F.concat(number_in_iv(F.col("k.iv"), F.col("packet_number")), F.substr(packet, at + F.col("pn_size") + 1))
    plain = F.try_aes_decrypt(sealed, F.col("k.key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("header"))
    opened = rows.withColumn("plain", plain).where("plain is not null")
    return opened.select("capture_id", "frame_index", "packet_number", "plain", crypto_frames("plain").alias("crypto"))
