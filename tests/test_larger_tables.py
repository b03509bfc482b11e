"""Queries over ids, texts and numbers of rows as larger tables have them, against their SQL."""

import os
import random
import struct

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from netloom.operators import keys
from netloom.plans.registry import QUERIES
from netloom.sources.pcap import MAGICS
from netloom.streaming import blocks, live
from netloom.streaming.ordered import InOrder


def checked(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables made of columns."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    query, sql = QUERIES[name]
    found = query(spark, str(folder))
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    return sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr), sorted(result.fetchall(), key=repr)


def views(users, each=3):
    """View events, ``each`` of every user in turn."""
    n = len(users) * each
    return {"event_id": pa.array(range(n), pa.int64()), "user_id": pa.array(users * each, pa.int64()), "event_type": ["view"] * n}


#: Users that share an address and a port where 16 bits hold the port, whose port would be one of HTTP, and
#: whose hellos would be numbered like data.
USERS = [0, 45_616, 65_536, 53_616, 131_072, 5_000_000, 5_000_001, 10_000_000]


@pytest.mark.parametrize("name", ["tls12_decrypt", "tls12_suites", "tls13_decrypt", "tls13_suites", "tls_failed_records", "tls_two_handshakes", "tls12_chacha", "tls13_chacha", "tls_tree"])
def test_each_user_has_a_session_of_their_own(spark, tmp_path, name):
    got, want = checked(spark, tmp_path, name, events=views(USERS))
    assert got == want and len(got) >= 24 - (name == "tls_failed_records")


def test_chacha_rows_together():
    """Many records at once against one by one, around the sizes of blocks, and the RFC's block."""
    rng = random.Random(5)
    rows = [(rng.randbytes(32), rng.randbytes(12), rng.randbytes(n), rng.randbytes(n % 21)) for n in (0, 1, 15, 16, 63, 64, 65, 16384, 300_000, *range(100, 120))]
    sealed = keys.chacha_seal_all(rows)
    assert sealed == [keys.chacha_seal(*row) for row in rows]
    shut = [(key, nonce, data, aad) for (key, nonce, _, aad), data in zip(rows, sealed, strict=True)]
    bad = [(key, nonce, data[:-1] + bytes([data[-1] ^ 1]), aad) for key, nonce, data, aad in shut]
    short = [(*rows[0][:2], b"short", b"")]
    want = [x for row in rows for x in (row[2], None)]
    assert keys.chacha_open_all([x for pair in zip(shut, bad, strict=True) for x in pair] + short) == [*want, None]
    key, nonce = np.arange(32, dtype=np.uint8).view("<u4"), np.frombuffer(bytes.fromhex("000000090000004a00000000"), "<u4")
    block = keys._chacha_blocks(key[None], np.array([1]), nonce[None])  # RFC 8439 section 2.3.2
    assert block.tobytes()[:16].hex() == "10f1e7e4d13b5915500fdd1fa32071c4" and keys.chacha_open_all([]) == []


def documents(*texts):
    return {"doc_id": pa.array([i for i, _ in texts], pa.int64()), "text": pa.array([t for _, t in texts], pa.string())}


def test_a_letter_in_documents_without_text(spark, tmp_path):
    got, want = checked(spark, tmp_path, "document_search", documents=documents((0, None), (1, ""), (2, "Ee é"), (3, "x"), (4, "İEΣe")))
    assert got == want and [r[1] for r in got] == [0, 0, 2, 0, 2]


def test_text_is_searched_in_headers_too(spark, tmp_path):
    """Documents whose address (50,079 and 58,271) or lengths have the letter's bytes, and one with them across two others."""
    texts = [(1, "Maß"), (2, "MASS"), (3, "ẞ"), (50_079, "x"), (58_271, "x"), (50_080, "x"), (4, "x" * 50_071), (5, "x" * 50_070), (6, "㟀"), (7, "¼9😀"), (8, None)]
    got, want = checked(spark, tmp_path, "filter_text", documents=documents(*texts))
    assert got == want and {r[1] for r in got} == {1, 4, 6, 50_079, 58_271}


def odd_datagrams(seed, n):
    """Datagrams of any order and unit: headers in between, records that fit in one order or none, short ones."""
    rng, out = random.Random(seed), []
    for i in range(n):
        order, what = rng.choice("<>"), rng.choices(["record", "head", "short", "long"], [10, i % 40 == seed, 1, 1])[0]
        body = bytes([rng.choice([0x45, 0x60, 0])]) + rng.randbytes(rng.randint(0, 30))
        if what == "head":
            magic = rng.choice([m for m, (o, _) in MAGICS.items() if o == order])
            out.append(magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, rng.choice([1, 101, 113])))
        else:
            record = struct.pack(order + "IIII", 1_700_000_000 + i, i, len(body) + (what == "long"), 1500 + i) + body
            out.append(record[: rng.randint(0, 15)] if what == "short" else record)
    return out


def test_blocks_of_datagrams_against_a_walk(spark, tmp_path, monkeypatch):
    """Two captures over three triggers, one of them without the second capture, another with numbers in between left out."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    sent, said, state = {c: odd_datagrams(seed, 150) for seed, c in ((3, "a"), (7, "b"))}, [], {}
    triggers = [{"a": range(50), "b": range(70)}, {"a": range(50, 90)}, {"a": range(100, 150), "b": range(70, 150)}]
    os.makedirs(f"{tmp_path}/spool")
    for t, part in enumerate(triggers):
        rows = [(c, i, sent[c][i]) for c, numbers in part.items() for i in numbers]
        for c, _, data in rows:
            skipped = state[c][4] if c in state else 0
            state[c], packet = live.parse_datagram(data, state.get(c))
            if packet or state[c][4] > skipped:
                said.append((c, *(packet or (state[c][4], None, len(data), len(data), None, data)), packet is None))
        random.Random(t).shuffle(rows)
        names = ("capture_id", "arrival", "datagram")
        pq.write_table(pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}), f"{tmp_path}/spool/{t}.parquet")
        os.utime(f"{tmp_path}/spool/{t}.parquet", (1_700_000_000 + t,) * 2)

    def use(parsed, number):
        parsed.write.mode("overwrite").parquet(f"{tmp_path}/out/trigger={number}")

    writer = blocks.parse_in_blocks(live.read_spool(spark, f"{tmp_path}/spool", 1), f"{tmp_path}/standing", use)
    writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").drop("trigger").collect()
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found), key=repr) == sorted(said, key=repr)
    assert len({x[5] for x in said}) > 2 and sum(x[-1] for x in said) > 10


class Kept:
    """Stands for a state of either kind and for its handle, and counts what is asked of it."""

    def __init__(self, calls):
        self.calls, self.held, self.timers = calls, {}, []

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("getValueState", "getMapState"):
                return Kept(self.calls)
            if name in ("update", "updateValue"):
                self.held[args[0] if len(args) > 1 else ()] = args[-1]
            return {
                "exists": lambda: bool(self.held), "get": lambda: self.held[()], "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k],
                "removeKey": lambda k: self.held.pop(k), "keys": lambda: iter(list(self.held)), "listTimers": lambda: iter(self.timers), "deleteTimer": self.timers.remove,
                "registerTimer": self.timers.append, "getCurrentProcessingTimeInMs": lambda: 0,
            }.get(name, lambda *_: None)(*args)

        return call


def test_waiting_datagrams_take_few_calls():
    """Five thousand datagrams of which the later half comes first, some twice, and one never: each call is one to another process."""
    calls = []
    handle, order = Kept(calls), InOrder(0, 1000, 10_000)
    order.init(handle)
    data = {i: struct.pack("<IIII", i, 0, 2, 2) + i.to_bytes(2, "big") for i in range(5000)}
    rng, out = random.Random(2), []
    for part in ([*range(2500, 5000), *range(2600, 2650)], [*range(10, 2490), 2600], range(10), [*range(2490, 2495), 3, *range(2496, 2500)]):
        rows = list(part)
        rng.shuffle(rows)
        half = len(rows) // 2
        batches = (pd.DataFrame({"arrival": x, "datagram": [data[i] for i in x]}) for x in (rows[:half], rows[half:]))
        out.append(pd.concat([pd.DataFrame(columns=["data"]), *order.handleInputRows(("a",), batches, handle)]))
    assert [len(x) for x in out] == [0, 0, 2490, 5] and len(handle.timers) == 1
    out += list(order.handleExpiredTimer(("a",), handle, None))
    said = pd.concat(out)
    assert [bytes(x) for x in said["data"]] == [i.to_bytes(2, "big") for i in range(5000) if i != 2495]
    assert list(said["frame_index"]) == list(range(1, 5000)) and not order.early.exists()
    assert len(calls) < 250
