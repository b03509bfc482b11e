"""Sessions cut into blocks against whole windows."""

import random

import pytest
from pyspark.sql import functions as F
from test_packets import eth, ip4, seg, table

from netloom.operators import scans, tcp
from netloom.operators.dissect import frames


def elephant(seed, n):
    """One session with most packets, others with few; repetitions, SYNs, long runs of one acknowledgement."""
    rng, packets = random.Random(seed), []
    ack = {}
    for _ in range(n):
        port = 5000 if rng.random() < 0.8 else rng.randint(5001, 5004)
        up = rng.random() < 0.5
        ends = ("10.0.0.1", "10.0.0.2") if up else ("10.0.0.2", "10.0.0.1")
        ack[port, up] = ack.get((port, up), 0) + (rng.random() < 0.1)
        flags = rng.choices([2, 18, 16], [1, 1, 30])[0]
        payload = b"" if rng.random() < 0.6 else bytes(rng.choices(b"abc", k=rng.randint(1, 30)))
        ports = (port, 443) if up else (443, port)
        packets.append(eth(ip4(6, seg(*ports, payload, rng.randint(0, 12) * 10, ack[port, up], flags), *ends)))
    return packets


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 300, 7), (2, 200, 1), (3, 100, 1 << 16)])
def test_blocks_give_what_windows_give(spark, seed, n, block):
    packets = frames(table(spark, elephant(seed, n)))
    columns = ["frame_index", "session", "src", "client", "rel_seq", "rel_ack", "retransmission", "out_of_order", "dup_ack", "tags", "tcp_info"]
    want, got = tcp.analyse(packets), tcp.analyse_blocks(packets, block)
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())
    assert got.where("dup_ack > 5").count() > 0
    want, got = tcp.reassemble(packets), tcp.reassemble_blocks(packets, block)
    assert sorted(got.collect(), key=repr) == sorted(want.select(got.columns).collect(), key=repr) and got.count() > 10


def test_running_by_null_keys_and_of_nothing(spark):
    rows = [(None if i % 3 else "a", i, i % 5 or None) for i in range(40)]
    df = scans.with_block(spark.createDataFrame(rows, "g string, frame_index long, x long"), 6)
    found = scans.running(df, ["g"], {"s": F.col("x")}, {"m": F.col("x")}, {"l": F.col("x")}, before=("m",)).collect()
    for g, i, _ in rows:
        upto = [x for k, j, x in rows if k == g and j <= i]
        ahead = [x for k, j, x in rows if k == g and j < i and x is not None]
        r = next(r for r in found if r["frame_index"] == i)
        known = [x for x in upto if x is not None]
        assert (r["s"], r["m"], r["l"]) == (sum(known), max(ahead, default=None), known[-1] if known else None)
    assert scans.running(df.limit(0), ["g"], {"s": F.col("x")}).collect() == [] == scans.runs(df.limit(0), ["g"], "x").collect()
