"""A receiver that is killed and started again, the stream that reads what it wrote, and datagrams out of order."""

import os
import signal
import socket
import struct
import subprocess
import sys
import time

import pytest

from netloom.streaming.live import parsed_datagrams
from netloom.streaming.ordered import ordered_datagrams
from netloom.streaming.spool import SPOOL, DatagramSource, SpoolReader, receive, spool_files, write_spool

HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def datagram(i):
    return struct.pack("<IIII", 1000 + i, i, 4, 4) + i.to_bytes(4, "big")


def free_port():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def send(port, numbers):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for i in numbers:
            s.sendto(HEADER if i == 0 else datagram(i), ("127.0.0.1", port))
            time.sleep(0.002)


def wait(test, seconds=30):
    end = time.monotonic() + seconds
    while not test():
        assert time.monotonic() < end
        time.sleep(0.05)


def test_a_killed_receiver_goes_on(tmp_path):
    folder, port = f"file://{tmp_path}/deep/spool", free_port()
    code = f"from netloom.streaming.spool import receive; receive({folder!r}, {port}, '127.0.0.1', patience=0.1)"
    at = 0
    for part in (range(0, 20), range(20, 50)):
        process = subprocess.Popen([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": os.environ["PYTHONPATH"]})
        bound = lambda: f":{port:04X} " in open("/proc/net/udp").read()
        wait(bound)
        send(port, part)
        at += len(part)
        wait(lambda: spool_files(folder) and spool_files(folder)[-1][1] == at)
        process.send_signal(signal.SIGKILL)
        process.wait()
    spans = [(a, b) for a, b, _ in spool_files(folder)]
    assert spans[0][0] == 0 and spans[-1][1] == 50 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    reader = SpoolReader({"spool": folder})
    rows = [r for p in reader.partitions({"arrival": 7}, {"arrival": 43}) for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["arrival"], r["datagram"]) for r in rows] == [(i, datagram(i)) for i in range(7, 43)]
    SpoolReader({"spool": folder, "discard": "true"}).commit({"arrival": 50})
    assert len(spool_files(folder)) == 1 and SpoolReader({"spool": folder}).latestOffset() == {"arrival": 50}


def test_a_taken_port(tmp_path):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        with pytest.raises(OSError):
            receive(str(tmp_path), s.getsockname()[1], "127.0.0.1")


def test_the_stream_loses_and_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(DatagramSource)
    folder, out, port = f"{tmp_path}/spool", f"{tmp_path}/out", free_port()

    def started():
        stream = spark.readStream.format("datagrams").option("spool", folder).option("port", port).option("host", "127.0.0.1").option("patience", "0.1").load()
        return parsed_datagrams(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").start()

    sent = 0
    for part in (range(0, 30), range(30, 70)):
        query = started()
        wait(lambda: f":{port:04X} " in open("/proc/net/udp").read())
        send(port, part)
        sent += len(part)
        wait(lambda: spool_files(folder) and spool_files(folder)[-1][1] == sent)
        if part[0]:
            query.processAllAvailable()
        query.stop()  # the first time with some of them unread
        wait(lambda: f":{port:04X} " not in open("/proc/net/udp").read())
    got = sorted((r["frame_index"], bytes(r["data"])) for r in spark.read.parquet(out).collect())
    assert got == [(i, i.to_bytes(4, "big")) for i in range(1, 70)]


def test_out_of_order_over_triggers(spark, tmp_path):
    """Files are read one a trigger, the latest numbers first, some of them twice; one number never comes."""
    folder = f"{tmp_path}/spool"
    order = [range(60, 80), range(20, 40), [*range(40, 58), 59], range(0, 20), range(30, 45), range(80, 90)]
    os.makedirs(folder)
    for n, part in enumerate(order):
        rows = [(c, i, bytearray(HEADER if i == 0 else datagram(i))) for i in part for c in "ab"]
        spark.createDataFrame(rows, SPOOL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}")
        name = next(f for f in os.listdir(f"{tmp_path}/{n}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/{n}/{name}", f"{folder}/{n}.parquet")
        os.utime(f"{folder}/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema(SPOOL).option("maxFilesPerTrigger", 1).parquet(folder)
        query = ordered_datagrams(stream, patience=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        read = lambda: sorted((r["capture_id"], r["frame_index"], bytes(r["data"])) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        want = [(c, n, i.to_bytes(4, "big")) for c in "ab" for n, i in enumerate([i for i in range(1, 90) if i != 58], 1)]
        # With a timer set the query always has a next trigger, so it is never done with all there is.
        wait(lambda: query.lastProgress and os.path.isdir(f"{tmp_path}/out/_spark_metadata") and (query.exception() is not None or len(read()) == len(want)), 90)
        assert query.exception() is None
        query.stop()
        assert read() == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
