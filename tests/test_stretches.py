"""Stretches found inside files against a walk from the begin; captures of one name; the index."""

import random
import struct

import pytest
from test_packets import eth, ip4, seg

from netloom.sources import stretches
from netloom.sources.pcap import CaptureError, capture_name, capture_root, list_captures, read_pcap, split_records

HEAD = {"<": struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1), ">": struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1)}


def record(order, n, data, length=None):
    return struct.pack(order + "IIiI", 1_700_000_000 + n, n % 1000, len(data) if length is None else length, len(data)) + data


def capture(order, seed, n, most=200, fakes=False):
    """Packets of any bytes; with ``fakes``, of whole records of another capture."""
    rng = random.Random(seed)

    def body():
        if fakes and rng.random() < 0.5:
            return b"".join(record(order, rng.randint(0, 99), bytes(rng.randint(1, 5))) for _ in range(rng.randint(1, 40)))
        return bytes(rng.choices(range(256), k=rng.randint(0, most))) if rng.random() < 0.9 else bytes(rng.randint(0, 5 * most))

    return HEAD[order] + b"".join(record(order, i, body()) for i in range(n))


def planned(spark, path, split):
    return sorted(map(tuple, stretches.plan_stretches(list_captures(spark, str(path)).select("path", "length"), split).collect()))


def starts_of(path, size):
    return {start: first for start, _, first in split_records(str(path), size, 1)}


@pytest.mark.parametrize(("order", "seed", "n", "split", "fakes"), [("<", 1, 300, 1000, False), (">", 2, 300, 64, False), ("<", 3, 200, 500, True), (">", 4, 3, 40, True)])
def test_any_split_gives_the_same_packets(spark, tmp_path, order, seed, n, split, fakes):
    path = tmp_path / "a.pcap"
    path.write_bytes(capture(order, seed, n, fakes=fakes))
    size = path.stat().st_size
    parts, starts = planned(spark, path, split), starts_of(path, size)
    assert [p[1] for p in parts] == [24, *(p[2] for p in parts[:-1])] and parts[-1][2] == size
    assert all(starts[p[1]] == p[3] for p in parts) and len(parts) > 2
    rows = read_pcap(spark, str(path), splitBytes=split).orderBy("frame_index").collect()
    whole = read_pcap(spark, str(path)).orderBy("frame_index").collect()
    assert rows == whole and [r["frame_index"] for r in rows] == list(range(1, n + 1))


def test_wrong_guesses_are_corrected(spark, tmp_path, monkeypatch):
    """Every byte begins a chain, so that no guess is right but by chance; then none is ever made."""
    path = tmp_path / "a.pcap"
    path.write_bytes(capture("<", 5, 60))
    want = starts_of(path, path.stat().st_size)
    for rounds, chain in ((100, 0), (0, 0), (2, 0), (100, 10**9)):
        monkeypatch.setattr(stretches, "CHAIN", chain)
        monkeypatch.setattr(stretches, "ROUNDS", rounds)
        parts = planned(spark, path, 2000)
        assert all(want[p[1]] == p[3] for p in parts) and sum(p[2] - p[1] for p in parts) == path.stat().st_size - 24


def test_bad_lengths_and_cut_off_ends(spark, tmp_path):
    good = capture("<", 6, 100)
    (tmp_path / "bad.pcap").write_bytes(good + record("<", 1, b"", length=-1) + capture("<", 7, 100)[24:])
    with pytest.raises(Exception, match="packet 101 claims"):
        read_pcap(spark, str(tmp_path / "bad.pcap"), splitBytes=700).count()
    (tmp_path / "cut.pcap").write_bytes(good[:-3])
    cut = read_pcap(spark, str(tmp_path / "cut.pcap"), splitBytes=700)
    whole = read_pcap(spark, str(tmp_path / "cut.pcap"))
    assert cut.count() == whole.count() < 101
    with pytest.raises(Exception, match="is cut off"):
        read_pcap(spark, str(tmp_path / "cut.pcap"), "FAILFAST", splitBytes=700).count()
    (tmp_path / "header.pcap").write_bytes(good[:24])
    assert read_pcap(spark, str(tmp_path / "header.pcap")).count() == 0
    with pytest.raises(Exception, match="more than 10"):
        read_pcap(spark, str(tmp_path / "cut.pcap"), maxBytes=10, splitBytes=700).count()


def test_names_of_captures(spark, tmp_path):
    for folder in ("a", "b/c"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x y.pcap").write_bytes(capture("<", len(folder), 5))
    found = read_pcap(spark, f"{tmp_path}/*/*.pcap").unionByName(read_pcap(spark, f"{tmp_path}/b/c")).groupBy("capture_id").count().collect()
    assert sorted(map(tuple, found)) == [("a/x y.pcap", 5), ("x y.pcap", 5)]
    assert capture_name("s3://k/p/q/f.pcap", capture_root("s3://k/p/*")) == "q/f.pcap"
    assert capture_name("file:/p/f.pcap", capture_root("/p/f.pcap")) == "f.pcap"
    assert capture_name("hdfs://h/elsewhere/f.pcap", capture_root("/p")) == "hdfs://h/elsewhere/f.pcap"


def test_not_a_capture(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"no capture at all, but long enough")
    for split in (10, 1000):
        with pytest.raises(Exception, match=CaptureError.__name__):
            read_pcap(spark, str(tmp_path / "x.pcap"), splitBytes=split).count()


def test_an_index_saves_reading(spark, tmp_path):
    from netloom.operators.dissect import frames
    from netloom.operators.filters import FilterError, filter_frames, index_filter
    from netloom.sources.pcap_index import index_captures, read_indexed, search_captures

    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    for name in ("a", "b"):
        packets = [eth(ip4(6, seg(1000 + i // 10, 443, b"x" * 50), f"10.0.{'ab'.index(name)}.{i // 10}", "192.0.2.1")) for i in range(400)]
        (folder / f"{name}.pcap").write_bytes(HEAD["<"] + b"".join(record("<", i, p) for i, p in enumerate(packets)))
    pattern = f"{folder}/*.pcap"
    index_captures(spark, pattern, index, 3000)
    every = frames(read_pcap(spark, pattern))
    for text, most in (("host 10.0.1.7", 120), ("port 1005 and not tcp", 240), ("port 1005 and host 10.0.0.5", 120), ("host 10.0.9.9", 60), ("host 10.0.0.1 or host 10.0.1.30", 240), ("not host 10.0.0.1", 800), ("tcp", 800), ("", 800)):
        read = read_indexed(spark, pattern, index, text)
        assert read.count() <= most, text
        got = search_captures(spark, pattern, index, text).select("capture_id", "frame_index").collect()
        assert sorted(got) == sorted(filter_frames(every, text).select("capture_id", "frame_index").collect()), text
    second = 1_700_000_000_000_000_000
    late = read_indexed(spark, pattern, index, since_ns=second + 390_000_000_000, until_ns=second + 395_000_000_000).select("ts_ns").collect()
    assert 12 <= len(late) < 200 and sum(second + 390 * 10**9 <= r[0] <= second + 395_000_000_000 for r in late) == 10
    (folder / "b.pcap").write_bytes(HEAD["<"] + record("<", 1, eth(ip4(6, seg(1, 2), "10.0.9.9"))))
    (folder / "c.pcap").write_bytes(HEAD["<"] + record("<", 1, eth(ip4(6, seg(1, 2), "10.0.9.9"))))
    found = search_captures(spark, pattern, index, "host 10.0.9.9").select("capture_id").collect()
    assert sorted(r[0] for r in found) == ["b.pcap", "c.pcap"]
    with pytest.raises(FilterError):
        index_filter("port abc")


def test_filters_pushed_into_the_source(spark, tmp_path):
    from pyspark.sql import functions as F

    from netloom.sources.pcap import PcapSource
    from netloom.sources.pcap_index import index_captures

    folder, index = tmp_path / "in", str(tmp_path / "index")
    folder.mkdir()
    for name in ("a", "b"):
        (folder / f"{name}.pcap").write_bytes(HEAD["<"] + b"".join(record("<", i, eth(ip4(6, seg(1, 2, b"x" * 50)))) for i in range(300)))
    index_captures(spark, f"{folder}/*.pcap", index, 3000)
    spark.dataSource.register(PcapSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda: spark.read.format("pcap").option("index", index).option("pushFilters", "true").load(str(folder))
        whole = {tuple(r) for r in spark.read.format("pcap").load(str(folder)).collect()}
        assert {tuple(r) for r in read().collect()} == whole and len(whole) == 600
        parts = read().rdd.getNumPartitions()
        assert parts > 20
        second = 1_700_000_000_000_000_000
        for test, tasks in (
            (F.col("capture_id") == "a.pcap", parts // 2), ((F.col("ts_ns") >= second + 250 * 10**9) & (F.col("ts_ns") < second + 252 * 10**9), 4), ((F.col("frame_index") > 290) & (F.col("capture_id") == "b.pcap"), 2),
            (F.col("frame_index") <= 3, 2), ((F.col("ts_ns") == 7), 1), (F.col("orig_len") > 10**6, parts),
        ):
            found = read().where(test)
            assert found.rdd.getNumPartitions() <= tasks
            assert {tuple(r) for r in found.collect()} == {tuple(r) for r in spark.createDataFrame(list(whole), found.schema).where(test).collect()}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
