"""The spool of a live capture: datagrams written ahead, numbered across restarts, and read as a stream
whose offsets are those numbers."""

from __future__ import annotations

import re
import socket
import time
import uuid
from collections.abc import Iterator
from threading import Event, Thread

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.pcap import located

SPOOL = "capture_id string, arrival long, datagram binary"
#: The largest datagram of a sender that puts one packet into each.
MOST_DATAGRAM = 65_599
_SPOOL = pa.schema([("capture_id", pa.string()), ("arrival", pa.int64()), ("datagram", pa.binary())])
_FILE = re.compile(r"([0-9]+)-([0-9]+)-[0-9a-f]+\.parquet")


def spool_files(folder: str) -> list[tuple[int, int, str]]:
    """First number, number behind the last, and path of the spool's files, in order. Names tell both, so
    nothing is opened."""
    system, inside = located(folder)
    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    named = ((_FILE.fullmatch(f.base_name), f.path) for f in found)
    return sorted((int(m[1]), int(m[1]) + int(m[2]), path) for m, path in named if m)


def write_spool(folder: str, capture_id: str, first: int, datagrams: list[bytes]) -> None:
    """Adds a file. It is written under a hidden name and moved, so that no reader sees half of
    it, and its name is unlike any other, so that nothing is overwritten."""
    system, inside = located(folder)
    name = f"{first:015d}-{len(datagrams)}-{uuid.uuid4().hex}.parquet"
    table = pa.table({"capture_id": [capture_id] * len(datagrams), "arrival": range(first, first + len(datagrams)), "datagram": datagrams}, _SPOOL)
    with system.open_output_stream(f"{inside}/.{name}") as f:
        pq.write_table(table, f)
    system.move(f"{inside}/.{name}", f"{inside}/{name}")


def receive(folder: str, port: int, host: str = "0.0.0.0", capture_id: str = "live", most: int = 1000, patience: float = 1.0, stop: Event | None = None) -> int:
    """Writes the datagrams that reach a UDP port to ``folder``, any that Arrow's file systems know,
    until ``stop`` is set; returns how many. Numbers go on where the folder's last file
    ends. A file holds at most ``most`` datagrams and what came within ``patience`` seconds; only what is not yet in a file is
    lost with the receiver. A spool has one receiver at a time. A port that is taken raises OSError."""
    rows: list[bytes] = []
    count = 0
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as source:
        source.bind((host, port))
        source.settimeout(patience / 4)
        system, inside = located(folder)
        system.create_dir(inside, recursive=True)
        begin = max((end for _, end, _ in spool_files(folder)), default=0)

        def write() -> None:
            write_spool(folder, capture_id, begin + count - len(rows), rows)
            rows.clear()

        since = time.monotonic()
        while stop is None or not stop.is_set():
            try:
                rows.append(source.recv(MOST_DATAGRAM))
                count += 1
            except TimeoutError:
                pass
            if rows and (len(rows) >= most or time.monotonic() - since > patience):
                write()
                since = time.monotonic()
        if rows:
            write()
    return count


class SpoolPartition(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


#: Receivers of this process by spool; readers themselves are sent to executors.
_RECEIVERS: dict[str, tuple[Thread, Event]] = {}


class SpoolReader(DataSourceStreamReader):
    """The stream of ``spark.readStream.format("datagrams")``. Options: ``spool`` (the folder), and to receive
    as well ``port``, ``host``, ``captureId`` and ``patience``; ``discard`` deletes
    files whose datagrams are all committed. An offset is the number of the next datagram: what a failed or
    killed query had not committed is read from the same files again."""

    def __init__(self, options: dict) -> None:
        self.options = {k.lower(): v for k, v in options.items()}
        self.spool = self.options["spool"]

    def _listen(self) -> None:
        if "port" in self.options and self.spool not in _RECEIVERS:
            over = Event()
            kwargs = {"stop": over, "patience": float(self.options.get("patience", 1.0)), "capture_id": self.options.get("captureid", "live")}
            thread = Thread(target=receive, args=(self.spool, int(self.options["port"]), self.options.get("host", "0.0.0.0")), kwargs=kwargs, daemon=True)
            thread.start()
            _RECEIVERS[self.spool] = thread, over

    def initialOffset(self) -> dict:
        files = spool_files(self.spool)
        return {"arrival": files[0][0] if files else 0}

    def latestOffset(self) -> dict:
        self._listen()
        files = spool_files(self.spool)
        return {"arrival": files[-1][1] if files else 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["arrival"], end["arrival"]
        folder = self.spool.rstrip("/")
        return [SpoolPartition(f"{folder}/{path.rsplit('/', 1)[-1]}", low, high) for first, last, path in spool_files(folder) if first < high and last > low]

    def read(self, partition: SpoolPartition) -> Iterator[pa.RecordBatch]:
        system, inside = located(partition.path)
        with system.open_input_file(inside) as f:
            for batch in pq.ParquetFile(f).iter_batches():
                arrival = batch.column("arrival").to_numpy()
                yield batch.filter(pa.array((arrival >= partition.start) & (arrival < partition.end)))

    def commit(self, end: dict) -> None:
        if self.options.get("discard", "false").lower() == "true":
            system, _ = located(self.spool)
            for _, last, path in spool_files(self.spool)[:-1]:  # the last file tells where numbers go on
                if last <= end["arrival"]:
                    system.delete_file(path)

    def stop(self) -> None:
        if found := _RECEIVERS.pop(self.spool, None):
            found[1].set()
            found[0].join()


class DatagramSource(DataSource):
    """Register with ``spark.dataSource.register(DatagramSource)``."""

    @classmethod
    def name(cls) -> str:
        return "datagrams"

    def schema(self) -> str:
        return SPOOL

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SpoolReader(self.options)
