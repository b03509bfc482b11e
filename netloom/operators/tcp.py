"""TCP: relative numbers, retransmissions, order, duplicate acknowledgements,
and reassembly, all as windows over sessions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions.bytes import mostly_text, utf8_text
from ..functions.render import occurrences
from ..shared import written
from . import scans
from .dissect import frames as dissected

_MASK = (1 << 32) - 1
SESSION = ["capture_id", "session"]


def tcp_packets(frames: DataFrame) -> DataFrame:
    """Whole TCP headers with ``session`` (both ``address:port``, in text order),
    ``src`` and the payload's length."""
    src = F.concat_ws(":", "src_ip", F.col("src_port").cast("string"))
    dst = F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string"))
    rows = frames.where(F.col("tcp_flags").isNotNull()).withColumns({"src": src, "dst": dst})
    return rows.withColumn("session", F.concat_ws(" ", F.least("src", "dst"), F.greatest("src", "dst")))


def _flag(bit: int) -> Column:
    return F.col("tcp_flags").bitwiseAND(F.lit(bit)) != 0


def analyse(frames: DataFrame) -> DataFrame:
    """The TCP packets with ``client``, ``rel_seq``, ``rel_ack``, ``retransmission``,
    ``out_of_order``, ``dup_ack`` (its number, 0 for none) and ``tags``.

    The client is the source of the first pure SYN, or of the first packet. Both initial
    numbers follow SYNs and are filled forward. The flags depend on one direction
    only, so their windows are split by sender as well as by session."""
    syn, ack, has = _flag(2), _flag(16), F.col("payload_len") > 0
    session = Window.partitionBy(*SESSION)
    order = session.orderBy("frame_index")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    way = Window.partitionBy(*SESSION, "src").orderBy("frame_index")
    before = way.rowsBetween(Window.unboundedPreceding, -1)
    rows = tcp_packets(frames).withColumns(
        {"has": has, "end": F.col("tcp_seq") + F.col("payload_len"), "pure": ack & ~has & ~syn, "nth": F.row_number().over(way)}
    )
    opener = F.min(F.when(syn & ~ack, F.struct("frame_index", "src"))).over(session)["src"]
    rows = rows.withColumn("client", F.coalesce(opener, F.first("src").over(order)))
    from_client = F.col("src") == F.col("client")
    first = F.col("nth") == 1
    marks = {
        "client_isn": F.when(from_client & ((syn & ~ack) | first), F.col("tcp_seq")),
        "server_isn": F.when(~from_client & (syn | first), F.col("tcp_seq")),
    }
    rows = rows.withColumns({k: F.last(v, ignorenulls=True).over(so_far) for k, v in marks.items()})
    own = F.when(from_client, F.col("client_isn")).otherwise(F.col("server_isn"))
    peer = F.when(from_client, F.col("server_isn")).otherwise(F.col("client_isn"))
    same = Window.partitionBy(*SESSION, "src", "has", "tcp_seq", "payload_len").orderBy("frame_index")
    acks = Window.partitionBy(*SESSION, "src", "pure").orderBy("frame_index")
    rows = rows.withColumns(
        {
            "rel_seq": (F.col("tcp_seq") - own).bitwiseAND(F.lit(_MASK)),
            "rel_ack": F.when(ack, (F.col("tcp_ack") - peer).bitwiseAND(F.lit(_MASK))),
            "retransmission": F.col("has") & (F.row_number().over(same) > 1),
            "highest": F.max(F.when(F.col("has"), F.col("end"))).over(before),
            "changed": F.coalesce(F.lag("tcp_ack").over(acks) != F.col("tcp_ack"), F.lit(True)).cast("int"),
        }
    )
    island = F.sum("changed").over(acks.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("island", island)
    in_island = Window.partitionBy(*SESSION, "src", "pure", "island").orderBy("frame_index")
    rows = rows.withColumns(
        {
            "out_of_order": F.coalesce(F.col("has") & ~F.col("retransmission") & (F.col("tcp_seq") < F.col("highest")), F.lit(False)),
            "dup_ack": F.when(F.col("pure"), F.row_number().over(in_island) - 1).otherwise(0),
        }
    )
    return _tagged(rows).drop("has", "end", "pure", "nth", "client_isn", "server_isn", "highest", "changed", "island")


def _tagged(rows: DataFrame) -> DataFrame:
    """The rows with ``tags`` and ``tcp_info``, in which they stand behind the packet's info."""
    tags = F.filter(
        F.array(
            F.when(F.col("retransmission"), F.lit("TCP Retransmission")),
            F.when(F.col("out_of_order"), F.lit("TCP Out-Of-Order")),
            F.when(F.col("dup_ack") > 0, F.concat(F.lit("TCP Dup ACK #"), F.col("dup_ack").cast("string"))),
        ),
        lambda x: x.isNotNull(),
    )
    rows = rows.withColumn("tags", tags)
    suffix = F.when(F.size("tags") > 0, F.concat(F.lit("  ["), F.array_join("tags", ", "), F.lit("]"))).otherwise("")
    return rows.withColumn("tcp_info", F.concat("l4_info", suffix))


_NARROW = ["capture_id", "session", "frame_index", "src", "dst", "tcp_flags", "tcp_seq", "tcp_ack", "payload_len", "l4_info"]


def analyse_blocks(frames: DataFrame, block: int = scans.BLOCK) -> DataFrame:
    """What ``analyse`` tells, with no window over a whole session: for captures with sessions too long for one
    task. Sessions are scanned in blocks of packet numbers and the blocks' results merged (``scans``).
    Only the columns above and those of ``analyse``. Not lazy: these columns are written once, and packets
    dissected once; more steps than ``analyse``, so worth it for long sessions alone."""
    syn, ack, has = _flag(2), _flag(16), F.col("payload_len") > 0
    way = [*SESSION, "src"]
    slim = scans.with_block(tcp_packets(frames).select(*_NARROW), block)
    rows = written(slim.withColumns({"has": has, "pure": ack & ~has & ~syn, "end": F.when(has, F.col("tcp_seq") + F.col("payload_len"))}), "tcp")
    opener = F.min(F.when(syn & ~ack, F.struct("frame_index", "src")))["src"]
    rows = scans.of_group(rows, SESSION, client=F.coalesce(opener, F.min_by("src", "frame_index")))
    rows = written(scans.of_group(rows, way, begins=F.min("frame_index")), "tcp")
    from_client, first = F.col("src") == F.col("client"), F.col("frame_index") == F.col("begins")
    lasts = {
        "client_isn": F.when(from_client & ((syn & ~ack) | first), F.col("tcp_seq")),
        "server_isn": F.when(~from_client & (syn | first), F.col("tcp_seq")),
    }
    rows = scans.running(rows, SESSION, lasts=lasts)
    # A segment's repetitions are few; all bare acknowledgements of one number are one group, which needs no order.
    same = Window.partitionBy(*way, "tcp_seq", "payload_len").orderBy("frame_index")
    repeated = rows.where("has").withColumn("retransmission", F.row_number().over(same) > 1)
    rows = written(repeated.unionByName(rows.where("NOT has").withColumn("retransmission", F.lit(False))), "tcp")
    rows = written(scans.running(rows, way, maxima={"highest": F.col("end")}, before=("highest",)), "tcp")
    pure = scans.runs(rows.where("pure"), way, "tcp_ack").withColumnRenamed("run", "dup_ack")
    rows = pure.unionByName(rows.where("NOT pure").withColumn("dup_ack", F.lit(0).cast("long")))
    own = F.when(from_client, F.col("client_isn")).otherwise(F.col("server_isn"))
    peer = F.when(from_client, F.col("server_isn")).otherwise(F.col("client_isn"))
    rows = rows.withColumns(
        {
            "rel_seq": (F.col("tcp_seq") - own).bitwiseAND(F.lit(_MASK)),
            "rel_ack": F.when(ack, (F.col("tcp_ack") - peer).bitwiseAND(F.lit(_MASK))),
            "out_of_order": F.coalesce(F.col("has") & ~F.col("retransmission") & (F.col("tcp_seq") < F.col("highest")), F.lit(False)),
            "dup_ack": F.col("dup_ack").cast("int"),
        }
    )
    return _tagged(rows).select(*_NARROW, "client", "rel_seq", "rel_ack", "retransmission", "out_of_order", "dup_ack", "tags", "tcp_info")


def reassemble_blocks(frames: DataFrame, block: int = scans.BLOCK) -> DataFrame:
    """``reassemble`` with no window over a whole session or direction, for long ones: numbers are scanned in
    blocks (``scans``) over narrow columns, and joined to the payloads. Not lazy: both are written once."""
    kept = ["capture_id", "session", "frame_index", "src", "dst", "tcp_flags", "tcp_seq", "payload_len"]
    packets = written(tcp_packets(frames).select(*kept, "payload"), "tcp")
    way, syn = [*SESSION, "src"], _flag(2)
    rows = scans.of_group(scans.with_block(packets.select(*kept), block), SESSION, client_first=F.min_by("src", "frame_index"))
    rows = rows.withColumns({"syn": syn, "at": F.when(syn, (F.col("tcp_seq") + 1).bitwiseAND(F.lit(_MASK))).otherwise(F.col("tcp_seq"))})
    rows = written(scans.running(rows, way, sums={"epoch": F.col("syn").cast("int")}), "tcp")
    reach = F.when(F.col("payload_len") > 0, F.col("at") + F.col("payload_len")).when(F.col("syn"), F.col("at"))
    rows = scans.running(rows, [*way, "epoch"], maxima={"reached": reach}, before=("reached",))
    rows = rows.withColumn("expected", F.coalesce(F.when(F.col("syn"), F.col("at")), F.col("reached"), F.col("at")))
    start = F.greatest("at", "expected")
    new = F.least(F.greatest(F.col("at") + F.col("payload_len") - start, F.lit(0)), F.col("payload_len"))
    rows = written(rows.withColumns({"chunk_seq": start, "fresh": F.when(F.col("payload_len") > 0, new).otherwise(0)}), "tcp")
    rows = scans.running(rows, way, sums={"data_offset": F.col("fresh")}, before=("data_offset",)).where("fresh > 0")
    found = rows.join(packets.select("capture_id", "frame_index", "payload"), ["capture_id", "frame_index"])
    found = found.withColumn("chunk", F.expr("substring(payload, payload_len - fresh + 1, fresh)"))
    return found.select("capture_id", "session", "client_first", "src", "dst", "frame_index", "chunk_seq", "data_offset", "fresh", "chunk")


def reassemble(frames: DataFrame) -> DataFrame:
    """The bytes each packet adds to its direction: ``chunk_seq``, ``data_offset``,
    ``fresh`` (how many) and ``chunk``. Overlaps are cut off in front; a gap is skipped, not
    waited for; every SYN starts numbering anew. ``client_first`` is the session's first
    sender."""
    way = Window.partitionBy(*SESSION, "src").orderBy("frame_index")
    so_far = way.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    syn = _flag(2)
    rows = tcp_packets(frames).withColumns(
        {
            "client_first": F.first("src").over(Window.partitionBy(*SESSION).orderBy("frame_index")),
            "syn": syn,
            "epoch": F.sum(syn.cast("int")).over(so_far),
            "at": F.when(syn, (F.col("tcp_seq") + 1).bitwiseAND(F.lit(_MASK))).otherwise(F.col("tcp_seq")),
        }
    )
    epoch = Window.partitionBy(*SESSION, "src", "epoch").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.when(F.col("payload_len") > 0, F.col("at") + F.col("payload_len")).when(F.col("syn"), F.col("at"))
    rows = rows.withColumn("expected", F.coalesce(F.when(F.col("syn"), F.col("at")), F.max(reach).over(epoch), F.col("at")))
    start = F.greatest("at", "expected")
    new = F.least(F.greatest(F.col("at") + F.col("payload_len") - start, F.lit(0)), F.col("payload_len"))
    rows = rows.withColumns({"chunk_seq": start, "fresh": F.when(F.col("payload_len") > 0, new).otherwise(0)})
    offset = F.coalesce(F.sum("fresh").over(way.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"data_offset": offset, "chunk": F.expr("substring(payload, payload_len - fresh + 1, fresh)")})
    return rows.where("fresh > 0").select(
        "capture_id", "session", "client_first", "src", "dst", "frame_index", "chunk_seq", "data_offset", "fresh", "chunk"
    )


def in_order(chunks: DataFrame) -> DataFrame:
    """The chunks of each direction in one partition, one after the other."""
    return (
        chunks.select(*SESSION, "src", "frame_index", "chunk").repartition(*SESSION, "src").sortWithinPartitions(*SESSION, "src", "frame_index")
    )


def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[int, bytes]]]]:
    """Each direction of ``in_order`` rows with its (packet number, chunk) pairs, which are read
    from the batches as they are asked for."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:3]):
        yield key, ((r[3], r[4]) for r in group)


def stream_digests(chunks: DataFrame) -> DataFrame:
    """The length and SHA-256 of each direction's bytes, gathered nowhere."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in directions(batches):
            size, state = 0, hashlib.sha256()
            for _, chunk in pieces:
                size += len(chunk)
                state.update(chunk)
            yield pa.RecordBatch.from_pydict(dict(zip(("capture_id", "session", "src", "bytes", "sha256"), ([x] for x in (*key, size, state.hexdigest())), strict=True)))

    return in_order(chunks).mapInArrow(digest, "capture_id string, session string, src string, bytes long, sha256 string")


def streams(chunks: DataFrame) -> DataFrame:
    """Each direction's bytes as one value, with the chunks they came from: for directions
    below 2 GB. ``in_order`` and ``directions`` read longer ones piece by piece."""
    return chunks.groupBy("capture_id", "session", "client_first", "src").agg(
        F.expr("listagg(chunk) within group (order by frame_index)").alias("stream"),
        F.sort_array(F.collect_list(F.struct("data_offset", "fresh", "frame_index"))).alias("pieces"),
    )


def follow_stream(raw: DataFrame, capture_id: str, frame_index: int) -> DataFrame:
    """The payloads of one packet's session, in order; the packet's sender is the client.
    Nothing is deduplicated. ``raw`` are raw packets: one is dissected first (and read by the
    driver) to learn the session; then one capture, once. Both filters stand below the
    dissector, where a source can apply them. No such TCP packet, no rows."""
    own = raw.where(F.col("capture_id") == capture_id)
    anchor = tcp_packets(dissected(own.where(F.col("frame_index") == frame_index))).select("session", "src").first()
    session, client = anchor or ("", "")
    found = tcp_packets(dissected(own)).where((F.col("session") == session) & (F.col("payload_len") > 0))
    return found.select("frame_index", (F.col("src") == client).alias("from_client"), "payload_len", "payload")


def stream_totals(segments: DataFrame) -> DataFrame:
    """Segments and bytes of a followed stream."""
    return segments.agg(F.count("*").alias("segments"), F.coalesce(F.sum("payload_len"), F.lit(0)).cast("long").alias("bytes"))


def search_stream(segments: DataFrame, needle: str) -> DataFrame:
    """The places of a text in a followed stream: packet, where in it, and the place's number
    among all (``nth``, from 0), with the numbers of the place before and after; behind
    the last comes the first again. One stream is searched, so its places alone are ordered together."""
    text = F.when(mostly_text(F.col("payload")), utf8_text(F.col("payload"))).otherwise(F.lower(F.hex("payload")))
    found = segments.select("frame_index", F.explode(occurrences(text, needle)).alias("pos"))
    order = Window.orderBy("frame_index", "pos")
    every = Window.partitionBy()
    rows = found.select("frame_index", "pos", (F.row_number().over(order) - 1).alias("nth"), F.count("*").over(every).cast("int").alias("total"))
    return rows.withColumns({"next": (F.col("nth") + 1) % F.col("total"), "previous": (F.col("nth") + F.col("total") - 1) % F.col("total")})
