"""Names inside payloads: walks whose every step depends on the one before."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .headers import ipv6_text

_RECORD = "name:string,type:int,class:int,next:int"
DNS = (
    "struct<truncated:boolean,id:int,flags:int,questions:int,answers:int,authority:int,additional:int,"
    f"query:struct<{_RECORD}>,answer:struct<name:string,type:int,class:int,ttl:bigint,length:int,data:string,next:int>>"
)
_COUNTS = ("id", "flags", "questions", "answers", "authority", "additional")


class Overrun(Exception):
    """A length leads beyond the end."""


class Cursor:
    """A position in a message that never reads beyond ``end``."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None) -> None:
        self.data, self.at = data, at
        self.end = len(data) if end is None else min(end, len(data))

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise Overrun
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def skip(self, width: int) -> None:
        """Over a field that begins with its own length."""
        self.take(self.number(width))


def _ascii(data: bytes) -> str:
    return data.decode("ascii", "replace")


def server_name(record: bytes) -> str | None:
    """The first host name of a ClientHello's server-name extension."""
    hello = Cursor(record, 6)
    try:
        hello.end = min(hello.end, 9 + hello.number(3))
        hello.take(34)
        for width in (1, 2, 1):  # session, cipher suites, compression methods
            hello.skip(width)
        hello.end = min(hello.end, hello.number(2) + hello.at)
        while True:
            kind, inner = hello.number(2), Cursor(hello.take(hello.number(2)))
            if kind == 0 and inner.end >= 5:
                if not 3 <= inner.number(2) <= inner.end - 2:
                    return None
                if inner.number(1) == 0 and int.from_bytes(inner.data[3:5], "big") <= inner.end - 5:
                    return _ascii(inner.take(2 + int.from_bytes(inner.data[3:5], "big"))[2:])
    except Overrun:
        return None


def read_name(message: bytes, at: int, most_jumps: int | None = None) -> tuple[str, int]:
    """The name at an offset and the offset behind it. A pointer to where the walk has been
    leads nowhere; ``most_jumps`` bounds them further."""
    labels, behind, been = [], None, set()
    place = Cursor(message, at)
    while True:
        size = place.number(1)
        if size >= 0xC0:
            target = (size & 0x3F) << 8 | place.number(1)
            behind = place.at if behind is None else behind
            if target in been or most_jumps is not None and len(been) >= most_jumps:
                raise Overrun
            been.add(target)
            place.at = target
        elif size >= 0x40:
            raise Overrun
        elif size:
            labels.append(_ascii(place.take(size)))
        else:
            return ".".join(labels), place.at if behind is None else behind


def _record(message: bytes, at: int, answer: bool, most_jumps: int | None) -> dict:
    name, behind = read_name(message, at, most_jumps)
    place = Cursor(message, behind)
    out = {"name": name, "type": place.number(2), "class": place.number(2)}
    if answer:
        out["ttl"], out["length"] = place.number(4), place.number(2)
        start, data = place.at, place.take(out["length"])
        out["data"] = f"({len(data)}B)"
        if out["type"] == 1:
            out["data"] = ".".join(map(str, data)) if len(data) == 4 else "?"
        elif out["type"] == 28:
            out["data"] = ipv6_text(data) if len(data) == 16 else "?"
        elif out["type"] in (2, 5, 12):
            try:
                out["data"] = read_name(message, start, most_jumps)[0]
            except Overrun:
                out["data"] = "?"
    return out | {"next": place.at}


def read_dns(message: bytes, most_jumps: int | None = None) -> dict:
    """Header, first question and first answer; ``truncated`` and nothing else where
    something leads beyond the message. Further questions are only stepped over."""
    try:
        head = Cursor(message)
        out: dict = {"truncated": False} | {k: head.number(2) for k in _COUNTS}
        at = head.at
        if len(message) > at:
            for i in range(out["questions"]):
                asked = _record(message, at, False, most_jumps)
                at = asked["next"]
                if i == 0:
                    out["query"] = asked
        if out["answers"] and at < len(message):
            out["answer"] = _record(message, at, True, most_jumps)
    except Overrun:
        return {"truncated": True}
    return out


def _each(column: pa.Array, use) -> list:
    return [None if x is None else use(x) for x in column.to_pylist()]


def _sni(payload: pa.Array) -> pa.Array:
    return pa.array(_each(payload, server_name), pa.string())


def sni(payload: Column) -> Column:
    """The server name of a ClientHello record; of null, null."""
    return F.arrow_udf(_sni, "string").asNondeterministic()(payload)


def dns(message: Column, most_jumps: int | None = None) -> Column:
    """A DNS message as a struct; of null, null."""
    record = [("name", pa.string()), ("type", pa.int32()), ("class", pa.int32())]
    answer = [*record, ("ttl", pa.int64()), ("length", pa.int32()), ("data", pa.string()), ("next", pa.int32())]
    kind = pa.struct(
        [("truncated", pa.bool_()), *((k, pa.int32()) for k in _COUNTS), ("query", pa.struct([*record, ("next", pa.int32())])), ("answer", pa.struct(answer))]
    )

    def read(payload: pa.Array) -> pa.Array:
        return pa.array(_each(payload, lambda x: read_dns(x, most_jumps)), kind)

    return F.arrow_udf(read, DNS).asNondeterministic()(message)
