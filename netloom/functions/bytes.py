"""Numbers, addresses and text out of BINARY columns. Offsets count from 0."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

Offset = int | Column


def _col(x: Offset) -> Column:
    return F.lit(x) if isinstance(x, int) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def cut(data: Column, at: Offset, n: Offset) -> Column:
    """``n`` bytes from ``at``; fewer where the data ends."""
    return F.substring(data, _col(at) + 1, F.greatest(_col(n), F.lit(0)))


def unsigned(data: Column, at: Offset, n: int) -> Column:
    """Big-endian unsigned number of ``n`` bytes; null beyond the end."""
    value = F.conv(F.hex(cut(data, at, n)), 16, 10).cast("long")
    return F.when(_col(at) + n <= F.octet_length(data), value)


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_number(value: Column, digits: int) -> Column:
    """``0x`` and at least ``digits`` digits."""
    text = F.lower(F.hex(value))
    return F.concat(F.lit("0x"), F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text))


def mac(data: Column, at: Offset) -> Column:
    return F.rtrim(F.regexp_replace(hex_lower(cut(data, at, 6)), "(..)", "$1:"), F.lit(":"))


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def utf8_text(data: Column) -> Column:
    """Invalid sequences become U+FFFD."""
    return F.call_function("make_valid_utf8", data.cast("string"))


def _literal(names: Mapping[int, str]) -> str:
    return "map(" + ", ".join(f"{value}L, '{name}'" for value, name in names.items()) + ")"


def named(code: Column, names: Mapping[int, str], otherwise: Column) -> Column:
    """A code's name from a small table, which is one literal of the plan."""
    return F.coalesce(F.try_element_at(F.expr(_literal(names)), code.cast("long")), otherwise)


def named_sql(code: str, names: Mapping[int, str], otherwise: str) -> str:
    """The same of SQL expressions."""
    return f"coalesce(try_element_at({_literal(names)}, CAST({code} AS BIGINT)), {otherwise})"


def printable(data: Column) -> Column:
    """Number of printable bytes, tab, line feed and carriage return among them."""
    return F.octet_length(data) - F.length(F.regexp_replace(latin1(data), "[\\x20-\\x7e\\x09\\x0a\\x0d]", ""))


def mostly_text(data: Column) -> Column:
    """At least four fifths of the bytes are printable."""
    return printable(data) * 5 >= F.octet_length(data) * 4
