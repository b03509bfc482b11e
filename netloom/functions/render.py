"""Rendered values: sizes, durations, hex dumps and search."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytes import cut, hex_lower, hex_number, latin1


def format_bytes(n: Column) -> Column:
    """Whole bytes below 1024, else one decimal of KB or MB, two of GB."""
    x = n.cast("double")
    return (
        F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit("B")))
        .when(n < 1024**2, F.format_string("%.1fKB", x / 1024))
        .when(n < 1024**3, F.format_string("%.1fMB", x / 1024 / 1024))
        .otherwise(F.format_string("%.2fGB", x / 1024 / 1024 / 1024))
    )


def format_duration(ns: Column) -> Column:
    """A dash for nothing; milliseconds, seconds or hours."""
    secs = ns / 1e9
    return (
        F.when(ns <= 0, "—")
        .when(secs < 1, F.format_string("%.0fms", secs * 1000))
        .when(secs < 60, F.format_string("%.2fs", secs))
        .when(secs < 3600, F.format_string("%.0fs", secs))
        .otherwise(F.format_string("%.1fh", secs / 3600))
    )


def hex_dump(data: Column, width: int = 8) -> Column:
    """array<struct<at, line>>: offset (at least four digits), hex pairs and ASCII of each
    ``width`` bytes."""

    def line(at: Column) -> Column:
        part = cut(data, at, width)
        pairs = F.rtrim(F.regexp_replace(hex_lower(part), "(..)", "$1 "))
        shown = F.regexp_replace(latin1(part), "[^\\x20-\\x7e]", ".")
        text = F.concat(F.substring(hex_number(at, 4), 3, 8), F.lit("  "), F.rpad(pairs, 3 * width - 1, " "), F.lit("  "), shown)
        return F.struct(at.alias("at"), text.alias("line"))

    rows = F.transform(F.sequence(F.lit(0), F.octet_length(data) - 1, F.lit(width)), line)
    return F.when(F.octet_length(data) > 0, rows).otherwise(F.array().cast("array<struct<at:int,line:string>>"))


def _folded(text: str) -> str:
    """Lower case, character by character, so that places stay what they were."""
    if text.isascii():
        return text.lower()
    small = text.lower()
    # Some letters become two, and one is written otherwise at the end of a word.
    return small if len(small) == len(text) and "Σ" not in text else "".join(c.lower()[0] for c in text)


def occurrences(text: Column, needle: str) -> Column:
    """Starts of the non-overlapping occurrences, whatever their case, from 0, in code points of
    the text as it stands. One pass over each text, in Arrow batches; null where the text is."""
    wanted = _folded(needle)

    def find(texts: pa.Array) -> pa.Array:
        starts, offsets = array("i"), array("i", [0])
        for text in texts.to_pylist():
            small, at = _folded(text or ""), 0
            while wanted and (at := small.find(wanted, at)) >= 0:
                starts.append(at)
                at += len(wanted)
            offsets.append(len(starts))
        lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(starts, np.int32) if starts else [], pa.int32()))
        return pc.if_else(pc.is_valid(texts), lists, None)

    return F.arrow_udf(find, T.ArrayType(T.IntegerType()))(text)
