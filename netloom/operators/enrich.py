"""What whole sessions tell about a packet, added to its protocol tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.bytes import hex_lower, named
from ..schema import FIELD

KEY = ["capture_id", "frame_index"]


def _field(name: str, value: Column) -> Column:
    """A field without a byte range; null where the value is."""
    nothing = F.lit(None).cast("int")
    made = F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"), nothing.alias("start"), nothing.alias("end"), F.array().alias("children"))
    return F.when(value.isNotNull(), made.cast(FIELD))


def _fields(*fields: Column) -> Column:
    return F.array_compact(F.array(*fields))


def _grown(found: DataFrame, protocol: str, fields: Column, summary: Column | None = None) -> DataFrame:
    """``found`` with ``fields`` behind those of the protocol's layer, and its summary replaced
    where there is a new one."""

    def layer(x: Column) -> Column:
        x = x.withField("fields", F.concat(x["fields"], F.coalesce(F.col("_fields"), F.array().cast(f"array<{FIELD}>"))))
        return x if summary is None else x.withField("summary", F.coalesce(F.col("_summary"), x["summary"]))

    rows = found.withColumns({"_fields": fields} | ({} if summary is None else {"_summary": summary}))
    grown = F.transform("layers", lambda x: F.when(x["protocol"] == protocol, layer(x)).otherwise(x))
    return rows.withColumn("layers", grown)


def _joined(tree: DataFrame, found: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """The tree's rows with the named columns of ``found`` under names of their own."""
    extra = found.select(*KEY, *[F.col(c).alias(f"_{k}") for k, c in columns.items()])
    return tree.join(extra, KEY, "left"), {k: F.col(f"_{k}") for k in columns}


def with_tcp_analysis(tree: DataFrame, analysed: DataFrame) -> DataFrame:
    """``tree`` (rows of ``layers.with_layers``) with the relative numbers and the tags of
    ``tcp.analyse`` in the TCP layer."""
    rows, x = _joined(tree, analysed, {"seq": "rel_seq", "ack": "rel_ack", "tags": "tags", "info": "tcp_info"})
    tagged = F.size(x["tags"]) > 0
    fields = _fields(
        _field("Relative Seq", x["seq"]), _field("Relative Ack", x["ack"]), _field("TCP Analysis", F.when(tagged, F.array_join(x["tags"], ", ")))
    )
    return _grown(rows, C.TCP, fields, F.when(tagged, x["info"])).select(*tree.columns)


def with_tls_plaintext(tree: DataFrame, opened: DataFrame) -> DataFrame:
    """``tree`` with what ``decrypt.decrypt_tls`` says of each record in the TLS layer."""
    rows, x = _joined(tree, opened, {"status": "status", "plain": "plain", "text": "text"})
    shown = F.when(F.startswith(x["status"], F.lit("✓")) & ~F.contains(x["status"], F.lit("empty")), hex_lower(x["plain"]))
    fields = _fields(_field("Decryption", x["status"]), _field("Decrypted (hex)", shown), _field("Decrypted (text)", x["text"]))
    return _grown(rows, C.TLS, fields).select(*tree.columns)


def with_quic_plaintext(tree: DataFrame, opened: DataFrame) -> DataFrame:
    """``tree`` with what ``decrypt.decrypt_quic_initials`` says of each packet in the QUIC
    layer."""
    rows, x = _joined(tree, opened, {"number": "packet_number", "plain": "plain", "crypto": "crypto"})
    status = F.concat(F.lit("✓ pn="), x["number"], F.lit(" ("), F.octet_length(x["plain"]), F.lit("B plaintext)"))

    def crypto(c: Column) -> Column:
        kind = F.conv(F.substring(F.hex(c["data"]), 1, 2), 16, 10).cast("int")
        name = named(kind, C.TLS_HANDSHAKES, F.concat(F.lit("Type"), kind.cast("string")))
        return _fields(
            _field("CRYPTO frame", F.concat(F.lit("offset="), c["offset"], F.lit(" length="), c["length"])),
            _field("CRYPTO data (hex)", hex_lower(c["data"])),
            _field("Handshake", F.when(F.octet_length(c["data"]) > 0, F.concat(kind.cast("string"), F.lit(" ("), name, F.lit(")")))),
        )

    own = _fields(_field("Initial decryption", status), _field("Decrypted (hex)", hex_lower(x["plain"])))
    fields = F.concat(own, F.coalesce(F.flatten(F.transform(x["crypto"], crypto)), F.array().cast(f"array<{FIELD}>")))
    return _grown(rows, C.QUIC, fields).select(*tree.columns)
