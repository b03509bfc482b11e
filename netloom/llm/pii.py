"""Personal data: patterns propose spans, checksums confirm them, nearby words
adjust the score. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the four base kinds, in an equivalent form that the
# JVM matches in linear time. A match may only begin where a run begins or where the
# previous match ended, which is where the leftmost match begins anyway; a card
# is a whole run of digits with single separators.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # Only the head is taken: the run after it, in group 1, may hold words behind the IBAN
    # and the next IBAN. A letter or digit that ends no word is part of the group.
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}",
}
#: Length of an IBAN by country, as registered (ISO 13616).
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
    "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
    "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
    "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
BASE = ("email", "ip", "card", "phone")
#: Words that make a kind likelier in the characters before a span, up to the span before.
CONTEXT = {
    "email": r"mail|contact|write|kontakt|correo|courriel",
    "ip": r"\bip\b|address|host|server|login|adresse",
    "card": r"card|visa|master|credit|debit|karte|tarjeta|carte",
    "phone": r"phone|call|tel|mobile|fax|telefon",
    "iban": r"iban|account|bank|konto|cuenta|compte",
}
CONTEXT_CHARS = 48
#: Matches that one fold goes through.
CHUNK = 256
SPANS = "array<struct<kind:string,start:int,end:int,value:string,before:string>>"
#: Confidence of a confirmed span without and with a context word.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.6, 0.9), "iban": (0.9, 1.0)}
#: A span beyond the base kinds is returned from this score on.
LEAST_SCORE = 0.5


def _chunks(values: Column) -> Column:
    """An array cut into arrays of CHUNK values, so that a fold never carries a long one. The
    array is bound first: within the inner lambda it would be computed for each chunk."""

    def cut(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(all_, i, F.lit(CHUNK)))

    return F.transform(F.array(values), cut)[0]


def _found(text: Column, kind: str, gate: Column) -> Column:
    """All matches of a kind as array<struct<kind, start, end, value, before>>; code points,
    end exclusive. The text between matches gives the offsets, first within a chunk of
    matches, then of the chunks; its last characters are ``before``. Of an IBAN, value
    is the run and start and end are those of its head."""
    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1 if kind == "iban" else 0))
    gaps = F.split(text, PATTERNS[kind], -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.char_length(x["gap"])
        end = start + (4 if kind == "iban" else F.char_length(x["value"]))
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before")
        )
        return F.struct(end.alias("pos"), F.concat(acc["spans"], F.array(span)).cast(SPANS).alias("spans"))

    first = F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("spans"))

    def placed(chunks: Column) -> Column:
        begins = F.aggregate(
            chunks,
            F.array(F.lit(0)),
            lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["pos"])),
        )

        def moved(c: Column, by: Column) -> Column:
            return F.transform(c["spans"], lambda s: s.withField("start", s["start"] + by).withField("end", s["end"] + by))

        return F.flatten(F.zip_with(chunks, F.slice(begins, F.lit(1), F.size(chunks)), moved)).cast(SPANS)

    spans = F.transform(F.array(F.transform(_chunks(pairs), lambda c: F.aggregate(c, first, step))), placed)[0]
    return F.when(gate, spans).otherwise(F.array().cast(SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """ISO 7064 remainder of an IBAN: the first four characters go last, letters
    count as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        small = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return F.regexp_like(value, F.lit(rf"^{small}(?:\.{small}){{3}}$"))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "iban":
        whole = F.regexp_like(value, F.lit("^[A-Z0-9 ]*$"))
        return whole & F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(value) == 1)
    return F.lit(True)


def _registered(value: Column) -> Column:
    length = F.length(F.replace(value, F.lit(" "), F.lit("")))
    return (length > 9) & F.contains(F.lit(IBAN_LENGTHS), F.concat(F.left(value, F.lit(2)), length.cast("string")))


def _ibans(runs: Column) -> Column:
    """The IBANs that begin the runs. A run may end one at each of its words; of the ends
    that mod 97 confirms, the one of the country's length counts, else the last. A
    head inside an IBAN begins no further one."""

    def longest(run: Column) -> Column:
        words = F.split(run, " ")
        ends = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))
        kept = F.filter(ends, lambda x: _confirmed("iban", x))
        return F.aggregate(kept, F.lit(""), lambda acc, x: F.when(_registered(x) | ~_registered(acc), x).otherwise(acc))

    def cut(s: Column) -> Column:
        value = longest(s["value"])
        return F.struct(s["kind"], s["start"], (s["start"] + F.char_length(value)).alias("end"), value.alias("value"), s["before"])

    return F.aggregate(
        F.filter(F.transform(runs, cut), lambda s: s["value"] != ""),
        F.struct(F.lit(0).alias("pos"), F.array().cast(SPANS).alias("spans")),
        lambda acc, s: F.when(
            s["start"] >= acc["pos"], F.struct(s["end"].alias("pos"), F.concat(acc["spans"], F.array(s)).cast(SPANS).alias("spans"))
        ).otherwise(acc),
        lambda acc: acc["spans"],
    )


def pii_spans(text: Column) -> Column:
    """The confirmed spans of a text: array<struct<kind, start, end, value, score>>
    by kind, then start. Null text has none."""
    text = F.coalesce(text, F.lit(""))
    digit = F.regexp_like(text, F.lit("[0-9]"))
    gates = {
        "email": F.contains(text, F.lit("@")),
        "ip": F.regexp_like(text, F.lit(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        "card": F.regexp_like(text, F.lit(r"[0-9](?:[ -]?[0-9]){15}")),
        "phone": F.contains(text, F.lit("+")),
        "iban": digit & F.regexp_like(text, F.lit(r"[A-Z]{2}[0-9]{2}")),
    }

    def of(kind: str) -> Column:
        found = _found(text, kind, gates[kind])
        kept = _ibans(found) if kind == "iban" else F.filter(found, lambda s: _confirmed(kind, s["value"]))
        plain, near = SCORES[kind]

        def scored(s: Column) -> Column:
            score = F.when(F.regexp_like(F.lower(s["before"]), F.lit(CONTEXT[kind])), F.lit(near)).otherwise(F.lit(plain))
            return F.struct(s["kind"], s["start"], s["end"], s["value"], score.alias("score"))

        out = F.transform(kept, scored)
        return out if kind in BASE else F.filter(out, lambda s: s["score"] >= LEAST_SCORE)

    return F.concat(*[of(kind) for kind in PATTERNS])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` and ``pii``: the spans of each whole text, in one pass without
    a shuffle. Null text counts as empty; null ids and repeated rows pass through;
    an empty table gives no rows; further columns are ignored. A text of any length is
    searched as a whole, in time in proportion to it and about that to its spans."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).select(
        "doc_id", "text", pii_spans(F.col("text")).alias("pii")
    )


def listing(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``<KIND>``; overlapping spans become one. Spans are
    gone through in chunks, each over the stretch of text that it covers."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def chunk(acc: Column, own: Column) -> Column:
        """``acc`` is where the text is done up to, and what it became."""
        base = acc["pos"]
        reach = F.array_max(F.transform(own, lambda s: s["end"]))

        def inside(piece: Column) -> Column:
            def step(now: Column, s: Column) -> Column:
                joined = F.concat(
                    now["out"], F.substring(piece, now["pos"] - base + 1, s["start"] - now["pos"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")
                )
                return F.when(s["start"] >= now["pos"], F.struct(s["end"].alias("pos"), joined.alias("out"))).otherwise(
                    F.struct(F.greatest(now["pos"], s["end"]).alias("pos"), now["out"].alias("out"))
                )

            first = F.struct(base.alias("pos"), F.lit("").alias("out"))
            return F.aggregate(own, first, step, lambda now: F.struct(now["pos"].alias("pos"), F.concat(acc["out"], F.array(now["out"])).alias("out")))

        piece = F.substring(text, base + 1, F.greatest(reach - base, F.lit(0)))
        return F.transform(F.array(piece), inside)[0]

    return F.aggregate(
        _chunks(ordered),
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")),
        chunk,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["pos"] + 1)),
    )
