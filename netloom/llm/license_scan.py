"""Licence recognition: sentences to identifiers, identifier sequences to licences."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

# Sentences of public licences and notices in normalised form, with the
# identifier that stands for each. A star stands for one to ``MOST_VARIABLE`` words, as of a name.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "this work is licensed under the apache license version 2 0": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this software is released under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name * may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the name of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "apache license version 2 0 january 2004": "apache2-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "gnu free documentation license version 1 3 3 november 2008": "gfdl13-title",
    "mozilla public license version 2 0": "mpl2-title",
    "creative commons legal code cc0 1 0 universal": "cc0-title",
    "cc0 1 0 universal": "cc0-title",
    "the artistic license 2 0": "artistic2-title",
    "artistic license 2 0": "artistic2-title",
    "eclipse public license v 2 0": "epl2-title",
    "boost software license version 1 0 august 17th 2003": "bsl-title",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-ref",
    "if a copy of the mpl was not distributed with this file you can obtain one at": "mpl2-copy",
    "licensed under cc by nc 4 0": "cc-by-nc4-ref",
    "licensed under cc by 4 0": "cc-by4-ref",
    "licensed under cc by sa 4 0": "cc-by-sa4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa4-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "all rights reserved": "reserved",
}
#: Names of licences as a sentence of any other wording may grant them, in normalised form.
NAMES = {
    "mit license": "mit-ref", "apache license version 2 0": "apache2-ref", "apache license 2 0": "apache2-ref", "apache 2 0 license": "apache2-ref",
    "bsd 2 clause license": "bsd2-ref", "bsd 3 clause license": "bsd3-ref", "2 clause bsd license": "bsd2-ref", "3 clause bsd license": "bsd3-ref",
    "isc license": "isc-ref", "zlib license": "zlib-ref", "boost software license version 1 0": "bsl-ref", "boost software license": "bsl-ref",
    "gnu general public license version 2": "gpl2-ref", "gnu general public license version 3": "gpl3-ref", "gnu gpl version 2": "gpl2-ref",
    "gnu gpl version 3": "gpl3-ref", "gnu affero general public license version 3": "agpl3-ref", "mozilla public license version 2 0": "mpl2-ref",
    "mozilla public license 2 0": "mpl2-ref", "cc by 4 0": "cc-by4-ref", "cc by sa 4 0": "cc-by-sa4-ref", "cc by nc 4 0": "cc-by-nc4-ref",
    "creative commons attribution 4 0 international license": "cc-by4-ref", "creative commons zero v1 0 universal": "cc0-ref", "cc0 1 0": "cc0-ref",
    "unlicense": "unlicense-grant",
}
#: What a sentence says before such a name when it grants the licence.
GRANT = r"\b(?:licen[sc]ed|released|distributed|available|published|provided|covered|shared)(?: [a-z]+){0,4}? under (?:an? |the )?(?:terms of )?(?:an? |the )?"
#: Rules in the order in which they are tried at a place: an identifier sequence, where
#: ``a?`` may be missing, and the licence it stands for.
RULES = [
    ("apache2-title apache2-ref? apache-comply? apache-copy? apache-warranty? apache-see?", "Apache-2.0"),
    ("gpl2-title", "GPL-2.0-only"),
    ("gpl3-title", "GPL-3.0-only"),
    ("lgpl21-title", "LGPL-2.1-only"),
    ("lgpl3-title", "LGPL-3.0-only"),
    ("agpl3-title", "AGPL-3.0-only"),
    ("gfdl13-title", "GFDL-1.3"),
    ("mpl2-title", "MPL-2.0"),
    ("cc0-title", "CC0-1.0"),
    ("artistic2-title", "Artistic-2.0"),
    ("epl2-title", "EPL-2.0"),
    ("bsl-title bsl-grant?", "BSL-1.0"),
    ("apache2-ref apache-comply apache-copy? apache-warranty? apache-see?", "Apache-2.0"),
    ("apache2-ref", "Apache-2.0"),
    ("mit-grant mit-notice mit-warranty? mit-liability?", "MIT"),
    ("mit-ref", "MIT"),
    ("isc-grant isc-warranty?", "ISC"),
    ("isc-ref", "ISC"),
    ("bsd-grant bsd-source bsd-binary bsd-endorse bsd-warranty?", "BSD-3-Clause"),
    ("bsd-grant bsd-source bsd-binary bsd-warranty?", "BSD-2-Clause"),
    ("bsd3-ref", "BSD-3-Clause"),
    ("bsd2-ref", "BSD-2-Clause"),
    ("zlib-warranty zlib-grant zlib-origin zlib-altered zlib-notice?", "Zlib"),
    ("zlib-ref", "Zlib"),
    ("bsl-grant", "BSL-1.0"),
    ("bsl-ref", "BSL-1.0"),
    ("agpl3-later gpl-warranty?", "AGPL-3.0-or-later"),
    ("agpl3-ref", "AGPL-3.0-only"),
    ("lgpl3-later gpl-warranty?", "LGPL-3.0-or-later"),
    ("gpl3-later gpl-warranty?", "GPL-3.0-or-later"),
    ("gpl2-later gpl-warranty?", "GPL-2.0-or-later"),
    ("lgpl21-later gpl-warranty?", "LGPL-2.1-or-later"),
    ("gpl3-ref", "GPL-3.0-only"),
    ("gpl2-ref", "GPL-2.0-only"),
    ("mpl2-ref mpl2-copy?", "MPL-2.0"),
    ("cc-by-nc4-ref", "CC-BY-NC-4.0"),
    ("cc-by-sa4-ref", "CC-BY-SA-4.0"),
    ("cc-by4-ref", "CC-BY-4.0"),
    ("cc0-ref", "CC0-1.0"),
    ("unlicense-grant unlicense-free?", "Unlicense"),
    ("reserved", "All-Rights-Reserved"),
]
#: A part of a word in every sentence above and in every grant of a name, in any case; a text without any is done.
CUES = ("licen", "permi", "copyright", "redistribut", "warrant", "free", "mpl", "reserved", "misrepresented", "liab", "notice", "under", "universal", "endorse")
#: Words that a star in a sentence may stand for, and words that take back a grant that they precede.
MOST_VARIABLE = 60
DENIALS = frozenset(("not", "never", "no", "without", "isn", "aren", "wasn", "cannot", "nor", "neither"))
#: How many words before a grant are looked at for one.
DENIED_WITHIN = 3
#: A tag that names its licence; what follows it is one as it stands.
_NAME = r"(?:\([ \t]*)*[A-Za-z0-9.:+-]+(?:[ \t]*\))*"
TAG = re.compile(rf"SPDX-License-Identifier:[ \t]*({_NAME}(?:[ \t]+(?-i:OR|AND|WITH)[ \t]+{_NAME})*)", re.I)
TAGGED = "spdx:"
#: A list marker with a bracket, which ends no sentence.
_MARKER = re.compile(r"^\s*[(\[]?[0-9A-Za-z]{1,2}[)\]]\s")
_SPLIT = re.compile(r"(?<=[.!?:;])\s+|\n+")
_WORD = re.compile(r"[0-9a-z]+")


def normalised_sentence(sentence: str) -> str:
    """Lower case, words and numbers only, single spaces; list markers go."""
    words = _WORD.findall(_MARKER.sub(" ", sentence).lower())
    return " ".join(words)


class Sentences:
    """Known sentences and the names that any sentence may grant, ready to be looked up."""

    def __init__(self, sentences: Mapping[str, str], names: Mapping[str, str]) -> None:
        self.known = {s: i for s, i in sentences.items() if "*" not in s.split()}
        self.names = dict(names)
        # What a known sentence begins with, word by word, up to the whole.
        self.beginnings = {" ".join(s.split()[:n]) for s in self.known for n in range(1, len(s.split()) + 1)}
        # Those with variable parts, by the fixed words before the first.
        self.variable: dict[str, list[tuple[re.Pattern, str]]] = {}
        for sentence, found in sentences.items():
            if "*" in sentence.split():
                head = sentence.split(" *")[0]
                self.variable.setdefault(head, []).append((re.compile(re.escape(sentence).replace(r"\*", rf"[0-9a-z]+(?: [0-9a-z]+){{0,{MOST_VARIABLE - 1}}}")), found))
                self.beginnings |= {" ".join(head.split()[:n]) for n in range(1, len(head.split()) + 1)}
        self.longest = max((len(s.split()) for s in sentences if "*" in s.split()), default=0) + MOST_VARIABLE
        self.grant = re.compile(GRANT + "(" + "|".join(sorted(map(re.escape, self.names), key=len, reverse=True)) + r")\b") if names else None

    def granted(self, sentence: str) -> list[str]:
        """The identifiers of the licence names that a sentence grants, in order. A grant behind or with a
        word of ``DENIALS`` is none."""
        if not self.grant or " under " not in sentence:
            return []

        def denied(m: re.Match) -> bool:
            return not DENIALS.isdisjoint([*sentence[: m.start()].split()[-DENIED_WITHIN:], *sentence[m.start() : m.start(1)].split()])

        return [self.names[m[1]] for m in self.grant.finditer(sentence) if not denied(m)]

    def found(self, sentence: str) -> str | None:
        """The identifier of a known sentence."""
        if exact := self.known.get(sentence):
            return exact
        heads = (h for h in self.variable if sentence.startswith(h))
        return next((i for h in heads for pattern, i in self.variable[h] if pattern.fullmatch(sentence)), None)

    def goes_on(self, joined: str) -> bool:
        """Whether a known sentence may begin so."""
        return joined in self.beginnings or (any(joined.startswith(f"{h} ") for h in self.variable) and joined.count(" ") < self.longest)

    def ids(self, text: str) -> list[str]:
        """Identifiers of the known sentences of a text, in order. A sentence may run over any
        number of line breaks: pieces are joined as long as a known sentence begins with them,
        and the first join that is one counts. A piece that begins none counts if it, or it
        with the piece after it, grants licences by name."""
        out: list[str] = []
        for part, tag in _parts(text):
            pieces = [p for p in (normalised_sentence(s) for s in _SPLIT.split(part)) if p]
            at = 0
            while at < len(pieces):
                joined, to, found = pieces[at], at + 1, self.found(pieces[at])
                while not found and to < len(pieces) and self.goes_on(joined):
                    joined, to = f"{joined} {pieces[to]}", to + 1
                    found = self.found(joined)
                ids = [found] if found else self.granted(pieces[at])
                to = to if found else at + 1
                if not ids and to < len(pieces) and not self.granted(pieces[to]) and not self.found(pieces[to]):
                    ids, to = self.granted(f"{pieces[at]} {pieces[to]}"), at + 2
                out += ids
                at = to if ids else at + 1
            if tag:
                out.append(TAGGED + tag)
        return out


def _parts(text: str) -> Iterator[tuple[str, str | None]]:
    """What stands before each tag, with the tag's licence, and what stands after the last."""
    at = 0
    for m in TAG.finditer(text):
        tag = " ".join(m[1].replace("(", " ( ").replace(")", " ) ").split()).replace("( ", "(").replace(" )", ")")
        while tag.endswith(")") and tag.count(")") > tag.count("("):  # the tag stands in brackets itself
            tag = tag[:-1]
        yield text[at : m.start()], tag
        at = m.end()
    yield text[at:], None


def sentence_ids(text: str) -> list[str]:
    """``Sentences.ids`` of the known ones above."""
    return _DEFAULT.ids(text)


_DEFAULT = Sentences(SENTENCES, NAMES)


def matched_licences(ids: list[str], rules: Sequence[tuple[str, str]] = RULES) -> list[str]:
    """Licences of an identifier sequence: at each place the first rule that matches
    takes what it covers; a tag is its own licence; an identifier that no rule begins with is
    ``UNKNOWN``."""
    out, at = [], 0
    while at < len(ids):
        if ids[at].startswith(TAGGED):
            out.append(ids[at].removeprefix(TAGGED))
            at += 1
            continue
        for rule, licence in rules:
            to = at
            for part in rule.split():
                if to < len(ids) and ids[to] == part.rstrip("?"):
                    to += 1
                elif not part.endswith("?"):
                    break
            else:
                out.append(licence)
                at = to
                break
        else:
            out.append("UNKNOWN")
            at += 1
    return out


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: Mapping[str, str] = SENTENCES,
    names: Mapping[str, str] = NAMES, rules: Sequence[tuple[str, str]] = tuple(RULES),
) -> DataFrame:
    """One row per document: ``doc_id, sentences`` (identifiers of the known licence
    sentences, in order) and ``licences`` (what the rules make of the sequence).

    ``sentences`` (normalised, with stars for variable parts, to identifiers), ``names`` (that any sentence may grant) and
    ``rules`` are tables of the caller's, by default those above: reference data that every
    task gets whole, so no corpus.

    One pass without a shuffle over whole texts, however long; those without a cue word never
    leave the JVM if the tables are the default ones. Null and empty texts have neither;
    null ids and repeated rows pass through; an empty table gives no rows; further columns
    are ignored.
    """
    text, known = F.coalesce(docs[text_col], F.lit("")), Sentences(sentences, names)
    own = (dict(sentences), dict(names)) == (SENTENCES, NAMES)
    cue = F.regexp_like(text, F.lit("(?i)" + "|".join(CUES))) if own else F.lit(True)
    source = docs.select(docs[id_col].alias("doc_id"), F.when(cue, text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.string())
        for batch in batches:
            ids = [known.ids(t) if t else [] for t in batch.column(1).to_pylist()]
            found = [matched_licences(x, rules) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, kind), pa.array(found, kind)], ["doc_id", "sentences", "licences"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return short_batches(source).mapInArrow(run, f"doc_id {kind}, sentences array<string>, licences array<string>")
