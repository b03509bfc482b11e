"""Each operator against a brute-force version, with the awkward rows: nulls, empty and
long texts, ties, repeated rows, an empty table, further columns with clashing names."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from netloom.llm import (
    exact_dedup,
    language_id,
    license_scan,
    packing,
    pii,
    sentencepiece_codec,
    simhash_dedup,
    substring_dedup,
    suffix_dedup,
    vector_search,
)
from netloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_file

# Names that the operators use inside themselves.
SCHEMA = "doc_id long, text string, norm string, h int, key string, place int, version string, spans string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z", "w") for i, t in rows], SCHEMA).repartition(3)


def corpus(seed=1, n=60):
    """Prose with copies, near copies, shared passages, and repetition inside documents."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstuéß", k=rng.randint(1, 8))) for _ in range(120)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 4, 5, 60, 200]))
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage.split()
        if i % 9 == 0 and texts:
            words = texts[rng.randrange(len(texts))].split()
        if i % 7 == 0 and texts:
            words = texts[rng.randrange(len(texts))].split()
            if words:
                words[rng.randrange(len(words))] = "changed"
        if i % 10 == 3:
            words = ["ab", "cd", "ef"] * 60
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    return list(enumerate(texts)) + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, texts[4]), (3, texts[3])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, table(spark, rows).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(spark, docs):
    rows, df = docs
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    want = []
    for i, t in rows:
        ids = groups[normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    for weak in (None, lambda t: F.lit(b"one hash for all")):
        got = [tuple(r) for r in exact_dedup.exact_dedup(df, hash128=weak).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_simhash_dedup(spark, docs):
    rows, df = docs
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = components(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots)), key=repr)
    got = sorted((tuple(r) for r in simhash_dedup.simhash_dedup(df).collect()), key=repr)
    assert got == want
    assert simhash_dedup.simhash_dedup(empty(spark)).count() == 0


def test_ball_hashing_of_dense_fingerprints(spark):
    """Chains, dense balls and buckets that are worked off in parts, against all pairs."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre, 0, (1 << 64) - 1}
    for _ in range(250):
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    for _ in range(60):
        fps.add(rng.getrandbits(64))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    before = simhash_dedup.SORT_VARIANTS
    low = np.array(fps, np.uint64)
    simhash_dedup.SORT_VARIANTS = 20_000
    try:
        a, b = simhash_dedup._link(low, np.zeros(len(fps), np.int64), 64, 2)
    finally:
        simhash_dedup.SORT_VARIANTS = before
    forest = simhash_dedup._forest(len(fps), a, b)
    want = components(fps)
    assert forest.tolist() == want
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    from netloom.llm.common import connected_components

    root = {r["node"]: r["root"] for r in connected_components(links).collect()}
    groups = {}
    for x, w in zip(signed, want):
        groups.setdefault(w, set()).add(root.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_substring_dedup(spark, docs):
    rows, df = docs
    largest = 1 << 63
    words = [(largest if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    for length in (50, 8):
        least = {}
        for place, _, w in words:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                least[key] = min(place, least.get(key, place))
        want = []
        for place, i, w in words:
            hit = set()
            for k in range(len(w) - length + 1):
                if least[tuple(w[k : k + length])] < place:
                    hit |= set(range(k, k + length))
            want.append((i, len(w), len(hit), b" ".join(x for k, x in enumerate(w) if k not in hit).decode()))
        for bits in (None, 16):
            got = [tuple(r) for r in substring_dedup.substring_dedup(df, length, sketch_bits=bits).collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(suffix_dedup, "TRANSFORM_BYTES", 3000)
    rows, df = docs
    for length in (400, 40):
        data = [(i, (t or "").encode()) for i, t in rows]
        count = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
        want = []
        for i, b in data:
            hit = np.zeros(len(b) + 1, bool)
            for k in range(len(b) - length + 1):
                if count[b[k : k + length]] > 1:
                    hit[k : k + length] = True
            runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
            want.append((i, len(b), int(hit.sum()), runs, bytes(c for c, h in zip(b, hit) if not h)))
        got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffix_dedup.suffix_dedup(df, length).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(empty(spark)).count() == 0


def test_interval_expansion_gives_common_prefixes():
    rng = np.random.default_rng(3)
    for least in (1, 3, 7):
        x = np.concatenate([rng.integers(5, 8, 200), [0], rng.integers(5, 8, 150), [1]]).astype(np.uint16)
        order, classes = suffix_dedup.common_prefix_classes(x, least)
        suffixes = [tuple(x[i:]) for i in order]
        assert suffixes == sorted(suffixes)
        for row in range(1, len(x)):
            same = suffixes[row][:least] == suffixes[row - 1][:least] and min(map(len, suffixes[row - 1 : row + 1])) >= least
            assert same == (classes[row] == classes[row - 1])


def test_language_id(spark):
    rng = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ster", "und", "gen"], "cc": ["éo", "ña", "mi"]}

    def prose(lang):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(40))

    rows = [(i, prose(lang := rng.choice(sorted(syllables))), lang) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (None, prose("aa"), None), (1003, "KALOMI KALO", None), (1003, "KALOMI KALO", None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    fitted = language_id.fit(df)
    assert fitted.languages == sorted(fitted.languages, key=lambda x: -Counter(l for i, t, l in rows if i is not None and t is not None and l and zlib.crc32(str(i).encode()) % 3 != 1)[x])
    got = language_id.predict(df, fitted).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, t, lang in rows if i is not None and i < 1000}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert by[1000]["score"] == 0
    none = df.limit(0)
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.predict(unlabelled, language_id.fit(unlabelled)).collect()} == {"und"}
    carried = language_id.predict(df, fitted, carry=True).select("row.*")
    assert sorted(map(tuple, carried.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_bit_sliced_filter_false_positive_rate():
    cells = np.zeros(1 << language_id.CELL_BITS, np.int64)
    cells[: len(cells) // 2] = 1
    rates = language_id.LanguageFilter(["x"], cells).false_positive_rates()
    assert rates[0] == pytest.approx(0.5**language_id.HASHES)


def test_sentencepiece_matches_the_library_and_round_trips(spark, docs):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = tokenizer_file("piece_bpe_32k.model")
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the library's own Viterbi, over the same pieces and scores
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    rows, df = docs
    extra = table(spark, [(900, "  two  spaces "), (901, "emoji 🙂 and 中文 text\n\ttabs"), (902, "x" * 5000), (903, "Hello, world!")])
    done = sentencepiece_codec.decode(sentencepiece_codec.encode(df.union(extra), path), path).collect()
    assert len(done) == len(rows) + 4
    for r in done:
        assert r["decoded"] == r["text"]
        # The library sums in single precision, so long texts may be cut otherwise there.
        if r["doc_id"] not in (901,) and len(r["text"]) < 400:
            assert r["ids"] == library.encode(r["text"]), r["text"]
    assert sentencepiece_codec.encode(empty(spark), path).count() == 0


def test_sentencepiece_against_a_plain_viterbi(spark):
    """Whole texts of the table, however long, as one string each: no segmentation scores better."""
    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece_codec.Model(path)
    longest = max(map(len, model.pieces))
    score = {i: x for x, i in model.pieces.values()}
    extra = table(spark, [(900, "  two  spaces "), (901, "emoji 🙂 and 中文 text\n\ttabs"), (902, "x" * 5000), (903, None), (904, "")])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(extra.select("doc_id", "text"))
    rows = sentencepiece_codec.encode(docs, path).collect()
    assert len(rows) == 205
    for r in rows:
        text = model.prefix + (r["text"] or "").replace(" ", sentencepiece_codec.SPACE) if r["text"] else ""
        best = [0.0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            known = [best[s] + model.pieces[text[s:end]][0] for s in range(max(0, end - longest), end) if text[s:end] in model.pieces]
            best[end] = max(known, default=-float("inf"))
            if text[end - 1] not in model.pieces:
                best[end] = max(best[end], best[end - 1] + model.worst)
        # A character that is no piece is its bytes, of which the first is no continuation.
        heads = sum(1 for i in r["ids"] or [] if i not in score and model.surface[i][0] & 0xC0 != 0x80)
        assert sum(score.get(i, 0.0) for i in r["ids"] or []) + heads * model.worst == pytest.approx(best[-1], rel=1e-9), r["doc_id"]


def test_shared_prefixes_change_nothing():
    class Toy:
        pieces = {"a": (-1.0, 1), "ab": (-1.5, 2), "abc": (-5.0, 3), "c": (-1.0, 4), "bc": (-1.1, 5), "b": (-2.0, 6)}
        endings, worst = {"a", "ab", "abc", "b", "bc", "c"}, -15.0

        @staticmethod
        def fallback(char):
            return [100 + ord(char)]

    words = ["abc", "abcz", "ab", "abab", "zab", "c", ""]
    together = sentencepiece_codec.encode_words(words, Toy)
    assert together == {w: sentencepiece_codec.encode_words([w], Toy)[w] for w in words}
    assert together["abc"] == [1, 5]


def test_words_walked_together_and_alone():
    """Words of all kinds are cut by the walk of many words at once as they are one by one,
    with less than a fifth of its calls of Python functions."""
    model = sentencepiece_codec.Model(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(5)
    chars = [*"aeinrst▁▁=-.\n\t0123🙂中文éß\0", *rng.sample(list(model.pieces), 200)]
    words = {"".join(rng.choices(chars, k=rng.randint(0, 12))) for _ in range(20_000)} | {"a" * 63, "a" * 64, "a" * 65, "\0", "a\0", "中" * 80}
    alone = {w: np.array(ids, np.int32).tobytes() for w, ids in sentencepiece_codec.encode_words(words, model).items()}
    assert sentencepiece_codec.encode_new(words, model) == alone
    assert sentencepiece_codec.encode_new([], model) == {}
    calls = [0, 0]

    def count(frame, event, arg):
        calls[which] += event in ("call", "c_call")

    short = [w for w in words if len(w) <= sentencepiece_codec.KEPT_LENGTH]
    for which, walk in enumerate((sentencepiece_codec.encode_words, sentencepiece_codec.encode_new)):
        sys.setprofile(count)
        walk(short, model)
        sys.setprofile(None)
    assert calls[1] < calls[0] / 5, calls


def test_decoded_lists_of_ids():
    surface = pa.array([b"", b" a", b" ", "é".encode()[:1], "é".encode()[1:], b"b"], pa.binary())
    lists = [[1, 5], None, [], [3], [4], [2], [2, 2, 3, 4], [0, 1], [1], [0]]
    ids = pa.array(lists, pa.list_(pa.int32()))
    want = ["ab", None, "", "\ufffd", "\ufffd", "", " é", "a", "a", ""]
    assert sentencepiece_codec.joined(surface, ids, True).to_pylist() == want
    assert sentencepiece_codec.joined(surface, ids.slice(4, 4), True).to_pylist() == want[4:8]
    assert sentencepiece_codec.joined(surface, ids.slice(1, 2), False).to_pylist() == [None, ""]
    assert sentencepiece_codec.joined(surface, pa.array([[1], [3, 4]]), False).to_pylist() == [" a", "é"]
    for wrong in ([6], [-1], [None]):
        with pytest.raises((IndexError, ValueError)):
            sentencepiece_codec.joined(surface, pa.array([wrong], pa.list_(pa.int32())), True)


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the Software without restriction, including without limitation\nthe rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and\nto permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    cases = {
        1: ("Prose. Released under the MIT License. More.", ["MIT"]),
        2: ("x\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", ["CC-BY-NC-4.0", "All-Rights-Reserved"]),
        3: ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        4: ("Licensed under the Apache License, Version 2.0. ALL\nRIGHTS\nRESERVED.", ["Apache-2.0", "All-Rights-Reserved"]),
        5: (mit, ["MIT"]),
        6: ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ["UNKNOWN"]),
        7: ("They licensed a song; free warranty.", []),
        8: (None, []),
        9: ("", []),
    }
    df = table(spark, [(i, t) for i, (t, _) in cases.items()] + [(1, cases[1][0])])
    got = license_scan.scan_licences(df).collect()
    assert len(got) == len(cases) + 1
    assert all(r["licences"] == cases[r["doc_id"]][1] for r in got)
    assert license_scan.scan_licences(empty(spark)).count() == 0
    assert all(any(c in s for c in license_scan.CUES) for s in license_scan.SENTENCES)
    known = {*license_scan.SENTENCES.values(), *license_scan.NAMES.values()}
    assert all(p.rstrip("?") in known for rule, _ in license_scan.RULES for p in rule.split())


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [(800, "a\n \nb  c   d"), (801, " x "), (802, "tail  "), (803, "<|endoftext|> inside<|endoftext|>"), (804, "word " * 3000), (805, "\t \n x  y  z")]
    rows = [r for r in docs[0] if r[0] not in (3,)] + odd
    df = table(spark, rows)
    pieces = packing.pack(df, path).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    have, sequences = {}, {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        ids = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        assert p["start"] == len(have.setdefault(p["doc_id"], []))
        assert len(ids) == p["length"] and zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
        assert p["doc_tokens"] == len(want[p["doc_id"]])
        have[p["doc_id"]] += ids
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert have == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024
    repeated = packing.pack(table(spark, [(1, "a b"), (1, "a b"), (None, None)]), path).collect()
    assert sorted((str(p["doc_id"]), p["doc_tokens"]) for p in repeated if p["start"] == 0) == [("1", 3), ("1", 3), ("None", 1)]
    assert packing.pack(empty(spark), path).count() == 0


def test_hilbert_keys_walk_the_grid():
    side = np.arange(8)
    points = np.array([(x, y, z) for x in side for y in side for z in side])
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    walk = points[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_vector_search(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((20, 16))
    v = (centres[rng.integers(0, 20, 1500)] + 0.4 * rng.standard_normal((1500, 16))).astype(np.float32)
    v[100:400] = v[100]  # many copies: ties go to smaller ids
    rows = [(i, x.tolist(), 0.0) for i, x in enumerate(v)]
    bad = [(2000, None, 0.0), (2050, [0.0] * 16, 0.0), (2100, [float("nan")] * 16, 0.0), (2150, [None] * 16, 0.0), (2200, [1.0] * 3, 0.0), (2250, [], 0.0), (None, v[0].tolist(), 0.0), (7, v[7].tolist(), 0.0)]
    schema = "vec_id long, embedding array<float>, score double"
    got = {}
    for r in vector_search.nearest(spark.createDataFrame(rows + bad, schema)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 50))
    x = v.astype(np.float64)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        s = np.array([np.sum(x[i] * x[q]) / np.sqrt(np.sum(x[i] ** 2) * np.sum(x[q] ** 2)) for i in range(len(x))])
        assert all(abs(s[i] - score) < 1e-12 for _, i, score in found)
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:5]
        if 100 <= q < 400:
            assert [f[1] for f in found] == [i for i in range(100, 107) if i != q][:5]
        hits += len({f[1] for f in found} & set(order))
    assert hits / (5 * len(got)) >= 0.9
    few = vector_search.nearest(spark.createDataFrame(rows[:3], schema)).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few)] == [(0, 1), (0, 2)]
    assert vector_search.nearest(spark.createDataFrame([], schema)).count() == 0
    assert vector_search.nearest(spark.createDataFrame(bad[:4], schema)).count() == 0


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii(spark):
    rng = random.Random(8)
    pieces = ["a.b@c.de", "x@y", "@", "_p@q.r.", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "010.000255.1.2", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "00000000000000000000", "+1 (555) 010-2020", "+49", "+1234567", "+1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "é", "🙂", " ", "-", ".", "1", "card", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 33"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 14))) for _ in range(600)]
    texts += ["1 " * 20000, "a" * 50000 + "@b.cc", "a@b." * 500, "9" * 40000, "+" + "1-" * 3000 + "1", None, "", "my iban: GB82 WEST 1234 5698 7654 32."]
    df = table(spark, list(enumerate(texts)) + [(0, texts[0]), (None, "a@b.cd")])
    rows = pii.find_pii(df).withColumn("clean", pii.redacted(F.col("text"), F.col("pii"))).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = "a@b.cd" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        spans = [(s["kind"], s["start"], s["end"]) for s in r["pii"]]
        assert [s for s in spans if s[0] in pii.BASE] == brute_pii(t)
        for s in r["pii"]:
            assert t[s["start"] : s["end"]] == s["value"] and 0 <= s["score"] <= 1
        out, at = [], 0
        for start, end, kind in sorted((s, e, k) for k, s, e in spans):
            if start >= at:
                out += [t[at:start], f"<{kind.upper()}>"]
            at = max(at, end)
        assert r["clean"] == "".join(out) + t[at:]
    ibans = {s["value"] for r in rows for s in r["pii"] if s["kind"] == "iban"}
    assert "GB82 WEST 1234 5698 7654 32" in ibans and "GB82 WEST 1234 5698 7654 33" not in ibans
    near = next(s for r in rows if r["text"].startswith("my iban") for s in r["pii"] if s["kind"] == "iban")
    assert near["score"] == pii.SCORES["iban"][1]
    assert pii.find_pii(empty(spark)).count() == 0


def test_ibans_before_capitals_and_digits(spark):
    de, gb, no, mt = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    cases = [
        (f"{de} Please send", [de]),
        (f"{de} BIC COBADEFF", [de]),
        (f"{de} 2024 500 EUR", [de]),
        (f"{de} A {gb} B 12 {no} {mt} Next", [de, gb, no, mt]),
        (f"{de} {gb} {no}", [de, gb, no]),
        (f"é🙂 {gb} AND MORE", [gb]),
        (f"{no} 1 2 3 X", [no]),
        (f"{mt}x {mt}0 {de}x {de}00000000000000 DE88370400440532013000 Please", []),
        # Beyond the registered length the whole run passes mod 97, too.
        (f"{de} {next(n for n in range(10, 108) if int('370400440532013000' + str(n) + '131489') % 97 == 1)}", [de]),
        # A country outside the register: the last end that passes.
        ("XX57 1234 5678 9012 345 Ends", ["XX57 1234 5678 9012 345"]),
    ]
    for r in pii.find_pii(table(spark, list(enumerate(t for t, _ in cases)))).collect():
        text, want = cases[r["doc_id"]]
        found = [s for s in r["pii"] if s["kind"] == "iban"]
        assert [s["value"] for s in found] == want, text
        assert all(text[s["start"] : s["end"]] == s["value"] for s in found)


def test_licence_sentences_over_many_lines():
    for sentence, identifier in license_scan.SENTENCES.items():
        words = sentence.replace("*", "acme inc").split()
        for step in (1, 2, 5):
            lines = "\n".join(f"# {' '.join(words[i : i + step])}" for i in range(0, len(words), step))
            assert license_scan.sentence_ids(f"Permission\nis given.\n{lines}\nand so on") == [identifier], sentence
    grant = next(s for s, i in license_scan.SENTENCES.items() if i == "mit-grant")
    notice = next(s for s, i in license_scan.SENTENCES.items() if i == "mit-notice")
    ids = license_scan.sentence_ids("\n".join(f"{grant}. {notice}".split()))
    assert license_scan.matched_licences(ids) == ["MIT"]


def test_rare_languages_and_many_languages(spark):
    rng = random.Random(5)
    names = [f"l{i:03d}" for i in range(130)]
    syllables = {x: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(12)] for x in names}

    def prose(lang):
        return " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(30))

    many = [(i, prose(x), x) for i, x in enumerate(names * 9)]
    large = [(i, prose("l000"), "l000") for i in range(10_000, 12_000)]
    df = spark.createDataFrame(many + large, "doc_id long, text string, lang string")
    fitted = language_id.fit(df, quota=100)
    assert fitted.languages[0] == "l000" and sorted(fitted.languages) == names
    truth = {i: x for i, _, x in many + large}
    held = [r for r in language_id.predict(df, fitted).collect() if r["held_out"]]
    rare = [r for r in held if truth[r["doc_id"]] != "l000"]
    assert len(rare) > 300 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rare) / len(rare) > 0.95
    assert sum(r["lang_pred"] == "l000" for r in held if truth[r["doc_id"]] == "l000") > 600


def test_hot_anchors_and_hot_rows(spark, monkeypatch):
    """One anchor with many classes, dealt out two a task, and one row many times."""
    monkeypatch.setattr(substring_dedup, "CLASSES", 2)
    rng = random.Random(11)
    passage = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*rng.choices("abcdefgh", k=rng.randint(0, 30)), *passage, *rng.choices("abcdefgh", k=rng.randint(0, 30))])) for i in range(40)]
    rows += [(None, rows[3][1])] * 200 + [(9, rows[9][1])] * 50
    got = substring_dedup.substring_dedup(table(spark, rows)).collect()
    assert len(got) == len(rows)
    removed = {}
    for r in got:
        removed.setdefault(r["doc_id"], set()).add(r["n_removed"])
    assert removed[0] == {0} and all(len(removed[i]) == 1 and min(removed[i]) >= 60 for i in range(1, 40)) and removed[None] == {len(rows[3][1].split())}
    cut = suffix_dedup.suffix_dedup(table(spark, rows), length=100).collect()
    assert {r["n_removed"] for r in cut if r["doc_id"] is None} == {len(rows[3][1])} and len(cut) == len(rows)


def test_planted_passages_of_over_fifty_words(spark):
    """Passages of 51 words and more, planted in pairs of documents: op1 counts words, op10 bytes from 400 on."""
    rng = random.Random(29)

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))

    def passage(words, size):
        text = f" {prose(words)} "
        return text[: size - 1] + " " if len(text) >= size else text[:-1] + "x" * (size - len(text)) + " "

    planted = [passage(51, 360), passage(55, 399), passage(55, 400), passage(51, 401), passage(120, 900)]
    assert all(len(p.split()) > 50 for p in planted)
    rows = [(i, prose(90)) for i in range(20)]
    for i, p in enumerate(planted):
        rows += [(100 + i, f"{prose(40)}1{p}2{prose(70)}"), (200 + i, f"{prose(70)}3{p}4{prose(40)}")]
    rows.append((300, f"{prose(20)}5{planted[2]}6{prose(20)}7{planted[2]}8{prose(20)}"))
    found = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(table(spark, rows)).collect()}
    want = {i: (len(t), 0, 0) for i, t in rows}
    for i, p in enumerate(planted):
        for place in (100 + i, 200 + i):
            want[place] = (len(dict(rows)[place]), len(p), 1) if len(p) >= 400 else want[place]
    want[300] = (len(rows[-1][1]), 800, 2)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"]) for i, r in found.items()} == want
    assert all(bytes(found[i]["kept"]).decode() == t for i, t in rows if not want[i][1])
    words = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert words == {i: 0 for i, _ in rows} | {200 + i: len(p.split()) for i, p in enumerate(planted)} | {300: 110}


def test_long_texts_cross_blocks(spark):
    """Texts above one block of 4 MB, alone and beside short ones."""
    rng = np.random.default_rng(8)

    def prose(n):
        return " ".join(map("".join, np.array(list("abcdefghijklmnopqrstuvwxyz"))[rng.integers(0, 26, (n, 7))].tolist()))

    passage = prose(80)
    long = prose(350_000) + "1 " + passage + " 2" + prose(350_000) + "3 " + passage
    rows = [(1, passage), (2, long), (3, prose(20)), (4, prose(30) + "4 " + passage + " 5" + prose(30))]
    df = table(spark, rows)
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(df).collect()}
    assert removed == {1: 0, 2: 160, 3: 0, 4: 80}
    cut_off = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.suffix_dedup(df).collect()}
    size = len(passage)
    # A space stands before the passage in three places and behind it in two.
    assert cut_off[1] == (size, 1) and cut_off[2] == (2 * size + 3, 2) and cut_off[3] == (0, 0) and cut_off[4] == (size + 2, 1)
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(df.union(table(spark, [(9, long)]))).collect()}
    assert got[9] == 2
    marks = {r["doc_id"]: r["fingerprint"] for r in simhash_dedup.simhash_dedup(df).collect()}
    assert marks[2] == f"{brute_fingerprint(long):016x}"
    mail = table(spark, [(5, long + " write to a.b@example.org " + long), (6, "Licensed under the MIT License. " + long + ". All rights reserved.")])
    found = {r["doc_id"]: r["pii"] for r in pii.find_pii(mail).collect()}
    assert [(s["kind"], s["start"]) for s in found[5]] == [("email", len(long) + 10)] and not found[6]
    assert {r["doc_id"]: r["licences"] for r in license_scan.scan_licences(mail).collect()} == {5: [], 6: ["MIT", "All-Rights-Reserved"]}


def test_language_masks_and_scores_by_brute_force(spark):
    rng = random.Random(5)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["ster", "und", "mi"], "cc": ["éo", "ña", "lo"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[l], k=2)) for _ in range(rng.randint(0, 12))), l) for i in range(250) for l in [rng.choice("abc") * 2]]
    rows += [(900, "kalo! 7 UND ñaéo", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
        padded = b" " + data + b" "
        return [g for g in (padded[i : i + 4] for i in range(len(padded) - 3)) if g != b"    "]

    train = [(t, l) for i, t, l in rows if l and zlib.crc32(str(i).encode()) % 3 != 1]
    size = Counter(l for _, l in train)
    languages = sorted(size, key=lambda l: (-size[l], l))
    counts = {l: Counter(g for t, x in train if x == l for g in set(grams(t))) for l in languages}
    share = {l: {g: n / size[l] for g, n in counts[l].items() if n > 1 and n / size[l] >= language_id.LEAST_SHARE} for l in languages}
    cells = np.zeros(1 << language_id.CELL_BITS, np.int64)
    seeds = [int(s) for s in language_id._SEEDS[: language_id.HASHES]]

    def places(gram):
        return [(int.from_bytes(gram, "little") * s % (1 << 64)) >> (64 - language_id.CELL_BITS) for s in seeds]

    for g in {g for l in languages for g in share[l]}:
        best = max(share[l].get(g, 0) for l in languages)
        for bit, l in enumerate(languages):
            if share[l].get(g, 0) >= language_id.LEAST_RATIO * best and g in share[l]:
                for at in places(g):
                    cells[at] |= 1 << bit
    fitted = language_id.fit(df)
    assert fitted.languages == languages and np.array_equal(fitted.cells[0], cells)
    false = [float(np.mean(cells >> b & 1)) ** language_id.HASHES for b in range(len(languages))]
    got = {r["doc_id"]: r for r in language_id.predict(df, fitted).collect()}
    for i, text, _ in rows:
        all_ = grams(text)
        hits = [sum(all(cells[p] >> b & 1 for p in places(g)) for g in all_) / max(1, len(all_)) for b in range(len(languages))]
        scores = [min(1, max(0, (h - f) / (1 - f))) for h, f in zip(hits, false)]
        letter = any(c.isalpha() for c in text)
        assert got[i]["lang_pred"] == (languages[scores.index(max(scores))] if letter else "und")
        assert got[i]["score"] == pytest.approx(max(scores) if letter else 0)


def test_licences_by_brute_force():
    """Every run of pieces is tried as a sentence, the shortest first."""
    rng = random.Random(6)
    known, names = license_scan.SENTENCES, license_scan.NAMES
    words = ["the", "code", "mit", "license", "under", "licensed", "free", "of"]

    def brute(text):
        pieces = [" ".join(re.findall("[0-9a-z]+", p.lower())) for p in re.split(r"(?<=[.!?:;])\s+|\n+", text)]
        pieces, out, at = [p for p in pieces if p], [], 0

        def granted(s):
            out, at = [], 0
            while found := [(m.start(), m.start(1), -len(n), m.end(), n) for n in names for m in [re.compile(license_scan.GRANT + f"({n})" + r"\b").search(s, at)] if m]:
                *_, at, name = min(found)
                before = s[: min(found)[0]].split()[-3:] + s[min(found)[0] : min(found)[1]].split()
                out += [names[name]] if not license_scan.DENIALS & set(before) else []
            return out

        def sentence(s):
            for k, i in known.items():
                head, star, tail = k.partition(" * ")
                inner = len(s.split()) - len(k.split()) + 1
                if s == k or (star and s.startswith(head + " ") and s.endswith(" " + tail) and 1 <= inner <= license_scan.MOST_VARIABLE):
                    return i

        while at < len(pieces):
            runs = [(n, sentence(" ".join(pieces[at : at + n]))) for n in range(1, len(pieces) - at + 1)]
            n, found = next(((n, [f]) for n, f in runs if f), (1, []))
            if not found and not (found := granted(pieces[at])):
                after = pieces[at + 1 : at + 2]
                if after and not granted(after[0]) and not sentence(after[0]) and (found := granted(" ".join(pieces[at : at + 2]))):
                    n = 2
            out += found
            at += n if found else 1
        return out

    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 6)):
            sentence = rng.choice([rng.choice(sorted(known)), " ".join(rng.choices(words, k=rng.randint(1, 7))), f"this is released under the {rng.choice(sorted(names))} today"])
            pieces = sentence.replace("*", " ".join(rng.choices(["acme", "inc", "the", "code"], k=rng.randint(1, 5)))).split()
            for k in range(len(pieces) - 1):
                pieces[k] += "\n" if rng.random() < 0.1 else " "
            parts.append("".join(pieces) + rng.choice([". ", "\n", "; ", " "]))
        text = "".join(parts)
        assert license_scan.sentence_ids(text) == brute(text), text
    assert license_scan.sentence_ids("// SPDX-License-Identifier: MIT OR  Apache-2.0\ncode") == ["spdx:MIT OR Apache-2.0"]
    assert license_scan.matched_licences(["spdx:MIT OR Apache-2.0", "mit-ref"]) == ["MIT OR Apache-2.0", "MIT"]


LICENCE_FILES = {
    "attrs": {"MIT"}, "pip": {"MIT"}, "pytest": {"MIT"}, "pyyaml": {"MIT"}, "urllib3": {"MIT"}, "certifi": {"MPL-2.0"}, "hypothesis": {"MPL-2.0"}, "idna": {"BSD-3-Clause"},
    "protobuf": {"BSD-3-Clause"}, "psutil": {"BSD-3-Clause"}, "py4j": {"BSD-3-Clause"}, "pyahocorasick": {"BSD-3-Clause"}, "zstandard": {"BSD-3-Clause"},
    "pygments": {"BSD-2-Clause"}, "xxhash": {"BSD-2-Clause"}, "requests": {"Apache-2.0"}, "sortedcontainers": {"Apache-2.0"},
    "packaging": {"Apache-2.0", "BSD-2-Clause"}, "python-dateutil": {"Apache-2.0", "BSD-3-Clause"},
}


def test_licence_files_of_installed_packages(spark):
    from importlib.metadata import PackageNotFoundError, distribution

    rows, names = [], {}
    for name in LICENCE_FILES:
        try:
            files = distribution(name).files or []
        except PackageNotFoundError:
            continue
        for f in files:
            if "licen" in f.name.lower() and f.locate().is_file() and not f.name.endswith((".py", ".pyc")):
                names[len(rows)] = name
                rows.append((len(rows), f.locate().read_text(encoding="utf-8", errors="replace")))
    got = {}
    for r in license_scan.scan_licences(table(spark, rows)).collect():
        got.setdefault(names[r["doc_id"]], set()).update(r["licences"])
    assert got and {n: x - {"All-Rights-Reserved"} for n, x in got.items()} == {n: LICENCE_FILES[n] for n in got}


def test_licences_denied_tagged_and_titled():
    ids = license_scan.sentence_ids
    for text in ("not licensed under the MIT License", "It is no longer released under the terms of the MIT License.", "Isn't licensed under the ISC License", "available, but not under the MIT License"):
        assert ids(text) == [], text
    assert ids("This is licensed under the MIT License, not under another") == ["mit-ref"]
    assert ids("# SPDX-License-Identifier: (MIT OR Apache-2.0) and more") == ["spdx:(MIT OR Apache-2.0)"]
    assert ids("(SPDX-License-Identifier: ISC)") == ["spdx:ISC"] and ids("SPDX-License-Identifier: MIT or later") == ["spdx:MIT"]
    assert ids("SPDX-License-Identifier: GPL-2.0-only WITH x-1.0 AND ( MIT OR (ISC) )") == ["spdx:GPL-2.0-only WITH x-1.0 AND (MIT OR (ISC))"]
    title = "   GNU LESSER GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n Copyright"
    assert license_scan.matched_licences(ids(title)) == ["LGPL-3.0-only"]
    clause = "Neither the name of {} nor the names of its\n contributors may be used to endorse or promote products derived from this\nsoftware without specific prior written permission."
    assert ids("3) " + clause.format("Acme Inc.")) == ["bsd-endorse"] and ids(clause.format("x " * 57)) == [] and ids(clause.format("x " * 54)) == ["bsd-endorse"]


def test_licence_tables_of_the_caller(spark):
    df = table(spark, [(1, "Use it well. Or not."), (2, "Shared under the house terms."), (3, "MIT License")])
    got = license_scan.scan_licences(df, sentences={"use it well": "well"}, names={"house terms": "house"}, rules=[("well", "W"), ("house", "H")])
    assert {r["doc_id"]: r["licences"] for r in got.collect()} == {1: ["W"], 2: ["H"], 3: []}


def test_long_runs_of_white_space_are_tokenised(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    texts = [" " * 3_000_000, "a" + "\n" * 1_000_000 + "b", "x " * 20_000, "y" * 100_000]
    encode, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    for text, ids in zip(texts, encode(texts)):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    pieces = packing.pack(table(spark, list(enumerate(texts))), path).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 0) == 3_000_001


def test_texts_without_spaces_are_not_kept(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh", k=300_000))
    done = sentencepiece_codec.decode(sentencepiece_codec.encode(table(spark, [(1, text)]), path), path).collect()
    assert done[0]["decoded"] == text
    known = sentencepiece_codec.Known()
    new = {"short": b"1234", text: b"1" * 400}
    known.update(new)
    known.settle(new)
    assert list(known) == ["short"] and known.size < 1000
    known.size = sentencepiece_codec.CACHE_BYTES
    known.update(next=b"1234")
    known.settle({"next": b"1234"})
    assert not known and known.size == 0


def test_helper_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "kalo", "aa", "p")], "doc_id long, text string, lang string, `my col` string")
    assert language_id.predict(df, language_id.fit(df), carry=True).select("row.*").columns == df.columns
    encoded = sentencepiece_codec.encode(df, tokenizer_file("piece_bpe_32k.model")).withColumn("my.col", F.lit(1))
    assert sentencepiece_codec.decode(encoded, tokenizer_file("piece_bpe_32k.model")).first()[-2] == 1


def test_very_many_spans_of_one_text(spark):
    """More spans than several chunks hold, overlapping ones among them."""
    text = "".join(f"ip {i % 256}.1.2.{i % 300} mail a{i}@b.org tel +49 30 {i:06d}, card 4111 1111 1111 1111. " for i in range(4000))
    got = pii.find_pii(table(spark, [(1, text), (2, "x")])).withColumn("clean", pii.redacted(F.col("text"), F.col("pii"))).collect()
    row = next(r for r in got if r["doc_id"] == 1)
    spans = [(s["kind"], s["start"], s["end"]) for s in row["pii"]]
    assert [s for s in spans if s[0] in pii.BASE] == brute_pii(text) and len(spans) > 10_000
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    assert row["clean"] == "".join(out) + text[at:]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{sf}/{name_}.parquet'")
    found = QUERIES[name](spark, sf)
    columns = sorted(found.columns)
    result = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == want
