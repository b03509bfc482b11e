"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import brute_fingerprint, brute_pii, components, normal  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(9)
    words = {"aa": ["kalo", "mika", "lomi", "kami"], "bb": ["under", "gester", "stund", "genund"]}
    rows = []
    for i in range(120):
        lang = rng.choice(sorted(words))
        text = " ".join(rng.choice(words[lang]) + rng.choice("xyzvw") for _ in range(80))
        if i % 6 == 5:
            text = rows[i - 5][1].replace(" ", "  ", 3)
        if i % 7 == 6:
            text = rows[i - 6][1] + " mail a.b@c.de now"
        rows.append((i, text, lang, "src", len(text)))
    rows += [(500, None, "aa", "src", 0), (501, "12 34", None, None, 5), (3, rows[3][1], rows[3][2], "src", 1)]
    path = str(tmp_path_factory.mktemp("in"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{path}/{k}"
        stage(spark, docs, path).write.parquet(out)
        seen.append((docs.collect(), docs.columns, spark.read.parquet(out).collect(), spark.read.parquet(out).columns))
        docs = spark.read.parquet(out)
    return path, seen


def test_columns_stay_until_the_last(stages):
    for before, names, _, after in stages[1][:-1]:
        assert names == after


def test_language_stage(stages):
    before, _, after, _ = stages[1][0]
    assert sorted(map(tuple, after), key=repr) == sorted((tuple(r) for r in before if r["text"] and any(c.isalpha() for c in r["text"])), key=repr)


def test_exact_stage(stages):
    before, _, after, _ = stages[1][1]
    least = {}
    for r in before:
        key = normal(r["text"])
        least[key] = min(r["doc_id"], least.get(key, r["doc_id"]))
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())


def test_near_stage(stages):
    before, _, after, _ = stages[1][2]
    before = sorted(before, key=lambda r: r["doc_id"])
    roots = components([brute_fingerprint(r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == [before[i]["doc_id"] for i in sorted(set(roots))]


def test_pii_stage(stages):
    before, _, after, _ = stages[1][3]
    assert len(before) == len(after)
    assert any(brute_pii(r["text"]) for r in before)
    for r in after:
        assert not brute_pii(r["text"]) and r["n_chars"] == len(r["text"])


def packed(pieces):
    have = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        have.setdefault(p["doc_id"], []).extend(np.frombuffer(bytes(p["ids"]), "<u4").tolist())
        assert zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
    return have


def tokens(texts):
    from tokenizers import Tokenizer

    from netloom.llm.queries import tokenizer_file

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}


def test_packing_stage(stages):
    before, _, after, _ = stages[1][4]
    assert packed(after) == tokens({r["doc_id"]: r["text"] for r in before})


def brute_redacted(text):
    spans = sorted((s, e, k) for k, s, e in brute_pii(text))
    out, at = "", 0
    for s, e, k in spans:
        if s >= at:
            out += text[at:s] + f"<{k.upper()}>"
        at = max(at, e)
    return out + text[at:]


def test_run(spark, stages):
    """The whole chain against brute force over the table."""
    path, seen = stages
    rows = sorted((r for r in seen[0][0] if r["text"] and any(c.isalpha() for c in r["text"])), key=lambda r: r["doc_id"])
    first = {}
    for r in rows:
        first.setdefault(normal(r["text"]), r)
    rows = sorted(first.values(), key=lambda r: r["doc_id"])
    roots = components([brute_fingerprint(r["text"]) for r in rows])
    kept = {rows[i]["doc_id"]: brute_redacted(rows[i]["text"]) for i in set(roots)}
    got = corpus_pipeline.run(spark, path).collect()
    assert packed(got) == tokens(kept)
    for sequence in {p["sequence_id"] for p in got}:
        own = sorted((p["offset"], p["length"]) for p in got if p["sequence_id"] == sequence)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_columns_of_any_name_keep_their_values(spark):
    names = ["place", "text_sha256", "version", "row", "my col", "key", "norm", "least", "root"]
    rows = [(i, "kalo mika lomi " * (i % 5 + 1), "aa", "src", 5, *(f"{n}{i}" for n in names)) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` string" for n in names)).repartition(2)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns
        found = after.collect()
        assert found and all(r[n] == f"{n}{r['doc_id']}" for r in found for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 12


def test_near_stage_keeps_one_row_of_null_and_repeated_ids(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(4))
    # Case and white space change the text, not the fingerprint.
    rows = [(1, a), (None, a.upper()), (None, a + " "), (None, b), (None, b.upper()), (None, b + "  "), (7, c), (7, c.upper()), (7, d), (7, d), (8, d + " ")]
    docs = spark.createDataFrame([(i, t, "aa", "src", len(t)) for i, t in rows], SCHEMA).repartition(3)
    after = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"].strip().lower()) for r in after), key=repr) == sorted([(1, a), (None, b), (7, c), (7, d)], key=repr)
