"""Shards, manifest and resampling against brute force, with the awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netloom.llm import merkle, resampling, sharding
from netloom.llm.ranks import positions

# Names that the operators use inside themselves are further columns here.
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key string, grp int, pos string, shard_ int, buckets string, _tie int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "aa", None, "k", 1, "p", 2, "b", 3) for i, t, s in rows], SCHEMA).repartition(3)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcXYZ09ßé\n_", k=rng.randint(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 19, 20, 60]))), rng.choice(["hot"] * 6 + ["b", "é", "", None])) for i in range(n)]
    hot = [(1000 + i, "the same text\nagain", "hot") for i in range(n // 2)]
    same = [(7, "row that repeats", "hot")] * (n // 2)
    return rows + hot + same + [(2000, None, None), (None, "no id", "b"), (None, None, "b"), (2001, "", "lone"), (2002, "long " * 50_000, "hot")]


def shards_of(rows, n):
    def key(r):
        text, own = r[1] or "", "" if r[0] is None else str(r[0])
        return hashlib.md5(text.encode()).digest(), hashlib.md5(own.encode()).digest()[:8]

    rows = sorted(rows, key=key)
    sizes = [len((r[1] or "").encode()) + 1 for r in rows]
    total, below, out, slots = sum(sizes), 0, [], Counter()
    for r, size in zip(rows, sizes):
        shard = below * n // total
        out.append((r[0], size, zlib.crc32((r[1] or "").encode()), shard, slots[shard]))
        slots[shard] += 1
        below += size
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 2, 16, 700])
def test_shards_by_brute_force(spark, n):
    rows = corpus()
    got = sharding.shard(table(spark, rows), n).collect()
    assert sorted(map(tuple, got), key=repr) == shards_of(rows, n)


def test_shards_in_many_pieces_and_few_probes(spark, monkeypatch):
    """Shards cut into pieces of a kilobyte, bounds refined by two probes a round."""
    monkeypatch.setattr(sharding, "PIECE_BYTES", 1000)
    monkeypatch.setattr(sharding, "PROBES", 2)
    rows = corpus(2)
    got = sharding.shard(table(spark, rows), 3).collect()
    assert sorted(map(tuple, got), key=repr) == shards_of(rows, 3)


def test_shards_within_a_tolerance(spark, monkeypatch):
    rows = [(i, "x" * (i % 50), "s") for i in range(3000)]
    placed = table(spark, rows).select(F.octet_length("text").cast("long").alias("size"), sharding.sort_key(F.col("text"), F.col("doc_id")).alias("key")).persist()
    rounds = []
    histogram = sharding._histogram
    monkeypatch.setattr(sharding, "_histogram", lambda *a: rounds.append(1) or histogram(*a))
    total = sum(i % 50 for i in range(3000))
    loose, _ = sharding.find_cuts(placed, 4, 0.2)
    few = len(rounds)
    exact, _ = sharding.find_cuts(placed, 4, 0.0)
    assert few < len(rounds) - few
    assert all(abs(c.bytes - total * j / 4) <= 0.2 * total / 4 + 1 for j, c in enumerate(loose, 1))
    assert all(0 <= c.bytes - total * j / 4 < 50 for j, c in enumerate(exact, 1))
    placed.unpersist()


def test_shards_of_nothing_and_files(spark, tmp_path):
    assert sharding.shard(table(spark, [(1, "a", "b")]).limit(0), 16).collect() == []
    rows = corpus(3)
    sharding.write_shards(table(spark, rows), str(tmp_path / "out"), 5)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in found.collect()) == Counter(rows)
    assert {r["shard"] for r in found.select("shard").distinct().collect()} == {s for *_, s, _ in shards_of(rows, 5)}
    with pytest.raises(ValueError):
        sharding.write_shards(found, str(tmp_path / "again"), 5)
    with pytest.raises(ValueError):
        sharding.shard(found, 0)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, arity):
    """Root, and for each leaf its siblings level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place - place % arity
            proofs[i].append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + arity])))
        nodes = [digest("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        at = [place // arity for place in at]
    return nodes[0], proofs


def brute_manifest(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0], leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(groups[s], key=lambda x: (x[0], x[1] or 0, x[2])),) for s in order}
    trees = {s: (leaves, *tree([x[2] for x in leaves], arity)) for s, (leaves,) in trees.items()}
    root, upper = tree([trees[s][1] for s in order], arity)
    return sorted(
        ((i, s, h, p, low + up, sub, root) for (s, (leaves, sub, proofs)), up in zip(trees.items(), upper) for p, ((_, i, h), low) in enumerate(zip(leaves, proofs))),
        key=repr,
    )


@pytest.mark.parametrize(("arity", "levels", "step"), [(3, 9, 3), (3, 2, 1), (2, 3, 2), (4, 1, 1), (3, 4, 3)])
def test_manifest_by_brute_force(spark, monkeypatch, arity, levels, step):
    monkeypatch.setattr(merkle, "SUBTREE_LEVELS", step)
    rows = corpus(4)
    df = table(spark, rows)
    other = merkle.leaf_hash(df.doc_id, F.concat(df.text, F.lit("!")), df.source)
    found = merkle.manifest(df, merkle.leaf_hash(df.doc_id, df.text, df.source), arity=arity, block_levels=levels, carry={"other": other})
    found = found.withColumns({"same": merkle.folded(F.col("leaf"), F.col("path")), "changed": merkle.folded(F.col("other"), F.col("path")), "proof": merkle.siblings_hash(F.col("path"))})
    got = found.collect()
    plain = sorted(((r["doc_id"], r["source"], r["leaf"], r["position"], [tuple(p) for p in r["path"]], r["subroot"], r["root"]) for r in got), key=repr)
    texts = {leaf(r): r for r in rows}
    assert [(*r[:4], *r[4:]) for r in plain] == [(i, s, h, p, path, sub, root) for i, s, h, p, path, sub, root in brute_manifest([(i, t, s) for i, t, s in rows], arity)]
    for r in got:
        assert r["same"] == r["root"] and (r["changed"] == r["root"]) == (texts[r["leaf"]][1] is None)
        assert r["proof"] == digest("".join(a + b for a, b in r["path"]))


def test_manifest_of_nothing_and_of_one(spark):
    df = table(spark, [(1, "a", "b")])
    hashed = merkle.leaf_hash(df.doc_id, df.text)
    assert merkle.manifest(df.limit(0), hashed).collect() == []
    row = merkle.manifest(df, hashed).first()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf((1, "a")) and row["path"] == []


@pytest.mark.parametrize("n", range(1, 60))
def test_traversal_holds_few_nodes(n):
    leaves = [digest(str(i)).encode() for i in range(n)]
    want_root, want = tree([x.decode() for x in leaves], 3)
    walker = merkle.Traversal(leaves, merkle.height(n, 3), 3, 1)
    got, most = [], 0
    for path in walker.paths():
        got.append([(a.decode(), b.decode()) for a, b in path])
        most = max(most, sum(len(run) for t in walker.existing for run in t.runs))
    assert got == want and walker.root().decode() == want_root
    assert most <= 3 * merkle.height(n, 3)


def test_positions_of_repeated_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randint(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "grp string, v int").repartition(7)
    got = positions(df, "grp", [F.col("v").desc()]).collect()
    for g in ("a", "b", None):
        own = sorted((r["pos"], r["v"]) for r in got if r["grp"] == g)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted((v for _, v in own), reverse=True)
        assert {r["n"] for r in got if r["grp"] == g} == {len(own)}


def brute_resample(rows, target, percent, seed=7):
    def features(text):
        small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
        return len(own), [zlib.crc32(x.encode()) % 10000 for x in own + [f"{a} {b}" for a, b in zip(own, own[1:])]]

    of = [features(r[1]) for r in rows]
    s, t = Counter(b for _, f in of for b in f), Counter(b for x in target for b in features(x)[1])
    n, m = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for (i, *_), (words, f) in zip(rows, of):
        total = sum(math.floor(1000 * math.log((t[b] + 1) * n / ((s[b] + 1) * m))) for b in f)
        weight = total // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    fit = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = {id(x): k for k, x in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((*x[:4], drawn.get(id(x))) for x in out), key=repr)


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resampling_by_brute_force(spark, percent):
    rows, target = corpus(5), ["abc XYZ 09", None, "", "aß " * 30, "same text again"]
    rows += [(i, "one two three four five " * (i % 9), "s") for i in range(300, 500)] + [(None, "u v w x y z " * 9, "s"), (77, "t " * 25, "s"), (77, "t " * 25, "s")]
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = resampling.resample(table(spark, rows), wanted, percent).collect()
    assert sorted(map(tuple, got), key=repr) == brute_resample(rows, target, percent)


def test_resampling_of_nothing(spark):
    none = table(spark, [(1, "a", "b")]).limit(0)
    wanted = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert resampling.resample(none, wanted).collect() == []
    rows = [(i, "one two " * 15, "s") for i in range(9)]
    got = resampling.resample(table(spark, rows), wanted.limit(0)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_resample(rows, [], 25)


def test_three_runs_of_words(spark):
    df = spark.createDataFrame([("a b c d",), ("a",), ("",)], "text string")
    got = [r[0] for r in df.select(resampling.bucket_array(resampling.words(F.col("text")), 3)).collect()]
    want = [["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"], ["a"], []]
    assert got == [[zlib.crc32(x.encode()) % 10000 for x in w] for w in want]
