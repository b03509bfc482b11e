"""SQL for the operators whose contracts rest on checksums, trees and hashed features."""

from __future__ import annotations

#: Table ``tab``: the remainders of one byte, for checksums.
_CRC_TABLE = """t0 AS (SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)),
        steps AS (SELECT i, c, k FROM t0 UNION ALL SELECT i, xor(c >> 1, 3988292384 * (c & 1)), k + 1 FROM steps WHERE k < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)"""


def _crc32(text: str) -> str:
    """CRC-32 of the bytes of ``text``, byte by byte; ``tab`` must be joined."""
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), {step}))"


# A row belongs to the shard in which its first byte falls, in the order of text and id hashes.
SHARDING = f"""
        WITH RECURSIVE {_CRC_TABLE},
        s AS (
            SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc32("coalesce(text, '')")} AS text_crc32,
                md5(coalesce(text, '')) || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key
            FROM documents, tab
        ),
        b AS (SELECT *, sum(size) OVER (ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS below, sum(size) OVER () AS total FROM s),
        d AS (SELECT *, CAST(16 * below // total AS INTEGER) AS shard FROM b)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot,
            CAST(NULL AS INTEGER) AS grown_shard
        FROM d
    """


def _encoded(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels and, for those with siblings to come, what stands left and right."""
    around = "OVER (PARTITION BY source, level, pos // 3 ORDER BY pos ROWS BETWEEN"
    return f"""{name}(source, level, pos, n, h) AS (
            SELECT source, 0, pos, n, h FROM {leaves}
            UNION ALL
            SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1
            GROUP BY source, level, pos // 3, n
        ),
        {name}_sides AS (
            SELECT source, level, pos, coalesce(string_agg(h, '') {around} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(h, '') {around} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
            FROM {name} WHERE n > 1
        )"""


def _fold(name: str, start: str, sides: str) -> str:
    return f"""{name}(id, source, level, pos, node, proof) AS (
            SELECT id, source, 0, pos, node, proof FROM {start}
            UNION ALL
            SELECT id, f.source, f.level + 1, f.pos // 3, sha256(s.l || node || s.r), proof || s.l || s.r
            FROM {name} f JOIN {sides} s ON f.source IS NOT DISTINCT FROM s.source AND f.level = s.level AND f.pos = s.pos
        ),
        {name}_end AS (SELECT id, source, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM {name} GROUP BY id, source)"""


MERKLE = f"""
        WITH RECURSIVE {_CRC_TABLE},
        d AS (
            SELECT doc_id, source, {_leaf("text")} AS leaf,
                CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 2 = 0 AND doc_id IS NOT NULL THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS now
            FROM documents, tab
        ),
        base AS (
            SELECT row_number() OVER () AS id, doc_id, source, leaf, now,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
            FROM d
        ),
        low_leaves AS (SELECT source, pos, n, leaf AS h FROM base),
        {_tree("low", "low_leaves")},
        subs AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
        top_leaves AS (SELECT '' AS source, pos, n, subroot AS h FROM subs),
        {_tree("top", "top_leaves")},
        begun AS (SELECT id, source, pos, now AS node, '' AS proof FROM base),
        {_fold("lower_fold", "begun", "low_sides")},
        between_ AS (SELECT id, '' AS source, subs.pos, node, proof FROM lower_fold_end f JOIN subs ON f.source IS NOT DISTINCT FROM subs.source),
        {_fold("upper_fold", "between_", "top_sides")}
        SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = top.h AS verified
        FROM base JOIN subs ON base.source IS NOT DISTINCT FROM subs.source JOIN upper_fold_end USING (id), top
        WHERE top.n = 1
    """

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
RESAMPLING = f"""
        WITH RECURSIVE {_CRC_TABLE},
        d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
        f AS (SELECT id, {_FEATURES} AS feature FROM d),
        e AS (SELECT {_FEATURES} AS feature FROM (SELECT {_WORDS} AS w FROM benchmark)),
        code AS (SELECT feature, {_crc32("feature")} % 10000 AS bucket FROM (SELECT feature FROM f UNION SELECT feature FROM e), tab),
        s AS (SELECT bucket, count(*) AS s FROM f JOIN code USING (feature) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM e JOIN code USING (feature) GROUP BY bucket),
        sums AS (SELECT (SELECT count(*) FROM f) + 10000 AS s_all, (SELECT count(*) FROM e) + 10000 AS t_all),
        gain AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1) * CAST(s_all AS DOUBLE) / ((s.s + 1) * CAST(t_all AS DOUBLE)))) AS BIGINT) AS g
            FROM s LEFT JOIN t USING (bucket), sums
        ),
        own AS (SELECT id, count(*) AS n, sum(g) AS g FROM f JOIN code USING (feature) JOIN gain USING (bucket) GROUP BY id),
        weighed AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(floor(CAST(g AS DOUBLE) / n), 0) AS BIGINT) AS weight,
                (CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
            FROM d LEFT JOIN own USING (id)
        ),
        scored AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln(u))) AS BIGINT) AS score FROM weighed),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS fit FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * fit // 100 THEN place END AS rank FROM ranked
    """
