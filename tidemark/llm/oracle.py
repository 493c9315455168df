"""SQL twins of the corpus queries that SQL can express, over the whole tables."""

from __future__ import annotations

#: Payload digests in base 32: each five hexadecimal digits of SHA-1 are four characters.
OP7 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT x, max(page_id) AS last, count(*) AS n FROM p GROUP BY 1),
d AS (SELECT p.*, g.last, g.n, [CAST('0x' || substr(p.x, 5 * i + 1, 5) AS BIGINT) FOR i IN range(8)] AS parts FROM p JOIN g ON p.x = g.x)
SELECT page_id, url, CASE WHEN n > 1 AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM last THEN last END AS refers_to,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR v IN parts], '') AS payload_digest,
  payload_bytes FROM d
"""

#: All strings of fifty bytes as hexadecimal digits; removed bytes by counting the starts that cover them.
OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, substr(x, CAST(2 * i + 1 AS BIGINT), 100) AS w FROM (SELECT doc_id, x, unnest(range(0, greatest(n - 49, 0))) AS i FROM d)),
m AS (SELECT w, min(doc_id) AS least FROM s GROUP BY 1 HAVING min(doc_id) <> max(doc_id)),
cut AS (SELECT doc_id, i FROM s JOIN m ON s.w = m.w WHERE doc_id > least),
isl AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM cut),
num AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM isl),
spans AS (SELECT doc_id, k, min(i) AS lo, max(i) + 50 AS hi FROM num GROUP BY 1, 2),
edge AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
parts AS (
  SELECT e.doc_id, string_agg(substr(d.x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (lo - before) AS BIGINT)), '' ORDER BY lo) AS kept, sum(hi - lo) AS removed, count(*) AS n_spans, max(hi) AS last
  FROM edge e JOIN d ON d.doc_id = e.doc_id GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN p.doc_id IS NULL THEN d.x ELSE p.kept || substr(d.x, CAST(2 * p.last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN parts p ON p.doc_id = d.doc_id
"""

#: Quartile bucket digests of each text and of its edited text. Digits of the text stand for its bytes; triplets are made within a text.
OP8 = """
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, text NULLS FIRST) AS k FROM documents),
e AS (
  SELECT a.doc_id, a.k, a.t, CASE WHEN a.k = (SELECT max(k) FROM o) THEN 1 ELSE a.k + 1 END AS nk, length(a.t) AS n,
    substr(a.t, 1, length(a.t) - length(a.t) // 2) || substr(b.t, 1, length(a.t) // 2) AS edited
  FROM o a JOIN o b ON b.k = CASE WHEN a.k = (SELECT max(k) FROM o) THEN 1 ELSE a.k + 1 END),
x AS (SELECT k, 0 AS kind, hex(encode(t)) AS h, octet_length(encode(t)) AS nb FROM e UNION ALL SELECT k, 1, hex(encode(edited)), octet_length(encode(edited)) FROM e),
grm AS (
  SELECT k, kind, t, count(*) AS n FROM (
    SELECT k, kind, unnest(regexp_extract_all(h, '.{6}') || regexp_extract_all(substr(h, 3), '.{6}') || regexp_extract_all(substr(h, 5), '.{6}')) AS t FROM x) GROUP BY 1, 2, 3),
tri AS (SELECT k, kind, n, CAST('0x' || t AS BIGINT) AS v FROM grm),
cnt AS (
  SELECT k, kind, ((((v >> 16) & 255) | (((v >> 8) & 255) << 8) | ((v & 255) << 16)) * 2654435761 % 4294967296) >> 24 AS bucket, sum(n)::BIGINT AS n FROM tri GROUP BY 1, 2, 3),
ful AS MATERIALIZED (SELECT x.k, x.kind, x.nb, b.bucket, coalesce(c.n, 0) AS n FROM x, (SELECT unnest(range(0, 256)) AS bucket) b LEFT JOIN cnt c ON c.k = x.k AND c.kind = x.kind AND c.bucket = b.bucket),
mk AS (SELECT k, kind, r[64] AS m1, r[128] AS m2, r[192] AS m3 FROM (SELECT k, kind, list_sort(list(n)) AS r FROM ful GROUP BY 1, 2)),
cd AS MATERIALIZED (SELECT f.k, f.kind, f.nb, f.bucket, (n > m1)::INT + (n > m2)::INT + (n > m3)::INT AS code FROM ful f JOIN mk ON mk.k = f.k AND mk.kind = f.kind),
by4 AS (SELECT k, kind, nb, bucket // 4 AS g, sum(code << (2 * (bucket % 4)))::INT AS byte FROM cd GROUP BY 1, 2, 3, 4),
len AS (SELECT k, kind, least(255, round_even(8 * log2(1 + nb), 0)::INT) AS c FROM x),
fp AS MATERIALIZED (SELECT b.k, b.kind, printf('%02x', any_value(l.c)) || string_agg(printf('%02x', byte), '' ORDER BY g) AS print FROM by4 b JOIN len l ON l.k = b.k AND l.kind = b.kind GROUP BY 1, 2),
pr AS (SELECT k, k AS k2, 1 AS kind2, 'e' AS which FROM e UNION ALL SELECT k, nk, 0, 'n' FROM e),
df AS MATERIALIZED (
  SELECT p.k, p.which, least(416, sum([0, 1, 2, 6][abs(a.code - b.code) + 1]) + least(24, any_value(abs(la.c - lb.c)))) AS d
  FROM pr p JOIN cd a ON a.k = p.k AND a.kind = 0 JOIN cd b ON b.k = p.k2 AND b.kind = p.kind2 AND b.bucket = a.bucket
  JOIN len la ON la.k = p.k AND la.kind = 0 JOIN len lb ON lb.k = p.k2 AND lb.kind = p.kind2 GROUP BY 1, 2)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, f.print AS fingerprint, g.print AS edited_fingerprint, 1 - de.d / 416 AS near_edited, 1 - dn.d / 416 AS near_next
FROM e JOIN fp f ON f.k = e.k AND f.kind = 0 JOIN fp g ON g.k = e.k AND g.kind = 1 JOIN df de ON de.k = e.k AND de.which = 'e' JOIN df dn ON dn.k = e.k AND dn.which = 'n'
"""


def _merkle() -> str:
    """Trees level by level: a level's digests by run. Seven levels are enough for two million rows of a language."""
    levels, top = 7, 3
    crc = (
        "rule(b, v, k) AS (SELECT b, b, 0 FROM (SELECT unnest(range(256)) AS b) UNION ALL "
        "SELECT b, CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END, k + 1 FROM rule WHERE k < 8), "
        "crc(t) AS (SELECT list(v ORDER BY b) FROM rule WHERE k = 8), "
    )
    fields = lambda text: " || ".join(
        f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text)
    )
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        crc,
        "base AS (SELECT doc_id, lang, sha256(" + fields("text") + ") AS leaf, sha256(" + fields(lower) + ") AS small, "
        "xor(list_reduce([ascii(x)::BIGINT FOR x IN regexp_extract_all(doc_id::VARCHAR, '.')], lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM documents, crc), ",
        "l0 AS (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, "
        "doc_id, leaf AS d, CASE WHEN h % 3 = 0 THEN small ELSE leaf END AS claim FROM base), ",
    ]

    def climb(name: str, count: int, key: str) -> None:
        for k in range(count):
            parts.append(
                f"{name}{k + 1} AS (SELECT {key} AS tree, i // 8 AS i, CASE WHEN any_value(s) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d "
                f"FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS s FROM {name}{k}) GROUP BY 1, 2), "
            )

    climb("l", levels, "tree")
    parts.append(f"t0 AS (SELECT 0 AS tree, tree AS i, d FROM l{levels}), ")
    climb("t", top, "tree")
    # The digests before and after a row's own in its run, at each level; none where one node is left.
    before = "f0 AS (SELECT tree, i, doc_id, d AS leaf, claim AS folded, '' AS proof FROM l0), "
    parts.append(before)
    steps = [(f"l{k}", 8**k, "f.tree", "f.i") for k in range(levels)] + [(f"t{k}", 8**k, "0", "f.tree") for k in range(top)]
    for k, (table, size, tree, at) in enumerate(steps):
        own = f"({at} // {size})"
        parts.append(
            f"f{k + 1} AS (SELECT f.tree, f.i, any_value(f.doc_id) AS doc_id, any_value(f.leaf) AS leaf, "
            f"CASE WHEN any_value(z.s) = 1 THEN any_value(f.folded) ELSE sha256(string_agg(CASE WHEN n.i = {own} THEN f.folded ELSE n.d END, '' ORDER BY n.i)) END AS folded, "
            f"any_value(f.proof) || coalesce(string_agg(n.d, '' ORDER BY n.i) FILTER (n.i <> {own}), '') AS proof "
            f"FROM f{k} f JOIN {table} n ON n.tree = {tree} AND n.i // 8 = {own} // 8 JOIN (SELECT tree, count(*) AS s FROM {table} GROUP BY 1) z ON z.tree = {tree} GROUP BY 1, 2), "
        )
    # A last run of one node is hashed alone, but what is alone on its level is not.
    last = len(steps)
    parts.append(f"done AS (SELECT f.*, l.d AS subroot, r.d AS root FROM f{last} f JOIN l{levels} l ON l.tree = f.tree CROSS JOIN t{top} r) ")
    return (
        "WITH RECURSIVE " + "".join(parts) + "SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM done"
    )


ALL = {"op4_substring_dedup": OP4, "op7_warc_zip": OP7, "op8_quartile_digest": OP8, "op11_merkle_manifest": _merkle()}
