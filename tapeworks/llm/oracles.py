"""SQL for conversation repair, the Merkle manifest and substring dedup: other ways to the same rows, for small tables."""

from __future__ import annotations

#: CTE with the 256 entries of the CRC-32 table, made by its rule from the polynomial; crc32() of an ASCII string by it.
CRC = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, x: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"


def conversation_sql() -> str:
    """States as strings of nine digits of cost and the audit, whose order is that of (cost, audit); one row of turns a round."""
    plus = lambda x, cost, letter: f"CASE WHEN {x} IS NOT NULL THEN printf('%09d', CAST(substr({x}, 1, 9) AS INTEGER) + {cost}) || substr({x}, 10) || '{letter}' END"
    keep = lambda x, symbol: f"CASE WHEN fault NOT IN (1, 2) AND initial = '{symbol}' THEN {plus(x, 'extra', 'K')} END"
    rerole = lambda x: f"CASE WHEN fault NOT IN (1, 2) THEN {plus(x, '1 + extra', 'R')} END"
    return rf"""
WITH RECURSIVE {CRC},
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc),
g AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
q AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), nth) AS i FROM q),
t AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, CASE WHEN last <> '' AND nth = 1 AND last NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, sum((fault = 1)::INT) AS blank, sum((fault = 2)::INT) AS duplicate, sum((fault = 3)::INT) AS truncated, sum((pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM t GROUP BY conv_id),
p(conv_id, i, c0, cs, cu, ca) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), '000000005I', '000000010II' FROM t
  UNION ALL
  SELECT conv_id, i, c0, cs, cu, least(ca, {plus("cu", 5, "I")}) FROM (
    SELECT conv_id, i, c0, cs, least(cu, {plus("c0", 5, "I")}, {plus("cs", 5, "I")}, {plus("ca", 5, "I")}) AS cu, ca FROM (
      SELECT p.conv_id, t.i, {plus("c0", 2, "D")} AS c0, least({plus("cs", 2, "D")}, {keep("c0", "s")}) AS cs,
        least({plus("cu", 2, "D")}, {keep("c0", "u")}, {rerole("c0")}, {keep("cs", "u")}, {rerole("cs")}, {keep("ca", "u")}, {rerole("ca")}) AS cu,
        least({plus("ca", 2, "D")}, {keep("cu", "a")}, {rerole("cu")}) AS ca
      FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = p.i + 1))),
r AS (SELECT p.conv_id, least(c0, ca) AS best FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n),
e AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS ch, unnest(range(1, length(best) - 8)) AS j FROM r WHERE length(best) > 9),
f AS (SELECT *, sum((ch <> 'I')::INT) OVER w AS i, sum((ch <> 'D')::INT) OVER w AS m FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
h AS (SELECT f.conv_id, f.j, f.ch, f.m, t.role, coalesce(t.text, '') AS text, max((f.m = 1 AND f.ch = 'K' AND t.initial = 's')::INT) OVER (PARTITION BY f.conv_id) AS s FROM f LEFT JOIN t ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i AND f.ch <> 'I' WHERE f.ch <> 'D'),
x AS (SELECT conv_id, sha256(string_agg(CASE WHEN ch = 'K' THEN role WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS repaired_sha256 FROM h GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(substr(best, 1, 9), '0') AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id LEFT JOIN x ON a.conv_id IS NOT DISTINCT FROM x.conv_id
"""


def manifest_sql(depth: int = 6) -> str:
    """Leaves numbered by a window, `depth` levels in each tree (16^6 leaves), each level's siblings by a window over its run."""
    value = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def tree(name: str, base: str, by: str) -> list[str]:
        steps = [f"{name}0 AS ({base})"]
        for k in range(depth):
            left, right = (f"coalesce(string_agg(h, '') OVER (PARTITION BY {by}, i // 16 ORDER BY i ROWS BETWEEN {rows}), '')" for rows in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
            steps.append(f"{name}s{k} AS (SELECT {by} AS g, i, {left} AS l, {right} AS r FROM {name}{k} WHERE n > 1)")
            steps.append(f"{name}{k + 1} AS (SELECT {by}, i // 16 AS i, (max(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY {by}, i // 16)")
        steps.append(f"{name}top AS ({' UNION ALL '.join(f'SELECT {by}, h FROM {name}{k} WHERE n = 1' for k in range(depth + 1))})")
        return steps

    def path(name: str, index: str, group: str) -> tuple[str, str]:
        """The joins that fetch a leaf's siblings, and the list of them."""
        joins = " ".join(f"LEFT JOIN {name}s{k} ON {name}s{k}.g IS NOT DISTINCT FROM {group} AND {name}s{k}.i = {index} // {16**k}" for k in range(depth))
        return joins, ", ".join(f"CASE WHEN {name}s{k}.i IS NOT NULL THEN {{'l': {name}s{k}.l, 'r': {name}s{k}.r}} END" for k in range(depth))

    below, above = path("t", "d.i", "d.source"), path("u", "u0.i", "0")
    steps = [
        CRC,
        f"d AS (SELECT doc_id, source, {leaf('text')} AS h, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} END AS tampered, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf('text')}) - 1 AS i FROM documents, crc)",
        *tree("t", "SELECT source, i, n, h FROM d", "source"),
        *tree("u", "SELECT 0 AS one, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM ttop", "one"),
        f"q AS (SELECT doc_id, d.h AS leaf, tampered, u0.h AS subroot, utop.h AS root, list_filter([{below[1]}, {above[1]}], lambda x: x IS NOT NULL) AS p FROM d JOIN u0 ON u0.source IS NOT DISTINCT FROM d.source, utop {below[0]} {above[0]})",
        "z AS (SELECT *, list_reduce(list_concat([{'l': '', 'r': coalesce(tampered, leaf)}], p), lambda a, x: {'l': '', 'r': sha256(x.l || a.r || x.r)}).r AS folded_root FROM q)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z"


REPEATS_SQL = r"""
WITH w AS (SELECT row_number() OVER (ORDER BY doc_id, md5(coalesce(text, ''))) AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT d, unnest(list_transform(range(1, len(ws) - 18), lambda s: md5(array_to_string(ws[s:s + 19], ' ')))) AS k, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
a AS (SELECT d, s FROM (SELECT d, s, row_number() OVER (PARTITION BY k ORDER BY d, s) AS nth FROM k) WHERE nth > 1),
c AS (SELECT DISTINCT d, unnest(range(s, s + 20)) AS s FROM a),
p AS (SELECT d, unnest(ws) AS word, generate_subscripts(ws, 1) AS s FROM w),
r AS (SELECT p.d, count(c.s) AS n_removed, coalesce(string_agg(CASE WHEN c.s IS NULL THEN word END, ' ' ORDER BY p.s), '') AS kept FROM p LEFT JOIN c ON p.d = c.d AND p.s = c.s GROUP BY p.d)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON w.d = r.d
"""
