"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT node AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(root) AS component_id, node = min(root) AS kept FROM reach LEFT JOIN n ON n.a = node GROUP BY node
"""

# CRC-32: a table of 256 values from its rule; OP3 takes one step a byte.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT))"


OP3 = f"""
WITH ct AS (SELECT {CRC_TABLE} AS t), bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
crc AS (SELECT doc_id, len(b) + 1 AS size, xor(4294967295, list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS text_crc32 FROM bytes, ct),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM crc),
cut AS (SELECT *, CAST(((2 * before + size) * 16) // (2 * total) AS INT) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM cut
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
win AS (SELECT doc_id, pos, CASE WHEN pos + 49 <= len(w) THEN md5(array_to_string(w[pos : pos + 49], ' ')) END AS h, w[pos] AS word FROM p),
lows AS (SELECT h, min(doc_id) AS low FROM win WHERE h IS NOT NULL GROUP BY 1),
flags AS (SELECT win.doc_id, pos, word, coalesce(low < win.doc_id, FALSE) AS dup FROM win LEFT JOIN lows USING (h)),
gone AS (SELECT doc_id, pos, word, count(*) FILTER (WHERE dup) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS g FROM flags),
kept AS (SELECT doc_id, count(*) FILTER (WHERE g) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT g), '')) AS s FROM gone GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(s, sha256('')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i : i + 2], ' '))) END AS g FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(node, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node)
SELECT node AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id, node = min(root) AS kept FROM reach LEFT JOIN n ON n.doc_id = node GROUP BY node
"""

OP7 = f"""
WITH s AS (SELECT doc_id, source, len({WORDS}) AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][(rank - 1) % 3 + 1] AS weight, sum(ss) OVER () * 3 / 2 AS budget FROM t),
l AS (SELECT *, 2 * ss / weight AS r, (budget - coalesce(sum(2 * ss) OVER (ORDER BY 2 * ss / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY 2 * ss / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, struct_pack(r := r, rank := rank)) FILTER (WHERE r > level) AS final FROM l),
g AS (SELECT source, rank, ss, budget, CASE WHEN final IS NULL OR 2 * ss <= final * weight THEN (2 * ss)::DOUBLE ELSE final * weight END AS target FROM l, f),
o AS (SELECT s.*, g.rank, g.ss, g.budget, g.target, sum(size) OVER (PARTITION BY g.rank ORDER BY key, doc_id, size) AS upto FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
c AS (SELECT doc_id, rank, key, size, budget, epoch, (upto + epoch * ss) / target AS time FROM o, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0 AND target > 0),
q AS (SELECT doc_id, size, budget, sum(size) OVER (ORDER BY time, rank, key, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS words FROM c),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM q WHERE words <= budget GROUP BY 1)
SELECT o.doc_id, size, ss AS source_size, target, coalesce(taken, 0) AS taken FROM o LEFT JOIN k USING (doc_id)
"""


def _spans(kind: str, rank: int, pattern: str, check: str) -> str:
    """DuckDB text: spans of one kind, from the cuts and matches of a text, with the text."""
    return (
        f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, list_sum(list_transform(cuts[1:i], lambda c: length(c))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda c: length(c))), 0) AS start, m, text FROM "
        f"(SELECT doc_id, text, cuts, ms, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (SELECT doc_id, text, string_split_regex(text, '{pattern}') AS cuts, regexp_extract_all(text, '{pattern}') AS ms FROM documents WHERE text IS NOT NULL)) WHERE {check}"
    )


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(string_split(reverse({DIGITS}), ''), lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)) % 10 = 0"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = "replace(m, ' ', '')"
MOD97 = f"list_reduce(list_transform(string_split(substr({IBAN}, 5) || substr({IBAN}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END), lambda r, v: CASE WHEN v < 10 THEN (r * 10 + v) % 97 ELSE (r * 100 + v) % 97 END, 0) = 1"
#: Kind, base score in hundredths and words before a span that add 10.
CONTEXT = (("email", 90, "mail|contact|write|address"), ("ip", 60, "ip|host|server|address|login"), ("card", 70, "card|visa|credit|payment|number"), ("phone", 60, "phone|call|tel|mobile|fax"), ("iban", 80, "iban|account|bank|transfer"))
SCORE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {base} + CASE WHEN regexp_matches(before, '\\b(?:{words})') THEN 10 ELSE 0 END" for k, base, words in CONTEXT) + " END"
OP9 = rf"""
WITH s AS ({_spans("email", 0, EMAIL, "TRUE")}
UNION ALL {_spans("ip", 1, r"[0-9]+(?:\.[0-9]+){3}", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR right('000' || p, 3)::INT > 255)) = 0")}
UNION ALL {_spans("card", 2, "[0-9](?:[ -]?[0-9])+", f"length({DIGITS}) BETWEEN 12 AND 19 AND {LUHN}")}
UNION ALL {_spans("phone", 3, r"\+[0-9][ ().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15")}
UNION ALL {_spans("iban", 4, r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", f"length({IBAN}) BETWEEN 15 AND 34 AND {MOD97}")}),
b AS (SELECT * EXCLUDE text, lower(substr(text, (start - least(start, 40))::BIGINT + 1, least(start, 40)::BIGINT)) AS before FROM s),
g AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_email, count(*) FILTER (WHERE rank = 1) AS n_ip, count(*) FILTER (WHERE rank = 2) AS n_card, count(*) FILTER (WHERE rank = 3) AS n_phone,
string_agg(kind || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT, ',' ORDER BY start, rank) FILTER (WHERE rank < 4) AS base, string_agg(kind || ':' || start::BIGINT || ':' || (start + length(m))::BIGINT, ',' ORDER BY start, rank) AS spans, string_agg({SCORE}, ',' ORDER BY start, rank) AS scores FROM b GROUP BY 1)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM documents d LEFT JOIN g USING (doc_id)
"""

_RUN = "regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')"
OP11 = f"""
WITH RECURSIVE ct AS (SELECT {CRC_TABLE} AS t),
runs AS (SELECT doc_id, translate(unnest({_RUN}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, k, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM d),
h AS (SELECT run, k, xor(4294967295, list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h FROM b, ct),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
p AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM p a JOIN p b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
UNION SELECT p.word, p.n, v.word, v.n FROM p JOIN v ON v.word = p.rest UNION SELECT v.word, v.n, p.word, p.n FROM p JOIN v ON v.word = p.rest),
g AS (SELECT word, n, count(*) AS n_near, arg_min(near, struct_pack(a := -near_n, b := near)) AS best, max(near_n) AS best_n FROM near GROUP BY 1, 2),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN g USING (word)),
reach(word, last) AS (SELECT word, word FROM f UNION ALL SELECT reach.word, f.form FROM reach JOIN f ON f.word = reach.last WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, reach.last AS root FROM f JOIN reach ON reach.word = f.word JOIN f e ON e.word = reach.last AND e.form IS NULL
"""

ORACLE_SQL = {"op1_embedding_dedup": OP1, "op3_byte_shards": OP3, "op4_substring_dedup": OP4, "op5_minhash_dedup": OP5, "op7_mix_sources": OP7, "op9_pii": OP9, "op11_spelling_variants": OP11}
