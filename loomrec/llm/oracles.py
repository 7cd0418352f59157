"""SQL for those of this subpackage's queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REACH = """reach AS (SELECT x AS a, y AS b FROM link UNION SELECT y, x FROM link UNION SELECT reach.a, l.y FROM reach JOIN (SELECT x, y FROM link UNION ALL SELECT y, x FROM link) l ON l.x = reach.b),
least AS (SELECT a AS id, least(a, min(b)) AS root FROM reach GROUP BY a)"""

ORACLES = {
    "op1_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
{REACH}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.id = w.doc_id""",
    "op4_source_mixing": """WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM s0),
s2 AS (SELECT *, [5.0::DOUBLE, 2, 1][(sid - 1) % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS ceiling FROM s1),
s3 AS (SELECT *, row_number() OVER f AS nth, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2 WINDOW f AS (ORDER BY ceiling / weight, sid)),
s4 AS (SELECT *, (SELECT arg_min(level, nth) FROM s3 WHERE level * weight <= ceiling) AS final FROM s3),
s5 AS (SELECT sid, source, source_size, coalesce(least(ceiling, final * weight), ceiling) AS target FROM s4),
s6 AS (SELECT *, floor(coalesce(target / nullif(source_size, 0), 0) + 1e-12) AS whole FROM s5),
s7 AS (SELECT *, greatest(0, target - whole * source_size) AS rest FROM s6),
z AS (SELECT d.*, s7.sid, s7.source_size, s7.target, s7.whole, s7.rest, length(bin(size)) AS odds, (CAST('0x' || substr(md5('mix|' || doc_id || '|' || size), 1, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM d JOIN s7 ON d.source IS NOT DISTINCT FROM s7.source),
b AS (SELECT sid, rest, odds, sum(size)::DOUBLE AS words FROM z WHERE size > 0 GROUP BY ALL),
c AS (SELECT sid, odds, (rest - coalesce(sum(words) OVER (PARTITION BY sid ORDER BY odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(words * odds) OVER (PARTITION BY sid ORDER BY odds DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM b),
r AS (SELECT sid, arg_max(c, odds) AS rate FROM c WHERE c * odds <= 1 GROUP BY 1),
p AS (SELECT z.*, least(1.0, coalesce(rate, 1.0) * odds) AS p FROM z LEFT JOIN r USING (sid)),
q AS (SELECT *, CASE WHEN size > 0 AND rest > 0 AND p > 0 THEN CASE WHEN p >= 1 THEN 0 ELSE u * (1 - p) / (u * (1 - p) + (1 - u) * p) END END AS q FROM p),
t AS (SELECT *, CASE WHEN q IS NOT NULL THEN sum(size) OVER (PARTITION BY sid, q IS NULL ORDER BY q RANGE UNBOUNDED PRECEDING) <= rest ELSE false END AS fits FROM q),
g AS (SELECT sid, any_value(rest) - coalesce(sum(size) FILTER (fits), 0) AS gap FROM t WHERE q IS NOT NULL GROUP BY 1),
m AS (SELECT t.sid, arg_min(struct_pack(q := q, size := size), struct_pack(miss := abs(gap - size), q := q, size := size)) AS best FROM t JOIN g USING (sid) WHERE q IS NOT NULL AND NOT fits AND abs(gap - size) < gap GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN fits OR coalesce(t.q = best.q AND size = best.size, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM t LEFT JOIN m USING (sid)""",
    "op6_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id < b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
{REACH}
SELECT vec_id, (SELECT count(*) FROM link WHERE x = vec_id OR y = vec_id) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM v LEFT JOIN least ON least.id = vec_id""",
    "op7_chat_format": """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(role, '\\', '\\\\'), '<', '\\l'), '[', '\\b')) + length(replace(replace(replace(text, '\\', '\\\\'), '<', '\\l'), '[', '\\b')) + 25 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars, false AS rewritten FROM e GROUP BY 1""",
    "op10_line_dedup": f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT doc_id, line, pos, coalesce(doc_id < holder, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY 1""",
    "op13_source_divergence": f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
u AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM u GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
n AS (SELECT lang, source, term, count(*) AS n FROM u SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
s AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY 1, 2),
g AS (SELECT DISTINCT d.lang, d.source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, lang_total FROM d LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 2)) // (total + 2 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v)::HUGEINT AS q
  FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10""",
}
