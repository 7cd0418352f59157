"""SQL for the registered queries, for an independent engine over the same tables."""

from __future__ import annotations

BASE = """
inter AS (SELECT o_custkey AS user_id, l_partkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey) - 1 AS pos,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
split AS (SELECT user_id, item_id, pos, n, CASE WHEN pos = n - 1 THEN 'test' WHEN pos = n - 2 THEN 'valid' ELSE 'train' END AS split FROM inter WHERE n >= 3),
edges AS (SELECT user_id, item_id, pos, n - 2 AS n_train, max((pos + 1) / (n - 2)) OVER (PARTITION BY user_id, item_id) AS recency FROM split WHERE split = 'train'),
items AS (SELECT p_partkey AS item_id, p_name AS title, concat_ws(' ', p_brand, p_type) AS description FROM part)
"""
ITEM_NB = """item_nb AS (SELECT * FROM (SELECT user_id, item_id, recency, row_number() OVER (PARTITION BY user_id ORDER BY recency DESC, pos) AS ord FROM edges) WHERE ord <= {n})"""
USER_NB = """bag AS (SELECT user_id, item_id, count(*) AS k, min(pos) AS first FROM edges GROUP BY ALL),
pairs AS (SELECT a.user_id, b.user_id AS neighbor_id, CAST(sum(a.k * b.k) AS BIGINT) AS overlap, min(a.first) AS first FROM bag a JOIN bag b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY ALL),
user_nb AS (SELECT user_id, neighbor_id, overlap, ord FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY overlap DESC, first, neighbor_id) AS ord FROM pairs) WHERE ord <= 50)"""
NEIGHBORS = (
    ITEM_NB.format(n=100)
    + ", "
    + USER_NB
    + """,
idg AS (SELECT item_id, count(*) AS d FROM edges GROUP BY 1), udg AS (SELECT user_id, count(*) AS d FROM edges GROUP BY 1),
nb AS (SELECT i.user_id, 'item' AS nb_type, i.item_id AS nb_id, i.recency, 0 AS overlap, g.d AS nb_degree, (SELECT max(d) FROM idg) AS max_degree, i.ord FROM item_nb i JOIN idg g USING (item_id)
  UNION ALL SELECT u.user_id, 'user', u.neighbor_id, 0.0, u.overlap, g.d, (SELECT max(d) FROM udg), u.ord FROM user_nb u JOIN udg g ON g.user_id = u.neighbor_id),
nbo AS (SELECT nb.*, udg.d AS own_degree FROM nb JOIN udg USING (user_id))"""
)
MIX = """
r1 AS (SELECT *, row_number() OVER (PARTITION BY user_id, nb_type ORDER BY score DESC, ord) AS nth FROM scored),
r2 AS (SELECT *, CASE WHEN nb_type = 'item' AND nth <= 6 THEN 0 WHEN nb_type = 'user' AND nth <= 4 THEN 1 ELSE 2 END AS slot FROM r1),
r3 AS (SELECT *, count(*) FILTER (slot < 2) OVER (PARTITION BY user_id) AS forced, row_number() OVER (PARTITION BY user_id, slot = 2 ORDER BY score DESC, nb_type, nth) AS fill FROM r2),
top AS (SELECT user_id, nb_type, nb_id, recency, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, slot, nb_type, nth) AS ord FROM r3 WHERE slot < 2 OR fill <= 16 - forced)"""
HYBRID = """scored AS (SELECT *, CASE WHEN nb_type = 'item' THEN (0.5::DOUBLE * recency + 0.3::DOUBLE * (nb_degree / max_degree) + 0.0::DOUBLE) * 1.0::DOUBLE
  ELSE (0.7::DOUBLE * (overlap / own_degree) + 0.3::DOUBLE * (nb_degree / max_degree)) * 0.5::DOUBLE END AS score FROM nbo)"""
MLP = """scored AS (SELECT *, -0.5::DOUBLE + greatest(0.1::DOUBLE + f0 * 0.5::DOUBLE + f1 * 1.0::DOUBLE + f2 * 2.0::DOUBLE, 0.0::DOUBLE) * 1.0::DOUBLE + greatest(0.2::DOUBLE + f0 * -0.5::DOUBLE + f1 * 0.25::DOUBLE + f3 * 3.0::DOUBLE, 0.0::DOUBLE) * 0.75::DOUBLE AS score
  FROM (SELECT *, CASE WHEN nb_type = 'item' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f0, nb_degree / max_degree AS f1, CASE WHEN nb_type = 'item' THEN recency ELSE 0 END AS f2, CASE WHEN nb_type = 'item' THEN 0 ELSE overlap / own_degree END AS f3 FROM nbo))"""
RULE = {
    "books": "score * CASE WHEN mo > 0.6 THEN 2.5::DOUBLE ELSE 1.0 END * CASE WHEN co > 3 THEN 1.8::DOUBLE ELSE 1.0 END * CASE WHEN days > 180 THEN exp(-0.004::DOUBLE * days) ELSE 1.0 END",
    "goodreads": "score * CASE WHEN co > 15 THEN 0.7::DOUBLE ELSE 1.0 END * CASE WHEN co > 10 THEN 2.0::DOUBLE ELSE 1.0 END * CASE WHEN co > 15 THEN 1.5::DOUBLE ELSE 1.0 END * CASE WHEN mo > 0.8 THEN 3.0::DOUBLE ELSE 1.0 END * CASE WHEN days > 365 THEN exp(-0.002::DOUBLE * days) ELSE 1.0 END",
    "movietv": "(score * CASE WHEN co >= 3 THEN 2.5::DOUBLE ELSE 1.0 END * CASE WHEN days <= 60 THEN 1.0 WHEN days <= 180 THEN exp(-0.018::DOUBLE * days) ELSE exp(-0.025::DOUBLE * days) END * CASE WHEN days > 365 THEN 0.3::DOUBLE ELSE 1.0 END + CASE WHEN co < 3 THEN 2.8::DOUBLE * mo ELSE 1.0 END) * CASE WHEN mo > 0.6 THEN 1.5::DOUBLE ELSE 1.0 END",
    "yelp": "score * CASE WHEN co >= 2 THEN 2.0::DOUBLE ELSE 0.5 END * CASE WHEN mo > 0.85 THEN 4.5::DOUBLE WHEN mo > 0.7 THEN 3.5 ELSE 1.0 END * CASE WHEN days <= 90 THEN 1.0 WHEN days <= 180 THEN exp(-0.028::DOUBLE * days) ELSE 0.5::DOUBLE * exp(-0.028::DOUBLE * days) END * CASE WHEN mo < 0.4 THEN 0.2::DOUBLE ELSE 1.0 END",
}
RULED = """ruled AS (SELECT *, {rule} AS rule_score FROM (SELECT *, CASE WHEN nb_type = 'item' THEN CASE WHEN recency > 0 THEN recency ELSE 0.5 END ELSE overlap / own_degree END AS score,
  CASE WHEN nb_type = 'item' THEN CASE WHEN recency > 0 THEN (1.0::DOUBLE - recency) * 365 ELSE 180 END ELSE 0 END AS days, CASE WHEN nb_type = 'item' THEN 0.5::DOUBLE ELSE 0 END AS mo, CASE WHEN nb_type = 'item' THEN 0 ELSE overlap END AS co FROM nbo)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nb_type, ord) AS list_ord FROM ruled),
r2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, nb_type ORDER BY rule_score DESC, list_ord) AS nth FROM r1),
r3 AS (SELECT *, CASE WHEN nb_type = 'user' AND nth <= 4 THEN 0 WHEN nb_type = 'item' AND nth <= 6 THEN 1 ELSE 2 END AS slot FROM r2),
r4 AS (SELECT *, min(slot) OVER (PARTITION BY user_id, nb_type, nb_id) AS best FROM r3),
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot, CASE WHEN slot < 2 THEN nth END, rule_score DESC, list_ord) AS o FROM r4 WHERE NOT (best < 2 AND slot = 2))"""


def draw(key: str, n: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % ({n})"


def candidates(target: str, positives: str, salt: int, name: str) -> str:
    """A CTE of candidate lists: user_id, item_id, is_target, pos."""
    n = "(SELECT max(item_id) + 1 FROM split)"
    return f"""{name}_t AS (SELECT user_id, item_id AS target FROM split WHERE split = '{target}'),
{name}_mine AS (SELECT user_id, item_id FROM split WHERE {positives} UNION SELECT user_id, target FROM {name}_t),
{name}_probe AS (SELECT user_id, j, {draw(f"'42|{salt}|' || user_id || '|' || j", n)} AS item_id FROM {name}_t, (SELECT unnest(range(0, 36)) AS j)),
{name}_found AS (SELECT p.user_id, p.item_id, min(j) AS j FROM {name}_probe p ANTI JOIN {name}_mine m ON p.user_id = m.user_id AND p.item_id = m.item_id GROUP BY ALL),
{name}_neg AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY j) AS nth FROM {name}_found) WHERE nth <= 9),
{name}_both AS (SELECT user_id, item_id, false AS is_target FROM {name}_neg UNION ALL SELECT user_id, target, true FROM {name}_t),
{name} AS (SELECT user_id, item_id, is_target, row_number() OVER (PARTITION BY user_id ORDER BY md5('42|{salt}|' || user_id || '|shuffle|' || item_id), item_id) - 1 AS pos FROM {name}_both)"""


EVAL = candidates("test", "true", 0, "cand")
LOGIT = """((CAST('0x' || substr(sha256({p} || '|' || item_id), 1, 8) AS BIGINT)::DOUBLE * 4294967296.0::DOUBLE + CAST('0x' || substr(sha256({p} || '|' || item_id), 9, 8) AS BIGINT)::DOUBLE) / 18446744073709551616.0::DOUBLE - 0.5::DOUBLE) * 8.0::DOUBLE"""
RANKED = f"""lg AS (SELECT user_id AS req_id, item_id, pos, {LOGIT.format(p="('full ' || user_id)")} AS logit FROM cand),
ranked AS (SELECT req_id, item_id, pos, logit, exp(logit - max(logit) OVER (PARTITION BY req_id)) AS e, row_number() OVER (PARTITION BY req_id ORDER BY logit DESC, pos) AS rank FROM lg)"""
ARMS = f"""al AS (SELECT user_id, arm, item_id, pos, is_target, {LOGIT.format(p="(arm || ' ' || user_id)")} AS logit FROM cand, (SELECT unnest(['sample1', 'sample2', 'shuffled', 'lorem', 'empty']) AS arm)),
ar AS (SELECT *, row_number() OVER (PARTITION BY user_id, arm ORDER BY logit DESC, pos) - 1 AS r FROM al),
arms AS (SELECT user_id, arm, r AS gold_rank, CASE WHEN r < 5 THEN 1 / log2(r + 2.0) ELSE 0 END AS ndcg_at_5, CASE WHEN r < 1 THEN 1.0::DOUBLE ELSE 0 END AS hit_at_1 FROM ar WHERE is_target)"""
THREE = "CAST(round_even(score * 1000, 0)::BIGINT // 1000 AS VARCHAR) || '.' || lpad(CAST(round_even(score * 1000, 0)::BIGINT % 1000 AS VARCHAR), 3, '0')"
PACKED = f"""recent AS (SELECT user_id, string_agg(substr(title, 1, 40), ', ' ORDER BY pos) AS recent FROM edges JOIN items USING (item_id) WHERE pos >= n_train - 3 AND title IS NOT NULL GROUP BY user_id),
snip AS (SELECT t.user_id, score, ord, CASE WHEN nb_type = 'item' THEN 'Item-' ELSE 'User-' END || nb_id AS node,
  substr(CASE WHEN nb_type = 'item' THEN '[Item-' || nb_id || ']' || CASE WHEN i.item_id IS NULL THEN '' ELSE ' ' || substr(coalesce(title, 'Item-' || nb_id), 1, 80) || CASE WHEN length(description) > 0 THEN ' | ' || substr(description, 1, 120) ELSE '' END END || ' (score=' || {THREE} || ')'
    ELSE '[User-' || nb_id || '] (overlap_score=' || {THREE} || ')' || CASE WHEN length(recent) > 0 THEN ' - Recent: ' || recent ELSE '' END END, 1, 200) AS snippet
  FROM top t LEFT JOIN items i ON nb_type = 'item' AND i.item_id = nb_id LEFT JOIN recent r ON nb_type = 'user' AND r.user_id = nb_id),
running AS (SELECT *, sum(length(snippet) // 4) OVER (PARTITION BY user_id ORDER BY score DESC, ord) AS upto, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ord) AS place FROM snip),
packed AS (SELECT * FROM running WHERE upto <= 500)"""
CONTEXT = """nbt AS (SELECT user_id, string_agg(place || '. ' || snippet, chr(10) ORDER BY place) AS t, count(*) AS n FROM packed GROUP BY 1),
ct AS (SELECT user_id, string_agg((pos + 1) || '. [Item-' || item_id || '] ' || substr(coalesce(title, 'N/A'), 1, 60), chr(10) ORDER BY pos) AS t FROM cand LEFT JOIN items USING (item_id) WHERE pos < 10 GROUP BY 1),
ctx AS (SELECT u.user_id, 'User memory: No memory yet.' || chr(10) || chr(10) || 'Neighbors:' || chr(10) || coalesce(nbt.t, '(none available)') || chr(10) || chr(10) || 'Candidates:' || chr(10) || coalesce(ct.t, '(none available)') AS context, coalesce(n, 0) AS n_neighbors
  FROM (SELECT DISTINCT user_id FROM edges) u LEFT JOIN nbt USING (user_id) LEFT JOIN ct USING (user_id))"""
NORM = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
def q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *ctes]) + "\n" + body


def metric_rows() -> str:
    parts = []
    for k in (1, 3, 5, 10):
        for m, e in (("hit", "1.0"), ("ndcg", "1 / log2(pos + 2.0)"), ("mrr", "1 / (pos + 1.0)")):
            parts.append(f"SELECT '{m}' AS metric, {k} AS k, round(avg(CASE WHEN pos < {k} THEN ({e})::DOUBLE ELSE 0 END), 6) AS value FROM p")
    return " UNION ALL ".join(parts)


ORACLES = {
    "loo_split": q("SELECT user_id, item_id, pos, split FROM split"),
    "recency_edges": q("SELECT user_id, item_id, pos, n_train, round(recency, 6) AS recency FROM edges"),
    "degrees": q("SELECT 'user' AS kind, user_id AS id, count(*) AS degree FROM edges GROUP BY ALL UNION ALL SELECT 'item', item_id, count(*) FROM edges GROUP BY ALL"),
    "graph_stats": q("SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_edges, round(count(*) / count(DISTINCT user_id), 6) AS mean_user_degree, round(count(*) / count(DISTINCT item_id), 6) AS mean_item_degree FROM edges"),
    "dataset_stats": q("SELECT max(user_id) + 1 AS n_users, max(item_id) + 1 AS n_items, count(*) AS n_rows, count(DISTINCT CASE WHEN split = 'train' THEN user_id END) AS train_users, count(*) FILTER (split = 'train') AS train_rows, round(count(*) / ((max(user_id) + 1) * (max(item_id) + 1)), 9) AS density FROM split"),
    "conversion_stats": q("SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_rows, round(count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 6) AS density, round(count(*) / count(DISTINCT user_id), 6) AS per_user, round(count(*) / count(DISTINCT item_id), 6) AS per_item FROM inter"),
    "sliding_targets": q("SELECT user_id, item_id AS target, pos AS n_history FROM inter WHERE n > 2 AND pos = n - 3"),
    "replay_targets": q("""SELECT user_id, CASE WHEN reason IS NULL THEN item_id END AS target, greatest(n - 2, 0) AS n_history, reason FROM (SELECT *, CASE WHEN n < 3 THEN 'history too short' WHEN (SELECT max(item_id) + 1 FROM inter) - (SELECT count(DISTINCT item_id) FROM inter i2 WHERE i2.user_id = inter.user_id) < 9 THEN 'negative pool too small' END AS reason FROM inter WHERE pos = n - 2 OR (n < 2 AND pos = 0))"""),
    "item_neighbors": q("SELECT user_id, item_id, round(recency, 6) AS recency, ord FROM item_nb", ITEM_NB.format(n=100)),
    "user_neighbors": q("SELECT user_id, neighbor_id, overlap, ord FROM user_nb", USER_NB),
    "hybrid_topk": q("SELECT user_id, nb_type, nb_id, round(score, 6) AS score, ord FROM top", NEIGHBORS, HYBRID, MIX),
    "mlp_topk": q("SELECT user_id, nb_type, nb_id, round(1 / (1 + exp(-score)), 6) AS score, ord FROM top", NEIGHBORS, MLP, MIX),
    "popularity": q("SELECT item_id, count(*) AS n, round(count(*) / (SELECT count(*) FROM edges), 9) AS popularity FROM edges GROUP BY 1"),
    "packed_context": q("SELECT user_id, context, n_neighbors, length(context) // 4 AS n_tokens FROM ctx", NEIGHBORS, HYBRID, MIX, PACKED, EVAL, CONTEXT),
    "snippet_parse": q("SELECT user_id, count(DISTINCT node) AS n, string_agg(DISTINCT node, ',' ORDER BY node) AS nodes FROM packed GROUP BY 1", NEIGHBORS, HYBRID, MIX, PACKED),
    "eval_candidates": q("SELECT user_id, item_id, is_target, pos FROM cand", EVAL),
    "warmup_candidates": q("SELECT user_id, item_id, is_target, pos FROM cand", candidates("valid", "split = 'train'", 1, "cand")),
    "candidate_overlap": q("""SELECT a.user_id, a.item_id, round(max(coalesce(c.common, 0)) / any_value(nu.n), 6) AS share FROM (SELECT DISTINCT user_id, item_id FROM item_nb) a JOIN cand ON cand.user_id = a.user_id LEFT JOIN common c ON c.x = a.item_id AND c.y = cand.item_id JOIN nu ON nu.item_id = a.item_id GROUP BY a.user_id, a.item_id""",
        ITEM_NB.format(n=10), EVAL, "ui AS (SELECT DISTINCT item_id, user_id FROM edges)", "nu AS (SELECT item_id, count(*) AS n FROM ui GROUP BY 1)", "common AS (SELECT a.item_id AS x, b.item_id AS y, count(*) AS common FROM ui a JOIN ui b USING (user_id) GROUP BY ALL)"),
    "weighted_negatives": q("SELECT user_id, item_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY j) AS nth FROM fd) WHERE nth <= 5",
        "numbered AS (SELECT row_number() OVER (ORDER BY item_id % 256, item_id, user_id, pos) - 1 AS edge, item_id FROM edges)",
        f"pr AS (SELECT user_id, j, {draw("'42|weighted|' || user_id || '|' || j", '(SELECT count(*) FROM edges)')} AS edge FROM (SELECT DISTINCT user_id FROM split), (SELECT unnest(range(0, 40)) AS j))",
        "fd AS (SELECT pr.user_id, n.item_id, min(j) AS j FROM pr JOIN numbered n USING (edge) ANTI JOIN split s ON s.user_id = pr.user_id AND s.item_id = n.item_id GROUP BY ALL)"),
    "bpr_triples": q("SELECT user_id, pos_item, pos, arg_min(neg, j) AS neg_item FROM pr ANTI JOIN split s ON s.user_id = pr.user_id AND s.item_id = pr.neg GROUP BY ALL",
        f"pr AS (SELECT user_id, item_id AS pos_item, pos, j, {draw("'42|bpr|' || user_id || '|' || pos || '|' || j", '(SELECT max(item_id) + 1 FROM split)')} AS neg FROM edges, (SELECT unnest(range(0, 10)) AS j))"),
    "user_splits": q("""SELECT user_id, 'test' AS part FROM pin UNION ALL SELECT user_id, CASE WHEN nth <= (SELECT n // 2 FROM cnt) THEN 'train' ELSE 'val' END FROM fr WHERE nth <= (SELECT n // 2 + n // 5 FROM cnt)""",
        "el AS (SELECT user_id FROM split GROUP BY 1 HAVING count(*) FILTER (split = 'train') >= 1)", "cnt AS (SELECT count(*) AS n FROM el)",
        "pin AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY md5('42|' || user_id), user_id) AS r FROM el) WHERE r <= (SELECT n // 10 FROM cnt))",
        "fr AS (SELECT user_id, row_number() OVER (ORDER BY md5('42|split|' || user_id), user_id) AS nth FROM el WHERE user_id NOT IN (SELECT user_id FROM pin))"),
    "eval_sample": q("SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY md5('42|' || user_id), user_id) AS r FROM el) WHERE r <= (SELECT greatest(1, count(*) // 4) FROM el)", "el AS (SELECT user_id FROM split GROUP BY 1 HAVING count(*) FILTER (split = 'train') >= 5)"),
    "history_text": q("SELECT user_id, md5(t) AS md5, length(t) AS n_chars FROM (SELECT user_id, string_agg('Title: ' || substr(title, 1, 100) || chr(10) || 'Description: ' || right(regexp_replace(description, '<.*?>', '', 'g'), 200) || chr(10), '' ORDER BY pos) AS t FROM edges JOIN items USING (item_id) GROUP BY 1)"),
    "hash_ranker": q("SELECT req_id, item_id, pos, round(logit, 6) AS logit, round(e / sum(e) OVER (PARTITION BY req_id), 6) AS prob, rank FROM ranked", EVAL, RANKED),
    "ranking_metrics": q(metric_rows(), EVAL, RANKED, "p AS (SELECT r.rank - 1 AS pos FROM ranked r JOIN cand c ON c.user_id = r.req_id AND c.item_id = r.item_id WHERE c.is_target)"),
    "arm_scores": q("SELECT user_id, arm, gold_rank, round(ndcg_at_5, 6) AS ndcg_at_5, hit_at_1 FROM arms", EVAL, ARMS),
    "arm_means": q("SELECT arm, count(*) AS n, round(avg(ndcg_at_5), 6) AS ndcg_at_5, round(avg(hit_at_1), 6) AS hit_at_1 FROM arms GROUP BY 1", EVAL, ARMS),
    "arm_gate": q("SELECT round(s, 6) AS sample1, round(h, 6) AS shuffled, round(l, 6) AS lorem, round(e, 6) AS empty, s >= greatest(h, l, e) + 0.02 AS passes FROM m", EVAL, ARMS, "m AS (SELECT avg(ndcg_at_5) FILTER (arm = 'sample1') AS s, avg(ndcg_at_5) FILTER (arm = 'shuffled') AS h, avg(ndcg_at_5) FILTER (arm = 'lorem') AS l, avg(ndcg_at_5) FILTER (arm = 'empty') AS e FROM arms)"),
    "tie_rate": q("SELECT arm, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6) AS tie_rate FROM (SELECT arm, round(ndcg_at_5, 9) AS v, count(*) AS c FROM arms GROUP BY ALL) GROUP BY 1", EVAL, ARMS),
    "paired_delta": q("SELECT count(*) AS n, round(avg(x), 6) AS delta, round(avg(x) - 1.96 * stddev_samp(x) / sqrt(count(*)), 6) AS low, round(avg(x) + 1.96 * stddev_samp(x) / sqrt(count(*)), 6) AS high, count(*) FILTER (x > 0) AS better, count(*) FILTER (x = 0) AS equal, count(*) FILTER (x < 0) AS worse FROM (SELECT a.ndcg_at_5 - b.ndcg_at_5 AS x FROM arms a JOIN arms b USING (user_id) WHERE a.arm = 'sample1' AND b.arm = 'empty')", EVAL, ARMS),
    "spearman": q("SELECT arm, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY n_train) + (count(*) OVER (PARTITION BY arm, n_train) - 1) / 2 AS rx, rank() OVER (PARTITION BY arm ORDER BY ndcg_at_5) + (count(*) OVER (PARTITION BY arm, ndcg_at_5) - 1) / 2 AS ry FROM arms JOIN (SELECT user_id, count(*) AS n_train FROM edges GROUP BY 1) USING (user_id)) GROUP BY 1", EVAL, ARMS),
    "sparsity_gain": q("SELECT 1 + (n_train > q1)::INT + (n_train > q2)::INT + (n_train > q3)::INT AS quartile, count(*) AS n, round(avg(gain), 6) AS mean_gain FROM g, (SELECT quantile_cont(n_train, 0.25) AS q1, quantile_cont(n_train, 0.5) AS q2, quantile_cont(n_train, 0.75) AS q3 FROM g) GROUP BY 1", EVAL, ARMS, "g AS (SELECT a.user_id, a.ndcg_at_5 - b.ndcg_at_5 AS gain, t.n_train FROM arms a JOIN arms b USING (user_id) JOIN (SELECT user_id, count(*) AS n_train FROM edges GROUP BY 1) t USING (user_id) WHERE a.arm = 'sample1' AND b.arm = 'empty')"),
    "memory_compaction": "SELECT role AS entity_type, conv_id AS entity_id, md5(arg_max(trim(text), turn)) AS md5, max(turn) AS seq, count(*) AS n_updates FROM conversations WHERE length(trim(text)) > 0 GROUP BY ALL",
    "memory_stats": "SELECT entity_type, count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_updates, round(avg(length(m)), 6) AS mean_chars FROM (SELECT role AS entity_type, conv_id, arg_max(trim(text), turn) AS m, count(*) AS n FROM conversations WHERE length(trim(text)) > 0 GROUP BY ALL) GROUP BY 1",
    "memory_init": q("SELECT item_id, title || '. ' || substr(trim(description), 1, 300) AS memory FROM items"),
    "degree_stream": "SELECT 'user' AS kind, user_id AS id, count(*) AS degree FROM events GROUP BY ALL UNION ALL SELECT 'item', ascii(event_type), count(*) FROM events GROUP BY ALL",
    "token_usage": "SELECT role AS stage, count(*) AS n, CAST(sum(CASE WHEN role <> 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS tokens_in, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END) AS BIGINT) AS tokens_out, round(avg(CASE WHEN role <> 'assistant' THEN length(text) // 4 ELSE 0 END), 6) AS mean_in, round(avg(CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END), 6) AS mean_out FROM conversations GROUP BY 1",
    "facet_vectors": f"""WITH w AS (SELECT doc_id AS user_id, unnest(regexp_split_to_array(trim(lower(text)), '\\s+')) AS word FROM documents),
c AS (SELECT user_id, {draw("word", "64")} AS dim, count(*) AS n FROM w WHERE length(word) > 0 GROUP BY ALL), u AS (SELECT user_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY user_id)) AS v FROM c)
SELECT user_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY user_id)), 6) AS value FROM u""",
    "leak_corpus": f"SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains({NORM.format(c='d.text')}, {NORM.format(c='b.text')}) AND {NORM.format(c='b.text')} <> ''",
    "leak_screen": q("SELECT p.user_id, CASE WHEN list_contains(ids, gold) THEN 'gold id' WHEN list_has_any(ids, cs) THEN 'candidate id' END AS reason FROM (SELECT user_id, list(nb_id) AS ids FROM top WHERE nb_type = 'item' GROUP BY 1) p JOIN (SELECT user_id, list(item_id) AS cs, max(item_id) FILTER (is_target) AS gold FROM cand GROUP BY 1) c USING (user_id)", NEIGHBORS, HYBRID, MIX, EVAL),
    "reward_breakdown": """WITH r AS (SELECT doc_id, text, quality, (3 - doc_id % 10 + 10) % 10 AS gold_rank, 0.3::DOUBLE * ((doc_id % 7) / 7) AS soft, toxic / 2 AS g, CASE WHEN doc_id % 3 > 0 THEN 0.5::DOUBLE END AS nul FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, CASE WHEN gold_rank < 5 THEN 1 / log2(gold_rank + 2.0) ELSE 0 END AS ndcg, CASE WHEN gold_rank < 1 THEN 1.0::DOUBLE ELSE 0 END AS hit, 0.1::DOUBLE * greatest(0, length(text) // 4 - 400) / 100 AS lp, CASE WHEN quality = 1 THEN 0.0::DOUBLE ELSE 1 END AS fp FROM r)
SELECT doc_id AS req_id, round(ndcg, 6) AS ndcg, hit, gold_rank, round(soft, 6) AS soft, round(lp, 6) AS len_penalty, fp AS fmt_penalty, round(ndcg + soft + 0.2::DOUBLE * g - lp - fp, 6) AS total, ndcg > nul AS beats_null FROM s""",
    "grounding": """WITH p AS (SELECT a.label, a.vec_id, a.vec_id + k AS cited, CASE WHEN c.vec_id IS NOT NULL THEN list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) END AS cs FROM embeddings a, (SELECT unnest([1, 2]) AS k) k LEFT JOIN embeddings c ON c.vec_id = a.vec_id + k AND c.label = a.label),
f AS (SELECT label, vec_id, max(cs) AS best FROM p GROUP BY ALL)
SELECT f.label AS req_id, round(count(*) FILTER (best >= 0.1) / 7, 6) AS grounding, count(*) FILTER (best >= 0.1) AS n_grounded, any_value(h.n) AS n_hallucinated FROM f JOIN (SELECT label, count(DISTINCT CASE WHEN cs IS NULL THEN cited END) AS n FROM p GROUP BY 1) h USING (label) GROUP BY 1""",
}
ORACLES["sequence_examples"] = q("""SELECT user_id, length, list_aggregate(list_concat(h[1:length], list_resize([]::BIGINT[], (19 - length)::BIGINT, 0)), 'string_agg', ',') AS input, list_aggregate(list_concat(h[2:length + 1], list_resize([]::BIGINT[], (19 - length)::BIGINT, 0)), 'string_agg', ',') AS target,
  list_aggregate([ng[1 + i % len(ng)] FOR i IN range(0, length)], 'string_agg', ',') AS negatives FROM (SELECT user_id, len(h) - 1 AS length, h FROM (SELECT user_id, list(item_id ORDER BY pos) FILTER (pos >= n - 2 - 20) AS h FROM split WHERE split = 'train' GROUP BY 1 HAVING count(*) >= 2)) JOIN ng USING (user_id)""",
    f"pr AS (SELECT user_id, j, {draw("'42|7|' || user_id || '|' || j", '(SELECT max(item_id) + 1 FROM split)')} AS item_id FROM (SELECT DISTINCT user_id FROM split), (SELECT unnest(range(0, 76)) AS j))",
    "fd AS (SELECT p.user_id, p.item_id, min(j) AS j FROM pr p ANTI JOIN split s ON s.user_id = p.user_id AND s.item_id = p.item_id GROUP BY ALL)",
    "ng AS (SELECT user_id, list(item_id ORDER BY j)[1:19] AS ng FROM fd GROUP BY 1 HAVING count(*) >= 19)")
ORACLES["bow_rerank"] = q("""SELECT user_id, item_id, pos, round(score, 6) AS score, rationale, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pos) AS rank FROM sc""", EVAL,
    "iw0 AS (SELECT p_partkey AS item_id, lower(unnest(string_split(p_type, ' '))) AS word, 1.0::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, unnest(regexp_split_to_array(lower(trim(p_name)), '\\s+')), 0.5 FROM part UNION ALL SELECT p_partkey, unnest(regexp_split_to_array(lower(trim(p_brand)), '\\s+')), 0.5 FROM part)",
    "iw AS (SELECT item_id, word, sum(w) AS w FROM iw0 WHERE w = 1 OR length(word) > 3 GROUP BY ALL)",
    "uw AS (SELECT user_id, word, max(c) AS w FROM (SELECT user_id, unnest(regexp_split_to_array(lower(trim(title)), '\\s+')) AS word, 1.0 / (n_train - pos) AS c FROM edges JOIN items USING (item_id) WHERE pos >= n_train - 3) WHERE length(word) > 3 GROUP BY ALL)",
    "sh AS (SELECT c.user_id, c.item_id, i.word, i.w * u.w AS p, row_number() OVER (PARTITION BY c.user_id, c.item_id ORDER BY i.w * u.w DESC, i.word) AS n FROM cand c JOIN iw i USING (item_id) JOIN uw u ON u.user_id = c.user_id AND u.word = i.word)",
    "tp AS (SELECT user_id, item_id, sum(p) AS dot, string_agg(word, ', ' ORDER BY n) FILTER (n <= 3) AS why FROM sh GROUP BY ALL)",
    "sc AS (SELECT c.user_id, c.item_id, c.pos, coalesce(t.dot / ((SELECT sqrt(sum(w * w)) FROM uw WHERE uw.user_id = c.user_id) * (SELECT sqrt(sum(w * w)) FROM iw WHERE iw.item_id = c.item_id)), 0) AS score, coalesce(t.why, 'No strong match') AS rationale FROM cand c LEFT JOIN tp t USING (user_id, item_id))")
ORACLES["dense_rerank"] = q("SELECT user_id, item_id, pos, round(s, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, pos) AS rank FROM (SELECT c.user_id, c.item_id, c.pos, coalesce(list_cosine_similarity(u.embedding::DOUBLE[], v.embedding::DOUBLE[]), 0) AS s FROM cand c LEFT JOIN embeddings u ON u.vec_id = c.user_id LEFT JOIN embeddings v ON v.vec_id = c.item_id)", EVAL)
ORACLES["facet_parse"] = f"""SELECT doc_id AS req_id, CASE WHEN k = 3 OR t IS NULL THEN 0 WHEN t = '' THEN 1 ELSE 2 END AS n_facets, md5(CASE WHEN k = 3 OR t IS NULL THEN '' WHEN t = '' THEN 'second' ELSE substr(t, 1, 400) END) AS first_md5,
CASE WHEN k = 3 OR t IS NULL OR t = '' THEN '' ELSE 'Item-' || doc_id || ',User-7' END AS cited, k < 2 AND t IS NOT NULL AS valid, k = 2 AND t IS NOT NULL AS truncated FROM (SELECT doc_id, doc_id % 4 AS k, {NORM.format(c='text')} AS t FROM documents)"""
ORACLES["reward_summary"] = "WITH b AS (" + ORACLES["reward_breakdown"] + """) SELECT count(*) AS n, round(avg(total), 6) AS mean_total, round(stddev_pop(total), 6) AS std_total, round(avg(ndcg), 6) AS mean_ndcg, round(avg(hit), 6) AS mean_hit, 0.0::DOUBLE AS mean_grounding, round(avg(CASE WHEN fmt_penalty = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS valid_rate, round(avg(len_penalty), 6) AS mean_len_penalty, round(avg(CASE WHEN beats_null IS NOT NULL THEN beats_null::INT END), 6) AS beats_null_rate FROM b"""
ORACLES["patch_stream"] = ORACLES["memory_compaction"]
ORACLES |= {f"rule_topk_{d}": q("SELECT user_id, nb_type, nb_id, round(score, 6) AS score, round(rule_score, 6) AS rule_score, o AS ord FROM top WHERE o <= 16", NEIGHBORS, RULED.format(rule=r)) for d, r in RULE.items()}
