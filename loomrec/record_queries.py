"""More registered queries, with their SQL beside them: files, records, arms, requests, responses and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomrec.functions.columns import node_id, tokens
from loomrec.operators import context, facets, graph, leakage, memory, metrics, pruning, records, rerank, rewards, sampling
from loomrec.operators import sequences as seq
from loomrec.oracles import ARMS, EVAL, HYBRID, MIX, NEIGHBORS, NORM, q
from loomrec.plans import pipelines
from loomrec.queries import SEED, _arms, _eval, _histories, _rows, edges, items, rounded, split, table
from loomrec.scratch import materialise, shared_dir
from loomrec.sources import tables

QUERIES, ORACLES = {}, {}


def registered(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex[:12]}"


# Files.


@registered("SELECT user_id, event_id AS item_id, value AS rating, CAST(event_id AS DOUBLE) AS timestamp FROM events")
def tsv_interactions(spark, d):
    at = folder(spark)
    tables.write_tsv(table(spark, d, "events").select("user_id", F.col("event_id").alias("item_id"), F.col("value").alias("rating"), F.col("event_id").alias("timestamp")), at)
    return tables.read_tsv(spark, at, tables.INTERACTIONS)


@registered("""SELECT 'interactions' AS name, count(*) AS n, CAST(0 AS BIGINT) AS n_chars FROM events UNION ALL SELECT 'items', count(*), CAST(sum(length(p_name)) AS BIGINT) FROM part
UNION ALL SELECT 'reviews', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations UNION ALL SELECT 'instructions', 0, 0""")
def load_bundle(spark, d):
    """Four tables written as one conversion and read as one bundle; the file of instructions is missing."""
    at = f"{folder(spark)}/x"
    e, c = table(spark, d, "events"), table(spark, d, "conversations")
    inter = e.select("user_id", F.col("event_id").alias("item_id"), F.lit(5.0).alias("rating"), F.lit(1.0).alias("timestamp"))
    tables.write_tsv(inter, f"{at}.inter")
    tables.write_tsv(c.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("item_id"), F.col("text").alias("review_text")), f"{at}.text")
    tables.write_tsv(items(spark, d).select("item_id", F.lit("").alias("asin"), "title", "description"), f"{at}.meta")
    got = tables.load_all(spark, at)
    size = {"interactions": F.lit(0), "items": F.length("title"), "reviews": F.length("review_text"), "instructions": F.length("instruction")}
    out = None
    for name, df in got.items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.coalesce(F.sum(size[name]), F.lit(0)).cast("long").alias("n_chars"))
        out = one if out is None else out.unionByName(one)
    return out


@registered(q("SELECT user_id, item_id, is_target, pos FROM cand", EVAL))
def listed_candidates(spark, d):
    """Ready-made lists, written and read again, in place of drawn candidates."""
    cand, at = materialise(_eval(spark, d), "lists"), folder(spark)
    ranked = cand.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"]).alias("ranked"))
    ranked.write.json(at)
    targets = cand.where("is_target").select("user_id", F.col("item_id").alias("target"))
    return sampling.listed_candidates(tables.read_ranked_lists(spark, at), targets, 10)


PARTS = """el AS (SELECT user_id FROM split GROUP BY 1 HAVING count(*) FILTER (split = 'train') >= 1), cnt AS (SELECT count(*) AS n FROM el),
pin AS (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY md5('42|' || user_id), user_id) AS r FROM el) WHERE r <= (SELECT n // 10 FROM cnt)),
fr AS (SELECT user_id, row_number() OVER (ORDER BY md5('42|split|' || user_id), user_id) AS nth FROM el WHERE user_id NOT IN (SELECT user_id FROM pin)),
parts AS (SELECT user_id, 'test' AS part FROM pin UNION ALL SELECT user_id, CASE WHEN nth <= (SELECT n // 2 FROM cnt) THEN 'train' ELSE 'val' END FROM fr WHERE nth <= (SELECT n // 2 + n // 5 FROM cnt))"""


def _parts(spark, d) -> DataFrame:
    users = materialise(sampling.eligible_users(split(spark, d)), "eligible")  # read several times
    n = users.count()
    return sampling.checked_splits(sampling.user_splits(users, sampling.user_sample(users, n // 10, SEED), n // 2, n // 5, SEED))


@registered(q("SELECT user_id, part FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY user_id) AS r FROM parts) WHERE r <= 20", PARTS))
def first_users(spark, d):
    """Splits written and read again, and the first twenty users of each: a smoke subset."""
    at = folder(spark)
    tables.write_splits(_parts(spark, d), at)
    return sampling.first_of_each(tables.read_splits(spark, at), 20)


@registered(q("SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY md5('42|' || user_id), user_id) AS r FROM (SELECT DISTINCT user_id FROM split)) WHERE r <= 100 UNION ALL SELECT -1 - count(*) FROM (SELECT DISTINCT s.user_id FROM split s JOIN (SELECT DISTINCT user_id FROM events) e USING (user_id))"))
def chosen_users(spark, d):
    """A sample of a hundred over all; and, as a negative number, how many a given list leaves."""
    users = split(spark, d).select("user_id").distinct()
    listed = sampling.chosen_users(users, SEED, table(spark, d, "events"))
    return sampling.chosen_users(users, SEED, n=100).unionByName(listed.agg((-1 - F.count("*")).alias("user_id")))


@registered("SELECT role AS stage, count(*) AS n, CAST(sum(length(text) // 4) AS BIGINT) AS tokens_in, CAST(0 AS BIGINT) AS tokens_out FROM conversations GROUP BY 1")
def call_log(spark, d):
    """Calls appended to a log in two goes, read again and added up by stage."""
    at, c = folder(spark), table(spark, d, "conversations")
    usage = F.struct(tokens(F.col("text")).alias("prompt_tokens"))
    calls = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("m").alias("model"), F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"), F.struct(F.col("role").alias("stage"), usage.alias("usage")).alias("metadata"))
    for part in (0, 1):
        tables.append_calls(calls.where(F.length("id") % 2 == part), at)
    return memory.token_usage(tables.read_calls(spark, at)).select("stage", "n", "tokens_in", "tokens_out")


# Conversion of sequence tables.

CONV = "conv AS (SELECT conv_id, count(*) AS n, row_number() OVER (ORDER BY conv_id) - 1 AS user_id, arg_min(text, turn) AS first FROM conversations GROUP BY 1)"


def _sequence_table(spark, d) -> DataFrame:
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("h"))
    return rows.select("conv_id", F.transform("h", lambda x: x["turn"]).alias("asin"), F.transform("h", lambda x: F.when(x["role"] == "user", x["text"])).alias("reviews"), F.col("h")[0]["text"].alias("said"))


@registered(f"WITH {CONV} SELECT user_id, turn AS item_id, 5.0::DOUBLE AS rating, row_number() OVER (PARTITION BY user_id ORDER BY turn) AS timestamp FROM conversations JOIN conv USING (conv_id)")
def converted_interactions(spark, d):
    return seq.exploded_interactions(_sequence_table(spark, d), "conv_id", "asin")


@registered(f"WITH {CONV} SELECT user_id, turn AS item_id, md5(text) AS md5 FROM conversations JOIN conv USING (conv_id) WHERE role = 'user'")
def converted_reviews(spark, d):
    out = seq.exploded_reviews(seq.running_ids(_sequence_table(spark, d), "conv_id"), "asin", "reviews")
    return out.select("user_id", "item_id", F.md5("review_text").alias("md5"))


@registered(f"WITH {CONV} SELECT user_id, md5(first) AS instruction, '' AS persona FROM conv")
def converted_instructions(spark, d):
    rows = seq.running_ids(_sequence_table(spark, d).withColumn("persona", F.lit(None).cast("string")), "conv_id")
    return seq.instructions(rows, "said", "persona").withColumn("instruction", F.md5("instruction"))


@registered("SELECT p_partkey AS item_id, p_brand AS asin, p_name AS title, '' AS description FROM part")
def converted_metadata(spark, d):
    return seq.metadata_from_mapping(table(spark, d, "part").select(F.col("p_partkey").alias("index"), F.col("p_brand").alias("asin"), F.col("p_name").alias("title")))


# Graph and neighbourhood.


@registered(q("""SELECT a.user_id, a.item_id, round(coalesce(max(e.recency), 0), 6) AS recency, coalesce(any_value(u.d), 0) AS user_degree, coalesce(any_value(i.d), 0) AS item_degree FROM cand a LEFT JOIN edges e ON e.user_id = a.user_id AND e.item_id = a.item_id
LEFT JOIN (SELECT user_id, count(*) AS d FROM edges GROUP BY 1) u ON u.user_id = a.user_id LEFT JOIN (SELECT item_id, count(*) AS d FROM edges GROUP BY 1) i ON i.item_id = a.item_id GROUP BY a.user_id, a.item_id""", EVAL))
def graph_lookup(spark, d):
    h = _histories(spark, d)
    # Of an item's edges the latest counts, whose own place is its recency.
    edges = _rows(h).where("split = 'train'").select("user_id", "item_id", ((F.col("pos") + 1) / (F.col("n") - 2)).alias("recency"))
    return rounded(graph.lookup(edges, _eval(spark, d, h).select("user_id", "item_id")), "recency")


@registered(q("SELECT user_id, count(*) FILTER (nb_type = 'item') AS n_items, count(*) FILTER (nb_type = 'user') AS n_users FROM top GROUP BY 1", NEIGHBORS, HYBRID, MIX))
def neighbor_kinds(spark, d):
    return pruning.counts_by_type(pruning.top_neighbors(edges(spark, d)))


@registered(q("SELECT user_id, 'item' AS nb_type, item_id AS nb_id, 'Item-' || item_id || ': close, weight ' || CAST(floor(recency * 100) AS INT) AS explanation FROM (SELECT DISTINCT user_id, item_id, recency FROM edges)"))
def own_rule(spark, d):
    """A rule registered by its user: the recency itself, explained in its own words."""
    # Of an item's edges the latest, whose own place is its recency: no two rows are the same, and none are held to compare.
    latest = edges(spark, d).where((F.col("pos") + 1) / F.col("n_train") == F.col("recency"))
    nb = latest.select("user_id", F.lit("item").alias("nb_type"), F.col("item_id").alias("nb_id"), "recency", F.lit(0).alias("overlap"), F.lit(1).alias("own_degree"))
    with pruning.rule_of_own("own", lambda edge, days, overlap, common, near, item: edge, "close"):
        ruled = pruning.explained(pruning.rule_score(nb, "Own"), "own")
    words = F.concat(F.substring_index("explanation", ":", 1), F.lit(": "), F.element_at(F.split("explanation", r"\. "), -1), F.lit(", weight "), F.floor(F.col("rule_score") * 100).cast("string"))
    return ruled.select("user_id", "nb_type", "nb_id", words.alias("explanation"))


# Memories and snapshots.

COMPACT = "comp AS (SELECT p_partkey % 2 = 0 AS even, p_partkey AS item_id, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ', liked' END AS memory FROM part)"


def _memories(spark, d, e: DataFrame | None = None) -> DataFrame:
    """Of every second item the bare title, of the others what was added to it; of every user how many items it has."""
    i = items(spark, d)
    mem = i.select(F.lit("item").alias("entity_type"), F.col("item_id").alias("entity_id"), F.when(F.col("item_id") % 2 == 0, F.col("title")).otherwise(F.concat("title", F.lit(", liked"))).alias("memory"))
    e = (edges(spark, d) if e is None else e).groupBy("user_id").agg(F.count("*").alias("n"))
    return mem.unionByName(e.select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.concat(F.col("n").cast("string"), F.lit(" items")).alias("memory")))


@registered(f"WITH {COMPACT} SELECT item_id, memory FROM comp WHERE NOT even")
def changed_memories(spark, d):
    """Memories saved and loaded; items whose memory says more than the title."""
    at = folder(spark)
    tables.save_memories(_memories(spark, d), at)
    return memory.changed_items(tables.load_memories(spark, at), items(spark, d))


SNAP = NEIGHBORS, HYBRID, MIX, EVAL


def _snapshot(spark, d) -> tuple[DataFrame, DataFrame]:
    h = _histories(spark, d)
    e = seq.train_edges(_rows(h))
    nb = pruning.top_neighbors(e)
    texts = nb.groupBy("user_id").agg(F.count("*").cast("string").alias("context"))
    log = _memories(spark, d, e).withColumn("seq", F.lit(1).cast("long"))
    users, held = memory.rebuilt(log, e, nb, texts, _eval(spark, d, h))
    at = folder(spark)
    tables.save_snapshot(users, held, at)
    return tables.load_snapshot(spark, at)


@registered(q("SELECT e.user_id, e.n || ' items' AS user_memory, CAST(t.n AS VARCHAR) AS neighbors_text, t.nodes AS neighbor_ids, e.n AS n_train_items FROM (SELECT user_id, count(*) AS n FROM edges GROUP BY 1) e JOIN (SELECT user_id, count(*) AS n, string_agg(CASE WHEN nb_type = 'item' THEN 'Item-' ELSE 'User-' END || nb_id, ',' ORDER BY ord) AS nodes FROM top GROUP BY 1) t USING (user_id)", *SNAP))
def snapshot_users(spark, d):
    """A snapshot rebuilt from a saved log, written and loaded."""
    return _snapshot(spark, d)[0].withColumn("neighbor_ids", F.array_join("neighbor_ids", ","))


@registered(q(f"SELECT item_id, memory FROM comp WHERE item_id IN (SELECT item_id FROM cand UNION SELECT nb_id FROM top WHERE nb_type = 'item')", *SNAP, COMPACT))
def snapshot_items(spark, d):
    return _snapshot(spark, d)[1]


@registered(q("""SELECT 'user' AS entity_type, user_id AS entity_id, 'saw ' || item_id AS memory FROM cand WHERE is_target UNION ALL SELECT 'item', item_id, 'seen' FROM cand WHERE is_target
UNION ALL SELECT 'item', item_id, 'near' FROM (SELECT c.user_id, c.item_id FROM cand c JOIN edges e ON e.user_id = c.user_id AND e.item_id = c.item_id WHERE c.pos < 4 UNION SELECT user_id, item_id FROM ei WHERE r = 1)""", EVAL, "ei AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS r FROM (SELECT DISTINCT user_id, item_id FROM edges))"))
def response_patches(spark, d):
    """Answers of the memory step to patches: updates of candidates and of the first train item; only neighbours count,
    and an update that an answer holds for both reasons is one."""
    cand, e = materialise(_eval(spark, d), "candidates"), edges(spark, d).select("user_id", "item_id").distinct()
    update = lambda c: F.struct(node_id(F.lit("item"), c).alias("neighbor_id"), F.lit("near").alias("memory_update"))
    near = cand.where("pos < 4").select("user_id", update(F.col("item_id")).alias("u")).unionByName(e.groupBy("user_id").agg(F.min("item_id").alias("i")).select("user_id", update(F.col("i")).alias("u")))
    near = near.groupBy("user_id").agg(F.collect_set("u").alias("neighbor_updates"))
    target = cand.where("is_target").select("user_id", "item_id")
    answers = target.select("user_id", F.concat(F.lit("saw "), F.col("item_id").cast("string")).alias("user_memory"), F.lit("seen").alias("item_memory")).join(near, "user_id")
    known = e.select("user_id", F.lit("item").alias("nb_type"), F.col("item_id").alias("nb_id"))
    told = memory.write_responses(target.withColumn("seq", F.lit(0)), answers)
    return memory.patches(told, known).select("entity_type", "entity_id", "memory")


@registered("""SELECT req_id, n_facets, failed FROM (SELECT doc_id AS req_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_facets, doc_id % 3 > 0 AS failed FROM documents)""")
def answered_requests(spark, d):
    """Every document asks; a third are answered, a third answer nothing, a third never."""
    docs = table(spark, d, "documents")
    req = docs.select(F.col("doc_id").alias("req_id"))
    text = F.when(F.col("doc_id") % 3 == 0, F.lit('{"facets": [{"facet": "x", "confidence": 0.5, "supporting_neighbors": []}]}')).otherwise(F.lit("no"))
    out = facets.answered(req, facets.parse_facets(docs.where("doc_id % 3 < 2").select(F.col("doc_id").alias("req_id"), text.alias("completion"))))
    return out.select("req_id", F.size("facets").alias("n_facets"), "failed")


@registered("""SELECT coalesce(reason, 'ok') AS reason, count(*) AS n, avg(CASE WHEN reason IS NULL THEN n_patches END) AS mean_patches FROM (SELECT CASE WHEN event_type = 'error' THEN event_type END AS reason, user_id AS n_patches FROM events) GROUP BY 1""")
def warmup_summary(spark, d):
    return memory.replay_summary(table(spark, d, "events").select(F.when(F.col("event_type") == "error", F.col("event_type")).alias("reason"), F.col("user_id").alias("n_patches")))


@registered("SELECT event_type AS stage, count(*) AS n, round(avg(value), 6) AS mean_seconds, avg(user_id) AS mean_patches FROM events GROUP BY 1")
def step_stats(spark, d):
    out = memory.step_stats(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"), F.col("user_id").alias("n_patches")))
    return rounded(out, "mean_seconds")


@registered(q("""SELECT 'graph.n_edges' AS metric, count(*)::DOUBLE AS value FROM edges UNION ALL SELECT 'graph.n_users', count(DISTINCT user_id) FROM edges UNION ALL SELECT 'graph.n_items', count(DISTINCT item_id) FROM edges
UNION ALL SELECT 'graph.mean_user_degree', round(count(*) / count(DISTINCT user_id), 6) FROM edges UNION ALL SELECT 'graph.mean_item_degree', round(count(*) / count(DISTINCT item_id), 6) FROM edges UNION ALL SELECT 'calls.n', count(*) FROM events"""))
def run_stats(spark, d):
    out = memory.run_stats(graph=graph.graph_stats(edges(spark, d)), calls=table(spark, d, "events").agg(F.count("*").alias("n")))
    return rounded(out, "value")


# Requests. The SQL writes the same texts.

FACT = "fac AS (SELECT user_id, title AS facet, row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) AS nth FROM edges JOIN items USING (item_id))"
CLIST = "string_agg('[Item-' || c.item_id || '] ' || i.title || {about}, chr(10) ORDER BY c.pos)"


def _facts(spark, d, e: DataFrame | None = None) -> DataFrame:
    """Facets of a user: titles of its train items, the latest first."""
    rows = (edges(spark, d) if e is None else e).join(items(spark, d), "item_id")
    return rows.select("user_id", F.col("title").alias("facet"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("pos"))).alias("nth"))


@registered(q("SELECT user_id, string_agg(facet, '; ' ORDER BY nth) AS summary FROM fac WHERE nth <= 5 GROUP BY 1", FACT))
def collaborative_summaries(spark, d):
    return context.collaborative_summary(_facts(spark, d))


@registered(q(f"""SELECT c.user_id, md5(f.t || {CLIST.format(about="''")}) AS md5 FROM cand c JOIN items i USING (item_id) JOIN (SELECT user_id, 'Facets:' || chr(10) || string_agg('- ' || facet, chr(10) ORDER BY nth) || chr(10) AS t FROM fac WHERE nth <= 10 GROUP BY 1) f ON f.user_id = c.user_id GROUP BY c.user_id, f.t""", EVAL, FACT))
def rerank_requests(spark, d):
    cand = _eval(spark, d).join(items(spark, d), "item_id").withColumn("memory", F.lit(None).cast("string"))
    return context.rerank_request(cand, _facts(spark, d)).select("user_id", F.md5("request").alias("md5"))


@registered(q(f"""SELECT c.user_id, md5({CLIST.format(about="' | ' || substr(i.description, 1, 200) || ' | ' || i.description")}) AS md5 FROM cand c JOIN items i USING (item_id) GROUP BY 1""", EVAL))
def plain_rerank_requests(spark, d):
    """Without facets: descriptions and tags."""
    cand = _eval(spark, d).join(items(spark, d), "item_id").withColumns({"memory": F.lit(None).cast("string"), "tags": F.array("description")})
    return context.rerank_request(cand).select("user_id", F.md5("request").alias("md5"))


@registered(q("""SELECT user_id, md5('Facets:' || chr(10) || f.t || chr(10) || chr(10) || 'User memory:' || chr(10) || (SELECT count(*) FROM edges e WHERE e.user_id = f.user_id) || ' items' || chr(10) || chr(10) || 'Item memory:' || chr(10) || '(none available)' || chr(10) || chr(10) || 'Neighbours:' || chr(10) || n.t) AS md5
FROM (SELECT user_id, string_agg('- ' || facet, chr(10) ORDER BY nth) AS t FROM fac WHERE nth <= 5 GROUP BY 1) f JOIN (SELECT user_id, string_agg('Item-' || nb_id || ': ' || CASE WHEN nb_id % 2 = 0 THEN '(No memory)' ELSE 'note ' || nb_id END, chr(10) ORDER BY place) AS t FROM (SELECT user_id, nb_id, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS place FROM top WHERE nb_type = 'item') WHERE place <= 5 GROUP BY 1) n USING (user_id)""", NEIGHBORS, HYBRID, MIX, FACT))
def write_requests(spark, d):
    e = materialise(edges(spark, d), "edges")
    nb = pruning.top_neighbors(e).where("nb_type = 'item'").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("ord")))
    listed = nb.select("user_id", "place", node_id(F.col("nb_type"), F.col("nb_id")).alias("node"), F.when(F.col("nb_id") % 2 == 0, "nan").otherwise(F.concat(F.lit("note "), F.col("nb_id").cast("string"))).alias("memory"))
    users = e.groupBy("user_id").agg(F.concat(F.count("*").cast("string"), F.lit(" items")).alias("user_memory"), F.lit(" ").alias("item_memory"))
    facts = materialise(_facts(spark, d, e).where("nth <= 5"), "facts")  # as many as a request shows
    return context.write_request(users, facts, listed).select("user_id", F.md5("request").alias("md5"))


@registered(q("""SELECT user_id, md5('Memory of the user:' || chr(10) || CASE WHEN user_id % 2 = 0 THEN '(no memory)' ELSE 'm' || user_id END || chr(10) || chr(10) || 'Neighbours:' || chr(10) || CASE WHEN user_id % 3 = 0 THEN '(none available)' ELSE 'n' || user_id END || chr(10) || chr(10) || 'Write the facets as JSON.') AS prompt,
md5('Summarise what this user wants as at most 7 facets with confidence and supporting neighbours, as JSON.' || chr(10) || chr(10) || 'n' || user_id) AS request FROM (SELECT DISTINCT user_id FROM edges)"""))
def policy_prompts(spark, d):
    users = edges(spark, d).select("user_id").distinct()
    said = lambda c, k: F.when(F.col("user_id") % k > 0, F.concat(F.lit(c), F.col("user_id").cast("string")))
    states = users.select("user_id", said("m", 2).alias("user_memory"), said("n", 3).alias("neighbors_text"))
    asks = context.retrieve_request(users.select("user_id", F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("context")))
    return context.policy_prompt(states).join(asks, "user_id").select("user_id", F.md5("prompt").alias("prompt"), F.md5("request").alias("request"))


CHOICE = "string_agg(chr(65 + c.pos::INT) || '. ' || i.title, chr(10) ORDER BY c.pos)"


@registered(q(f"""SELECT c.user_id AS req_id, md5(f.t || 'Candidates:' || chr(10) || {CHOICE} || chr(10) || 'Answer with one letter: ') AS md5 FROM cand c JOIN items i USING (item_id) JOIN (SELECT user_id, 'Preferences:' || chr(10) || string_agg('- ' || facet, chr(10) ORDER BY nth) || chr(10) AS t FROM fac WHERE nth <= 3 GROUP BY 1) f ON f.user_id = c.user_id GROUP BY c.user_id, f.t""", EVAL, FACT))
def choice_prompts(spark, d):
    held = _facts(spark, d).where("nth <= 3").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "facet"))), lambda x: x["facet"]).alias("facets"))
    rows = _eval(spark, d).join(items(spark, d), "item_id").join(held, "user_id")
    rows = rows.select(F.col("user_id").alias("req_id"), "pos", "title", F.lit(None).cast("string").alias("memory"), "facets", F.lit(None).cast("string").alias("instruction"))
    return context.choice_prompt(rows).select("req_id", F.md5("prompt").alias("md5"))


@registered(q("""SELECT user_id, item_id, CASE WHEN pos % 2 = 0 THEN 'Item ' || item_id || ' (fit: 0.' || pos || '0): fits' ELSE 'Item ' || item_id || ' is recommended based on collaborative signals.' END AS explanation, CASE WHEN pos % 2 = 0 THEN pos / 10 ELSE 0.0 END AS score FROM cand""", EVAL))
def explained_candidates(spark, d):
    """Every second candidate has a note, told twice."""
    cand = materialise(_eval(spark, d), "candidates")
    notes = cand.where("pos % 2 = 0").select("user_id", "item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"), (F.col("pos") / 10).alias("fit"), F.lit("fits").alias("rationale"))
    return context.candidate_explanations(rerank.note_scores(cand, notes), notes).select("user_id", "item_id", "explanation", "score")


# Rankings from responses.


@registered(q("""SELECT user_id, item_id, pos, s AS score, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, pos) AS rank FROM (SELECT *, CASE WHEN user_id % 3 > 0 THEN 0.5 WHEN pos % 2 = 0 THEN (item_id % 10) / 10 ELSE 0 END::DOUBLE AS s FROM cand)""", EVAL))
def response_rankings(spark, d):
    """A third of the users get scores, for every second candidate; a third an error, a third nothing."""
    cand = materialise(_eval(spark, d), "candidates")
    scores = F.array_compact(F.collect_list(F.when(F.col("pos") % 2 == 0, F.struct("item_id", ((F.col("item_id") % 10) / 10).alias("score"), F.lit("").alias("rationale")))))
    got = cand.where("user_id % 3 < 2").groupBy("user_id").agg((F.col("user_id") % 3 == 0).alias("ok"), scores.alias("scores"))
    return rerank.response_ranking(cand.select("user_id", "item_id", "pos"), got)


@registered(q("""SELECT metric, k, round(value, 6) AS value FROM (SELECT 'hit' AS metric, 3 AS k, avg(CASE WHEN p < 3 THEN 1.0::DOUBLE ELSE 0 END) AS value FROM t UNION ALL SELECT 'recall', 3, avg(CASE WHEN p < 3 THEN 1.0::DOUBLE ELSE 0 END) FROM t)""", EVAL,
    "t AS (SELECT user_id, r AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_id % 7 DESC, item_id) - 1 AS r FROM cand) WHERE is_target)"))
def score_metrics(spark, d):
    pos = metrics.positions(_eval(spark, d).select("user_id", "item_id", (F.col("item_id") % 7).alias("score"), "is_target"))
    return rounded(metrics.metric_rows(pos, (3,), ("hit", "recall")), "value")


@registered(q("""SELECT user_id AS req_id, item_id, 1 - (10 - pos - 1) / 10 AS score, false AS missing, false AS repeated FROM cand""", EVAL))
def permutation_scores(spark, d):
    """Permutations that turn the candidates round."""
    rows = _eval(spark, d).groupBy(F.col("user_id").alias("req_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"]).alias("candidates"))
    return rewards.permutation_scores(rows.withColumn("ranking", F.reverse("candidates")))


@registered(q("SELECT n, round(-sum(c / n * log2(c / n)), 6) AS entropy FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS n FROM cand WHERE is_target GROUP BY pos) GROUP BY n", EVAL))
def target_entropy(spark, d):
    return rounded(rewards.label_entropy(_eval(spark, d).where("is_target").select("pos")), "entropy")


# Arms and rewards.


@registered("""WITH u AS (SELECT DISTINCT conv_id AS user_id FROM conversations), n AS (SELECT user_id, coalesce(lead(user_id) OVER (ORDER BY user_id), (SELECT min(user_id) FROM u)) AS partner FROM u)
SELECT user_id, 'sample' || k AS arm, CASE WHEN user_id % 5 = 0 AND k = 2 THEN '' ELSE 'f' || user_id || '-' || k END AS facets FROM u, (SELECT unnest([1, 2]) AS k) UNION ALL SELECT user_id, 'shuffled', 'f' || partner || '-1' FROM n
UNION ALL SELECT user_id, 'lorem', 'Lorem ipsum dolor sit amet|Consectetur adipiscing elit|Sed do eiusmod tempor' FROM u UNION ALL SELECT user_id, 'empty', '' FROM u""")
def facet_arms(spark, d):
    """The five arms of every user; each fifth user's second sample failed."""
    users = table(spark, d, "conversations").select(F.col("conv_id").alias("user_id")).distinct()
    text = F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit("-"), F.col("nth").cast("string"))
    samples = users.withColumn("nth", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("facets", F.when((F.col("user_id") % 5 > 0) | (F.col("nth") == 1), F.array(text)))
    return records.arms(samples, sampling.shuffled_partner(users)).withColumn("facets", F.array_join("facets", "|"))


@registered(q("SELECT count(*) AS n, round(avg((abs(a.ndcg_at_5 - b.ndcg_at_5) < 1e-9)::INT), 6) AS tie_rate FROM arms a JOIN arms b USING (user_id) WHERE a.arm = 'sample1' AND b.arm = 'sample2'", EVAL, ARMS))
def sample_ties(spark, d):
    return rounded(rewards.sample_ties(_arms(spark, d), "ndcg_at_5"), "tie_rate")


@registered(q("SELECT round(s - e, 6) AS headroom, s - e < 0.01 AS flat FROM (SELECT avg(ndcg_at_5) FILTER (arm = 'sample1') AS s, avg(ndcg_at_5) FILTER (arm = 'empty') AS e FROM arms)", EVAL, ARMS))
def arm_headroom(spark, d):
    return rounded(metrics.headroom(metrics.arm_means(_arms(spark, d))), "headroom")


@registered(q("SELECT user_id, arm, round(ndcg_at_5, 6) AS proxy, hit_at_1 AS reference FROM arms WHERE user_id % 2 = 0", EVAL, ARMS))
def paired_scores(spark, d):
    """A proxy's and a reference's scores of the same user and arm; the reference has every second user."""
    s = _arms(spark, d)
    ref = s.where("user_id % 2 = 0").select("user_id", "arm", F.col("hit_at_1").alias("ndcg_at_5"))
    return rounded(rewards.paired_scores(s, ref, "ndcg_at_5"), "proxy")


@registered(q("SELECT user_id, arm, round((ndcg_at_5 - m) / s, 6) AS advantage FROM (SELECT *, avg(ndcg_at_5) OVER (PARTITION BY user_id) AS m, stddev_pop(ndcg_at_5) OVER (PARTITION BY user_id) AS s FROM arms) WHERE s > 0", EVAL, ARMS))
def group_advantages(spark, d):
    out = rewards.group_advantages(_arms(spark, d).select(F.col("user_id").alias("group"), "arm", F.col("ndcg_at_5").alias("total")))
    return out.select(F.col("group").alias("user_id"), "arm", F.round("advantage", 6).alias("advantage"))


@registered(q("""SELECT user_id, arm AS req_id, round(ndcg_at_5, 6) AS total FROM (SELECT *, max(CASE WHEN arm = 'empty' THEN ndcg_at_5 END) OVER (PARTITION BY user_id) AS nul, row_number() OVER (PARTITION BY user_id ORDER BY (arm <> 'empty') DESC, ndcg_at_5 DESC, arm DESC) AS r FROM arms) WHERE r = 1 AND ndcg_at_5 > nul""", EVAL, ARMS))
def best_of_n(spark, d):
    s = _arms(spark, d)
    none = s.where("arm = 'empty'").select("user_id", F.col("ndcg_at_5").alias("null_total"))
    out = rewards.best_of_n(s.where("arm <> 'empty'").select("user_id", F.col("arm").alias("req_id"), F.col("ndcg_at_5").alias("total")).join(none, "user_id"))
    return rounded(out, "total")


@registered(q("SELECT 'arms of user ' || user_id AS fault FROM (SELECT DISTINCT user_id FROM arms) WHERE user_id % 10 = 0 UNION ALL SELECT 'sample1 is not above empty' FROM (SELECT avg(ndcg_at_5) FILTER (arm = 'sample1') AS s, avg(ndcg_at_5) FILTER (arm = 'empty') AS e FROM arms) WHERE NOT s > e", EVAL, ARMS))
def reference_faults(spark, d):
    """A reference in which every tenth user lacks an arm."""
    s = _arms(spark, d)
    return leakage.reference_faults(s.where("user_id % 10 > 0 or arm <> 'lorem'"), metrics.arm_means(s))


# Records and their audits.


def _records(spark, d, cand: DataFrame | None = None) -> DataFrame:
    cand = materialise(_eval(spark, d), "candidates") if cand is None else cand
    c = cand.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"]).alias("candidates"), F.max(F.when(F.col("is_target"), F.col("item_id"))).alias("gold_item_id"))
    about = c.join(items(spark, d).select(F.col("item_id").alias("gold_item_id"), F.col("title").alias("gold_title")), "gold_item_id")
    # Each seventh prompt names the gold item, each fifth another candidate, each third the gold title.
    u = F.col("user_id")
    said = F.when(u % 7 == 0, F.concat(F.lit("Item-"), F.col("gold_item_id").cast("string"))).when(u % 5 == 0, F.concat(F.lit("see Item-"), F.col("candidates")[1].cast("string"))).when(u % 3 == 0, F.concat(F.lit("He read: "), F.repeat(F.concat("gold_title", F.lit("!! ")), 3))).otherwise("Nothing of note")
    return about.withColumn("prompt", said).withColumn("gold_title", F.rtrim(F.repeat(F.concat("gold_title", F.lit(" ")), 3)))


REC = f"""rec AS (SELECT c.user_id, max(c.item_id) FILTER (c.is_target) AS gold, max(c.item_id) FILTER (c.pos = 1) AS second, any_value(i.title) FILTER (c.is_target) AS title FROM cand c JOIN items i USING (item_id) GROUP BY 1),
leak AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'gold id' WHEN user_id % 5 = 0 THEN CASE WHEN second = gold THEN 'gold id' ELSE 'candidate id' END WHEN user_id % 3 = 0 AND length({NORM.format(c="title || ' ' || title || ' ' || title")}) >= 25 THEN 'gold title' END AS reason FROM rec)"""


@registered(q("SELECT user_id, reason FROM leak", EVAL, REC))
def leak_reasons(spark, d):
    """Ids and gold titles in prompts, the first reason of each."""
    return leakage.leak_reason(_records(spark, d)).select("user_id", "reason")


@registered(q("""SELECT part, CASE WHEN reason IS NOT NULL THEN 'leaked' WHEN user_id % 11 = 0 THEN 'no state' ELSE 'record' END AS status, count(*) AS n FROM parts LEFT JOIN leak USING (user_id) GROUP BY ALL""", EVAL, REC, PARTS))
def record_counts(spark, d):
    cand = materialise(_eval(spark, d), "candidates")
    rec = materialise(_records(spark, d, cand), "records")
    _, dropped = leakage.screened(rec)
    return records.record_counts(_parts(spark, d), rec.where("user_id % 11 > 0").select("user_id"), cand, dropped)


@registered(q("""SELECT user_id, 'gold not in candidates' AS fault FROM rec WHERE user_id % 4 = 0 UNION ALL SELECT user_id, 'repeated candidates' FROM rec WHERE user_id % 6 = 0 UNION ALL SELECT user_id, 'empty prompt' FROM rec WHERE user_id % 9 = 0 UNION ALL SELECT user_id, 'no snippets' FROM rec WHERE user_id % 2 = 0""", EVAL, REC))
def record_faults(spark, d):
    u = F.col("user_id")
    rec = _records(spark, d).withColumns({
        "gold_item_id": F.when(u % 4 == 0, F.lit(-1)).otherwise(F.col("gold_item_id")), "candidates": F.when(u % 6 == 0, F.concat("candidates", "candidates")).otherwise(F.col("candidates")),
        "prompt": F.when(u % 9 == 0, " ").otherwise(F.col("prompt")), "neighbor_snippets": F.when(u % 2 == 1, F.create_map(F.lit("Item-1"), F.lit("x"))),
    })
    return leakage.record_faults(rec)


@registered(q(f"SELECT user_id FROM rec WHERE user_id % 2 = 0 AND length({NORM.format(c='title')}) > 0", EVAL, REC))
def instruction_leaks(spark, d):
    rec = _records(spark, d)
    title = F.trim(F.substring_index("gold_title", " ", 2))
    return leakage.instruction_leaks(rec.select("user_id", F.concat(F.lit("x "), "gold_title").alias("prompt"), F.when(F.col("user_id") % 2 == 0, title).otherwise("never said").alias("instruction")))


@registered("""SELECT user_id, baseline_h1, r_null FROM (SELECT user_id, CASE WHEN user_id % 4 > 0 THEN (user_id % 10) / 10 END AS baseline_h1, CASE WHEN user_id % 3 = 0 THEN 0.5::DOUBLE END AS r_null FROM (SELECT DISTINCT user_id FROM events)) WHERE baseline_h1 IS NULL OR baseline_h1 BETWEEN 0.2 AND 0.8""")
def banded_records(spark, d):
    """Records in the difficulty band, with a column filled in by user."""
    u = table(spark, d, "events").select("user_id").distinct()
    rows = u.select("user_id", F.when(F.col("user_id") % 4 > 0, (F.col("user_id") % 10) / 10).alias("baseline_h1"), F.lit(None).cast("double").alias("r_null"))
    return records.back_filled(records.dataset(rows), u.where("user_id % 3 = 0").select("user_id", F.lit(0.5).alias("r_null")), "r_null")[0]


@registered(q("SELECT count(*) AS n, CAST(sum(10) AS BIGINT) AS n_candidates, count(DISTINCT gold) AS n_gold FROM rec", EVAL, REC))
def frozen_records(spark, d):
    """Candidate-blind records of every user, written as JSON lines and read again, leaks kept in."""
    inter = tables.order_interactions(table(spark, d, "lineitem"), table(spark, d, "orders"))
    none = spark.createDataFrame([], "user_id long, instruction string")
    told = materialise(_memories(spark, d), "memories")  # read three times
    ready = pipelines.prepare(inter, tables.ORDER, items(spark, d), told, blind=True)
    kept, dropped = pipelines.freeze(ready, items(spark, d), told, none)
    at = folder(spark)
    tables.write_records(kept.unionByName(dropped.drop("reason").select(*kept.columns)), at)
    got = tables.read_records(spark, at)
    rewards.check_columns(got)
    return got.agg(F.count("*").alias("n"), F.sum(F.size("candidates")).alias("n_candidates"), F.count_distinct("gold_item_id").alias("n_gold"))


@registered("SELECT conv_id AS req_id, arg_max(md5(text), turn) AS md5, max(turn) >= 4 AS long FROM conversations GROUP BY 1")
def chat_completions(spark, d):
    """The last message of every conversation, by a model step that is plugged in."""
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("req_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("content")))).alias("messages"))
    said = rows.select("req_id", F.md5(rewards.last_message()).alias("md5"), F.size("messages").alias("n"))

    def step(frames):
        for f in frames:
            yield f.assign(long=f["n"] > 4)[["req_id", "md5", "long"]]

    return context.pluggable(said, step, "req_id long, md5 string, long boolean")


# Vectors and proxy scores.


@registered("""WITH w AS (SELECT doc_id AS user_id, unnest(regexp_split_to_array(trim(lower(text)), '\\s+')) AS word FROM documents WHERE doc_id % 2 = 0),
c AS (SELECT user_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS dim, count(*) AS n FROM w WHERE length(word) > 0 GROUP BY ALL)
SELECT d.doc_id AS user_id, 64 AS width, coalesce(v.nz, 0) AS nonzero, round(coalesce(v.top, 0), 6) AS top FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT user_id, count(*) AS nz, max(n / len) AS top FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY user_id)) AS len FROM c) GROUP BY 1) v ON v.user_id = d.doc_id""")
def dense_vectors(spark, d):
    """Facet vectors with all their dimensions: zeros for every second document, which has no facet."""
    docs = table(spark, d, "documents")
    rows = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("user_id"), F.col("text").alias("facet"), F.lit(0.5).alias("confidence"))
    out = facets.dense_vectors(docs.select(F.col("doc_id").alias("user_id")), facets.facet_vectors(rows))
    nonzero = F.size(F.filter("vector", lambda v: v != 0)).cast("long")
    return out.select("user_id", F.size("vector").alias("width"), nonzero.alias("nonzero"), F.round(F.array_max("vector"), 6).alias("top"))


@registered("SELECT item_id, word, round(sum(v), 6) AS weight FROM (SELECT p_partkey AS item_id, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS word, 0.5::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, lower(p_type), 0.25 FROM part) WHERE length(word) > 3 GROUP BY ALL")
def memory_map_words(spark, d):
    """Memories in the form of a map from words to confidences."""
    name, kind = F.concat_ws(" ", "p_name", "p_type"), F.concat(F.col("p_type"), F.lit(" "))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.create_map(name, F.lit(0.5), kind, F.lit(0.25)).alias("memory"))
    return rounded(rerank.memory_map_words(rows), "weight")


@registered(q("""SELECT arm, count(*) AS n, round(avg(CASE WHEN r < 5 THEN 1 / log2(r + 2.0) ELSE 0 END), 6) AS ndcg_at_5, round(avg(CASE WHEN r < 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_at_1 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, arm ORDER BY logit DESC, pos) - 1 AS r
FROM (SELECT p.user_id, p.arm, c.item_id, c.pos, c.is_target, ((CAST('0x' || substr(sha256(p.prompt || '|' || c.item_id), 1, 8) AS BIGINT)::DOUBLE * 4294967296.0::DOUBLE + CAST('0x' || substr(sha256(p.prompt || '|' || c.item_id), 9, 8) AS BIGINT)::DOUBLE) / 18446744073709551616.0::DOUBLE - 0.5::DOUBLE) * 8.0::DOUBLE AS logit FROM pr p JOIN cand c USING (user_id))) WHERE is_target GROUP BY 1""", EVAL, FACT,
    f"ch AS (SELECT c.user_id, {CHOICE} AS t FROM cand c JOIN items i USING (item_id) GROUP BY 1)",
    "us AS (SELECT DISTINCT user_id FROM cand)", "fs AS (SELECT user_id, string_agg('- ' || facet, chr(10) ORDER BY nth) AS t FROM fac WHERE nth <= 3 GROUP BY 1)",
    "nx AS (SELECT user_id, coalesce(lead(user_id) OVER (ORDER BY user_id), (SELECT min(user_id) FROM us)) AS partner FROM us)",
    "af AS (SELECT user_id, 'sample' || k AS arm, t FROM fs, (SELECT unnest([1, 2]) AS k) UNION ALL SELECT n.user_id, 'shuffled', f.t FROM nx n JOIN fs f ON f.user_id = n.partner UNION ALL SELECT user_id, 'lorem', '- Lorem ipsum dolor sit amet' || chr(10) || '- Consectetur adipiscing elit' || chr(10) || '- Sed do eiusmod tempor' FROM us UNION ALL SELECT user_id, 'empty', NULL FROM us)",
    "pr AS (SELECT user_id, arm, CASE WHEN af.t IS NULL THEN '' ELSE 'Preferences:' || chr(10) || af.t || chr(10) END || 'Candidates:' || chr(10) || ch.t || chr(10) || 'Answer with one letter: ' AS prompt FROM af JOIN ch USING (user_id))"))
def proxy_scores(spark, d):
    """Every (user, arm) scored by the deterministic ranker from its own facets, and the means of the arms."""
    cand = materialise(_eval(spark, d), "candidates")
    three = _facts(spark, d).where("nth <= 3").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "facet"))), lambda x: x["facet"]).alias("facets"))
    samples = three.withColumn("nth", F.explode(F.array(F.lit(1), F.lit(2))))
    arms = records.arms(samples, sampling.shuffled_partner(cand.select("user_id").distinct()))
    return rounded(metrics.arm_means(pipelines.proxy_scores(cand, items(spark, d), arms)), "ndcg_at_5", "hit_at_1")
