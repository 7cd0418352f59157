"""Registered queries over whole flows and their files: evaluation, record contents, results, reports, answers and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.operators import facets, leakage, memory, metrics, records, rerank, rewards
from loomrec.operators import sequences as seq
from loomrec.oracles import EVAL, HYBRID, MIX, NEIGHBORS, draw, q
from loomrec.plans import pipelines
from loomrec.queries import _eval, _titles, edges, items, rounded, split, table
from loomrec.record_queries import COMPACT, CONV, PARTS, _memories, _parts, _sequence_table, folder
from loomrec.scratch import materialise
from loomrec.sources import tables

QUERIES, ORACLES = {}, {}


def registered(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


# Files.


@registered(q("SELECT user_id, part FROM parts", PARTS))
def split_file(spark, d):
    """Splits written and read again whole."""
    at = folder(spark)
    tables.write_splits(_parts(spark, d), at)
    return tables.read_splits(spark, at)


@registered(q("SELECT DISTINCT user_id FROM split WHERE user_id IN (SELECT user_id FROM events)"))
def user_list(spark, d):
    """A list of users in one JSON object, cut down to the users there are."""
    at = folder(spark)
    table(spark, d, "events").agg(F.collect_set("user_id").alias("user_ids")).coalesce(1).write.json(at)
    return tables.read_user_list(spark, at, split(spark, d))


POS = "p AS (SELECT conv_id, count(*) AS n, (conv_id * 7) % 13 AS pos FROM conversations GROUP BY 1)"
GRID = ", ".join(f"round(avg({v}), 6) AS {m}_{k}" for k in (1, 5) for m, v in (("hit", f"CASE WHEN pos < {k} THEN 1.0::DOUBLE ELSE 0 END"), ("ndcg", f"CASE WHEN pos < {k} THEN 1 / log2(pos + 2.0) ELSE 0 END")))


@registered(f"""WITH {POS}, g AS (SELECT 'long' AS run, {GRID} FROM p WHERE n >= 4 UNION ALL SELECT 'short', {GRID} FROM p WHERE n < 4),
m AS (UNPIVOT g ON COLUMNS(* EXCLUDE (run)) INTO NAME c VALUE v) SELECT run, replace(c, '_', '@') AS cell, v AS value FROM m UNION ALL
SELECT 'summary ' || CASE run WHEN 'long' THEN 'full' ELSE 'no memory' END, replace(c, '_', '@'), v FROM m""")
def run_results(spark, d):
    """Two runs' metrics, a file for each and a row for each in the summary; the first is written twice."""
    at = folder(spark)
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("pos", (F.col("conv_id") * 7 % 13).cast("int"))
    ks, names = (1, 5), ("hit", "ndcg")
    for run, mode, rows in (("long", "full", c.where("n < 4")), ("long", "full", c.where("n >= 4")), ("short", "vanilla", c.where("n < 4"))):
        tables.write_run(metrics.metric_rows(rows, ks, names), mode, run, at, ks=ks, names=names)
    runs, summary = tables.read_runs(spark, at)
    cells = F.explode(F.array(*[F.struct(F.lit(f"{m}@{k}").alias("cell"), F.col(f"`{m}@{k}`").alias("value")) for k in ks for m in names])).alias("c")
    rows = summary.select(F.concat(F.lit("summary "), "mode").alias("run"), cells).select("run", "c.*")
    return rounded(runs.select("run", F.concat_ws("@", "metric", "k").alias("cell"), "value").unionByName(rows), "value")


@registered(f"""WITH {CONV}, r AS (SELECT user_id, turn, role, text FROM conversations JOIN conv USING (conv_id))
SELECT 'interaction' AS kind, user_id AS a, turn AS b, CAST(row_number() OVER (PARTITION BY user_id ORDER BY turn) AS VARCHAR) AS value FROM r UNION ALL SELECT 'review', user_id, turn, md5(text) FROM r WHERE role = 'user'
UNION ALL SELECT 'item', p_partkey, 0, md5(p_name) FROM part UNION ALL SELECT 'told', user_id, 0, md5(first) FROM conv
UNION ALL SELECT 'statistics', 0, 0, 'n_users: ' || count(DISTINCT user_id) FROM r UNION ALL SELECT 'statistics', 0, 0, 'n_items: ' || count(DISTINCT turn) FROM r UNION ALL SELECT 'statistics', 0, 0, 'n_rows: ' || count(*) FROM r""")
def conversion_files(spark, d):
    """A conversion's four tables and statistics, written, read again by split and compared whole; texts run over lines."""
    at = f"{folder(spark)}/x"
    rows = seq.running_ids(_sequence_table(spark, d).withColumn("persona", F.lit(None).cast("string")), "conv_id")
    inter = seq.exploded_interactions(_sequence_table(spark, d), "conv_id", "asin")
    about = seq.metadata_from_mapping(table(spark, d, "part").select(F.col("p_partkey").alias("index"), F.col("p_brand").alias("asin"), F.col("p_name").alias("title")))
    stats = seq.conversion_stats(inter).select("n_users", "n_items", "n_rows")
    tables.write_conversion(inter, seq.exploded_reviews(rows, "asin", "reviews"), about, seq.instructions(rows, "said", "persona"), stats, at)
    got, none = tables.load_all(spark, at), F.lit(0).cast("long")
    out = got["interactions"].select(F.lit("interaction").alias("kind"), F.col("user_id").alias("a"), F.col("item_id").alias("b"), F.col("timestamp").cast("long").cast("string").alias("value"))
    out = out.unionByName(got["reviews"].select(F.lit("review").alias("kind"), F.col("user_id").alias("a"), F.col("item_id").alias("b"), F.md5("review_text").alias("value")))
    out = out.unionByName(got["items"].select(F.lit("item").alias("kind"), F.col("item_id").alias("a"), none.alias("b"), F.md5("title").alias("value")))
    out = out.unionByName(got["instructions"].select(F.lit("told").alias("kind"), F.col("user_id").alias("a"), none.alias("b"), F.md5("instruction").alias("value")))
    return out.unionByName(spark.read.text(f"{at}.statistics").select(F.lit("statistics").alias("kind"), none.alias("a"), none.alias("b"), "value"))


@registered("SELECT doc_id AS user_id, 'toxic' AS reason FROM labels WHERE toxic = 1 UNION ALL SELECT count(*), 'n' FROM labels UNION ALL SELECT CAST(sum(quality) AS BIGINT), 'good' FROM labels")
def validation_report(spark, d):
    """A report of one row and the log of dropped users, written and read again."""
    at, labels = folder(spark), table(spark, d, "labels")
    tables.write_report(labels.agg(F.count("*").alias("n"), F.sum("quality").alias("good")), labels.where("toxic = 1").select(F.col("doc_id").alias("user_id"), F.lit("toxic").alias("reason")), at)
    report, dropped = tables.read_report(spark, at)
    numbers = report.select(F.inline(F.array(*[F.struct(F.col(c).cast("long").alias("user_id"), F.lit(c).alias("reason")) for c in ("n", "good")])))
    return dropped.unionByName(numbers)


NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@registered(f"SELECT name || '.parquet' AS name, true AS present, true AS sha_match, true AS ok FROM (SELECT unnest({NAMES}) AS name) UNION ALL SELECT 'missing', false, true, false UNION ALL SELECT 'extra', false, true, true UNION ALL SELECT 'region.parquet', true, false, false")
def audited_files(spark, d):
    """The tables' own files against a manifest of digests that Spark's file sources give; one table's digests are wrong,
    and two files are not there. A table of several files is whole if each of them is."""
    table_of = lambda c: F.substring_index(c, "/", 1)
    sha = leakage.source_digests(spark, f"{d}/*.parquet", d).where(table_of("name").isin([f"{n}.parquet" for n in NAMES]))
    kinds = F.when(table_of("name") == "region.parquet", F.array(F.lit("told"), F.lit("wrong"))).otherwise(F.array(F.lit("told")))
    rows = sha.select("name", "sha256", F.lit(True).alias("required"), F.explode(kinds).alias("kind"))
    rows = rows.withColumn("sha256", F.when(F.col("kind") == "wrong", "0").otherwise(F.col("sha256")))
    more = spark.createDataFrame([("missing", None, True, "told"), ("extra", None, False, "told")], "name string, sha256 string, required boolean, kind string")
    audit = leakage.file_audit(spark, f"{d}/*.parquet", rows.unionByName(more).withColumn("lines", F.lit(None).cast("long")), d)
    return audit.groupBy(table_of("name").alias("name"), "kind").agg(*[F.bool_and(c).alias(c) for c in ("present", "sha_match", "ok")]).drop("kind")


# Statistics by sketches.


@registered("SELECT true AS users_close, true AS items_close, count(*) AS n_rows FROM lineitem")
def sketched_conversion(spark, d):
    """Distinct users and items from sketches of every year's orders, against the exact numbers: within 3 %, four standard errors."""
    rows = tables.order_interactions(table(spark, d, "lineitem"), table(spark, d, "orders"))
    inter = materialise(rows.select("user_id", "item_id", F.year("o_orderdate").alias("year")), "inter")
    guess, exact = seq.sketched_stats(seq.count_sketches(inter, "year")), seq.conversion_stats(inter)
    near = lambda c: (F.abs(F.col(f"g.{c}") - F.col(f"e.{c}")) <= 0.03 * F.col(f"e.{c}"))
    return guess.alias("g").join(exact.alias("e"), F.col("g.n_rows") == F.col("e.n_rows")).select(near("n_users").alias("users_close"), near("n_items").alias("items_close"), F.col("g.n_rows").alias("n_rows"))


# Memories.

SPOILT = "CASE doc_id % 6 WHEN 0 THEN 'nan' WHEN 1 THEN ' [NaN] ' WHEN 2 THEN '['''']' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE text END"


@registered(f"SELECT doc_id, md5(CASE WHEN m IS NULL OR lower(trim(m)) IN ('', 'nan', '[nan]', '['''']', '[]') THEN '(No memory)' ELSE m END) AS md5 FROM (SELECT doc_id, {SPOILT} AS m FROM documents)")
def cleaned_memories(spark, d):
    spoilt = F.expr(SPOILT.replace("['''']", "[\\'\\']"))
    return table(spark, d, "documents").select("doc_id", F.md5(memory.cleaned(spoilt)).alias("md5"))


@registered(q("SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 'No memory yet.' ELSE 'm' || user_id END AS memory FROM split"))
def user_summaries(spark, d):
    """Users' memories, with the default for those that have none."""
    users = split(spark, d).select("user_id").distinct()
    held = users.where("user_id % 3 > 0").select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("memory"))
    return memory.user_summary(users, held)


@registered(q("SELECT c.user_id, 'm' || c.user_id AS state, c.item_id, CASE WHEN c.item_id % 2 = 0 THEN '' ELSE p_name || ', liked' END AS memory FROM cand c JOIN part ON p_partkey = c.item_id", EVAL))
def snapshot_lookups(spark, d):
    """Every asked user's state, which must be there, and item memories with '' for those that are not."""
    asked = materialise(_eval(spark, d).select("user_id", "item_id"), "asked")
    states = asked.select("user_id").distinct().withColumn("state", F.concat(F.lit("m"), F.col("user_id").cast("string")))
    return memory.item_lookup(memory.user_lookup(asked, states), _memories(spark, d).where("entity_type = 'user' or entity_id % 2 = 1"))


@registered(q(f"SELECT user_id, cand.item_id, memory FROM cand JOIN comp ON comp.item_id = cand.item_id WHERE NOT even", EVAL, COMPACT))
def known_candidates(spark, d):
    """Candidates that have a memory; every memory comes twice, in an older and a newer form."""
    held = _memories(spark, d).where("entity_type = 'user' or entity_id % 2 = 1").withColumn("seq", F.lit(2).cast("long"))
    older = held.withColumns({"memory": F.lit("zzz"), "seq": F.lit(1).cast("long")})
    return records.candidate_memories(_eval(spark, d), held.unionByName(older)).select("user_id", "item_id", "memory")


GATED = "g AS (SELECT conv_id AS user_id, CASE WHEN conv_id % 4 > 0 THEN (conv_id * 7) % 17 END AS pos FROM (SELECT DISTINCT conv_id FROM conversations))"


@registered(f"WITH {GATED} SELECT user_id, 'top' AS gate FROM g WHERE pos < 10 UNION ALL SELECT user_id, 'present' FROM g WHERE pos IS NOT NULL UNION ALL SELECT user_id, 'CLICK' FROM g WHERE pos < 5")
def write_gates(spark, d):
    """Users whose memories may be written, by either gate, and those that give feedback."""
    at = F.when(F.col("conv_id") % 4 > 0, F.col("conv_id") * 7 % 17)
    ranked = table(spark, d, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("user_id"), at.alias("pos"))
    gates = [memory.write_gate(ranked).select("user_id", F.lit("top").alias("gate")), memory.write_gate(ranked, None).select("user_id", F.lit("present").alias("gate")), memory.feedback(ranked).withColumnRenamed("gt", "gate")]
    return gates[0].unionByName(gates[1]).unionByName(gates[2])


# Facets.

#: Forms of one facet that models write: names of the list, of the text, of the confidence and of the cited ids.
FORMS = (
    ('{"preferences": [{"text": "%s", "score": "85%%", "source_ids": ["item_%d", "u-7"]}]}', 0.85, ("Item-%d", "User-7")),
    ('[{"facet": "%s", "confidence": 7, "supporting_neighbors": "Item-%d, junk; User 8"}]', 1.0, ("Item-%d", "User-8")),
    ('{"facets": ["%s"], "note": %d}', 0.5, ()),
    ('{"facets": [{"facet": "%s", "confidence": "about 0.25", "supporting_neighbors": ["[Item-%d]"]}, {"facet": "  "}]}', 0.25, ("Item-%d",)),
)


def _forms(docs: DataFrame) -> DataFrame:
    """A completion for every document, in one form after the other."""
    text = F.substring(F.concat(F.lit("t "), F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), 1, 100)
    said = F.lit(None).cast("string")
    for k, (form, *_) in enumerate(FORMS):
        said = F.when(F.col("doc_id") % len(FORMS) == k, F.format_string(form, text, F.col("doc_id"))).otherwise(said)
    return docs.select(F.col("doc_id").alias("req_id"), said.alias("completion"))


def _forms_sql(cited: str) -> str:
    case = lambda pick: "CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {pick(f)}" for k, f in enumerate(FORMS)) + " END"
    ids = case(lambda f: "[" + ", ".join("'" + x.replace("%d", "' || doc_id || '") + "'" for x in f[2]) + "]::VARCHAR[]")
    said = "trim(substr('t ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), 1, 100))"
    return f"SELECT doc_id AS req_id, md5({said}) AS md5, {case(lambda f: f'{f[1]}::DOUBLE')} AS confidence, array_to_string({cited.format(ids=ids)}, ',') AS cited FROM documents"


@registered(_forms_sql("{ids}"))
def facet_forms(spark, d):
    """Facets under other names, with confidences as texts, percentages and too large, and ids in many forms."""
    out = facets.parse_facets(_forms(table(spark, d, "documents"))).select("req_id", F.inline("facets"))
    return out.select("req_id", F.md5("facet").alias("md5"), "confidence", F.array_join("supporting_neighbors", ",").alias("cited"))


@registered(_forms_sql("list_filter({ids}, lambda x: x = 'User-7' OR x = 'Item-' || (doc_id - doc_id % 3))"))
def cited_facets(spark, d):
    """The same, with citations of unknown neighbours left out."""
    allowed = F.array(F.lit("User-7"), F.concat(F.lit("Item-"), (F.col("req_id") - F.col("req_id") % 3).cast("string")))
    out = facets.parse_facets(_forms(table(spark, d, "documents")).withColumn("allowed", allowed), allowed="allowed").select("req_id", F.inline("facets"))
    return out.select("req_id", F.md5("facet").alias("md5"), "confidence", F.array_join("supporting_neighbors", ",").alias("cited"))


@registered(f"SELECT doc_id AS req_id, doc_id % 3 = 0 AS failed, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n FROM documents")
def facet_bundles(spark, d):
    """The bundle of every request; one that was not answered has no facets."""
    docs = table(spark, d, "documents")
    parsed = facets.parse_facets(_forms(docs.where("doc_id % 3 > 0")))
    return facets.answered(docs.select(F.col("doc_id").alias("req_id")), parsed).select("req_id", "failed", F.size("facets").alias("n"))


# Reranking and evaluation.

SAID = "said AS (SELECT user_id, string_agg(title, '. ' ORDER BY nth) AS t FROM (SELECT user_id, title, n_train - pos AS nth FROM edges JOIN items USING (item_id) WHERE pos >= n_train - 3) WHERE length(title) > 0 GROUP BY 1)"
HASHED = f"""vw AS (SELECT who, id, unnest(regexp_split_to_array(lower(trim(t)), '\\s+')) AS word FROM (SELECT 'u' AS who, c.user_id AS id, coalesce(t, 'General recommendations') AS t FROM (SELECT DISTINCT user_id FROM cand) c LEFT JOIN said USING (user_id)
  UNION ALL SELECT 'i', p_partkey, p_name || '. ' || replace(p_type, ' ', ', ') || '. ' || p_brand FROM part)),
vc AS (SELECT who, id, {draw("word", "64")} AS dim, count(*)::DOUBLE AS n FROM vw GROUP BY ALL), vn AS (SELECT who, id, sqrt(sum(n * n)) AS norm FROM vc GROUP BY ALL)"""


@registered(q("""SELECT user_id, item_id, pos, round(s, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 12) DESC, pos) AS rank FROM (SELECT c.user_id, c.item_id, c.pos, coalesce(x.dot / (a.norm * b.norm), 0) AS s FROM cand c JOIN vn a ON a.who = 'u' AND a.id = c.user_id JOIN vn b ON b.who = 'i' AND b.id = c.item_id
LEFT JOIN (SELECT c.user_id, c.item_id, sum(u.n * i.n) AS dot FROM cand c JOIN vc u ON u.who = 'u' AND u.id = c.user_id JOIN vc i ON i.who = 'i' AND i.id = c.item_id AND i.dim = u.dim GROUP BY ALL) x USING (user_id, item_id))""", EVAL, SAID, HASHED))
def text_rerank(spark, d):
    """Dense reranking from profile and item texts, encoded in batches by a deterministic encoder."""
    told = edges(spark, d).where(F.col("pos") >= F.col("n_train") - 3).join(items(spark, d), "item_id").select("user_id", (F.col("n_train") - F.col("pos")).alias("nth"), F.col("title").alias("facet"))
    about = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.split("p_type", " ").alias("tags"), F.col("p_brand").alias("memory"))
    cand = materialise(_eval(spark, d).select("user_id", "item_id", "pos"), "candidates")  # read three times
    out = rerank.text_rerank(cand, told, about)
    out = rerank.ranked(out.drop("rank").withColumn("score", F.round("score", 12)))
    return rounded(out, "score")


EVALUATED = (
    "iw AS (SELECT item_id, word, sum(w) AS w FROM (SELECT p_partkey AS item_id, unnest(regexp_split_to_array(lower(trim(p_name)), '\\s+')) AS word, 0.5::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, unnest(regexp_split_to_array(lower(trim(p_brand || ' ' || p_type)), '\\s+')), 0.5 FROM part) WHERE length(word) > 3 GROUP BY ALL)",
    "uw AS (SELECT user_id, word, max(c) AS w FROM (SELECT user_id, unnest(regexp_split_to_array(lower(trim(title)), '\\s+')) AS word, 1.0 / (n_train - pos) AS c FROM edges JOIN items USING (item_id) WHERE pos >= n_train - 3) WHERE length(word) > 3 GROUP BY ALL)",
    "dt AS (SELECT c.user_id, c.item_id, sum(i.w * u.w) AS dot FROM cand c JOIN iw i USING (item_id) JOIN uw u ON u.user_id = c.user_id AND u.word = i.word GROUP BY ALL)",
    "ec AS (SELECT c.user_id, c.item_id, c.pos, c.is_target, coalesce(t.dot / ((SELECT sqrt(sum(w * w)) FROM uw WHERE uw.user_id = c.user_id) * (SELECT sqrt(sum(w * w)) FROM iw WHERE iw.item_id = c.item_id)), 0) AS score FROM cand c LEFT JOIN dt t USING (user_id, item_id))",
    "ep AS (SELECT 'facets' AS stage, is_target, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pos) - 1 AS pos FROM ec UNION ALL SELECT 'none', is_target, pos FROM cand)",
)


@registered(q("""SELECT stage, 'hit' AS metric, k, round(avg(CASE WHEN pos < k THEN 1.0::DOUBLE ELSE 0 END), 3) AS value FROM ep, (SELECT unnest([1, 5]) AS k) WHERE is_target GROUP BY ALL
UNION ALL SELECT stage, 'ndcg', k, round(avg(CASE WHEN pos < k THEN 1 / log2(pos + 2.0) ELSE 0 END), 3) FROM ep, (SELECT unnest([1, 5]) AS k) WHERE is_target GROUP BY ALL""", EVAL, *EVALUATED))
def evaluation(spark, d):
    """The whole composition: prepared candidates, completions parsed into facets, reranked and measured, with retrieval and without."""
    inter = tables.order_interactions(table(spark, d, "lineitem"), table(spark, d, "orders"))
    ready = pipelines.prepare(inter, tables.ORDER, items(spark, d), _memories(spark, d))
    told = _titles(spark, d).groupBy("user_id").agg(F.collect_list(F.struct("facet", "confidence", F.array().cast("array<string>").alias("supporting_neighbors"))).alias("facets"))
    completions = materialise(told.select("user_id", F.to_json(F.struct("facets")).alias("completion")), "completions")
    out = None
    for stage, retrieval in (("facets", True), ("none", False)):
        one = pipelines.evaluate(ready, items(spark, d), completions, (1, 5), retrieval).where("metric <> 'mrr'").select(F.lit(stage).alias("stage"), "metric", "k", "value")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "value", places=3)


@registered(q("SELECT count(*) AS n, true AS measured FROM (SELECT DISTINCT user_id FROM cand)", EVAL))
def scoring_throughput(spark, d):
    """Rows of proxy scoring, counted and timed by the plan that makes them."""
    cand = materialise(_eval(spark, d), "cand")
    arms = cand.select("user_id").distinct().select("user_id", F.lit("empty").alias("arm"), F.array().cast("array<string>").alias("facets"))
    meter = rewards.Throughput()
    materialise(meter.watch(pipelines.proxy_scores(cand, items(spark, d), arms)), "scores")
    return meter.report(spark).select("n", (F.col("seconds") >= 0).alias("measured"))


# Records.

FROZEN = f"""tl AS (SELECT user_id, string_agg(item_id || '=' || title, ';' ORDER BY pos) AS titles, string_agg(item_id, ',' ORDER BY pos) AS candidates, string_agg(item_id || '=' || CASE WHEN item_id % 2 = 0 THEN title ELSE title || ', liked' END, ';' ORDER BY pos) AS memories, max(item_id) FILTER (is_target) AS gold FROM cand JOIN items USING (item_id) GROUP BY 1),
nn AS (SELECT user_id, string_agg(CASE WHEN nb_type = 'item' THEN 'Item-' ELSE 'User-' END || nb_id, ',' ORDER BY ord) AS neighbors FROM top GROUP BY 1)"""


@registered(q("""SELECT user_id, candidates, gold AS gold_item_id, md5(titles) AS titles, md5(memories) AS memories, e.n || ' items' AS m_u, neighbors, e.n AS n_train_items, true AS prompt_whole, true AS snippets_cited FROM tl JOIN nn USING (user_id) JOIN (SELECT user_id, count(*) AS n FROM edges GROUP BY 1) e USING (user_id)""", NEIGHBORS, HYBRID, MIX, EVAL, FROZEN))
def record_contents(spark, d):
    """Every field of candidate-blind records, written and read again: lists, maps, memories, neighbours; the prompt shows the
    memory and no candidate list, and snippets are of neighbours alone and within the prompt."""
    inter = tables.order_interactions(table(spark, d, "lineitem"), table(spark, d, "orders"))
    none = spark.createDataFrame([], "user_id long, instruction string")
    told = materialise(_memories(spark, d), "memories")  # read three times
    ready = pipelines.prepare(inter, tables.ORDER, items(spark, d), told, blind=True)
    kept, dropped = pipelines.freeze(ready, items(spark, d), told, none)
    at = folder(spark)
    tables.write_records(kept.unionByName(dropped.drop("reason").select(*kept.columns)), at)
    got = tables.read_records(spark, at)
    rewards.check_columns(got)
    listed = lambda m: F.md5(F.array_join(F.transform("listed", lambda i: F.concat(i.cast("string"), F.lit("="), F.try_element_at(m, i.cast("string")))), ";"))
    got = got.select("*", F.col("neighbors").alias("near"), F.col("candidates").alias("listed"))
    whole = F.contains("prompt", F.concat(F.lit("Memory of the user:\n"), "M_u")) & ~F.contains("prompt", F.lit("Candidates:")) & F.col("r_null").isNull() & F.col("instruction").isNull()
    cited = F.forall(F.map_entries("neighbor_snippets"), lambda e: F.array_contains("near", e["key"]) & F.contains("prompt", e["value"])) & (F.size("neighbor_snippets") > 0) & (F.col("near") == F.col("neighbor_ids"))
    return got.select("user_id", F.array_join("listed", ",").alias("candidates"), "gold_item_id", listed("candidate_titles").alias("titles"), listed("candidate_memories").alias("memories"), F.col("M_u").alias("m_u"), F.array_join("near", ",").alias("neighbors"), F.col("n_train_items").cast("long").alias("n_train_items"), whole.alias("prompt_whole"), cited.alias("snippets_cited"))
