"""Queries and their SQL over small tables made to be awkward: what the given tables hold only at size."""

import glob
import gzip
import hashlib
import os
import shutil
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomrec import flow_queries, queries, scratch
from loomrec.operators import facets, graph, leakage, pruning, records, rerank, sampling, sequences
from loomrec.sources import tables
from tests.test_sql import ORACLES, QUERIES, plain


def against_sql(spark, d, name):
    con = duckdb.connect()
    for path in glob.glob(f"{d}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got = plain(QUERIES[name](spark, str(d)).toPandas())
    assert got == plain(con.sql(ORACLES[name]).df())
    return got[1]


@pytest.fixture
def orders(spark, tmp_path):
    """Writes users' items, in order, as orders of one line each, and a hundred parts."""

    def write(users):
        rows = [(u, at, 1000 * u + at, i) for u, own in users.items() for at, i in enumerate(own)]
        df = spark.createDataFrame(rows, "u long, at int, o long, i long")
        df.select(F.col("o").alias("o_orderkey"), F.col("u").alias("o_custkey"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("at")).alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
        df.select(F.col("o").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("i").alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
        spark.range(100).select(F.col("id").alias("p_partkey"), F.format_string("part %d", "id").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type")).write.parquet(f"{tmp_path}/part.parquet")
        return tmp_path

    return write


def test_update_told_twice_is_one(spark, orders):
    got = against_sql(spark, orders({u: [5, 99, 5] for u in range(1, 13)}), "response_patches")
    assert sum(r[2] == "near" for r in got) == 12  # also where the test item, which is the first train item, stands at 0 to 3


def test_logits_order_where_scores_are_the_same(spark):
    rows = [(1, "item", i, 0.0, 0, d, 1, 1, i) for i, d in ((1, 50), (2, 60), (3, 55))]
    nb = spark.createDataFrame(rows, "user_id long, nb_type string, nb_id long, recency double, overlap long, nb_degree long, own_degree long, max_degree long, ord int")
    weights = {"w1": [[0.0, 1.0] + [0.0] * 8], "b1": [0.0], "w2": [1.0], "b2": 0.0}
    got = pruning.mix_top_k(pruning.mlp_score(nb, weights))
    assert [r["nb_id"] for r in got.orderBy("ord").collect()] == [2, 3, 1]
    assert {r["score"] for r in got.collect()} == {1.0} and "logit" not in got.columns


def test_grounding_of_large_ids(spark, tmp_path):
    rows = [(100_000 + i, i % 2, [1.0, float(i)]) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert len(against_sql(spark, tmp_path, "grounding")) == 2


def test_completions_without_words(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a b"] * 4 + ["!?"] * 4 + [None] * 4)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(against_sql(spark, tmp_path, "facet_parse")) == 12


def test_audit_of_tables_in_folders(spark, sf_dir, tmp_path):
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        shutil.copy(path, tmp_path / os.path.basename(path))
    for name in ("documents", "labels"):
        os.remove(tmp_path / f"{name}.parquet")
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    against_sql(spark, tmp_path, "audited_files")
    for sub in ("a", "b"):
        os.mkdir(tmp_path / sub)
        (tmp_path / sub / "same").write_text(sub * 3)
        (tmp_path / sub / "none").write_text("")
    names = [r["name"] for r in leakage.file_digests(spark, f"{tmp_path}/[ab]", root=str(tmp_path)).collect()]
    assert sorted(names) == ["a/none", "a/same", "b/none", "b/same"]


def test_audit_of_files_beyond_a_row(spark, sf_dir):
    """Files larger than Spark's file source can hold in a row are audited as well, and no setting is left changed."""
    key = "spark.sql.sources.binaryFile.maxLength"
    before = {k: spark.conf.get(k) for k in (key, "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set(key, "4096")
    try:
        assert max(os.path.getsize(x) for x in glob.glob(f"{sf_dir}/*.parquet")) > 4096
        against_sql(spark, sf_dir, "audited_files")
    finally:
        spark.conf.set(key, before[key])
    assert {k: spark.conf.get(k) for k in before} == before


def test_digests_by_sources(spark, tmp_path, monkeypatch):
    mark = leakage.BOM
    files = {"r and%25#+\u00e9": bytes(range(256)) * 999, "long": (b"x" * 99_999 + b"\n") * 9, "marked": mark + b"a\r\nb\rc\n", "open": mark + mark + b"ab\ncde", "end": b"\n", "n": b"\n\n\nx", "no": b"", "many": b"\n" * 45_000}
    files |= {"sub/z": b"\x00\xff\n\xfe" * 99, "cr": b"a\r\nb\r\r\n", "mark": mark, "z.gz": gzip.compress(b"abc\n" * 999), "w.zst": b"not packed\n" * 99}
    (tmp_path / "sub").mkdir()
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    want = sorted((k, hashlib.sha256(v).hexdigest(), v.count(b"\n") + (v[-1:] not in (b"", b"\n")), len(v)) for k, v in files.items())
    for whole in (3, 10, 1 << 24):
        assert sorted(map(tuple, leakage.source_digests(spark, f"{tmp_path}/*", str(tmp_path), whole).collect())) == want
    streams = leakage.file_digests(spark, f"{tmp_path}/[!r]*", root=str(tmp_path))
    assert sorted(map(tuple, streams.collect())) == [x for x in want if x[0][0] != "r"]
    assert "Exchange" not in streams._jdf.queryExecution().executedPlan().toString()  # few paths would be put into one task
    monkeypatch.setattr(leakage, "_opens", lambda folder: False)
    assert sorted(map(tuple, leakage.file_digests(spark, f"{tmp_path}/*", root=str(tmp_path)).collect())) == want
    with pytest.raises(ValueError):
        leakage._Lines("x", None)
    part = leakage._Lines("x", 9)
    part.add([b"ab"])
    with pytest.raises(ValueError):
        part.digest()


def test_pairs_are_summed_where_lists_are(spark):
    """Pairs of users are made behind the last shuffle, and ids may be larger than the lists' four bytes."""
    ids = [3, 7, 1 << 31, (1 << 31) + 7, 5 << 33, -4]
    rows = [(u, i, p) for n, u in enumerate(ids) for p, i in enumerate([0, 1, n % 3, 1 + n % 2])]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, pos int")
    df = graph.user_neighbors(edges, most=3)
    assert "hashpartitioning(user_id" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "neighbor_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
    bags = {u: [i for v, i, _ in rows if v == u] for u in ids}
    want = set()
    for u in ids:
        met = [(-sum(bags[u].count(i) * bags[v].count(i) for i in set(bags[u])), min(p for p, i in enumerate(bags[u]) if i in bags[v]), v) for v in ids if v != u]
        want |= {(u, v, -k, at + 1) for at, (k, _, v) in enumerate(sorted(met)[:3])}
    assert {tuple(r) for r in df.collect()} == want


def test_words_do_not_carry_their_text(spark):
    rows = [(1, "b a a", 0.5), (1, "b a a", 0.5), (1, "c", None), (2, None, 0.5), (3, " ", 0.5)]
    df = facets.facet_vectors(spark.createDataFrame(rows, "user_id long, facet string, confidence double"))
    assert "_id" in (plan := df._jdf.queryExecution().optimizedPlan().toString()) and "struct(facet, facet" not in plan and "unhex(sha2(" in plan
    assert {r["user_id"] for r in df.collect()} <= {1, 3} and abs(sum(r["value"] ** 2 for r in df.where("user_id = 1").collect()) - 1) < 1e-9


@pytest.fixture
def written(monkeypatch):
    """Names of the tables that queries write for themselves, with their numbers of rows."""
    seen = []

    def keep(df, label):
        out = scratch.materialise(df, label)
        seen.append((label, out.count()))
        return out

    for module in (queries, flow_queries, sampling):
        monkeypatch.setattr(module, "materialise", keep)
    return seen


def test_few_edges_probe_twice(spark, orders, written):
    d = orders({u: [5, 7, 99, 5, 8] for u in range(1, 13)})
    against_sql(spark, d, "bpr_triples")
    assert dict(written)["bpr_first"] == 36 and dict(written)["bpr"] < 12


def test_users_are_ordered_once(spark, orders, written):
    d = orders({u: [5, 7, 99, 5, 8] for u in range(1, 13)})
    for name in ("eval_candidates", "warmup_candidates", "target_entropy"):
        against_sql(spark, d, name)
    assert [label for label, _ in written] == ["split", "drawn"] * 3


def test_own_rule_is_not_left_behind(spark, orders):
    before = pruning.RULES.copy(), pruning.DESCRIPTIONS.copy()
    against_sql(spark, orders({u: [5, 7, 99, 5, 8] for u in range(1, 13)}), "own_rule")
    assert (pruning.RULES, pruning.DESCRIPTIONS) == before and pruning.rule_name("unknown") == "books"


def test_vectors_are_not_broadcast(spark):
    cand = spark.createDataFrame([(1, 2, 0)], "user_id long, item_id long, pos int")
    users, items = (spark.createDataFrame([(k, [1.0])], f"{c} long, vector array<double>") for k, c in ((1, "user_id"), (2, "item_id")))
    out = rerank.dense_rerank(cand, users, items)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2 and out.first()["score"] == 1.0


def test_rounds_of_users_agree(spark, monkeypatch):
    """Users taken in rounds have the neighbours and shares that they have all at once, and what was shuffled is deleted."""
    rows = [(u, (u * k) % 11, k, 4, 0.25 * (k + 1)) for u in range(40) for k in range(4)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, pos int, n_train int, recency double")
    cand = spark.createDataFrame([(u, (u + k) % 12) for u in range(0, 40, 2) for k in range(3)], "user_id long, item_id long")
    jobs = {"users": lambda: graph.user_neighbors(edges, 5), "top": lambda: pruning.top_neighbors(edges, k=8), "share": lambda: graph.candidate_overlap(edges, edges, cand, 8)}
    once = {name: sorted(map(tuple, job().collect())) for name, job in jobs.items()}
    monkeypatch.setattr(graph, "ROUND_IDS", 200)
    monkeypatch.setattr(graph, "ROUND_SHARE", 5)
    assert len(list(graph.neighbor_rounds(edges, 5))) > 1
    for name, job in jobs.items():
        assert sorted(map(tuple, job().collect())) == once[name], name
    scratch.materialise(edges.groupBy("user_id").count(), "counted")
    assert spark.conf.get(scratch.CLEANUP, "false") == "false"


def test_tasks_of_users_rows_are_bounded(spark, orders, monkeypatch):
    """A table of many rows is put in order by more tasks, and own_rule holds no rows to compare them."""
    d = str(orders({u: [5, 7, 99, 5, 8] for u in range(1, 13)}))
    monkeypatch.setattr(queries, "TASK_ROWS", 8)
    df = QUERIES["own_rule"](spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "HashAggregate" not in plan and "hashpartitioning(user_id" in plan
    against_sql(spark, d, "own_rule")


@pytest.mark.parametrize("n_items", [12, 40, 5000])
def test_spare_probes_change_nothing(spark, monkeypatch, n_items):
    """Few probes at first, and all of them for who is short, draw what all of them draw."""
    users = spark.range(30).withColumnRenamed("id", "user_id")
    mine = users.selectExpr("user_id", "explode(sequence(0L, user_id % 10)) AS item_id")
    drawn = {}
    for spare in (0, 3, 1000):
        monkeypatch.setattr(sampling, "SPARE", spare)
        drawn[spare] = sorted(map(tuple, sampling.negatives(users, mine, n_items, 5, 42).collect()))
    assert drawn[0] == drawn[3] == drawn[1000] and not {r[:2] for r in drawn[0]} & set(map(tuple, mine.collect()))


def test_arms_are_scored_once(spark, orders, written):
    d = orders({u: [5, 7, 99, 5, 8] for u in range(1, 13)})
    against_sql(spark, d, "sparsity_gain")
    assert [label for label, _ in written] == ["split", "drawn", "candidates", "scored"]


def test_targets_are_ranked_by_counting(spark, monkeypatch):
    """Each prompt's rank of the target is the ranker's, ties and users without a target too; a candidate is shuffled once
    and not once a prompt, and no row is put in order by its logit."""
    real = rerank.pseudo_logit
    monkeypatch.setattr(rerank, "pseudo_logit", lambda prompt, item: F.floor(real(prompt, item) / 3))
    cand = spark.range(60).selectExpr("id % 6 AS user_id", "id AS item_id", "id % 7 = 3 AND id % 6 > 0 AND id < 48 AS is_target", "CAST(9 - id DIV 6 AS INT) AS pos")
    cand = cand.withColumn("is_target", F.col("is_target") & (F.row_number().over(Window.partitionBy("user_id", "is_target").orderBy("item_id")) == 1))
    prompts = {a: F.concat_ws(" ", F.lit(a), F.col("user_id").cast("string")) for a in ("one", "two", "three")}
    got = rerank.target_ranks(cand, prompts)
    want = []
    for arm, prompt in prompts.items():
        ranked = rerank.hash_ranker(cand.select(F.col("user_id").alias("req_id"), prompt.alias("prompt"), "item_id", "pos"))
        ranked = ranked.select(F.col("req_id").alias("user_id"), F.lit(arm).alias("arm"), "item_id", "rank")
        gold = cand.groupBy("user_id").agg(F.max(F.when(F.col("is_target"), F.col("item_id"))).alias("gold"))
        want += records.scored_arms(ranked, gold).select("user_id", "arm", "gold_rank").collect()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
    assert len({r["gold_rank"] for r in want}) > 3 and None in {r["gold_rank"] for r in want} and dict(got.dtypes)["gold_rank"] == "int"
    table = scratch.materialise(cand, "candidates")
    plan = rerank.target_ranks(table, prompts)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "row_number" not in plan and "floor" not in plan[plan.index("Exchange"):]


def test_the_split_is_shared_with_chosen_neighbours(spark, orders, written):
    """What packs, screens and snapshots chosen neighbours puts users' rows in order once."""
    d = orders({u: [5, 7, 99, 5, 8] for u in range(1, 13)})
    for name in ("leak_screen", "packed_context"):
        written.clear()
        against_sql(spark, d, name)
        assert [label for label, _ in written].count("split") == 1, name


def test_tables_of_a_round_are_deleted(spark, monkeypatch):
    """When neighbours are chosen, only the chosen ones are left of what was written for them."""
    rows = [(u, (u * k) % 11, k, 4, 0.25 * (k + 1)) for u in range(40) for k in range(4)]
    edges = spark.createDataFrame(rows, "user_id long, item_id long, pos int, n_train int, recency double")
    monkeypatch.setattr(graph, "ROUND_IDS", 200)
    monkeypatch.setattr(graph, "ROUND_SHARE", 5)
    there = lambda: {p.name for p in Path(scratch.shared_dir(spark).removeprefix("file://")).iterdir()}
    held = scratch.materialise(edges, "held")
    before = there()
    for given in (edges, held):
        out = pruning.top_neighbors(given, k=8)
        assert {n.rsplit("-", 1)[0] for n in there() - before} == {"chosen"} and out.count() > 0
    assert held.count() == 160


def test_records_are_compressed(spark, tmp_path):
    """Records repeat their texts in prompts and snippets: files are much smaller than these, and read back the same."""
    text = "Item-5 and what is said of it, " * 40
    rows = spark.range(200).select(F.col("id").alias("user_id"), F.lit(text).alias("prompt"), F.lit(text).alias("M_u"), F.array(F.lit(1).cast("long")).alias("candidates"))
    tables.write_records(rows.coalesce(1), f"{tmp_path}/records")
    assert sum(p.stat().st_size for p in (tmp_path / "records").iterdir()) < 200 * len(text) / 10
    got = tables.read_records(spark, f"{tmp_path}/records").select("user_id", "prompt", "M_u", "candidates")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_users_draw_within_their_row(spark, orders):
    """Histories are the sequences, and candidates follow from them, also for users who hold most items."""
    d = str(orders({u: [(u * k) % 90 for k in range(2 + u % 5)] + [5, 99, 5] for u in range(1, 13)} | {20: list(range(96)), 21: [1, 2]}))
    rows = tables.order_interactions(queries.table(spark, d, "lineitem"), queries.table(spark, d, "orders"))
    rows = rows.unionByName(rows.where("user_id < 4")).withColumn("o_orderdate", F.when(F.col("l_orderkey") % 3 > 0, F.col("o_orderdate")))
    one, two = sequences.sequences(rows, tables.ORDER), sequences.history_rows(sequences.histories(rows, tables.ORDER))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.dtypes == two.dtypes
    own = queries._histories(spark, d).where("user_id < 20")
    held = spark.createDataFrame([(20, list(range(90, 97)), [96]), (21, [1, 7], [7]), (22, [1, 7], [7, 8])], "user_id long, held array<long>, targets array<long>")
    rows = own.selectExpr("user_id", "items AS held", "slice(items, -1, 1) AS targets").unionByName(held)
    targets, mine = rows.selectExpr("user_id", "explode(targets) AS target"), rows.selectExpr("user_id", "explode(held) AS item_id")
    for n_items in (12, 100):
        got = sampling.row_candidates(rows, n_items, 10, 42)
        same = sampling.candidates(targets, mine, n_items, 10, 42)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, same.collect())) and got.dtypes == same.dtypes
        drawn = got.where("not is_target").join(mine, ["user_id", "item_id"])
        assert drawn.count() == 0 and {r["user_id"] for r in got.collect()} >= {20, 21} and 22 not in {r["user_id"] for r in got.collect()}


def test_words_meet_in_a_candidates_row(spark):
    """Scores, first words and ranks are those of all pairs of words, and no word is shuffled with a candidate's ids."""
    items = [(i, w, 0.5 * (1 + (i + k) % 3)) for i in range(9) for k, w in enumerate("abcdef"[i % 3 : 3 + i % 4])] + [(3, None, 2.0)]
    users = [(u, w, 1 / (1 + (u + k) % 3)) for u in range(5) for k, w in enumerate("fedcb"[u % 3 :])] + [(1, None, 1.0)]
    cand = [(u, (u + k) % 11, k) for u in range(7) for k in range(8)]
    got = rerank.bow_rerank(*(spark.createDataFrame(rows, s) for rows, s in ((cand, "user_id long, item_id long, pos int"), (users, "user_id long, word string, weight double"), (items, "item_id long, word string, weight double"))))
    assert "hashpartitioning(user_id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", word" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x and "user_id" in x and "item_id" in x)
    assert plan.count("Join") <= 2
    for r in got.collect():
        wi, wu = ({w: x for k, w, x in rows if k == key} for rows, key in ((items, r["item_id"]), (users, r["user_id"])))
        parts = sorted((-wi[w] * wu[w], w) for w in set(wi) & set(wu) - {None})
        norm = sum(x * x for x in wi.values()) ** 0.5 * sum(x * x for x in wu.values()) ** 0.5
        assert abs(r["score"] - (-sum(p for p, _ in parts) / norm if norm else 0)) < 1e-12
        assert r["rationale"] == (", ".join(w for _, w in parts[:3]) or "No strong match")
    for u in range(7):
        mine = sorted((r for r in got.collect() if r["user_id"] == u), key=lambda r: r["rank"])
        assert [(-r["score"], r["pos"]) for r in mine] == sorted((-r["score"], r["pos"]) for r in mine)


def test_edges_and_asked_meet_at_their_user(spark):
    edges = spark.createDataFrame([(1, 5, 0.5), (1, 5, 1.0), (1, 6, 0.2), (2, 5, 1.0), (3, None, 1.0)], "user_id long, item_id long, recency double")
    asked = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (2, 6), (3, None), (9, 5), (None, 5)], "user_id long, item_id long")
    got = graph.lookup(edges, asked)
    assert "hashpartitioning(user_id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "item_id" not in "".join(x.split("]")[0] for x in plan.splitlines() if "hashpartitioning(user_id" in x)
    want = [(1, 5, 1.0, 3, 3), (1, 5, 1.0, 3, 3), (1, 7, 0.0, 3, 0), (2, 6, 0.0, 1, 1), (3, None, 0.0, 1, 0), (9, 5, 0.0, 0, 3), (None, 5, 0.0, 0, 3)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_candidates_are_joined_once(spark, orders):
    """Candidates follow from histories without a shuffle; explanations and scores are joined to them and not to each other; metrics put no candidate in order;
    dense scores are made where they are ranked."""
    d = str(orders({u: [5, 7, 99, 5, 8] for u in range(1, 13)}))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for name in ("eval_candidates", "warmup_candidates"):
        assert shuffles(QUERIES[name](spark, d)) == 0
    assert plan(QUERIES["explained_candidates"](spark, d)).count("Join ") == 2
    against_sql(spark, d, "explained_candidates")
    assert "row_number" not in plan(QUERIES["ranking_metrics"](spark, d))
    against_sql(spark, d, "ranking_metrics")
    cand = scratch.materialise(spark.range(40).selectExpr("id % 4 AS user_id", "id AS item_id", "CAST(id DIV 4 AS INT) AS pos"), "cand")
    vectors = scratch.materialise(spark.range(9).selectExpr("id", "array(1D, CAST(id AS DOUBLE)) AS vector"), "vectors")
    out = rerank.dense_rerank(cand, vectors.withColumnRenamed("id", "user_id"), vectors.withColumnRenamed("id", "item_id"))
    assert shuffles(out) == 4 and out.where("rank = 1 and score > 0").count() == 4
