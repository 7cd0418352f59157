"""Grounding, composite rewards, and the statistics that validate them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from loomrec.functions.columns import cosine, tokens
from loomrec.operators.metrics import hit, ndcg, rank_of
from loomrec.operators.sequences import running_sums

RECORD_COLUMNS = ("user_id", "candidates", "gold_item_id", "candidate_titles", "candidate_memories", "instruction", "neighbor_snippets")


def grounding(facets: DataFrame, snippets: DataFrame, n_facets: int, threshold: float = 0.35) -> DataFrame:
    """facets (req_id, nth, vector, cited array<string>), snippets (req_id, node, vector) -> req_id, grounding,
    n_grounded, hallucinated: a facet is grounded if its best cited snippet is close enough; the score is out of the
    facets asked for. A facet that cites nothing that exists is not grounded."""
    cited = facets.select("req_id", "nth", F.col("vector").alias("fv"), F.explode_outer("cited").alias("node"))
    pairs = cited.join(snippets.withColumnRenamed("vector", "sv"), ["req_id", "node"], "left")
    best = pairs.groupBy("req_id", "nth").agg(F.max(F.when(F.col("sv").isNotNull(), cosine(F.col("fv"), F.col("sv")))).alias("best"))
    made_up = pairs.where("node is not null and sv is null").groupBy("req_id").agg(F.sort_array(F.collect_set("node")).alias("hallucinated"))
    score = best.groupBy("req_id").agg(F.count_if(F.col("best") >= threshold).alias("n_grounded"))
    return score.join(made_up, "req_id", "left").select("req_id", (F.col("n_grounded") / n_facets).alias("grounding"), "n_grounded", F.coalesce("hallucinated", F.array().cast("array<string>")).alias("hallucinated"))


def word_grounding(facets: DataFrame, snippets: DataFrame, n_facets: int, threshold: float = 0.35) -> DataFrame:
    """The same over words: facets (req_id, nth, facet, cited), snippets (req_id, node, snippet), joined word by word."""
    from loomrec.functions.columns import word_list

    def counted(df: DataFrame, key: list[str], text: str) -> tuple[DataFrame, DataFrame]:
        words = df.select(*key, F.explode(word_list(F.col(text))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n"))
        return words, words.groupBy(*key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))

    fw, fn = counted(facets, ["req_id", "nth"], "facet")
    sw, sn = counted(snippets, ["req_id", "node"], "snippet")
    cited = facets.select("req_id", "nth", F.explode_outer("cited").alias("node"))
    known = cited.join(snippets.select("req_id", "node", F.lit(True).alias("known")), ["req_id", "node"], "left")
    dots = cited.join(fw.withColumnRenamed("n", "a"), ["req_id", "nth"]).join(sw.withColumnRenamed("n", "b"), ["req_id", "node", "word"]).groupBy("req_id", "nth", "node").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    dots = dots.join(fn.withColumnRenamed("norm", "x"), ["req_id", "nth"]).join(sn.withColumnRenamed("norm", "y"), ["req_id", "node"])
    good = dots.where(F.col("dot") / (F.col("x") * F.col("y")) >= threshold).select("req_id", "nth").distinct().groupBy("req_id").agg(F.count("*").alias("n_grounded"))
    made_up = known.where("node is not null and known is null").groupBy("req_id").agg(F.sort_array(F.collect_set("node")).alias("hallucinated"))
    out = facets.select("req_id").distinct().join(good, "req_id", "left").join(made_up, "req_id", "left")
    n = F.coalesce("n_grounded", F.lit(0))
    return out.select("req_id", (n / n_facets).alias("grounding"), n.alias("n_grounded"), F.coalesce("hallucinated", F.array().cast("array<string>")).alias("hallucinated"))


def length_penalty(completion):
    return 0.1 * F.greatest(F.lit(0), tokens(completion) - 400) / 100


def check_columns(records: DataFrame, needed: tuple[str, ...] = RECORD_COLUMNS) -> None:
    missing = [c for c in needed if c not in records.columns]
    if missing:
        raise ValueError(f"records lack columns {missing}")


def last_message(completion: str = "messages"):
    """The text of a chat-form completion: the content of its last message."""
    return F.try_element_at(completion, F.lit(-1))["content"]


def composite(rows: DataFrame, soft_weight: float = 0.0, ground_weight: float = 0.2, format_penalty: float = 1.0) -> DataFrame:
    """rows (req_id, completion, valid, ranking, gold, p_gold, grounding, null_ndcg) -> with ndcg, hit, penalties, total
    and beats_null; the null arm's score is reported and not subtracted. An unreadable completion counts as no memory."""
    at = rank_of(F.col("ranking"), F.col("gold"))
    r = rows.withColumns({"ndcg": ndcg(at, 5), "hit": hit(at, 1), "gold_rank": at, "len_penalty": F.coalesce(length_penalty(F.col("completion")), F.lit(0.0)), "fmt_penalty": F.when(F.coalesce("valid", F.lit(False)), 0.0).otherwise(format_penalty)})
    r = r.withColumn("soft", soft_weight * F.coalesce("p_gold", F.lit(0.0)))
    total = F.col("ndcg") + F.col("soft") + ground_weight * F.coalesce("grounding", F.lit(0.0)) - F.col("len_penalty") - F.col("fmt_penalty")
    return r.withColumn("total", total).withColumn("beats_null", F.when(F.col("null_ndcg").isNotNull(), F.col("ndcg") > F.col("null_ndcg")))


def reward_summary(rewards: DataFrame) -> DataFrame:
    beats = F.avg(F.when(F.col("beats_null").isNotNull(), F.col("beats_null").cast("double")))
    return rewards.agg(F.count("*").alias("n"), F.avg("total").alias("mean_total"), F.stddev_pop("total").alias("std_total"), F.avg("ndcg").alias("mean_ndcg"), F.avg("hit").alias("mean_hit"), F.avg("grounding").alias("mean_grounding"), F.avg(F.col("valid").cast("double")).alias("valid_rate"), F.avg("len_penalty").alias("mean_len_penalty"), beats.alias("beats_null_rate"))


def tie_rate(values: DataFrame, column: str, *groups: str) -> DataFrame:
    """Share of values that are not unique, to nine places; 0 for fewer than two."""
    counts = values.groupBy(*groups, F.round(column, 9).alias("v")).agg(F.count("*").alias("c"))
    rate = F.when(F.sum("c") < 2, 0.0).otherwise(F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c"))
    return counts.groupBy(*groups).agg(rate.alias("tie_rate"))


def average_ranks(rows: DataFrame, column: str, *groups: str) -> DataFrame:
    """rows with <column>_rank: ranks with ties at their mean.

    Equal values are counted first, so a task orders distinct values, and a group's rows are never sorted as they are."""
    counts = rows.groupBy(*groups, column).agg(F.count("*").alias("_c"))
    if groups:
        before = Window.partitionBy(*groups).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    else:
        counts = running_sums(counts, column, "_c", "_b")
    ranks = counts.withColumn(f"{column}_rank", F.col("_b") + (F.col("_c") + 1) / 2).drop("_b", "_c")
    return rows.join(ranks, [*groups, column])


def spearman(rows: DataFrame, x: str, y: str, *groups: str, least: int = 2) -> DataFrame:
    """groups, n, rho: NaN where there are fewer than two points or a side is constant; groups of under `least` rows go."""
    r = average_ranks(average_ranks(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, *groups), y, *groups)
    a, b = F.col(f"{x}_rank"), F.col(f"{y}_rank")
    s = r.groupBy(*groups).agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return s.where(F.col("n") >= (least if groups else 0)).select(*groups, "n", F.when((F.col("n") < 2) | (F.col("sa") == 0) | (F.col("sb") == 0), F.lit(float("nan"))).otherwise(F.col("c") / (F.col("sa") * F.col("sb"))).alias("rho"))


def arm_gate(means: DataFrame, margin: float = 0.02) -> DataFrame:
    """means (arm, ndcg_at_5) -> passes: all four arms are there and sample1 leads every corrupted arm by the margin."""
    arms = means.agg(*[F.max(F.when(F.col("arm") == a, F.col("ndcg_at_5"))).alias(a) for a in ("sample1", "shuffled", "lorem", "empty")])
    return arms.withColumn("passes", F.coalesce(F.expr(f"sample1 >= greatest(nullif(shuffled, null), lorem, empty) + {margin} and shuffled is not null and lorem is not null and empty is not null"), F.lit(False)))


def sample_ties(scores: DataFrame, column: str) -> DataFrame:
    """Share of users whose two samples score the same."""
    one, two = (scores.where(F.col("arm") == a).select("user_id", F.col(column).alias(a)) for a in ("sample1", "sample2"))
    return one.join(two, "user_id").agg(F.count("*").alias("n"), F.avg((F.abs(F.col("sample1") - F.col("sample2")) < 1e-9).cast("double")).alias("tie_rate"))


def paired_delta(scores: DataFrame, column: str, arm: str, against: str) -> DataFrame:
    """n, delta, low, high (95 %), better, equal, worse."""
    a, b = (scores.where(F.col("arm") == x).select("user_id", F.col(column).alias(c)) for x, c in ((arm, "a"), (against, "b")))
    d = F.col("a") - F.col("b")
    half = 1.96 * F.stddev_samp(d) / F.sqrt(F.count("*"))
    return a.join(b, "user_id").agg(F.count("*").alias("n"), F.avg(d).alias("delta"), (F.avg(d) - half).alias("low"), (F.avg(d) + half).alias("high"), F.count_if(d > 0).alias("better"), F.count_if(d == 0).alias("equal"), F.count_if(d < 0).alias("worse"))


def group_advantages(rewards: DataFrame) -> DataFrame:
    """rewards (group, total) with advantage: centred and scaled within the group; groups without spread go."""
    g = rewards.groupBy("group").agg(F.avg("total").alias("_m"), F.stddev_pop("total").alias("_s")).where("_s > 0")
    return rewards.join(g, "group").withColumn("advantage", (F.col("total") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def best_of_n(rewards: DataFrame) -> DataFrame:
    """The best completion of each user (user_id, req_id, total, null_total), if it beats the null arm."""
    best = rewards.groupBy("user_id").agg(F.max(F.struct("total", F.col("req_id"), "null_total")).alias("b"))
    return best.where("b.total > b.null_total").select("user_id", "b.req_id", "b.total")


def gain_by_sparsity(rows: DataFrame) -> DataFrame:
    """rows (user_id, n_train, gain) -> quartile of n_train, n, mean gain; quartiles come from exact percentiles."""
    cuts = rows.agg(F.percentile("n_train", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return rows.join(F.broadcast(cuts)).groupBy((1 + F.aggregate("q", F.lit(0), lambda s, x: s + (F.col("n_train") > x).cast("int"))).alias("quartile")).agg(F.count("*").alias("n"), F.avg("gain").alias("mean_gain"))


def label_entropy(positions: DataFrame) -> DataFrame:
    """positions (pos of the gold item) -> n, entropy in bits of where it stands: low where a model always answers alike."""
    counts = positions.groupBy("pos").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    return counts.join(F.broadcast(total)).agg(F.max("n").alias("n"), (-F.sum(p * F.log2(p))).alias("entropy"))


def paired_scores(proxy: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """user_id, arm, proxy, reference for the pairs that both tables score."""
    one, two = (df.select("user_id", "arm", F.col(column).alias(name)) for df, name in ((proxy, "proxy"), (reference, "reference")))
    return one.join(two, ["user_id", "arm"])


def permutation_scores(rows: DataFrame) -> DataFrame:
    """rows (req_id, candidates, ranking arrays) -> req_id, item_id, score = 1 - rank/n; with missing and repeated flags."""
    n = F.size("candidates")
    r = rows.select("req_id", n.alias("n"), (F.size(F.array_except("candidates", "ranking")) > 0).alias("missing"), (F.size("ranking") > F.size(F.array_distinct("ranking"))).alias("repeated"), F.posexplode(F.filter(F.array_distinct("ranking"), lambda x: F.array_contains("candidates", x))).alias("rank", "item_id"))
    return r.select("req_id", "item_id", (1 - F.col("rank") / F.col("n")).alias("score"), "missing", "repeated")


class Throughput:
    """Rows and rows a second of a plan, measured while it runs and not by a second pass.

    df = meter.watch(df) adds the measure; once an action has run on it, meter.report(spark) is one row: n, seconds from
    the first row to the last over all tasks, and rows a second (null for a single instant)."""

    def __init__(self, name: str = "throughput"):
        self.seen = Observation(name)

    def watch(self, df: DataFrame) -> DataFrame:
        now = F.expr("java_method('java.lang.System', 'currentTimeMillis')").cast("long")
        timed = df.withColumn("_at", now)
        return timed.observe(self.seen, F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"), F.max("_at").alias("last")).drop("_at")

    def report(self, spark: SparkSession) -> DataFrame:
        got = self.seen.get
        seconds = (got["last"] - got["first"]) / 1000 if got["n"] else 0.0
        return spark.createDataFrame([(got["n"], seconds, got["n"] / seconds if seconds else None)], "n long, seconds double, rows_per_second double")
