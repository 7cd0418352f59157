"""Training records, their filters, and evaluation arms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.operators.metrics import hit, ndcg

SCHEMA = (
    "user_id long, prompt string, candidates array<long>, gold_item_id long, M_u string, neighbors array<string>, r_null double, baseline_h1 double, instruction string, "
    "candidate_titles map<string,string>, candidate_memories map<string,string>, neighbor_ids array<string>, neighbor_snippets map<string,string>, n_train_items int"
)
LOREM = ("Lorem ipsum dolor sit amet", "Consectetur adipiscing elit", "Sed do eiusmod tempor")


def candidate_titles(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """candidates with title ('N/A' if unknown) and tags (empty if unknown); of an item's repeated rows the smallest counts."""
    named = ["title", *(["tags"] if "tags" in items.columns else [])]
    about = items.groupBy("item_id").agg(F.min(F.struct(*named)).alias("_a")).select("item_id", *[F.col(f"_a.{c}") for c in named])
    out = candidates.join(about, "item_id", "left").withColumn("title", F.coalesce("title", F.lit("N/A")))
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")) if "tags" in items.columns else F.array().cast("array<string>"))


def candidate_memories(candidates: DataFrame, memories: DataFrame) -> DataFrame:
    """candidates that have a memory, with it."""
    return candidates.join(_item_memories(memories), "item_id")


def _item_memories(memories: DataFrame) -> DataFrame:
    """item_id, memory: of repeated rows the one of the largest seq counts, or the smallest memory where there is none."""
    rows = memories.where("entity_type = 'item'")
    memory = F.max_by("memory", F.struct("seq", "memory")) if "seq" in memories.columns else F.min("memory")
    return rows.groupBy(F.col("entity_id").alias("item_id")).agg(memory.alias("memory"))


def records(states: DataFrame, prompts: DataFrame, candidates: DataFrame, items: DataFrame, memories: DataFrame, instructions: DataFrame, snippet_maps: DataFrame) -> DataFrame:
    """One record for each user that has a state, a prompt and candidates; an item is one candidate, however often it is listed."""
    once = candidates.groupBy("user_id", "item_id").agg(F.min("pos").alias("pos"), F.max("is_target").alias("is_target"))
    rows = candidate_titles(once, items).join(_item_memories(memories), "item_id", "left")
    c = rows.groupBy("user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "item_id"))), lambda x: x["item_id"]).alias("candidates"),
        F.max(F.when(F.col("is_target"), F.col("item_id"))).alias("gold_item_id"),
        F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string"), "title"))).alias("candidate_titles"),
        F.map_from_entries(F.collect_list(F.when(F.col("memory").isNotNull(), F.struct(F.col("item_id").cast("string"), "memory")))).alias("candidate_memories"),
    )
    out = states.join(prompts, "user_id").join(c, "user_id").join(instructions.select("user_id", "instruction"), "user_id", "left").join(snippet_maps.withColumnRenamed("snippets", "neighbor_snippets"), "user_id", "left")
    return out.select(
        "user_id", "prompt", "candidates", "gold_item_id", F.col("user_memory").alias("M_u"), F.col("neighbor_ids").alias("neighbors"), F.lit(None).cast("double").alias("r_null"), F.lit(None).cast("double").alias("baseline_h1"),
        "instruction", "candidate_titles", "candidate_memories", "neighbor_ids", "neighbor_snippets", F.col("n_train_items").cast("int").alias("n_train_items"),
    )


def missing_users(splits: DataFrame, states: DataFrame, candidates: DataFrame) -> DataFrame:
    """part, status, n: how many users of each split have a record, or lack a state or candidates."""
    rows = splits.join(states.select("user_id", F.lit(True).alias("s")), "user_id", "left").join(candidates.select("user_id", F.lit(True).alias("c")).distinct(), "user_id", "left")
    status = F.when(F.col("s").isNull(), "no state").when(F.col("c").isNull(), "no candidates").otherwise("record")
    return rows.groupBy("part", status.alias("status")).agg(F.count("*").alias("n"))


def record_counts(splits: DataFrame, states: DataFrame, candidates: DataFrame, leaked: DataFrame) -> DataFrame:
    """missing_users(), with the users that were dropped for a leak counted apart."""
    gone = leaked.select("user_id").distinct()
    rows = missing_users(splits.join(gone, "user_id", "left_anti"), states, candidates)
    return rows.unionByName(splits.join(gone, "user_id").groupBy("part", F.lit("leaked").alias("status")).agg(F.count("*").alias("n")))


def in_band(rows: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    return rows.where(F.col("baseline_h1").isNull() | F.col("baseline_h1").between(low, high))


def dataset(rows: DataFrame, low: float = 0.2, high: float = 0.8, n: int | None = None) -> DataFrame:
    """The rows in the band, the first n by user_id if asked; an empty result is an error."""
    out = in_band(rows, low, high)
    out = out.orderBy("user_id").limit(n) if n is not None else out
    if out.isEmpty():
        raise ValueError("no records in the band")
    return out


def back_filled(rows: DataFrame, values: DataFrame, column: str) -> tuple[DataFrame, int]:
    """rows with a column patched by user_id, and how many were."""
    new = values.select("user_id", F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    out = rows.join(new, "user_id", "left")
    n = out.where("_hit").count()
    return out.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit"), n


def arms(samples: DataFrame, partners: DataFrame) -> DataFrame:
    """samples (user_id, nth 1 or 2, facets array<string>) -> user_id, arm, facets for the five arms of each user.

    The shuffled arm is the partner's first sample; a failed sample has no facets."""
    none = F.array().cast("array<string>")
    own = samples.select("user_id", F.concat(F.lit("sample"), F.col("nth").cast("string")).alias("arm"), F.coalesce("facets", none).alias("facets"))
    users = samples.select("user_id").distinct()
    first = samples.where("nth = 1").select(F.col("user_id").alias("partner_id"), "facets")
    other = partners.join(first, "partner_id", "left").select("user_id", F.lit("shuffled").alias("arm"), F.coalesce("facets", none).alias("facets"))
    fixed = users.select("user_id", F.lit("lorem").alias("arm"), F.array(*[F.lit(x) for x in LOREM]).alias("facets")).unionByName(users.select("user_id", F.lit("empty").alias("arm"), none.alias("facets")))
    return own.unionByName(other).unionByName(fixed)


def scored_arms(ranked: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """ranked (user_id, arm, item_id, rank) and gold (user_id, gold) -> user_id, arm, gold_rank, ndcg_at_5, hit_at_1.

    Without gold, ranked has it as a column."""
    at = (ranked if gold is None else ranked.join(gold, "user_id")).groupBy("user_id", "arm").agg(F.max(F.when(F.col("item_id") == F.col("gold"), F.col("rank") - 1)).alias("gold_rank"))
    return arm_metrics(at)


def arm_metrics(at: DataFrame) -> DataFrame:
    """at (user_id, arm, gold_rank) with ndcg_at_5 and hit_at_1."""
    return at.select("user_id", "arm", "gold_rank", ndcg(F.col("gold_rank"), 5).alias("ndcg_at_5"), hit(F.col("gold_rank"), 1).alias("hit_at_1"))
