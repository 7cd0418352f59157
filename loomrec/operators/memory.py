"""Memories: an append-only patch log with last-write-wins views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.functions.columns import node_id


def compacted(patches: DataFrame) -> DataFrame:
    """patches (entity_type, entity_id, memory, seq) -> the last non-blank memory of each entity and n_updates."""
    text = F.trim("memory")
    kept = patches.withColumn("memory", text).where(F.length("memory") > 0)
    return kept.groupBy("entity_type", "entity_id").agg(F.max_by("memory", F.struct("seq", "memory")).alias("memory"), F.max("seq").alias("seq"), F.count("*").alias("n_updates"))


def initial_item_memories(items: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """items (item_id, title, description) without a memory -> item_id, memory: 'title. description[:300]' or the title."""
    if existing is not None:
        items = items.join(existing.select("item_id").distinct(), "item_id", "left_anti")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Item-"), F.col("item_id").cast("string")))
    about = F.trim("description")
    usable = F.coalesce(~F.lower(about).isin("", "nan", "n/a"), F.lit(False))
    return items.select("item_id", F.when(usable, F.concat(title, F.lit(". "), F.substring(about, 1, 300))).otherwise(title).alias("memory"))


def first_description(entries: Column) -> Column:
    """The first entry of a list that is not blank, nan or n/a."""
    return F.get(F.filter(entries, lambda d: ~F.lower(F.trim(d)).isin("", "nan", "n/a")), F.lit(0))


def cleaned(memory: Column) -> Column:
    low = F.lower(F.trim(memory))
    return F.when(low.isNull() | low.isin("", "nan", "[nan]", "['']", "[]"), "(No memory)").otherwise(memory)


def user_summary(users: DataFrame, memories: DataFrame, default: str = "No memory yet.") -> DataFrame:
    mine = memories.where("entity_type = 'user'").select(F.col("entity_id").alias("user_id"), "memory")
    return users.select("user_id").join(mine, "user_id", "left").select("user_id", F.coalesce("memory", F.lit(default)).alias("memory"))


def item_lookup(asked: DataFrame, memories: DataFrame) -> DataFrame:
    mine = memories.where("entity_type = 'item'").select(F.col("entity_id").alias("item_id"), "memory")
    return asked.join(mine, "item_id", "left").withColumn("memory", F.coalesce("memory", F.lit("")))


def user_lookup(asked: DataFrame, states: DataFrame) -> DataFrame:
    """asked users with their state; a user without one is an error."""
    absent = asked.select("user_id").distinct().join(states, "user_id", "left_anti").limit(5).collect()
    if absent:
        raise KeyError(f"no state of users {[r['user_id'] for r in absent]}")
    return asked.join(states, "user_id")


def write_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (user_id, seq, item_id) with the model's answer; one that failed or is missing has blank memories and no
    updates, and says so."""
    out = requests.join(responses, "user_id", "left").withColumn("failed", F.col("user_memory").isNull())
    none = F.array().cast(dict(responses.dtypes)["neighbor_updates"])
    return out.withColumns({"user_memory": F.coalesce("user_memory", F.lit("")), "item_memory": F.coalesce("item_memory", F.lit("")), "neighbor_updates": F.coalesce("neighbor_updates", none)})


def patches(responses: DataFrame, known: DataFrame) -> DataFrame:
    """responses (user_id, seq, item_id, user_memory, item_memory, neighbor_updates array<struct<neighbor_id, memory_update>>)
    and known neighbours (user_id, nb_type, nb_id) -> patch rows; updates of unknown neighbours are left out."""
    user = responses.select(F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("user_memory").alias("memory"), "seq", "user_id")
    item = responses.where("item_id is not null").select(F.lit("item").alias("entity_type"), F.col("item_id").alias("entity_id"), F.col("item_memory").alias("memory"), "seq", "user_id")
    names = known.select("user_id", "nb_type", "nb_id", node_id(F.col("nb_type"), F.col("nb_id")).alias("neighbor_id")).distinct()
    near = responses.select("user_id", "seq", F.inline("neighbor_updates")).join(names, ["user_id", "neighbor_id"])
    near = near.select(F.col("nb_type").alias("entity_type"), F.col("nb_id").alias("entity_id"), F.col("memory_update").alias("memory"), "seq", "user_id")
    return user.unionByName(item).unionByName(near).where(F.length(F.trim("memory")) > 0)


def patch_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(*[F.count_if(F.col("entity_type") == t).alias(f"n_{t}") for t in ("user", "item")])


def write_gate(ranked: DataFrame, top: int | None = 10) -> DataFrame:
    """ranked (user_id, pos of the target, null if absent): users whose target is in the top, or is there at all."""
    return ranked.where(F.col("pos").isNotNull() & (F.lit(True) if top is None else F.col("pos") < top))


def feedback(ranked: DataFrame, top: int = 5) -> DataFrame:
    return ranked.where(F.col("pos") < top).select("user_id", F.lit("CLICK").alias("gt"))


def store_stats(compact: DataFrame) -> DataFrame:
    return compact.groupBy("entity_type").agg(F.count("*").alias("n_entities"), F.sum("n_updates").alias("n_updates"), F.avg(F.length("memory")).alias("mean_chars"))


def changed_items(memories: DataFrame, items: DataFrame) -> DataFrame:
    """Item memories that differ from the bare title and its list forms."""
    rows = memories.where("entity_type = 'item'").join(items.select(F.col("item_id").alias("entity_id"), "title"), "entity_id")
    plain = [F.col("title"), F.concat(F.lit("['"), "title", F.lit("']")), F.concat(F.lit("['', '"), "title", F.lit("']"))]
    return rows.where(~F.col("memory").isin(*plain)).select(F.col("entity_id").alias("item_id"), "memory")


def replay_summary(steps: DataFrame) -> DataFrame:
    """steps (reason, n_patches) -> reason, n, mean_patches; a null reason is a replay that went well."""
    return steps.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("reason").isNull(), F.col("n_patches"))).alias("mean_patches"))


def token_usage(calls: DataFrame) -> DataFrame:
    """calls (stage, prompt_tokens, input_tokens, completion_tokens, output_tokens) -> totals and means per stage."""
    put, got = F.coalesce("prompt_tokens", "input_tokens", F.lit(0)), F.coalesce("completion_tokens", "output_tokens", F.lit(0))
    return calls.groupBy("stage").agg(F.count("*").alias("n"), F.sum(put).alias("tokens_in"), F.sum(got).alias("tokens_out"), F.avg(put).alias("mean_in"), F.avg(got).alias("mean_out"))


def step_stats(steps: DataFrame) -> DataFrame:
    """steps (stage, seconds, n_patches) -> stage, n, mean_seconds, mean_patches."""
    return steps.groupBy("stage").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_seconds"), F.avg("n_patches").alias("mean_patches"))


def run_stats(**tables: DataFrame) -> DataFrame:
    """metric, value rows of several one-row tables of numbers."""
    out = None
    for name, df in tables.items():
        one = df.select(F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("m")).select("m.*")
        out = one if out is None else out.unionByName(one)
    return out


def user_states(users: DataFrame, memories: DataFrame, texts: DataFrame, neighbors: DataFrame, edges: DataFrame) -> DataFrame:
    """The snapshot's users: user_id, user_memory, neighbors_text, neighbor_ids, n_train_items."""
    n = edges.groupBy("user_id").agg(F.count("*").alias("n_train_items"))
    ids = neighbors.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", node_id(F.col("nb_type"), F.col("nb_id")).alias("n")))), lambda x: x["n"]).alias("neighbor_ids"))
    out = user_summary(users, memories, "").withColumnRenamed("memory", "user_memory").join(texts.select("user_id", F.col("context").alias("neighbors_text")), "user_id", "left").join(ids, "user_id", "left").join(n, "user_id", "left")
    return out.select("user_id", "user_memory", F.coalesce("neighbors_text", F.lit("")).alias("neighbors_text"), F.coalesce("neighbor_ids", F.array().cast("array<string>")).alias("neighbor_ids"), F.coalesce("n_train_items", F.lit(0)).alias("n_train_items"))


def rebuilt(log: DataFrame, edges: DataFrame, neighbors: DataFrame, texts: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A snapshot's users and item memories from a saved log of patches, without any model call."""
    kept = compacted(log)
    return user_states(edges.select("user_id").distinct(), kept, texts, neighbors, edges), item_closure(candidates, neighbors, kept)


def item_closure(candidates: DataFrame, neighbors: DataFrame, memories: DataFrame) -> DataFrame:
    """Memories of all candidate and neighbour items."""
    wanted = candidates.select("item_id").union(neighbors.where("nb_type = 'item'").select("nb_id")).distinct()
    return wanted.join(memories.where("entity_type = 'item'").select(F.col("entity_id").alias("item_id"), "memory"), "item_id")
