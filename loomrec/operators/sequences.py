"""Per-user sequences, leave-one-out splits, recency and replay targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.scratch import materialise


def sequences(interactions: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """user_id, item_id, pos (from 0) and n: each user's rows in a total order."""
    user = Window.partitionBy("user_id")
    pos = F.row_number().over(user.orderBy(*order, "item_id")) - 1
    return interactions.select("user_id", "item_id", pos.alias("pos"), F.count("*").over(user).alias("n"))


def histories(interactions: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """user_id, items: the same rows and order, one row a user. Each is shuffled once and sorted in its user's array alone."""
    held = interactions.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(*order, "item_id"))).alias("h"))
    return held.select("user_id", F.transform("h", lambda x: x["item_id"]).alias("items"))


def history_rows(histories: DataFrame) -> DataFrame:
    """histories() as sequences() gives them, without a shuffle."""
    rows = histories.select("user_id", F.size("items").cast("long").alias("n"), F.posexplode("items").alias("pos", "item_id"))
    return rows.select("user_id", "item_id", "pos", "n")


def leave_one_out(seq: DataFrame, least: int = 3) -> DataFrame:
    """seq with split: the last row is test, the one before valid, the rest train; shorter users go."""
    split = F.when(F.col("pos") == F.col("n") - 1, "test").when(F.col("pos") == F.col("n") - 2, "valid").otherwise("train")
    return seq.where(F.col("n") >= least).withColumn("split", split)


def train_edges(split: DataFrame) -> DataFrame:
    """user_id, item_id, pos, n_train, recency: a bag of edges; a repeated item has its latest recency."""
    n_train = F.col("n") - 2
    latest = F.max((F.col("pos") + 1) / n_train).over(Window.partitionBy("user_id", "item_id"))
    return split.where("split = 'train'").select("user_id", "item_id", "pos", n_train.alias("n_train"), latest.alias("recency"))


def history_upto(split: DataFrame, upto: str = "train") -> DataFrame:
    """user_id, items: the ordered items of the splits up to `upto`."""
    kinds = {"train": ["train"], "valid": ["train", "valid"], "test": ["train", "valid", "test"]}[upto]
    held = split.where(F.col("split").isin(kinds)).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "item_id"))).alias("h"))
    return held.select("user_id", F.transform("h", lambda x: x["item_id"]).alias("items"))


def sliding_target(seq: DataFrame, round_no: int, rounds: int) -> DataFrame:
    """user_id, target, n_history for one warm-up round: the element at offset rounds - round_no + 1 from the end."""
    offset = rounds - round_no
    return seq.where((F.col("n") > offset) & (F.col("pos") == F.col("n") - offset - 1)).select("user_id", F.col("item_id").alias("target"), F.col("pos").alias("n_history"))


def replay_target(seq: DataFrame, n_items: int, n_candidates: int = 10, least: int = 2) -> DataFrame:
    """user_id, target, n_history, reason: the second-last element, or why a user can't be replayed."""
    user = Window.partitionBy("user_id")
    rows = seq.withColumn("distinct_items", F.size(F.collect_set("item_id").over(user)))
    reason = F.when(F.col("n") < least + 1, "history too short").when(F.lit(n_items) - F.col("distinct_items") < n_candidates - 1, "negative pool too small")
    rows = rows.withColumn("reason", reason).where((F.col("pos") == F.col("n") - 2) | ((F.col("n") < 2) & (F.col("pos") == 0)))
    return rows.select("user_id", F.when(F.col("reason").isNull(), F.col("item_id")).alias("target"), F.greatest(F.col("n") - 2, F.lit(0)).alias("n_history"), "reason")


def dataset_stats(split: DataFrame) -> DataFrame:
    train = F.col("split") == "train"
    s = split.agg((F.max("user_id") + 1).alias("n_users"), (F.max("item_id") + 1).alias("n_items"), F.count("*").alias("n_rows"), F.count_distinct(F.when(train, F.col("user_id"))).alias("train_users"), F.count_if(train).alias("train_rows"))
    return s.withColumn("density", F.col("n_rows") / (F.col("n_users") * F.col("n_items")))


def count_sketches(interactions: DataFrame, *parts: str, lg_k: int = 14) -> DataFrame:
    """parts, users, items, n_rows: sketches of the distinct users and items of each part, a row a part.

    Sketches merge, so parts that come later need no second look at those before. 2**lg_k registers give a standard
    error of about 0.8 % at 14."""
    return interactions.groupBy(*parts).agg(F.hll_sketch_agg("user_id", F.lit(lg_k)).alias("users"), F.hll_sketch_agg("item_id", F.lit(lg_k)).alias("items"), F.count("*").alias("n_rows"))


def sketched_stats(sketches: DataFrame) -> DataFrame:
    """conversion_stats() of all parts together, with estimated numbers of users and items."""
    number = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c))
    return _per_user_and_item(sketches.agg(number("users").alias("n_users"), number("items").alias("n_items"), F.sum("n_rows").alias("n_rows")))


def conversion_stats(interactions: DataFrame) -> DataFrame:
    s = interactions.agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"), F.count("*").alias("n_rows"))
    return _per_user_and_item(s)


def _per_user_and_item(s: DataFrame) -> DataFrame:
    return s.withColumns({"density": F.col("n_rows") / (F.col("n_users") * F.col("n_items")), "per_user": F.col("n_rows") / F.col("n_users"), "per_item": F.col("n_rows") / F.col("n_items")})


# Sequence tables: one row per user with arrays of items and reviews.


def exploded_interactions(table: DataFrame, key: str, items: str) -> DataFrame:
    """user_id, item_id, rating 5.0, timestamp from 1: user_id is the row's rank by key.

    Ranks are counted per range of keys and added up, so no task sees all rows."""
    ranked = running_ids(table, key)
    return ranked.select("user_id", F.posexplode(items).alias("pos", "item_id")).select("user_id", "item_id", F.lit(5.0).alias("rating"), (F.col("pos") + 1).alias("timestamp"))


def running_ids(table: DataFrame, key: str) -> DataFrame:
    """table with user_id from 0 in order of key, contiguous.

    Rows are written once in ranges of key; a row's id is its place in its range plus the sizes of earlier ranges."""
    rows = table.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    rows = materialise(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "ranges")
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(sizes, "_part").withColumn("user_id", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running_sums(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """table with name: the sum of value over all rows of a smaller key; keys are distinct. No task sees them all."""
    rows = materialise(table.repartitionByRange(F.col(key)).select("*", F.spark_partition_id().alias("_part")), "ranges")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", earlier("_n", Window.partitionBy(F.lit(1)).orderBy("_part")).alias("_before"))
    within = earlier(value, Window.partitionBy("_part").orderBy(key))
    return rows.join(sizes, "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before")


def exploded_reviews(ranked: DataFrame, items: str, reviews: str) -> DataFrame:
    """user_id, item_id, review_text: both arrays up to the shorter one, null reviews dropped."""
    n = F.least(F.size(items), F.size(reviews))
    both = F.arrays_zip(F.slice(items, 1, n).alias("item_id"), F.slice(reviews, 1, n).alias("review_text"))
    return ranked.where(n > 0).select("user_id", F.inline(both)).where("review_text is not null")


def instructions(ranked: DataFrame, instruction: str, persona: str) -> DataFrame:
    """user_id, instruction, persona under the running ids; null texts are empty."""
    return ranked.select("user_id", *[F.coalesce(c, F.lit("")).alias(name) for c, name in ((instruction, "instruction"), (persona, "persona"))])


def metadata_from_mapping(mapping: DataFrame) -> DataFrame:
    missing = {"index", "asin", "title"} - set(mapping.columns)
    if missing:
        raise ValueError(f"mapping lacks columns {sorted(missing)}")
    return mapping.select(F.col("index").alias("item_id"), "asin", "title", F.lit("").alias("description"))


def history_text(history: DataFrame, items: DataFrame) -> DataFrame:
    """user_id, text: title[:100] and the last 200 characters of the untagged description of each item, in order."""
    plain = F.regexp_replace(F.coalesce("description", F.lit("")), "<.*?>", "")
    tail = F.when(F.length(plain) > 200, F.expr("right(regexp_replace(coalesce(description, ''), '<.*?>', ''), 200)")).otherwise(plain)
    rows = history.select("user_id", F.posexplode("items").alias("pos", "item_id")).join(items, "item_id")
    part = F.concat(F.lit("Title: "), F.substring("title", 1, 100), F.lit("\nDescription: "), tail, F.lit("\n"))
    held = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))).alias("h"))
    return history.select("user_id").join(held, "user_id", "left").select("user_id", F.coalesce(F.array_join(F.transform("h", lambda x: x["part"]), ""), F.lit("")).alias("text"))
