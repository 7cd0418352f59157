"""Ranking metrics with one target per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _checked(k: int) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return k


def hit(pos: Column, k: int) -> Column:
    return F.when(pos < _checked(k), 1.0).otherwise(0.0)


def ndcg(pos: Column, k: int) -> Column:
    """1 / log2(position + 2) within the first k; 0 beyond, or where the target is absent."""
    return F.when(pos < _checked(k), 1.0 / F.log2(pos + 2.0)).otherwise(0.0)


def mrr(pos: Column, k: int) -> Column:
    return F.when(pos < _checked(k), 1.0 / (pos + 1.0)).otherwise(0.0)


METRICS = {"hit": hit, "recall": hit, "ndcg": ndcg, "mrr": mrr}


def rank_of(ranking: Column, gold: Column) -> Column:
    """Position from 0, null where it is absent."""
    at = F.array_position(ranking, gold)
    return F.when(at > 0, at - 1)


def positions(scores: DataFrame) -> DataFrame:
    """scores (user_id, item_id, score, is_target) -> user_id, pos: how many items rank before the target."""
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    ranked = scores.withColumn("pos", F.row_number().over(order) - 1)
    return ranked.where("is_target").select("user_id", "pos")


def target_positions(gold: DataFrame, ranked: DataFrame, n_candidates: int, on_missing: str = "miss") -> DataFrame:
    """gold (user_id, gold) with pos in ranked (user_id, item_id, pos); an absent target has position n_candidates.

    on_missing: users without any ranking are a 'miss', or 'skip' leaves them out."""
    at = gold.join(ranked.select("user_id", F.col("item_id").alias("gold"), "pos"), ["user_id", "gold"], "left")
    if on_missing == "skip":
        at = at.join(ranked.select("user_id").distinct(), "user_id", "left_semi")
    return at.select("user_id", F.coalesce("pos", F.lit(n_candidates)).alias("pos"))


def metric_grid(pos: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), names: tuple[str, ...] = ("hit", "ndcg", "mrr")) -> DataFrame:
    """One row: a mean for each name and k, over the scored users."""
    return pos.agg(F.count("*").alias("n_users"), *[F.avg(METRICS[m](F.col("pos"), k)).alias(f"{m}_{k}") for k in ks for m in names])


def metric_rows(pos: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), names: tuple[str, ...] = ("hit", "ndcg", "mrr")) -> DataFrame:
    """metric, k, value rows of the grid."""
    grid = metric_grid(pos, ks, names)
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(f"{m}_{k}").alias("value")) for k in ks for m in names]
    return grid.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def arm_means(scores: DataFrame) -> DataFrame:
    """scores (user_id, arm, ndcg_at_5, hit_at_1) -> arm, n, ndcg_at_5, hit_at_1."""
    return scores.groupBy("arm").agg(F.count("*").alias("n"), F.avg("ndcg_at_5").alias("ndcg_at_5"), F.avg("hit_at_1").alias("hit_at_1"))


def headroom(means: DataFrame, least: float = 0.01) -> DataFrame:
    s = means.agg(*[F.max(F.when(F.col("arm") == a, F.col("ndcg_at_5"))).alias(a) for a in ("sample1", "empty")])
    return s.select((F.col("sample1") - F.col("empty")).alias("headroom"), (F.col("sample1") - F.col("empty") < least).alias("flat"))
