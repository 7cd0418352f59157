"""Scores of neighbours and the mix-constrained choice of the best k."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.operators.graph import item_neighbors, neighbor_rounds
from loomrec.scratch import discard, materialise, written

Rule = Callable[[Column, Column, Column, Column, Column, Column], Column]


def neighbors(edges: DataFrame, max_items: int = 100, max_users: int = 50) -> DataFrame:
    """user_id, nb_type, nb_id, recency, overlap, nb_degree, own_degree, max_degree, ord for both kinds of neighbours."""
    return _united(_rounds(edges, max_items, max_users))


def _united(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rounds(edges: DataFrame, max_items: int = 100, max_users: int = 50, keep: bool = True) -> Iterator[DataFrame]:
    """neighbors() by the rounds of users in which user neighbours are found; keep as in neighbor_rounds()."""
    given, edges = edges, edges if written(edges) else materialise(edges.select("user_id", "item_id", "pos", "recency"), "edges")
    item_degree = materialise(edges.groupBy("item_id").agg(F.count("*").alias("nb_degree")), "item_degree")
    user_degree = materialise(edges.groupBy("user_id").agg(F.count("*").alias("own_degree")), "user_degree")
    top = item_degree.agg(F.max("nb_degree").alias("max_item")).join(user_degree.agg(F.max("own_degree").alias("max_user")))  # one row by one row
    for turn, found in neighbor_rounds(edges, max_users, keep=keep):
        items = item_neighbors(edges if turn is None else edges.where(turn), max_items).join(item_degree, "item_id")
        items = items.select("user_id", F.lit("item").alias("nb_type"), F.col("item_id").alias("nb_id"), "recency", F.lit(0).cast("long").alias("overlap"), "nb_degree", "ord")
        users = found.join(user_degree.select(F.col("user_id").alias("neighbor_id"), F.col("own_degree").alias("nb_degree")), "neighbor_id")
        users = users.select("user_id", F.lit("user").alias("nb_type"), F.col("neighbor_id").alias("nb_id"), F.lit(0.0).alias("recency"), "overlap", "nb_degree", "ord")
        both = items.unionByName(users).join(user_degree, "user_id").join(F.broadcast(top))
        yield both.withColumn("max_degree", F.when(F.col("nb_type") == "item", F.col("max_item")).otherwise(F.col("max_user"))).drop("max_item", "max_user")
    if not keep:
        discard(item_degree, user_degree, *([] if edges is given else [edges]))


def hybrid_score(nb: DataFrame, item_weight: float = 1.0, user_weight: float = 0.5) -> DataFrame:
    """nb with score; a column candidate_share, where there is one, adds to items."""
    extra = 0.5 * F.col("candidate_share") if "candidate_share" in nb.columns else F.lit(0.0)
    popular = F.col("nb_degree") / F.col("max_degree")
    item = (0.5 * F.col("recency") + 0.3 * popular + extra) * item_weight
    user = (0.7 * F.coalesce(F.try_divide("overlap", "own_degree"), F.lit(0.0)) + 0.3 * popular) * user_weight
    return nb.withColumn("score", F.when(F.col("nb_type") == "item", item).otherwise(user))


def features(nb: DataFrame) -> DataFrame:
    """nb with the ten features of the learned scorer: type, degree, recency, overlap, six zeros."""
    item = F.col("nb_type") == "item"
    parts = [item.cast("double"), F.col("nb_degree") / F.col("max_degree"), F.when(item, F.col("recency")).otherwise(0.0), F.when(item, 0.0).otherwise(F.coalesce(F.try_divide("overlap", "own_degree"), F.lit(0.0)))]
    return nb.withColumn("features", F.array(*parts, *[F.lit(0.0)] * 6))


def mlp_score(nb: DataFrame, weights: dict | None) -> DataFrame:
    """A layer of rectified units and a sigmoid over features; hybrid scores where no weights are given.

    logit, the sum before the sigmoid, orders as the score does, and does not depend on how an engine rounds exp().
    weights: w1 (units x 10), b1, w2 (units), b2. They are literals of the plan: a few hundred numbers."""
    if weights is None:
        return hybrid_score(nb)
    total = F.lit(float(weights["b2"]))
    for row, bias, out in zip(weights["w1"], weights["b1"], weights["w2"]):
        unit = F.lit(float(bias))
        for i, w in enumerate(row):
            if w:
                unit = unit + F.col("features")[i] * float(w)
        total = total + F.greatest(unit, F.lit(0.0)) * float(out)
    return features(nb).withColumn("logit", total).withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))


def mix_top_k(scored: DataFrame, k: int = 16, min_items: int = 6, min_users: int = 4) -> DataFrame:
    """The first min_items items and min_users users, then the best of the rest up to k; ord follows the score, or the
    logit that it is made of."""
    best = F.desc("logit" if "logit" in scored.columns else "score")
    kind = Window.partitionBy("user_id", "nb_type").orderBy(best, "ord")
    rows = scored.withColumn("nth", F.row_number().over(kind))
    is_item = F.col("nb_type") == "item"
    rows = rows.withColumn("slot", F.when(is_item & (F.col("nth") <= min_items), 0).when(~is_item & (F.col("nth") <= min_users), 1).otherwise(2))
    rows = rows.withColumn("forced", F.count_if(F.col("slot") < 2).over(Window.partitionBy("user_id")))
    rest = Window.partitionBy("user_id", F.col("slot") == 2).orderBy(best, "nb_type", "nth")
    rows = rows.withColumn("fill", F.row_number().over(rest)).where((F.col("slot") < 2) | (F.col("fill") <= F.lit(k) - F.col("forced")))
    final = Window.partitionBy("user_id").orderBy(best, "slot", "nb_type", "nth")
    return rows.withColumn("ord", F.row_number().over(final)).drop("nth", "slot", "forced", "fill", "logit")


# Domain rules. Arguments: edge weight, days, metadata overlap, users in common, memory similarity, whether an item.


def books(edge, days, overlap, common, memory, item):
    out = edge * F.when(overlap > 0.6, 2.5).otherwise(1.0)
    out = out * F.when(common > 3, F.lit(1.8) * F.when(memory > 0.5, 1.5).otherwise(1.0)).otherwise(1.0)
    out = out * F.when(days > 180, F.exp(-0.004 * days)).otherwise(1.0)
    return out * (1.0 + F.when(item, 1.2).otherwise(0.8) * memory)


def goodreads(edge, days, overlap, common, memory, item):
    out = edge * F.when(common > 15, 0.7).otherwise(1.0)
    out = out * F.when(common > 10, 2.0).otherwise(1.0) * F.when(common > 15, 1.5).otherwise(1.0)
    out = out * F.when(overlap > 0.8, 3.0).otherwise(1.0) * (1.0 + F.when(common > 10, 1.5).otherwise(1.0) * memory)
    return out * F.when(days > 365, F.exp(-0.002 * days)).otherwise(1.0)


def movietv(edge, days, overlap, common, memory, item):
    fades = F.when(days <= 60, 1.0).when(days <= 180, F.exp(-0.018 * days)).otherwise(F.exp(-0.025 * days))
    out = edge * F.when(common >= 3, 2.5).otherwise(1.0) * fades * F.when(days > 365, 0.3).otherwise(1.0)
    out = out + F.when(common < 3, 2.8 * overlap).otherwise(1.0)
    return out * (1.0 + F.when(common >= 3, 1.8).otherwise(1.5) * memory) * F.when(overlap > 0.6, 1.5).otherwise(1.0)


def yelp(edge, days, overlap, common, memory, item):
    out = edge * F.when(common >= 2, 2.0).otherwise(0.5) * F.when(overlap > 0.85, 4.5).when(overlap > 0.7, 3.5).otherwise(1.0)
    out = out * (1.0 + F.when(overlap > 0.7, 2.2).otherwise(1.0) * memory)
    out = out * F.when(days <= 90, 1.0).when(days <= 180, F.exp(-0.028 * days)).otherwise(0.5 * F.exp(-0.028 * days))
    return out * F.when(overlap < 0.4, 0.2).otherwise(1.0)


RULES: dict[str, Rule] = {"books": books, "goodreads": goodreads, "movietv": movietv, "yelp": yelp}
DESCRIPTIONS = {
    "books": "Books: shared readers and related metadata count, old links fade slowly",
    "goodreads": "GoodReads: many shared readers count, very common ones less",
    "movietv": "MovieTV: shared viewers count, else metadata; interest fades fast",
    "yelp": "Yelp: the category decides, visits fade fast",
}


def register_rule(name: str, rule: Rule, description: str = "") -> None:
    RULES[name.lower()], DESCRIPTIONS[name.lower()] = rule, description or name


@contextmanager
def rule_of_own(name: str, rule: Rule, description: str = "") -> Iterator[None]:
    """A rule that is registered while plans are made: left in place it would be found for other domains too (own in unknown)."""
    before = [(held, held.copy()) for held in (RULES, DESCRIPTIONS)]
    register_rule(name, rule, description)
    try:
        yield
    finally:
        for held, was in before:
            held.clear()
            held.update(was)


def rule_name(domain: str) -> str:
    """The rule of a domain: by exact name, else the first whose name holds the domain's or is held by it, else books."""
    domain = domain.lower()
    if domain in RULES:
        return domain
    return next((n for n in RULES if n in domain or domain and domain in n), "books")


def rule_score(nb: DataFrame, domain: str) -> DataFrame:
    """nb with score (the edge weight) and rule_score; metadata_overlap and memory_sim are taken where given."""
    item = F.col("nb_type") == "item"
    edge = F.when(item, F.when(F.col("recency") > 0, F.col("recency")).otherwise(0.5)).otherwise(F.when(F.col("own_degree") > 0, F.col("overlap") / F.col("own_degree")).otherwise(0.5))
    days = F.when(item, F.when(F.col("recency") > 0, (1.0 - F.col("recency")) * 365).otherwise(180.0)).otherwise(0.0)
    overlap = F.col("metadata_overlap") if "metadata_overlap" in nb.columns else F.when(item, 0.5).otherwise(0.0)
    memory = F.col("memory_sim") if "memory_sim" in nb.columns else F.lit(0.0)
    rows = nb.withColumn("score", edge).withColumn("days", days)
    return rows.withColumn("rule_score", RULES[rule_name(domain)](F.col("score"), F.col("days"), overlap, F.when(item, 0).otherwise(F.col("overlap")), memory, item))


def rule_top_k(ruled: DataFrame, k: int = 16, min_items: int = 6, min_users: int = 4) -> DataFrame:
    """Users first, then items, then the best of the rest that are not chosen already; cut to k, ord is this order."""
    rows = ruled.withColumn("list_ord", F.row_number().over(Window.partitionBy("user_id").orderBy("nb_type", "ord")))
    kind = Window.partitionBy("user_id", "nb_type").orderBy(F.desc("rule_score"), "list_ord")
    rows = rows.withColumn("nth", F.row_number().over(kind))
    is_item = F.col("nb_type") == "item"
    rows = rows.withColumn("slot", F.when(~is_item & (F.col("nth") <= min_users), 0).when(is_item & (F.col("nth") <= min_items), 1).otherwise(2))
    chosen = F.min("slot").over(Window.partitionBy("user_id", "nb_type", "nb_id")) < 2
    rows = rows.withColumn("again", chosen & (F.col("slot") == 2)).where("not again")
    order = Window.partitionBy("user_id").orderBy("slot", F.when(F.col("slot") < 2, F.col("nth")), F.desc("rule_score"), "list_ord")
    return rows.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= k).drop("nth", "slot", "again", "list_ord")


def explained(chosen: DataFrame, domain: str) -> DataFrame:
    text = F.format_string("%s-%d: weight %.3f, rule score %.3f. %s", F.initcap("nb_type"), F.col("nb_id"), F.col("score"), F.col("rule_score"), F.lit(DESCRIPTIONS[rule_name(domain)]))
    return chosen.withColumn("explanation", text)


def counts_by_type(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("user_id").agg(F.count_if(F.col("nb_type") == "item").alias("n_items"), F.count_if(F.col("nb_type") == "user").alias("n_users"))


def top_neighbors(edges: DataFrame, mode: str = "hybrid", domain: str = "books", weights: dict | None = None, **k) -> DataFrame:
    """One of the modes hybrid, mlp and rules. The choice is the user's own, so it is made round by round."""

    def chosen(nb: DataFrame) -> DataFrame:
        if mode == "rules":
            return rule_top_k(rule_score(nb, domain), **k)
        return mix_top_k(mlp_score(nb, weights) if mode == "mlp" else hybrid_score(nb), **k)

    return _united(materialise(chosen(nb), "chosen") for nb in _rounds(edges, keep=False))
