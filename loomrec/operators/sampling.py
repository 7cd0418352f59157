"""Reproducible draws: negatives, candidate lists, user splits, training examples. Every order and draw is an md5 of
seed and ids, so results do not depend on partitions, and no user is ever crossed with all items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.functions.columns import draw, keyed
from loomrec.scratch import materialise


def popularity(edges: DataFrame) -> DataFrame:
    counts = edges.groupBy("item_id").agg(F.count("*").alias("n"))
    total = edges.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("item_id", "n", (F.col("n") / F.col("total")).alias("popularity"))


#: Probes beyond those that are wanted, which nearly all users can do with.
SPARE = 3


def negatives(users: DataFrame, positives: DataFrame, n_items: int, n: int, seed: int, salt: int = 0, oversample: int = 4, on_short: str = "all") -> DataFrame:
    """user_id, item_id, nth (1 to n): distinct items of 0..n_items-1 that the user has not among its positives.

    Each user makes n * oversample probes; repeats and positives fall out, and the first n stay. Nearly all need only the
    first n + SPARE of them, and those who are still short make them all. Users whose probes do
    not suffice (those with most items as positives) have all items put in order of their hash instead. A user's positives
    are gathered in one row.
    on_short: 'all' gives what there is, 'repeat' repeats the last one up to n, 'error' is checked by short_pools()."""
    own = positives.select("user_id", F.col("item_id").cast("long").alias("item_id"), F.lit(False).alias("asked"))
    rows = own.unionByName(users.select("user_id", F.lit(None).cast("long").alias("item_id"), F.lit(True).alias("asked"))).repartition("user_id")
    rows = rows.groupBy("user_id").agg(F.collect_set("item_id").alias("held"), F.bool_or("asked").alias("asked")).where("asked").drop("asked")
    out = _drawn(rows, n_items, n, seed, salt, oversample).select("user_id", F.posexplode("drawn").alias("nth", "item_id"))
    out = out.select("user_id", "item_id", (F.col("nth") + 1).alias("nth"))
    return repeated(out, users, n) if on_short == "repeat" else out


def _drawn(rows: DataFrame, n_items: int, n: int, seed: int, salt: int, oversample: int = 4) -> DataFrame:
    """rows (user_id, held and others; one row a user) with drawn, the items that negatives() draws, in order, for held.

    A user's probes meet its items in its row, so nothing is shuffled but what is drawn for the few who need all items."""
    probes = lambda k: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: draw(keyed(seed, salt, F.col("user_id"), j), F.lit(n_items)))
    free = lambda k: F.slice(F.array_except(probes(k), F.col("held").cast("array<long>")), 1, n)
    short = F.size("drawn") < n
    rows = rows.withColumn("drawn", free(min(n + SPARE, n * oversample)))
    rows = rows.withColumn("drawn", F.when(short, free(n * oversample)).otherwise(F.col("drawn")))
    rows = materialise(rows.withColumn("held", F.when(short, F.col("held"))), "drawn")  # read several times
    few = rows.where(short)
    if few.isEmpty():
        return rows.drop("held")
    every = all_others(few, few.select("user_id", F.explode("held").alias("item_id")), n_items)
    order = Window.partitionBy("user_id").orderBy(keyed(seed, salt, F.col("user_id"), "all", F.col("item_id")), "item_id")
    every = every.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
    every = every.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "item_id"))), lambda x: x["item_id"]).alias("drawn"))
    few = few.drop("held", "drawn").join(every, "user_id", "left").withColumn("drawn", F.coalesce("drawn", F.array().cast("array<long>")))
    return rows.where(~short).drop("held").unionByName(few)


def repeated(drawn: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """drawn, with each user's last item repeated up to n; 0 for users that have none."""
    held = drawn.groupBy("user_id").agg(F.max("nth").alias("k"), F.max_by("item_id", "nth").alias("item_id"))
    held = users.join(held, "user_id", "left").select("user_id", F.coalesce("item_id", F.lit(0)).alias("item_id"), F.coalesce("k", F.lit(0)).alias("k"))
    return drawn.unionByName(held.where(F.col("k") < n).select("user_id", "item_id", F.explode(F.sequence(F.col("k") + 1, F.lit(n))).alias("nth")))


def all_others(users: DataFrame, mine: DataFrame, n_items: int) -> DataFrame:
    """user_id, item_id: every item of 0..n_items-1 that is not in mine, from the gaps between a user's items in order.

    For the few users whose probes do not suffice: they have most items, and their gaps are short."""
    users = users.select("user_id").distinct()
    ends = users.select("user_id", F.explode(F.array(F.lit(-1).cast("long"), F.lit(n_items).cast("long"))).alias("item_id"))
    held = mine.select("user_id", F.col("item_id").cast("long").alias("item_id")).where(F.col("item_id").between(0, n_items - 1)).join(users, "user_id", "left_semi")
    after = F.lead("item_id").over(Window.partitionBy("user_id").orderBy("item_id"))
    gaps = held.distinct().unionByName(ends).select("user_id", "item_id", after.alias("after")).where(F.col("after") - F.col("item_id") > 1)
    return gaps.select("user_id", F.explode(F.sequence(F.col("item_id") + 1, F.col("after") - 1)).alias("item_id"))


def candidates(targets: DataFrame, positives: DataFrame, n_items: int, n: int, seed: int, salt: int = 0, skip_short: bool = True) -> DataFrame:
    """user_id, item_id, is_target, pos: the target and n - 1 negatives in an order of their own.

    positives decide what may not be drawn: all of a user's items, or its train items alone."""
    target = F.struct(F.col("target").cast("long").alias("item_id"))
    own = positives.select("user_id", F.col("item_id").cast("long").alias("item_id"), F.lit(None).cast("struct<item_id: long>").alias("target"))
    rows = own.unionByName(targets.select("user_id", F.col("target").cast("long").alias("item_id"), target.alias("target"))).repartition("user_id")
    rows = rows.groupBy("user_id").agg(F.collect_set("item_id").alias("held"), F.collect_list("target").alias("targets")).where(F.size("targets") > 0)
    return row_candidates(rows.withColumn("targets", F.transform("targets", lambda t: t["item_id"])), n_items, n, seed, salt, skip_short)


def row_candidates(rows: DataFrame, n_items: int, n: int, seed: int, salt: int = 0, skip_short: bool = True) -> DataFrame:
    """candidates() of rows that hold all of a user: user_id, held (its targets and what else may not be drawn), targets."""
    named = lambda c, is_target: F.transform(c, lambda i: F.struct(keyed(seed, salt, F.col("user_id"), "shuffle", i).alias("key"), i.cast("long").alias("item_id"), F.lit(is_target).alias("is_target")))
    drawn = _drawn(rows, n_items, n - 1, seed, salt)
    lists = drawn.select("user_id", F.sort_array(F.concat(named("drawn", False), named("targets", True))).alias("c"))
    lists = lists.where(F.size("c") == n) if skip_short else lists
    out = lists.select("user_id", F.posexplode("c").alias("pos", "c"))
    return out.select("user_id", F.col("c.item_id").alias("item_id"), F.col("c.is_target").alias("is_target"), "pos")


def short_pools(candidate_rows: DataFrame, n: int) -> DataFrame:
    """Users with fewer than n candidates."""
    return candidate_rows.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") < n)


#: Share of all edges from which an item may count as heavy.
HEAVY_SHARE = 1 / 64


def weighted_negatives(users: DataFrame, edges: DataFrame, positives: DataFrame, n: int, seed: int, oversample: int = 8, buckets: int = 256, n_items: int | None = None) -> DataFrame:
    """user_id, item_id, nth (1 to n): draws without replacement in proportion to popularity.

    A probe picks one of the numbered train edges and takes its item. Edges themselves are not numbered: counts of items
    are added up within buckets, and one count per bucket overall. Dropping repeats of draws with replacement is drawing without.
    Where a few items hold most edges, probes would hit little else: then such items (HEAVY_SHARE of all edges each, so
    there are few) are not probed but each has a time of arrival of its own, exponential with its weight, probes of the
    rest arrive as a Poisson stream of the remaining weight, and both are taken in order of time, which is the same draw.
    Users whose probes do not suffice make `oversample` times as many; those who are short still draw the rest from all
    items of 0..n_items-1 (by default up to the largest id) that are left, by weighted keys, items without train edges
    last and in order of their hash. Where there are too few, the last is repeated; 0 for users without any."""
    if n_items is None:
        n_items = 1 + max(df.agg(F.coalesce(F.max("item_id"), F.lit(-1))).head()[0] for df in (edges, positives))
    counts = materialise(edges.groupBy("item_id").agg(F.count("*").alias("n")), "item_counts")
    every = counts.agg(F.sum("n")).first()[0] or 0
    heavy = [(r["item_id"], r["n"]) for r in counts.where(F.col("n") > HEAVY_SHARE * every).collect()]  # 1 / HEAVY_SHARE at most
    heavy = heavy if 2 * sum(k for _, k in heavy) > every else []
    light = counts.where(~F.col("item_id").isin([i for i, _ in heavy])) if heavy else counts
    light = light.withColumn("bucket", F.pmod("item_id", F.lit(buckets)))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = light.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", earlier(Window.partitionBy(F.lit(1)).orderBy("bucket")).alias("start"))
    total = light.agg(F.nullif(F.sum("n"), F.lit(0)).alias("total"), F.ceil(F.sum("n") / F.count("*")).alias("span"))
    ranges = light.withColumn("at", earlier(Window.partitionBy("bucket").orderBy("item_id"))).join(F.broadcast(starts), "bucket").join(F.broadcast(total))
    # Item i owns the edges low..high-1. Stretches of `span` edges, as many as items, bring probes and items together; those
    # of a very common item are listed in two steps, so that no row holds a long array.
    ranges = ranges.select("item_id", "span", (F.col("start") + F.col("at")).alias("low"), (F.col("start") + F.col("at") + F.col("n")).alias("high"))
    a, b, step = F.floor(F.col("low") / F.col("span")), F.floor((F.col("high") - 1) / F.col("span")), 1 << 14
    ranges = ranges.select("item_id", "low", "high", a.alias("a"), b.alias("b")).select("*", F.explode(F.sequence(F.floor(F.col("a") / step), F.floor(F.col("b") / step))).alias("s"))
    ranges = ranges.select("item_id", "low", "high", F.explode(F.sequence(F.greatest("a", F.col("s") * step), F.least("b", F.col("s") * step + step - 1))).alias("stretch"))
    mine = positives.select("user_id", "item_id").distinct()
    users = users.select("user_id").distinct()
    wait = lambda *parts: -F.log((F.conv(F.substring(keyed(seed, "weighted", F.col("user_id"), *parts), 9, 12), 16, 10).cast("double") + 0.5) / float(2**48))

    def probed(who: DataFrame, times: int) -> DataFrame:
        probes = who.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(n * times - 1))).alias("j")).join(F.broadcast(total))
        probes = probes.select("user_id", "j", "span", "total", draw(keyed(seed, "weighted", F.col("user_id"), F.col("j")), F.col("total")).alias("edge"))
        if heavy:  # when the probe arrives; without heavy items only the order counts
            gaps = Window.partitionBy("user_id").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
            probes = probes.withColumn("j", F.sum(wait(F.col("j"), "gap") / F.col("total")).over(gaps))
        met = probes.withColumn("stretch", F.floor(F.col("edge") / F.col("span"))).join(ranges, "stretch").where("edge >= low and edge < high")
        found = met.groupBy("user_id", "item_id").agg(F.min("j").alias("j"))
        if heavy:
            own = who.select("user_id", F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("item_id"), F.lit(k).alias("n")) for i, k in heavy])))
            found = found.unionByName(own.select("user_id", "item_id", (wait("heavy", F.col("item_id")) / F.col("n")).alias("j")))
        found = found.join(mine, ["user_id", "item_id"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("user_id").orderBy("j"))
        return materialise(found.withColumn("nth", nth).where(F.col("nth") <= n).select("user_id", "item_id", "nth"), "weighted")

    def short(who: DataFrame, drawn: DataFrame) -> DataFrame:
        return materialise(who.join(drawn.where(F.col("nth") == n).select("user_id"), "user_id", "left_anti"), "weighted_short")

    first = probed(users, oversample)
    few = short(users, first)
    if few.isEmpty():
        return first
    more = probed(few, oversample * oversample)
    out = first.join(few, "user_id", "left_anti").unionByName(more)
    few = short(few, more)
    if few.isEmpty():
        return out
    held = more.join(few, "user_id", "left_semi")
    rest = all_others(few, mine.unionByName(held.select("user_id", "item_id")), n_items).join(counts.withColumnRenamed("n", "weight"), "item_id", "left")
    key = keyed(seed, "weighted", F.col("user_id"), "all", F.col("item_id"))
    u = (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    order = Window.partitionBy("user_id").orderBy(F.col("weight").isNull(), -F.log(u) / F.coalesce("weight", F.lit(1)), "item_id")
    had = held.groupBy("user_id").agg(F.count("*").alias("had"))
    rest = rest.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).join(had, "user_id", "left")
    rest = rest.select("user_id", "item_id", (F.col("nth") + F.coalesce("had", F.lit(0))).cast("int").alias("nth")).where(F.col("nth") <= n)
    return repeated(materialise(out.unionByName(rest), "weighted"), users, n)


#: Up to so many users are taken as the smallest of all partitions; more are cut off at their place in a range sort.
SMALL = 100_000


def _first_users(users: DataFrame, key: Column, n: int) -> DataFrame:
    """user_id, nth (from 0) of the n users that are first in the order of key."""
    from loomrec.operators.sequences import running_ids

    rows = users.select(F.col("user_id").alias("id"), key.alias("key"))
    if n <= SMALL:
        nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("key", "id")) - 1
        return rows.orderBy("key", "id").limit(n).select(F.col("id").alias("user_id"), nth.cast("long").alias("nth"))
    return running_ids(rows, "key").where(F.col("user_id") < n).select(F.col("id").alias("user_id"), F.col("user_id").alias("nth"))


def user_sample(users: DataFrame, n: int, seed: int) -> DataFrame:
    """n users in the order of their hash, sorted by id; all if there are no more."""
    return _first_users(users.select("user_id").distinct(), keyed(seed, F.col("user_id")), n).select("user_id").orderBy("user_id")


def chosen_users(population: DataFrame, seed: int, listed: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """A given list over a sample of n over all."""
    if listed is not None:
        return population.select("user_id").distinct().join(listed.select("user_id").distinct(), "user_id")
    return user_sample(population, n, seed) if n is not None else population.select("user_id").distinct()


def eligible_users(split: DataFrame, min_train: int = 1) -> DataFrame:
    """Users with a test item and at least min_train train items."""
    counts = split.groupBy("user_id").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"))
    return counts.where((F.col("n_test") > 0) & (F.col("n_train") >= min_train)).select("user_id")


def user_splits(users: DataFrame, pinned_test: DataFrame, n_train: int, n_val: int, seed: int) -> DataFrame:
    """user_id, part: pinned users test; of the others, by hash, the first n_train train and the next n_val val."""
    pinned = pinned_test.select("user_id").distinct()
    free = users.select("user_id").distinct().join(pinned, "user_id", "left_anti")
    free = materialise(_first_users(free, keyed(seed, "split", F.col("user_id")), n_train + n_val), "free_users")
    if free.count() < n_train + n_val:
        raise ValueError(f"not enough eligible users for {n_train} + {n_val}")
    return free.select("user_id", F.when(F.col("nth") < n_train, "train").otherwise("val").alias("part")).unionByName(pinned.select("user_id", F.lit("test").alias("part")))


def overlapping_users(splits: DataFrame) -> DataFrame:
    """Users in more than one part, or more than once in a part."""
    return splits.groupBy("user_id").agg(F.count_distinct("part").alias("parts"), F.count("*").alias("n")).where("parts > 1 or n > 1")


def checked_splits(splits: DataFrame, parts: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """The splits, if every part is there and no user is in two or twice in one; else an error."""
    missing = sorted(set(parts) - {r["part"] for r in splits.select("part").distinct().collect()})
    if missing:
        raise ValueError(f"splits lack {missing}")
    if not overlapping_users(splits).isEmpty():
        raise ValueError("users are in several parts, or repeated")
    return splits


def listed_candidates(lists: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """user_id, item_id, is_target, pos from ready-made lists (user_id, item_id, pos), as candidates() gives them: users
    whose first n items hold their target."""
    rows = lists.where(F.col("pos") < n).join(targets.select("user_id", "target"), "user_id")
    rows = rows.withColumn("is_target", F.col("item_id") == F.col("target"))
    return rows.withColumn("_any", F.max("is_target").over(Window.partitionBy("user_id"))).where("_any").select("user_id", "item_id", "is_target", "pos")


def first_of_each(splits: DataFrame, n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("part").orderBy("user_id"))
    return splits.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_nth")


def shuffled_partner(rows: DataFrame) -> DataFrame:
    """user_id, partner_id: the next user in order of id, the first after the last. Each user appears once in rows."""
    from loomrec.operators.sequences import running_ids

    numbered = running_ids(rows.select(F.col("user_id").alias("id")), "id").select("id", F.col("user_id").alias("nth"))
    total = numbered.agg(F.count("*").alias("total"))
    mine = numbered.join(F.broadcast(total)).select(F.col("id").alias("user_id"), ((F.col("nth") + 1) % F.col("total")).alias("nth"))
    return mine.join(numbered, "nth").select("user_id", F.col("id").alias("partner_id"))


def bpr_triples(edges: DataFrame, positives: DataFrame, n_items: int, seed: int, probes: int = 10) -> DataFrame:
    """user_id, pos_item, pos, neg_item: for each train edge the first probe that is not a positive of the user.

    Edges whose probes are all positives draw from all items that are not: each user's are numbered in the order of
    their hash. A user that holds every item gets 0."""
    neg = lambda j: draw(keyed(seed, "bpr", F.col("user_id"), F.col("pos"), j), F.lit(n_items)).alias("neg")
    mine = positives.select("user_id", F.col("item_id").alias("neg")).distinct()
    # Nearly every edge needs one probe; the others make the rest of theirs.
    edges = edges.select("user_id", F.col("item_id").alias("pos_item"), "pos")
    first = edges.select("*", neg(F.lit(0))).join(mine.withColumn("held", F.lit(True)), ["user_id", "neg"], "left")
    first = materialise(first.select("user_id", "pos_item", "pos", F.col("neg").alias("neg_item"), F.coalesce("held", F.lit(False)).alias("held")), "bpr_first")
    again = first.where("held").select("user_id", "pos_item", "pos", F.explode(F.sequence(F.lit(1), F.lit(probes - 1)) if probes > 1 else F.array().cast("array<int>")).alias("j"))
    again = again.withColumn("neg", neg(F.col("j"))).join(mine, ["user_id", "neg"], "left_anti")
    again = materialise(again.groupBy("user_id", "pos_item", "pos").agg(F.min_by("neg", "j").alias("neg_item")), "bpr")
    found = first.where("not held").drop("held").unionByName(again)
    key = ["user_id", "pos_item", "pos"]
    left = materialise(first.where("held").select(*key).distinct().join(again, key, "left_anti"), "bpr_left")
    pool = all_others(left.select("user_id").distinct(), mine.withColumnRenamed("neg", "item_id"), n_items)
    order = Window.partitionBy("user_id").orderBy(keyed(seed, "bpr", F.col("user_id"), "all", F.col("item_id")), "item_id")
    pool = materialise(pool.select("user_id", F.col("item_id").alias("neg_item"), (F.row_number().over(order) - 1).cast("long").alias("nth")), "bpr_pool")
    sizes = pool.groupBy("user_id").agg(F.count("*").alias("size"))
    at = draw(keyed(seed, "bpr", F.col("user_id"), F.col("pos"), "all"), F.col("size")).alias("nth")
    left = left.join(sizes, "user_id", "left").select(*key, at).join(pool, ["user_id", "nth"], "left")
    return found.unionByName(left.select(*key, F.coalesce("neg_item", F.lit(0)).cast(dict(found.dtypes)["neg_item"]).alias("neg_item")))


def sequence_examples(split: DataFrame, max_len: int, n_neg: int, n_items: int, seed: int) -> DataFrame:
    """user_id, length, input, target (right-padded with 0 to max_len - 1) and negatives (n_neg per place, wrapping round)."""
    train = split.where("split = 'train'")
    held = train.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("pos", "item_id"))).alias("h")).where(F.size("h") >= 2)
    items = F.transform("h", lambda x: x["item_id"])
    held = held.select("user_id", F.slice(items, F.greatest(F.size("h") - max_len + 1, F.lit(1)), max_len).alias("items")).withColumn("length", F.size("items") - 1)
    drawn = negatives(held.select("user_id"), split, n_items, n_neg * (max_len - 1), seed, 7)
    drawn = drawn.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "item_id"))), lambda x: x["item_id"]).alias("pool"))
    room = F.lit(max_len - 1)
    pad = lambda a: F.concat(a, F.array_repeat(F.lit(0).cast("long"), room - F.size(a)))
    out = held.join(drawn, "user_id", "left")
    wrapped = F.transform(F.sequence(F.lit(0), F.col("length") * n_neg - 1), lambda i: F.get("pool", F.pmod(i, F.size("pool"))))
    return out.select("user_id", "length", pad(F.slice("items", 1, F.col("length"))).alias("input"), pad(F.slice("items", 2, F.col("length"))).alias("target"), wrapped.alias("negatives"))
