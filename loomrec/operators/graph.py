"""The user-item graph: degrees, neighbours by recency and by shared items, candidate overlap."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.scratch import discard, materialise


def degrees(edges: DataFrame) -> DataFrame:
    """kind, id, degree: bag counts of users and items."""
    users = edges.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("degree")).select(F.lit("user").alias("kind"), "id", "degree")
    items = edges.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("degree")).select(F.lit("item").alias("kind"), "id", "degree")
    return users.unionByName(items)


def graph_stats(edges: DataFrame) -> DataFrame:
    s = edges.agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"), F.count("*").alias("n_edges"))
    mean = lambda n: F.coalesce(F.try_divide(F.col("n_edges"), F.col(n)), F.lit(0.0))
    return s.withColumns({"mean_user_degree": mean("n_users"), "mean_item_degree": mean("n_items")})


def item_neighbors(edges: DataFrame, most: int = 100) -> DataFrame:
    """user_id, item_id, recency, ord: the latest first, equal ones in order of history."""
    order = Window.partitionBy("user_id").orderBy(F.desc("recency"), "pos")
    return edges.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most).select("user_id", "item_id", "recency", "ord")


#: Pairs, or ids that are shipped, from which the work is done in rounds; and so many of them a round for each row of the table.
ROUND_IDS, ROUND_SHARE = 64_000_000, 4


def _turns(n: int, rows: int) -> list[Column | None]:
    """Conditions that deal users to rounds, so that a round ships a bounded share of n ids for a table of `rows` rows; None
    where one round does. How many there are depends on n / rows and not on the table's size."""
    rounds = max(1, min(-(-n // ROUND_IDS), -(-n // max(1, ROUND_SHARE * rows))))
    return [F.pmod(F.xxhash64("user_id"), F.lit(rounds)) == at for at in range(rounds)] if rounds > 1 else [None]


def user_neighbors(edges: DataFrame, most: int = 50, **options) -> DataFrame:
    """user_id, neighbor_id, overlap, ord: users by bag overlap, then first shared position, then id.

    Edges are summed up per (user, item) before users meet over an item. Options are those of neighbor_rounds()."""
    parts = [part for _, part in neighbor_rounds(edges, most, **options)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def neighbor_rounds(
    edges: DataFrame, most: int = 50, max_item_degree: int | None = None, hot_degree: int = 10_000, hot_items: int = 8, block: int = 4096, light_degree: int = 512, keep: bool = True
) -> Iterator[tuple[Column | None, DataFrame]]:
    """user_neighbors() by rounds of users: the condition on user_id that a round's users meet (None: all of them), and
    their neighbours, written if there are several rounds, so that disk holds the lists of one round at a time.

    keep: without it a round is read before the next one is asked for, and what was written for it is deleted then.
    Results are the same whatever the four parameters before it are: the hot_items items of most users, if they have more
    than hot_degree, make no pairs of users (see _over_hot); items of more than light_degree users are met in order of
    their users' number, by those users alone that may still find a neighbour there (see _bounded_pairs); and the users
    of large items are dealt to blocks, so that no key joins more than block users to the rest. With such items there
    is one round.
    max_item_degree leaves out items of more users than that; it changes results and is off unless given."""
    bag = whole = materialise(edges.groupBy("user_id", "item_id").agg(F.count("*").alias("k"), F.min("pos").alias("first")), "bag")
    d = sizes = materialise(bag.groupBy("item_id").agg(F.count("*").alias("d"), F.max("k").alias("top")), "item_degrees")
    if max_item_degree is not None:
        d = d.where(F.col("d") <= max_item_degree)
        bag = bag.join(d.select("item_id"), "item_id", "left_semi")
    largest = [(r["item_id"], r["d"]) for r in d.orderBy(F.desc("d"), "item_id").limit(hot_items + 1).collect()]
    hot = [i for i, n in largest[:hot_items] if n > hot_degree]
    rest = bag.where(~F.col("item_id").isin(hot)) if hot else bag
    order = Window.partitionBy("user_id").orderBy(F.desc("overlap"), "first", "neighbor_id")
    cut = lambda pairs: pairs.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most).select("user_id", "neighbor_id", "overlap", "ord")
    large = bool([n for i, n in largest if i not in hot and n > light_degree])
    met = d.agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("rows")).first()
    turns = [None] if hot or large else _turns(met["n"], met["rows"])
    if len(turns) > 1:
        lists = materialise(_lists(rest, d, block), "lists")
        for turn in turns:
            found = materialise(cut(_met_pairs(rest.where(turn), lists, d, block)), "user_neighbors")
            yield turn, found
            if not keep:
                discard(found)
        if not keep:
            discard(lists, whole, sizes)
        return
    pairs = _bounded_pairs(bag, d, hot, most, block, light_degree) if large else _pairs(rest, rest, d, block)
    if hot:
        pairs = _over_hot(materialise(bag.where(F.col("item_id").isin(hot)), "hot"), pairs, hot, most)
    yield None, cut(pairs)


#: Pairs that a task puts together in memory.
TASK_PAIRS = 4_000_000


def _pairs(mine: DataFrame, other: DataFrame, degrees: DataFrame, block: int) -> DataFrame:
    """user_id, neighbor_id, overlap, first of users of mine and of other with an item in common.

    An item's users go to each of them as lists of four bytes a user, and pairs are made and summed up only where all of
    a user's lists are, so that no row a pair is shuffled or written. A large item's users are dealt to blocks, a list
    each: those of mine meet the lists of a block of their own number, repeated for every block."""
    return _met_pairs(mine, _lists(other, degrees, block), degrees, block)


def _dealt(rows: DataFrame, degrees: DataFrame, block: int) -> DataFrame:
    large = degrees.where(F.col("d") > block).select("item_id", F.ceil(F.col("d") / block).cast("int").alias("blocks"))
    return rows.join(large, "item_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("at", F.pmod(F.xxhash64("user_id"), F.col("blocks")).cast("int"))


def _lists(other: DataFrame, degrees: DataFrame, block: int) -> DataFrame:
    """item_id, high, low, k2, at: the users of an item's block, for each block that they are to meet."""
    ids = F.struct((F.col("user_id").bitwiseAND(0x7FFFFFFF)).cast("int").alias("low"), "k")
    lists = _dealt(other, degrees, block).groupBy("item_id", "blocks", "at", F.shiftright("user_id", 31).alias("high")).agg(F.sort_array(F.collect_list(ids)).alias("held"), F.max("k").alias("most"))  # block at most
    return lists.select("item_id", "high", F.col("held")["low"].alias("low"), F.when(F.col("most") > 1, F.col("held")["k"]).alias("k2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"))


def _met_pairs(mine: DataFrame, lists: DataFrame, degrees: DataFrame, block: int) -> DataFrame:
    met = _dealt(mine, degrees, block).join(lists, ["item_id", "at"]).select("user_id", "k", "first", "high", "low", "k2")
    n = mine.join(degrees, "item_id").agg(F.sum("d")).first()[0] or 0
    parts = max(int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_PAIRS + 1)
    pairs = met.repartition(parts, "user_id").select("user_id", "k", "first", "high", "k2", F.posexplode("low").alias("nth", "low"))
    pairs = pairs.select("user_id", F.shiftleft("high", 31).bitwiseOR(F.col("low").cast("long")).alias("neighbor_id"), (F.col("k") * F.coalesce(F.get("k2", F.col("nth")), F.lit(1))).alias("k"), "first").where("user_id <> neighbor_id")
    return pairs.groupBy("user_id", "neighbor_id").agg(F.sum("k").alias("overlap"), F.min("first").alias("first"))


def _bounded_pairs(bag: DataFrame, degrees: DataFrame, hot: list, most: int, block: int, light_degree: int) -> DataFrame:
    """Pairs over the items that are not hot, as _pairs() gives them, but for those that cannot be among a user's first `most`.

    Items are met by level, each of four times as many users as the one before. What a user can still gain from items not
    met is at most the sum of its own counts times the largest count of each. Once the last of its first `most` has more
    than that, nobody whom it has not met yet can come in: the search ends, and those it has met that are still near
    enough are completed by looking up what they have in the other items. Others go on to the next level."""
    level = F.when(F.col("d") <= light_degree, 0).otherwise(F.ceil(F.log(F.col("d") / light_degree) / F.log(F.lit(4.0)))).cast("int")
    level = F.when(F.col("item_id").isin(hot), 1 << 20).otherwise(level) if hot else level
    bag = materialise(bag.join(degrees, "item_id").select("user_id", "item_id", "k", "first", level.alias("level"), (F.col("k") * F.col("top")).alias("gain")), "leveled")
    levels = sorted(r["level"] for r in bag.select("level").distinct().collect() if r["level"] < 1 << 20)  # a few dozen at most
    searching, met, out = None, None, None
    for at in levels:
        here = bag.where(F.col("level") == at)
        mine = here if searching is None else here.join(searching, "user_id", "left_semi")
        found = _pairs(mine, here, degrees, block)
        if met is not None:
            found = met.join(searching, "user_id", "left_semi").unionByName(found).groupBy("user_id", "neighbor_id").agg(F.sum("overlap").alias("overlap"), F.min("first").alias("first"))
        met = materialise(found, "met")
        if at == levels[-1]:
            out = met if out is None else out.unionByName(met)
            break
        left = bag.where(F.col("level") > at).groupBy("user_id").agg(F.sum("gain").alias("left"))
        nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("overlap")))
        last = met.select("user_id", "overlap", nth.alias("nth")).where(F.col("nth") == most).select("user_id", F.col("overlap").alias("least"))
        users = bag.select("user_id").distinct() if searching is None else searching
        state = users.join(left, "user_id", "left").join(last, "user_id", "left").select("user_id", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("least", F.lit(0)).alias("least"))
        state = materialise(state.withColumn("done", (F.col("left") == 0) | (F.col("least") > F.col("left"))), "search")
        near = met.join(state.where("done"), "user_id").where(F.col("overlap") + F.col("left") >= F.col("least")).select("user_id", "neighbor_id", "overlap", "first")
        beyond = bag.where((F.col("level") > at) & (F.col("level") < 1 << 20))
        theirs = beyond.select(F.col("user_id").alias("neighbor_id"), "item_id", F.col("k").alias("k2"))
        more = near.select("user_id", "neighbor_id").join(beyond.select("user_id", "item_id", "k", "first"), "user_id").join(theirs, ["neighbor_id", "item_id"])
        more = more.select("user_id", "neighbor_id", (F.col("k") * F.col("k2")).alias("overlap"), "first")
        whole = near.unionByName(more).groupBy("user_id", "neighbor_id").agg(F.sum("overlap").alias("overlap"), F.min("first").alias("first"))
        out = whole if out is None else out.unionByName(whole)
        searching = state.where("not done").select("user_id")
    return materialise(out, "bounded")


def _over_hot(bag: DataFrame, pairs: DataFrame, hot: list, most: int) -> DataFrame:
    """pairs completed by what users have in common in hot items, with every pair that may be among a user's first `most`
    and has only hot items in common.

    Users with the same counts of the hot items are one kind. They differ by id alone to anyone else, so the most + 1
    smallest ids of a kind stand for it, and kinds meet kinds; a kind's users take over what it found."""
    n = range(len(hot))
    count = lambda i: F.coalesce(F.sum(F.when(F.col("item_id") == hot[i], F.col("k"))), F.lit(0))
    users = bag.groupBy("user_id").agg(F.array(*[count(i) for i in n]).alias("kind"), F.array(*[F.min(F.when(F.col("item_id") == hot[i], F.col("first"))) for i in n]).alias("firsts"))
    users = materialise(users, "hot_users")

    by_id = Window.partitionBy("kind").orderBy("user_id")
    ids = users.select("kind", "user_id", F.row_number().over(by_id).alias("nth")).where(F.col("nth") <= most + 1)
    ids = materialise(ids.select(F.col("kind").alias("other"), F.col("user_id").alias("neighbor_id")), "hot_ids")
    held = ids.groupBy("other").agg(F.count("*").alias("held"))
    on = lambda c: F.explode(F.filter(F.transform(F.col(c), lambda k, i: F.when(k > 0, i)), lambda i: i.isNotNull())).alias("i")
    theirs = held.select("other", "held", on("other"))
    meet = held.select(F.col("other").alias("kind")).select("kind", on("kind")).join(theirs, "i").select("kind", "other", "held").distinct()
    shared = F.zip_with("kind", "other", lambda a, b: a * b)
    meet = meet.select("kind", "other", "held", F.aggregate(shared, F.lit(0).cast("long"), lambda s, x: s + x).alias("overlap"), F.transform(shared, lambda x: x > 0).alias("mask"))
    # Kinds that fewer than most + 1 users of a larger overlap come before, and of equal ones the smallest ids for each
    # set of shared items: the first shared position depends on that set.
    upto = F.sum("held").over(Window.partitionBy("kind").orderBy(F.desc("overlap")).rangeBetween(Window.unboundedPreceding, 0))
    meet = meet.withColumn("before", upto - F.sum("held").over(Window.partitionBy("kind", "overlap"))).where(F.col("before") <= most)
    near = Window.partitionBy("kind", "overlap", "mask").orderBy("neighbor_id")
    found = meet.join(ids, "other").withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= most + 1)
    found = found.groupBy("kind").agg(F.collect_list(F.struct("neighbor_id", "overlap", "mask")).alias("found"))  # kinds times ids, not users

    first = lambda mask, firsts: F.array_min(F.zip_with(mask, firsts, lambda m, f: F.when(m, f)))
    only_hot = users.join(found, "kind").select("user_id", "firsts", F.explode("found").alias("f"))
    only_hot = only_hot.select("user_id", "f.neighbor_id", "f.overlap", first(F.col("f.mask"), F.col("firsts")).alias("first")).where("user_id <> neighbor_id")

    theirs = users.select(F.col("user_id").alias("neighbor_id"), F.col("kind").alias("other"))
    both = pairs.join(users, "user_id", "left").join(theirs, "neighbor_id", "left")
    shared = F.zip_with("kind", "other", lambda a, b: a * b)
    more = F.coalesce(F.aggregate(shared, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    firsts = F.least("first", first(F.transform(shared, lambda x: x > 0), F.col("firsts")))  # nulls do not count
    both = both.select("user_id", "neighbor_id", (F.col("overlap") + more).alias("overlap"), firsts.alias("first"))
    # A pair found both ways has its whole overlap in the larger row, and its first position is the smaller.
    return both.unionByName(only_hot).groupBy("user_id", "neighbor_id").agg(F.max("overlap").alias("overlap"), F.min("first").alias("first"))


def lookup(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (user_id, item_id) with recency (0 if there is no edge) and both degrees (0 if unknown)."""
    # Edges and what is asked meet where their user is, so that both are shuffled once for it.
    known = edges.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull()).select("user_id", "item_id", "recency", F.lit(False).alias("asked"))
    rows = known.unionByName(asked.select("user_id", "item_id", F.lit(None).cast("double").alias("recency"), F.lit(True).alias("asked"))).repartition("user_id")
    met = rows.groupBy("user_id", "item_id").agg(F.max("recency").alias("recency"), F.count_if("asked").alias("times")).where("times > 0")
    asked = met.select("user_id", "item_id", "recency", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_")).drop("_")
    users = edges.groupBy("user_id").agg(F.count("*").alias("user_degree"))
    items = edges.groupBy("item_id").agg(F.count("*").alias("item_degree"))
    out = asked.join(users, "user_id", "left").join(items, "item_id", "left")
    return out.select("user_id", "item_id", F.coalesce("recency", F.lit(0.0)).alias("recency"), F.coalesce("user_degree", F.lit(0)).alias("user_degree"), F.coalesce("item_degree", F.lit(0)).alias("item_degree"))


def candidate_overlap(edges: DataFrame, neighbors: DataFrame, candidates: DataFrame, block: int = 8192) -> DataFrame:
    """user_id, item_id, share: for each neighbour item, the largest number of users it has in common with one of the
    user's candidates, over its own users.

    An item's users are held as one set for each block of user ids. The sets go to the asking users, once an item that a
    user names and not once a pair of them, and meet there block by block; common users are counted by intersecting two
    sets. Users are taken in rounds, so that disk holds the sets of one round at a time."""
    users = edges.select("item_id", "user_id").distinct()
    sets = users.groupBy("item_id", F.floor(F.col("user_id") / block).alias("block")).agg(F.collect_list(F.pmod("user_id", F.lit(block)).cast("int")).alias("own"))  # block at most
    sets = materialise(sets, "item_users")
    n_users = materialise(sets.groupBy("item_id").agg(F.sum(F.size("own")).alias("n_users")), "item_degrees")
    near = materialise(neighbors.select("user_id", "item_id").distinct().join(n_users, "item_id", "left"), "near")
    asked = materialise(candidates.select("user_id", F.col("item_id").alias("candidate")).distinct(), "asked")
    sizes = n_users.withColumnRenamed("item_id", "candidate")
    shipped = near.select("n_users").unionByName(asked.join(sizes, "candidate").select("n_users")).agg(F.sum("n_users")).first()[0] or 0
    rows = n_users.agg(F.sum("n_users")).first()[0] or 0
    turns, out = _turns(shipped, rows), None
    for turn in turns:
        mine, theirs = (near, asked) if turn is None else (near.where(turn), asked.where(turn))
        left = mine.select("user_id", "item_id").join(sets, "item_id")
        right = theirs.join(sets.select(F.col("item_id").alias("candidate"), "block", F.col("own").alias("other")), "candidate")
        common = left.join(right, ["user_id", "block"]).select("user_id", "item_id", "candidate", F.size(F.array_intersect("own", "other")).alias("common")).where("common > 0")
        best = common.groupBy("user_id", "item_id", "candidate").agg(F.sum("common").alias("common")).groupBy("user_id", "item_id").agg(F.max("common").alias("common"))
        part = mine.join(theirs.select("user_id").distinct(), "user_id", "left_semi").join(best, ["user_id", "item_id"], "left")
        part = part.select("user_id", "item_id", F.coalesce(F.try_divide("common", "n_users"), F.lit(0.0)).alias("share"))
        part = part if turn is None else materialise(part, "overlaps")
        out = part if out is None else out.unionByName(part)
    return out
