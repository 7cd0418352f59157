"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words: the total shared by weight, no source above `limit` times its own size, the
excess shared out again by weight. With ratio = target/size, every document first gets floor(ratio) whole copies for
certain. The rest of the target is a sample without replacement: document i has inclusion probability
p_i = min(1, c * w_i), where w_i grows with the logarithm of its size and c makes the expected words meet the rest;
documents are ranked by [u/(1-u)] / [p/(1-p)] with u a hash of the id, and the first ones are taken while they fit; the
one document that comes nearest to what is then missing takes the last place.

u depends on nothing but seed, doc_id and size, so reruns agree. A source is never sorted
as a whole: ranks are first counted in `cells` cells, and only the one cell in which the rest runs out is put in order.

Defined results: null or empty text has size 0 and is never sampled; a null source is a source of its own, last in
order; equal rows are taken together or not at all; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.text import WORD
from loomrec.scratch import materialise

#: A source's row among this many may be broadcast; more sources are joined by a shuffle.
FEW = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, marked for broadcasting if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def targets(sources: DataFrame, weights: tuple[float, ...], limit: float) -> DataFrame:
    """(sid, source, source_size, target): water-filling by weight under a ceiling of limit * source_size.

    One row per source passes through a single task here, never documents."""
    everything = Window.partitionBy(F.lit(1))
    pick = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("sid", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")))
    s = s.withColumn("weight", F.get(pick, (F.col("sid") - 1) % len(weights))).withColumn("ceiling", limit * F.col("source_size"))
    # Sources reach their ceiling in order of ceiling / weight; level is a unit weight's share once all before did.
    filling = everything.orderBy(F.col("ceiling") / F.col("weight"), "sid")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0.0)
    s = s.withColumn("at", F.row_number().over(filling))
    s = s.withColumn("free", F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), nothing))
    s = s.withColumn("level", F.col("free") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), nothing)))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct("at", "level"))
    s = s.withColumn("final", F.min(fits).over(everything)["level"])
    return s.select("sid", "source", "source_size", F.coalesce(F.least("ceiling", F.col("final") * F.col("weight")), "ceiling").cast("double").alias("target"))


def inclusion(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """shares with rate: c in p = min(1, c * weight), so that the expected words of the sample are `rest`.

    Weights are whole numbers below 64, so a source has fewer than 64 rows here however many documents it has."""
    bins = sized.where("size > 0").groupBy("source", "odds").agg(F.sum("size").alias("words"))
    bins = bins.join(few(shares.select(F.col("source").alias("_s"), "sid", "rest")), F.col("source").eqNullSafe(F.col("_s")))
    heavy = Window.partitionBy("sid").orderBy(F.desc("odds"))
    before = F.coalesce(F.sum("words").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("words") * F.col("odds")).over(heavy.rowsBetween(0, Window.unboundedFollowing))
    bins = bins.withColumn("c", (F.col("rest") - before) / onward)
    rates = bins.where("c * odds <= 1").groupBy("sid").agg(F.max_by("c", "odds").alias("rate"))
    return shares.join(rates, "sid", "left")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), limit: float = 3.0, seed: str = "mix", cells: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): copies from 0 to limit for every row of docs.

    Columns named in carry follow. They are written once beside the sizes, and no shuffle moves them: the rows meet only
    tables of a row a source."""
    carried = [F.struct(*carry).alias("carried")] if carry else []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carried)
    word = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    u = (F.conv(F.substring(word, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    sized = materialise(sized.withColumn("u", u).withColumn("odds", F.length(F.bin("size"))), "sizes")
    shares = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    ratio = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    shares = shares.withColumn("whole", F.floor(ratio + 1e-12)).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    shares = materialise(inclusion(sized, materialise(shares, "shares")), "rates")

    p = F.least(F.lit(1.0), F.coalesce("rate", F.lit(1.0)) * F.col("odds"))
    rank = F.when(p >= 1, F.lit(0.0)).otherwise(F.col("u") * (1 - p) / (F.col("u") * (1 - p) + (1 - F.col("u")) * p))
    ranked = sized.join(few(shares.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ranked = ranked.withColumn("q", F.when((F.col("size") > 0) & (F.col("rest") > 0) & (p > 0), rank)).withColumn("cell", F.floor(F.col("q") * cells))
    drawn = ranked.where("q is not null").drop("carried")

    by_cell = drawn.groupBy("sid", "rest", "cell").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    by_cell = by_cell.withColumn("upto", F.sum("words").over(upto))
    cuts = by_cell.where("upto > rest").groupBy("sid").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("cut"))
    cuts = materialise(cuts.select("sid", F.col("cut.cell").alias("cut"), "cut.before"), "cuts")

    last = drawn.join(few(cuts), "sid").where("cell = cut")
    peers = Window.partitionBy("sid").orderBy("q").rangeBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.col("before") + F.sum("size").over(peers)).where("upto <= rest")
    last = cuts.join(last.groupBy("sid").agg(F.max("q").alias("to_q"), F.max("upto").alias("upto")), "sid", "left")
    last = materialise(last.withColumn("upto", F.coalesce("upto", "before")).withColumn("to_q", F.coalesce("to_q", F.lit(-1.0))), "last")

    over = drawn.join(few(last), "sid").where("not (cell < cut or q <= to_q)")
    miss, gap = F.abs(F.col("rest") - F.col("upto") - F.col("size")), F.col("rest") - F.col("upto")
    best = over.where(miss < gap).groupBy("sid").agg(F.min(F.struct(miss.alias("miss"), "q", "size")).alias("best"))
    last = materialise(last.join(best, "sid", "left").select("sid", "cut", "to_q", F.col("best.q").alias("best_q"), F.col("best.size").alias("best_size")), "ends")

    out = ranked.join(few(last), "sid", "left")
    taken = F.col("q").isNotNull() & (F.col("cut").isNull() | (F.col("cell") < F.col("cut")) | (F.col("q") <= F.col("to_q")) | F.coalesce((F.col("q") == F.col("best_q")) & (F.col("size") == F.col("best_size")), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(taken, 1).otherwise(0)).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), *[F.col("carried")[c].alias(c) for c in carry])
