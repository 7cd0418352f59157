"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches, later ids first. A batch's line keys are hashed, grouped, and merge-anti-joined with the
runs: keys that no run holds are new, and the batch adds them as a run sorted and bucketed by hash, together with the
largest document that holds them; keys that a run holds already go to a tally of repeats. When a level has `fanout`
runs they are merged into one of the next level, so a batch meets few runs however many batches came before it.
Because later ids come first, the run that first holds a key names the document that keeps it.

Lines travel as (document, position, hash), without their text. What a document loses are positions, taken from the
sequence of all positions by hash, so the work is linear in a document's lines.

Defined results: null or empty text is one empty line; a document without an id takes no part and stays as it is; rows
that repeat a doc_id count as one document and each keeps its row; an empty table gives an empty result; extra columns
are carried through, but for kept_text, n_dropped and the names of SCRATCH, which are replaced or dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.mixing import few
from loomrec.scratch import materialise, table_path

BATCH_DOCS = 50_000_000
SCRATCH = ("_id", "_key", "_text", "_drops", "_lines", "_kept")
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased (plain lower() where the line is ASCII)."""
    cut = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(cut) == F.octet_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def line_hash(key: Column) -> Column:
    """128 bits, so that different keys do not meet even among 10**12 lines."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


class LineRuns:
    """Levelled runs of (h1, h2, holder, n): every key seen so far once over all runs, and a tally of later sightings."""

    def __init__(self, spark, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.tallies: list[DataFrame] = []

    def _written(self, df: DataFrame) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", table_path(self.spark, name)).saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds: one merge anti join with each run."""
        for run in self.runs():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in a batch of keys (h1, h2, holder, n), one row each; returns the run of those that were new."""
        seen = bool(self.runs())
        run = self._written(self.unseen(keys).select("h1", "h2", "holder", "n"))
        if seen:
            self.tallies.append(materialise(keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti").select("h1", "h2", "n"), "tally"))
        self.levels[0].append(run)
        at = 0
        while len(self.levels[at]) > self.fanout:
            merged = self._written(_union(self.levels[at]))
            self.levels[at] = []
            if at + 1 == len(self.levels):
                self.levels.append([])
            self.levels[at + 1].append(merged)
            at += 1
        return run

    def frequent(self, least: int) -> DataFrame:
        """(h1, h2, holder) of the keys with `least` sightings or more."""
        parts = self.runs()
        if not self.tallies:
            return _union([r.where(F.col("n") >= least).select("h1", "h2", "holder") for r in parts])
        again = materialise(_union(self.tallies).groupBy("h1", "h2").agg(F.sum("n").alias("more")), "tallies")
        found = [r.join(again.hint("merge"), ["h1", "h2"], "left").where(F.col("n") + F.coalesce("more", F.lit(0)) >= least) for r in parts]
        return _union([f.select("h1", "h2", "holder") for f in found])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int | None, fanout: int) -> DataFrame:
    """(doc_id, text_key, pos): the lines that each document loses, by position; text_key tells rows of one doc_id apart."""
    ids = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    if batches is None:  # more for a larger input, so that a batch stays of a size that one sort can take
        batches = 4 + int(ids.count() // BATCH_DOCS)
    cuts = ids.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    batch = F.lit(0)
    for k, cut in enumerate(cuts):
        batch = F.when(F.col("doc_id") > cut, k + 1).otherwise(batch)
    # Keys are taken of whole texts before their lines become rows.
    each = ids.select("doc_id", text_key(F.col("text")).alias("text_key"), batch.alias("batch"), F.split("text", "\n").alias("lines"))
    each = each.select("doc_id", "text_key", "batch", F.posexplode("lines").alias("pos", "line"))
    keyed = each.select("doc_id", "text_key", "batch", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    lines = materialise(keyed.select("doc_id", "text_key", "batch", "pos", line_hash(F.col("key")).alias("k")).select("doc_id", "text_key", "batch", "pos", "k.h1", "k.h2"), "lines")
    store = LineRuns(docs.sparkSession, fanout)
    for b in range(len(cuts), -1, -1):
        held = lines.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.max("doc_id").alias("holder"), F.count("*").alias("n"))
        store.add(materialise(held, "batch_keys"))
    # Lines that a document repeats, and rows that repeat a doc_id, were counted as often; over the few lines left, documents are counted exactly.
    frequent = materialise(store.frequent(min_docs), "frequent")
    found = materialise(lines.join(few(frequent, 100_000), ["h1", "h2"]).select("doc_id", "text_key", "pos", "h1", "h2", "holder"), "found")
    enough = found.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    return found.where("doc_id < holder").join(few(materialise(enough, "enough"), 100_000), ["h1", "h2"]).select("doc_id", "text_key", "pos")


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 2) -> DataFrame:
    """docs with two more columns: kept_text, the lines that stay joined by \\n, and n_dropped.

    A line key of at least min_chars characters found in at least min_docs documents stays in the largest doc_id alone."""
    docs = docs.drop("kept_text", "n_dropped", *SCRATCH)
    drops = repeated_lines(docs, min_chars, min_docs, batches, fanout)
    drops = drops.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("pos").alias("_drops"))
    # The lines are a column of the joined rows, so that they are split once and not once a position.
    out = docs.withColumns({"_text": text_key(F.col("text")), "_lines": F.split(F.coalesce("text", F.lit("")), "\n")})
    out = out.join(drops, (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drops")
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    out = out.withColumn("kept_text", F.when(F.col("_drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
    return out.withColumn("n_dropped", F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")).cast("long")).drop(*SCRATCH)
