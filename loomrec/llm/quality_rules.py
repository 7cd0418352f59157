"""Quality rules with thresholds that adapt to each language and source.

Every document gets a few counts. Ratios of these counts go into quantile sketches with logarithmic buckets (relative
error `gamma` - 1), one for each (language, source, measure). A sketch is a table of bucket counts: two sketches merge by
adding counts, so sketches of sources add up to those of languages and of the whole, and a hot source is summed up
before it is shuffled. A group's sketch is merged with `prior` more documents at evenly spaced quantiles of its
language's, and that one likewise with all documents', so that a small group follows its language and a large one itself.
Fences lie a few quartile distances outside the quartiles and are joined to the documents. Word lengths are measured by the ratio of the quartiles, so that a low fence
stays positive.

No cutoff is fixed: a document fails where it lies outside its group's fence and further from what is usual in the
group than counting alone explains. Usual is the upper quartile of the group's sketch or its mean, whichever is more: of
signs and repeated lines most documents have none, so the quartile is 0 and the mean says how many a text of some length
may have. A count s out of n is judged against the usual rate q on the scale of square roots, where a count's standard
deviation is 1/2 however large it is: sqrt(s) may exceed sqrt(n * q) by `reach` of these (each count with 3/8 added), so
what is allowed grows with a text's length. Repeated lines are counted per word, as lines are long or short. For a mean
word length a word's length is taken to deviate by about half the mean.

Defined results: null or blank text has no words and fails the base rule; null language or source is a group of its
own; equal rows are judged alike; an empty table gives an empty result; extra columns are ignored unless `carry` names
them.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.mixing import few
from loomrec.llm.text import SPACES, gram_codes, slices, words
from loomrec.scratch import materialise

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stutters")
#: Measure: (count, out of, quartile distances in one reach). Only high values of these are bad.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1),
    "dup_lines": ("n_dup_lines", "n_words", 1),
    "upper": ("n_upper", "word_chars", 3),
    "stutters": ("n_stutters", "n_words", 3),
}
#: Characters a word: too low or too high, by ratios.
LENGTH, LENGTH_TIMES, LENGTH_DEVIATION = "word_length", 3, 0.5


def counts(text: str | None) -> tuple[int, ...]:
    """The numbers named in COUNTS, over the whole text."""
    if not text:
        return (0,) * len(COUNTS)
    w = words(text)
    n = len(w)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    covered = 0
    if n >= 5:
        grams = gram_codes(w, 5)
        _, where, times = np.unique(grams, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[where] > 1)
        if len(twice):
            ends = np.zeros(n + 1, np.int32)
            np.add.at(ends, twice, 1)
            np.add.at(ends, twice + 5, -1)
            covered = int((np.cumsum(ends[:n]) > 0).sum())
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    if not text.isascii():
        upper += sum(c.isupper() for c in text if c > "\x7f")
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), covered, len(lines), upper, sum(map(eq, w, w[1:]))


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and the counts of every row."""
    kinds = dict(docs.dtypes)
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), *(f"{c} long" for c in COUNTS)])
    rows = docs.select(*carry, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = np.asarray([counts(t) for t in b.column(b.num_columns - 1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=[*carry, *COUNTS])

    return rows.mapInArrow(run, ddl)


def sketch(measured: DataFrame, gamma: float) -> DataFrame:
    """(lang, source, measure, bucket, n): how many documents of each group have a measure in a bucket."""
    ratios = {m: F.try_divide(s, n) for m, (s, n, _) in MEASURES.items()} | {LENGTH: F.try_divide("word_chars", "n_words")}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in ratios.items()])).alias("m")
    values = measured.where("n_words > 0").select(F.struct("lang", "source").alias("g"), pairs).select("g.lang", "g.source", "m.*").where("value is not null")
    bucket = F.when(F.col("value") < 1e-6, F.lit(-100000)).otherwise(F.ceil(F.log("value") / F.log(F.lit(gamma)))).cast("int")
    return values.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, *groups: str) -> DataFrame:
    """The sketches of larger groups."""
    return sketches.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def spaced(sketches: DataFrame, prior: int, *groups: str) -> DataFrame:
    """Sketches of `prior` documents each, at evenly spaced quantiles of the given ones."""
    group = Window.partitionBy(*groups, "measure")
    s = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("docs", F.sum("n").over(group))
    k = F.expr(f"(2 * upto * {prior} + docs) div (2 * docs) - (2 * (upto - n) * {prior} + docs) div (2 * docs)")
    return s.select(*groups, "measure", "bucket", k.alias("n")).where("n > 0")


def blended(sketches: DataFrame, prior: int) -> DataFrame:
    """Each group's sketch with `prior` documents of its language's, which has as many of all documents'."""
    every, lang = spaced(merged(sketches), prior), merged(sketches, "lang")
    lang = lang.unionByName(lang.select("lang", "measure").distinct().join(every, "measure"))
    lang = spaced(merged(lang, "lang"), prior, "lang").withColumnRenamed("lang", "_lang").withColumnRenamed("measure", "_measure")
    own = sketches.select("lang", "source", "measure").distinct()
    more = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure")))
    return merged(sketches.unionByName(more.drop("_lang", "_measure")), "lang", "source")


def quartiles(sketches: DataFrame, gamma: float) -> DataFrame:
    """(lang, source, measure, docs, mean, q25, q75) as the sketches give them."""
    group = Window.partitionBy("lang", "source", "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    s = sketches.withColumn("upto", upto).withColumn("docs", F.sum("n").over(group))
    value = F.when(F.col("bucket") == -100000, F.lit(0.0)).otherwise(F.pow(F.lit(gamma), F.col("bucket") - 0.5))
    quart = [F.min(F.when(F.col("upto") >= q * F.col("docs"), F.struct("bucket", value.alias("v"))))["v"].alias(f"q{int(100 * q)}") for q in (0.25, 0.75)]
    mean = F.sum(F.col("n") * value) / F.sum("n")
    return s.groupBy("lang", "source", "measure").agg(F.max("docs").alias("docs"), mean.alias("mean"), *quart)


def fences(found: DataFrame, reach: float) -> DataFrame:
    """(_lang, _source, and each measure's usual rate and fence) for every group."""
    s = found.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "measure", "mean", "q25", "q75")
    times = F.create_map(*[F.lit(x) for m, (*_, k) in MEASURES.items() for x in (m, float(k))])[F.col("measure")]
    ends = [F.max(F.when(F.col("measure") == m, c)).alias(f"_{name}_{m}") for m in MEASURES for name, c in (("usual", F.greatest("q75", "mean")), ("high", F.col("q75") + reach * times * (F.col("q75") - F.col("q25"))))]
    ends += [F.max(F.when(F.col("measure") == LENGTH, c)).alias(f"_{name}_{LENGTH}") for name, c in (("low", F.col("q25")), ("high", F.col("q75")), ("factor", F.pow(F.col("q75") / F.col("q25"), F.lit(reach * LENGTH_TIMES))))]
    return s.groupBy("_lang", "_source").agg(*ends)


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), gamma: float = 1.02, reach: float = 3.0, prior: int = 20) -> DataFrame:
    """The carried columns, the counts, base_failed and kept for every row of docs."""
    keep = list(dict.fromkeys([*carry, "lang", "source"]))
    measured = materialise(measure(docs, keep), "counts")
    sketches = materialise(sketch(measured, gamma), "sketch")
    rules = materialise(fences(quartiles(blended(sketches, prior), gamma), reach), "rules")
    judged = measured.join(few(rules), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    factor = F.greatest(F.col(f"_factor_{LENGTH}"), 1 + reach * LENGTH_DEVIATION / F.sqrt("n_words"))
    length = F.try_divide("word_chars", "n_words")
    fine = (length >= F.col(f"_low_{LENGTH}") / factor) & (length <= F.col(f"_high_{LENGTH}") * factor)
    for m, (count, out_of, _) in MEASURES.items():
        chance = F.pow(F.sqrt(F.col(out_of) * F.col(f"_usual_{m}") + 0.375) + reach / 2, F.lit(2.0)) - 0.375
        fine = fine & (F.col(count) <= F.greatest(F.col(out_of) * F.col(f"_high_{m}"), chance))
    judged = judged.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    judged = judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(fine, F.lit(True))))
    return judged.drop(*rules.columns)
