"""The corpus pipeline: documents pass quality rules, line dedup, near-duplicate removal, source mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined results: columns beside those of documents are left out, whatever they are called; an empty table gives an
empty one at every stage; a null lang or source is a group of its own. Rows are judged, kept and packed one by one, so
equal rows share their fate but for near-duplicates, of which one stays, and rows without a doc_id take part in all but
line dedup, which leaves them as they are. A text is null or without words only before the quality rules, which reject it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.llm.line_dedup import dedup_lines
from loomrec.llm.mixing import mix
from loomrec.llm.ngram_join import similar_documents
from loomrec.llm.packing import pack
from loomrec.llm.quality_rules import judge
from loomrec.llm.queries import tokenizer_path
from loomrec.scratch import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or their group's fences reject go: so do null and blank texts. Equal rows go or stay together."""
    return judge(docs, carry=tuple(COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them alone; every document stays, if with less text.

    Rows that repeat a doc_id count as one document; n_chars is that of the text that is left, and a null text becomes ''."""
    done = dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return done.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the smallest doc_id, rows without one last, then the smallest text.

    Rows are judged one by one, so an id that is repeated with another text stays where that text is not a copy; equal
    rows are copies of each other, and a row without words is a group of its own."""
    rows = materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = similar_documents(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2("text", 256), "lang", "source", "_row")
    first = rows.select("_row", order.alias("order")).join(groups, "_row").groupBy("component_id").agg(F.min("order")["_row"].alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes, up to three; ties in rank go by a hash of id and size, equal rows together."""
    mixed = mix(docs, carry=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence; a copy is a document, and an empty text is its closing token."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: The tokenizer of the last stage has no SQL form; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
