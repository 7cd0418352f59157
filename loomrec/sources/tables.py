"""Readers and writers of the library's tables. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.operators.memory import changed_items
from loomrec.operators.records import SCHEMA as RECORD
from loomrec.sources.records import records

INTERACTIONS = "user_id long, item_id long, rating double, timestamp double"
ITEMS = "item_id long, asin string, title string, description string"
REVIEWS = "user_id long, item_id long, review_text string"
INSTRUCTIONS = "user_id long, instruction string, persona string"
CALLS = "id string, timestamp string, model string, messages array<struct<role:string,content:string>>, response string, metadata struct<stage:string,usage:struct<prompt_tokens:long,input_tokens:long,completion_tokens:long,output_tokens:long>>"
VERSION = 1


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_tsv(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """A headed TSV with quoted, possibly multi-line fields, read by split; the header's own columns are taken by name."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    header = spark.read.option("sep", "\t").option("header", True).csv(path).limit(0).columns
    plain = [c.split(":")[0] for c in header]
    kinds = [f.strip().split(" ", 1) for f in schema.split(", ")]
    fields = F.from_csv("value", ", ".join(f"`{c}` string" for c in plain), {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    raw = records(spark, path).where("not first").select(fields.alias("r")).select("r.*")
    return raw.select(*[(F.col(c).try_cast(k) if c in plain else F.lit(None).cast(k)).alias(c) for c, k in kinds])


def load_all(spark: SparkSession, prefix: str) -> dict[str, DataFrame]:
    """interactions, items, reviews and instructions from <prefix>.inter, .meta, .text and .instruction."""
    reviews = read_tsv(spark, f"{prefix}.text", REVIEWS, True).withColumn("review_text", F.coalesce("review_text", F.lit("")))
    return {
        "interactions": read_tsv(spark, f"{prefix}.inter", INTERACTIONS),
        "items": read_tsv(spark, f"{prefix}.meta", ITEMS, True),
        "reviews": reviews,
        "instructions": read_tsv(spark, f"{prefix}.instruction", INSTRUCTIONS, True),
    }


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="\t", header=True, quote='"', escape='"').csv(path)


def read_ranked_lists(spark: SparkSession, path: str) -> DataFrame:
    """user_id, item_id, pos from JSON rows (user_id, ranked): a ready-made source of candidates."""
    return spark.read.schema("user_id long, ranked array<long>").json(path).select("user_id", F.posexplode("ranked").alias("pos", "item_id"))


def read_user_list(spark: SparkSession, path: str, population: DataFrame) -> DataFrame:
    """The users of a JSON list that are in the population."""
    listed = spark.read.schema("user_ids array<long>").json(path, multiLine=True).select(F.explode("user_ids").alias("user_id")).distinct()
    return listed.join(population.select("user_id").distinct(), "user_id", "left_semi")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """user_id, part from what write_splits() wrote, or from a JSON file with an object of lists."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.read.schema("user_id long, part string").json(path)
    raw = spark.read.schema("splits map<string,array<long>>").json(path, multiLine=True)
    return raw.select(F.explode("splits").alias("part", "ids")).select(F.explode("ids").alias("user_id"), "part")


def write_splits(splits: DataFrame, path: str) -> None:
    """A folder of JSON lines, a user each, which read_splits() reads; written by as many tasks as there are."""
    splits.select("user_id", "part").write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path).where("user_id is not null")


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines, compressed: prompts, contexts and snippets repeat the same texts."""
    rows.write.mode("overwrite").json(path, compression="gzip")


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """Call log with the usage fields flat, for token_usage()."""
    calls = spark.read.schema(CALLS).json(path)
    return calls.select("id", "model", "messages", "response", F.col("metadata.stage").alias("stage"), *[F.col(f"metadata.usage.{c}").alias(c) for c in ("prompt_tokens", "input_tokens", "completion_tokens", "output_tokens")])


def append_calls(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").json(path)


def save_snapshot(users: DataFrame, item_memories: DataFrame, path: str, version: int = VERSION) -> None:
    users.sortWithinPartitions("user_id").write.mode("overwrite").parquet(f"{path}/users")
    item_memories.sortWithinPartitions("item_id").write.mode("overwrite").parquet(f"{path}/items")
    users.sparkSession.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    found = spark.read.parquet(f"{path}/meta").first()["version"]
    if found != VERSION:
        raise ValueError(f"snapshot has version {found}, not {VERSION}")
    return spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items")


def save_memories(memories: DataFrame, path: str) -> None:
    memories.write.mode("overwrite").parquet(path)


def load_memories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_memories(memories: DataFrame, items: DataFrame, path: str) -> None:
    """JSON lines of all users' memories and of those item memories that say more than the title."""
    memories.where("entity_type = 'user'").select(F.col("entity_id").alias("user_id"), "memory").write.mode("overwrite").json(f"{path}/users")
    changed_items(memories, items).write.mode("overwrite").json(f"{path}/items")


#: What runs are called in summaries.
MODES = {"full": "full", "vanilla": "no memory", "no_retrieval": "no collaborative read"}


def result_row(metrics: DataFrame, mode: str, ks: tuple[int, ...] = (1, 3, 5, 10), names: tuple[str, ...] = ("hit", "ndcg", "mrr")) -> DataFrame:
    """One row of a run from metric, k, value rows: its mode's label, then a column for each k and metric in order."""
    cells = [F.max(F.when((F.col("metric") == m) & (F.col("k") == k), F.col("value"))).alias(f"{m}@{k}") for k in ks for m in names]
    return metrics.agg(F.lit(MODES.get(mode, mode)).alias("mode"), *cells)


def append_result(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_run(metrics: DataFrame, mode: str, run: str, path: str, **columns: tuple[int, ...] | tuple[str, ...]) -> None:
    """A run's results: its metrics as JSON in a folder of its own, which a repeated run replaces, and its row in the summary of all.

    The summary has a folder a run too, so a run that is repeated counts once."""
    metrics.select("metric", "k", "value").coalesce(1).write.mode("overwrite").json(f"{path}/runs/run={run}")
    result_row(metrics, mode, **columns).write.mode("overwrite").parquet(f"{path}/summary/run={run}")


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """run, metric, k, value of all runs, and the summary's rows."""
    return spark.read.schema("metric string, k int, value double, run string").json(f"{path}/runs"), spark.read.parquet(f"{path}/summary")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_report() wrote; the report's columns are read as they are, as there are few rows."""
    return spark.read.json(f"{path}/report"), spark.read.schema("user_id long, reason string").json(f"{path}/dropped")


def write_report(report: DataFrame, dropped: DataFrame, path: str) -> None:
    """A validation report of one or a few rows, and the log of dropped users with their reasons, as JSON."""
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    dropped.select("user_id", "reason").write.mode("overwrite").json(f"{path}/dropped")


def write_conversion(interactions: DataFrame, reviews: DataFrame, items: DataFrame, told: DataFrame, statistics: DataFrame, prefix: str) -> None:
    """The four TSV tables that load_all() reads, and a text file of statistics, a line for each number."""
    for df, end in ((interactions, "inter"), (reviews, "text"), (items, "meta"), (told, "instruction")):
        write_tsv(df, f"{prefix}.{end}")
    lines = F.explode(F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in statistics.columns])).alias("value")
    statistics.select(lines).coalesce(1).write.mode("overwrite").text(f"{prefix}.statistics")


def item_table(part: DataFrame) -> DataFrame:
    """Items from a part table: title is the name, description brand and type."""
    return part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("description"))


def order_interactions(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Interactions from order lines: the customer is the user, the part the item."""
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), "o_orderdate", "l_orderkey", "l_linenumber")


ORDER = ("o_orderdate", "l_orderkey", "l_linenumber")
