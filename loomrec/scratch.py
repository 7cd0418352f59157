"""Written intermediates in the folder that the whole cluster shares.

Long lineages are cut by writing a Parquet table there and reading it back, so a lost executor never forces the
work before the cut to be done again and nothing depends on one machine's disk.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a folder of our own only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = getattr(spark, "_loomrec_scratch", None)
        if not found:
            found = spark._loomrec_scratch = "file://" + tempfile.mkdtemp(prefix="spark-loomrec-")
    return f"{found.rstrip('/')}/loomrec-{spark.sparkContext.applicationId}"


def table_path(spark: SparkSession, name: str) -> str:
    """Where a table of the catalog that this application makes for itself may lie; clear() drops it."""
    if not hasattr(spark, "_loomrec_tables"):
        spark._loomrec_tables = []
    spark._loomrec_tables.append(name)
    return f"{shared_dir(spark)}/{name}"


def clear(spark: SparkSession) -> None:
    """Drop the tables and delete the files that this application has written to the shared folder, once no result of it
    is read any more: results read these files until they are saved elsewhere."""
    for name in getattr(spark, "_loomrec_tables", []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark._loomrec_tables = []
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark deletes what a command has shuffled as soon as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and return the table that reads it; what was shuffled for it is deleted.
    Settings hold for the session while it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    settings = {CLEANUP: "true"} | (settings or {})
    before = {k: spark.conf.get(k, "false") if k == CLEANUP else spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomrec_path = path
    return out


def written(df: DataFrame) -> bool:
    """Whether df is a table that materialise() has returned."""
    return getattr(df, "_loomrec_path", None) is not None


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more, before clear() does."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._loomrec_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
