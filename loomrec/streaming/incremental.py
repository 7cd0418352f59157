"""Incremental upkeep: memory patches and graph counts from streams, in tables that a batch changes in part.

Two kinds of keyed tables are kept, both with a manifest for each micro-batch, written last. A reader takes the newest
manifest, so it never sees half a batch; a batch that runs again finds the manifest of the batch before it and writes
the same folders once more.

`BucketedState` holds one row per key in hash buckets and rewrites only the buckets that a batch touches. `ChangeRuns`
appends what a batch changed and merges runs level by level, so rows written follow the batches and not the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomrec.operators.memory import compacted

ENTITY = ("entity_type", "entity_id")
NODE = ("kind", "id")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The batches whose manifests are complete."""
    fs, folder = _fs(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName()[6:]) for p in found if fs.exists(path_of(p, "_SUCCESS")))


def _newest(spark: SparkSession, path: str, before: int | None = None) -> list:
    """Rows of the newest manifest, of those before a batch if one is named."""
    found = [b for b in _manifests(spark, path) if before is None or b < before]
    return spark.read.parquet(f"{path}/manifest/batch={found[-1]}").collect() if found else []


def _commit(spark: SparkSession, path: str, batch_id: int, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")


class BucketedState:
    """One row per key in `buckets` hash buckets; a manifest says which batch wrote each bucket last.

    The number of buckets is fixed by the first batch; choose it so that a bucket fits a task."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The rows as of the newest batch (before a given one), of some buckets or all; None if there is nothing."""
        held = [r for r in _newest(self.spark, self.path, before) if only is None or r["bucket"] in only]
        return self.spark.read.parquet(*(f"{self.path}/version={r['version']}/bucket={r['bucket']}" for r in held)) if held else None

    def merge(self, batch_id: int, rows: DataFrame, combine: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put rows (one per key) into the state: combine() makes one row per key of old and new ones. Returns the buckets it rewrote."""
        touched = sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most `buckets`
        if touched:
            old = self.read(batch_id, touched)
            both = rows if old is None else old.unionByName(rows)
            out = combine(both).withColumn("bucket", self.bucket())
            out.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={batch_id}")
        held = {r["bucket"]: r["version"] for r in _newest(self.spark, self.path, batch_id)} | {b: batch_id for b in touched}
        _commit(self.spark, self.path, batch_id, sorted(held.items()), "bucket int, version long")
        return touched

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions of buckets and manifests that none of the newest `keep` batches needs."""
        batches = _manifests(self.spark, self.path)
        live = {(r["bucket"], r["version"]) for b in batches[-keep:] for r in self.spark.read.parquet(f"{self.path}/manifest/batch={b}").collect()}
        fs, folder = _fs(self.spark, self.path)
        for version in fs.listStatus(folder):
            name = version.getPath().getName()
            if name.startswith("version=") and int(name[8:]) <= batches[-1]:
                for b in fs.listStatus(version.getPath()):
                    bucket = b.getPath().getName()
                    if bucket.startswith("bucket=") and (int(bucket[7:]), int(name[8:])) not in live:
                        fs.delete(b.getPath(), True)
        for b in batches[:-keep]:
            fs.delete(_fs(self.spark, f"{self.path}/manifest/batch={b}")[1], True)


class ChangeRuns:
    """The newest row of each key, in runs: a batch appends one, and `fanout` runs of a level are merged into one of the next."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], fanout: int = 8):
        self.spark, self.path, self.keys, self.fanout = spark, path, keys, fanout

    def _latest(self, runs: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*runs)
        rest = [c for c in rows.columns if c not in (*self.keys, "_batch")]
        newest = F.max_by(F.struct(*rest), "_batch").alias("row")
        return rows.groupBy(*self.keys).agg(newest, F.max("_batch").alias("_batch")).select(*self.keys, *[f"row.{c}" for c in rest], "_batch")

    def append(self, batch_id: int, rows: DataFrame) -> None:
        """rows: the new values of the keys that changed, one row each."""
        rows.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/level=0/run={batch_id}")
        held = [(r["level"], r["run"]) for r in _newest(self.spark, self.path, batch_id)] + [(0, batch_id)]
        level = 0
        while sum(x == level for x, _ in held) > self.fanout:
            merged = [f"{self.path}/level={x}/run={r}" for x, r in held if x == level]
            self._latest(merged).write.mode("overwrite").parquet(f"{self.path}/level={level + 1}/run={batch_id}")
            held = [h for h in held if h[0] != level] + [(level + 1, batch_id)]
            level += 1
        _commit(self.spark, self.path, batch_id, held, "level int, run long")

    def read(self) -> DataFrame:
        held = _newest(self.spark, self.path)
        return self._latest([f"{self.path}/level={r['level']}/run={r['run']}" for r in held]).drop("_batch")


def merged_memories(rows: DataFrame) -> DataFrame:
    """One row per entity of several: the last memory, and all updates."""
    return rows.groupBy(*ENTITY).agg(F.max_by("memory", F.struct("seq", "memory")).alias("memory"), F.max("seq").alias("seq"), F.sum("n_updates").alias("n_updates"))


def upsert_patches(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64, available_now: bool = True) -> StreamingQuery:
    """Keep the last memory of each entity from a stream of patches (entity_type, entity_id, memory, seq).

    A batch reads and rewrites the buckets of the entities that it patches. A patch that arrives again, in whatever
    batch, counts once: its hash is in the bucket's own list of patches, to which batches append."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = BucketedState(spark, path, ENTITY, buckets)
        new = batch.select("entity_type", "entity_id", "memory", "seq").where("length(trim(memory)) > 0").distinct()
        new = new.withColumns({"bucket": state.bucket(), "h": F.xxhash64("entity_type", "entity_id", "memory", "seq")})
        new.cache()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
            earlier = [b for b in _manifests(spark, path) if b < batch_id]
            fresh = new
            if earlier and touched:
                kinds = ", ".join(f"{c} {t}" for c, t in new.dtypes if c in (*ENTITY, "h"))
                seen = spark.read.schema(f"{kinds}, batch long, bucket int").option("basePath", f"{path}/seen").parquet(f"{path}/seen").where(F.col("bucket").isin(touched) & (F.col("batch") < batch_id))
                fresh = new.join(seen.select(*ENTITY, "h"), [*ENTITY, "h"], "left_anti")
            fresh.repartition(max(len(touched), 1), "bucket").select(*ENTITY, "h", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/seen/batch={batch_id}")
            # What is already merged must not change what is fresh while the state is written.
            fresh = new.join(spark.read.parquet(f"{path}/seen/batch={batch_id}").select(*ENTITY, "h"), [*ENTITY, "h"], "left_semi") if touched else new
            state.merge(batch_id, compacted(fresh.drop("bucket", "h")), merged_memories)
        finally:
            new.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def memories(spark: SparkSession, path: str) -> DataFrame:
    """entity_type, entity_id, memory, seq, n_updates as of the newest batch."""
    found = BucketedState(spark, path, ENTITY).read()
    return spark.createDataFrame([], "entity_type string, entity_id long, memory string, seq long, n_updates long") if found is None else found


def running_degrees(stream: DataFrame) -> DataFrame:
    """kind, id, degree from a stream of (user_id, item_id): for output mode update or complete."""
    ends = F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("id")), F.struct(F.lit("item").alias("kind"), F.col("item_id").alias("id")))
    return stream.select(F.explode(ends).alias("e")).groupBy("e.kind", "e.id").agg(F.count("*").alias("degree"))


def upsert_degrees(stream: DataFrame, path: str, checkpoint: str, fanout: int = 8, available_now: bool = True) -> StreamingQuery:
    """Keep the degrees of a stream of (user_id, item_id): the running counts stay in Spark's state, and a batch writes those that it changed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ChangeRuns(batch.sparkSession, path, NODE, fanout).append(batch_id, batch.select(*NODE, "degree"))

    writer = running_degrees(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_degrees(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, degree as of the newest batch."""
    return ChangeRuns(spark, path, NODE).read()
