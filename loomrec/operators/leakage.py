"""Screens for leaked answers, and audits of written data."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomrec.functions.columns import normalised
from loomrec.scratch import materialise

TITLE_FLOOR = 25
#: Hashes of 12 bytes each that may go to every task.
MOST_PASSAGES = 1_000_000
DIGESTS = "path string, sha256 string, n_lines long, n_bytes long"
#: Names of files that Spark's text source would unpack.
PACKED = "gz,bz2,deflate,snappy,lz4,zst,passthrough"
#: Spark's file sources neither split files nor put two into a task.
UNSPLIT = {"spark.sql.files.maxPartitionBytes": str(1 << 50), "spark.sql.files.openCostInBytes": str(1 << 50)}
BOM = b"\xef\xbb\xbf"


def leak_reason(records: DataFrame) -> DataFrame:
    """records (user_id, prompt, gold_item_id, candidates, gold_title) with reason: the first of gold id, candidate id
    and gold title in the prompt, null where nothing leaks. Ids are read as whole numbers, so 2125 is not in 21254."""
    ids = F.transform(F.regexp_extract_all("prompt", F.lit(r"Item-(\d+)"), 1), lambda x: x.try_cast("long"))
    rows = records.withColumn("_ids", ids).withColumn("_title", normalised(F.col("gold_title")))
    inside = (F.length("_title") >= TITLE_FLOOR) & F.contains(normalised(F.col("prompt")), F.col("_title"))
    reason = F.when(F.array_contains("_ids", F.col("gold_item_id")), "gold id").when(F.arrays_overlap("_ids", "candidates"), "candidate id").when(inside, "gold title")
    return rows.withColumn("reason", reason).drop("_ids", "_title")


def screened(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept and dropped records."""
    rows = leak_reason(records)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def instruction_leaks(records: DataFrame, prefix: int = 120) -> DataFrame:
    ask = F.substring(normalised(F.col("instruction")), 1, prefix)
    return records.where((F.length(ask) > 0) & F.contains(normalised(F.col("prompt")), ask)).select("user_id")


def contained_passages(texts: DataFrame, passages: DataFrame, width: int = 8) -> DataFrame:
    """texts (doc_id, text), passages (item_id, text) -> doc_id, item_id: passages found within texts once normalised.

    A passage's first and last word may lie within longer words of a text, so texts and passages meet on the hash of
    the words between, at most `width` of them; the whole passage is then looked for. Passages of one or two words,
    which have no words between, are found where their words are whole.

    Hashes of passages are counted first. Up to MOST_PASSAGES go to every task, so that windows are looked up where they
    are made and only hits are shuffled; more are joined by a shuffle."""
    p = passages.select("item_id", normalised(F.col("text")).alias("passage")).where("passage <> ''").withColumn("w", F.split("passage", " "))
    inner = F.when(F.size("w") > 2, F.slice("w", 2, F.least(F.size("w") - 2, F.lit(width)))).otherwise(F.col("w"))
    p = materialise(p.select("item_id", "passage", F.size(inner).alias("n"), F.xxhash64(_hashes(inner)).alias("h")), "passages")
    known = p.select("n", "h").distinct()
    known = F.broadcast(known) if known.limit(MOST_PASSAGES + 1).count() <= MOST_PASSAGES else known
    widths = sorted(r[0] for r in p.select("n").distinct().collect())  # at most `width` numbers
    bodies = texts.select("doc_id", normalised(F.col("text")).alias("body")).where("body <> ''").withColumn("w", _hashes(F.split("body", " ")))
    windows = None
    for k in widths:
        one = bodies.where(F.size("w") >= k).select("doc_id", F.explode(_windows(k)).alias("h")).join(known.where(F.col("n") == k), "h", "left_semi")
        one = one.select("doc_id", F.lit(k).alias("n"), "h")
        windows = one if windows is None else windows.unionByName(one)
    if windows is None:
        return texts.select("doc_id").join(passages.select("item_id"), F.lit(False)).limit(0)
    hits = windows.distinct().join(p, ["n", "h"]).select("doc_id", "item_id", "passage").distinct()
    return hits.join(bodies.select("doc_id", "body"), "doc_id").where(F.contains("body", F.col("passage"))).select("doc_id", "item_id").distinct()


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(k: int) -> Column:
    """Hashes of all windows of k words, from an array column w of the words' hashes."""
    return F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.slice("w", i, k)))


def record_faults(records: DataFrame) -> DataFrame:
    """user_id, fault rows: gold not among candidates, repeated candidates, empty prompt, no snippets."""
    faults = F.array(
        F.when(~F.coalesce(F.array_contains("candidates", F.col("gold_item_id")), F.lit(False)), F.lit("gold not in candidates")),
        F.when(F.size("candidates") > F.size(F.array_distinct("candidates")), F.lit("repeated candidates")),
        F.when(F.coalesce(F.length(F.trim("prompt")), F.lit(0)) == 0, F.lit("empty prompt")),
        F.when(F.coalesce(F.size("neighbor_snippets"), F.lit(0)) == 0, F.lit("no snippets")),
    )
    return records.select("user_id", F.explode(F.array_compact(faults)).alias("fault"))


def file_name(spark: SparkSession, path: Column, root: str | None = None) -> Column:
    """The last part of a path that Spark's file source gives; below a root, the whole path from there."""
    if root is None:
        return F.element_at(F.split(path, "/"), -1)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    return F.substring(path, F.lit(len(whole) + 2), F.length(path))


def file_digests(spark: SparkSession, folder: str, chunk: int = 1 << 20, root: str | None = None) -> DataFrame:
    """name, sha256, n_lines, n_bytes of the files of a folder or pattern, each read in chunks and never held whole.
    Names are those of file_name(): where files of several folders may share a name, give their root.

    Only paths are listed by Spark's file source, which leaves out empty files (they are added) and deals the others by size; a task
    opens its files as streams. Stores that tasks can open through Spark alone are read by source_digests(). A last line without an
    end counts."""
    if not _opens(folder):
        return source_digests(spark, folder, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(_uri(path))
                digest, lines, size, last = hashlib.sha256(), 0, 0, b"\n"
                with system.open_input_stream(at) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                        lines, size, last = lines + part.count(b"\n"), size + len(part), part[-1:]
                yield _digest(path, digest.hexdigest(), lines + (last != b"\n"), size)

    listed = spark.read.format("binaryFile").load(folder).select("path")
    return _named(spark, listed.mapInArrow(run, DIGESTS).unionByName(_empty_files(spark, folder)), root)


def source_digests(spark: SparkSession, folder: str, root: str | None = None, whole: int = 1 << 24) -> DataFrame:
    """What file_digests() gives, read by Spark's file sources alone: files of up to whole bytes in a row each, larger ones in one
    task each as the lines of Spark's text source, whose bytes it does not change; they are read at once and their digests written.

    A line may have 2 GB, and so may a file that the text source would unpack (PACKED), which is held in a row whatever its size."""
    files = spark.read.format("binaryFile").load(folder)
    whole = min(whole, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    packed = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{PACKED}}}").load(folder)
    held = files.where(F.col("length") <= whole).unionByName(packed.where(F.col("length") > whole))
    ends = F.length("content") - F.length(F.translate(F.decode("content", "ISO-8859-1"), "\n", ""))
    open_end = (F.col("length") > 0) & (F.right(F.decode("content", "ISO-8859-1"), F.lit(1)) != "\n")
    out = held.select("path", F.sha2("content", 256).alias("sha256"), (ends + F.when(open_end, 1).otherwise(0)).cast("long").alias("n_lines"), F.col("length").alias("n_bytes"))
    out = out.unionByName(_empty_files(spark, folder))

    if not files.where(F.col("length") > whole).select("path").isEmpty():
        about = lambda c: F.col(f"_metadata.{c}")
        unsplit = (about("file_block_start") == 0) & (about("file_block_length") == about("file_size"))
        large = spark.read.text(folder, lineSep="\n").where((about("file_size") > whole) & ~about("file_name").rlike(rf"\.({PACKED.replace(',', '|')})$"))
        lines = large.select(about("file_path").alias("path"), F.when(unsplit, about("file_size")).alias("size"), F.col("value").cast("binary").alias("line"))
        out = out.unionByName(materialise(lines.mapInArrow(_hashed_lines, DIGESTS), "digests", UNSPLIT))
    return _named(spark, out, root)


def _hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of files that come as their lines in order, one file after the other."""
    file = None
    for b in batches:
        runs, first = pc.run_end_encode(b.column(0)), 0
        for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if file is None or file.path != path:
                if file is not None:
                    yield file.digest()
                file = _Lines(path, b.column(1)[first].as_py())
            file.add(b.column(2)[first:end].to_pylist())
            first = end
    if file is not None:
        yield file.digest()


class _Lines:
    """A file's bytes out of its lines. Only its size tells whether the last line has an end, and whether Spark has dropped a
    byte order mark before the first."""

    def __init__(self, path: str, size: int | None):
        if size is None:
            raise ValueError(f"{path} was split")
        self.path, self.size, self.n, self.got = path, size, 0, 0
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(BOM)

    def add(self, lines: list[bytes]) -> None:
        if self.n:
            self._update(b"\n")
        self._update(b"\n".join(lines))
        self.n += len(lines)

    def _update(self, part: bytes) -> None:
        self.plain.update(part)
        self.marked.update(part)
        self.got += len(part)

    def digest(self) -> pa.RecordBatch:
        mark, end = divmod(self.size - self.got, len(BOM))
        if mark not in (0, 1) or end not in (0, 1):
            raise ValueError(f"{self.path}: {self.got} of {self.size} bytes came as lines")
        self._update(b"\n" * end)
        return _digest(unquote(self.path), (self.marked if mark else self.plain).hexdigest(), self.n, self.size)


def _digest(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["path", "sha256", "n_lines", "n_bytes"])


def _named(spark: SparkSession, digests: DataFrame, root: str | None) -> DataFrame:
    return digests.select(file_name(spark, F.col("path"), root).alias("name"), "sha256", "n_lines", "n_bytes")


def _empty_files(spark: SparkSession, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x for s in system.globStatus(path) or [] for x in (system.listStatus(s.getPath()) if s.isDirectory() else [s])]
    nothing = hashlib.sha256(b"").hexdigest()
    return spark.createDataFrame([(x.getPath().toString(), nothing, 0, 0) for x in found if x.isFile() and not x.getLen() and x.getPath().getName()[0] not in "._"], DIGESTS)


def _uri(path: str) -> str:
    """file:/a as file:///a, and paths without a scheme as those of local files."""
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def _opens(folder: str) -> bool:
    try:
        fs.FileSystem.from_uri(_uri(folder))
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def file_audit(spark: SparkSession, folder: str, manifest: DataFrame, root: str | None = None) -> DataFrame:
    """manifest (name, lines, sha256, required) with present, lines_match, sha_match and ok for the files of a folder."""
    files = file_digests(spark, folder, root=root).select("name", F.col("sha256").alias("_sha"), F.col("n_lines").alias("_lines"))
    out = manifest.join(files, "name", "left")
    out = out.select(*manifest.columns, F.col("_sha").isNotNull().alias("present"), F.coalesce(F.coalesce("_lines", F.lit(0)) == F.col("lines"), F.lit(True)).alias("lines_match"), F.coalesce(F.col("_sha") == F.col("sha256"), F.lit(True)).alias("sha_match"))
    return out.withColumn("ok", F.when(F.col("present"), F.col("lines_match") & F.col("sha_match")).otherwise(~F.col("required")))


def reference_faults(scores: DataFrame, means: DataFrame, arms: tuple[str, ...] = ("sample1", "sample2", "shuffled", "lorem", "empty")) -> DataFrame:
    """fault rows of an arm reference: arms missing or unknown, users without all arms, sample1 not above empty."""
    found = scores.groupBy("user_id").agg(F.sort_array(F.collect_set("arm")).alias("arms"))
    want = F.array(*[F.lit(a) for a in sorted(arms)])
    odd = found.where(F.col("arms") != want).select(F.concat(F.lit("arms of user "), F.col("user_id").cast("string")).alias("fault"))
    low = means.agg(F.max(F.when(F.col("arm") == "sample1", F.col("ndcg_at_5"))).alias("s"), F.max(F.when(F.col("arm") == "empty", F.col("ndcg_at_5"))).alias("e")).where("not coalesce(s > e, false)")
    return odd.unionByName(low.select(F.lit("sample1 is not above empty").alias("fault")))
