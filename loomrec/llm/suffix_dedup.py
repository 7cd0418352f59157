"""Removal of long repeated byte strings by prefix-free parsing.

A window of bytes whose rolling hash is small is a trigger; triggers cut every text into phrases in a way that depends
on the bytes around a cut alone, so equal strings are cut alike. An n-byte string belongs to the first trigger in it:
`o` bytes before the trigger (a suffix of a dictionary phrase) and n - o bytes from there on (the beginning of a suffix
of the parse). Two strings are equal if both parts are.

Triggers are grouped by the `core` bytes from the trigger on, which all strings that they own contain. Where the whole
contexts (the longest string before, n bytes after) of two triggers are equal, all their strings repeat, which settles
the inside of copies without reading them again. Only the remaining contexts of a group, one of each kind, are fetched.
A task sorts them by the bytes from the trigger on, with common prefix lengths (the suffix array of the parse), and
walks each dictionary suffix's occurrences in that order: neighbours repeat a string if the smallest common prefix
between them is long enough. Together this is corpus order, of the strings that can repeat at all.

Strings with no trigger among their first n - core bytes are hashed one by one to 128 bits and travel with the triggers.
Those of triggers with more than `hot` different contexts are hashed too, counted with partial sums and joined back.

A text's id is a 64-bit hash. A second hash of every text tells whether two texts share one, and those that do, a few in
10**10 texts, are named by the second hash instead.

Defined results: null text is empty; a text shorter than n loses nothing; texts that occur in several rows lose
everything if they have n bytes; rows that repeat a doc_id are judged each for itself; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrec.llm.text import slices
from loomrec.scratch import materialise, table_path

WINDOW = 16  # bytes of a trigger
BUCKET_BYTES = 24 << 20  # of texts, whose triggers meet in one task
MOST_SHARED = 10_000  # ids of several texts; chance makes a few
TABLE = np.random.default_rng(400).integers(0, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD
    return h ^ (h >> np.uint64(29))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2**64, for i up to n."""
    if not _powers or len(_powers["up"]) <= n:
        size = max(1 << 21, 2 * n)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class Buffer:
    """Texts side by side, with hashes of any of their substrings."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        up, self.down = powers(len(self.data) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[self.data] * up[: len(self.data)], dtype=np.uint64)])

    def hash(self, a: np.ndarray, z: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        h = (self.sums[z] - self.sums[a]) * self.down[a]
        return mixed(h + np.asarray(salt, np.uint64) * ODD)

    def triggers(self, spacing: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of triggers, none across two texts, and the texts that they are in."""
        x = self.data.astype(np.uint64)
        for k in (1, 2, 4):
            x = x[:-k] | (x[k:] << np.uint64(8 * k)) if len(x) > k else x[:0]
        x = mixed(x[:-8] * np.uint64(BASE) + x[8:]) if len(x) > 8 else x[:0]
        at = np.flatnonzero(mixed(x * ODD) < np.uint64(2**64 // spacing))
        text = np.searchsorted(self.ends, at, "right")
        inside = at + WINDOW <= self.ends[np.minimum(text, len(self.ends) - 1)] if len(self.ends) else at < 0
        return at[inside], text[inside]

    def owned(self, n: int, core: int, spacing: int):
        """For each trigger that owns strings: its text, position, and the most and fewest bytes before it.

        Also the positions (text, start) of the n-byte strings that no trigger owns."""
        at, text = self.triggers(spacing)
        first = np.concatenate([[True], text[1:] != text[:-1]]) if len(at) else np.zeros(0, bool)
        before = np.where(first, self.starts[text] - 1, np.concatenate([[0], at[:-1]])) if len(at) else at
        most = np.minimum(at - before - 1, n - core)
        least = np.maximum(0, n - (self.ends[text] - at))
        # Gaps between triggers, from each text's start to its end.
        edge_text = np.concatenate([np.arange(len(self.starts)), text])
        edge_from = np.concatenate([self.starts, at + 1])
        order = np.lexsort((edge_from, edge_text))
        edge_text, edge_from = edge_text[order], edge_from[order]
        upto = np.full(len(edge_from), np.iinfo(np.int64).max >> 1)
        if len(edge_from) > 1:
            follows = edge_text[1:] == edge_text[:-1]
            upto[:-1][follows] = edge_from[1:][follows] - 1
        last = np.minimum(upto - (n - core) - 1, self.ends[edge_text] - n)
        many = np.maximum(0, last - edge_from + 1)
        alone_text = np.repeat(edge_text, many)
        alone = np.repeat(edge_from - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else many
        keep = least <= most
        return text[keep], at[keep], most[keep], least[keep], alone_text, alone.astype(np.int64)


SPAN = "cid long, a int, z int"


def scan(texts: DataFrame, n: int, core: int, spacing: int, buckets: int) -> DataFrame:
    """Packed triggers by bucket of their core's hash; strings that no trigger owns come with `most` -1 and two hashes."""
    names = ["bucket", "core", "context", "cids", "at", "most", "least"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed():
            cols = [np.concatenate(c) for c in zip(*held)]
            bucket = (cols[0] % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            cols, bucket = [c[by] for c in cols], bucket[by]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            parts = [pa.array([c[a:z].tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary()) for c in cols]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *parts], names=names)

        for b in slices(batches, 256):
            cids = b.column(0).to_numpy()
            buf = Buffer([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
            text, at, most, least, alone_text, alone = buf.owned(n, core, spacing)
            right = np.minimum(buf.ends[text] - at, n)
            key, context = buf.hash(at, at + core), buf.hash(at - most, at + right, most * 1024 + right)
            held.append((key, context, cids[text], (at - buf.starts[text]).astype(np.int32), most.astype(np.int16), least.astype(np.int16)))
            key, context, none = buf.hash(alone, alone + n), buf.hash(alone, alone + n // 2, 77), np.zeros(len(alone), np.int16)
            held.append((key, context, cids[alone_text], (alone - buf.starts[alone_text]).astype(np.int32), none - 1, none))
            size += len(at) + len(alone)
            if size > 1_000_000:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    return texts.select("cid", "text").mapInArrow(run, "bucket int, core binary, context binary, cids binary, at binary, most binary, least binary")


def settle(packed: DataFrame, n: int, buckets: int, hot: int) -> DataFrame:
    """Spans (cid, a, z) of triggers with equal contexts, and the triggers (cid, at, most, least, core, hot) to look at."""
    names = ["cid", "a", "z", "at", "most", "least", "core", "hot"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            held += [[np.frombuffer(x, d) for x, d in zip(row, (np.uint64, np.uint64, np.int64, np.int32, np.int16, np.int16))] for row in zip(*(b.column(i).to_pylist() for i in range(6)))]
        if not held:
            return
        core, context, cid, at, most, least = (np.concatenate(c) for c in zip(*held))
        by = np.lexsort((at, cid, context, core))
        core, context, cid, at, most, least = core[by], context[by], cid[by], at[by], most[by].astype(np.int32), least[by].astype(np.int32)
        same_core = core[1:] == core[:-1]
        new_core = np.concatenate([[True], ~same_core])
        new = np.concatenate([[True], ~(same_core & (context[1:] == context[:-1]))])
        run_of, core_of = np.cumsum(new) - 1, np.cumsum(new_core) - 1
        copies = np.bincount(run_of)[run_of]
        contexts = np.bincount(core_of[new & (most >= 0)], minlength=core_of[-1] + 1)[core_of]
        alone = most < 0
        full = copies > 1
        most, least = np.where(alone, 0, most), np.where(alone, 0, least)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cid[full]), pa.array((at - most)[full]), pa.array((at - least + n)[full]), *(pa.nulls(int(full.sum()), k) for k in kinds[3:])], names=names
        )
        look = ~alone & (contexts > 1) & (new | (contexts > hot))
        cols = [cid[look], at[look], most[look], least[look], core.view(np.int64)[look], contexts[look] > hot]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(pa.nulls(int(look.sum()), k) for k in kinds[1:3]), *map(pa.array, cols[1:])], names=names)

    ddl = "cid long, a int, z int, at int, most int, least int, core long, hot boolean"
    return packed.repartitionById(buckets, F.col("bucket")).select("core", "context", "cids", "at", "most", "least").mapInArrow(run, ddl)


def asked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text, asked): texts with the triggers to look at."""
    what = wanted.groupBy("cid").agg(F.collect_list(F.struct("at", "most", "least", "core")).alias("asked"))
    return texts.join(what.hint("merge"), "cid").select("cid", "text", "asked")


def fetch(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Contexts (core, cid, at, most, least, bytes)."""
    names = ["core", "cid", "at", "most", "least", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            rows = []
            for cid, text, what in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(x["core"], cid, x["at"], x["most"], x["least"], raw[x["at"] - x["most"] : x["at"] + n]) for x in what]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return asked(texts, wanted).mapInArrow(run, "core long, cid long, at int, most int, least int, bytes binary")


def single_strings(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Spans (cid, a, z) of the strings of hot triggers that occur twice, found string by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            for cid, text, what in zip(*(b.column(i).to_pylist() for i in range(3))):
                at = np.unique(np.concatenate([np.arange(x["at"] - x["most"], x["at"] - x["least"] + 1) for x in what]))
                buf = Buffer([text.encode("utf-8", "surrogatepass")])
                w1, w2 = buf.hash(at, at + n), buf.hash(at, at + n // 2, 77)
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(np.full(len(at), cid)), pa.array(at.astype(np.int32))], names=["w1", "w2", "cid", "a"])

    strings = materialise(asked(texts, wanted).mapInArrow(run, "w1 long, w2 long, cid long, a int"), "strings")
    again = strings.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").select("w1", "w2")
    return strings.join(again, ["w1", "w2"]).select("cid", "a", (F.col("a") + n).cast("int").alias("z"))


def repeated_suffixes(contexts: list[bytes], most: np.ndarray, least: np.ndarray, core: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, o): strings of n bytes, o of them before the context's trigger, that another context has too."""
    right = np.zeros((len(contexts), -(-n // 8) * 8), np.uint8)
    size = np.zeros(len(contexts), np.int64)
    for i, (c, m) in enumerate(zip(contexts, most)):
        size[i] = len(c) - m
        right[i, : size[i]] = np.frombuffer(c, np.uint8, offset=m)
    # Suffix array of the parse: contexts by core and then by what follows, with common prefix lengths of neighbours.
    order = np.lexsort((_ranks(right), core))
    differ = right[order[1:]] != right[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), n) if len(order) > 1 else np.zeros(0, np.int64)
    common = np.minimum(common, np.minimum(size[order[1:]], size[order[:-1]]))
    common[core[order[1:]] != core[order[:-1]]] = 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # Occurrences of dictionary suffixes: every o of every context, by the bytes before the trigger and their number.
    buf = Buffer(contexts)
    many = most - least + 1
    owner = np.repeat(np.arange(len(contexts)), many)
    o = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(least, many)
    mark = buf.starts[owner] + most[owner]
    suffix = buf.hash(mark - o, mark, o + 1)
    by = np.lexsort((rank[owner], suffix))
    owner, o, suffix = owner[by], o[by], suffix[by]
    p, q = rank[owner[:-1]], rank[owner[1:]]
    near = (suffix[1:] == suffix[:-1]) & (o[1:] == o[:-1]) & (p < q)
    hit = np.zeros(len(owner), bool)
    if near.any():
        k = np.flatnonzero(near)
        equal = _least_between(common, p[k], q[k]) >= n - o[k]
        hit[k[equal]] = True
        hit[k[equal] + 1] = True
    return owner[hit], o[hit]


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Ranks of equal-length byte rows in byte order, equal rows alike."""
    keys = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    new = np.concatenate([[False], (keys[order[1:]] != keys[order[:-1]]).any(1)]) if len(order) else np.zeros(0, bool)
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def _least_between(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """min(values[a:z]) for each pair a < z, from a table of minima over powers of two."""
    levels = [values]
    while len(levels[-1]) > (1 << (len(levels) - 1)) and (1 << len(levels)) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    level = np.frexp((z - a).astype(float))[1] - 1
    out = np.empty(len(a), values.dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(levels[k][a[at]], levels[k][z[at] - (1 << int(k))])
    return out


def compare(contexts: DataFrame, n: int, buckets: int) -> DataFrame:
    """Spans of strings that several contexts of a core have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("core", "ascending")])
        core = t["core"].to_numpy()
        cuts, at = [0], 0
        while at < len(core):  # whole cores at a time, so that memory is bounded by the largest
            at = int(np.searchsorted(core, core[min(at + 20_000, len(core)) - 1], "right"))
            cuts.append(at)
        for a, z in zip(cuts, cuts[1:]):
            part = t.slice(a, z - a)
            cid, pos = part["cid"].to_numpy(), part["at"].to_numpy()
            owner, o = repeated_suffixes(part["bytes"].to_pylist(), part["most"].to_numpy().astype(np.int64), part["least"].to_numpy().astype(np.int64), core[a:z], n)
            if not len(owner):
                continue
            by = np.lexsort((-o, owner))
            owner, start = owner[by], (pos[owner] - o)[by]
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(owner)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(cid[owner[first]]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + n).astype(np.int32))], names=["cid", "a", "z"])

    bucket = F.pmod(F.xxhash64("core"), F.lit(buckets)).cast("int")
    return contexts.repartitionById(buckets, bucket).select("core", "cid", "at", "most", "least", "bytes").mapInArrow(run, SPAN)


def identified(docs: DataFrame, first: Callable[[Column], Column] = F.xxhash64) -> tuple[Column, int]:
    """An expression for the id of column text, different for every two texts of docs, and all texts' bytes."""
    second = F.xxhash64(F.lit("again"), "text")
    seen = docs.where("text is not null").groupBy(first(F.col("text")).alias("cid")).agg(F.min(second).alias("low"), F.max(second).alias("high"), F.sum(F.octet_length("text")).alias("size"))
    seen = materialise(seen, "ids")
    size = seen.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shared = [r["cid"] for r in seen.where("low <> high").select("cid").limit(MOST_SHARED + 1).collect()]
    if len(shared) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} ids are shared by several texts")
    own = first(F.col("text"))
    return F.when(own.isin(shared), second).otherwise(own) if shared else own, size


def repeated_spans(docs: DataFrame, cid: Column, size: int, n: int, core: int, spacing: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(cid, text, copies) of distinct texts, and (cid, spans): their repeated spans, unmerged."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-size // BUCKET_BYTES))  # a task's share does not grow with the corpus
    texts = docs.where("text is not null").select(cid.alias("cid"), "text").groupBy("cid").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex[:12]}"
    texts.write.bucketBy(parts, "cid").sortBy("cid").option("compression", "zstd").option("path", table_path(spark, name)).saveAsTable(name)
    texts = spark.table(name)
    long = texts.where(F.octet_length("text") >= n)
    settled = materialise(settle(scan(long, n, core, spacing, buckets), n, buckets, hot), "settled")
    look = settled.where("at is not null")
    spans = settled.where("a is not null").select("cid", "a", "z").unionByName(compare(fetch(long, look.where("not hot"), n), n, buckets))
    if not look.where("hot").isEmpty():
        spans = spans.unionByName(single_strings(long, look.where("hot"), n))
    return texts, spans.groupBy("cid").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def remove_repeats(docs: DataFrame, n: int = 400, core: int = 80, spacing: int = 56, hot: int = 4096, ident: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; kept are the remaining bytes."""
    cid, size = identified(docs, ident)
    texts, spans = repeated_spans(docs, cid, size, n, core, spacing, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in slices(batches, 128):
            rows = []
            for cid, text, copies, found in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = text.encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for a, z in [(0, len(raw))] if copies > 1 and len(raw) >= n else sorted((s["a"], s["z"]) for s in found or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(z, merged[-1][1])
                    else:
                        merged.append([a, z])
                cuts = [0, *(x for m in merged for x in m), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(cuts[::2], cuts[1::2]))
                rows.append((cid, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    done = texts.join(spans.hint("merge"), "cid", "left").select("cid", "text", "copies", "spans").mapInArrow(run, "cid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = docs.select("doc_id", cid.alias("_cid"), F.col("text").isNull().alias("_none")).join(done, (F.col("_cid") == F.col("cid")) & ~F.col("_none"), "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.coalesce("kept_sha256", nothing).alias("kept_sha256"), F.coalesce("kept", F.lit(b"")).alias("kept"))
