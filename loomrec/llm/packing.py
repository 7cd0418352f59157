"""Best-fit packing by linear grouping.

Large pieces are sorted by length and cut into groups of equal cardinality; each length is rounded up to the largest
of its group, so that only a few sizes remain. Configurations of those sizes are chosen one after another: the largest
size left, completed by the subset of sizes that fills the sequence best, used as often as the counts allow. Actual
pieces then take the places of the rounded ones, and the small pieces go best-fit into what is left.

The plan needs only the histogram of lengths (at most `capacity` numbers, whatever the corpus), so it is made on the
driver; the pieces never leave the executors. A piece finds its place by its rank among the pieces of its length:
its rank within its task, counted while tokenising, plus the counts of earlier tasks.

Defined results: null or empty text is the closing token alone; a repeated row is packed again; an empty table gives
an empty result; null ids are carried along; extra input columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomrec.llm.text import slices, words
from loomrec.scratch import materialise

_tokenizers: dict[str, "WordCache"] = {}

#: Latin letters that lower-case and normalise one by one, then ASCII signs other than the apostrophe and < >: two runs that the
#: tokenizer's own pattern separates, and always in this way.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest take letters from U+0100 on."""
    spare = iter(range(256, 512))
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordCache:
    """Token ids of whole words, packed as little-endian 32-bit integers.

    The tokenizer never joins what white space separates, so a text's ids are its words' ids one after another. Plain
    words go straight to the tokenizer's merge model, which gives the same ids in a quarter of the time; any other word
    takes the whole tokenizer."""

    LIMIT = 200_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.stems, self.letters = Tokenizer.from_file(path), {}, {}, byte_letters()
        self.plain = all(self._plain(w) == self._whole([w])[0] for w in (b"Plain", "D\u00c9J\u00c0".encode(), b"end.", b"x***%%"))

    @classmethod
    def of(cls, path: str) -> "WordCache":
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def _whole(self, some: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in some], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _merged(self, stem: bytes) -> bytes:
        """Ids of a run of lower-case letters or of signs."""
        ids = self.stems.get(stem)
        if ids is None:
            if len(self.stems) > self.LIMIT:
                self.stems.clear()
            text = stem.decode() if stem.isascii() else "".join([self.letters[b] for b in stem])
            ids = self.stems[stem] = array("I", [x.id for x in self.tokenizer.model.tokenize(text)]).tobytes()
        return ids

    def _plain(self, word: bytes) -> bytes | None:
        stem = word.rstrip(b"!#$%&*+,-./:;=?@^_|~")
        if stem.isalpha():  # ASCII letters
            signs = word[len(stem) :]
            return self._merged(stem.lower()) + self._merged(signs) if signs else self._merged(stem.lower())
        found = PLAIN.fullmatch(word.decode("utf-8", "replace"))
        if not found:
            return None
        ids = self._merged(found[1].lower().encode())
        return ids + self._merged(found[2].encode()) if found[2] else ids

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
        new, rest = set().union(*texts).difference(known), []
        for w in new:
            ids = self._plain(w) if self.plain else None
            if ids is None:
                rest.append(w)
            else:
                known[w] = ids
        for at in range(0, len(rest), 4096):
            known.update(zip(rest[at : at + 4096], self._whole(rest[at : at + 4096])))
        return [b"".join(map(known.__getitem__, t)) for t in texts]


def tokenise(docs: DataFrame, tokenizer: str, capacity: int, closing_id: int, keep_ids: bool) -> DataFrame:
    """Pieces of at most `capacity` tokens, with task number (chunk) and rank among the task's pieces of that length."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("chunk", pa.int32()), ("nth", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids
    ddl = "doc_id long, piece int, start long, length int, ids_crc32 long, chunk int, nth long" + ", ids array<int>" * keep_ids
    close, width = np.asarray([closing_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, chunk = WordCache.of(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices(batches, 256):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), cache.encode([words(t) for t in batch.column(1).to_pylist()])):
                ids += close
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    n = len(part) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(part), chunk, seen[n], *([np.frombuffer(part, "<i4")] * keep_ids)))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(zip(*rows), fields)], names=[f[0] for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Ways to fill a sequence with the given sizes (indices into sizes, largest first) and how often each is used."""
    left, out, top = list(counts), [], 0
    while True:
        while top < len(sizes) and not left[top]:
            top += 1
        if top == len(sizes):
            return out
        room, used = capacity - sizes[top], [top]
        reach, steps = 1, []
        for i in range(top, len(sizes)):
            if sizes[i] > room or reach >> room & 1:
                continue
            for _ in range(min(left[i] - (i == top), room // sizes[i])):
                grown = (reach | reach << sizes[i]) & ((2 << room) - 1)
                if grown == reach:
                    break
                steps.append((i, reach))
                reach = grown
        fill = reach.bit_length() - 1
        for i, before in reversed(steps):
            if not before >> fill & 1:
                used.append(i)
                fill -= sizes[i]
        need = {i: used.count(i) for i in used}
        times = min(left[i] // k for i, k in need.items())
        for i, k in need.items():
            left[i] -= k * times
        out.append((sorted(used), times))


def layout(counts: np.ndarray, capacity: int, groups: int = 256, small: int = 8) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Places for counts[length] pieces: by length, (first rank, first sequence, offset) runs; and the number of sequences.

    groups: how many rounded sizes; pieces of at most capacity/small tokens are small."""
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank, sequences = [0] * (capacity + 1), 0
    classes: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)

    def put(length: int, first: int, n: int, offset: int) -> None:
        places[length].append((rank[length], first, offset))
        rank[length] += n

    edge = capacity // small
    large = [n for n in range(capacity, edge, -1) if counts[n]]
    each = max(1, -(-int(sum(counts[n] for n in large)) // groups))
    sizes, members, filled = [], [], each
    for n in large:  # a length is not divided between groups
        if filled >= each:
            sizes.append(n)
            members.append([])
            filled = 0
        members[-1].append([n, int(counts[n])])
        filled += int(counts[n])
    for slots, times in configurations(sizes, [sum(k for _, k in m) for m in members], capacity):
        done = 0
        while done < times:  # as many sequences at a time as get the same actual lengths
            need: dict[int, int] = defaultdict(int)
            run, got = times - done, []
            for g in slots:
                need[g] += 1
            for g, k in need.items():
                run = min(run, max(1, members[g][0][1] // k))
            for g in slots:
                n, have = members[g][0]
                if have < run:  # the last pieces of a length: this one sequence mixes two lengths
                    run = have
            for g in slots:
                n, have = members[g][0]
                got.append(n)
                members[g][0][1] = have - run
                if have == run:
                    members[g].pop(0)
            offset = 0
            for n in got:
                put(n, sequences, run, offset)
                offset += n
            classes[capacity - offset].append((sequences, run))
            sequences += run
            done += run
    rooms = sorted(classes)
    for n in range(edge, 0, -1):
        left = int(counts[n])
        while left:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                opened = -(-left // (capacity // n))
                room, first, have = capacity, sequences, opened
                sequences += opened
            else:
                room = rooms[at]
                first, have = classes[room].pop()
                if not classes[room]:
                    del classes[room], rooms[at]
            k = room // n
            run = min(have, max(1, left // k))
            k = min(k, left)
            for j in range(k):
                put(n, first, run, capacity - room + j * n)
            left -= k * run
            for r, f, m in ((room - k * n, first, run), (room, first + run, have - run)):
                if m and r:
                    if r not in classes:
                        rooms.insert(bisect_left(rooms, r), r)
                    classes[r].append((f, m))
    return places, sequences


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing_id: int = 0, groups: int = 256, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): every piece and its place."""
    pieces = materialise(tokenise(docs, tokenizer, capacity, closing_id, keep_ids), "pieces")
    held = pieces.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    held = materialise(held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in held.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[n] = k
    places, _ = layout(counts, capacity, groups)
    runs = sorted((n, first, seq, off) for n, found in places.items() for first, seq, off in found)
    starts = np.asarray([(n << 44) + first for n, first, _, _ in runs], np.int64)
    bases = np.asarray([seq - first for _, first, seq, _ in runs], np.int64)
    offsets = np.asarray([off for *_, off in runs], np.int64)
    shape = docs.sparkSession.sparkContext.broadcast((starts, bases, offsets))  # as large as the histogram allows, never as the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, bases, offsets = shape.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(starts, (length.astype(np.int64) << 44) + rank, "right") - 1
            cols = [b.column(i) for i in range(b.num_columns - 1)] + [pa.array(bases[at] + rank), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], "sequence_id", "offset"])

    ranked = pieces.join(held.select("chunk", "length", "before"), ["chunk", "length"])
    ranked = ranked.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *["ids"] * keep_ids, (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long")
