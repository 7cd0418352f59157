"""Small text helpers that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The six characters that separate words in every contract of this subpackage.
SPACES = " \t\n\x0b\x0c\r"
#: The same set as a Java regular expression class of everything else.
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; bytes.split() separates at exactly the six characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python objects are held for a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()  # what a batch took goes back before the next one comes


def codes(items: list[bytes]) -> tuple[np.ndarray, int]:
    """Dense integer codes of the items, in order of first appearance, and how many there are."""
    seen: dict[bytes, int] = {}
    out = np.fromiter((seen.setdefault(x, len(seen)) for x in items), np.int64, len(items))
    return out, len(seen)


def gram_codes(items: list[bytes], n: int) -> np.ndarray:
    """Integers that are equal exactly where windows of n items are equal (no hashing)."""
    if len(items) < n:
        return np.empty(0, np.int64)
    unit, top = codes(items)
    grams, have, width = unit, top, 1
    while width < n:
        right = unit[width:]
        left = grams[: len(right)]
        if have > (1 << 62) // max(top, 1):
            left = np.unique(left, return_inverse=True)[1]
            have = int(left.max()) + 1
        grams, have, width = left * top + right, have * top, width + 1
    return grams
