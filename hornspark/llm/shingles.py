"""Hashed word shingles of whole texts, and joins by document id."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from hornspark.llm.common import mix

#: An id list of at most this many rows is broadcast (some 30 MB as a hash table); a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: str) -> list[bytes]:
    """Runs without blank, tab, line feed, vertical tab, form feed and carriage return, with A-Z in lower case: just what bytes do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(batch: Sequence[str], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles as ascending 64-bit hashes.

    A text of fewer words than ``width`` has its whole sequence as the only shingle, one without words has none.
    Two different shingles of a pair of documents share a hash with a chance of about 1e-13 for a million shingles.
    """
    found = [words(t) for t in batch]
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((xxh3_64_intdigest(w) for ws in found for w in ws), np.uint64, int(lengths.sum()))
    size = max(0, len(flat) - width + 1)
    rolled = np.zeros(size, np.uint64)
    for k in range(width):
        rolled = mix(rolled + flat[k : k + size] + np.uint64(k + 1))
    out, at = [], 0
    for ws, n in zip(found, lengths.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            out.append(np.array([xxh3_64_intdigest(b" ".join(ws), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (left_semi, inner) or not in it (left_anti)."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", how)
