"""Document fingerprints by one-permutation MinHash with optimal densification.

Shrivastava, Optimal Densification for Fast and Accurate Minwise Hashing (2017); Li and König, b-Bit Minwise Hashing (2010).
Every shingle is hashed once: high bits choose one of K bins, which keeps its least value. An empty bin takes
the value of a bin that a 2-universal hash of (bin, attempt) names, at the first attempt that meets a full one.
Of each bin's value the low B bits are packed, as lower-case hex. Two fingerprints agree in a bin by chance with probability 2**-B, so the
share of agreeing bins m gives the likeness (m - 2**-B) / (1 - 2**-B), at least 0.

Shingles are five words, as in the near-duplicate operators. A text without words has the fingerprint of no shingle, all zeros
with a leading "-"; its likeness is 1 to another such text and 0 to any other. Null counts as empty. Equal texts have equal fingerprints.

Neighbours in ascending doc_id come from one range-dealt shuffle of the texts: cut points split the ids into
ranges, and each range also gets a copy of the first document after it. Rows with a null doc_id come first in that order,
rows of equal doc_id follow each other by text. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.llm.common import bound_batches, mix, texts
from hornspark.llm.shingles import shingle_sets

BINS, BITS, WIDTH = 256, 8, 5
#: Documents to a range, on average, and the most ranges: the driver holds two numbers for each.
RANGE_ROWS, MOST_RANGES = 1024, 100_000
#: Ranges that a task of the shuffle takes, on average.
RANGES_A_TASK = 8
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bin_minima(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of bins for each set; -1 where no shingle fell."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    h = mix(np.concatenate([*sets, np.zeros(0, np.uint64)]) + np.uint64(0x632BE59BD9B4E019))
    at = np.repeat(np.arange(len(sets)), sizes) * bins + ((h >> np.uint64(40)) * np.uint64(bins) >> np.uint64(24)).astype(np.int64)
    out = np.full(len(sets) * bins, 1 << 62, np.int64)
    np.minimum.at(out, at, (h & np.uint64((1 << 40) - 1)).astype(np.int64))
    return np.where(out == 1 << 62, -1, out).reshape(-1, bins)


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill empty bins of rows that have a full one. Each attempt treats all still empty bins of all rows at once."""
    out, bins = minima.copy(), minima.shape[1]
    row, col = np.nonzero((minima < 0) & (minima >= 0).any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = (mix(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> np.uint64(33)).astype(np.int64) % bins
        value = minima[row, source]
        ok = value >= 0
        out[row[ok], col[ok]] = value[ok]
        row, col = row[~ok], col[~ok]
    return out


def low_bits(sets: list[np.ndarray]) -> np.ndarray:
    """Packed low-order bits of each bin's value, a row of bytes each. Values are mixed once more, so that their low bits tell all of them apart equally."""
    full = densify(bin_minima(sets, BINS))
    return (mix(full.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, a_empty: np.ndarray, b_empty: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    found = np.maximum(0.0, ((a == b).mean(axis=1) - chance) / (1 - chance))
    return np.where(a_empty | b_empty, (a_empty & b_empty).astype(float), found)


def as_text(bits: np.ndarray, empty: np.ndarray) -> list[str]:
    return ["-" + "00" * BINS if e else row.tobytes().hex() for row, e in zip(bits, empty, strict=True)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, for general use: no neighbours, no shuffle."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(texts(b.column(1)), WIDTH)
            empty = np.array([not len(s) for s in sets], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_text(low_bits(sets), empty), pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next document's first, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _rows(ids: list, own: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(own, following, strict=True)]
    chain = [*own, following[-1]]  # each next document but the last is the following row's own
    sets = shingle_sets(chain, WIDTH)
    edited_sets = shingle_sets(changed, WIDTH)
    bits, bits_edited = low_bits(sets), low_bits(edited_sets)
    empty, empty_edited = (np.array([not len(s) for s in x], bool) for x in (sets, edited_sets))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
            pa.array(as_text(bits[:-1], empty[:-1])),
            pa.array(as_text(bits_edited, empty_edited)),
            pa.array(likeness(bits[:-1], bits_edited, empty[:-1], empty_edited)),
            pa.array(likeness(bits[:-1], bits[1:], empty[:-1], empty[1:])),
        ],
        [c.split()[0] for c in SCHEMA.split(", ")],
    )


def range_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """Number of cut points up to each id; rows without id are in range 0."""
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    return np.where(pc.is_null(ids).to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, keys, side="right")).astype(np.int64)


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    ids = docs.select("doc_id")
    n = max(1, min(MOST_RANGES, -(-ids.count() // RANGE_ROWS)))
    cuts = ids.filter("doc_id is not null").approxQuantile("doc_id", [k / n for k in range(1, n)], max(1e-4, 0.2 / n)) if n > 1 else []
    cuts = np.unique(np.array(cuts, np.int64))

    def first_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = range_of(b.column(0), cuts)
            found = pa.table([pa.array(ranges), b.column(0), pc.is_null(b.column(0))], ["range", "first", "nulls"]).group_by("range").aggregate([("first", "min"), ("nulls", "any")])
            yield from found.rename_columns(["range", "first", "nulls"]).to_batches()

    firsts = ids.mapInArrow(first_ids, "range long, first long, nulls boolean").groupBy("range").agg(F.min("first").alias("first"), F.bool_or("nulls").alias("nulls"))
    firsts = sorted(map(tuple, firsts.collect()))  # a row for each range
    # A range's first document is copied to the range before it, that of the first range to the last. Rows without id come first of all.
    copies = {None if nulls and not k else first: firsts[k - 1][0] for k, (_, first, nulls) in enumerate(firsts)}
    heads = np.array(sorted(i for i in copies if i is not None), np.int64)
    heads_to = np.array([copies[i] for i in heads.tolist()], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = range_of(b.column(0), cuts)
            no = np.zeros(b.num_rows, bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ranges), pa.array(no)], ["doc_id", "text", "range", "guard"])
            keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            null = pc.is_null(b.column(0)).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(heads, keys), max(0, len(heads) - 1))
            is_head = ~null & (heads[at] == keys) if len(heads) else no
            to = heads_to[at] if len(heads) else np.zeros(b.num_rows, np.int64)
            if None in copies:
                to, is_head = np.where(null, copies[None], to), is_head | null
            if is_head.any():
                some = b.filter(pa.array(is_head))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(to[is_head]), pa.array(~no[: some.num_rows])], ["doc_id", "text", "range", "guard"])

    dealt = docs.mapInArrow(deal, "doc_id long, text string, range long, guard boolean")
    # A few ranges to a partition, however many there are: what a task reads doesn't grow with the table.
    dealt = dealt.repartition(-(-n // RANGES_A_TASK), "range").sortWithinPartitions("range", "guard", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, text, range) not yet answered
        for b in batches:
            ids, own, ranges, guards = b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, t, r, g in zip(ids, own, ranges, guards, strict=True):
                if g:  # of several rows with that id the first is the neighbour
                    if held and held[-1][2] == r:
                        yield _rows([x[0] for x in held], [x[1] for x in held], [*(x[1] for x in held[1:]), t])
                        held = []
                    continue
                held.append((i, t, r))
            if len(held) > 1:
                yield _rows([x[0] for x in held[:-1]], [x[1] for x in held[:-1]], [x[1] for x in held[1:]])
                held = held[-1:]
        assert not held, "a range without a guard"

    return dealt.mapInArrow(run, SCHEMA)
