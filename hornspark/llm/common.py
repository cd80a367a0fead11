"""Small parts that several operators use."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, islice, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornspark.sources.ship import ship

#: Rows and bytes that an Arrow batch to Python holds at most: texts may be long, and a worker's memory is small.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """What every operator with Python workers needs first: small batches, and this package on the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(column: pa.Array) -> list[str]:
    """A batch's texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def map_batches(df: DataFrame, columns: list[str], work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema, memos: Callable[[], tuple[Memo, ...]] = tuple) -> DataFrame:
    """``work`` on each Arrow batch of ``columns``, without a shuffle. Only these columns are read. ``memos`` are those that the work uses."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.keep_only(*memos())
        for b in batches:
            if b.num_rows:
                out = work(b)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def trim() -> None:
    """Freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def give_back() -> None:
    """What was freed goes back to the system at once: for a driver that has fitted and sent a model, and serves other operators after it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim()


class Memo:
    """Results by word in two generations, for a bound on memory.

    When the young generation is full it becomes the old one, and what the former old one held is forgotten unless
    it was asked for meanwhile. A worker process serves one operator after another; what an operator remembers goes
    when another one's task begins.
    """

    everyone: list[Memo] = []

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit // 2, {}, {}
        Memo.everyone.append(self)

    def clear(self) -> None:
        self.young, self.old = {}, {}

    @staticmethod
    def keep_only(*mine: Memo) -> None:
        gone = [m for m in Memo.everyone if m.young and not any(m is x for x in mine)]
        for m in gone:
            m.clear()
        if gone:
            trim()

    def look_up(self, keys: list, compute: Callable[[list], Iterable]) -> list:
        """The value of each key; those missing are computed all at once."""
        young = self.young
        out = list(map(young.get, keys))
        gaps = list(compress(range(len(out)), map(is_, out, repeat(None))))
        if gaps:
            wanted = {keys[i] for i in gaps}
            if len(young) + len(wanted) > self.limit:
                self.young, self.old = {}, young  # what the former old generation held is gone
                young = self.young
            old = self.old
            found = {k: old[k] for k in wanted if k in old} if old else {}
            missing = [k for k in wanted if k not in found] if found else list(wanted)
            found.update(zip(missing, compute(missing), strict=True))
            young.update(found)
            for i in gaps:
                out[i] = found[keys[i]]
        return out


def by_row(rows: list[list], look_up: Callable[[list], list]) -> Iterator[list]:
    """The looked-up values of each row, all rows looked up together."""
    found = iter(look_up(list(chain.from_iterable(rows))))
    for r in rows:
        yield list(islice(found, len(r)))


def mix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mixing step (the finalizer of splitmix64), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
