"""Exact top-k search by tiled matrix products.

Query vectors are every EVERY-th id. If their components number GROUP_VALUES at most (32 MB), they are broadcast and every task of one scan meets them
all. Beyond that both sides are tiled: queries are dealt into groups of that size and the written base into shards of about SHARD_ROWS; one shuffle
brings each pair of a group and a shard together, the group's queries first, so that a task holds one group and streams the shard. No block goes through the driver.

A task holds a running list of the k best for every query and takes candidates tile by tile: a matrix product for each BLOCK_ROWS queries, a
partial selection of the tile's k best, a merge into the lists. The tasks' lists meet in two rounds of merging by query, each over about the
square root of their number.

Components become floor(256 * x). Products are sums of whole numbers: as doubles where all of them are below 2**53, and so exact, else as Python's integers, held within +-2**62.
Ties go to the smaller vec_id. A vector without id, empty, null or with a null or non-finite component takes no part; vectors of other lengths than the
query's are no candidates. A repeated query id is asked once, with the least of its vectors; rows of the query's own id are never
candidates; other repeated rows count each for themselves. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornspark.llm.common import bound_batches
from hornspark.sources.scratch import Scratch

EVERY, BLOCK_ROWS, TILE_ROWS = 50, 2048, 1024
GROUP_VALUES, SHARD_ROWS, MOST_TASKS = 1 << 22, 1 << 17, 1 << 16
EXACT = float(1 << 53)


class Matrix:
    """Vectors as they are, and as whole numbers; those of the largest doubles become infinite there, and are taken from the doubles themselves."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw.astype(np.float64)
        with np.errstate(over="ignore"):
            self.scaled = np.floor(256.0 * self.raw)
        self.most = float(np.abs(self.scaled).max(initial=0))

    def __getitem__(self, rows: slice) -> Matrix:
        return Matrix(self.raw[rows])

    def whole(self) -> list[list[int]]:
        """floor(256 * x) as integers of any size."""
        return [[256 * n // d for n, d in map(float.as_integer_ratio, row)] for row in self.raw.tolist()]


def by_length(ids: np.ndarray, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) for each length of vectors; ids ascending."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield int(n), ids[rows], flat[start[rows][:, None] + np.arange(n)]


def products(a: Matrix, b: Matrix) -> np.ndarray:
    """Inner products of all rows of a with all of b, as int64."""
    if a.most * b.most * a.raw.shape[1] < EXACT:
        return (a.scaled @ b.scaled.T).astype(np.int64)
    whole, top = b.whole(), 1 << 62
    return np.array([[max(-top, min(top, sum(x * y for x, y in zip(p, q, strict=True)))) for q in whole] for p in a.whole()], np.int64).reshape(len(a.raw), len(b.raw))


NONE = np.iinfo(np.int64).min


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by falling score, then rising id; ``ids`` is a row for all, ascending. NONE never counts."""
    n = scores.shape[1]
    if n <= k:
        chosen = np.broadcast_to(np.arange(n), scores.shape)
    elif np.abs(np.where(scores == NONE, 0, scores)).max(initial=0) < (1 << 61) // n:
        key = np.where(scores == NONE, NONE, scores * n + np.arange(n)[::-1])  # unequal keys: ties are settled before selecting
        chosen = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        chosen = np.argsort(np.where(scores == NONE, np.iinfo(np.int64).max, -np.maximum(scores, NONE + 1)), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, chosen, 1), ids[chosen]


def merge(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -np.maximum(scores, NONE + 1)), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class Lists:
    """The k best candidates so far for each of some queries, by length of vectors."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, k: int):
        self.k = k
        self.queries = {n: (found, Matrix(m)) for n, found, m in by_length(ids, vectors)} if len(ids) else {}
        self.best = {n: (np.full((len(found), k), NONE), np.zeros((len(found), k), np.int64)) for n, (found, _) in self.queries.items()}

    def take(self, ids: np.ndarray, vectors: pa.Array) -> None:
        for n, found, raw in by_length(ids, vectors):
            if n not in self.queries:
                continue
            query_ids, matrix = self.queries[n]
            for lo in range(0, len(found), TILE_ROWS):
                some, tile = found[lo : lo + TILE_ROWS], Matrix(raw[lo : lo + TILE_ROWS])
                for q in range(0, len(query_ids), BLOCK_ROWS):
                    block = slice(q, q + BLOCK_ROWS)
                    scores = products(matrix[block], tile)
                    own = np.minimum(np.searchsorted(query_ids[block], some), len(scores) - 1)
                    hit = np.flatnonzero(query_ids[block][own] == some)
                    scores[own[hit], hit] = NONE
                    old, new = self.best[n], best(scores, some, self.k)
                    old[0][block], old[1][block] = merge(np.hstack([old[0][block], new[0]]), np.hstack([old[1][block], new[1]]), self.k)

    def rows(self, task: int) -> Iterator[pa.RecordBatch]:
        for n, (scores, found) in self.best.items():
            row, col = np.nonzero(scores != NONE)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(self.queries[n][0][row]), pa.array(np.full(len(row), task)), pa.array(scores[row, col]), pa.array(found[row, col])], FOUND_NAMES)


FOUND = "query_id long, task long, score long, vec_id long"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _one_scan(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each task's k best for every query, these being few enough to broadcast."""
    found = queries.toArrow()
    shared = base.sparkSession.sparkContext.broadcast((found.column("vec_id").to_numpy(), found.column("embedding").combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(*shared.value, k)
        for b in batches:
            lists.take(b.column(0).to_numpy(), b.column(1))
        yield from lists.rows(TaskContext.get().partitionId())

    return base.mapInArrow(run, FOUND)


def _tiled(base: DataFrame, queries: DataFrame, k: int, n_groups: int, n_shards: int) -> DataFrame:
    """Each shard's k best for every query; both tables are written ones, so that their rows are numbered alike whenever they are read."""
    number = F.monotonically_increasing_id()
    base = base.withColumn("shard", (number % n_shards).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    queries = queries.withColumn("group", (number % n_groups).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    columns = ["group", "shard", "query", "vec_id", "embedding"]
    both = queries.withColumn("query", F.lit(True)).select(columns).union(base.withColumn("query", F.lit(False)).select(columns))
    both = both.repartition(min(n_groups * n_shards, MOST_TASKS), "group", "shard").sortWithinPartitions("group", "shard", F.desc("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, lists = None, [], None
        for b in batches:
            group, shard, query = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(shard) != 0) | (np.diff(query.astype(int)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if key != (group[lo], shard[lo]):
                    if lists:
                        yield from lists.rows(int(key[1]))
                    key, held, lists = (group[lo], shard[lo]), [], None
                some = b.slice(lo, hi - lo)
                if query[lo]:
                    held.append(some)
                elif held:
                    if lists is None:
                        t = pa.Table.from_batches(held)
                        lists = Lists(t.column("vec_id").to_numpy(), t.column("embedding").combine_chunks(), k)
                    lists.take(some.column(3).to_numpy(), some.column(4))
        if lists:
            yield from lists.rows(int(key[1]))

    return both.mapInArrow(run, FOUND)


def _merged(found: DataFrame, k: int, *keys: str) -> DataFrame:
    entry = F.struct((-F.col("score")).alias("a"), F.col("vec_id").alias("b"))
    top = F.slice(F.sort_array(F.collect_list(entry)), 1, k)
    return found.groupBy(*keys).agg(top.alias("top")).select(*keys, F.posexplode("top").alias("at", "e")).select(*keys, (F.col("at") + 1).alias("rank"), F.col("e.b").alias("vec_id"), (-F.col("e.a")).alias("score"))


def top_k(vectors: DataFrame, *, k: int = 5, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    bound_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    queries = base.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    values = queries.agg(F.sum(F.size("embedding"))).first()[0] or 0
    if values <= GROUP_VALUES:
        found, lists = _one_scan(base, queries, k), 4096
    else:
        scratch = Scratch(spark)
        base, queries = scratch.write(base), scratch.write(queries)
        lists = -(-base.count() // SHARD_ROWS)
        found = _tiled(base, queries, k, -(-values // GROUP_VALUES), lists)
    found = found.withColumn("group", F.floor(F.col("task") / max(1, round(lists**0.5))))
    out = _merged(_merged(found, k, "query_id", "group"), k, "query_id")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""
