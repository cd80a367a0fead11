"""Labelled training rows, and what a classifier's result has in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: How many times the wanted rows a hash threshold leaves.
SPARE = 2


def held_out() -> Column:
    """crc32 of the doc_id as text is a multiple of 5. A row without id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label for a bounded sample of the training labels, and how many training labels there are of each class.

    ``most[c]`` bounds the rows of class c; those of least hashed doc_id are taken, so the choice is the same in
    every run. Labels that are null or neither 0 nor 1 don't count; of several for one doc_id the largest does.
    """
    own = labels.filter(F.col(column).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(column).alias("label"))
    totals = {int(r["label"]): r["count"] for r in own.groupBy("label").count().collect()}
    # A threshold on the hash leaves about SPARE times as many rows as wanted (more than enough but for a chance of less than 1e-12), so that few rows meet in the task that takes the first n.
    number = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    parts = []
    for c, n in most.items():
        mine = own.filter(F.col("label") == c)
        if totals.get(c, 0) > SPARE * n:
            mine = mine.filter(number < int(SPARE * n / totals[c] * (1 << 32)))
        parts.append(mine.orderBy(number, "doc_id").limit(n))
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    # At most sum(most) rows: small enough to broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), totals
