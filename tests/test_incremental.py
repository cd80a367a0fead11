"""Facts that arrive later give the same fixpoint."""

import random

from hornspark.engine import Engine
from hornspark.streaming.incremental import Incremental

RULES = "path(A,B) :- edge(A,B). path(A,C) :- path(A,B),edge(B,C). both(A) :- path(A,B),path(B,A)."
TEXT = f"Schemes: none(a) Facts: Rules: {RULES} Queries: path(A,B)? both(A)?"


def rows(frames):
    return [sorted(map(tuple, f.collect())) for f in frames]


def test_inserts_equal_one_run(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(8), rng.randrange(8)) for _ in range(14)]
    kept = Incremental(spark, TEXT, {"edge": spark.createDataFrame(edges[:5], "a int, b int")})
    for lo in range(5, 14, 3):
        kept.insert("edge", spark.createDataFrame(edges[lo : lo + 3], "a int, b int"))
    assert not kept.insert("edge", spark.createDataFrame(edges[:2], "a int, b int"))
    whole = Engine(spark).register("edge", spark.createDataFrame(edges, "a int, b int")).run(TEXT)
    assert rows(kept.answers()) == rows(q.df for q in whole.queries)


def test_stream(spark, tmp_path):
    edges = [(1, 2), (2, 3), (3, 1), (4, 5)]
    for k, e in enumerate(edges):
        spark.createDataFrame([e], "a int, b int").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("a int, b int").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in" / "*"))
    kept = Incremental(spark, TEXT, {"edge": spark.createDataFrame([], "a int, b int")})
    query = kept.follow("edge", stream, str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    whole = Engine(spark).register("edge", spark.createDataFrame(edges, "a int, b int")).run(TEXT)
    assert rows(kept.answers()) == rows(q.df for q in whole.queries)
