"""Intermediate results as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it is unset, as in local tests, a folder of our own becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hornspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Written tables of one job. They cut lineage: a lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.numbers = spark, [], count()
        self.path_of: dict[int, str] = {}
        self.kept: list[DataFrame] = []
        self.base = f"{shared_dir(spark).rstrip('/')}/hornspark-{uuid.uuid4().hex}"

    def _path(self) -> str:
        self.paths.append(path := f"{self.base}/{next(self.numbers)}")
        return path

    def write(self, df: DataFrame) -> DataFrame:
        """The same rows, now read from a written table."""
        path = self._path()
        df.write.parquet(path)
        return self._read(df, path)

    def _read(self, df: DataFrame, path: str) -> DataFrame:
        out = self.spark.read.schema(df.schema).parquet(path)
        self.path_of[id(out)] = path
        self.kept.append(out)  # so that no other frame gets its id
        return out

    def write_counted(self, df: DataFrame, buckets: int = 0, mark: Column | None = None) -> tuple:
        """The same rows, now read from a written table, and their number, which the write itself finds; after it ``mark``, an aggregate, if given.

        With ``buckets`` the table is dealt by the hash of all its columns, as a shuffle of that many partitions does it; joins on all
        its columns know that and don't shuffle it again.
        """
        path, seen = self._path(), Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("n"), *([mark.alias("mark")] if mark is not None else [])).write
        if not buckets:
            writer.parquet(path)
            return self._read(df, path), *seen.get.values()
        name = f"hornspark_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, *df.columns).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # noqa: B018 - the plan is resolved before the name goes; the files stay
        self.spark.sql(f"drop table {name}")
        return out, *seen.get.values()

    def forget(self, *frames: DataFrame) -> None:
        """Delete the tables that these frames, as ``write`` returned them, read: nothing to come needs them."""
        for df in frames:
            if (path := self.path_of.pop(id(df), None)) is not None:
                self.drop(path)

    def drop(self, path: str | None = None) -> None:
        """Delete one table, or all of them."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path or self.base)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
