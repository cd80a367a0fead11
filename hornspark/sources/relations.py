"""Relations: DataFrames whose columns are c0, c1, ... by position, with the types they had."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornspark.plans.nodes import Fact

SCALAR = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def empty(spark: SparkSession, arity: int) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(arity)]))


def from_facts(spark: SparkSession, facts: Sequence[Fact]) -> DataFrame:
    """Distinct tuples; shorter ones are filled with NULL, which no bound variable ever matches."""
    arity = max(len(f.values) for f in facts)
    rows = list(dict.fromkeys(f.values + (None,) * (arity - len(f.values)) for f in facts))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(arity)])
    return spark.createDataFrame(rows, schema)


def from_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Chosen columns of a table, by position. Rows may repeat; evaluation is by sets."""
    chosen = list(columns or df.columns)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in chosen:
        if not isinstance(kinds[c], SCALAR):
            raise TypeError(f"{c} is {kinds[c].simpleString()}; only scalar columns can be bound")
    return df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(chosen)))
