"""Constants and columns of unlike types, compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Types of which it is known how they write each value.
RULED = (T.StringType, T.BooleanType, *INTEGRAL)


def equals_text(column: Column, kind: T.DataType, text: str) -> Column:
    """``column`` written as text equals ``text``.

    A typed literal reaches the Parquet scan as a pushed filter, so it is used wherever the text is how the
    type writes that value; other texts match nothing. Types without such a rule are compared as text.
    """
    if isinstance(kind, RULED):
        value = typed(text, kind)
        return F.lit(False) if value is None else column == F.lit(value).cast(kind)
    return column.cast("string") == F.lit(text)


def typed(text: str, kind: T.DataType) -> str | int | bool | None:
    """The value that the type writes as ``text``; None if it writes none so, or the type has no such rule."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        return {"true": True, "false": False}.get(text)
    if isinstance(kind, INTEGRAL):
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)]
        try:
            number = int(text)
        except ValueError:
            return None
        return number if str(number) == text and -(1 << (bits - 1)) <= number < 1 << (bits - 1) else None
    return None


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which values of both are compared: theirs, a long for two integral ones, else text."""
    if a == b:
        return a
    return T.LongType() if isinstance(a, INTEGRAL) and isinstance(b, INTEGRAL) else T.StringType()


def as_type(column: Column, have: T.DataType, want: T.DataType) -> Column:
    return column if have == want else column.cast(want)
