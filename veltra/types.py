"""The four logical types and their Spark types."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Type(Enum):
    INT64 = "INT64"
    DOUBLE = "DOUBLE"
    BOOL = "BOOL"
    STRING = "STRING"

    @property
    def numeric(self) -> bool:
        return self in (Type.INT64, Type.DOUBLE)

    @property
    def spark(self) -> T.DataType:
        return SPARK[self]


SPARK = {Type.INT64: T.LongType(), Type.DOUBLE: T.DoubleType(), Type.BOOL: T.BooleanType(), Type.STRING: T.StringType()}

#: Names in CAST.
CAST_NAMES = {"bigint": Type.INT64, "double": Type.DOUBLE, "boolean": Type.BOOL, "varchar": Type.STRING}

INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1


def logical(kind: T.DataType) -> Type | None:
    """The logical type that holds a Spark type's values without loss; None if there is none."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Type.INT64
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Type.DOUBLE
    if isinstance(kind, T.BooleanType):
        return Type.BOOL
    return Type.STRING if isinstance(kind, T.StringType) else None
