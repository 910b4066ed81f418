"""Table layouts."""

from pyspark.sql import types as T

_VECTOR = T.ArrayType(T.DoubleType())

SNAPSHOT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("take", T.IntegerType()),
    T.StructField("ts", T.DoubleType()),
    T.StructField("reference", _VECTOR),
    T.StructField("interp_diff", _VECTOR),
    T.StructField("cir", T.ArrayType(T.ArrayType(_VECTOR))),
    T.StructField("valid_mask", T.ArrayType(T.BooleanType())),
    T.StructField("toa", _VECTOR),
])

PAIRS = T.StructType([
    T.StructField("i", T.LongType()),
    T.StructField("j", T.LongType()),
    T.StructField("d", T.DoubleType()),
])
