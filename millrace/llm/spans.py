"""Span columns: the shape that the span finders return and the digests that queries derive from it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

#: start and end count code points, end exclusive; base: found by the plain pattern, else by the operator's method.
SPAN_TYPE = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("base", BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def to_arrow(found: list[list[tuple]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans] for spans in found], _ARROW)


def count_of(spans: str, kind: str) -> Column:
    """Number of base spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(spans: str) -> tuple[Column, Column]:
    """(SHA-256 of the base spans, all spans), each as kind:start:end joined by commas."""
    base = F.sha2(joined(F.filter(spans, lambda s: s["base"])).cast("binary"), 256)
    return base.alias("base_sha256"), joined(F.col(spans)).alias("spans")
