"""Vectors as text, for files that hold no arrays: big-endian doubles in base64, packed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOUBLE = "java.lang.Double"


def pack_vector(vector: Column) -> Column:
    """The text of a vector; null stays null, an empty vector and entries that are null or not finite are an error."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    bits = F.transform(vector, lambda x: F.lpad(F.hex(F.reflect(F.lit(DOUBLE), F.lit("doubleToRawLongBits"), x.cast("double")).cast("long")), 16, "0"))
    # Spark may break the text into lines.
    packed = F.regexp_replace(F.base64(F.unhex(F.array_join(bits, ""))), r"\s", "")
    return F.when(vector.isNull(), None).when((F.size(vector) > 0) & finite, packed).otherwise(F.raise_error(F.lit("a vector must hold finite numbers, and one at least")))


def unpack_vector(text: Column) -> Column:
    """The vector of a text; null stays null, a text that holds no whole number of doubles is an error."""
    digits = F.hex(F.unbase64(text))
    starts = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(16))
    longs = F.transform(starts, lambda i: F.conv(F.substr(digits, i, F.lit(16)), 16, -10).cast("long"))
    vector = F.transform(longs, lambda b: F.reflect(F.lit(DOUBLE), F.lit("longBitsToDouble"), b).cast("double"))
    whole = (F.length(digits) > 0) & (F.length(digits) % 16 == 0)
    return F.when(text.isNull(), None).when(whole, vector).otherwise(F.raise_error(F.lit("the text holds no vector")))
