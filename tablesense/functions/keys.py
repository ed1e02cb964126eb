"""Key values as text, so that keys of different types can be compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def key_text(col: Column, data_type: T.DataType, *, empty_is_null: bool = False) -> Column:
    """Render a key as text: 7, 7.0 and '7' all become '7'; nothing is trimmed."""
    if isinstance(data_type, T.StringType):
        return F.when(col != "", col) if empty_is_null else col
    if isinstance(data_type, _INTEGRAL):
        return col.cast("string")
    if isinstance(data_type, T.DecimalType):
        text = col.cast("string")
        if data_type.scale == 0:
            return text
        return F.regexp_replace(text, r"\.?0+$", "")
    if isinstance(data_type, _FLOATING):
        # every double from 2^53 on is whole; a long holds it exactly below 2^63
        whole = (F.abs(col) >= F.lit(2.0**53)) | (col == F.rint(col))
        exact = F.when(F.abs(col) < F.lit(2.0**63), col.cast("bigint").cast("string"))
        exact = exact.when(F.abs(col) < F.lit(1e38), col.cast("decimal(38,0)").cast("string"))
        return F.coalesce(F.when(whole, exact), col.cast("string"))
    return col.cast("string")


def tuple_key(parts: Sequence[Column]) -> Column:
    """One text for a whole key. Null when any part is null; length prefixes keep tuples apart."""
    if len(parts) == 1:
        return parts[0]
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.length(part).cast("string"), F.lit(":"), part]
    return F.concat(*pieces)
