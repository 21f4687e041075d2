"""Order keys for recency.

The latest record of an entity is the lexicographic maximum of a key such as
``(tier, date, -source_rank)``, whose parts may be of any type that Spark orders.
One aggregation pass finds both the largest and the smallest category at the
best key, and so the exact "more than one category on the latest date" test
without a window: the largest by ``max(struct(key..., c))``, the smallest by
``min(struct(-key..., c))`` where all parts are numbers, and otherwise by
``max(struct(key..., complement(c)))``, where the complement of a code is a text
that orders the other way round (it costs some more for each record).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that Spark has no order for.
_UNORDERED = (T.MapType, T.CalendarIntervalType, T.NullType, T.VariantType)


def orderable(dt: T.DataType) -> bool:
    """Whether Spark orders values of this type."""
    if isinstance(dt, _UNORDERED):
        return False
    if isinstance(dt, T.StructType):
        return all(orderable(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return orderable(dt.elementType)
    return True


def time_key(name: str, dtype: T.DataType, grain: str | None = None) -> tuple[Column, bool]:
    """What orders the records of an entity in time, and whether it is a number that
    can be negated exactly: dates, timestamps, whole and decimal numbers are. Any
    other type that Spark orders is taken as it is (NaN is later than every
    number, texts compare by bytes).

    With ``grain`` ("day", "month", "year") dates and timestamps are truncated
    first, so records within one grain compare equal (timestamps use the session
    time zone to find their day).
    """
    c = F.col(name)
    if grain is not None:
        day = c if isinstance(dtype, T.DateType) else F.to_date(c)
        if grain == "day":
            return F.unix_date(day).cast("long"), True
        if grain in ("month", "year"):
            return F.unix_date(F.trunc(day, grain)).cast("long"), True
        raise ValueError(f"unknown grain {grain!r}")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long"), True
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c), True
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("long"), True
    if isinstance(dtype, T.DecimalType):
        return c, True
    if not orderable(dtype):
        raise TypeError(f"cannot order by {name!r} of type {dtype.simpleString()}")
    return c, False


#: Hexadecimal digits, and the digits of the complements.
_DIGITS = "0123456789ABCDEF"


def complement(code: Column) -> Column:
    """A text that orders codes (by their bytes) the other way round.

    Each half byte is replaced by its complement. The end mark is larger than
    every digit: a code that begins another one comes after it.
    """
    return F.concat(F.translate(F.hex(code), _DIGITS, _DIGITS[::-1]), F.lit("G"))


def canonical(c: Column, dt: T.DataType) -> Column:
    """``c`` in a form that Spark orders: maps as their sorted entries, variants as
    JSON text, other types as they are. Equal values have equal forms."""
    if orderable(dt):
        return c
    if isinstance(dt, T.MapType):
        entry = lambda e: F.struct(canonical(e["key"], dt.keyType).alias("key"), canonical(e["value"], dt.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(c), entry))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: canonical(e, dt.elementType))
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[canonical(c[f.name], f.dataType).alias(f.name) for f in dt.fields]))
    if isinstance(dt, T.VariantType):
        return F.to_json(c)
    return c.cast("string")  # calendar intervals


def source_rank(name: str, order: tuple[str, ...]) -> Column:
    """1 for the best source, 2 for the next, ...; NULL for any other value."""
    c = F.col(name)
    expr = None
    for i, value in enumerate(order, start=1):
        expr = F.when(c == value, F.lit(i)) if expr is None else expr.when(c == value, F.lit(i))
    return expr if expr is not None else F.lit(None).cast("int")


def key(*parts: tuple[str, Column]) -> Column:
    """A named struct of key components, compared left to right."""
    return F.struct(*[col.alias(name) for name, col in parts])
