"""One schema for extracts that drift from day to day.

``common_schema`` finds for every column the narrowest type that holds all the
days' types without loss; where there is none (text against numbers, dates
against numbers) it is text.  ``conform`` casts rows to a schema, either that
one or a declared one, and returns apart the rows whose cast would lose
something: a value that cannot be read, or that comes back different.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    NullType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

# Decimal digits of the whole numbers.
_DIGITS = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}
# Digits that the floating types hold exactly.
_EXACT = {FloatType: 7, DoubleType: 15}


def _digits(t: DataType) -> tuple[int, int] | None:
    """(digits before, digits after the point) of exact numbers."""
    if isinstance(t, DecimalType):
        return t.precision - t.scale, t.scale
    return (_DIGITS[type(t)], 0) if type(t) in _DIGITS else None


def wider(a: DataType, b: DataType) -> DataType:
    """The narrowest type that holds the values of both, text where no other does."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if type(a) in _DIGITS and type(b) in _DIGITS:
        return max(a, b, key=lambda t: _DIGITS[type(t)])
    exact = _digits(a), _digits(b)
    if None not in exact:
        before, after = (max(x) for x in zip(*exact))
        return DecimalType(before + after, after) if before + after <= 38 else StringType()
    floats = [t for t in (a, b) if type(t) in _EXACT]
    if len(floats) == 2:
        return DoubleType()
    if floats:
        other = exact[0] or exact[1]
        return DoubleType() if other and sum(other) <= _EXACT[DoubleType] else StringType()
    times = {type(t) for t in (a, b)}
    if times <= {DateType, TimestampNTZType}:
        return TimestampNTZType()
    if times <= {DateType, TimestampType}:
        return TimestampType()
    return StringType()


def common_schema(schemas: Iterable[StructType]) -> StructType:
    """All columns of the days, in order of first appearance (names compared without case), each with the type
    that holds every day's."""
    names: dict[str, str] = {}
    kinds: dict[str, DataType] = {}
    for schema in schemas:
        for f in schema.fields:
            at = f.name.lower()
            names.setdefault(at, f.name)
            kinds[at] = wider(kinds[at], f.dataType) if at in kinds else f.dataType
    return StructType([StructField(n, StringType() if isinstance(kinds[k], NullType) else kinds[k])
                       for k, n in names.items()])


def _loses(value: Column, source: DataType, target: DataType) -> Column:
    """Whether casting the value loses something."""
    if source == target or isinstance(source, NullType):
        return F.lit(False)
    if isinstance(target, StringType):
        return F.lit(False)
    there = value.try_cast(target)
    unread = value.isNotNull() & there.isNull()
    if isinstance(source, StringType):
        return unread            # '007' and ' 7' are 7: other spellings of a value are no loss
    return unread | ~there.try_cast(source).eqNullSafe(value)


@dataclass(frozen=True)
class Conformed:
    """Rows in the schema, and rows that do not fit it: (row: JSON of the whole row, column, value, target)."""
    rows: DataFrame
    rejects: DataFrame


def conform(df: DataFrame, schema: StructType) -> Conformed:
    """``df`` in ``schema``; columns it lacks are NULL, columns the schema lacks are dropped.

    A row with one or more losing casts goes to the rejects, once for each such column, and not to the rows.
    """
    have = {f.name.lower(): f for f in df.schema.fields}
    lossy: dict[str, Column] = {}
    for f in schema.fields:
        own = have.get(f.name.lower())
        if own is not None:
            test = _loses(F.col(f"`{own.name}`"), own.dataType, f.dataType)
            if own.dataType != f.dataType and not isinstance(f.dataType, StringType):
                lossy[f.name] = test
    # a union of days (several frames) runs this once for each; nothing is shuffled
    bad = reduce(lambda a, b: a | b, lossy.values(), F.lit(False))

    def converted(f: StructField) -> Column:
        own = have.get(f.name.lower())
        return (F.lit(None) if own is None else F.col(f"`{own.name}`")).try_cast(f.dataType).alias(f.name)

    rows = df.where(~bad).select(*[converted(f) for f in schema.fields])
    entries = [F.when(test, F.struct(F.lit(name).alias("column"),
                                     F.col(f"`{have[name.lower()].name}`").cast("string").alias("value"),
                                     F.lit(schema[name].dataType.simpleString()).alias("target")))
               for name, test in lossy.items()]
    kind = "array<struct<column:string,value:string,target:string>>"
    found = F.array_compact(F.array(*entries)) if entries else F.array().cast(kind)
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    rejects = (df.where(bad).select(whole.alias("row"), F.explode(found).alias("__r"))
               .select("row", "__r.column", "__r.value", "__r.target"))
    return Conformed(rows, rejects)


def conform_days(days: Sequence[DataFrame], schema: StructType | None = None) -> Conformed:
    """Several days in one schema: the declared one, or the narrowest that holds them all."""
    target = schema or common_schema(d.schema for d in days)
    parts = [conform(d, target) for d in days]
    return Conformed(reduce(DataFrame.unionByName, [p.rows for p in parts]),
                     reduce(DataFrame.unionByName, [p.rejects for p in parts]))


