"""Conversion functions and row numbers of the transformation language."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType
from pyspark.sql.window import Window

from weftline.functions.text import date_pattern
from weftline.stored import written

_INTEGERS = {"INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint"}


def nvl(value: Column, other: Column, value_type: DataType, other_type: DataType) -> Column:
    """``other`` where ``value`` is null; of different kinds both become text."""
    alike = value_type == other_type or (isinstance(value_type, NumericType) and isinstance(other_type, NumericType))
    return F.coalesce(value, other) if alike else F.coalesce(value.cast("string"), other.cast("string"))


def round_(value: Column, decimals: int) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(value, decimals)


def cast(value: Column, source: DataType, target: str) -> Column:
    """A value as INTEGER, BIGINT, SMALLINT, FLOAT, BOOLEAN, TEXT or DATETIME (from seconds since 1970)."""
    target = target.upper()
    if target in _INTEGERS:
        whole = isinstance(source, NumericType) and source.typeName() in ("byte", "short", "integer", "long")
        return (value if whole else value.cast("double")).cast(_INTEGERS[target])
    if target == "FLOAT":
        return value.cast("double")
    if target == "TEXT":
        return value.cast("string")
    if target == "BOOLEAN":
        return F.length(value) > 0 if isinstance(source, StringType) else value.cast("double") != 0
    if target == "DATETIME":
        if not isinstance(source, NumericType):
            raise ValueError("only numbers become DATETIME; texts take to_date")
        return F.timestamp_seconds(value).cast("timestamp_ntz")
    raise ValueError(f"unknown type {target}")


def to_date(value: Column, strftime: str | None = None) -> Column:
    """A text as a timestamp; null where it isn't one."""
    parsed = F.try_to_timestamp(value) if strftime is None else F.try_to_timestamp(value, F.lit(date_pattern(strftime, lenient=True)))
    return parsed.cast("timestamp_ntz")


def numbered(rows: DataFrame, name: str, start: int = 1, step: int = 1) -> DataFrame:
    """``rows`` numbered in the order that they have.

    They are written once to the shared folder with the place of each in its partition;
    so the order is fixed before it is read twice, for the partitions' counts and for the
    numbers. Only the counts meet in one place.
    """
    place = _free("place", [*rows.columns, name])
    stored = written(rows.withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(place, 33).alias("part")
    counts = stored.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("part").alias(_free("part", [*stored.columns, name])), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(_free("before", [*stored.columns, name])))
    out = stored.join(first, F.shiftright(place, 33) == F.col(first.columns[0]))
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, (start + step * (F.col(first.columns[1]) + within)).cast("bigint")).drop(place, *first.columns)


def _free(stem: str, names: Sequence[str]) -> str:
    """A column name that isn't among ``names``."""
    taken = {c.lower() for c in names}
    return next(name for name in (stem + "_" * n for n in range(len(taken) + 1)) if name.lower() not in taken)


def with_range(rows: DataFrame, name: str, order: Sequence[str | Column], start: int = 1, step: int = 1) -> DataFrame:
    """``rows`` numbered along ``order``: one sort, at any size."""
    return numbered(rows.orderBy(*order), name, start, step)
