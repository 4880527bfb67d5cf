"""Relational operators with the transformation language's rules for nulls, names and types.

All lower to plain DataFrame plans; only a union of geometries, a page's totals and a
join of repeated keys run a job. A predicate that a null
makes unknown keeps no row and takes no branch, just as a false one; so those without
a negation are left as they are, and their comparisons reach the scan. Only the
negations need the null made false first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import geometry


#: Rows that a task of ``join_repeated`` makes, about.
TASK_ROWS = 1 << 23


class QueryError(ValueError):
    """A query that can't be run, found before any job starts."""


def equal(a: Column, b: Column) -> Column:
    """Holds nowhere where either side is null."""
    return a == b


def not_equal(a: Column, b: Column) -> Column:
    """The complement of ``equal``: true where either side is null."""
    return ~F.coalesce(a == b, F.lit(False))


def compare(a: Column, operator: str, b: Column) -> Column:
    """``<``, ``<=``, ``>`` or ``>=``; holds nowhere where either side is null."""
    made = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
    if operator not in made:
        raise QueryError(f"unknown comparison {operator}")
    return made[operator]


def like(a: Column, pattern: str, negated: bool = False) -> Column:
    """Whether a regular expression is found anywhere in the text; null is neither like nor not like it."""
    found = a.rlike(pattern)
    return ~found if negated else found


def in_list(a: Column, *values: Column) -> Column:
    """Equal to any of the values; a null never is."""
    return reduce(lambda x, y: x | y, (equal(a, v) for v in values), F.lit(False))


def not_in_list(a: Column, *values: Column) -> Column:
    return ~F.coalesce(reduce(lambda x, y: x | y, (F.coalesce(equal(a, v), F.lit(False)) for v in values), F.lit(False)), F.lit(False))


def holds(condition: Column, negated: bool = False) -> Column:
    """A function's result as a predicate: null doesn't hold, and its negation does."""
    held = condition.cast("boolean")
    return ~F.coalesce(held, F.lit(False)) if negated else held


def case(rows: DataFrame, branches: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first branch whose condition holds; all values must have one type."""
    values = [v for _, v in branches] + ([] if otherwise is None else [otherwise])
    kinds = {f.dataType.simpleString() for f in rows.select(*(v.alias(f"v{i}") for i, v in enumerate(values))).schema}
    if len(kinds) > 1:
        raise QueryError(f"branches of different types: {', '.join(sorted(kinds))}")
    out = F
    for condition, value in branches:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def project(rows: DataFrame, *columns: tuple[str, Column]) -> DataFrame:
    """Named columns; a name that repeats gets the next free number."""
    taken: set[str] = set()
    out = []
    for name, column in columns:
        unique, n = name, 1
        while unique.lower() in taken:
            n += 1
            unique = f"{name}{n}"
        taken.add(unique.lower())
        out.append(column.alias(unique))
    return rows.select(*out)


def prefixed(rows: DataFrame, alias: str) -> DataFrame:
    """A source under its alias: each column's name follows the alias and a dot's stand-in."""
    return rows.select(*(F.col(f"`{c}`").alias(f"{alias}__{c}") for c in rows.columns))


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[Column, Column]], how: str = "inner") -> DataFrame:
    """Equi-join over pairs of expressions; null keys match one another.

    Null-safe equality stays an equi-join for the planner, so hash and merge joins,
    and their handling of skew, remain open.
    """
    if how not in ("inner", "left", "right", "full"):
        raise QueryError(f"unknown join {how}")
    if not on:
        raise QueryError("a join needs a condition")
    return left.join(right, reduce(lambda x, y: x & y, (a.eqNullSafe(b) for a, b in on)), how)


def join_repeated(left: DataFrame, right: DataFrame, on: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Inner ``join`` for keys that repeat on both sides, so that the result can be far larger than its inputs.

    Spark sizes tasks by what they read. Here one job counts the pairs first, and as many
    tasks share them as ``TASK_ROWS`` asks for. A key of more pairs is cut into tiles:
    its rows of each side are dealt into runs, and each run of one side meets each of the
    other. Rows of keys that the other side lacks fall out before. Rows are dealt by
    their place in the partitions they are read from.
    """
    mark = "_" * (1 + max(map(len, left.columns + right.columns)))
    key, tile, place, across, down = (f"{mark}{n}" for n in ("key", "tile", "place", "across", "down"))
    spots = f"{mark}spot_a", f"{mark}spot_b"
    sides = [rows.withColumn(key, F.struct(*(pair[s].alias(f"k{i}") for i, pair in enumerate(on)))) for s, rows in enumerate((left, right))]
    n, m = (rows.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias(name)) for rows, name in zip(sides, (across, down), strict=True))
    sizes, pairs = n.join(m, key), F.col(across) * F.col(down)
    total = sizes.agg(F.sum(pairs)).first()[0] or 0
    if total <= TASK_ROWS:
        return join(left, right, on)
    run = math.isqrt(TASK_ROWS)
    runs = sizes.select(key, *(F.when(pairs > TASK_ROWS, F.ceil(F.col(c) / run)).otherwise(1).alias(c) for c in (across, down)))

    def dealt(rows: DataFrame, own: str, other: str, tiled: Callable[[Column, Column], Column], spot: str) -> DataFrame:
        rows = rows.withColumn(place, F.xxhash64(F.monotonically_increasing_id())).join(runs, key)
        rows = rows.withColumn(tile, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        rows = rows.withColumn(spot, F.struct(key, tiled(F.pmod(place, own), F.col(tile)).alias("tile"))).drop(key, tile, place, across, down)
        return rows.repartition(math.ceil(2 * total / TASK_ROWS), spot)

    a = dealt(sides[0], across, down, lambda mine, met: mine * F.col(down) + met, spots[0])
    b = dealt(sides[1], down, across, lambda mine, met: met * F.col(down) + mine, spots[1])
    return a.join(b.hint("merge"), F.col(spots[0]) == F.col(spots[1])).drop(*spots)


def _one_srid(rows: DataFrame, name: str) -> int | None:
    """The reference system of a geometry column; none if it has no geometries."""
    found = rows.agg(F.min(f"`{name}`.srid").alias("low"), F.max(f"`{name}`.srid").alias("high"), F.bool_or(F.col(f"`{name}`").isNotNull() & F.col(f"`{name}`.srid").isNull()).alias("none")).first()
    if found["none"]:
        raise QueryError(f'"{name}" has geometries without a reference system')
    if found["low"] != found["high"]:
        raise QueryError(f'"{name}" has geometries in several reference systems')
    return found["low"]


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows by position under the first one's names; counts and types must agree.

    Geometries of the others are brought into the reference system of the first one's,
    which one aggregate over its column finds; one without a system is an error.
    """
    kinds = [f.dataType for f in first.schema]
    shapes = [i for i, (_, kind) in enumerate(first.dtypes) if geometry.is_geometry(kind)]
    for other in others:
        if [f.dataType for f in other.schema] != kinds:
            raise QueryError(f"union of {first.schema.simpleString()} and {other.schema.simpleString()}")
    systems = {i: _one_srid(first, first.columns[i]) for i in shapes} if others else {}
    out = first
    for other in others:
        columns = [F.col(f"`{name}`") for name in other.columns]
        out = out.union(other.select(*(geometry.transform(x, systems[i]).alias(n) if systems.get(i) else x for i, (x, n) in enumerate(zip(columns, other.columns, strict=True)))))
    return out


def order_by(rows: DataFrame, *keys: tuple[int | str | Column, bool]) -> DataFrame:
    """Sorted by position (from 1), name or expression, each ascending or not; nulls are last either way."""
    out = []
    for key, ascending in keys:
        if isinstance(key, int):
            if not 1 <= key <= len(rows.columns):
                raise QueryError(f"there is no column {key}")
            key = F.col(f"`{rows.columns[key - 1]}`")
        elif isinstance(key, str):
            if key.lower() not in {c.lower() for c in rows.columns}:
                raise QueryError(f'column "{key}" does not exist')
            key = F.col(f"`{key}`")
        out.append(key.asc_nulls_last() if ascending else key.desc_nulls_last())
    return rows.orderBy(*out)


def preview(rows: DataFrame, count: int = 3, page: int = 1) -> DataFrame:
    """One page of a result as text, nulls shown as NULL."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) for c in rows.columns]
    return rows.offset(count * (page - 1)).limit(count).select(*text)


def preview_with_totals(rows: DataFrame, count: int = 3, page: int = 1) -> tuple[DataFrame, int, dict[str, str]]:
    """A page, the number of all rows, and each column's type."""
    return preview(rows, count, page), rows.count(), dict(rows.dtypes)
