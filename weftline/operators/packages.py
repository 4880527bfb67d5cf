"""The catalogue of tables and stored queries: searches, and what depends on what.

Packages: a table (id, name, description, owner, private). Uses: a table (user, used), a
stored query and a package that it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.stored import written

PAGE = 20


def search(packages: DataFrame, user: int, text: str | None = None, name: str | None = None, description: str | None = None, mine_only: bool = False, sort: tuple[str, bool] | None = None, page: int = 1) -> DataFrame:
    """A page of the packages that a user may see and whose fields contain the texts, in any case.

    ``text`` is looked for in name and description. Sorted by id unless ``sort`` names a
    column and whether it ascends.
    """
    def has(column: str, part: str):
        return F.coalesce(F.lower(column).contains(part.lower()), F.lit(False))

    rows = packages.where((F.col("owner") == user) | ~F.col("private"))
    if name is not None:
        rows = rows.where(has("name", name))
    if description is not None:
        rows = rows.where(has("description", description))
    if text is not None:
        rows = rows.where(has("name", text) | has("description", text))
    if mine_only:
        rows = rows.where(F.col("owner") == user)
    column, ascending = sort or ("id", True)
    order = F.col(column).asc_nulls_last() if ascending else F.col(column).desc_nulls_last()
    return rows.orderBy(order, "id").offset(PAGE * (page - 1)).limit(PAGE)


def _reached(uses: DataFrame, start: DataFrame, towards: str, by: str) -> DataFrame:
    """The ids that can be reached from those of ``start``, these included; a join a step, until nothing is new."""
    known = front = written(start.select("id").distinct(), "reached")
    while front.head(1):
        step = uses.join(front.withColumnRenamed("id", by), by).select(F.col(towards).alias("id")).distinct()
        front = written(step.join(known, "id", "left_anti"), "reached")
        known = known.union(front)
    return known


def dependants(uses: DataFrame, packages: DataFrame) -> DataFrame:
    """The ids of all stored queries that read any of ``packages`` (id), directly or through others."""
    return _reached(uses, packages, "user", "used").join(packages.select("id"), "id", "left_anti")


def sources_of(uses: DataFrame, package: int) -> DataFrame:
    """The ids of all that a stored query reads, itself included."""
    return _reached(uses, uses.sparkSession.createDataFrame([(package,)], "id long"), "used", "user")


def least_refresh(uses: DataFrame, refreshes: DataFrame, package: int) -> int | None:
    """The smallest refresh time, in seconds, of what a stored query reads; ``refreshes`` has (id, seconds)."""
    return sources_of(uses, package).join(refreshes, "id").agg(F.min("seconds")).first()[0]
