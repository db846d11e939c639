"""Joins on keys of which some may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _heavy(classes: DataFrame, count: str):
    total = classes.agg(F.sum(count)).first()[0] or 0
    return F.col(count) * 1000 > total


def with_classes(rows: DataFrame, classes: DataFrame, key: Sequence[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``classes``, which has one row for each ``key`` and in ``count`` how many of the rows have it.

    A key of more than a thousandth of all rows would be one large task. There are at most a thousand such keys, by
    arithmetic, so theirs are broadcast; the others meet in a shuffle. Both tables are read twice and should be stored.
    """
    heavy = _heavy(classes, count)
    many, few = F.broadcast(classes.filter(heavy).drop(count)), classes.filter(~heavy).drop(count)
    rest = rows.join(F.broadcast(classes.filter(heavy).select(*key)), list(key), "left_anti")
    return rows.join(many, list(key)).unionByName(rest.join(few, list(key)))


def outside_classes(rows: DataFrame, classes: DataFrame, key: Sequence[str], count: str) -> DataFrame:
    """Rows whose key is not in ``classes``; as in :func:`with_classes` no large group of rows is shuffled by its key."""
    heavy = _heavy(classes, count)
    rest = rows.join(F.broadcast(classes.filter(heavy).select(*key)), list(key), "left_anti")
    return rest.join(classes.filter(~heavy).select(*key), list(key), "left_anti")
