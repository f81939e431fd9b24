"""Fold-style custom aggregates that stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def fold(fields: list[str], start: Column, step: Callable[[Column, Column], Column], order: list[str] | None = None) -> Column:
    """An aggregate that walks a group's rows: sorted by ``order`` when given, in any order otherwise.

    A group is held as one array, so use it on groups of bounded size (see ``operators.skew`` for the others).
    """
    item = F.struct(*[F.col(c) for c in [*(order or []), *[f for f in fields if f not in (order or [])]]])
    rows = F.collect_list(item)
    return F.aggregate(F.sort_array(rows) if order else rows, start, step)
