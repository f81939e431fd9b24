"""Two order-dependent selections, exact for any group size.

``greedy_pairs``: walk candidate pairs in a total order and take a pair when both ends are still free.
``greedy_keep``: walk rows in a total order and keep a row when no kept row conflicts with it.

Bounded groups run as one fold inside Catalyst. A hot group is solved in rounds of joins and aggregates that give
the same answer: a pair (row) that comes first among everything it competes with can be taken at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from boxtrail.operators.skew import union_routes
from boxtrail.session import materialize


Conflict = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def _on(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on ``names`` with null equal to null, keeping one copy of them."""
    other = right.select(*[F.col(n).alias(f"_r_{n}") if n in names else F.col(n) for n in right.columns])
    same = [left[n].eqNullSafe(other[f"_r_{n}"]) for n in names]
    return left.join(other, same, how).drop(*[f"_r_{n}" for n in names])


def _progress(won: DataFrame) -> DataFrame:
    """Every round takes at least the first row of what is left; anything else would never end."""
    if won.isEmpty():
        raise RuntimeError("a selection round took no row: the order is not total or the cells are wrong")
    return won


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def fold_pairs(items: Column, kind: str, left: Callable[[Column], Column], right: Callable[[Column], Column], ltype: str, rtype: str) -> Column:
    """The taken ones of an array of pairs in their order; ``left`` and ``right`` read a pair's ends. A null end is never taken."""
    start = F.struct(_empty(ltype).alias("l"), _empty(rtype).alias("r"), _empty(kind).alias("t"))

    def step(acc, e):
        free = ~F.array_contains(acc["l"], left(e)) & ~F.array_contains(acc["r"], right(e))
        return F.when(
            free,
            F.struct(
                F.array_append(acc["l"], left(e)).alias("l"),
                F.array_append(acc["r"], right(e)).alias("r"),
                F.array_append(acc["t"], e).alias("t"),
            ),
        ).otherwise(acc)

    return F.aggregate(items, start, step)["t"]


def fold_keep(items: Column, kind: str, conflict: Conflict, seed: str | None = None, limit: int | None = None) -> Column:
    """The kept ones of an array of rows (their fields in ``v``) in their order."""

    def step(acc, e):
        new = e["v"]
        clash = F.exists(acc, lambda old: conflict(lambda c: old[c], lambda c: new[c]))
        take = ~clash if not seed else (new[seed] | ~clash)
        if limit:
            take = take & (F.size(acc) < limit)
        return F.when(take, F.array_append(acc, new)).otherwise(acc)

    return F.aggregate(items, _empty(kind), step)


def greedy_pairs(edges: DataFrame, keys: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """Accepted rows of ``edges`` (keys, left, right, order columns). ``order`` must be total within a group."""
    cols = list(dict.fromkeys([*order, left, right]))
    item = F.struct(*[F.col(c) for c in cols])
    ltype, rtype = (edges.schema[c].dataType.simpleString() for c in (left, right))
    shape = ",".join(f"{c}:{edges.schema[c].dataType.simpleString()}" for c in cols)

    def fold(rows):
        packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_e"))
        found = fold_pairs(F.col("_e"), f"struct<{shape}>", lambda e: e[left], lambda e: e[right], ltype, rtype)
        taken = packed.select(*keys, F.explode(found).alias("_t"))
        return taken.select(*keys, *[F.col(f"_t.{c}").alias(c) for c in cols])

    def rounds(rows):
        # A pair with a null end is never taken, as in the fold.
        rest = materialize(rows.select(*keys, *cols).where(F.col(left).isNotNull() & F.col(right).isNotNull()))
        taken = None
        while rest.take(1):
            first_l = rest.groupBy(*keys, left).agg(F.min(item).alias("_bl"))
            first_r = rest.groupBy(*keys, right).agg(F.min(item).alias("_br"))
            # An edge wins when it is the first one at both of its ends.
            both = _on(first_l.select(*keys, F.col("_bl").alias("_b")), first_r.select(*keys, F.col("_br").alias("_b")), [*keys, "_b"], "inner")
            won = _progress(materialize(both.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in cols])))
            taken = won if taken is None else taken.unionByName(won)
            rest = _on(rest, won.select(*keys, left), [*keys, left], "left_anti")
            rest = materialize(_on(rest, won.select(*keys, right), [*keys, right], "left_anti"))
        return (rest if taken is None else taken).select(*keys, *cols)

    # Edges come out of a join: write them once, so that counting group sizes does not run the join a second time.
    return union_routes(materialize(edges.select(*keys, *cols)), keys, fold, rounds)


def greedy_keep(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    fields: list[str],
    conflict: Conflict,
    cells: Column,
    seed: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Kept rows (keys, order, fields). ``order`` is ascending and total within a group.

    ``conflict(kept, row)`` gets two field readers. ``cells`` is an array column such that two rows in conflict
    always share a cell. Rows with a true ``seed`` column are kept unconditionally and block the others.
    ``limit`` is the operator's own maximum number of kept rows per group.
    """
    extra = [seed] if seed else []
    cols = list(dict.fromkeys([*extra, *order, *fields]))
    # Seeds sort first, so they are in place before any other row is looked at.
    rank = ([F.col(seed).cast("int") * -1] if seed else []) + [F.col(o) for o in order]
    item = F.struct(F.struct(*[r.alias(f"o{i}") for i, r in enumerate(rank)]).alias("o"), F.struct(*cols).alias("v"))

    def fold(df):
        shape = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in cols)
        packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_e"))
        found = fold_keep(F.col("_e"), f"struct<{shape}>", conflict, seed, limit)
        kept = packed.select(*keys, F.explode(found).alias("_t"))
        return kept.select(*keys, *[F.col(f"_t.{c}").alias(c) for c in cols])

    def rounds(df):
        """Each round keeps rows that are first in every cell they touch, then drops what those suppress.

        A cell has at most one new kept row per round, so the join never forms all pairs of a cell.
        """
        base = df.select(*keys, *cols, cells.alias("_cells"), item["o"].alias("_o"))
        rest = materialize(base)
        # A row without cells (a null box) conflicts with nothing and is kept at once.
        placed = F.coalesce(F.size("_cells") > 0, F.lit(False))
        taken = rest.filter(~placed)
        rest = rest.filter(placed)
        if seed:
            taken = taken.unionByName(rest.filter(F.col(seed)))
            rest = materialize(_suppress(rest.filter(~F.col(seed)), rest.filter(F.col(seed))))
        while rest.take(1):
            spots = rest.select(*keys, "_o", "_cells", F.explode("_cells").alias("_cell"))
            lead = spots.groupBy(*keys, "_cell").agg(F.min("_o").alias("_lead"))
            held = lead.groupBy(*keys, F.col("_lead").alias("_o")).agg(F.count(F.lit(1)).alias("_held"))
            won = _on(rest, held, [*keys, "_o"], "inner").filter(F.col("_held") == F.size(F.array_distinct("_cells")))
            won = _progress(materialize(won.drop("_held")))
            taken = taken.unionByName(won)
            rest = _on(rest, won.select(*keys, "_o"), [*keys, "_o"], "left_anti")
            rest = materialize(_suppress(rest, won))
        out = taken.select(*keys, *cols)
        return _first_n(out) if limit else out

    def _suppress(rest, kept):
        a = rest.select(*keys, *cols, "_o", F.explode("_cells").alias("_cell")).alias("a")
        b = kept.select(*keys, *cols, F.explode("_cells").alias("_cell")).alias("b")
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_cell"]]
        clash = conflict(lambda c: F.col(f"b.{c}"), lambda c: F.col(f"a.{c}"))
        gone = a.join(b, [*on, clash], "left_semi").select(*[f"a.{k}" for k in keys], "a._o").distinct()
        return _on(rest, gone, [*keys, "_o"], "left_anti")

    def _first_n(df):
        from boxtrail.operators.ordered import indexed

        return indexed(df, keys, [*([F.col(seed).cast("int") * -1] if seed else []), *order], "_n").filter(
            F.col("_n") <= limit
        ).drop("_n")

    need = list(dict.fromkeys([*keys, *cols]))
    slim = rows.select(*need)
    return union_routes(slim, keys, fold, rounds)


def box_cells(size: float) -> Column:
    """Cells covered by x1..y2: two boxes that overlap always share one."""

    def span(lo, hi):
        return F.sequence(F.floor(F.col(lo) / size), F.floor(F.greatest(F.col(lo), F.col(hi)) / size))

    return F.flatten(F.transform(span("x1", "x2"), lambda x: F.transform(span("y1", "y2"), lambda y: F.struct(x, y))))


def disc_cells(x: str, y: str, reach: float) -> Column:
    """Cells of side ``reach`` around a point: two points nearer than ``reach`` always share one."""

    def near(c):
        base = F.floor(F.col(c) / reach)
        return F.sequence(base, base + 1)

    return F.flatten(F.transform(near(x), lambda a: F.transform(near(y), lambda b: F.struct(a, b))))
