"""Scans over the rows of a part in order, of which no task holds a whole part.

Rows are dealt to ranges of the order; windows run inside a range. What a range needs from those before and behind - their sums, the last row before it, the first one behind - comes from one row a range, over which a second window
runs. The first step is written once, so nothing before it is computed twice. Parts and orders have no nulls; the order is total, or rows that tie are alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.tables import keep

RANGE = 1 << 16  # of the first column of an order
Columns = dict[str, Column]


def range_of(order: list[str], width: int = RANGE) -> list[Column]:
    return [F.floor(F.col(order[0]) / width)]


def carried(rows: DataFrame, part: list[str], order: list[str], sums: Columns | None = None, before: Columns | None = None, after: Columns | None = None, most: Columns | None = None, latest: Columns | None = None, coming: Columns | None = None, width: int = RANGE, ranges: list[Column] | None = None) -> DataFrame:
    """rows with new columns, each of an expression over rows.

    sums: its sum over the rows of the part up to this one; before and after: its value in the row before and behind (null where there is none); most: its largest value in the rows before; latest and coming: its last value that isn't null up
    to this row, and the first one from this row on. ranges: expressions that never fall along the order; if none are given, ranges of the first order column of this width."""
    asked = {"sum": sums or {}, "before": before or {}, "after": after or {}, "most": most or {}, "latest": latest or {}, "coming": coming or {}}
    ranges = ranges or range_of(order, width)
    keys = [f"_range{i}" for i in range(len(ranges))]
    w = Window.partitionBy(*part, *keys).orderBy(*order)
    back = Window.partitionBy(*part, *keys).orderBy(*[F.desc(c) for c in order])
    place = F.struct(*order)
    box = lambda e: F.struct(e.alias("v"))  # noqa: E731  so that a null value isn't taken for no row
    held = lambda e: F.when(e.isNotNull(), place)
    grows = lambda x: x.rowsBetween(Window.unboundedPreceding, 0)
    local = {
        "sum": lambda e: F.coalesce(F.sum(e).over(grows(w)), F.lit(0)),
        "before": lambda e: F.lag(box(e)).over(w),
        "after": lambda e: F.lead(box(e)).over(w),
        "most": lambda e: F.max(e).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "latest": lambda e: F.last(e, ignorenulls=True).over(grows(w)),
        "coming": lambda e: F.last(e, ignorenulls=True).over(grows(back)),
    }
    own = {
        "sum": lambda e: F.coalesce(F.sum(e), F.lit(0)),
        "before": lambda e: F.max_by(box(e), place),
        "after": lambda e: F.min_by(box(e), place),
        "most": F.max,
        "latest": lambda e: F.max_by(e, held(e)),
        "coming": lambda e: F.min_by(e, held(e)),
    }
    across, beyond = Window.partitionBy(*part).orderBy(*keys), Window.partitionBy(*part).orderBy(*[F.desc(k) for k in keys])
    earlier = lambda x: x.rowsBetween(Window.unboundedPreceding, -1)
    over_ranges = {
        "sum": lambda c: F.coalesce(F.sum(c).over(earlier(across)), F.lit(0)),
        "before": lambda c: F.lag(c).over(across),
        "after": lambda c: F.lead(c).over(across),
        "most": lambda c: F.max(c).over(earlier(across)),
        "latest": lambda c: F.last(c, ignorenulls=True).over(earlier(across)),
        "coming": lambda c: F.last(c, ignorenulls=True).over(earlier(beyond)),
    }
    joined = {
        "sum": lambda x, e: x + e,
        "before": lambda x, e: F.coalesce(x, e)["v"],
        "after": lambda x, e: F.coalesce(x, e)["v"],
        "most": F.greatest,
        "latest": F.coalesce,
        "coming": F.coalesce,
    }
    each = [(kind, name, e, f"_own_{kind}_{name}", f"_edge_{kind}_{name}") for kind, of in asked.items() for name, e in of.items()]
    dealt = rows.withColumns(dict(zip(keys, ranges, strict=True)))
    kept = keep(dealt.withColumns({x: local[kind](e) for kind, _, e, x, _ in each}), "scan")
    edges = kept.groupBy(*part, *keys).agg(*[own[kind](e).alias(edge) for kind, _, e, _, edge in each])
    edges = edges.withColumns({edge: over_ranges[kind](F.col(edge)) for kind, _, _, _, edge in each})
    names = {name for _, name, *_ in each}
    return kept.join(edges, [*part, *keys]).select(*[c for c in rows.columns if c not in names], *[joined[kind](F.col(x), F.col(edge)).alias(name) for kind, name, _, x, edge in each])


def numbered(rows: DataFrame, part: list[str], order: list[str], name: str, width: int = RANGE) -> DataFrame:
    """rows with their numbers from 1 in each part."""
    return carried(rows, part, order, sums={name: F.lit(1)}, width=width)


def nearby(rows: DataFrame, part: list[str], index: str, reach: int, columns: dict, width: int = RANGE) -> DataFrame:
    """rows with columns that are functions of a window over the rows whose index is within reach: name -> function of Window.rangeBetween's window. Rows are copied to the ranges that they reach."""
    i = F.col(index)
    at = lambda x: F.floor(x / width)
    dealt = rows.withColumn("_own", at(i)).withColumn("_range", F.explode(F.sequence(at(i - reach), at(i + reach))))
    w = Window.partitionBy(*part, "_range").orderBy(index)
    return dealt.withColumns({n: f(w) for n, f in columns.items()}).where("_range = _own").drop("_range", "_own")
