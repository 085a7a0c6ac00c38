"""Order-dependent columns without one task per series.

A series is cut into chunks of its order key. Each chunk runs its own window; one summary row per chunk
carries what the chunks before it add. Only summaries meet in one task per series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Order-key width of a chunk.
CHUNK = 65536

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


def unused(columns: list[str], *names: str) -> list[str]:
    """Column names like those given that none of the columns has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def running_all(df: DataFrame, specs: dict[str, tuple[str, Column, bool]], *, order: list[str], keys: list[str] = (), chunk: int = CHUNK, chunk_by: Column | None = None) -> DataFrame:
    """Adds a column for each name: (what, value, before) in specs, all in one pass over chunks.

    what: the running max, min, sum, or last non-null of value over `order`; before: up to the row before
    instead of the row itself. order[0] must be an integer key that chunks can be cut by, unless chunk_by gives
    another non-decreasing one; the rest of `order` breaks ties. Every row stays, those with a null key or order key too.
    """
    keys, names = list(keys), list(specs)
    columns = [c for c in df.columns if c not in names]  # a name that the input has is replaced
    part, *own = unused([*df.columns, *names], "chunk", *[f"{k}{i}" for k in ("value", "sum", "carry", "local") for i in range(len(names))])
    v, s, c, here = (own[k * len(names) : (k + 1) * len(names)] for k in range(4))
    df = df.withColumns({v[i]: specs[n][1] for i, n in enumerate(names)} | {part: F.floor((F.col(order[0]) if chunk_by is None else chunk_by) / chunk)})
    prior = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sums, carries, local, both = [], [], {}, {}
    for i, name in enumerate(names):
        what, _, before = specs[name]
        rows = W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
        if what == "last":
            sums.append(F.max_by(v[i], F.when(F.col(v[i]).isNotNull(), F.struct(*order))).alias(s[i]))
            carries.append(F.last(s[i], ignorenulls=True).over(prior).alias(c[i]))
            local[here[i]] = F.last(v[i], ignorenulls=True).over(rows)
            both[name] = F.coalesce(F.col(here[i]), F.col(c[i]))
        else:
            sums.append(_AGG[what](v[i]).alias(s[i]))
            carries.append(_AGG[what](s[i]).over(prior).alias(c[i]))
            local[here[i]] = _AGG[what](v[i]).over(rows)
            both[name] = F.coalesce(F.col(here[i]), F.lit(0)) + F.coalesce(F.col(c[i]), F.lit(0)) if what == "sum" else (F.greatest if what == "max" else F.least)(F.col(here[i]), F.col(c[i]))
    # A null key is a series of its own and rows without an order key come first, so nulls must meet.
    summary = df.groupBy(*keys, part).agg(*sums).select(*keys, part, *carries)
    same = [*keys, part]
    x, y = df.withColumns(local).alias("x"), summary.alias("y")
    on = reduce(lambda p, q: p & q, [F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`")) for k in same])
    out = x.join(y, on).select("x.*", *[F.col(f"y.`{k}`") for k in c]).withColumns(both)
    return out.select(*[F.col(f"`{k}`") for k in [*columns, *names]])


def running(df: DataFrame, what: str, value: Column, name: str, *, before: bool = False, **where) -> DataFrame:
    """Adds `name`: one running aggregate; see running_all."""
    return running_all(df, {name: (what, value, before)}, **where)


def previous(df: DataFrame, value: Column, name: str, **where) -> DataFrame:
    """Adds `name`: the last non-null value before the row."""
    return running(df, "last", value, name, before=True, **where)
