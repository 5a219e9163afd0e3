"""Set-based building blocks that stay safe when one key holds most of the rows.

* ``latest`` is an aggregate (``max_by``), so it combines on the map side.
* ``first_rows`` is ``row_number() <= k``.  Catalyst plans it with a
  WindowGroupLimit below the exchange: a map task ships at most k rows per key.
* ``running`` is a two-level scan.  Rows of one key are cut into chunks that
  follow the order; a chunk's total is aggregated first, the totals are scanned
  (one row per chunk), and each chunk is then scanned in its own task with the
  carried-in value.  No task holds all rows of a hot key, but one does scan all
  of its chunk totals, so chunks should not be too small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column], cols: list[str] | None = None) -> DataFrame:
    """The row with the greatest ``order`` per key, by aggregation.

    Order columns must not all be nullable: a null part ranks lowest.
    """
    cols = cols or [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*cols), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    out = df.groupBy(*keys).agg(best.alias("_best"))
    return out.select(*keys, *[F.col("_best")[c].alias(c) for c in cols])


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int = 1,
               rank: str | None = None) -> DataFrame:
    """The first k rows per key in ``order``; ``rank`` keeps the position."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str],
                  arrival: list[Column], nullsafe: bool = False) -> DataFrame:
    """Incoming rows whose key is not held yet; the first arrival of a key wins."""
    fresh = first_rows(incoming, keys, arrival)
    held = existing.select(*keys).distinct()
    return anti(fresh, held, keys, nullsafe)


def anti(left: DataFrame, right: DataFrame, keys: list[str], nullsafe: bool = False) -> DataFrame:
    return _exist_join(left, right, keys, nullsafe, "left_anti")


def semi(left: DataFrame, right: DataFrame, keys: list[str], nullsafe: bool = False) -> DataFrame:
    return _exist_join(left, right, keys, nullsafe, "left_semi")


def _exist_join(left, right, keys, nullsafe, how):
    if not nullsafe:
        return left.join(right.select(*keys), keys, how)
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how)


def flag_in(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a boolean: is this row's key present on the right?"""
    mark = right.select(*keys).distinct().withColumn(name, F.lit(True))
    return left.join(mark, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


@dataclass(frozen=True)
class Scan:
    """One running value: ``how`` is max, min, sum or last.

    ``whole`` gives the value over the whole key instead, out of the same totals.
    """
    name: str
    how: str
    value: Column
    inclusive: bool = True
    backward: bool = False
    whole: bool = False


def running(df: DataFrame, keys: list[str], chunk: Column, order: list[str], scans: list[Scan]) -> DataFrame:
    """Running values per key over ``order`` (a total order), cut at ``chunk``.

    ``chunk`` must not decrease along ``order``.  ``last`` carries the previous
    non-null value, i.e. an exclusive ``last`` is a lag.
    """
    src = df.select("*", chunk.alias("_chunk"))

    def part(s):
        v = s.value
        if s.how == "last":
            pos = F.struct(*order)
            by = F.min_by if s.backward else F.max_by
            return by(v, F.when(v.isNotNull(), pos))
        return {"max": F.max, "min": F.min, "sum": F.sum}[s.how](v)

    totals = src.groupBy(*keys, "_chunk").agg(*[part(s).alias(f"_t_{s.name}") for s in scans])
    by_chunk = Window.partitionBy(*keys)

    def carried(s):
        w = by_chunk.orderBy(F.col("_chunk").desc() if s.backward else F.col("_chunk"))
        w = by_chunk if s.whole else w.rowsBetween(Window.unboundedPreceding, -1)
        t = F.col(f"_t_{s.name}")
        if s.how == "last":
            return F.last(t, ignorenulls=True).over(w)
        return {"max": F.max, "min": F.min, "sum": F.sum}[s.how](t).over(w)

    carry = totals.select(*keys, "_chunk", *[carried(s).alias(f"_c_{s.name}") for s in scans])
    in_chunk = Window.partitionBy(*keys, "_chunk")

    def value(s):
        cols = [F.col(o).desc() if s.backward else F.col(o) for o in order]
        w = in_chunk.orderBy(*cols).rowsBetween(
            Window.unboundedPreceding, Window.currentRow if s.inclusive else -1)
        v, c = F.col(f"_v_{s.name}"), F.col(f"_c_{s.name}")
        if s.whole:
            return c
        if s.how == "last":
            return F.coalesce(F.last(v, ignorenulls=True).over(w), c)
        if s.how == "sum":
            local = F.sum(v).over(w)
            return F.when(local.isNotNull() | c.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(c, F.lit(0)))
        pick = F.greatest if s.how == "max" else F.least
        return pick(c, {"max": F.max, "min": F.min}[s.how](v).over(w))

    # values are made again behind the join: they need not be shuffled beside the columns that they come from
    joined = src.join(carry, [*keys, "_chunk"]).withColumns({f"_v_{s.name}": s.value for s in scans})
    return joined.select(*df.columns, *[value(s).alias(s.name) for s in scans])


def coalescing_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], cols: list[str],
                      seq: str) -> DataFrame:
    """Per key, the newest non-null value of every column; null keys are equal.

    Existing rows carry a lower ``seq`` than incoming ones, so a null never blanks
    a stored value and several incoming rows of one key fold in arrival order.
    """
    both = existing.select(*keys, *cols, seq).unionByName(incoming.select(*keys, *cols, seq))
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols]
    return both.groupBy(*keys).agg(*aggs)
