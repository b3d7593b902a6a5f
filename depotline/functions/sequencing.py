"""Skew-safe running aggregates.

A plain ``sum().over(Window.partitionBy(k).orderBy(o))`` sends every row of a
key to one task; when one key holds a third of the data that task holds a
third of the data.  These helpers compute the same prefix aggregates in two
levels:

1. rows are cut into buckets ``(key, o div width)``; each bucket is reduced to
   one partial value with a normal (map-side combined) ``groupBy``;
2. a window over the bucket partials of a key gives each bucket its offset
   (the window sees ``rows_of_key / width`` rows, not the rows themselves);
3. a window over ``(key, bucket)`` (at most ``width`` rows when ``o`` is unique
   per key) adds the offset to the local prefix.

The order column must be integral and non-negative; extra ``tiebreak`` columns
make the order total when it is not unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows per bucket when the order column is unique within its key.
DEFAULT_BUCKET_WIDTH = 1 << 18


def _bucket(order_col: str, width: int) -> Column:
    return F.expr(f"`{order_col}` div {int(width)}")


def running_aggs(df: DataFrame, keys: Sequence[str], order_col: str,
                 specs: Sequence[tuple], *, tiebreak: Sequence[str] = (),
                 width: int = DEFAULT_BUCKET_WIDTH, per_key: DataFrame | None = None) -> DataFrame:
    """Several prefix aggregates in one pass (one partial aggregation, one
    bucket window, one join, one local window).

    ``specs`` holds ``(value, out_col, agg, inclusive)`` with ``agg`` in
    ``sum``/``max``/``last``; ``last`` is the newest value that is not NULL, a struct that begins
    with the order columns (inclusive only); ``inclusive=False`` excludes the current row (empty
    prefix -> 0 for sum, NULL for max).  ``per_key`` (keys and more columns) is joined by the
    keys, as an inner join of the result would be, but to the partials, which are fewer.
    """
    keys = list(keys)
    fns = {"sum": F.sum, "max": F.max, "last": F.max}
    d = df.withColumn("_rb", _bucket(order_col, width))
    for n, (value, _out, _agg, _inc) in enumerate(specs):
        d = d.withColumn(f"_rv{n}", F.col(value) if isinstance(value, str) else value)
    part = d.groupBy(*keys, "_rb").agg(*[fns[a](f"_rv{n}").alias(f"_rp{n}")
                                         for n, (_v, _o, a, _i) in enumerate(specs)])
    wb = Window.partitionBy(*keys).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*keys, "_rb", *[fns[a](f"_rp{n}").over(wb).alias(f"_ro{n}")
                                       for n, (_v, _o, a, _i) in enumerate(specs)])
    if per_key is not None:  # a key's rows as one list, so that they don't repeat the rows of the windows
        more = [c for c in per_key.columns if c not in keys]
        part = part.join(per_key.groupBy(*keys).agg(F.collect_list(F.struct(*more)).alias("_rk")), keys, "inner")
    d = d.join(part, [*keys, "_rb"], "inner")
    order = Window.partitionBy(*keys, "_rb").orderBy(order_col, *tiebreak)
    drop = ["_rb"]
    for n, (_v, out, a, inc) in enumerate(specs):
        wl = order.rowsBetween(Window.unboundedPreceding, Window.currentRow if inc else -1)
        local = (F.last(f"_rv{n}", ignorenulls=True) if a == "last" else fns[a](f"_rv{n}")).over(wl)
        if a == "last":
            res = F.coalesce(local, F.col(f"_ro{n}"))
        elif a == "sum":
            res = F.coalesce(F.col(f"_ro{n}"), F.lit(0)) + F.coalesce(local, F.lit(0))
        else:
            res = F.greatest(F.col(f"_ro{n}"), local)  # greatest skips NULLs
        d = d.withColumn(out, res)
        drop += [f"_rv{n}", f"_ro{n}"]
    if per_key is not None:
        d = d.select("*", F.inline("_rk")).drop("_rk")
    return d.drop(*drop)


def running_agg(df: DataFrame, keys: Sequence[str], order_col: str, value: Column | str,
                out_col: str, *, agg: str = "sum", inclusive: bool = True,
                tiebreak: Sequence[str] = (), width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """Add ``out_col`` = prefix ``agg`` (``sum`` or ``max``) of ``value``."""
    return running_aggs(df, keys, order_col, [(value, out_col, agg, inclusive)],
                        tiebreak=tiebreak, width=width)


def running_max(df: DataFrame, keys: Sequence[str], order_col: str, value: Column | str,
                out_col: str, **kw) -> DataFrame:
    return running_agg(df, keys, order_col, value, out_col, agg="max", **kw)


def dense_number(df: DataFrame, keys: Sequence[str], order_col: str, out_col: str, *,
                 tiebreak: Sequence[str] = (), width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """``row_number()`` within ``keys`` ordered by ``order_col`` (1-based), skew-safe."""
    return running_agg(df, keys, order_col, F.lit(1).cast("long"), out_col,
                       tiebreak=tiebreak, width=width)
