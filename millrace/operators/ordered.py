"""Ordered computations that spread one key over tasks: values of whole buckets first, then rows inside a bucket.

A bucket is a coarser form of the order, so a key's rows are in as many tasks as it has buckets, and one task sees
a key whole only as one row for each bucket. ``stream_fold`` is for what depends on every row before it: rows of
a group pass one by one in order, so no group is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.shipping import ship

_FIRST = Window.unboundedPreceding


def _same(a: list[str], keys: list[str]) -> Column:
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return on


def _joined(rows: DataFrame, sums: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of one-row-per-bucket ``sums``; null keys are keys like others."""
    return rows.join(sums.withColumnsRenamed({c: f"_k_{c}" for c in keys}), _same(keys, keys)).drop(*[f"_k_{c}" for c in keys])


def running(df: DataFrame, by: list[str], bucket: Column, order: list, value: Column, name: str, how: str = "sum", own: bool = True) -> DataFrame:
    """``name``: the sum, or with ``how="max"`` the greatest, of ``value`` up to each row within ``by``; without the row itself if not ``own``."""
    agg = F.sum if how == "sum" else F.max
    both = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if how == "sum" else F.greatest
    rows, keys = df.withColumns({"_b": bucket, "_x": value}), [*by, "_b"]
    sums = rows.groupBy(*keys).agg(agg("_x").alias("_s"))
    sums = sums.select(*keys, agg("_s").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(_FIRST, -1)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(_FIRST, 0 if own else -1)
    out = _joined(rows.withColumn("_in", agg("_x").over(inside)), sums, keys)
    return out.withColumn(name, both(F.col("_in"), F.col("_before"))).drop("_in", "_before", "_b", "_x", "_s")


def neighbour(df: DataFrame, by: list[str], bucket: Column, order: list, value: Column, name: str, back: bool = True, own: bool = False) -> DataFrame:
    """``name``: the nearest ``value`` that is not NULL before (or after) each row in the order, or at the row if ``own``."""
    rows, keys = df.withColumns({"_b": bucket, "_x": value}), [*by, "_b"]
    inside = Window.partitionBy(*keys).orderBy(*order)
    here, there = (F.last, F.first) if back else (F.first, F.last)
    span = (_FIRST, 0 if own else -1) if back else (0 if own else 1, Window.unboundedFollowing)
    every = inside.rowsBetween(_FIRST, Window.unboundedFollowing)
    rows = rows.withColumns({"_in": here("_x", ignorenulls=True).over(inside.rowsBetween(*span)), "_edge": here("_x", ignorenulls=True).over(every), "_at": F.row_number().over(inside)})
    ends = rows.where("_at = 1").select(*keys, "_edge")  # one row for each bucket
    out_of = Window.partitionBy(*by).orderBy("_b").rowsBetween(*((_FIRST, -1) if back else (1, Window.unboundedFollowing)))
    ends = ends.select(*keys, here("_edge", ignorenulls=True).over(out_of).alias("_far"))
    return _joined(rows.drop("_edge", "_at"), ends, keys).withColumn(name, F.coalesce("_in", "_far")).drop("_in", "_far", "_b", "_x")


def stream_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``fold`` makes of each group's rows, which it gets in order and one by one: tuples of the columns of ``df``, keys first."""
    ship(df.sparkSession)
    names, width = [c.strip().split()[0] for c in schema.split(",")], len(keys)
    kind = {"STRING": pa.string(), "BIGINT": pa.int64(), "BOOLEAN": pa.bool_()}
    types = [kind[c.strip().split()[1]] for c in schema.split(",")]

    def go(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def groups():
            it = rows()
            head = next(it, None)
            while head is not None:
                key, held = head[:width], [head]

                def own():
                    nonlocal head
                    while held or head is not None:
                        if held:
                            yield held.pop()
                        head = next(it, None)
                        if head is None or head[:width] != key:
                            return
                        held.append(head)

                yield from fold(own())

        out = []

        def emit():
            cols = list(zip(*out)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for row in groups():
            out.append(row)
            if len(out) >= 10_000:
                yield emit()
                out.clear()
        yield emit()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(go, schema)
