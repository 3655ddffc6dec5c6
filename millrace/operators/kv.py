"""Key-value commands: ordered folds, compare-and-set, effects of settlements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordered import running, stream_fold


SEQ_BUCKET = 4096


def fold(cmds: DataFrame) -> DataFrame:
    """``cmds(key, seq, op, expected, value)``, applied in order for each key.

    ``op``: put, delete, cas (put if the value equals ``expected``, NULL: absent) or cad (delete if it
    does). A put or a delete needs no earlier state, so each begins a segment of its key; segments are numbered by
    running sums over buckets of ``seq`` and spread over the cluster, and the rows of one pass in order, one by one.
    Rows (key, value, applied, refused).
    """
    rows = cmds.select("key", "seq", "op", "expected", "value")
    parts = running(rows, ["key"], F.expr(f"seq div {SEQ_BUCKET}"), ["seq"], F.col("op").isin("put", "delete").cast("bigint"), "seg")

    def apply(rows):
        value, applied, refused = None, 0, 0
        for key, seg, _, op, expected, new in rows:
            if op in ("put", "delete") or value == expected:
                value, applied = new if op in ("put", "cas") else None, applied + 1
            else:
                refused += 1
        yield key, seg, value, applied, refused

    done = stream_fold(parts.select("key", "seg", "seq", "op", "expected", "value"), ["key", "seg"], ["seq"], apply, "key STRING, seg BIGINT, value STRING, applied BIGINT, refused BIGINT")
    last = F.max(F.struct("seg", "value"))["value"]
    return done.groupBy("key").agg(last.alias("value"), F.sum("applied").alias("applied"), F.sum("refused").alias("refused"))


def conflicts(ops: DataFrame) -> DataFrame:
    """``ops(run_id, key, seq, op)``: operations on a key that an earlier one of the other kind staged."""
    w = Window.partitionBy("run_id", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    other = F.when(F.col("op") == "put", F.max(F.when(F.col("op") == "delete", 1)).over(w)).otherwise(F.max(F.when(F.col("op") == "put", 1)).over(w))
    return ops.withColumn("conflict", F.coalesce(other, F.lit(0)) == 1)


def apply_effects(kv: DataFrame, writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """The namespace after one settlement: writes, then deletes; a key in both is deleted."""
    kept = kv.join(writes.select("key"), "key", "left_anti").unionByName(writes.select("key", "value"))
    return kept.join(deletes.select("key"), "key", "left_anti")
