"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 36-bit hash of its id. Sizes are summed by source and the first 12 bits; the
bucket in which a source's budget ends is split by the next 12 bits, and once more by the last 12.
That gives one threshold for each source, nested (a larger budget takes a superset), found without
a sort of documents. A document below its source's threshold is taken once more than the whole
number of passes over its source. Joins go by (source, first bucket), so a hot source is spread
over 4096 keys.

Null text has size 0. Null source is a source of its own, the last. Rows with the same id and
source fall on the same side of the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, read_table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BITS = 12


def sized(docs: DataFrame) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 9), 16, 10).cast("long")
    return docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), h.alias("_h"), F.shiftright(h, 2 * BITS).alias("_b"))


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Words to take from each row of ``by_source(_key, source, s)``: weight times a level, at most ``most`` times s.

    The level is found on the sources in order of the level at which they are full; one row a source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    out = by_source.withColumn("w", w).withColumn("cap", F.col("s") * float(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    every, order = Window.partitionBy(), Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("level", (F.sum("s").over(every) * float(share) - (F.sum("cap").over(order) - F.col("cap"))) / (F.sum("w").over(every) - (F.sum("w").over(order) - F.col("w"))))
    out = out.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every))
    return out.select("_key", "s", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _cut(hist: DataFrame, key: str) -> DataFrame:
    """``hist(_key, key, n, rem)`` with the words before each bucket."""
    w = Window.partitionBy("_key").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("before", F.sum("n").over(w) - F.col("n"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies, taken), one for each row of ``docs``."""
    rows = materialise(sized(docs), "sizes")
    hist = materialise(rows.groupBy("_key", "_b").agg(F.first("source").alias("source"), F.sum("size").alias("n")), "hist")
    goal = targets(hist.groupBy("_key").agg(F.first("source").alias("source"), F.sum("n").alias("s")), weights, share, most)
    passes = F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("rem", F.col("target") - F.col("passes") * F.col("s"))
    top = materialise(_cut(hist.drop("source").join(goal, "_key"), "_b"), "top")
    edge = top.where("before < rem and rem < before + n").select("_key", "_b", (F.col("rem") - F.col("before")).alias("rem"))
    # refine the boundary bucket twice
    second = F.shiftright("_h", BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    near = rows.where("size > 0").join(edge, ["_key", "_b"])
    deeper = _cut(near.groupBy("_key", "_b", second.alias("_c")).agg(F.sum("size").alias("n"), F.first("rem").alias("rem")), "_c")
    edge = deeper.where("before < rem and rem <= before + n").select("_key", "_b", "_c", (F.col("rem") - F.col("before")).alias("rem"))
    near = rows.where("size > 0").withColumn("_c", second).join(edge, ["_key", "_b", "_c"])
    last = _cut(near.groupBy("_key", "_b", "_h").agg(F.sum("size").alias("n"), F.first("rem").alias("rem")), "_h")
    cut = last.where("before < rem and rem <= before + n").select("_key", "_b", (F.col("_h") + F.when(F.col("rem") - F.col("before") >= F.col("n") / 2, 1).otherwise(0)).alias("thr"))
    top = top.join(cut, ["_key", "_b"], "left")
    once = F.when(F.col("before") + F.col("n") <= F.col("rem"), 1).when(F.col("before") >= F.col("rem"), 0).otherwise((F.col("_h") < F.col("thr")).cast("int"))
    got = rows.join(top, ["_key", "_b"]).withColumn("copies", (F.col("passes") + F.coalesce(once, F.lit(0))).cast("long"))
    return got.select("doc_id", "source", "size", F.col("s").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with all of its columns."""
    names = docs.columns
    plan = mixed(docs, weights, share, most).where("copies > 0").groupBy("doc_id", "source").agg(F.max("copies").alias("copies")).select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("copies").alias("_copies"))
    rows = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").alias("_d"), F.col("source").alias("_s"))
    got = rows.join(plan, F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_src")))
    return got.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_row.*").select(*names)


def op7_mixing(spark, sf_dir):
    return mixed(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h FROM documents),
     s AS (SELECT k, source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY k, source),
     w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, s * 2.0::DOUBLE AS cap FROM s),
     o AS (SELECT *, cap / w AS full_at FROM w),
     l AS (SELECT *, (sum(s) OVER () * 1.5::DOUBLE - (sum(cap) OVER ord - cap)) / (sum(w) OVER () - (sum(w) OVER ord - w)) AS lv
           FROM o WINDOW ord AS (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
     m AS (SELECT *, max(CASE WHEN lv <= full_at THEN lv END) OVER () AS level FROM l),
     t AS (SELECT k, s, least(cap, coalesce(level * w, cap)) AS target FROM m),
     p AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS passes FROM t),
     q AS (SELECT *, target - passes * s AS rem FROM p),
     b AS (SELECT d.k, d.h, sum(d.size) AS n FROM d GROUP BY d.k, d.h),
     c AS (SELECT k, h, n, sum(n) OVER (PARTITION BY k ORDER BY h ROWS UNBOUNDED PRECEDING) - n AS before FROM b)
SELECT d.doc_id, d.size, q.s AS source_size, q.target,
       CAST(d.size * (q.passes + CASE WHEN c.before >= q.rem THEN 0 WHEN c.before + c.n <= q.rem THEN 1 WHEN q.rem - c.before >= c.n / 2.0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.k = q.k JOIN c ON d.k = c.k AND d.h = c.h
"""
