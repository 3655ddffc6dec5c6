"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.shipping import ship

_made: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor share.

    It is ``spark.checkpoint.dir``; only a local master may do without that setting.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = _made.get(sc.applicationId)
        if base is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = _made[sc.applicationId] = tempfile.mkdtemp(prefix="millrace-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    root = f"{scratch_dir(spark)}/millrace-{spark.sparkContext.applicationId}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if root not in _made:
        _made[root] = root
        atexit.register(_drop, spark, root)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for frames that nothing will read again."""
    for df in frames:
        _drop(df.sparkSession, df._millrace_path)


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors, and with batches that stay small where texts are long.

    The batch settings stay in the session, as the plan reads them when it runs.
    """
    ship(df.sparkSession)
    for key, value in BATCH.items():
        df.sparkSession.conf.set(key, value)
    return df.mapInArrow(fn, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(sizes: DataFrame, by: list[str], parts: int) -> DataFrame:
    """Keys of ``sizes(*by, n)`` that have a ``parts``-th of all rows or more: at most ``parts`` of them, so they may be broadcast."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return sizes.groupBy(*by).agg(F.sum("n").alias("n")).where(f"n * {parts} >= {total}").select(*by, F.lit(True).alias("_hot"))


def dealt(df: DataFrame, hot: DataFrame, by: list[str], parts: int) -> DataFrame:
    """``df`` with ``_salt`` in place of the hash ``_spread``; it deals the rows of the hot keys over ``parts``."""
    salt = F.pmod(F.col("_spread"), F.lit(parts)).cast("int")
    return df.join(F.broadcast(hot), by, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot", "_spread")


def copied(df: DataFrame, hot: DataFrame, by: list[str], parts: int) -> DataFrame:
    """``df`` once for each part that ``dealt`` makes of its key."""
    last = F.when(F.col("_hot"), parts - 1).otherwise(0)
    return df.join(F.broadcast(hot), by, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_hot")


def connected_components(edges: DataFrame, rounds: int = 40, parts: int = 64) -> DataFrame:
    """Smallest reachable vertex of each vertex of ``edges(a, b)``: rows ``(v, root)``.

    Alternates large-star and small-star contraction until the edge set is a set of stars.
    Vertices without an edge do not appear. Every round is written to the shared folder. A vertex with a
    ``parts``-th of all edges or more (at most ``2 * parts`` such) has them dealt over ``parts`` tasks.
    """

    def with_least(ends: DataFrame, total: int) -> DataFrame:
        """``ends(u, v)`` with ``m``, the least ``v`` of each ``u``."""
        least = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = least.where(f"n * {parts} >= {total}").select("u", F.lit(True).alias("_hot"))
        rows = dealt(ends.withColumn("_spread", F.xxhash64("v")), hot, ["u"], parts)
        return rows.join(copied(least.select("u", "m"), hot, ["u"], parts), ["u", "_salt"]).select("u", "v", "m")

    both = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    cur = materialise(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    last, n = None, cur.count()
    for _ in range(rounds if n else 0):
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(sym, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        hop = with_least(large, n)
        small = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(hop.select("u", F.col("m").alias("v")))
        before, cur = cur, materialise(small.distinct(), "cc")
        release(before)
        state = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last, n = state, state[0]
    else:
        if n:
            raise RuntimeError("the components did not settle")
    roots = cur.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
