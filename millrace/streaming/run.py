"""Run a stream over what is there now and return its final table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.shipping import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows that the stream emits under ``availableNow``, read back from its sink.

    Update and complete modes keep every emitted row with its batch in ``_batch``; the last batch of a
    key is its final row.
    """
    spark = stream.sparkSession
    ship(spark)
    at = _folder(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def put(rows: DataFrame, batch: int) -> None:
        from pyspark.sql import functions as F

        # a batch that runs again overwrites what its first try left
        rows.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{at}/out/b={batch}")

    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    from pyspark.sql import types as T

    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{at}/out")
