"""Registers kept up to date from a stream: the batch aggregation unchanged, as maxima neither mind
late rows nor repeated ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from overlapse.operators.registers import registers
from overlapse.plans.session import scratch


def run_registers(elements: DataFrame, keys: Sequence[str], p: int, kind: str = "xxh64") -> DataFrame:
    """Drives a stream of (keys, element) over all rows now available and returns the registers.

    Each micro-batch appends the registers that rose; the maximum over batches is the sketch.
    """
    spark = elements.sparkSession
    path = scratch(spark, "registers")
    regs = registers(elements, keys, p, kind)
    schema = T.StructType([*regs.schema.fields, T.StructField("batch", T.IntegerType())])

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    query = (
        regs.writeStream.foreachBatch(sink)
        .outputMode("update")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], regs.schema)
    table = spark.read.schema(schema).option("basePath", f"{path}/table").parquet(f"{path}/table/batch=*")
    return table.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))
