"""Incremental runs over folders that grow: new records in, only keys that are not done yet out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process what ``source`` (JSON lines) gained since the last run; keys that the sink has are not done again.

    A batch that is repeated after a failure writes its own folder of the sink anew, so nothing is written twice.
    """
    stream = spark.readStream.schema(schema).json(source)

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(keys)
        try:
            done = spark.read.parquet(sink).where(F.col("batch") != number)
            rows = rows.join(done.select(*keys), keys, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        transform(rows).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

