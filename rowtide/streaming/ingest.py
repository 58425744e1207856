"""Streams of row versions into a table: each micro-batch is one upsert commit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowtide.sources.table_log import Table


def json_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of JSON files as they arrive."""
    return spark.readStream.schema(schema).json(folder)


def kafka_json_stream(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """Rows of a Kafka topic of JSON values; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"}).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def upsert_stream(stream: DataFrame, table: Table, order: Sequence[str], checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
    """Starts upserting; ``order`` tells which row of a key is newer within a batch.

    The number of the batch is saved in its commit, so a batch that is delivered again after a crash
    is recognised and skipped: every row counts once. Empty batches commit nothing.
    """
    prop = f"rowtide.batch.{name}"

    def one(df: DataFrame, batch: int) -> None:
        if int(table.meta().properties.get(prop, -1)) >= batch:
            return
        df = df.persist()
        try:
            if df.limit(1).count():
                table.upsert(df, order, {prop: str(batch)})
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()
