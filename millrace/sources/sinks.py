"""Sinks: where the rows of a compiled pipeline go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import spec as S


def path_of(sink: S.Sink, root: str) -> str:
    """Folder of a sink's rows below `root`. A Kafka topic's double is a folder for the topic."""
    to = sink.to
    if to.kind == "object_storage":
        return f"{root}/object-storage/{to.bucket}/{to.prefix}"
    return f"{root}/kafka/{to.topic_name}" if to.kind == "kafka" else f"{root}/views/{to.view_name}"


def kafka_rows(df: DataFrame, sink: S.Sink) -> DataFrame:
    """Key, value and partition as Spark's Kafka writer takes them."""
    return df.select(F.col("record_key").alias("key"), F.to_json("payload").alias("value"), "partition_id")


def write_kafka(df: DataFrame, sink: S.Sink, servers: str) -> None:
    """Needs Spark's Kafka package on the class path."""
    kafka_rows(df, sink).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", sink.to.topic_name).save()


def write(df: DataFrame, sink: S.Sink, root: str, *, batch: int | None = None) -> str:
    """Writes rows as Parquet below `root`. With `batch`, a repeated batch replaces its own rows."""
    out = kafka_rows(df, sink) if sink.to.kind == "kafka" else df
    path = path_of(sink, root)
    if batch is None:
        out.write.mode("overwrite").parquet(path)
    else:
        out.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    if sink.to.kind == "materialized_view":
        spark = df.sparkSession
        spark.read.parquet(path).createOrReplaceTempView(sink.to.view_name.replace("-", "_"))
    return path
