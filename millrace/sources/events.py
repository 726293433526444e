"""Event frames: what operators work on, and how tables become one.

The columns are tenant_id, pipeline_id, source_id, partition_id, offset, record_key,
event_time_ms and the struct payload. Two columns more, `_error` and `_error_op`,
come with compiled pipelines that tell dead letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = ["tenant_id", "pipeline_id", "source_id", "partition_id", "offset", "record_key", "event_time_ms"]
#: What tells an event from all others.
EVENT_KEY = ["source_id", "partition_id", "offset"]


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970, rounded to the nearest."""
    return F.round(F.unix_micros(ts.cast("timestamp")) / F.lit(1000)).cast("long")


def events(df: DataFrame, *, source_id: str, partition_id: Column, offset: Column, event_time_ms: Column, payload: list[Column | str], record_key: Column | None = None, tenant_id: str = "tenant-a", pipeline_id: str = "pipeline") -> DataFrame:
    """`df` as an event frame. Columns that no one asks for later are never read."""
    key = F.concat(F.lit(f"{source_id}-"), offset.cast("string")) if record_key is None else record_key
    return df.select(
        F.lit(tenant_id).alias("tenant_id"),
        F.lit(pipeline_id).alias("pipeline_id"),
        F.lit(source_id).alias("source_id"),
        partition_id.cast("int").alias("partition_id"),
        offset.cast("long").alias("offset"),
        key.alias("record_key"),
        event_time_ms.cast("long").alias("event_time_ms"),
        F.struct(*payload).alias("payload"),
    )


def from_json(df: DataFrame, schema: T.StructType, *, value: str = "value", **envelope) -> DataFrame:
    """Event frame from JSON texts, for the encoding json."""
    parsed = df.withColumn("_json", F.from_json(F.col(value), schema))
    return events(parsed, payload=[F.col(f"_json.`{f.name}`").alias(f.name) for f in schema], **envelope)


def read_source(spark: SparkSession, encoding: str, path: str, *, schema: T.StructType | None = None) -> DataFrame:
    """A table of one source: JSON lines of a schema, Avro files, or a Parquet archive of decoded events.

    Avro needs Spark's own connector package on the class path.
    """
    if encoding == "json":
        if schema is None:
            raise ValueError("JSON lines need a schema")
        return spark.read.schema(schema).json(path)
    if encoding == "parquet":
        return spark.read.parquet(path)
    if encoding == "avro":
        return spark.read.format("avro").load(path)
    raise ValueError(f"no reader for the encoding {encoding}")


def partition_batch(df: DataFrame, partition_id: int, after: int, limit: int) -> DataFrame:
    """The next events of a partition after an offset: a pushed filter and a top-k, no full sort."""
    return df.where((F.col("partition_id") == partition_id) & (F.col("offset") > after)).orderBy("offset").limit(limit)


def replay_range(df: DataFrame, from_offset: int, to_offset: int | None = None, *, last: int | None = None, strict: bool = False) -> DataFrame:
    """Events of an offset range, ends included, after `last` if given. `strict` leaves out offset 0."""
    low = F.col("offset") >= from_offset
    if last is not None:
        low &= F.col("offset") > last
    if strict:
        low &= F.col("offset") > 0
    return df.where(low if to_offset is None else low & (F.col("offset") <= to_offset))


def high_watermarks(df: DataFrame) -> DataFrame:
    """The largest offset of each partition."""
    return df.groupBy("partition_id").agg(F.max("offset").alias("max_offset"))
