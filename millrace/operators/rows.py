"""Operators that look at one event at a time: filter, map, key by, window label, enrich.

Each takes an event frame and gives one. Where the frame has a column `_error`, rows
that can't be worked on get the reason in it and are left alone from then on; where it
has none, they go. Without it a filter is an ordinary one that reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import expressions as X
from millrace.functions.text import floor_to
from millrace.plans import spec as S


def _routes(df: DataFrame) -> bool:
    return "_error" in df.columns


def _kind(df: DataFrame) -> T.DataType:
    return df.schema["payload"].dataType


def _mark(df: DataFrame, error: Column, operator_id: str) -> DataFrame:
    """Sets `_error` where there is none yet, and `_error_op` with it."""
    fresh = F.col("_error").isNull() & error.isNotNull()
    return df.withColumns({"_error_op": F.when(fresh, F.lit(operator_id)).otherwise(F.col("_error_op")), "_error": F.coalesce("_error", error)})


def with_errors(df: DataFrame) -> DataFrame:
    """The frame with error columns; events before 1970 are errors from the start."""
    early = F.when(F.col("event_time_ms") < 0, F.lit("event time is before 1970"))
    return df.withColumns({"_error": early, "_error_op": F.when(early.isNotNull(), F.col("source_id"))})


def filter_events(df: DataFrame, op: S.Filter, operator_id: str = "filter", *, strict: bool = False) -> DataFrame:
    c = X.compile_filter(op.expression, F.col("payload"), _kind(df), strict=strict)
    if not _routes(df):
        return df.where(c.plain)
    marked = _mark(df, c.error, operator_id)
    return marked.where(F.col("_error").isNotNull() | c.wanted)


def map_events(df: DataFrame, op: S.Map, operator_id: str = "map") -> DataFrame:
    payload, error = X.compile_projection(op.projection, F.col("payload"), _kind(df))
    if _routes(df):
        df = _mark(df, error, operator_id)
    elif isinstance(X.parse_projection(op.projection), str):
        df = df.where(F.lit(False))
    return df.withColumn("payload", payload)


def key_by(df: DataFrame, op: S.KeyBy, *, physical: bool = False) -> DataFrame:
    """Values stay as they are. `physical` also deals the rows out by the key's hash."""
    found = X.at_path(F.col("payload"), _kind(df), op.key_field)
    return df.repartition(op.partition_count, found[0]) if physical and found else df


def key_partition(key: Column, count: int) -> Column:
    """The partition that a key belongs to."""
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def window_bounds(ms: Column, op: S.Window) -> tuple[Column, Column]:
    """Start and end of the one window that labels an event; a sliding one is the last that began."""
    step = (op.size_secs if op.window == "tumbling" else op.slide_secs) * 1000
    start = floor_to(ms, step)
    return start, start + F.lit(op.size_secs * 1000)


def label_window(df: DataFrame, op: S.Window) -> DataFrame:
    start, end = window_bounds(F.col("event_time_ms"), op)
    label = F.struct(start.alias("start_epoch_ms"), end.alias("end_epoch_ms"), F.lit(op.grace_secs).alias("grace_secs"))
    return df.withColumn("payload", F.col("payload").withField("_window", label))


def enrich(df: DataFrame, op: S.Enrich, operator_id: str = "enrich") -> DataFrame:
    """Adds what is to be looked up: table, key field and key."""
    found = X.at_path(F.col("payload"), _kind(df), op.key_field)
    key = found[0] if found else F.lit(None).cast("string")
    error = F.when(key.isNull(), F.lit(X.MISSING_ENRICHMENT_KEY.format(op.key_field)))
    df = _mark(df, error, operator_id) if _routes(df) else df.where(key.isNotNull())
    label = F.struct(F.lit(op.table_name).alias("table"), F.lit(op.key_field).alias("key_field"), key.alias("key_value"))
    return df.withColumn("payload", F.col("payload").withField("_enrichment", label))


def enrich_lookup(df: DataFrame, table: DataFrame, key_field: str, table_key: str, into: str = "_lookup") -> DataFrame:
    """An extension: joins the lookup table's row into the payload. Spark broadcasts the table where its size allows."""
    found = X.at_path(F.col("payload"), _kind(df), key_field)
    row = table.select(F.col(table_key).alias("_lookup_key"), F.struct(*table.columns).alias("_lookup_row"))
    joined = df.withColumn("_key", found[0]).join(row, F.col("_key") == F.col("_lookup_key"), "left")
    return joined.withColumn("payload", F.col("payload").withField(into, F.col("_lookup_row"))).drop("_key", "_lookup_key", "_lookup_row")
