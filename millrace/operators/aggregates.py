"""Running aggregates: one row for each event, with the totals of its partition so far.

A partition may hold a third of all events, so its running total isn't left to one
task. Offsets are cut into blocks; each block's totals are found by an ordinary
aggregation, the totals before each block by a window over one row per block, and
within a block by a window of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import expressions as X
from millrace.operators.rows import _kind, _mark, _routes
from millrace.plans import spec as S

#: What keeps running totals apart.
SCOPE = ["tenant_id", "pipeline_id", "partition_id"]
BLOCK_OFFSETS = 1_000_000

_NAMES = ("n", "sum", "min", "max")


def _parts(value: Column, exact: bool) -> dict[str, Column]:
    x = value.cast("decimal(28,6)") if exact else value
    return {"n": F.count(F.lit(1)), "sum": F.sum(x), "min": F.min(value), "max": F.max(value)}


def _needed(function: str) -> tuple[str, ...]:
    return {"count": ("n",), "sum": ("n", "sum"), "min": ("n", "min"), "max": ("n", "max"), "average": ("n", "sum")}[function]


def _combined(name: str, before: Column, now: Column) -> Column:
    if name in ("n", "sum"):
        return F.coalesce(before, F.lit(0)) + now
    return (F.least if name == "min" else F.greatest)(before, now)  # both let nulls go


def _split(df: DataFrame, op: S.Aggregate, operator_id: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """`df` with its new errors marked, the rows that count, with their value as `_x`, and those that can't be worked on."""
    value = X.numeric(F.col("payload"), _kind(df))
    if op.function != "count":
        error = F.lit(X.NOT_NUMERIC) if value is None else F.when(value.isNull(), F.lit(X.NOT_NUMERIC))
        if _routes(df):
            df = _mark(df, error, operator_id)
        else:
            df = df.where(F.lit(False)) if value is None else df.where(value.isNotNull())
    bad = df.where(F.col("_error").isNotNull()) if _routes(df) else None
    good = df.where(F.col("_error").isNull()) if _routes(df) else df
    return df, good.withColumn("_x", F.lit(None).cast("double") if value is None else value), bad


def running_aggregate(df: DataFrame, op: S.Aggregate, operator_id: str = "aggregate", *, exact: bool = False, earlier: DataFrame | None = None, block: int | None = BLOCK_OFFSETS) -> DataFrame:
    """Payload {count} or {count, value} of each event, in the order of (offset, source_id).

    Count takes any payload, the others a numeric one or one with a numeric field
    `value`. `exact` adds decimals of six places, so that sums don't depend on the
    order. `earlier` has totals (SCOPE, n, sum, min, max) from which to go on. With
    `block=None` each partition is one window.
    """
    df, good, bad = _split(df, op, operator_id)
    names = _needed(op.function)
    parts = _parts(F.col("_x"), exact)
    rows = good.withColumn("_b", F.floor(F.col("offset") / F.lit(block)) if block else F.lit(0))
    inside = Window.partitionBy(*SCOPE, "_b").orderBy("offset", "source_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = {k: parts[k].over(inside) for k in names}
    rows = rows.withColumns({f"_{k}": c for k, c in run.items()})
    before: dict[str, Column] = {k: F.lit(None) for k in names}
    if block:
        totals = good.withColumn("_b", F.floor(F.col("offset") / F.lit(block))).groupBy(*SCOPE, "_b").agg(*[parts[k].alias(k) for k in names])
        past = Window.partitionBy(*SCOPE).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        gather = {"n": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        starts = totals.select(*SCOPE, "_b", *[gather[k](k).over(past).alias(f"_p{k}") for k in names])
        rows = rows.join(starts, [*SCOPE, "_b"])
        before = {k: F.col(f"_p{k}") for k in names}
    if earlier is not None:
        was = earlier.select(*SCOPE, *[F.col(k).alias(f"_e{k}") for k in names])
        rows = rows.join(was, SCOPE, "left")
        before = {k: _combined(k, F.col(f"_e{k}"), F.coalesce(before[k], F.lit(0)) if k in ("n", "sum") else before[k]) for k in names}
    total = {k: _combined(k, before[k], F.col(f"_{k}")) for k in names}
    count = total["n"].cast("long").alias("count")
    if op.function == "count":
        payload = F.struct(count)
    else:
        out = {"sum": lambda: total["sum"].cast("double"), "min": lambda: total["min"], "max": lambda: total["max"], "average": lambda: total["sum"].cast("double") / total["n"]}[op.function]()
        payload = F.struct(count, F.when(~F.isnan(out) & (F.abs(out) < F.lit(float("inf"))), out).alias("value"))
    out = rows.withColumn("payload", payload).select(*df.columns)
    if bad is not None:  # as constants, so that whoever asks for errors alone plans no window
        out = out.withColumns({"_error": X.no_error(), "_error_op": X.no_error()})
    return out if bad is None else out.unionByName(bad.withColumn("payload", F.lit(None).cast(out.schema["payload"].dataType)))


def totals(df: DataFrame, op: S.Aggregate, operator_id: str = "aggregate", *, exact: bool = False) -> DataFrame:
    """Totals (SCOPE, n, sum, min, max) of the rows that `running_aggregate` counts, and the newest event's time, for a snapshot."""
    _, good, _ = _split(df, op, operator_id)
    return good.groupBy(*SCOPE).agg(*[c.alias(k) for k, c in _parts(F.col("_x"), exact).items()], F.max("event_time_ms").alias("newest_ms"))


def merged_totals(now: DataFrame, earlier: DataFrame) -> DataFrame:
    """Totals of both."""
    return now.unionByName(earlier).groupBy(*SCOPE).agg(F.sum("n").alias("n"), F.sum("sum").cast(now.schema["sum"].dataType).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.max("newest_ms").alias("newest_ms"))


def unexpired_totals(earlier: DataFrame, df: DataFrame, op: S.Aggregate) -> DataFrame:
    """Totals whose newest event is no more than the operator's TTL older than the newest event of `df` in its partition."""
    now = df.groupBy(*SCOPE).agg(F.max("event_time_ms").alias("_now"))
    kept = earlier.join(now, SCOPE, "left").where(F.col("_now").isNull() | (F.col("_now") - F.col("newest_ms") <= op.state_ttl_secs * 1000))
    return kept.select(earlier.columns)
