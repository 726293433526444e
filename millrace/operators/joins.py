"""Interval joins of two event frames, inner and eager left.

Events meet if they are of one partition and key and their times are at most
`within_secs` apart, and if no event that came between them in the order of (offset,
source_id) had let the earlier one expire: one whose time is more than `within_secs`
after it. The joined row is that of the later event. A left event without a match
before it gives a row with a null right side at once, and further rows as matches come.

The equi-join is on partition, key and a time bucket as long as the interval (one
side is dealt to three neighbouring buckets), so that a hot key is many small groups.

Whether an event came between that let the earlier one expire is a question after the
largest time in a range of offsets. It is open only for pairs whose later event isn't
the newest of its partition at its place. For those the range is cut into aligned runs
of 16^0, 16^1, ... offsets, at most 30 of each size, and an equi-join looks up the
largest time of each run, so that no pair meets the events between one by one.
Nothing runs while a join is planned; in a log in time order no pair is open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import expressions as X
from millrace.operators.aggregates import BLOCK_OFFSETS
from millrace.operators.rows import _kind, _mark, _routes
from millrace.plans import spec as S
from millrace.sources.events import ENVELOPE

_ORDER = ["offset", "source_id"]


def _newest(clock: DataFrame, block: int) -> DataFrame:
    """`clock` (partition_id, offset, source_id, event_time_ms) with `newest`, the largest time so far in the partition."""
    rows = clock.withColumn("_b", F.floor(F.col("offset") / F.lit(block)))
    inside = Window.partitionBy("partition_id", "_b").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = Window.partitionBy("partition_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("partition_id", "_b").agg(F.max("event_time_ms").alias("top")).select("partition_id", "_b", F.max("top").over(past).alias("_past"))
    return rows.withColumn("newest", F.max("event_time_ms").over(inside)).join(tops, ["partition_id", "_b"]).withColumn("newest", F.greatest("newest", "_past")).drop("_b", "_past")


def _newest_after(clock: DataFrame, block: int) -> DataFrame:
    """`clock` with `after`, the largest time that comes later in the partition, or null."""
    rows = clock.withColumn("_b", F.floor(F.col("offset") / F.lit(block)))
    inside = Window.partitionBy("partition_id", "_b").orderBy(*map(F.desc, _ORDER)).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("partition_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("partition_id", "_b").agg(F.max("event_time_ms").alias("top")).select("partition_id", "_b", F.max("top").over(later).alias("_later"))
    return rows.withColumn("after", F.max("event_time_ms").over(inside)).join(tops, ["partition_id", "_b"]).withColumn("after", F.greatest("after", "_later")).drop("_b", "_later")


def _side(df: DataFrame, key_field: str, operator_id: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows with `_key`, and those that can't be joined."""
    found = X.at_path(F.col("payload"), _kind(df), key_field)
    key = found[0] if found else F.lit(None).cast("string")
    error = F.when(key.isNull(), F.lit(X.MISSING_JOIN_KEY.format(key_field)))
    if not _routes(df):
        return df.withColumn("_key", key).where(key.isNotNull()), None
    df = _mark(df, error, operator_id)
    return df.where(F.col("_error").isNull()).withColumn("_key", key), df.where(F.col("_error").isNotNull())


def _named(df: DataFrame, prefix: str) -> DataFrame:
    old = [F.col("_old") if "_old" in df.columns else F.lit(False)]
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in [*ENVELOPE, "_key", "payload"]], old[0].alias(f"{prefix}_old"))


def interval_join(left: DataFrame, right: DataFrame, op: S.Join, operator_id: str = "join", *, clock: DataFrame | None = None, ordered: bool = False, block: int = BLOCK_OFFSETS, buffered: tuple[DataFrame, DataFrame] | None = None, matches: bool = False) -> DataFrame:
    """Event frame with payload {join_key, left, right}, with `matches` also `_match`: the place of the earlier event.

    `buffered` has event frames of earlier rows of both sides that are still there;
    they only meet rows of `left` and `right`.

    `clock` has all events that reach the join, filtered ones included; by default
    those of both sides. `ordered` says that times never go back in a partition, so
    that no event in between can matter.
    """
    routes = _routes(left)
    left, bad_left = _side(left, op.key_field, operator_id)
    right, bad_right = _side(right, op.key_field, operator_id)
    within = op.within_secs * 1000
    if clock is None:
        clock = left.select("partition_id", *_ORDER, "event_time_ms").union(right.select("partition_id", *_ORDER, "event_time_ms"))
    else:
        clock = clock.select("partition_id", *_ORDER, "event_time_ms")
    left_alone = left
    if buffered is not None:
        old = [_side(b.select(*ENVELOPE, "payload"), op.key_field, operator_id)[0].withColumn("_old", F.lit(True)) for b in buffered]
        left = left.select(*ENVELOPE, "payload", "_key").withColumn("_old", F.lit(False)).unionByName(old[0])
        right = right.select(*ENVELOPE, "payload", "_key").withColumn("_old", F.lit(False)).unionByName(old[1])
        clock = reduce(DataFrame.unionByName, [clock, *(b.select(clock.columns) for b in buffered)])
    same_type = left.schema["_key"].dataType == right.schema["_key"].dataType
    bucket = lambda c: F.floor(F.col(c) / F.lit(within))
    a = _named(left, "l_").withColumn("_bucket", bucket("l_event_time_ms"))
    b = _named(right, "r_").withColumn("_bucket", F.explode(F.sequence(bucket("r_event_time_ms") - 1, bucket("r_event_time_ms") + 1)))
    on = (a["l_partition_id"] == b["r_partition_id"]) & (a["_bucket"] == b["_bucket"]) & ((a["l__key"] == b["r__key"]) if same_type else F.lit(False))
    met = a.join(b, on & (F.abs(F.col("l_event_time_ms") - F.col("r_event_time_ms")) <= within)).drop(a["_bucket"]).drop(b["_bucket"])
    if buffered is not None:
        met = met.where(~(F.col("l__old") & F.col("r__old")))
    left_last = F.struct(*[F.col(f"l_{c}") for c in _ORDER]) > F.struct(*[F.col(f"r_{c}") for c in _ORDER])
    met = met.withColumn("_left_last", left_last)
    if not ordered:
        met = _unexpired(met, clock, within, block)

    last = [F.when(F.col("_left_last"), F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(c) for c in ENVELOPE]
    first = [F.struct(*[F.when(F.col("_left_last"), F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(c) for c in _ORDER]).alias("_match")] if matches else []
    pairs = met.select(*last, *first, F.struct(F.when(F.col("_left_last"), F.col("l__key")).otherwise(F.col("r__key")).alias("join_key"), F.col("l_payload").alias("left"), F.col("r_payload").alias("right")).alias("payload"))
    out = [pairs]
    if op.join == "left":
        matched = met.where("_left_last").select(F.col("l_partition_id").alias("partition_id"), F.col("l_offset").alias("offset"), F.col("l_source_id").alias("source_id")).distinct()
        alone = left_alone.join(matched, ["partition_id", *_ORDER], "left_anti")
        nothing = F.lit(None).cast(right.schema["payload"].dataType)
        none = [F.lit(None).cast(pairs.schema["_match"].dataType).alias("_match")] if matches else []
        out.append(alone.select(*ENVELOPE, *none, F.struct(F.col("_key").alias("join_key"), F.col("payload").alias("left"), nothing.alias("right")).alias("payload")))
    result = reduce(DataFrame.unionByName, out)
    if not routes:
        return result
    result = result.withColumns({"_error": X.no_error(), "_error_op": X.no_error()})
    kind = result.schema["payload"].dataType
    for bad in (bad_left, bad_right):
        bad = bad.withColumn("_match", F.lit(None).cast(result.schema["_match"].dataType)) if matches else bad
        result = result.unionByName(bad.withColumn("payload", F.lit(None).cast(kind)).select(result.columns))
    return result


def still_buffered(rows: DataFrame, clock: DataFrame, within_secs: int, block: int = BLOCK_OFFSETS) -> DataFrame:
    """Those rows that no later event of `clock` has let expire; for the rows and events of one micro-batch."""
    after = _newest_after(clock, block).select("partition_id", *_ORDER, "after").dropDuplicates(["partition_id", *_ORDER])
    kept = rows.join(after, ["partition_id", *_ORDER], "left").where(F.col("after").isNull() | (F.col("after") - F.lit(within_secs * 1000) <= F.col("event_time_ms")))
    return kept.select(rows.columns)


#: Runs of offsets: 16^0 to 16^9 long; beyond that, more of the longest.
_BITS, _LEVELS = 4, 10


def _runs(first: Column, end: Column) -> Column:
    """The aligned runs (level, run) that make up the offsets from `first` to before `end`."""

    def bounds(n: int) -> tuple[Column, Column]:
        """The first run of level n that lies within, and the one after the last."""
        return F.shiftright(first + F.lit((1 << _BITS * n) - 1), _BITS * n), F.shiftright(end, _BITS * n)

    def runs(n: int, low: Column, high: Column) -> Column:
        some = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(some, lambda x: F.struct(F.lit(n).alias("level"), x.alias("run")))

    out = []
    for n in range(_LEVELS):
        low, high = bounds(n)
        if n + 1 == _LEVELS:
            out.append(runs(n, low, high))
            continue
        up, down = bounds(n + 1)
        out.append(F.when(up < down, F.concat(runs(n, low, F.shiftleft(up, _BITS)), runs(n, F.shiftleft(down, _BITS), high))).otherwise(runs(n, low, high)))
    return F.flatten(F.array(*out))


def _unexpired(met: DataFrame, clock: DataFrame, within: int, block: int) -> DataFrame:
    """Those pairs of which the earlier event was still there when the later one came."""
    behind = _newest(clock, block).where("newest > event_time_ms").select(F.col("partition_id").alias("_p"), F.col("offset").alias("_o"), F.col("source_id").alias("_s"), "newest")
    pick = lambda c, later: F.when(F.col("_left_last") == later, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}"))
    place = {"_o1": pick("offset", False), "_s1": pick("source_id", False), "_o2": pick("offset", True), "_s2": pick("source_id", True)}
    pairs = met.select(F.col("l_partition_id").alias("_p"), *[c.alias(n) for n, c in place.items()], (pick("event_time_ms", False) + within).alias("_limit"))
    open_pairs = pairs.join(behind, (pairs["_p"] == behind["_p"]) & (F.col("_o2") == F.col("_o")) & (F.col("_s2") == F.col("_s"))).where("newest > _limit").drop(behind["_p"], "_o", "_s", "newest")
    # Level -1 has the events themselves, for the offsets that the pair's own events have.
    ends = F.transform(F.array_distinct(F.array("_o1", "_o2")), lambda o: F.struct(F.lit(-1).alias("level"), o.alias("run")))
    asked = open_pairs.withColumn("_x", F.explode(F.concat(ends, _runs(F.col("_o1") + 1, F.col("_o2"))))).select("*", F.col("_x.level").alias("_level"), F.col("_x.run").alias("_run")).drop("_x")
    # One row for each partition of the log.
    disordered = behind.select(F.col("_p").alias("partition_id")).distinct()
    levels = F.explode(F.array(*map(F.lit, range(-1, _LEVELS))))
    own = clock.join(F.broadcast(disordered), "partition_id", "left_semi").select(F.col("partition_id").alias("_q"), "offset", "source_id", "event_time_ms", levels.alias("_level_"))
    run = F.expr(f"shiftright(offset, greatest(_level_, 0) * {_BITS})")
    tops = own.groupBy("_q", "_level_", run.alias("_run_"), F.when(F.col("_level_") < 0, F.col("source_id")).alias("_source")).agg(F.max("event_time_ms").alias("_top"))
    at = F.struct(F.col("_run").alias("o"), F.col("_source").alias("s"))
    between = (at > F.struct(F.col("_o1").alias("o"), F.col("_s1").alias("s"))) & (at <= F.struct(F.col("_o2").alias("o"), F.col("_s2").alias("s")))
    found = asked.join(tops, (F.col("_p") == F.col("_q")) & (F.col("_level") == F.col("_level_")) & (F.col("_run") == F.col("_run_")))
    expired = found.where((F.col("_top") > F.col("_limit")) & ((F.col("_level") >= 0) | between)).select("_p", *place).distinct()
    keys = met.withColumns({"_p": F.col("l_partition_id"), **place})
    return keys.join(expired, ["_p", *place], "left_anti").select(met.columns)
