"""Run status of a pipeline from its metadata frames: lag, checkpoint age, backlog, state, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Checkpoint age where there is no checkpoint.
NO_CHECKPOINT_AGE = 4_294_967_295
OPEN_REPLAYS = ("pending", "running")


def latest_offsets(checkpoints: DataFrame) -> DataFrame:
    """The largest checkpointed offset of each partition."""
    return checkpoints.groupBy("partition_id").agg(F.max("kafka_offset").alias("checkpoint_offset"))


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The newest checkpoint row of each partition, by creation time, then offset."""
    newest = F.max(F.struct("created_at", "kafka_offset", *[c for c in checkpoints.columns if c not in ("created_at", "kafka_offset", "partition_id")]))
    return checkpoints.groupBy("partition_id").agg(newest.alias("c")).select("partition_id", "c.*")


def partition_lag(watermarks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """How far each partition's checkpoint is behind its newest offset, never negative."""
    done = latest_offsets(checkpoints)
    return watermarks.join(done, "partition_id", "left").select("partition_id", F.greatest(F.lit(0), F.col("max_offset") - F.coalesce("checkpoint_offset", F.lit(0))).cast("long").alias("lag"))


def consumer_lag(watermarks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    return partition_lag(watermarks, checkpoints).agg(F.coalesce(F.sum("lag"), F.lit(0)).cast("long").alias("consumer_lag"))


def checkpoint_age(checkpoints: DataFrame, now: int) -> DataFrame:
    """Seconds since the newest checkpoint (`created_at` in seconds)."""
    newest = F.max("created_at")
    age = F.when(newest.isNull(), F.lit(NO_CHECKPOINT_AGE)).otherwise(F.greatest(F.lit(0), F.lit(now) - newest))
    return checkpoints.agg(age.cast("long").alias("checkpoint_age_secs"))


def is_ready(now: int, stale_after: int) -> Column:
    return (F.col("status") == "ready") & (F.col("last_heartbeat_at") + stale_after >= now)


def ready_workers(workers: DataFrame, assignments: DataFrame, now: int, stale_after: int) -> DataFrame:
    """Number of ready, fresh workers that have an assignment of the pipeline."""
    own = workers.join(assignments.select("worker_id").distinct(), "worker_id", "left_semi")
    return own.agg(F.count_if(is_ready(now, stale_after)).alias("ready_worker_count"))


def replay_backlog(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin(*OPEN_REPLAYS)).alias("replay_backlog"))


def derived_state(deployment_state: str, backlog: Column, assignments: Column) -> Column:
    """The run state: what a running pipeline does depends on its backlog and assignments."""
    fixed = {"draft": "pending", "validated": "pending", "deploying": "deploying", "paused": "paused", "failed": "failed"}
    if deployment_state in fixed:
        return F.lit(fixed[deployment_state])
    return F.when(backlog > 0, "rebalancing").when(assignments == 0, "pending").otherwise("running")


def run_status(tenant_id: str, pipeline_id: str, deployment_state: str, *, watermarks: DataFrame, checkpoints: DataFrame, assignments: DataFrame, workers: DataFrame, replay_jobs: DataFrame, dead_letters: DataFrame, now: int, stale_after: int) -> DataFrame:
    """One row. Every part is an aggregation to one row, so that joining them multiplies nothing."""
    _scope(tenant_id, pipeline_id)
    parts = [
        consumer_lag(watermarks, checkpoints),
        checkpoint_age(checkpoints, now),
        assignments.agg(F.count(F.lit(1)).alias("active_assignment_count")),
        ready_workers(workers, assignments, now, stale_after),
        replay_backlog(replay_jobs),
        dead_letters.agg(F.count(F.lit(1)).alias("dead_letter_count")),
    ]
    row = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:
        row = row.join(p.withColumn("_one", F.lit(1)), "_one")
    state = derived_state(deployment_state, F.col("replay_backlog"), F.col("active_assignment_count"))
    return row.select(F.lit(tenant_id).alias("tenant_id"), F.lit(pipeline_id).alias("pipeline_id"), state.alias("state"), "consumer_lag", "checkpoint_age_secs", "active_assignment_count", "ready_worker_count", "replay_backlog", "dead_letter_count")


def _scope(tenant_id: str, pipeline_id: str) -> None:
    if not tenant_id.strip():
        raise ValueError("tenant id must not be empty")
    if not pipeline_id.strip():
        raise ValueError("pipeline id must not be empty")


_LISTING_ORDER = {"assignments": ["partition_id"], "replay_jobs": ["created_at"], "checkpoints": ["created_at"], "dead_letters": ["created_at"]}


def listing(df: DataFrame, kind: str, tenant_id: str, pipeline_id: str) -> DataFrame:
    """Rows of one pipeline in the listing's order; newest first but for assignments."""
    _scope(tenant_id, pipeline_id)
    own = df.where((F.col("tenant_id") == tenant_id) & (F.col("pipeline_id") == pipeline_id))
    order = [F.asc(c) if kind == "assignments" else F.desc(c) for c in _LISTING_ORDER[kind]]
    return own.orderBy(*order)
