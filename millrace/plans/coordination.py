"""Partition assignment as computations over worker and assignment tables.

Spark's scheduler places the work itself; these give the same answers as a
coordinator would. Placement is a rule on a few workers and partitions and runs on
the driver; what scans tables is DataFrames.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans import spec as S

_TARGET_REASONS = {"draft": "pipeline must be validated before it can be rebalanced", "paused": "paused pipelines are not eligible for worker assignments", "failed": "failed pipelines are not eligible for worker assignments"}


@dataclass(frozen=True)
class Worker:
    worker_id: str
    endpoint: str
    availability_zone: str
    max_assignments: int
    labels: tuple[str, ...] = ()
    status: str = "ready"
    active_assignments: int = 0
    registered_at: int = 0
    last_heartbeat_at: int = 0


@dataclass(frozen=True)
class Assignment:
    tenant_id: str
    pipeline_id: str
    version: int
    partition_id: int
    worker_id: str
    lease_epoch: int


def normalized_labels(labels) -> tuple[str, ...]:
    """Trimmed, ASCII lower case, without empty ones, sorted, each once."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return tuple(sorted({x for raw in labels if (x := raw.strip().translate(lower))}))


def register(w: Worker, now: int) -> Worker:
    """A worker as it enters: ready, without assignments, seen now."""
    for name, value in (("worker id", w.worker_id), ("worker endpoint", w.endpoint), ("worker availability zone", w.availability_zone)):
        if not value.strip():
            raise ValueError(f"{name} must not be empty")
    if w.max_assignments == 0:
        raise ValueError("worker max assignments must be greater than zero")
    return replace(w, labels=normalized_labels(w.labels), status="ready", active_assignments=0, registered_at=now, last_heartbeat_at=now)


def heartbeat(w: Worker, now: int) -> Worker:
    """A sign of life; an expired worker is ready again, a draining one stays so."""
    return replace(w, last_heartbeat_at=now, status="ready" if w.status == "expired" else w.status)


def rebalance(p: S.Pipeline, workers: list[Worker], current: list[Assignment], now: int, stale_after: int) -> list[Assignment]:
    """A worker for each source partition: always the one with least assignments, then the oldest heartbeat, then the first id."""
    if p.deployment_state not in S.RUNNABLE:
        raise ValueError(_TARGET_REASONS[p.deployment_state])
    fresh = [w for w in workers if w.status == "ready" and w.last_heartbeat_at + stale_after >= now]
    if not fresh:
        raise ValueError("no ready workers are available for assignment")
    if not p.sources:
        raise ValueError("pipeline has no source partitions")
    partitions = max(s.partition_count for s in p.sources)
    too_few = "worker capacity is lower than the required partition count"
    if sum(w.max_assignments for w in fresh) < partitions:
        raise ValueError(too_few)
    epoch = max((a.lease_epoch for a in current), default=0) + 1
    room = {w.worker_id: w.max_assignments for w in fresh}
    heap = [(w.active_assignments, w.last_heartbeat_at, w.worker_id) for w in fresh if w.active_assignments < w.max_assignments]
    heapq.heapify(heap)
    out = []
    for partition in range(partitions):
        if not heap:
            raise ValueError(too_few)
        active, seen, worker = heapq.heappop(heap)
        out.append(Assignment(p.tenant_id, p.pipeline_id, p.version, partition, worker, epoch))
        if active + 1 < room[worker]:
            heapq.heappush(heap, (active + 1, seen, worker))
    return out


def rebalance_table(workers: DataFrame, partitions: int, epoch: int, now: int, stale_after: int) -> DataFrame:
    """`rebalance` over a table of workers: (partition_id, worker_id, lease_epoch).

    Taking the least loaded worker again and again is taking the workers' free places in
    the order of (place, heartbeat, id), so the first places are a top-k.
    """
    fresh = workers.where((F.col("status") == "ready") & (F.col("last_heartbeat_at") + stale_after >= now) & (F.col("active_assignments") < F.col("max_assignments")))
    places = fresh.select("worker_id", "last_heartbeat_at", F.explode(F.sequence(F.col("active_assignments"), F.least(F.col("max_assignments"), F.col("active_assignments") + partitions) - 1)).alias("place"))
    order = ["place", "last_heartbeat_at", "worker_id"]
    taken = places.orderBy(*order).limit(partitions)
    number = F.row_number().over(Window.orderBy(*order)) - 1  # of as many rows as there are partitions
    return taken.select(number.cast("int").alias("partition_id"), "worker_id", F.lit(epoch).cast("long").alias("lease_epoch"))


def replace_assignments(assignments: DataFrame, new: DataFrame, tenant_id: str, pipeline_id: str) -> DataFrame:
    """The assignment table with `new` in place of all that the pipeline had."""
    others = assignments.where(~((F.col("tenant_id") == tenant_id) & (F.col("pipeline_id") == pipeline_id)))
    return others.unionByName(new.select(assignments.columns))


def worker_assignments(assignments: DataFrame, worker_id: str) -> DataFrame:
    """What a worker holds, by tenant, pipeline and partition."""
    return assignments.where(F.col("worker_id") == worker_id).orderBy("tenant_id", "pipeline_id", "partition_id")


@dataclass(frozen=True)
class Expiry:
    workers: DataFrame
    assignments: DataFrame
    expired: DataFrame
    revoked: DataFrame


def expire(workers: DataFrame, assignments: DataFrame, now: int, stale_after: int, default_stale_after: int = 90) -> Expiry:
    """Workers whose heartbeat is too old expire and lose their assignments. A `stale_after` of 0 means the default."""
    limit = max(0, now - (stale_after or default_stale_after))
    late = (F.col("last_heartbeat_at") < limit) & (F.col("status") != "expired")
    gone = workers.where(late).select("worker_id")
    return Expiry(
        workers.withColumn("status", F.when(late, "expired").otherwise(F.col("status"))),
        assignments.join(gone, "worker_id", "left_anti").select(assignments.columns),
        gone,
        assignments.join(gone, "worker_id", "left_semi").select(assignments.columns),
    )


def workers_with_counts(workers: DataFrame, assignments: DataFrame, status: str | None = None) -> DataFrame:
    """Workers, those of a status if given, with the number of their assignments."""
    own = workers if status is None else workers.where(F.col("status") == status)
    counts = assignments.groupBy("worker_id").agg(F.count(F.lit(1)).alias("active_assignments"))
    return own.drop("active_assignments").join(counts, "worker_id", "left").withColumn("active_assignments", F.coalesce("active_assignments", F.lit(0)).cast("long")).orderBy("worker_id")


def pipeline_workers(workers: DataFrame, assignments: DataFrame, tenant_id: str, pipeline_id: str) -> DataFrame:
    """The workers that hold a partition of the pipeline, each once."""
    own = assignments.where((F.col("tenant_id") == tenant_id) & (F.col("pipeline_id") == pipeline_id)).select("worker_id").distinct()
    return workers.join(own, "worker_id", "left_semi").orderBy("worker_id")
