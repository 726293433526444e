"""Replays: a pipeline over a range of offsets, from empty state, as one bounded batch."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import spec as S
from millrace.plans.compiler import Compiled, compile_pipeline
from millrace.sources.events import replay_range


@dataclass(frozen=True)
class ReplayJob:
    """One replay and where it stands: pending, running, succeeded or failed."""

    replay_job_id: str
    tenant_id: str
    pipeline_id: str
    version: int
    from_offset: int
    to_offset: int | None
    reason: str
    status: str = "pending"
    claimed_by_worker_id: str | None = None
    last_processed_offset: int | None = None
    error_message: str | None = None


def request(p: S.Pipeline, from_offset: int, to_offset: int | None, reason: str) -> ReplayJob:
    """A pending job that is bound to the pipeline's present version."""
    for name, value in (("tenant id", p.tenant_id), ("pipeline id", p.pipeline_id), ("replay reason", reason)):
        if not value.strip():
            raise ValueError(f"{name} must not be empty")
    return ReplayJob(str(uuid.uuid4()), p.tenant_id.strip(), p.pipeline_id.strip(), p.version, from_offset, to_offset, reason.strip())


def claim(job: ReplayJob, worker_id: str) -> ReplayJob:
    if job.status != "pending":
        raise ValueError(f"replay job is {job.status}")
    return replace(job, status="running", claimed_by_worker_id=worker_id)


def oldest_pending(jobs: DataFrame) -> DataFrame:
    """The pending job that was asked for first, of several the one with the smallest id; no row if there is none."""
    return jobs.where("status = 'pending'").orderBy("created_at", "replay_job_id").limit(1)


def transition(jobs: DataFrame, job_ids: DataFrame, now: int, *, status: str | None = None, worker_id: str | None = None, last_processed_offset: int | None = None, error_message: str | None = None) -> DataFrame:
    """The job table after a step of the jobs named in `job_ids`: claimed, got on, succeeded or failed.

    What is not given stays as it was.
    """
    named = job_ids.select("replay_job_id").distinct().withColumn("_named", F.lit(True))
    given = {"status": status, "claimed_by_worker_id": worker_id, "last_processed_offset": last_processed_offset, "error_message": error_message, "updated_at": now}
    out = jobs.join(named, "replay_job_id", "left")
    return out.select(*[F.when(F.col("_named"), F.lit(given[c]).cast(jobs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if given.get(c) is not None else F.col(c) for c in jobs.columns])


def claim_oldest(jobs: DataFrame, worker_id: str, now: int) -> DataFrame:
    """The job table after a worker took the oldest pending job."""
    return transition(jobs, oldest_pending(jobs), now, status="running", worker_id=worker_id)


def replay(p: S.Pipeline, sources: dict[str, DataFrame], from_offset: int, to_offset: int | None = None, *, last: int | None = None, **options) -> Compiled:
    """The compiled pipeline over the range; every partition starts without state and the whole range is covered."""
    strict = options.get("strict", False)
    cut = {k: replay_range(df, from_offset, to_offset, last=last, strict=strict) for k, df in sources.items()}
    return compile_pipeline(p, cut, **options)


def run(job: ReplayJob, p: S.Pipeline, sources: dict[str, DataFrame], write, **options) -> ReplayJob:
    """Claims nothing: works a running job through with `write(compiled)` and gives it with its outcome."""
    try:
        compiled = replay(p, sources, job.from_offset, job.to_offset, last=job.last_processed_offset, **options)
        write(compiled)
        tops = [replay_range(df, job.from_offset, job.to_offset).agg(F.max("offset")).first()[0] for df in sources.values()]
        done = max((t for t in tops if t is not None), default=job.last_processed_offset)
        return replace(job, status="succeeded", last_processed_offset=done)
    except Exception as e:  # a failed job keeps its reason; the caller goes on with other jobs
        return replace(job, status="failed", error_message=str(e))
