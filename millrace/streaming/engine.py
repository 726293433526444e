"""Pipelines as Structured Streaming queries.

Each micro-batch is compiled like a bounded batch, with the state that the last one
left: totals of running aggregates and the joins' rows that are still to be met. The
new state is written as a snapshot table for the batch before the next one begins, so
that a restarted query goes on from the last complete batch and a repeated batch
writes the same rows to the same place. No Python function sees a row.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates, joins
from millrace.plans import spec as S
from millrace.plans.compiler import Compiled, compile_pipeline, join_inputs, lineage_of, require_runnable
from millrace.plans.validate import topological_order, validate
from millrace.sources import sinks
from millrace.sources.events import ENVELOPE


def combined(streams: dict[str, DataFrame]) -> DataFrame:
    """One frame of all sources: the envelope, and a payload column for each source."""
    named = [df.select(*ENVELOPE, F.col("payload").alias(f"payload__{i}")) for i, df in streams.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def work_dir(spark: SparkSession) -> str:
    """A new folder for a query's state: below `spark.checkpoint.dir`, or a temporary one in a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/millrace/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="millrace-")


def source_options(pipeline: S.Pipeline, source: S.Source) -> dict[str, str]:
    """Reader options that keep a micro-batch within the deployment's messages in flight for each partition."""
    return {"subscribe": source.topic_name, "maxOffsetsPerTrigger": str(pipeline.deployment.max_in_flight_messages * source.partition_count)}


class Engine:
    """Runs one pipeline version; everything it keeps lies below `root`, by version.

    `expire_state` lets an aggregate start anew in a partition where no event came for
    its state's TTL, by event time; by default totals are kept for good.
    """

    def __init__(self, spark: SparkSession, pipeline: S.Pipeline, root: str, *, worker_id: str = "spark", expire_state: bool = False, **options):
        validate(pipeline)
        require_runnable(pipeline)
        self.spark, self.pipeline, self.worker_id, self.expire_state, self.options = spark, pipeline, worker_id, expire_state, options
        self.root = f"{root}/{pipeline.tenant_id}/{pipeline.pipeline_id}/v{pipeline.version}"
        by_id = {o.operator_id: o for o in pipeline.operators}
        self.order = [by_id[i] for i in topological_order(pipeline)]
        self.lineage = lineage_of(pipeline, self.order)

    # -- state ------------------------------------------------------------
    def _at(self, kind: str, operator_id: str, batch: int) -> str:
        return f"{self.root}/state/{kind}/{operator_id}/batch={batch}"

    def _read(self, kind: str, operator_id: str, batch: int) -> DataFrame | None:
        path = self._at(kind, operator_id, batch)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.parquet(path)

    def _stateful(self, kind: str) -> list[S.Operator]:
        return [o for o in self.order if o.op.kind == kind]

    def _state(self, batch: int) -> tuple[dict, dict]:
        earlier, buffered = {}, {}
        for o in self._stateful("aggregate"):
            if (df := self._read("totals", o.operator_id, batch)) is not None:
                earlier[o.operator_id] = df
        for o in self._stateful("join"):
            pair = tuple(self._read(f"buffer-{side}", o.operator_id, batch) for side in ("left", "right"))
            if None not in pair:
                buffered[o.operator_id] = pair
        return earlier, buffered

    def _save_state(self, c: Compiled, batch: int, earlier: dict, buffered: dict) -> None:
        for o in self._stateful("aggregate"):
            now = aggregates.totals(c.inputs[o.operator_id], o.op, o.operator_id, exact=self.options.get("exact_sums", False))
            if o.operator_id in earlier:
                now = aggregates.merged_totals(now, earlier[o.operator_id])
            now.write.mode("overwrite").parquet(self._at("totals", o.operator_id, batch))
        for o in self._stateful("join"):
            *sides, clock = join_inputs(o, c.nodes, self.lineage, c.empty)
            old = buffered.get(o.operator_id)
            if old is not None:
                clock = reduce(DataFrame.unionByName, [clock, *(b.select(clock.columns) for b in old)])
            for k, (name, side) in enumerate(zip(("left", "right"), sides)):
                side = (side.where("_error is null") if "_error" in side.columns else side).select(*ENVELOPE, "payload")
                if old is not None:
                    side = side.unionByName(old[k].select(side.columns))
                joins.still_buffered(side, clock, o.op.within_secs).write.mode("overwrite").parquet(self._at(f"buffer-{name}", o.operator_id, batch))

    # -- batches ----------------------------------------------------------
    def process(self, df: DataFrame, batch: int) -> None:
        """One micro-batch: sinks, dead letters, state, then the checkpoint rows."""
        df = df.persist()
        try:
            if df.isEmpty():
                return
            sources = {s.source_id: df.where(F.col("source_id") == s.source_id).select(*ENVELOPE, F.col(f"payload__{s.source_id}").alias("payload")) for s in self.pipeline.sources}
            last = self._last(batch)
            earlier, buffered = self._state(last) if last is not None else ({}, {})
            if self.expire_state:
                ops = {o.operator_id: o.op for o in self.order}
                earlier = {i: aggregates.unexpired_totals(t, df, ops[i]) for i, t in earlier.items()}
            c = compile_pipeline(self.pipeline, sources, earlier=earlier, buffered=buffered, **self.options)
            by_id = {k.sink_id: k for k in self.pipeline.sinks}
            for i, rows in c.sinks.items():
                sinks.write(rows, by_id[i], self.root, batch=batch)
            if c.dead_letters is not None:
                c.dead_letters.write.mode("overwrite").parquet(f"{self.root}/dead-letters/batch={batch}")
            self._save_state(c, batch, earlier, buffered)
            self._checkpoints(df).write.mode("overwrite").parquet(f"{self.root}/checkpoints/batch={batch}")
            self._complete(batch)
        finally:
            df.unpersist()

    def _checkpoints(self, df: DataFrame) -> DataFrame:
        uri = F.concat(F.lit(f"processor-runtime://{self.worker_id}/"), F.col("tenant_id"), F.lit("/"), F.col("pipeline_id"), F.lit("/"), F.col("partition_id").cast("string"), F.lit("/offset/"), F.col("kafka_offset").cast("string"))
        tops = df.groupBy("tenant_id", "pipeline_id", "partition_id").agg(F.max("offset").alias("kafka_offset"))
        return tops.withColumns({"snapshot_uri": uri, "snapshot_version": F.lit(1).cast("long"), "created_at": F.unix_timestamp(F.current_timestamp())})

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _done(self) -> list[int]:
        """Complete batches whose state is kept, in order."""
        p, fs = self._path(f"{self.root}/complete/*")
        return sorted(int(f.getPath().getName()) for f in fs.globStatus(p) or [])

    def _last(self, batch: int) -> int | None:
        """The last complete batch before `batch`."""
        return max((b for b in self._done() if b < batch), default=None)

    def _complete(self, batch: int) -> None:
        """Notes that a batch is complete; state from before the last batch but one goes.

        A batch may be repeated after it was noted, and then starts from the one before.
        """
        p, fs = self._path(f"{self.root}/complete/{batch}")
        fs.create(p, True).close()
        for old in self._done()[:-2]:
            for pattern in (f"state/*/*/batch={old}", f"complete/{old}"):
                p, fs = self._path(f"{self.root}/{pattern}")
                for f in fs.globStatus(p) or []:
                    fs.delete(f.getPath(), True)

    def start(self, streams: dict[str, DataFrame], *, available_now: bool = False, interval: str | None = None):
        """The running query. `streams` has a streaming event frame for each source; batches come at the checkpoint interval."""
        writer = combined(streams).writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.root}/offsets")
        if available_now:
            writer = writer.trigger(availableNow=True)
        else:
            writer = writer.trigger(processingTime=interval or f"{self.pipeline.deployment.checkpoint_interval_secs} seconds")
        return writer.start()

    def emissions(self, sink_id: str) -> DataFrame:
        """What a sink has got so far."""
        sink = next(k for k in self.pipeline.sinks if k.sink_id == sink_id)
        return self.spark.read.parquet(sinks.path_of(sink, self.root))

    def dead_letters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/dead-letters")
