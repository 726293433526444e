"""From a pipeline definition to DataFrames: one for each sink, and the dead letters.

Operators are applied once each, in topological order, so what several branches need
is one plan node. `strict` settles where a definition's literal reading and the
sensible one differ:

* an event that a filter dropped, or an inner join left without a match, is a dead
  letter if an operator other than a join follows (default: it is dropped);
* whole-number fields never equal number literals (default: equal by value);
* an operator other than a join takes only the oldest of the matches that an event had
  in a join before it (default: all);
* operators run in declared order, and one before its upstream is skipped (default:
  topological order);
* offset 0 is not processed (default: it is; with `from_start=True` in strict mode too).

In both modes an event that fails in any operator has no emission from any branch,
and aggregates that it reached before have counted it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import expressions as X
from millrace.operators import aggregates, joins, rows
from millrace.plans import spec as S
from millrace.plans.validate import topological_order, validate
from millrace.sources.events import ENVELOPE, EVENT_KEY

_LABELS = {"key_by": "keyBy"}


class NotRunnable(RuntimeError):
    """The pipeline's deployment state doesn't allow it to run."""


_STATE_REASONS = {"draft": "pipeline draft is not eligible for processor execution", "paused": "pipeline is paused", "failed": "pipeline is failed"}


def require_runnable(p: S.Pipeline) -> None:
    if p.deployment_state not in S.RUNNABLE:
        raise NotRunnable(_STATE_REASONS[p.deployment_state])


@dataclass
class Compiled:
    """Frames of a compiled pipeline; nothing has run yet."""

    pipeline: S.Pipeline
    nodes: dict[str, DataFrame]
    sinks: dict[str, DataFrame]
    dead_letters: DataFrame | None
    #: What reaches each aggregate, with the errors that it meets there; nodes with events that have no value (strict mode).
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    empty: frozenset[str] = frozenset()

    def emissions(self) -> DataFrame:
        """All sinks' rows: sink_id, partition_id, offset, payload (JSON text), destination."""
        by_id = {k.sink_id: k for k in self.pipeline.sinks}
        out = [df.select(F.lit(i).alias("sink_id"), "partition_id", "offset", F.to_json("payload").alias("payload"), F.lit(by_id[i].to.destination).alias("destination")) for i, df in self.sinks.items()]
        return reduce(DataFrame.unionByName, out)

    def totals(self) -> DataFrame:
        """One row: the events that the sources gave and the rows that the sinks got."""
        count = lambda df: df.select(F.lit(1).alias("n"))
        read = [count(self.nodes[s.source_id]).withColumn("what", F.lit("read")) for s in self.pipeline.sources]
        sent = [count(df).withColumn("what", F.lit("sent")) for df in self.sinks.values()]
        every = reduce(DataFrame.unionByName, read + sent)
        return every.agg(F.count_if(F.col("what") == "read").alias("processed_events"), F.count_if(F.col("what") == "sent").alias("sink_emissions"))


def lineage_of(p: S.Pipeline, order: list[S.Operator]) -> dict[str, set[str]]:
    """The sources that each node's events come from."""
    out = {s.source_id: {s.source_id} for s in p.sources}
    for o in order:
        out[o.operator_id] = set().union(*(out.get(u, set()) for u in o.upstream_ids))
    return out


def compile_pipeline(p: S.Pipeline, sources: dict[str, DataFrame], *, dead_letters: bool = True, strict: bool = False, exact_sums: bool = False, ordered: bool = False, block: int | None = aggregates.BLOCK_OFFSETS, earlier: dict[str, DataFrame] | None = None, buffered: dict[str, tuple[DataFrame, DataFrame]] | None = None, from_start: bool = False) -> Compiled:
    """`sources` has an event frame for each source id. Without `dead_letters` bad events are dropped and filters stay plain.

    `earlier` and `buffered` are the totals of aggregates and the rows of joins, by
    operator, with which a run goes on where another left off.
    """
    validate(p)
    require_runnable(p)
    by_id = {o.operator_id: o for o in p.operators}
    order = list(p.operators) if strict else [by_id[i] for i in topological_order(p)]
    lineage = lineage_of(p, [by_id[i] for i in topological_order(p)])
    nodes: dict[str, DataFrame] = {}
    joined = any(o.op.kind == "join" for o in order)
    for s in p.sources:
        df = sources[s.source_id].where(F.col("source_id") == s.source_id)
        df = df.where("offset > 0") if strict and not from_start else df
        nodes[s.source_id] = rows.with_errors(df) if dead_letters else df.where("event_time_ms >= 0")
        if dead_letters and not joined:  # what came in goes along; only dead letters read it
            nodes[s.source_id] = nodes[s.source_id].withColumn("_original", F.col("payload"))
    inputs: dict[str, DataFrame] = {}
    empty: set[str] = set()  # nodes that, in strict mode, keep events without a value
    for o in order:
        if any(u not in nodes for u in o.upstream_ids):
            continue
        first, op = nodes[o.upstream_ids[0]], o.op
        if op.kind == "join":
            nodes[o.operator_id] = _join(p, o, nodes, lineage, empty, strict, strict and dead_letters, ordered, block, (buffered or {}).get(o.operator_id))
            if strict and dead_letters:
                empty.add(o.operator_id)
            continue
        if "_match" in first.columns:
            oldest = F.row_number().over(Window.partitionBy(*EVENT_KEY).orderBy(F.asc_nulls_first("_match"), "payload.join_key"))
            first = first.withColumn("_rank", oldest).where("_rank = 1").drop("_rank", "_match")
        if o.upstream_ids[0] in empty:
            first = rows._mark(first, F.when(F.col("_empty"), F.lit(X.EMPTY_UPSTREAM.format(_LABELS.get(op.kind, op.kind)))), o.operator_id).drop("_empty")
        if op.kind == "filter" and strict and dead_letters:
            c = X.compile_filter(op.expression, F.col("payload"), first.schema["payload"].dataType, strict=True)
            nodes[o.operator_id] = rows._mark(first, c.error, o.operator_id).withColumn("_empty", ~c.wanted & F.col("_error").isNull())
            empty.add(o.operator_id)
            continue
        if op.kind == "aggregate":
            inputs[o.operator_id] = first
        nodes[o.operator_id] = {
            "filter": lambda: rows.filter_events(first, op, o.operator_id, strict=strict),
            "map": lambda: rows.map_events(first, op, o.operator_id),
            "key_by": lambda: rows.key_by(first, op),
            "window": lambda: rows.label_window(first, op),
            "aggregate": lambda: aggregates.running_aggregate(first, op, o.operator_id, exact=exact_sums, earlier=(earlier or {}).get(o.operator_id), block=block),
            "enrich": lambda: rows.enrich(first, op, o.operator_id),
        }[op.kind]()
    out = _outputs(p, nodes, empty, dead_letters)
    return replace(out, inputs=inputs, empty=frozenset(empty))


def _join(p, o, nodes, lineage, empty, strict, keep_empty, ordered, block, buffered) -> DataFrame:
    left_id, right_id = o.upstream_ids
    left, right, clock = join_inputs(o, nodes, lineage, empty)
    out = joins.interval_join(left, right, o.op, o.operator_id, clock=clock, ordered=ordered, buffered=buffered, matches=strict, **({} if block is None else {"block": block}))
    if not keep_empty:
        return out
    # In strict mode events without a match are there too, without a value.
    out = out.withColumn("_empty", F.lit(False))
    reached = reduce(DataFrame.unionByName, [nodes[i].where("_error is null").select(*ENVELOPE) for i in (left_id, right_id)])
    rest = reached.join(out.select(*EVENT_KEY), EVENT_KEY, "left_anti").withColumns({"payload": F.lit(None).cast(out.schema["payload"].dataType), "_error": X.no_error(), "_error_op": X.no_error(), "_empty": F.lit(True), "_match": F.lit(None).cast(out.schema["_match"].dataType)})
    return out.unionByName(rest.select(out.columns))


def join_inputs(o: S.Operator, nodes: dict[str, DataFrame], lineage: dict[str, set[str]], empty: set[str] = frozenset()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Left and right rows of a join, and the times of all events that reach it."""
    left_id, right_id = o.upstream_ids
    present = lambda i: nodes[i].where(~F.col("_empty")).drop("_empty") if i in empty else nodes[i]
    left, right = present(left_id), present(right_id)
    # An event that both inputs descend from is taken for the first of them alone.
    if shared := lineage[left_id] & lineage[right_id]:
        right = right.where(~F.col("source_id").isin(sorted(shared)))
    used = [nodes[s] for s in sorted(lineage[left_id] | lineage[right_id])]
    clock = reduce(DataFrame.unionByName, [s.select("partition_id", "offset", "source_id", "event_time_ms") for s in used])
    return left, right, clock


def _outputs(p: S.Pipeline, nodes: dict[str, DataFrame], empty: set[str], dead_letters: bool) -> Compiled:
    taken = {u for o in p.operators for u in o.upstream_ids}
    leaves = [o.operator_id for o in p.operators if o.operator_id in nodes and o.operator_id not in taken]
    ends = list(dict.fromkeys([*leaves, *(k.upstream_id for k in p.sinks if k.upstream_id in nodes)]))
    clean = lambda df, i: df.where(~F.col("_empty")).drop("_empty") if i in empty else df
    if not dead_letters:
        return Compiled(p, nodes, {k.sink_id: nodes[k.upstream_id].drop("_match") for k in p.sinks if k.upstream_id in nodes}, None)
    place = F.create_map(*[F.lit(x) for i, n in enumerate([*(s.source_id for s in p.sources), *(o.operator_id for o in p.operators)]) for x in (n, i)])
    carried = all("_original" in nodes[i].columns for i in ends)
    payload = [F.to_json("_original").alias("payload")] if carried else []
    failed = [nodes[i].where("_error is not null").select(*ENVELOPE, *payload, F.col("_error").alias("failure_reason"), F.col("_error_op").alias("operator_id"), place[F.col("_error_op")].alias("_at")) for i in ends]
    bad = reduce(DataFrame.unionByName, failed)
    several = len(ends) > 1  # with one end an event has one row at most
    once = F.row_number().over(Window.partitionBy(*EVENT_KEY).orderBy("_at"))
    bad = (bad.withColumn("_once", once).where("_once = 1").drop("_once") if several or not carried else bad).drop("_at")
    sinks = {}
    for k in p.sinks:
        if k.upstream_id in nodes:
            good = clean(nodes[k.upstream_id], k.upstream_id).where("_error is null")
            if several:
                good = good.join(bad.select(*EVENT_KEY), EVENT_KEY, "left_anti")
            sinks[k.sink_id] = good.select(*ENVELOPE, "payload")
    original = None if carried else reduce(DataFrame.unionByName, [nodes[s.source_id].select(*EVENT_KEY, F.to_json("payload").alias("payload")) for s in p.sources])
    letters = (bad if carried else bad.join(original, EVENT_KEY)).select("tenant_id", "pipeline_id", "source_id", "partition_id", F.col("offset").alias("event_offset"), "record_key", "failure_reason", F.lit(False).alias("retryable"), "payload", "operator_id")
    return Compiled(p, nodes, sinks, letters)
