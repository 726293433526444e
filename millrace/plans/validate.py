"""Checks of pipeline definitions. All issues are gathered; each names a field and says what is wrong."""

from __future__ import annotations

from dataclasses import dataclass

from millrace.plans import spec as S


@dataclass(frozen=True)
class Issue:
    field: str
    message: str


class InvalidPipeline(ValueError):
    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(f"{i.field}: {i.message}" for i in issues))
        self.issues = issues


# Messages by what is wrong. (field, message)
_M = {
    "tenant": ("tenant_id", "tenant id must not be empty"),
    "pipeline": ("pipeline_id", "pipeline id must not be empty"),
    "version": ("version", "pipeline version must be greater than zero"),
    "no_sources": ("sources", "at least one source topic is required"),
    "no_sinks": ("sinks", "at least one sink is required"),
    "source_id": ("sources.source_id", "source id must not be empty"),
    "source_topic": ("sources.topic_name", "source topic name must not be empty"),
    "source_count": ("sources.partition_count", "source partition count must be greater than zero"),
    "source_key": ("sources.partition_key", "source partition key must not be empty"),
    "source_twice": ("sources.source_id", "source ids must be unique"),
    "operator_id": ("operators.operator_id", "operator id must not be empty"),
    "operator_twice": ("operators.operator_id", "operator ids must be unique"),
    "sink_id": ("sinks.sink_id", "sink id must not be empty"),
    "sink_twice": ("sinks.sink_id", "sink ids must be unique"),
    "overlap": ("sources.source_id", "source ids must not overlap with operator ids"),
    "no_upstream": ("operators.upstream_ids", "operators must declare at least one upstream id"),
    "upstream_twice": ("operators.upstream_ids", "operators must not declare duplicate upstream ids"),
    "upstream_unknown": ("operators.upstream_ids", "operator upstream ids must reference known sources or operators"),
    "cycle": ("operators", "operator graph must be acyclic and fully connected from declared upstreams"),
    "sink_unknown": ("sinks.upstream_id", "sink upstream ids must reference known sources or operators"),
    "parallelism": ("deployment.parallelism", "deployment parallelism must be greater than zero"),
    "interval": ("deployment.checkpoint_interval_secs", "checkpoint interval must be greater than zero"),
    "in_flight": ("deployment.max_in_flight_messages", "max in-flight messages must be greater than zero"),
    "kafka_topic": ("sinks.kind.kafka.topic_name", "Kafka sink topic name is required"),
    "kafka_count": ("sinks.kind.kafka.partition_count", "Kafka sink partition count must match upstream partition count"),
    "kafka_key": ("sinks.kind.kafka.partition_key", "Kafka sink partition key must match upstream partition key"),
    "view_name": ("sinks.kind.materialized_view.view_name", "materialized view sink name is required"),
    "bucket": ("sinks.kind.object_storage.bucket", "object storage sink bucket is required"),
    "prefix": ("sinks.kind.object_storage.prefix", "object storage sink prefix is required"),
    "filter_empty": ("operators", "filter operators require a non-empty expression"),
    "map_empty": ("operators", "map operators require a non-empty projection"),
    "key_empty": ("operators", "keyBy operators require a non-empty key field"),
    "key_count": ("operators", "keyBy operators require a non-zero partition count"),
    "window_size": ("operators", "window operators require a positive window size"),
    "slide_missing": ("operators", "sliding windows require a slide interval to be configured"),
    "slide_range": ("operators", "sliding windows require a positive slide interval not greater than the window size"),
    "ttl": ("operators", "aggregate operators require a positive state ttl"),
    "join_key": ("operators", "join operators require a non-empty key field"),
    "join_within": ("operators", "join operators require a positive within window"),
    "join_count": ("operators", "join operators require upstream partition counts to match"),
    "join_keyed": ("operators", "join operators require both upstreams to be partitioned by the join key"),
    "enrich_table": ("operators", "enrich operators require a lookup table name"),
    "enrich_key": ("operators", "enrich operators require a non-empty key field"),
    "enrich_keyed": ("operators", "enrich operators require the upstream partition key to match the lookup key"),
}


def _blank(s: str) -> bool:
    return not s.strip()


def topological_order(p: S.Pipeline) -> list[str]:
    """Operator ids so that each follows its upstreams; those on or behind a cycle are left out.

    Operators that are ready together come in the order of their ids.
    """
    ids = {o.operator_id for o in p.operators}
    waiting = {i: 0 for i in sorted(ids)}
    feeds: dict[str, list[str]] = {i: [] for i in ids}
    for o in p.operators:
        for u in o.upstream_ids:
            if u in ids:
                feeds[u].append(o.operator_id)
                waiting[o.operator_id] += 1
    order = [i for i, n in waiting.items() if not n]
    for done in order:  # grows while it is gone through
        for then in feeds[done]:
            waiting[then] -= 1
            if not waiting[then]:
                order.append(then)
    return order


def _partitioning(op, inputs: list[tuple[int, str]]) -> tuple[int, str] | str:
    """(count, key) after an operator, or the name of what is wrong."""
    kind = op.kind
    checks: list[tuple[bool, str]] = {
        "filter": lambda: [(_blank(op.expression), "filter_empty")],
        "map": lambda: [(_blank(op.projection), "map_empty")],
        "key_by": lambda: [(_blank(op.key_field), "key_empty"), (op.partition_count == 0, "key_count")],
        "window": lambda: [(op.size_secs == 0, "window_size"), *([(op.slide_secs is None, "slide_missing"), (not 0 < (op.slide_secs or 0) <= op.size_secs, "slide_range")] if op.window == "sliding" else [])],
        "aggregate": lambda: [(op.state_ttl_secs == 0, "ttl")],
        "join": lambda: [(_blank(op.key_field), "join_key"), (op.within_secs == 0, "join_within")],
        "enrich": lambda: [(_blank(op.table_name), "enrich_table"), (_blank(op.key_field), "enrich_key")],
    }[kind]()
    for wrong, name in checks:
        if wrong:
            return name
    wanted, label = (2, "join") if kind == "join" else (1, {"key_by": "keyBy"}.get(kind, kind))
    if len(inputs) != wanted:
        return f"!{label} operators require exactly {wanted} upstream(s)"
    if kind == "key_by":
        return op.partition_count, op.key_field
    if kind == "join":
        if inputs[0][0] != inputs[1][0]:
            return "join_count"
        return (inputs[0][0], op.key_field) if inputs[0][1] == inputs[1][1] == op.key_field else "join_keyed"
    if kind == "enrich" and inputs[0][1] != op.key_field:
        return "enrich_keyed"
    return inputs[0]


def issues(p: S.Pipeline) -> list[Issue]:
    """Everything that is wrong with `p`; partitioning is only looked at where nothing else is."""
    out: list[Issue] = []

    def check(wrong: bool, name: str) -> None:
        if wrong:
            out.append(Issue(*_M[name]) if name[0] != "!" else Issue("operators", name[1:]))

    check(_blank(p.tenant_id), "tenant")
    check(_blank(p.pipeline_id), "pipeline")
    check(p.version == 0, "version")
    check(not p.sources, "no_sources")
    check(not p.sinks, "no_sinks")
    sources: set[str] = set()
    for s in p.sources:
        check(_blank(s.source_id), "source_id")
        check(_blank(s.topic_name), "source_topic")
        check(s.partition_count == 0, "source_count")
        check(_blank(s.partition_key), "source_key")
        check(s.source_id in sources, "source_twice")
        sources.add(s.source_id)
    operators: set[str] = set()
    for o in p.operators:
        check(_blank(o.operator_id), "operator_id")
        check(o.operator_id in operators, "operator_twice")
        operators.add(o.operator_id)
    sinks: set[str] = set()
    for k in p.sinks:
        check(_blank(k.sink_id), "sink_id")
        check(k.sink_id in sinks, "sink_twice")
        sinks.add(k.sink_id)
    for _ in sources & operators:
        check(True, "overlap")

    known = sources | operators
    for o in p.operators:
        check(not o.upstream_ids, "no_upstream")
        for i, u in enumerate(o.upstream_ids):
            check(u in o.upstream_ids[:i], "upstream_twice")
            check(u not in known, "upstream_unknown")
    order = topological_order(p)
    check(len(order) != len(p.operators), "cycle")
    for k in p.sinks:
        check(k.upstream_id not in known, "sink_unknown")
    check(p.deployment.parallelism == 0, "parallelism")
    check(p.deployment.checkpoint_interval_secs == 0, "interval")
    check(p.deployment.max_in_flight_messages == 0, "in_flight")
    if out:
        return out

    have: dict[str, tuple[int, str]] = {s.source_id: (s.partition_count, s.partition_key) for s in p.sources}
    by_id = {o.operator_id: o for o in p.operators}
    for i in order:
        got = _partitioning(by_id[i].op, [have[u] for u in by_id[i].upstream_ids if u in have])
        if isinstance(got, str):
            check(True, got)
        else:
            have[i] = got
    for k in p.sinks:
        if k.upstream_id not in have:
            continue
        count, key = have[k.upstream_id]
        if k.to.kind == "kafka":
            check(_blank(k.to.topic_name), "kafka_topic")
            check(k.to.partition_count != count, "kafka_count")
            check(k.to.partition_key != key, "kafka_key")
        elif k.to.kind == "materialized_view":
            check(_blank(k.to.view_name), "view_name")
        else:
            check(_blank(k.to.bucket), "bucket")
            check(_blank(k.to.prefix), "prefix")
    return out


def validate(p: S.Pipeline) -> None:
    """Raises InvalidPipeline with all issues, if there are any."""
    if found := issues(p):
        raise InvalidPipeline(found)
