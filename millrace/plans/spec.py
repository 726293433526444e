"""Pipeline definitions: sources, operators and sinks as plain data, to and from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, ClassVar


@dataclass(frozen=True)
class Source:
    source_id: str
    topic_name: str
    partition_count: int
    partition_key: str
    encoding: str = "json"  # json, avro or protobuf


@dataclass(frozen=True)
class Filter:
    kind: ClassVar[str] = "filter"
    expression: str


@dataclass(frozen=True)
class Map:
    kind: ClassVar[str] = "map"
    projection: str


@dataclass(frozen=True)
class KeyBy:
    kind: ClassVar[str] = "key_by"
    key_field: str
    partition_count: int


@dataclass(frozen=True)
class Window:
    kind: ClassVar[str] = "window"
    window: str  # tumbling or sliding
    size_secs: int
    slide_secs: int | None = None
    grace_secs: int = 0


@dataclass(frozen=True)
class Aggregate:
    kind: ClassVar[str] = "aggregate"
    function: str  # count, sum, min, max or average
    state_ttl_secs: int


@dataclass(frozen=True)
class Join:
    kind: ClassVar[str] = "join"
    join: str  # inner or left
    key_field: str
    within_secs: int


@dataclass(frozen=True)
class Enrich:
    kind: ClassVar[str] = "enrich"
    table_name: str
    key_field: str


@dataclass(frozen=True)
class Operator:
    operator_id: str
    upstream_ids: tuple[str, ...]
    op: Filter | Map | KeyBy | Window | Aggregate | Join | Enrich

    def __post_init__(self):
        object.__setattr__(self, "upstream_ids", tuple(self.upstream_ids))


@dataclass(frozen=True)
class KafkaSink:
    kind: ClassVar[str] = "kafka"
    topic_name: str
    partition_count: int
    partition_key: str

    @property
    def destination(self) -> str:
        return f"kafka:{self.topic_name}"


@dataclass(frozen=True)
class ViewSink:
    kind: ClassVar[str] = "materialized_view"
    view_name: str

    @property
    def destination(self) -> str:
        return f"view:{self.view_name}"


@dataclass(frozen=True)
class ObjectSink:
    kind: ClassVar[str] = "object_storage"
    bucket: str
    prefix: str

    @property
    def destination(self) -> str:
        return f"object-storage:{self.bucket}/{self.prefix}"


@dataclass(frozen=True)
class Sink:
    sink_id: str
    upstream_id: str
    to: KafkaSink | ViewSink | ObjectSink


@dataclass(frozen=True)
class Deployment:
    parallelism: int = 1
    checkpoint_interval_secs: int = 30
    max_in_flight_messages: int = 1024


@dataclass(frozen=True)
class ReplayPolicy:
    allow_manual_replay: bool = True
    retention_hours: int = 168


#: Life of a pipeline version; only RUNNABLE ones are executed.
STATES = ("draft", "validated", "deploying", "running", "paused", "failed")
RUNNABLE = frozenset(("validated", "deploying", "running"))


@dataclass(frozen=True)
class Pipeline:
    tenant_id: str
    pipeline_id: str
    version: int
    sources: tuple[Source, ...]
    operators: tuple[Operator, ...]
    sinks: tuple[Sink, ...]
    deployment: Deployment = field(default_factory=Deployment)
    replay_policy: ReplayPolicy = field(default_factory=ReplayPolicy)
    deployment_state: str = "validated"

    def __post_init__(self):
        for name in ("sources", "operators", "sinks"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    def to_json(self) -> str:
        return json.dumps(_plain(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Pipeline:
        d = json.loads(text)
        return Pipeline(
            **{k: d[k] for k in ("tenant_id", "pipeline_id", "version")},
            sources=[Source(**s) for s in d["sources"]],
            operators=[Operator(o["operator_id"], o["upstream_ids"], _tagged(_OPS, o["op"])) for o in d["operators"]],
            sinks=[Sink(s["sink_id"], s["upstream_id"], _tagged(_SINKS, s["to"])) for s in d["sinks"]],
            deployment=Deployment(**d.get("deployment", {})),
            replay_policy=ReplayPolicy(**d.get("replay_policy", {})),
            deployment_state=d.get("deployment_state", "validated"),
        )


_OPS = {c.kind: c for c in (Filter, Map, KeyBy, Window, Aggregate, Join, Enrich)}
_SINKS = {c.kind: c for c in (KafkaSink, ViewSink, ObjectSink)}


def _tagged(kinds: dict, d: dict) -> Any:
    d = dict(d)
    return kinds[d.pop("kind")](**d)


def _plain(x: Any) -> Any:
    if is_dataclass(x):
        tag = {"kind": x.kind} if hasattr(x, "kind") else {}
        return tag | {f.name: _plain(getattr(x, f.name)) for f in fields(x)}
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    return x


def replaced(p: Pipeline, **changes: Any) -> Pipeline:
    """A copy of `p` with other values."""
    return Pipeline(**({f.name: getattr(p, f.name) for f in fields(p)} | changes))
