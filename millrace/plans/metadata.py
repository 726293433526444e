"""Pipelines and their versions, topics, tenants, roles and service accounts, as tables.

Tables are small and Parquet has no updates, so a write makes the next table from the
last: `upsert` and `insert_new` give the frame to be written. `Registry` keeps the
tables of one session.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans import spec as S
from millrace.plans.validate import validate


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with `rows` in place of those with equal keys; of equal keys within `rows` the row with the smallest hash."""
    newer = rows.withColumn("_new", F.lit(1)).unionByName(table.withColumn("_new", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.xxhash64(*table.columns)))
    return newer.withColumn("_rank", rank).where("_rank = 1").drop("_new", "_rank")


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """`table` with the rows whose keys it lacks, and those rows; of equal keys the row with the smallest hash."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*rows.columns)))
    fresh = rows.join(table.select(*keys), keys, "left_anti").withColumn("_rank", first).where("_rank = 1").drop("_rank")
    return table.unionByName(fresh), fresh


def current_versions(pipelines: DataFrame, versions: DataFrame) -> DataFrame:
    """The version row that is current for each pipeline."""
    now = pipelines.select("tenant_id", "pipeline_id", F.col("current_version").alias("version"))
    return versions.join(now, ["tenant_id", "pipeline_id", "version"])


def list_pipelines(current: DataFrame, tenant_id: str | None = None, state: str | None = None) -> DataFrame:
    """Current versions of a tenant and state, if given."""
    for name, wanted in (("tenant_id", tenant_id), ("deployment_state", state)):
        if wanted is not None:
            current = current.where(F.col(name) == wanted)
    return current.orderBy("tenant_id", "pipeline_id")


# Roles, and those that a role includes besides itself.
ROLES = ("platform_admin", "tenant_admin", "pipeline_editor", "pipeline_viewer", "topic_editor", "topic_viewer")
_INCLUDES = {"platform_admin": set(ROLES), "tenant_admin": set(ROLES), "pipeline_editor": {"pipeline_viewer"}, "topic_editor": {"topic_viewer"}}


def authorized(bindings: DataFrame, tenant_id: str, role: str) -> DataFrame:
    """Subjects with `role` in a tenant: by the role or one that includes it, in the tenant or everywhere."""
    granting = [r for r in ROLES if r == role or role in _INCLUDES.get(r, ())]
    return bindings.where(F.col("role").isin(granting) & (F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant_id))).select("subject_kind", "subject_id").distinct()


def slug(text: str) -> str:
    """ASCII lower case, runs of other characters one hyphen, none at the ends."""
    kept = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text)
    return "-".join(kept.split())


def client_id(tenant_id: str, display_name: str) -> str:
    return f"{slug(tenant_id)}-{slug(display_name)}"


@dataclass
class Registry:
    """Pipelines by version, topics, tenants, roles and service accounts of one session."""

    pipelines: dict[tuple[str, str], dict[int, S.Pipeline]] = field(default_factory=dict)
    topics: dict[tuple[str, str], tuple[int, int]] = field(default_factory=dict)
    tenants: dict[str, tuple[str, str, bool]] = field(default_factory=dict)
    bindings: set[tuple[str, str, str | None, str]] = field(default_factory=set)
    service_accounts: dict[str, tuple[str, str, str, bool]] = field(default_factory=dict)

    def create(self, p: S.Pipeline) -> S.Pipeline:
        validate(p)
        if (p.tenant_id, p.pipeline_id) in self.pipelines:
            raise ValueError("pipeline already exists")
        self.pipelines[p.tenant_id, p.pipeline_id] = {p.version: p}
        return p

    def update(self, p: S.Pipeline) -> S.Pipeline:
        validate(p)
        known = self.pipelines.get((p.tenant_id, p.pipeline_id))
        if known is None:
            raise KeyError("pipeline not found")
        if p.version <= max(known):
            raise ValueError("pipeline version must increase")
        known[p.version] = p
        return p

    def get(self, tenant_id: str, pipeline_id: str, version: int | None = None) -> S.Pipeline:
        known = self.pipelines.get((tenant_id, pipeline_id))
        if not known or version is not None and version not in known:
            raise KeyError("pipeline not found")
        return known[max(known) if version is None else version]

    def list(self, tenant_id: str | None = None, state: str | None = None) -> list[S.Pipeline]:
        now = [self.get(*k) for k in sorted(self.pipelines)]
        return [p for p in now if tenant_id in (None, p.tenant_id) and state in (None, p.deployment_state)]

    def set_state(self, tenant_id: str, pipeline_id: str, state: str) -> S.Pipeline:
        """Deploy, pause or resume: a new version in another state."""
        p = self.get(tenant_id, pipeline_id)
        return self.update(S.replaced(p, version=p.version + 1, deployment_state=state))

    def register_topic(self, tenant_id: str, name: str, partitions: int, retention_hours: int) -> None:
        for what, value in (("tenant id", tenant_id), ("topic name", name)):
            if not value.strip():
                raise ValueError(f"{what} must not be empty")
        if partitions <= 0:
            raise ValueError("topic partition count must be greater than zero")
        if retention_hours <= 0:
            raise ValueError("topic retention must be greater than zero")
        self.topics[tenant_id, name] = (partitions, retention_hours)

    def add_tenant(self, tenant_id: str, display_name: str, realm: str, enabled: bool = True) -> None:
        if not tenant_id.strip():
            raise ValueError("tenant id must not be empty")
        self.tenants[tenant_id] = (display_name, realm, enabled)

    def bind(self, subject_kind: str, subject_id: str, tenant_id: str | None, role: str) -> None:
        if role not in ROLES:
            raise ValueError(f"unknown role: {role}")
        self.bindings.add((subject_kind, subject_id, tenant_id, role))

    def add_service_account(self, tenant_id: str, display_name: str) -> str:
        name = client_id(tenant_id, display_name)
        self.service_accounts[name] = (tenant_id, name, display_name, True)
        return name

    def is_authorized(self, subject_kind: str, subject_id: str, tenant_id: str, role: str) -> bool:
        return any((k, s) == (subject_kind, subject_id) and t in (None, tenant_id) and (r == role or role in _INCLUDES.get(r, ())) for k, s, t, r in self.bindings)

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        """One of the tables as a frame: pipelines, versions, topics, tenants, bindings or service_accounts."""
        versions = [(p.tenant_id, p.pipeline_id, p.version, p.deployment_state, p.to_json()) for by in self.pipelines.values() for p in by.values()]
        rows, schema = {
            "pipelines": ([(*k, max(v)) for k, v in self.pipelines.items()], "tenant_id string, pipeline_id string, current_version long"),
            "versions": (versions, "tenant_id string, pipeline_id string, version long, deployment_state string, spec string"),
            "topics": ([(*k, *v) for k, v in self.topics.items()], "tenant_id string, topic_name string, partition_count int, retention_hours int"),
            "tenants": ([(k, *v) for k, v in self.tenants.items()], "tenant_id string, display_name string, oidc_realm string, enabled boolean"),
            "bindings": (sorted(self.bindings, key=str), "subject_kind string, subject_id string, tenant_id string, role string"),
            "service_accounts": ([(k, *v) for k, v in self.service_accounts.items()], "service_account_id string, tenant_id string, client_id string, display_name string, enabled boolean"),
        }[table]
        return spark.createDataFrame(rows, schema)
