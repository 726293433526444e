from dataclasses import replace

import pytest

from millrace.plans import spec as S
from millrace.plans.validate import InvalidPipeline, issues, topological_order, validate


def throughput():
    return S.Pipeline(
        "tenant-a", "order-throughput", 1,
        [S.Source("orders", "orders", 12, "account_id")],
        [
            S.Operator("accepted", ["orders"], S.Filter("status == 'accepted'")),
            S.Operator("minutes", ["accepted"], S.Window("tumbling", 60, None, 10)),
            S.Operator("count", ["minutes"], S.Aggregate("count", 300)),
        ],
        [S.Sink("out", "count", S.KafkaSink("orders-materialized", 12, "account_id"))],
    )


def settlement():
    return S.Pipeline(
        "tenant-a", "settlement-enrichment", 3,
        [S.Source("payments", "payments", 12, "merchant_id"), S.Source("disputes", "disputes", 12, "merchant_id")],
        [S.Operator("pairs", ["payments", "disputes"], S.Join("inner", "merchant_id", 600))],
        [S.Sink("out", "pairs", S.ObjectSink("analytics-snapshots", "settlements/hourly"))],
    )


def with_op(p, i, **changes):
    ops = list(p.operators)
    ops[i] = replace(ops[i], **changes)
    return S.replaced(p, operators=ops)


def test_valid_pipelines_and_json_round_trip():
    for p in (throughput(), settlement()):
        assert issues(p) == []
        validate(p)
        assert S.Pipeline.from_json(p.to_json()) == p


@pytest.mark.parametrize(
    ("change", "text"),
    [
        (lambda p: with_op(with_op(p, 0, upstream_ids=("minutes",)), 1, upstream_ids=("accepted",)), "acyclic"),
        (lambda p: S.replaced(p, sources=[*p.sources, p.sources[0]]), "source ids must be unique"),
        (lambda p: with_op(p, 1, op=S.Window("sliding", 60, 90, 10)), "slide interval"),
        (lambda p: with_op(p, 1, op=S.Window("sliding", 60, None, 10)), "slide interval to be configured"),
        (lambda p: with_op(p, 1, op=S.Window("tumbling", 0)), "positive window size"),
        (lambda p: S.replaced(p, sinks=[S.Sink("out", "count", S.KafkaSink("t", 6, "account_id"))]), "Kafka sink partition count"),
        (lambda p: S.replaced(p, sinks=[S.Sink("out", "count", S.KafkaSink("t", 12, "other"))]), "partition key must match"),
        (lambda p: S.replaced(p, sources=[S.Source("orders", "orders", 0, "account_id")]), "partition count must be greater"),
        (lambda p: S.replaced(p, version=0), "pipeline version"),
        (lambda p: S.replaced(p, sinks=[]), "at least one sink"),
        (lambda p: S.replaced(p, deployment=S.Deployment(parallelism=0)), "parallelism"),
        (lambda p: with_op(p, 0, upstream_ids=("nowhere",)), "known sources or operators"),
        (lambda p: with_op(p, 0, upstream_ids=("orders", "orders")), "duplicate upstream"),
        (lambda p: with_op(p, 0, op=S.Filter(" ")), "non-empty expression"),
        (lambda p: with_op(p, 2, op=S.Aggregate("count", 0)), "positive state ttl"),
        (lambda p: with_op(p, 2, op=S.Enrich("t", "status")), "match the lookup key"),
    ],
)
def test_messages(change, text):
    with pytest.raises(InvalidPipeline) as e:
        validate(change(throughput()))
    assert text in str(e.value)


def test_join_needs_equal_partitions():
    p = settlement()
    p = S.replaced(p, sources=[p.sources[0], replace(p.sources[1], partition_count=6)])
    assert any("partition counts to match" in i.message for i in issues(p))


def test_all_issues_are_gathered():
    p = S.replaced(throughput(), tenant_id="", pipeline_id=" ", version=0)
    assert [i.field for i in issues(p)] == ["tenant_id", "pipeline_id", "version"]


def test_topological_order_is_by_id_among_ready():
    p = S.replaced(throughput(), operators=[S.Operator("b", ["orders"], S.Map("*")), S.Operator("a", ["orders"], S.Map("*")), S.Operator("c", ["b", "a"], S.Join("inner", "account_id", 1))])
    assert topological_order(p) == ["a", "b", "c"]
