"""Whole pipelines on small event lists, against known results and a plain interpreter."""

import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from millrace.functions import expressions as X
from millrace.operators import aggregates, joins, rows
from millrace.plans import replay
from millrace.plans import spec as S
from millrace.plans.compiler import NotRunnable, compile_pipeline
from millrace.sources.events import read_source
from millrace.streaming.engine import Engine, combined, source_options

T0 = 1_735_000_000_000


def frame(spark, source, events, schema, partition=0):
    """events: (offset, payload dict[, time offset ms[, partition]])."""
    data = []
    for e in events:
        offset, payload = e[0], e[1]
        ms = T0 + (e[2] if len(e) > 2 else offset * 1000)
        data.append(("tenant-a", "p", source, e[3] if len(e) > 3 else partition, offset, f"{source}-{offset}", ms, json.dumps(payload)))
    df = spark.createDataFrame(data, "tenant_id string, pipeline_id string, source_id string, partition_id int, offset long, record_key string, event_time_ms long, j string")
    return df.withColumn("payload", F.from_json("j", schema)).drop("j")


ORDER = "tenant_id string, status string, value double"


def counting(state="running", **kw):
    return S.Pipeline(
        "tenant-a", "p", 1, [S.Source("orders", "orders", 4, "tenant_id")],
        [
            S.Operator("paid", ["orders"], S.Filter("status == paid")),
            S.Operator("slim", ["paid"], S.Map("tenant_id, value")),
            S.Operator("win", ["slim"], S.Window("tumbling", 300, None, 30)),
            S.Operator("count_amount", ["win"], S.Aggregate("count", 600)),
        ],
        [S.Sink("view", "count_amount", S.ViewSink("orders_count_mv"))], deployment_state=state, **kw,
    )


def paid(value):
    return {"tenant_id": "tenant-a", "status": "paid", "value": value}


def emitted(c):
    return sorted((r.sink_id, r.offset, json.loads(r.payload), r.destination) for r in c.emissions().collect())


def test_two_events_two_counts(spark):
    c = compile_pipeline(counting(), {"orders": frame(spark, "orders", [(1, paid(10)), (2, paid(20))], ORDER)})
    assert emitted(c) == [("view", 1, {"count": 1}, "view:orders_count_mv"), ("view", 2, {"count": 2}, "view:orders_count_mv")]
    assert c.dead_letters.count() == 0


def test_missing_field_is_a_dead_letter(spark):
    events = [(1, {"tenant_id": "tenant-a", "value": 10}), (2, paid(20))]
    c = compile_pipeline(counting(), {"orders": frame(spark, "orders", events, ORDER)})
    (d,) = c.dead_letters.collect()
    assert (d.event_offset, d.failure_reason, d.retryable, d.record_key) == (1, "missing field status", False, "orders-1")
    assert json.loads(d.payload) == {"tenant_id": "tenant-a", "value": 10.0}
    assert [e[1:3] for e in emitted(c)] == [(2, {"count": 1})]


def test_strict_filter_before_operator_is_a_dead_letter(spark):
    src = {"orders": frame(spark, "orders", [(1, paid(1) | {"status": "open"}), (2, paid(2))], ORDER)}
    assert compile_pipeline(counting(), src).dead_letters.count() == 0
    c = compile_pipeline(counting(), src, strict=True)
    assert [r.failure_reason for r in c.dead_letters.collect()] == ["map operators received an empty upstream batch"]
    assert [e[1] for e in emitted(c)] == [2]


def test_states_that_do_not_run(spark):
    src = {"orders": frame(spark, "orders", [(1, paid(1))], ORDER)}
    for state, text in (("draft", "draft"), ("paused", "paused"), ("failed", "failed")):
        with pytest.raises(NotRunnable, match=text):
            compile_pipeline(counting(state), src)


def test_replay(spark):
    src = {"orders": frame(spark, "orders", [(n, paid(n)) for n in (5, 10, 11, 12)], ORDER)}
    job = replay.claim(replay.request(counting(), 10, 11, "fix"), "worker-a")
    seen = []
    done = replay.run(job, counting(), src, lambda c: seen.extend(emitted(c)))
    assert (done.status, done.last_processed_offset) == ("succeeded", 11)
    assert [e[1:3] for e in seen] == [(10, {"count": 1}), (11, {"count": 2})]
    failed = replay.run(job, counting("paused"), src, lambda c: None)
    assert failed.status == "failed" and "paused" in failed.error_message
    with pytest.raises(ValueError, match="reason"):
        replay.request(counting(), 1, 2, " ")


def test_any_branch_failing_stops_all_emissions(spark):
    p = counting()
    p = S.replaced(p, operators=[*p.operators, S.Operator("total", ["slim"], S.Aggregate("sum", 60))], sinks=[*p.sinks, S.Sink("sums", "total", S.ViewSink("sums"))])
    events = [(1, paid(1)), (2, paid(None)), (3, paid(3))]
    c = compile_pipeline(p, {"orders": frame(spark, "orders", events, ORDER)})
    assert [(s, o, x["count"]) for s, o, x, _ in emitted(c)] == [("sums", 1, 1), ("sums", 3, 2), ("view", 1, 1), ("view", 3, 3)]
    assert [r.failure_reason for r in c.dead_letters.collect()] == [X.NOT_NUMERIC]


def test_events_before_1970_are_dead_letters(spark):
    c = compile_pipeline(counting(), {"orders": frame(spark, "orders", [(1, paid(1), -T0 - 5), (2, paid(2))], ORDER)})
    assert [r.event_offset for r in c.dead_letters.collect()] == [1]


def test_sink_may_read_a_source(spark):
    p = S.replaced(counting(), operators=[], sinks=[S.Sink("raw", "orders", S.KafkaSink("copy", 4, "tenant_id"))])
    c = compile_pipeline(p, {"orders": frame(spark, "orders", [(1, paid(1))], ORDER)})
    assert emitted(c)[0][3] == "kafka:copy"


# -- expressions ----------------------------------------------------------
FIELDS = "i long, d double, s string, b boolean, o struct<x: long, value: double>"
ROW = {"i": 10, "d": 10.0, "s": "10", "b": True, "o": {"x": 1, "value": 2.5}}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("i == 10", True), ("d == 10", True), ("s == 10", False), ("s == '10'", True), ('s == "10"', True), ("b == true", True), ("b != false", True),
        ("i != 10.5", True), ("i == 10.5", False), ("i > 9.5", True), ("i >= 10", True), ("d < 10", False), ("d <= 10", True), ("o.x == 1", True), ("o > 2", True),
        ("TRUE", True), ("False", False), ("exists(o.x)", True), ("exists(o.y)", False), ("exists(zz)", False), ("s == nan", False), ("i == null", False),
        ("s > 5", X.NOT_NUMERIC), ("i > abc", X.NOT_NUMERIC), ("zz == 1", "missing field zz"), ("o.zz > 1", "missing field o.zz"),
        ("i = 10", "unsupported filter operator: ="), ("i == 10 and", "unsupported filter expression: i == 10 and"), ("Exists(i)", "unsupported filter expression: Exists(i)"),
    ],
)
def test_filter_language(spark, text, want):
    df = frame(spark, "s", [(1, ROW)], FIELDS)
    c = X.compile_filter(text, F.col("payload"), df.schema["payload"].dataType)
    holds, error = df.select(c.wanted, c.error).first()
    assert (error or holds) == want
    plain = rows.filter_events(df, S.Filter(text)).count()
    assert plain == (want is True)


def test_strict_whole_numbers_never_equal_literals(spark):
    df = frame(spark, "s", [(1, ROW)], FIELDS)
    kind = df.schema["payload"].dataType
    got = df.select(*[X.compile_filter(t, F.col("payload"), kind, strict=True).wanted for t in ("i == 10", "i != 10", "d == 10")]).first()
    assert list(got) == [False, True, True]


def test_projection(spark):
    df = frame(spark, "s", [(1, ROW)], FIELDS)
    out = rows.map_events(df, S.Map("o.x, i as n, zz, o.x as n2")).select("payload").first()[0].asDict()
    assert out == {"o.x": 1, "n": 10, "n2": 1}
    assert rows.map_events(df, S.Map("*")).first()["payload"] == df.first()["payload"]
    bad = rows.map_events(rows.with_errors(df), S.Map("i AS n")).first()
    assert bad["_error"] == "unsupported projection selector: i AS n"


def test_windows_and_enrichment(spark):
    df = frame(spark, "s", [(1, ROW, 61_500 - T0)], FIELDS)
    get = lambda op: tuple(rows.label_window(df, op).first()["payload"]["_window"])
    assert get(S.Window("tumbling", 60, None, 7)) == (60_000, 120_000, 7)
    assert get(S.Window("sliding", 60, 20, 7)) == (60_000, 120_000, 7)
    e = rows.enrich(df, S.Enrich("users", "o.x")).first()["payload"]["_enrichment"]
    assert (e["table"], e["key_field"], e["key_value"]) == ("users", "o.x", 1)
    assert rows.enrich(rows.with_errors(df), S.Enrich("users", "zz")).first()["_error"] == "missing enrichment key field zz"


@pytest.mark.parametrize("block", [None, 1_000_000, 3])
def test_running_aggregates(spark, block):
    r = random.Random(4)
    events = [(n, {"value": r.choice([1.5, -2.0, 7.0])}, n, n % 2) for n in range(20)]
    df = frame(spark, "s", events, "value double")
    for fn, f in {"sum": sum, "min": min, "max": max, "average": lambda v: sum(v) / len(v), "count": None}.items():
        out = aggregates.running_aggregate(df, S.Aggregate(fn, 60), exact=True, block=block).collect()
        for row in out:
            so_far = [e[1]["value"] for e in events if e[3] == row.partition_id and e[0] <= row.offset]
            assert row.payload["count"] == len(so_far)
            if f:
                assert row.payload["value"] == pytest.approx(f(so_far))


# -- joins ----------------------------------------------------------------
def interpret(events, kind, within_ms):
    """events: (offset, side, key, ms, partition); the join as it goes through one event after the other."""
    out, state = [], {}
    for o, side, key, ms, part in sorted(events, key=lambda e: (e[4], e[0], e[1])):
        s = state.setdefault(part, {"l": [], "r": []})
        for k in s:
            s[k] = [b for b in s[k] if b[1] >= max(0, ms - within_ms)]
        other = [b for b in s["r" if side == "l" else "l"] if b[0] == key and abs(b[1] - ms) <= within_ms]
        s[side].append((key, ms, o))
        pairs = [(o, o, b[2]) if side == "l" else (o, b[2], o) for b in other]
        out += [(part, *p) for p in pairs]
        if kind == "left" and side == "l" and not other:
            out.append((part, o, o, None))
    return sorted(out, key=str)


def sides(spark, events):
    schema = "k long, n long"
    return [frame(spark, src, [(o, {"k": k, "n": o}, ms, part) for o, s, k, ms, part in events if s == side], schema) for side, src in (("l", "left"), ("r", "right"))]


@pytest.mark.parametrize("seed", range(6))
def test_join_like_the_interpreter(spark, seed):
    r = random.Random(seed)
    events, t = [], 0
    for o in range(60):
        t += r.randint(0, 3000)
        late = r.choice([0, 0, 0, r.randint(0, 9000)]) if seed % 2 else 0
        events.append((o, r.choice("lr"), r.randint(0, 2), max(0, t - late), r.randint(0, 1)))
    left, right = sides(spark, events)
    for kind in ("inner", "left"):
        out = joins.interval_join(left, right, S.Join(kind, "k", 4), block=7)
        got = [(x.partition_id, x.offset, x.payload.left["n"], x.payload.right and x.payload.right["n"]) for x in out.collect()]
        assert sorted(got, key=str) == interpret(events, kind, 4000)


def test_runs_make_up_their_offsets(spark):
    r = random.Random(2)
    ranges = [(1, 1), (5, 5), (5, 4), (0, 16), (1, 40), (15, 17), (0, 4096), (3, 70_000)] + [(a, a + r.randint(0, 3000)) for a in (r.randint(0, 10**12) for _ in range(40))]
    for a, b, found in spark.createDataFrame(ranges, "a long, b long").select("a", "b", joins._runs(F.col("a"), F.col("b"))).collect():
        assert sorted(o for level, run in found for o in range(run << 4 * level, (run + 1) << 4 * level)) == [*range(a, b)]
        assert len(found) <= 30 * 4 + 1


def test_planning_a_join_runs_nothing(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        src = {i: frame(spark, i, [(1, {"account_id": "a"}, 5), (2, {"account_id": "b"}, 1)], "account_id string") for i in ("orders", "profiles")}
        compile_pipeline(joining(), src)
        assert not tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def joining(kind="left"):
    return S.Pipeline(
        "tenant-a", "p", 1, [S.Source("orders", "orders", 4, "account_id"), S.Source("profiles", "profiles", 4, "account_id")],
        [S.Operator("join", ["orders", "profiles"], S.Join(kind, "account_id", 60))], [S.Sink("out", "join", S.ViewSink("joined_mv"))],
    )


def test_left_join_fixture(spark):
    src = {"profiles": frame(spark, "profiles", [(1, {"account_id": "a-1", "plan": "pro"})], "account_id string, plan string"), "orders": frame(spark, "orders", [(2, {"account_id": "a-1", "amount": 42}), (3, {"amount": 1})], "account_id string, amount long")}
    c = compile_pipeline(joining(), src)
    ((_, offset, payload, _),) = emitted(c)
    assert (offset, payload["join_key"], payload["left"]["amount"], payload["right"]["plan"]) == (2, "a-1", 42, "pro")
    assert [d.failure_reason for d in c.dead_letters.collect()] == ["join key field account_id missing"]


def test_join_of_one_source_with_itself_sees_the_first_input_only(spark):
    p = S.Pipeline("tenant-a", "p", 1, [S.Source("s", "s", 4, "k")], [S.Operator("a", ["s"], S.Map("*")), S.Operator("j", ["s", "a"], S.Join("left", "k", 60))], [S.Sink("out", "j", S.ViewSink("v"))])
    c = compile_pipeline(p, {"s": frame(spark, "s", [(1, {"k": 1}), (2, {"k": 1})], "k long")})
    assert [x[2].get("right") for x in emitted(c)] == [None, None]


# -- streaming ------------------------------------------------------------
def _stream(spark, tmp_path, df, name, files):
    """A streaming frame over `df` cut into files by offset."""
    path = str(tmp_path / name)
    cuts = sorted({r.offset for r in df.select("offset").collect()})
    size = max(1, -(-len(cuts) // files))
    for i in range(0, len(cuts), size):
        df.where(F.col("offset").isin(cuts[i : i + size])).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_of_a_running_count_equals_the_batch(spark, tmp_path):
    events = [(n, paid(n) if n % 3 else paid(n) | {"status": "open"}, n * 1000, n % 2) for n in range(1, 13)] + [(13, {"value": 1.0})]
    df = frame(spark, "orders", events, ORDER)
    p = S.replaced(counting(), operators=[*counting().operators, S.Operator("sum", ["slim"], S.Aggregate("average", 60))], sinks=[*counting().sinks, S.Sink("avg", "sum", S.ObjectSink("b", "avg"))])
    batch = compile_pipeline(p, {"orders": df})
    engine = Engine(spark, p, str(tmp_path / "root"))
    q = engine.start({"orders": _stream(spark, tmp_path, df, "orders", 4)}, available_now=True)
    q.awaitTermination(120)
    for sink in ("view", "avg"):
        got = sorted((r.partition_id, r.offset, tuple(r.payload)) for r in engine.emissions(sink).collect())
        assert got == sorted((r.partition_id, r.offset, tuple(r.payload)) for r in batch.sinks[sink].collect())
    assert [r.event_offset for r in engine.dead_letters().collect()] == [13]
    # Started again on the same folder, there is nothing to do and nothing changes.
    n = engine.emissions("view").count()
    engine.start({"orders": _stream(spark, tmp_path, df.limit(0), "orders", 1)}, available_now=True).awaitTermination(120)
    assert engine.emissions("view").count() == n


def test_stream_of_a_left_join_equals_the_batch(spark, tmp_path):
    r = random.Random(9)
    events = [(o, r.choice("lr"), r.randint(0, 2), o * 900, 0) for o in range(30)]
    p = S.Pipeline("tenant-a", "p", 1, [S.Source("left", "l", 1, "k"), S.Source("right", "r", 1, "k")], [S.Operator("j", ["left", "right"], S.Join("left", "k", 4))], [S.Sink("out", "j", S.ViewSink("v"))])
    left, right = sides(spark, events)
    want = interpret(events, "left", 4000)
    engine = Engine(spark, p, str(tmp_path / "root"), dead_letters=False, ordered=True)
    for batch, (lo, hi) in enumerate(((0, 9), (10, 14), (15, 29))):
        part = [df.where(F.col("offset").between(lo, hi)) for df in (left, right)]
        engine.process(combined({"left": part[0], "right": part[1]}), batch)
        engine.process(combined({"left": part[0], "right": part[1]}), batch)  # repeated batches change nothing
    got = [(x.partition_id, x.offset, x.payload.left["n"], x.payload.right and x.payload.right["n"]) for x in engine.emissions("out").collect()]
    assert sorted(got, key=str) == want


def test_filters_reach_the_scan(spark):
    from millrace.queries import event_log

    df = rows.filter_events(event_log(spark, "/root/testdata/sf0.001"), S.Filter("event_type == purchase")).select("offset")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan
    assert "value" not in plan.split("ReadSchema")[1]


def test_replaced_keeps_the_rest():
    assert replace(counting().sources[0], partition_count=2).partition_key == "tenant_id"


def _rows(df):
    return sorted(((r.partition_id, r.offset, r.payload.asDict(True)) for r in df.collect()), key=lambda x: (x[0], x[1], str(x[2])))


def _in_batches(spark, p, sources, root, cuts, **options):
    """An engine that has got the sources' events in batches that end before the offsets `cuts`, the first of them twice."""
    engine = Engine(spark, p, root, **options)
    for batch, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, 1 << 40])):
        part = combined({i: df.where((F.col("offset") >= lo) & (F.col("offset") < hi)) for i, df in sources.items()})
        for _ in range(1 if batch else 2):
            engine.process(part, batch)
    return engine


@pytest.mark.parametrize("strict", [False, True])
def test_streamed_aggregates_equal_the_batch(spark, tmp_path, strict):
    r = random.Random(6)
    events = [(n, {"value": r.choice([1.5, -2.25, None, 7.0]), "open": r.choice([0, 1, None])}, n * 1000, n % 2) for n in range(1, 25)]
    src = {"s": frame(spark, "s", events, "value double, open long")}
    before = {"s": [], "some": [S.Operator("some", ["s"], S.Filter("open == 1"))]}
    before["slim"] = [*before["some"], S.Operator("slim", ["some"], S.Map("value"))]
    # One aggregate to a pipeline: an event that fails in any branch has no emission.
    cases = [("some", "count"), ("slim", "sum")] if strict else [("some", "count"), ("s", "average"), *(("slim", f) for f in ("sum", "min", "max"))]
    for up, f in cases:
        p = S.Pipeline("tenant-a", f"{up}-{f}", 1, [S.Source("s", "s", 2, "open")], [*before[up], S.Operator("out", [up], S.Aggregate(f, 60))], [S.Sink("out", "out", S.ViewSink("v"))])
        options = {"strict": strict, "exact_sums": f in ("sum", "average")}
        batch = compile_pipeline(p, src, **options)
        engine = _in_batches(spark, p, src, str(tmp_path / "root"), (7, 8), **options)
        assert _rows(engine.emissions("out")) == _rows(batch.sinks["out"]), (up, f)
        assert sorted((d.event_offset, d.failure_reason) for d in engine.dead_letters().collect()) == sorted((d.event_offset, d.failure_reason) for d in batch.dead_letters.collect())


@pytest.mark.parametrize("kind", ["inner", "left"])
@pytest.mark.parametrize("strict", [False, True])
def test_streamed_joins_equal_the_batch(spark, tmp_path, kind, strict):
    r = random.Random(12)
    events = [(o, r.choice("lr"), r.randint(0, 1), max(1, o * 900 - r.choice([0, 0, 5000])), 0) for o in range(1, 26)]
    schema = "k long, n long, open long"
    src = {i: frame(spark, i, [(o, {"k": k if o % 6 else None, "n": o, "open": o % 4}, ms, part) for o, s, k, ms, part in events if s == side], schema) for side, i in (("l", "left"), ("r", "right"))}
    p = S.Pipeline(
        "tenant-a", "p", 1, [S.Source("left", "l", 1, "k"), S.Source("right", "r", 1, "k")],
        [S.Operator("some", ["left"], S.Filter("open != 2")), S.Operator("j", ["some", "right"], S.Join(kind, "k", 4))], [S.Sink("out", "j", S.ViewSink("v"))],
    )
    batch = compile_pipeline(p, src, strict=strict)
    engine = _in_batches(spark, p, src, str(tmp_path / "root"), (12,), strict=strict)
    want = _rows(batch.sinks["out"])
    assert _rows(engine.emissions("out")) == want and want
    assert sorted((d.event_offset, d.failure_reason) for d in engine.dead_letters().collect()) == sorted((d.event_offset, d.failure_reason) for d in batch.dead_letters.collect())


def test_state_goes_when_it_is_not_needed(spark, tmp_path):
    src = {"s": frame(spark, "s", [(n, {"value": 1.0}, n * 1000) for n in (1, 2, 200, 201)], "value double")}
    p = S.Pipeline("tenant-a", "p", 1, [S.Source("s", "s", 1, "value")], [S.Operator("n", ["s"], S.Aggregate("count", 60))], [S.Sink("out", "n", S.ViewSink("v"))])
    engine = _in_batches(spark, p, src, str(tmp_path / "a"), (2, 100, 201))
    assert [r["count"] for _, _, r in _rows(engine.emissions("out"))] == [1, 2, 3, 4]
    assert len([*(tmp_path / "a").glob("**/state/*/*/batch=*")]) == 2
    engine = _in_batches(spark, p, src, str(tmp_path / "b"), (2, 100, 201), expire_state=True)
    assert [r["count"] for _, _, r in _rows(engine.emissions("out"))] == [1, 2, 1, 2]


def test_reader_options_bound_a_batch():
    p = joining()
    assert source_options(p, p.sources[0]) == {"subscribe": "orders", "maxOffsetsPerTrigger": str(4 * p.deployment.max_in_flight_messages)}


def test_strict_operators_after_a_join_take_the_oldest_match(spark):
    events = [(1, "r", 1, 1000, 0), (2, "r", 1, 2000, 0), (3, "l", 1, 3000, 0), (4, "r", 1, 4000, 0), (5, "l", 2, 5000, 0)]
    left, right = sides(spark, events)
    p = S.Pipeline(
        "tenant-a", "p", 1, [S.Source("left", "l", 1, "k"), S.Source("right", "r", 1, "k")],
        [S.Operator("j", ["left", "right"], S.Join("left", "k", 60)), S.Operator("m", ["j"], S.Map("left.n as l, right.n as r"))], [S.Sink("out", "m", S.ViewSink("v")), S.Sink("all", "j", S.ViewSink("w"))],
    )
    for strict, want in ((False, [(3, 3, 1), (3, 3, 2), (4, 3, 4), (5, 5, None)]), (True, [(3, 3, 1), (4, 3, 4), (5, 5, None)])):
        c = compile_pipeline(p, {"left": left, "right": right}, strict=strict)
        assert sorted((r.offset, r.payload.l, r.payload.r) for r in c.sinks["out"].collect()) == want
        assert sorted(r.offset for r in c.sinks["all"].collect()) == [3, 3, 4, 5]
        assert tuple(c.totals().first()) == (5, len(want) + 4)


def test_json_lines_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        read_source(spark, "json", str(tmp_path))
    with pytest.raises(ValueError):
        read_source(spark, "protobuf", str(tmp_path))
