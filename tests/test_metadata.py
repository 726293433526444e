import duckdb
import pytest
from pyspark.sql import functions as F

from millrace import queries as Q
from millrace.functions.text import normalize_labels, slugify
from millrace.plans import coordination as C
from millrace.plans import introspection as I
from millrace.plans import metadata as M
from millrace.plans import spec as S
from millrace.streaming import windows

SF = "/root/testdata/sf0.001"


def pipeline(partitions=4, state="running", version=1, pipeline_id="orders-throughput", tenant="tenant-a"):
    return S.Pipeline(tenant, pipeline_id, version, [S.Source("s", "s", partitions, "k")], [], [S.Sink("out", "s", S.ViewSink("v"))], deployment_state=state)


def test_run_status_fixture(spark):
    row = I.run_status(
        "tenant-a", "p", "running",
        watermarks=spark.createDataFrame([(0, 108), (1, 100)], "partition_id int, max_offset long"),
        checkpoints=spark.createDataFrame([(0, 100, 1990), (1, 92, 1980)], "partition_id int, kafka_offset long, created_at long"),
        assignments=spark.createDataFrame([(0, "worker-a")], "partition_id int, worker_id string"),
        workers=spark.createDataFrame([("worker-a", "ready", 1990)], "worker_id string, status string, last_heartbeat_at long"),
        replay_jobs=spark.createDataFrame([("replay-1", "running")], "replay_job_id string, status string"),
        dead_letters=spark.createDataFrame([(1, 88)], "partition_id int, event_offset long"),
        now=2000, stale_after=90,
    ).first()
    assert tuple(row)[2:] == ("rebalancing", 16, 10, 1, 1, 1, 1)


def test_run_status_of_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    row = I.run_status("t", "p", "running", watermarks=empty("partition_id int, max_offset long"), checkpoints=empty("partition_id int, kafka_offset long, created_at long"), assignments=empty("partition_id int, worker_id string"), workers=empty("worker_id string, status string, last_heartbeat_at long"), replay_jobs=empty("status string"), dead_letters=empty("event_offset long"), now=5, stale_after=1).first()
    assert tuple(row)[2:] == ("pending", 0, I.NO_CHECKPOINT_AGE, 0, 0, 0, 0)
    with pytest.raises(ValueError, match="tenant id"):
        I.listing(empty("tenant_id string"), "assignments", " ", "p")


def test_states(spark):
    for state, want in (("draft", "pending"), ("validated", "pending"), ("deploying", "deploying"), ("paused", "paused"), ("failed", "failed")):
        assert spark.range(1).select(I.derived_state(state, F.lit(1), F.lit(1))).first()[0] == want


def test_registration():
    w = C.register(C.Worker("worker-a", "http://a", "az", 2, (" Streaming", "general", "general", ""), active_assignments=99), 7)
    assert (w.status, w.active_assignments, w.labels, w.registered_at, w.last_heartbeat_at) == ("ready", 0, ("general", "streaming"), 7, 7)
    with pytest.raises(ValueError, match="max assignments"):
        C.register(C.Worker("a", "b", "c", 0), 1)
    assert C.heartbeat(C.Worker("a", "b", "c", 1, status="expired"), 9).status == "ready"
    assert C.heartbeat(C.Worker("a", "b", "c", 1, status="draining"), 9).status == "draining"


def test_rebalance():
    workers = [C.register(C.Worker(f"worker-{c}", "e", "z", 2), 100) for c in "ab"]
    out = C.rebalance(pipeline(version=3), workers, [], 100, 90)
    assert [(a.partition_id, a.worker_id, a.lease_epoch, a.version) for a in out] == [(0, "worker-a", 1, 3), (1, "worker-b", 1, 3), (2, "worker-a", 1, 3), (3, "worker-b", 1, 3)]
    assert C.rebalance(pipeline(2), workers, out, 100, 90)[0].lease_epoch == 2
    with pytest.raises(ValueError, match="capacity is lower"):
        C.rebalance(pipeline(5), workers, [], 100, 90)
    with pytest.raises(ValueError, match="no ready workers"):
        C.rebalance(pipeline(), workers, [], 191, 90)
    with pytest.raises(ValueError, match="paused pipelines"):
        C.rebalance(pipeline(state="paused"), workers, [], 100, 90)


def test_expiry(spark):
    w = spark.createDataFrame([("worker-a", "ready", 0), ("worker-b", "ready", 119)], "worker_id string, status string, last_heartbeat_at long")
    a = spark.createDataFrame([("t", "p", 0, "worker-a"), ("t", "p", 1, "worker-a"), ("t", "p", 2, "worker-b")], "tenant_id string, pipeline_id string, partition_id int, worker_id string")
    e = C.expire(w, a, 120, 1)
    assert [r[0] for r in e.expired.collect()] == ["worker-a"]
    assert e.revoked.count() == 2 and e.assignments.count() == 1
    assert C.expire(w, a, 80, 0).expired.count() == 0


def test_registry(spark):
    r = M.Registry()
    r.create(pipeline())
    with pytest.raises(ValueError, match="already exists"):
        r.create(pipeline())
    with pytest.raises(ValueError, match="must increase"):
        r.update(pipeline())
    r.update(pipeline(version=2, state="validated"))
    r.create(pipeline(pipeline_id="other"))
    assert [p.version for p in r.list("tenant-a", "validated")] == [2]
    assert r.get("tenant-a", "orders-throughput", 1).version == 1
    assert r.set_state("tenant-a", "orders-throughput", "paused").version == 3
    r.register_topic("tenant-a", "orders", 12, 168)
    with pytest.raises(ValueError, match="partition count"):
        r.register_topic("tenant-a", "orders", 0, 168)
    r.add_tenant("tenant-acme", "Acme", "acme")
    r.bind("user", "user-123", "tenant-acme", "tenant_admin")
    r.bind("user", "root", None, "platform_admin")
    r.bind("user", "ed", "tenant-acme", "pipeline_editor")
    assert r.add_service_account("tenant-acme", "Control Plane") == "tenant-acme-control-plane"
    assert r.is_authorized("user", "user-123", "tenant-acme", "pipeline_editor")
    assert not r.is_authorized("user", "user-123", "tenant-b", "pipeline_viewer")
    assert r.is_authorized("user", "root", "tenant-b", "topic_editor")
    assert r.is_authorized("user", "ed", "tenant-acme", "pipeline_viewer") and not r.is_authorized("user", "ed", "tenant-acme", "topic_viewer")
    assert {x.subject_id for x in M.authorized(r.frame(spark, "bindings"), "tenant-acme", "pipeline_viewer").collect()} == {"user-123", "root", "ed"}
    now = M.list_pipelines(M.current_versions(r.frame(spark, "pipelines"), r.frame(spark, "versions")))
    assert [(x.pipeline_id, x.version) for x in now.collect()] == [("orders-throughput", 3), ("other", 1)]


def test_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert {tuple(r) for r in M.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], t.schema), ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    all_rows, fresh = M.insert_new(t, spark.createDataFrame([(2, "c"), (3, "d")], t.schema), ["id"])
    assert {tuple(r) for r in all_rows.collect()} == {(1, "a"), (2, "b"), (3, "d")} and fresh.count() == 1


def test_text(spark):
    row = spark.createDataFrame([("  Ünï--Code & Co. 7! ", [" B", "a", "b ", ""])], "s string, l array<string>").select(slugify("s"), normalize_labels("l")).first()
    assert list(row) == [M.slug("  Ünï--Code & Co. 7! "), ["a", "b"]]
    assert row[0] == "n-code-co-7"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_queries_equal_their_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    r = duck.execute(Q.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


def _compared(spark, tmp_path, name, events):
    """The rows of a query and of its SQL on a table of events (event_id, ts, user_id, event_type, value)."""
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, ?, ?, ?, ?, '{\"k\": 1}')", events)
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    r = con.execute(Q.SQL[name])
    want = sorted(r.fetchall())
    return sorted(tuple(x) for x in Q.QUERIES[name](spark, str(tmp_path)).select(*[d[0] for d in r.description]).collect()), want


def test_a_session_ends_where_the_gap_is_whole(spark, tmp_path):
    at = ["2024-01-01 00:00:00", "2024-01-01 02:00:00", "2024-01-01 03:59:59.999", "2024-01-01 05:59:59.999", "2024-01-01 08:00:00"]
    got, want = _compared(spark, tmp_path, "session_counts", [(i, t, 7, "view", 1.0) for i, t in enumerate(at)])
    assert got == want and [n for *_, n in got] == [1, 2, 1, 1]
    df = spark.createDataFrame([(t,) for t in (0, 1999, 2000, 4000)], "event_time_ms long")
    out = windows.session_aggregate(df, 2, {}, {"n": F.count(F.lit(1))}).collect()
    assert sorted(tuple(r) for r in out) == [(0, 4000, 3), (4000, 6000, 1)]


def test_first_matches_begin_at_place_0_and_have_one_row_for_a_number(spark, tmp_path):
    click, purchase = "click", "purchase"
    hours = lambda h: f"2024-01-01 {h:02d}:00:00"
    events = [
        (0, hours(0), 7, click, 1.0), (1, hours(0), 7, click, 2.0), (2, hours(1), 7, purchase, 3.0),
        # Other partitions with the same numbers; the oldest match of number 6 is user 6's.
        (5, hours(10), 5, click, 4.0), (6, hours(10), 5, purchase, 5.0), (4, hours(10), 6, purchase, 6.0), (6, hours(10), 6, click, 7.0),
    ]
    got, want = _compared(spark, tmp_path, "join_first_match", events)
    assert got == want == [(2, 6, 6, 7.0, 6.0), (3, 2, 7, 1.0, 3.0)]
