"""Status streams: the stream gives what the table gives."""

import datetime as dt

from pyspark.sql import functions as F

from loamworks.streaming import status


def _rows(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_idle_sessions_stream_equals_table(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", t(0)), ("a", t(10)), ("a", t(40)), ("b", t(5)), ("z", t(10_000))]
    table, stream = _rows(spark, tmp_path, rows, "user string, ts timestamp")
    q = status.idle_sessions(stream, "user").writeStream.format("memory").queryName("idle").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in status.idle_sessions(table, "user").collect() if r["user"] != "z"}
    assert {tuple(r) for r in spark.table("idle").collect()} == want and len(want) == 3


def test_readiness(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", "report", 150, t(0)), ("a", "end", None, t(5)), ("a", "report", 10, t(6)), ("b", "report", 40, t(1))]
    _, stream = _rows(spark, tmp_path, rows, "key string, kind string, percent int, ts timestamp")
    q = status.readiness(stream).writeStream.format("memory").queryName("ready").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["key"]: (r["percent"], r["complete"]) for r in spark.table("ready").collect() if not r["by_timeout"]}
    assert got == {"a": (100, True), "b": (40, False)}


def test_readiness_times_out_by_language(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "key string, kind string, percent int, ts timestamp"
    for i, rows in enumerate(([("java", "report", 10, t(0)), ("go", "report", 20, t(0)), ("zig", "report", 30, t(0))], [("clock", "report", 0, t(50))], [("clock", "report", 0, t(51))])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = status.readiness(stream, seconds=40).writeStream.foreachBatch(lambda d, _, i=i: d.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "at")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    timed = {(r["key"], r["percent"]) for r in spark.read.parquet(str(tmp_path / "out")).filter("by_timeout").collect()}
    assert timed == {("go", 20), ("zig", 30)}


def test_batch_mechanisms(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    e = spark.createDataFrame([("a", "end", t(5)), ("a", "end", t(3)), ("b", "report", t(1))], "k string, event_type string, ts timestamp")
    assert [tuple(r) for r in status.first_completion(e, "k").collect()] == [("a", t(3), 2)]
    q = spark.createDataFrame([(1, t(0)), (2, t(0)), (3, t(0))], "id int, ts timestamp")
    r = spark.createDataFrame([(1, t(4), False), (2, t(11), False), (3, t(2), True)], "id int, ts timestamp, cancelled boolean")
    assert {(x["id"], x["outcome"]) for x in status.request_pairs(q, r).collect()} == {(1, "answered"), (2, "timed_out"), (3, "cancelled")}
    assert {(x["id"], x["outcome"]) for x in status.request_pairs(q, r.drop("cancelled")).collect()} == {(1, "answered"), (2, "timed_out"), (3, "answered")}
    g = spark.createDataFrame([("x", "register", False, t(0)), ("x", "unregister", False, t(1)), ("y", "unregister", True, t(1)), ("z", "register", False, t(2))], "id string, action string, static boolean, ts timestamp")
    assert {tuple(x) for x in status.registrations(g).collect()} == {("x", False), ("y", True), ("z", True)}
    lag = spark.createDataFrame([("a", i) for i in range(70)], "k string, event_id long")
    assert [tuple(x) for x in status.lagged(lag, "k").collect()] == [("a", 64, 6)]
    u = spark.createDataFrame([("a", t(0), 0), ("b", t(0), 1), ("c", t(3000), 0)], "k string, last_used timestamp, in_flight int")
    assert [x["k"] for x in status.evictable(u, t(3600)).collect()] == ["a"]
    assert [x[0] for x in spark.createDataFrame([(-3,), (50,), (400,)], "p int").select(status.percent(F.col("p"))).collect()] == [0, 50, 100]


def _replayed(spark, tmp_path, name, parts, schema, query):
    """The last row of each key after the parts came one by one, the query being started anew from its checkpoint each time; and all rows."""
    rows = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name))
        out = query(stream).writeStream.foreachBatch(lambda d, n, i=i: rows.extend(((i, n), tuple(r)) for r in d.collect()))
        out.option("checkpointLocation", str(tmp_path / f"{name}-at")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = {}
    for _, r in sorted(rows, key=lambda x: x[0]):
        last[r[0]] = r
    return last, [r for _, r in rows]


def test_channel_stream_equals_the_table_after_restarts(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    events = [(k, f"{k}{i:03}", t(i)) for i in range(150) for k in "ab" if k == "a" or i % 3 == 0]
    parts = [events[:60], events[60:61], events[61:]]
    last, _ = _replayed(spark, tmp_path, "c", parts, "key string, value string, ts timestamp", lambda s: status.channel(s, 20))
    for k in "ab":
        mine = [v for x, v, _ in events if x == k]
        assert last[k] == (k, 20, len(mine) - 20, mine[-20:])
    lag = {tuple(r) for r in status.lagged(spark.createDataFrame(events, "key string, value string, ts timestamp"), "key", 20).collect()}
    assert lag == {(k, n, d) for k, n, d, _ in last.values()}


def test_registrations_stream_equals_the_table_after_restarts(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = [
        [("x", "register", False, t(0)), ("y", "unregister", True, t(1)), ("z", "register", False, t(9))],
        [("x", "unregister", False, t(5)), ("z", "unregister", False, t(3)), ("w", "unregister", False, t(4))],
        [("x", "register", False, t(2)), ("w", "register", False, t(8))],
    ]
    schema = "id string, action string, static boolean, ts timestamp"
    last, _ = _replayed(spark, tmp_path, "r", parts, schema, status.registered)
    want = {tuple(r) for r in status.registrations(spark.createDataFrame(sum(parts, []), schema)).collect()}
    assert set(last.values()) == want == {("x", False), ("y", True), ("z", True), ("w", True)}


def test_probe_cache_ends_by_the_clock_of_events(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = [[("go", True, t(0)), ("rust", False, t(0))], [("go", True, t(200))], [("zig", True, t(350))], [("zig", True, t(360)), ("go", False, t(20))], [("rust", True, t(361))]]
    last, every = _replayed(spark, tmp_path, "p", parts, "key string, ok boolean, ts timestamp", status.probes)
    assert ("rust", False, False) in every  # 300 seconds after its probe
    assert last == {"go": ("go", True, True), "rust": ("rust", True, True), "zig": ("zig", True, True)}  # a late probe changes nothing
