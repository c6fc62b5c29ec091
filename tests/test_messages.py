from pyspark.sql import functions as F

from docmill.operators import messages as m, registry as r


def test_slices_equal_one_window(spark, monkeypatch):
    import random

    from pyspark.sql.window import Window

    monkeypatch.setattr(m, "SLICE", 7)
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 2, None]), i, rng.random() < 0.3, rng.choice("ab")) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, o long, f boolean, v string")
    w = Window.partitionBy("k").orderBy("o")
    got = m.previous(m.running(df, F.col("f"), "n", ["k"], "o"), {"p": F.col("v")}, ["k"], "o")
    want = df.withColumn("n", F.sum(F.col("f").cast("long")).over(w)).withColumn("p", F.lag("v").over(w))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=lambda r: r[1]) == sorted(map(tuple, want.collect()), key=lambda r: r[1])


def test_turns_and_limits(spark):
    rows = [(1, 1, "user"), (1, 2, "tool"), (1, 3, "user"), (1, 4, "tool"), (1, 5, "tool"), (2, 1, "tool")]
    df = spark.createDataFrame(rows, "thread_id int, idx int, role string")
    assert {x.thread_id: x.calls for x in m.tool_calls_in_turn(df).collect()} == {1: 2, 2: 1}
    assert m.turns(df.limit(0)).count() == 0


def test_traces_and_latency(spark):
    e = spark.createDataFrame([(1, 1, "tool_call", "a", 100), (1, 2, "tool_result", "a", 90), (1, 3, "tool_result", "a", 500), (1, 4, "tool_call", "b", 7)], "thread_id int, seq int, type string, call_id string, ts long")
    got = {x.call_id: (x.duration_ms, x.running) for x in m.tool_latency(e).collect()}
    assert got == {"a": (0, False), "b": (None, True)}
    t = m.tool_traces(e.where("type = 'tool_call'").select("thread_id", "call_id"), e.where("type = 'tool_result'").withColumn("result", F.col("ts").cast("string")))
    assert {x.call_id: x.result for x in t.collect()} == {"a": "500", "b": "no result"}


def test_candidates(spark):
    rows = [("c", "search_files", 1, True, ["x"], False), ("c", "search_files", 2, False, None, False), ("c", "list_folder_contents", 3, True, ["y", "z"], False), ("c", "list_folder_contents", 4, False, None, False), ("d", "search_files", 5, True, ["q"], False), ("d", None, 6, True, None, True)]
    df = spark.createDataFrame(rows, "client string, source string, seq int, ok boolean, results array<string>, cleared boolean")
    held = r.latest_candidates(df)
    assert [(x.client, x.source, x.seq, x.results) for x in held.collect()] == [("c", "list_folder_contents", 3, ["y", "z"])]
    assert r.current_candidates(held, df).count() == 4
    out = df.select(r.candidate_at(F.col("results"), F.lit(1)).alias("a"), r.candidate_at(F.col("results"), F.lit(0)).alias("b"), r.candidate_at(F.col("results"), F.lit(9)).alias("z")).first()
    assert tuple(out) == ("x", None, None)


def test_consumption(spark):
    p = spark.createDataFrame([("t", "c", 0), ("u", "c", 0)], "token string, client string, at int").select("token", "client", F.timestamp_seconds("at").alias("created"))
    c = spark.createDataFrame([("t", "x", 5, 1), ("t", "c", 300, 2), ("t", "c", 301, 3), ("u", "c", 301, 4), ("v", "c", 1, 5)], "token string, client string, s int, seq int").select("token", "client", F.timestamp_seconds("s").alias("at"), "seq")
    assert [(x.token, x.seq) for x in r.consumed(p, c).collect()] == [("t", 2)]


def test_prepare_send(spark):
    df = spark.createDataFrame([([2, 1, 2, 0, 9],)], "i array<int>").select("i", F.array(F.struct(F.lit("a").alias("path"), F.lit(True).alias("is_dir")), F.struct(F.lit("b").alias("path"), F.lit(False).alias("is_dir"))).alias("r"))
    out = df.select(r.prepare_send(F.col("i"), F.col("r")).alias("x")).first()["x"]
    assert [f.path for f in out.files] == ["b"] and sorted(out.errors) == [0, 1, 9]
