import time

from pyspark.sql import functions as F

from docmill.operators import registry
from docmill.streaming import state


def run(spark, tmp_path, rows, schema, make, mode, name, prepare=lambda d: d, batches=2):
    """Rows in small files through a stream; the collected output."""
    size = -(-len(rows) // batches)
    for i in range(batches):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = make(prepare(stream)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_candidates_equal_batch(spark, tmp_path):
    schema = "client string, source string, seq long, ok boolean, results array<string>, cleared boolean"
    rows = [("c", "search_files", 1, True, ["x"], False), ("c", "search_files", 2, False, None, False), ("c", "list_folder_contents", 3, True, ["y", "z"], False), ("d", "search_files", 4, True, ["q"], False), ("c", "list_folder_contents", 5, False, None, False), ("d", None, 6, True, None, True), ("d", "search_files", 7, True, ["r"], False)]
    run(spark, tmp_path, rows, schema, state.candidate_stream, "update", "cands")
    out = spark.table("cands").collect()
    last = {(r.client, r.source): (r.seq, r["count"]) for r in out}
    batch = {(r.client, r.source): (r.seq, len(r.results)) for r in registry.latest_candidates(spark.createDataFrame(rows, schema)).collect()}
    assert batch.items() <= last.items()
    assert [r.results for r in out if r.seq == 3] == [["y", "z"]] * len([r for r in out if r.seq == 3])


def test_pending_sends(spark, tmp_path):
    rows = [("t", "c", "prepare", 0), ("t", "x", "consume", 1), ("t", "c", "consume", 300), ("t", "c", "consume", 301), ("u", "c", "prepare", 0), ("u", "c", "consume", 301)]
    prepare = lambda d: d.select("token", "client", "kind", F.timestamp_seconds(F.col("at") + 1_000_000).alias("at")).withWatermark("at", "1 hour")
    out = run(spark, tmp_path, rows, "token string, client string, kind string, at long", state.pending_stream, "append", "sends", prepare)
    assert sorted(tuple(r) for r in out) == [("t", "c", "sent"), ("t", "c", "unknown"), ("t", "x", "unknown"), ("u", "c", "expired")]


def test_messages(spark, tmp_path):
    schema = "run_id string, seq long, message_id string, kind string, text string, last boolean"
    rows = [("r", 1, "m1", "text", "he", False), ("r", 2, "m1", "text", "llo", True), ("r", 3, "m2", "reasoning", "why", False), ("r", 4, "m2", "call", None, False), ("r", 5, "m3", "text", "x", False), ("r", 6, None, "flush", None, False)]
    out = run(spark, tmp_path, rows, schema, state.message_stream, "append", "msgs")
    assert sorted(tuple(r) for r in out) == [("r", "m1", "hello", "", 0), ("r", "m2", "", "why", 1), ("r", "m3", "x", "", 0)]


def test_deduplicated(spark, tmp_path):
    rows = [(1, "tool_call", "a", 10), (1, "tool_call", "a", 11), (1, "tool_call", "b", 12), (1, "tool_result", "a", 13)]
    out = run(spark, tmp_path, rows, "thread_id int, type string, call_id string, s long", state.deduplicated, "append", "dedup", lambda d: d.withColumn("at", F.timestamp_seconds("s")))
    assert len(out) == 3
