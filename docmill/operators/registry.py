"""State by client in batch: candidate lists, prepared sendings with their time to live, histories. Streams keep the same state in docmill.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Sources of candidates, seconds a prepared sending is valid.
SOURCES, VALID_SECONDS = ("search_files", "list_folder_contents"), 300


def latest_candidates(events: DataFrame) -> DataFrame:
    """(client, source, seq, results): the candidates that hold for each client and source.

    events has client, source, seq, ok, results and may have cleared. The latest event counts; a failed search clears the
    list, a failed folder listing leaves it as it is, a cleared client loses all before.
    """
    rows = events.where(F.col("source").isin(*SOURCES))
    rows = rows.where(F.col("ok") | (F.col("source") == SOURCES[0]))
    if "cleared" in events.columns:
        gone = events.where("cleared").groupBy("client").agg(F.max("seq").alias("_gone"))
        rows = rows.where(~F.coalesce("cleared", F.lit(False))).join(gone, "client", "left").where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    last = rows.groupBy("client", "source").agg(F.max_by(F.struct("seq", "ok", "results"), "seq").alias("l"))
    return last.where("l.ok").select("client", "source", "l.seq", "l.results")


def current_candidates(snapshots: DataFrame, clients: DataFrame) -> DataFrame:
    """(client, source, has_candidates, count): both sources of every client, empty ones too."""
    sources = F.explode(F.array(*[F.lit(s) for s in SOURCES])).alias("source")
    grid = clients.select("client").distinct().select("client", sources)
    n = F.coalesce(F.size("results"), F.lit(0))
    return grid.join(snapshots, ["client", "source"], "left").select("client", "source", F.col("results").isNotNull().alias("has_candidates"), F.when(F.col("results").isNull(), 0).otherwise(n).alias("count"))


def candidate_at(results: Column, index: Column) -> Column:
    """The candidate of a 1-based index; null outside the list."""
    return F.when(index >= 1, F.get(results, index - 1))


def cleared_counts(snapshots: DataFrame) -> DataFrame:
    """(client, sources, items): what clearing a client removes."""
    return snapshots.groupBy("client").agg(F.count("*").alias("sources"), F.sum(F.size("results")).alias("items"))


def consumed(prepared: DataFrame, consumes: DataFrame, seconds: int = VALID_SECONDS) -> DataFrame:
    """(token, client, seq): the consumption that uses up each prepared sending.

    prepared has token, client, created (timestamp); consumes has token, client, at, seq. The first one by the same client,
    not before the preparation and at most `seconds` after it, counts; one by another client leaves the token as it is.
    """
    p = prepared.groupBy("token").agg(F.max_by(F.struct("client", "created"), "created").alias("p"))
    rows = consumes.join(p, "token").where((F.col("client") == F.col("p.client")) & (F.col("at") >= F.col("p.created")) & (F.col("at") <= F.col("p.created") + F.expr(f"interval {seconds} seconds")))
    first = Window.partitionBy("token").orderBy("at", "seq")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("token", "client", "seq")


def histories(runs: DataFrame) -> DataFrame:
    """(thread_id, messages): messages of the successful runs of each thread, in order; failed runs leave it unchanged."""
    return runs.where("ok").groupBy("thread_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "message"))), lambda x: x["message"]).alias("messages"))


def new_since(messages: Column, count: Column) -> Column:
    """The messages after the first `count`."""
    return F.slice(messages, count + 1, F.greatest(F.size(messages) - count, F.lit(0)))


def prepare_send(indices: Column, results: Column) -> Column:
    """struct(files, errors): the candidates of 1-based indices without repetitions, and the indices that name no file."""
    once = F.array_distinct(indices)
    good = F.filter(once, lambda i: candidate_at(results, i).isNotNull() & ~F.coalesce(candidate_at(results, i)["is_dir"], F.lit(False)))
    return F.struct(F.transform(good, lambda i: candidate_at(results, i)).alias("files"), F.array_except(once, good).alias("errors"))
