"""Conversations and run events in batch: turns, tool traces, deltas, interrupts, the state of a thread.

Tables of events have thread_id, seq (order in the thread), type, ts (epoch milliseconds) and further columns; those of
messages thread_id, idx, role and content. Running sums and neighbours go by slices of a thread, so a thread with a third of all rows is
spread over tasks; only what joins the texts of a thread holds them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from docmill.functions.text import blank_to_null, col, first_filled

#: Most signs of an overlap between two deltas, and the seconds that a prepared sending is valid.
OVERLAP_MOST, VALID_SECONDS = 200, 300


def in_order(key: str = "thread_id", order: str = "seq"):
    return Window.partitionBy(key).orderBy(order)


#: Values of the order column that one task handles of a key: a key with many rows is spread over its slices.
SLICE = 1 << 17


def _sliced(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_slice", F.floor(F.col(order) / SLICE))


def _join_slices(rows: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a column of their slice; null keys are keys too."""
    on = F.lit(True)
    for k in [*keys, "_slice"]:
        slices = slices.withColumnRenamed(k, f"_r{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"_r{k}"))
    return rows.join(slices, on).drop(*[f"_r{k}" for k in [*keys, "_slice"]])


def running(df: DataFrame, flag: Column, name: str, keys: list[str], order: str) -> DataFrame:
    """df with `name`: the sum of an integer flag over the rows of the same keys up to each row, by an integer order.

    Rows are summed within slices of the order, slices among themselves (one row a slice), so no task has to hold all rows of
    a key.
    """
    rows = _sliced(df.withColumn("_flag", flag.cast("long")), order)
    within = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_slice").agg(F.sum("_flag").alias("_sum"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    rows = rows.withColumn("_within", F.sum("_flag").over(within))
    return _join_slices(rows, sums, keys).withColumn(name, F.col("_within") + F.col("_before")).drop("_flag", "_slice", "_within", "_before")


def previous(df: DataFrame, values: dict[str, Column], keys: list[str], order: str) -> DataFrame:
    """df with the values of the row before among the same keys, by an integer order, under the names of `values`; null at the first. Sliced as in running."""
    rows = _sliced(df.withColumn("_now", F.struct(*[v.alias(n) for n, v in values.items()])), order)
    last = rows.groupBy(*keys, "_slice").agg(F.max_by("_now", order).alias("_last"))
    last = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_last")
    rows = rows.withColumn("_within", F.lag("_now").over(Window.partitionBy(*keys, "_slice").orderBy(order)))
    rows = _join_slices(rows, last, keys).withColumn("_prev", F.coalesce("_within", "_before"))
    return rows.select(*df.columns, *[F.col(f"_prev.{n}").alias(n) for n in values])


def latest(df: DataFrame, values: dict[str, Column], keys: list[str], order: str) -> DataFrame:
    """df with, for each of `values`, its last value that isn't null among the rows before of the same keys, by an integer order. Sliced as in running."""
    rows = _sliced(df.withColumns({f"_v{n}": v for n, v in values.items()}), order)
    last = rows.groupBy(*keys, "_slice").agg(*[F.max_by(f"_v{n}", F.when(F.col(f"_v{n}").isNotNull(), F.col(order))).alias(f"_l{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select(*keys, "_slice", *[F.last(f"_l{n}", True).over(before).alias(f"_b{n}") for n in values])
    within = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = _join_slices(rows.withColumns({f"_w{n}": F.last(f"_v{n}", True).over(within) for n in values}), last, keys)
    return rows.select(*df.columns, *[F.coalesce(f"_w{n}", f"_b{n}").alias(n) for n in values])


def turns(messages: DataFrame) -> DataFrame:
    """messages with turn (number of user messages so far) and current (whether no user message follows)."""
    rows = running(messages, F.col("role") == "user", "turn", ["thread_id"], "idx")
    last = messages.where(F.col("role") == "user").groupBy(F.col("thread_id").alias("_t")).agg(F.max("idx").alias("_user"))
    rows = rows.join(last, F.col("thread_id").eqNullSafe(F.col("_t")), "left")
    return rows.withColumn("current", F.coalesce(F.col("idx") >= F.col("_user"), F.lit(True))).drop("_t", "_user")


def tool_calls_in_turn(messages: DataFrame, limit: int = 10) -> DataFrame:
    """(thread_id, calls, over_limit): tool calls since the last user message of each thread."""
    rows = turns(messages).groupBy("thread_id").agg(F.count_if(F.col("current") & (F.col("role") == "tool")).alias("calls"))
    return rows.withColumn("over_limit", F.col("calls") >= limit)


def strip_reasoning(messages: DataFrame) -> DataFrame:
    """messages whose reasoning is kept in the current turn only."""
    return turns(messages).withColumn("reasoning", F.when(F.col("current"), F.col("reasoning"))).drop("turn", "current")


def rounds(messages: DataFrame) -> DataFrame:
    """messages with round_index: how many messages with tool calls there are so far."""
    return running(messages, F.coalesce(F.col("has_calls"), F.lit(False)), "round_index", ["thread_id"], "idx")


def tool_traces(calls: DataFrame, results: DataFrame, missing: str = "no result") -> DataFrame:
    """calls (thread_id, call_id, ...) with the last result (by seq) of the same call, or a placeholder."""
    last = results.groupBy("thread_id", "call_id").agg(F.max_by("result", "seq").alias("result"))
    return calls.join(last, ["thread_id", "call_id"], "left").withColumn("result", F.coalesce("result", F.lit(missing)))


def tool_latency(events: DataFrame) -> DataFrame:
    """(thread_id, call_id, seq, duration_ms, running): each call and the time to its first result that has a time; never negative."""
    done = events.where((F.col("type") == "tool_result") & F.col("ts").isNotNull()).groupBy("thread_id", "call_id").agg(F.min_by("ts", "seq").alias("done"))
    calls = events.where(F.col("type") == "tool_call").select("thread_id", "call_id", "seq", "ts")
    joined = calls.join(done, ["thread_id", "call_id"], "left")
    took = F.when(F.col("done").isNotNull() & F.col("ts").isNotNull(), F.greatest(F.lit(0), F.col("done") - F.col("ts")))
    return joined.select("thread_id", "call_id", "seq", took.alias("duration_ms"), F.col("done").isNull().alias("running"))


def collapse_deltas(events: DataFrame) -> DataFrame:
    """(thread_id, first_seq, type, n, chars, start_ts, end_ts): neighbouring deltas of one type as one row; other events stay alone."""
    delta = F.col("type").endswith("_delta")
    rows = previous(events, {"_type": F.col("type")}, ["thread_id"], "seq")
    rows = running(rows, ~(delta & F.coalesce(F.col("_type") == F.col("type"), F.lit(False))), "_island", ["thread_id"], "seq")
    text = F.coalesce(F.length("text"), F.lit(0)) if "text" in events.columns else F.lit(0)
    return rows.groupBy("thread_id", "_island").agg(F.min("seq").alias("first_seq"), F.min("type").alias("type"), F.count("*").alias("n"), F.sum(text).alias("chars"), F.min_by("ts", "seq").alias("start_ts"), F.max_by("ts", "seq").alias("end_ts")).drop("_island")


def dedup_calls(events: DataFrame) -> DataFrame:
    """Tool calls and results, the first of each call id and type in its thread; an empty id counts as one id."""
    w = Window.partitionBy("thread_id", "type", F.coalesce(F.col("call_id").cast("string"), F.lit(""))).orderBy("seq")
    return events.where(F.col("type").isin("tool_call", "tool_result")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_interrupts(events: DataFrame) -> DataFrame:
    """events and, after each successful prepare_send result with a token, an interrupt event with its time to live."""
    made = (F.col("type") == "tool_result") & (F.col("tool") == "prepare_send") & F.col("ok") & (F.coalesce("token", F.lit("")) != "")
    own = F.struct(F.lit(0).alias("part"), F.col("type").alias("type"), F.lit(None).cast("int").alias("expires_in"))
    more = F.struct(F.lit(1).alias("part"), F.lit("interrupt").alias("type"), F.lit(VALID_SECONDS).alias("expires_in"))
    rows = events.withColumn("_e", F.explode(F.when(F.coalesce(made, F.lit(False)), F.array(own, more)).otherwise(F.array(own))))
    return rows.select(*[c for c in events.columns if c != "type"], F.col("_e.part").alias("part"), F.col("_e.type").alias("type"), F.col("_e.expires_in").alias("expires_in"))


def resolution_status(events: DataFrame) -> DataFrame:
    """(thread_id, status): how an interrupt ended. A stream error counts first, then a rejection (an error if it was sent all the same), a confirmation, an error message."""
    is_a = lambda t: F.bool_or(F.col("type") == t)
    runs = events.groupBy("thread_id").agg(is_a("error").alias("e"), is_a("rejected").alias("r"), is_a("sent").alias("s"), is_a("confirmed").alias("c"), is_a("message_error").alias("m"))
    status = F.when(F.col("e"), "error").when(F.col("r") & F.col("s"), "error").when(F.col("r"), "rejected").when(F.col("c") | F.col("s"), "confirmed").when(F.col("m"), "error").otherwise("not_executed")
    return runs.select("thread_id", status.alias("status"))


def pending_last_send(messages: DataFrame) -> DataFrame:
    """(thread_id, token): threads whose last tool message of the current turn is a successful prepare_send."""
    rows = turns(messages).where(F.col("current") & (F.col("role") == "tool"))
    last = rows.groupBy("thread_id").agg(F.max_by(F.struct("tool", "ok", "token"), "idx").alias("l"))
    return last.where((F.col("l.tool") == "prepare_send") & F.col("l.ok") & (F.coalesce("l.token", F.lit("")) != "")).select("thread_id", "l.token")


def hidden_debug(messages: DataFrame) -> DataFrame:
    """messages with hidden: whether a resolved interrupt came before in the same turn."""
    flag = F.coalesce(F.col("resolved"), F.lit(False))
    rows = running(turns(messages), flag, "_seen", ["thread_id", "turn"], "idx")
    return rows.withColumn("hidden", F.col("_seen") - flag.cast("int") > 0).drop("_seen")


def last_reply(messages: DataFrame, default: str = "") -> DataFrame:
    """(thread_id, idx, reply): the last assistant message of every thread; the default where there is none or it is blank."""
    rows = messages.groupBy("thread_id").agg(F.max(F.when(F.col("role") == "assistant", F.struct("idx", "content"))).alias("l"))
    return rows.select("thread_id", F.col("l.idx").alias("idx"), F.coalesce(blank_to_null("l.content"), F.lit(default)).alias("reply"))


def reduce_threads(events: DataFrame) -> DataFrame:
    """(thread_id, text, reasoning, tool_count, usage, finished, last_type): the state of each thread after its events."""
    ordered = lambda t: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == t, F.struct("seq", "text")))), lambda x: x["text"]), "")
    return events.groupBy("thread_id").agg(
        ordered("assistant_delta").alias("text"), ordered("reasoning_delta").alias("reasoning"), F.count_if(F.col("type") == "tool_call").alias("tool_count"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("usage"), F.coalesce(F.bool_or(F.col("type") == "run_finished"), F.lit(False)).alias("finished"), F.max_by("type", "seq").alias("last_type"),
    )


def assembled_calls(parts: DataFrame) -> DataFrame:
    """(message_id, index, id, name, args): tool calls from their streamed parts; the last id counts, names and arguments are joined in order."""
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), "")
    return parts.groupBy("message_id", "index").agg(F.max_by("id", F.when(F.coalesce("id", F.lit("")) != "", F.col("seq"))).alias("id"), ordered("name").alias("name"), ordered("args").alias("args"))


def message_bounds(chunks: DataFrame) -> DataFrame:
    """(thread_id, message_no, message_id, n, closed): runs of chunks of one message; a last chunk closes its message, another id begins a new one."""
    rows = previous(chunks, {"_id": F.col("message_id"), "_last": F.coalesce("last", F.lit(False))}, ["thread_id"], "seq")
    rows = running(rows, ~F.coalesce((F.col("_id") == F.col("message_id")) & ~F.col("_last"), F.lit(False)), "message_no", ["thread_id"], "seq")
    return rows.groupBy("thread_id", "message_no").agg(F.min("message_id").alias("message_id"), F.count("*").alias("n"), F.bool_or(F.coalesce("last", F.lit(False))).alias("closed"))


def new_part(before: Column, incoming: Column, most: int | None = OVERLAP_MOST) -> Column:
    """What `incoming` adds to `before`: without the longest start that is an end of `before`, of `most` signs at most."""
    reach = F.least(F.length(before), F.length(incoming), *([F.lit(most)] if most else []))
    sizes = F.when(reach > 0, F.sequence(reach, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda k: F.right(before, k) == F.left(incoming, k))
    return F.substring(incoming, F.coalesce(F.get(fits, F.lit(0)), F.lit(0)) + 1, F.length(incoming))


def merged_stream(segments: Column, most: int | None = OVERLAP_MOST) -> Column:
    """An array of segments that may repeat what came before, as one text."""
    return F.aggregate(F.filter(segments, lambda x: x.isNotNull()), F.lit(""), lambda text, x: F.concat(text, new_part(text, x, most)))


def event_detail(kind: Column, tool: Column, text: Column, error: Column) -> Column:
    """The label of an event in a timeline."""
    return (
        F.when(kind.isin("tool_call", "tool_result"), F.coalesce(tool, F.lit("")))
        .when(kind.endswith("_delta"), F.concat(F.coalesce(F.length(text), F.lit(0)).cast("string"), F.lit(" chars")))
        .when(kind == "error", F.coalesce(blank_to_null(error), F.lit("error")))
        .otherwise(F.lit(""))
    )


def timeline_view(events: DataFrame, view: str = "all") -> DataFrame:
    """The events of one of the views all, tools, flow."""
    if view == "tools":
        return events.where(F.col("type").isin("tool_call", "tool_result"))
    if view == "flow":
        return events.where(~F.col("type").isin("tool_call", "tool_result") & ~F.col("type").endswith("_delta"))
    if view != "all":
        raise ValueError("view must be all, tools or flow")
    return events


def resume_error(payload: Column, default: str = "confirm_send 执行失败。") -> Column:
    """The first filled of message, user_hint, operator_hint and summary of a JSON payload."""
    return F.coalesce(first_filled(*[F.get_json_object(payload, f"$.{k}") for k in ("message", "user_hint", "operator_hint", "summary")]), F.lit(default))


def flatten_nodes(updates: DataFrame) -> DataFrame:
    """(run_id, node, pos, message) from a map of node to messages; nodes that begin with two underscores are left out."""
    nodes = updates.select("run_id", F.explode("nodes").alias("node", "messages")).where(~F.col("node").startswith("__"))
    return nodes.select("run_id", "node", F.posexplode("messages").alias("pos", "message"))


def is_internal(tags: Column, *flags: Column) -> Column:
    """Whether a stream item is an internal summary, by its tags or any flag."""
    held = F.coalesce(F.array_contains(tags, "internal_preview_summary"), F.lit(False))
    for f in flags:
        held = held | F.coalesce(f, F.lit(False))
    return held


def client_key(*candidates: Column) -> Column:
    """The first filled of several ways to name a client, else "default"."""
    return F.coalesce(first_filled(*candidates), F.lit("default"))


def summary_of(tool: Column | str, payload: Column | str) -> Column:
    """One line on a tool's JSON result."""
    get = lambda k: F.get_json_object(col(payload), f"$.{k}")
    ok = F.coalesce(get("ok") != "false", F.lit(True))
    return (
        F.when(~ok, F.concat(F.lit("error: "), F.coalesce(get("message"), get("error"), F.lit("unknown"))))
        .when(col(tool).isin("search_files", "list_folder_contents"), F.concat(F.coalesce(get("count"), F.lit("0")), F.lit(" results")))
        .when(col(tool) == "read_file_content", F.concat(F.lit("read "), F.coalesce(get("name"), F.lit(""))))
        .otherwise(F.lit("ok"))
    )


#: Kinds of content blocks, tools that are not offered, signs of a result that is shown as it is.
TEXT_KINDS, REASONING_KINDS, INTERNAL_TOOLS, RESULT_MOST = ("text", "output_text"), ("reasoning", "thinking", "reasoning_content"), ("clear_client_state",), 240


def ai_content(blocks: Column, reasoning: Column | None = None) -> Column:
    """struct(text, reasoning) of content blocks (type, text): texts and reasoning apart, each joined by line feeds; reasoning goes after what is there."""
    joined = lambda kinds, *head: F.array_join(F.filter(F.concat(F.array(*head).cast("array<string>"), F.transform(F.filter(F.coalesce(blocks, F.array()), lambda b: b["type"].isin(*kinds)), lambda b: b["text"])), lambda t: t.isNotNull() & (t != "")), "\n")
    return F.struct(joined(TEXT_KINDS).alias("text"), joined(REASONING_KINDS, *([reasoning] if reasoning is not None else [])).alias("reasoning"))


def with_tool_results(messages: DataFrame, results: DataFrame, order: str = "idx") -> DataFrame:
    """messages (thread_id, a unique order in it, tools: array of structs with id) whose tools also have the last result of their id.

    Each tool is joined by thread and id, so a thread with a third of all messages is spread over its ids. Messages of equal
    thread and order count once; null and empty tools stay as they are.
    """
    last = results.where(F.col("call_id").isNotNull()).groupBy("thread_id", "call_id").agg(F.max_by("result", "seq").alias("result"))
    others = [c for c in messages.columns if c not in ("thread_id", order, "tools")]
    made = messages.select("thread_id", order, F.struct(F.lit(0).alias("_"), *others).alias("_rest"), F.col("tools").isNull().alias("_none"), F.posexplode_outer("tools").alias("_pos", "_tool"))
    made = made.join(last.withColumnRenamed("thread_id", "_thread"), (F.col("thread_id") == F.col("_thread")) & (F.col("_tool.id") == F.col("call_id")), "left")
    tool = F.when(F.col("_pos").isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col("_tool.id").alias("id"), "result"))
    held = made.groupBy("thread_id", order).agg(F.first("_rest").alias("_rest"), F.first("_none").alias("_none"), F.sort_array(F.collect_set(tool)).alias("_tools"))
    patched = F.when(~F.col("_none"), F.transform("_tools", lambda t: F.struct(t["id"].alias("id"), t["result"].alias("result"))))
    return held.select("thread_id", order, *[F.col(f"_rest.{c}").alias(c) for c in others], patched.alias("tools")).select(*messages.columns)


def pending_interrupts(events: DataFrame) -> DataFrame:
    """(thread_id, finished_seq, message_seq, token): interrupts that a finished run attaches to the last assistant message before it; null message where there is none.

    An interrupt waits for the next run_finished of its thread; of several the last counts. What came last before an event is
    found by slices of a thread.
    """
    is_a = lambda t: F.col("type") == t
    interrupt = F.when(is_a("interrupt") & F.col("token").isNotNull(), F.struct("seq", "token"))
    rows = latest(events.select("thread_id", "seq", "type", "token"), {"_assistant": F.when(is_a("message_start"), F.col("seq")), "_finished": F.when(is_a("run_finished"), F.col("seq")), "_interrupt": interrupt}, ["thread_id"], "seq")
    waiting = F.col("_interrupt").isNotNull() & (F.col("_finished").isNull() | (F.col("_interrupt.seq") > F.col("_finished")))
    return rows.where(is_a("run_finished") & waiting).select("thread_id", F.col("seq").alias("finished_seq"), F.col("_assistant").alias("message_seq"), F.col("_interrupt.token").alias("token"))


def visible(text: Column, reasoning: Column, tools: Column, interrupt: Column, status: Column, running: Column, hide_debug: Column) -> Column:
    """Whether an assistant message shows anything."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    shown = ~hide_debug & (filled(reasoning) | (F.coalesce(F.size(tools), F.lit(0)) > 0))
    return filled(text) | shown | (interrupt.isNotNull() & ~(running & F.coalesce(status == "pending", F.lit(False))))


def stream_outcome(events: DataFrame, missing: str) -> DataFrame:
    """(thread_id, ok, error): whether the last resolution of a stream is definite; else its message, the last error, or `missing`."""
    last = lambda kind, c: F.max_by(c, F.when(F.col("type") == kind, F.col("seq")))
    runs = events.groupBy("thread_id").agg(last("interrupt_resolved", "status").alias("s"), last("interrupt_resolved", "message").alias("m"), last("error", "message").alias("e"))
    ok = F.coalesce(F.col("s").isin("confirmed", "rejected"), F.lit(False))
    return runs.select("thread_id", ok.alias("ok"), F.when(~ok, F.coalesce(F.nullif("m", F.lit("")), F.nullif("e", F.lit("")), F.lit(missing))).alias("error"))


def offered(tools: DataFrame) -> DataFrame:
    """Tools without the internal ones."""
    return tools.where(~F.col("name").isin(*INTERNAL_TOOLS))


def result_lines(payload: Column, most: int = 3) -> Column:
    """A search result's payload as text: its count, keyword and path, then the first results by name and path; other text on one line, cut."""
    kind = "struct<ok: boolean, error_type: string, message: string, user_hint: string, error: string, keyword: string, path: string, count: bigint, results: array<struct<name: string, full_path: string, size_display: string>>>"
    one = F.trim(F.regexp_replace(payload, "[\r\n]", " "))
    p = F.from_json(payload, kind)
    item = lambda r: F.concat_ws("\n", F.concat(F.lit("- "), F.coalesce(r["name"], F.lit("<unknown>"))), F.concat(F.lit("  "), F.nullif(r["full_path"], F.lit(""))), F.concat(F.lit("  size="), r["size_display"]))
    head = F.concat(F.lit("hits "), F.coalesce(p["count"], F.lit(0)).cast("string"), F.lit(" | keyword="), F.coalesce(p["keyword"], F.lit("")), F.lit(" | path="), F.coalesce(F.nullif(p["path"], F.lit("")), F.lit("*")))
    failed = F.concat(F.lit("failed"), F.coalesce(F.concat(F.lit("["), p["error_type"], F.lit("]")), F.lit("")), F.lit(": "), F.coalesce(p["message"], p["user_hint"], p["error"], F.lit("unknown")))
    good = F.array_join(F.concat(F.array(head), F.transform(F.slice(F.coalesce(p["results"], F.array()), 1, most), item)), "\n")
    parsed = F.coalesce(F.try_parse_json(payload).isNotNull() & payload.startswith("{"), F.lit(False))
    return F.when(parsed, F.when(F.coalesce(p["ok"], F.lit(False)), good).otherwise(failed)).otherwise(F.when(F.length(one) > RESULT_MOST, F.concat(F.substring(one, 1, RESULT_MOST), F.lit("..."))).otherwise(one))


def confirmed_files(sent: DataFrame) -> DataFrame:
    """(token, pos, path, status): the files of confirmed sendings, each as sent."""
    return sent.select("token", F.posexplode("files").alias("pos", "path"), F.lit("sent").alias("status"))


def merged_metadata(common: Column, extra: Column) -> Column:
    """Two maps as one; entries of the second win, unless they are null."""
    return F.map_zip_with(F.coalesce(common, F.create_map().cast("map<string,string>")), F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))


def folder_guard(source_ok: Column, candidate: Column, exists: Column, is_dir: Column) -> Column:
    """The first reason why a folder can't be listed; null if it can."""
    return F.when(~source_ok, "invalid_candidate_source").when(candidate.isNull(), "candidate_not_found").when(~exists, "directory_not_found").when(~is_dir, "not_a_directory")


def read_guard(depth_ok: Column, given: Column, candidate_ok: Column, exists: Column, is_dir: Column, allowed: Column) -> Column:
    """The first reason why a file can't be previewed; null if it can."""
    return F.when(~depth_ok | ~given, "invalid_argument").when(~candidate_ok, "candidate_not_found").when(~exists, "file_not_found").when(is_dir, "directory_not_supported").when(~allowed, "preview_not_allowed")


def replies_with_traces(messages: DataFrame, default: str = "") -> DataFrame:
    """(thread_id, reply, traces, needs_confirmation): the last reply of each thread, how many tool messages its current turn has, and whether a prepared sending waits for confirmation."""
    reply = last_reply(messages, default).select("thread_id", "reply")
    traces = tool_calls_in_turn(messages).select("thread_id", F.col("calls").alias("traces"))
    waiting = pending_last_send(messages).select("thread_id", F.lit(True).alias("_waits"))
    joined = reply.join(traces, "thread_id").join(waiting, "thread_id", "left")
    return joined.select("thread_id", "reply", "traces", F.coalesce("_waits", F.lit(False)).alias("needs_confirmation"))


def clear_result(blocks: Column, client: Column) -> Column:
    """struct(client_id, sources, items, pending) of the first text block (type, text) that is JSON; the client itself and zeros where a part or all of it is missing."""
    texts = F.filter(F.coalesce(blocks, F.array()), lambda b: (b["type"] == "text") & F.try_parse_json(b["text"]).isNotNull())
    first = F.get(texts, F.lit(0))["text"]
    count = lambda k: F.coalesce(F.get_json_object(first, f"$.{k}").try_cast("int"), F.lit(0))
    return F.struct(F.coalesce(F.get_json_object(first, "$.client_id"), client).alias("client_id"), count("cleared_candidate_source_count").alias("sources"), count("cleared_candidate_item_count").alias("items"), count("cleared_pending_count").alias("pending"))
