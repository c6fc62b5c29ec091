"""Inputs that queries derive from the test tables: each as a DataFrame and as a SQL common table expression of equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.operators.incremental import slashed
from docmill.session import table

#: White space in the SQL engine's regular expressions.
W = r"[\t-\r \x{85}\p{Z}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def collapse_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}+', ' ', 'g'))"


def newlines_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g')"


def normalize_sql(x: str) -> str:
    return strip_sql(f"regexp_replace({newlines_sql(x)}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def preview_sql(x: str, n: int) -> str:
    return f"case when length({collapse_sql(x)}) <= {n} then {collapse_sql(x)} else rtrim(substring({collapse_sql(x)}, 1, {n})) || '...' end"


def files(spark: SparkSession, d: str) -> DataFrame:
    """One row a path of file_records: name, folder, size of the last record, and every 13th path as a folder."""
    full = slashed("path")
    rows = table(spark, d, "file_records").groupBy(full.alias("full_path")).agg(F.max_by("size", "record_id").alias("size"), F.max_by("mtime", "record_id").alias("mtime"), F.max("record_id").alias("record_id"))
    return rows.select(F.regexp_extract("full_path", "([^/]+)$", 1).alias("name"), F.regexp_replace("full_path", "/[^/]+$", "").alias("path"), "size", "mtime", (F.col("record_id") % 13 == 0).alias("is_dir"), "full_path")


FILES = """files as (select regexp_extract(full_path, '([^/]+)$', 1) as name, regexp_replace(full_path, '/[^/]+$', '') as path, size, mtime, rid % 13 = 0 as is_dir, full_path
 from (select replace(path, '\\', '/') as full_path, arg_max_null(size, record_id) as size, arg_max_null(mtime, record_id) as mtime, max(record_id) as rid from file_records group by 1))"""


def run_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("view", "tool_call", "purchase", "tool_result", "click", "assistant_delta", "signup", "reasoning_delta")])
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("thread_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.coalesce(kind[F.col("event_type")], F.lit("error")).alias("type"),
        F.get_json_object("props", "$.k").cast("long").alias("call_id"), "value", F.col("event_type").alias("text"),
    )


RUN_EVENTS = """run_events as (select event_id as seq, user_id as thread_id, epoch_us(ts) // 1000 as ts, case event_type when 'view' then 'tool_call' when 'purchase' then 'tool_result' when 'click' then 'assistant_delta'
 when 'signup' then 'reasoning_delta' else 'error' end as type, cast(props->>'$.k' as bigint) as call_id, value, event_type as text from events)"""


def messages(spark: SparkSession, d: str) -> DataFrame:
    role = F.create_map(*[F.lit(x) for x in ("signup", "user", "click", "assistant", "view", "assistant", "purchase", "tool")])
    return table(spark, d, "events").select(
        F.col("user_id").alias("thread_id"), F.col("event_id").alias("idx"), F.coalesce(role[F.col("event_type")], F.lit("system")).alias("role"), F.col("props").alias("content"), F.col("event_type").alias("reasoning"),
        (F.col("event_type") == "view").alias("has_calls"), F.when(F.col("event_id") % 3 == 0, "prepare_send").otherwise("search_files").alias("tool"), (F.col("value") > 20).alias("ok"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"), (F.col("event_id") % 17 == 0).alias("resolved"),
    )


MESSAGES = """messages as (select user_id as thread_id, event_id as idx, case event_type when 'signup' then 'user' when 'click' then 'assistant' when 'view' then 'assistant' when 'purchase' then 'tool' else 'system' end as role,
 props as content, event_type as reasoning, event_type = 'view' as has_calls, case when event_id % 3 = 0 then 'prepare_send' else 'search_files' end as tool, value > 20 as ok, 't' || event_id as token, event_id % 17 = 0 as resolved from events),
 turned as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by thread_id order by idx rows unbounded preceding) as turn,
 coalesce(idx >= max(case when role = 'user' then idx end) over (partition by thread_id), true) as current from messages)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as text blocks, five a page, larger where they are shorter."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("pos", "x"))
    size = F.when(F.length("x") < 40, 14.0).when(F.length("x") < 80, 12.5).otherwise(10.0)
    return lines.select("file", (F.floor(F.col("pos") / 5) + 1).cast("int").alias("page_number"), (F.col("pos") + 1).cast("int").alias("ordinal"), F.regexp_replace("x", "^ +| +$", "").alias("text"), size.alias("max_font_size"), F.lit(1).alias("line_count")).where("text <> ''")


BLOCKS = """blocks as (select file, cast((i - 1) // 5 + 1 as int) as page_number, cast(i as int) as ordinal, regexp_replace(x, '^ +| +$', '', 'g') as text, case when length(x) < 40 then 14.0 when length(x) < 80 then 12.5 else 10.0 end::double as max_font_size
 from (select doc_id as file, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where regexp_replace(x, '^ +| +$', '', 'g') <> '')"""


def parents(spark: SparkSession, d: str) -> DataFrame:
    """The parent store with its metadata as columns; one row a parent_id."""
    get = lambda k: F.get_json_object("metadata_json", f"$.{k}").alias(k)
    rows = table(spark, d, "parent_docs").groupBy("parent_id").agg(F.min("content").alias("content"), F.min("metadata_json").alias("metadata_json"), F.min("kb_name").alias("kb_name"))
    return rows.select("parent_id", "content", "kb_name", get("doc_type"), get("file_path"), get("h1"), get("h2"), get("h3"), get("heading_path"), get("section_title"), get("sheet_name"), get("page_number"))


PARENTS = """parents as (select parent_id, content, kb_name, m->>'$.doc_type' as doc_type, m->>'$.file_path' as file_path, m->>'$.h1' as h1, m->>'$.h2' as h2, m->>'$.h3' as h3, m->>'$.heading_path' as heading_path,
 m->>'$.section_title' as section_title, m->>'$.sheet_name' as sheet_name, m->>'$.page_number' as page_number from (select parent_id, min(content) as content, min(metadata_json) as m, min(kb_name) as kb_name from parent_docs group by 1))"""


def children(spark: SparkSession, d: str) -> DataFrame:
    """The filled lines of parents as their children."""
    lines = parents(spark, d).select("parent_id", F.posexplode(F.split("content", "\n")).alias("child_no", "content"))
    return lines.where(F.regexp_replace("content", "^ +| +$", "") != "").withColumn("child_id", F.concat("parent_id", F.lit("#"), F.col("child_no").cast("string")))


CHILDREN = """children as (select parent_id, cast(i - 1 as int) as child_no, x as content, parent_id || '#' || (i - 1) as child_id from (select parent_id, unnest(string_split(content, chr(10))) as x,
 generate_subscripts(string_split(content, chr(10)), 1) as i from parents) where regexp_replace(x, '^ +| +$', '', 'g') <> '')"""


def proper_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of 64 finite numbers that aren't all zero."""
    v = F.col("vectors")
    return table(spark, d, "embed_vectors").where((F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0))


VECTORS = """vecs as (select vec_id, child_id, parent_id, is_probe, cast(vectors as double[]) as v from embed_vectors where len(vectors) = 64
 and len(list_filter(vectors, lambda x: x is null or isnan(x))) = 0 and len(list_filter(vectors, lambda x: x <> 0)) > 0)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Scans as candidate events: failed and aborted ones as failures, unended ones as clearing."""
    return table(spark, d, "scan_results").select(F.col("kb_name").alias("client"), F.when(F.col("scan_id") % 2 == 0, "search_files").otherwise("list_folder_contents").alias("source"), F.col("scan_id").alias("seq"), F.coalesce(F.col("status") == "success", F.lit(False)).alias("ok"), F.col("modified").alias("results"), F.col("status").isNull().alias("cleared"))


SNAPSHOTS = """snaps as (select kb_name as client, case when scan_id % 2 = 0 then 'search_files' else 'list_folder_contents' end as source, scan_id as seq, coalesce(status = 'success', false) as ok, modified as results, status is null as cleared from scan_results),
 gone as (select client, max(seq) as g from snaps where cleared group by 1),
 latest as (select client, source, seq, results from (select s.*, row_number() over (partition by s.client, s.source order by seq desc) as k from snaps s left join gone on gone.client = s.client
 where not cleared and (ok or source = 'search_files') and (g is null or seq > g)) where k = 1 and ok)"""
