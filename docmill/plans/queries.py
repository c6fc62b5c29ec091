"""Queries of the core operators over the test tables, with equivalent SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.functions import text as fn
from docmill.operators import catalog, chunking, cleaning, embedding, incremental, messages as msg, quality, registry, retrieval, structure
from docmill.plans import fixtures as fx
from docmill.plans.fixtures import BLOCKS, CHILDREN, FILES, MESSAGES, PARENTS, RUN_EVENTS, SNAPSHOTS, VECTORS, W, collapse_sql, newlines_sql, normalize_sql, preview_sql, strip_sql
from docmill.session import shared_dir, table
from docmill.plans import office
from docmill.plans.office import OFFICE
from docmill.sources import files as sources, frames, sinks

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL if there is one."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


# incremental processing

P4_SQL = """with l as (select scan_id, replace(path, '\\', '/') as path, mtime, size, row_number() over (partition by scan_id, replace(path, '\\', '/') order by record_id desc) k
 from file_records where mtime is not null), ok as (select scan_id, lag(scan_id) over (partition by root_dir order by scan_id) as prev from scan_results where status = 'success')
 select ok.scan_id, l.path from ok join l on l.scan_id = ok.scan_id and l.k = 1 left join l p on p.scan_id = ok.prev and p.path = l.path and p.k = 1
 where p.scan_id is null or p.mtime <> l.mtime or p.size is distinct from l.size"""


@query(P4_SQL)
def p4_found(spark, d):
    """All scans as one run of a new target in the shared folder; the rows are read from what it published."""
    target = incremental.VersionedTarget(spark, f"{shared_dir(spark)}/p4-{uuid.uuid4().hex}")
    incremental.process_scans(target, table(spark, d, "file_records"), table(spark, d, "scan_results"))
    return incremental.processed_paths(target).select("scan_id", "path")


@query(P4_SQL)
def changed_paths(spark, d):
    """The same for a whole history at once, without a target."""
    return incremental.changed_paths(table(spark, d, "file_records"), table(spark, d, "scan_results")).select("scan_id", "path")


# retrieval

_ASKED = "(select vec_id as query_id, v as qv from vecs where vec_id % 20 = 0)"


def _hits(spark, d, k):
    """Every vector whose id is divisible by 20 asks all vectors."""
    vectors = fx.proper_vectors(spark, d).select("vec_id", "vectors")
    return retrieval.top_k(vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vectors").alias("query_vector")), k, "vec_id", "vectors")


@query(f"""with {VECTORS}, {PARENTS}, d as (select query_id, vec_id, parent_id, 1 - list_cosine_similarity(qv, v) as dist from vecs, {_ASKED}), r as (select *, row_number() over (partition by query_id order by dist, vec_id) as rank from d)
 select query_id, rank, vec_id, round(dist, 6) as distance, round(greatest(0.0, 1 - dist), 4) as score, coalesce({preview_sql("content", 120)}, '') as parent_preview from r left join parents using (parent_id) where rank <= 10""")
def vector_topk_parent(spark, d):
    hits = _hits(spark, d, 10).join(table(spark, d, "embed_vectors").select("vec_id", "parent_id"), "vec_id").join(fx.parents(spark, d).select("parent_id", "content"), "parent_id", "left")
    return hits.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"), retrieval.score(F.col("distance")).alias("score"), F.coalesce(fn.preview("content", 120), F.lit("")).alias("parent_preview"))


@query(f"""with {VECTORS}, {PARENTS}, r as (select query_id, parent_id, 1 - list_cosine_similarity(qv, v) as dist, vec_id,
 row_number() over (partition by query_id order by 1 - list_cosine_similarity(qv, v), vec_id) as rank from vecs, {_ASKED}) select query_id, rank, round(greatest(0.0, 1 - dist), 4) as score, {preview_sql("coalesce(nullif(content, ''), '')", 200)} as preview
 from r left join parents using (parent_id) where rank <= 3""")
def query_report(spark, d):
    chunks = table(spark, d, "embed_vectors").select("vec_id", "parent_id", F.lit("").alias("content"))
    return retrieval.query_report(retrieval.with_parents(_hits(spark, d, 5), chunks, fx.parents(spark, d), "vec_id"))


@query("""select cast(i as int) as rank, id, document, distance from (select scan_id, unnest(modified) as id, unnest(modified) as document, generate_subscripts(modified, 1) as i, cast(scan_id as double) as distance from scan_results)""")
def flattened_results(spark, d):
    first = lambda c: F.array(c)
    rows = table(spark, d, "scan_results").select(first(F.col("modified")).alias("ids"), first(F.col("modified")).alias("documents"), first(F.transform("modified", lambda x: F.col("scan_id").cast("double"))).alias("distances"))
    return retrieval.flatten_result(rows)


@query(f"""with t as (select doc_id, ' ' || {collapse_sql('lower(text)')} || ' ' as x from documents where text is not null), g as (select doc_id, unnest(range(1, length(x) - 1)) as i, x from t), c as (select doc_id,
 (unicode(substring(x, i, 1)) * 73856093::bigint + unicode(substring(x, i + 1, 1)) * 19349663::bigint + unicode(substring(x, i + 2, 1)) * 83492791::bigint) % 2147483629 as h from g),
 v as (select doc_id, cast(h % 64 as int) as place, sum(case when h // 64 % 2 = 1 then 1 else -1 end) as n from c group by 1, 2), l as (select doc_id, sqrt(sum(n * n)) as len from v group by 1) select doc_id, place, round(cast(cast(n / len as float) as double), 6) as value from v join l using (doc_id) where n <> 0""")
def hashed_embeddings(spark, d):
    rows = embedding.embed(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text", lambda: embedding.HashingEncoder(64))
    held = rows.select("doc_id", F.posexplode(embedding.checked("embedding", 64)).alias("place", "value"))
    return held.where("value <> 0").select("doc_id", "place", F.round(F.col("value").cast("double"), 6).alias("value"))


# catalogue

_SUFFIX = "lower(regexp_extract(regexp_extract({p}, '([^/\\\\]*)$', 1), '^.+(\\.[^./\\\\]+)$', 1))"
_REASON = f"""case when p like '%/.git/%' or p like '%/node_modules/%' or p like '%/\\_\\_pycache\\_\\_/%' escape '\\' or p like '%/dist/%' or p like '%/.vite/%' or p like '%/.venv/%' or p like '%/.idea/%' or p like '%/final/%' then 'excluded_by_glob'
 when {_SUFFIX.format(p="p")} in ('.md', '.docx', '.pdf', '.txt') then case when size > 1048576 then 'size_exceeds_limit' end when {_SUFFIX.format(p="p")} = '.pptx' then 'pptx_not_supported_in_step1' else 'unsupported_extension' end"""
_SCAN = (".md", ".docx", ".pdf", ".txt"), (*catalog.EXCLUDE_GLOB, "**/final/**")


@query(f"select record_id, {_REASON} as reason from (select record_id, replace(path, '\\', '/') as p, size from file_records)")
def scan_reasons(spark, d):
    return table(spark, d, "file_records").select("record_id", catalog.skip_reason("path", "size", 1, *_SCAN).alias("reason"))


def _two_listings(spark, d):
    """The listings of the last successful scan of each root, and of the one before."""
    state = incremental.listings(table(spark, d, "file_records"))
    last = table(spark, d, "scan_results").where("status = 'success'").groupBy("root_dir").agg(F.max("scan_id").alias("scan_id"))
    both = incremental.successful(table(spark, d, "scan_results")).join(last, "scan_id", "left_semi")
    return state.join(both.select("scan_id"), "scan_id").drop("scan_id"), state.join(both.select(F.col("prev_id").alias("scan_id")), "scan_id").drop("scan_id")


_LISTINGS = """l as (select scan_id, replace(path, '\\', '/') as path, mtime, size, row_number() over (partition by scan_id, replace(path, '\\', '/') order by record_id desc) k from file_records where mtime is not null),
 ok as (select scan_id, root_dir, lag(scan_id) over (partition by root_dir order by scan_id) as prev, row_number() over (partition by root_dir order by scan_id desc) as n from scan_results where status = 'success'),
 cur as (select path, mtime, size from l join ok using (scan_id) where n = 1 and k = 1), man as (select path, coalesce(mtime, 0) as mtime, coalesce(size, 0) as size from l join ok on l.scan_id = ok.prev where n = 1 and k = 1)"""
_STATUS = "case when m.path is null then 'added' when c.path is null then 'deleted' when c.mtime is not distinct from m.mtime and c.size is not distinct from m.size then 'unchanged' else 'modified' end"


@query(f"with {_LISTINGS} select coalesce(c.path, m.path) as path, {_STATUS} as status from cur c full join man m on c.path = m.path")
def scan_diff(spark, d):
    return catalog.diff(*_two_listings(spark, d))


_DUP = f"""stems as (select p, size, mtime, substring(p, 1, length(p) - length({_SUFFIX.format(p="p")})) as stem, {_SUFFIX.format(p="p")} as suffix from {{src}}),
 best as (select stem, max(struct_pack(r := case suffix when '.md' then 3 when '.docx' then 2 else 1 end, s := suffix)).s as b from stems where suffix in ('.md', '.docx', '.txt') group by 1)"""


@query(f"""with {_LISTINGS}, base as (select path as p, size, mtime from cur), judged as (select p, size, mtime, {_REASON} as reason from base), kept as (select p, size, mtime from judged where reason is null), {_DUP.format(src="kept")},
 dup as (select p, size, mtime, case when suffix = '.pdf' then b end as d from stems left join best using (stem)), c as (select p as path, mtime, size from dup where d is null), done as (select coalesce(c.path, m.path) as path, {_STATUS} as status from c full join man m on c.path = m.path)
 select status, count(*) as n from (select status from done union all select 'skipped' from judged where reason is not null union all select 'skipped' from dup where d is not null) group by 1""")
def scan_summary(spark, d):
    current, manifest = _two_listings(spark, d)
    return catalog.scan_summary(catalog.scan(current, manifest, 1, *_SCAN))


@query(f"""with base as (select distinct replace(path, '\\', '/') as p, 0 as size, 0 as mtime from file_records union select distinct regexp_replace(replace(path, '\\', '/'), '\\.md$', '.pdf'), 0, 0 from file_records), {_DUP.format(src="base")}
 select p as path, case when suffix = '.pdf' then b end as duplicate_of from stems left join best using (stem)""")
def duplicate_suppression(spark, d):
    paths = table(spark, d, "file_records").select(incremental.slashed("path").alias("path"))
    both = paths.union(paths.select(F.regexp_replace("path", r"\.md$", ".pdf"))).distinct()
    return catalog.suppress_duplicates(both)


_BLOCKED = ", ".join(f"'{x}'" for x in catalog.BLOCKED_PARTS)
_FOUND = f"""ok as (select *, lower(name) as low, case when is_dir then lower(name) else lower(substring(name, 1, length(name) - length({_SUFFIX.format(p="name")}))) end as stem, case when is_dir then 0 else coalesce(size, 0) end as n
 from files where name <> '' and path <> '' and (is_dir or coalesce(size, 0) <> 0) and not list_has_any(string_split_regex(full_path, '[/\\\\]'), [{_BLOCKED}])
 and not regexp_matches(name, '^(~\\$|\\.~|\\._)') and not regexp_matches(lower(name), '[^.]\\.(tmp|temp|bak|swp)$|^(thumbs\\.db|desktop\\.ini|ntuser\\.dat)$'))"""
_ORDER = "score desc, length(stem), length(regexp_replace(full_path, '[^/\\\\]', '', 'g')), length(full_path), lower(name), full_path"
_HIDDEN = "case when regexp_matches(low, '^(_|\\.|~\\$)') then 400 else 0 end"


def _search_sql(word: str, scope: str | None = None) -> str:
    whole = f"regexp_matches({{x}}, '(^|[^0-9a-z_]){word}([^0-9a-z_]|$)')"
    score = f"case when stem = '{word}' or low = '{word}' then 5000 when {whole.format(x='stem')} then 3000 when starts_with(stem, '{word}') then 2000 when contains(stem, '{word}') then 1000 when contains(low, '{word}') then 500 else 0 end + case when is_dir then 300 else 0 end - {_HIDDEN}"
    where = f" and (starts_with(path, '{scope}/') or path = '{scope}')" if scope else ""
    return f"""with {FILES}, {_FOUND}, hits as (select *, {score} as score from (select *, row_number() over (partition by lower(full_path) order by case when is_dir and low = '{word}' then 0 when is_dir and {whole.format(x='low')} then 1 when {whole.format(x='low')} then 2 else 3 end, name, full_path) as k from ok where contains(low, '{word}'){where}) where k = 1)
 select row_number() over (order by {_ORDER}) as rank, name, path, cast(n as bigint) as size, is_dir, full_path, score from hits order by {_ORDER} limit 20"""


@query(_search_sql("draft"))
def file_search(spark, d):
    return catalog.search(fx.files(spark, d), "draft")


@query(_search_sql("schedule", "/srv/kb/team_shared"))
def file_search_scoped(spark, d):
    return catalog.search(fx.files(spark, d), " schedule ", "/srv/kb/team_shared/")


@query(f"""with {FILES}, {_FOUND}, folder as (select path from files group by path order by count(*) desc, path limit 1), hits as (select ok.*, case when is_dir then 300 else 0 end - {_HIDDEN} as score from ok join folder using (path))
 select row_number() over (order by {_ORDER}) as rank, name, path, cast(n as bigint) as size, is_dir, full_path, score from hits order by {_ORDER} limit 30""")
def folder_listing(spark, d):
    files = fx.files(spark, d)
    return catalog.children(files, files.groupBy("path").count().orderBy(F.desc("count"), "path").limit(1))


def _size_sql(x: str) -> str:
    scaled = lambda u: f"cast(round(cast({x} as decimal(30, 6)) / {u}, 1) as decimal(30, 1))"
    return f"case when {x} < 1024 then {x} || ' B' when {x} < 1048576 then {scaled(1024)} || ' KB' when {x} < 1073741824 then {scaled(1048576)} || ' MB' else {scaled(1073741824)} || ' GB' end"


@query(f"with s as ({_search_sql('draft')}) select rank as index, name, full_path, case when not is_dir then size end as size, case when is_dir then 'folder' else {_size_sql('size')} end as size_display, is_dir from s")
def search_results(spark, d):
    return catalog.serialized(file_search(spark, d))


@query("select preview_id, regexp_matches(lower(file_type), '^(csv|json|log|md|py|txt|yaml|yml)$') as is_text, lower(regexp_extract(path, '^.*/[^/]+(\\.[^./]+)$', 1)) as suffix from file_previews")
def preview_types(spark, d):
    from docmill.sources.files import TEXT_SUFFIXES

    kind = F.concat(F.lit("."), F.lower("file_type")).isin(*TEXT_SUFFIXES)
    return table(spark, d, "file_previews").select("preview_id", kind.alias("is_text"), catalog.suffix_of(incremental.slashed("path")).alias("suffix"))


# cleaning

@query(f"select parent_id, {normalize_sql('content')} as text from parent_docs")
def normalize_text(spark, d):
    return table(spark, d, "parent_docs").select("parent_id", cleaning.normalize("content").alias("text"))


@query(f"select preview_id, {collapse_sql('preview_text')} as flat, {normalize_sql('replace(preview_text, chr(160), chr(32))')} as block from file_previews")
def block_texts(spark, d):
    return table(spark, d, "file_previews").select("preview_id", cleaning.repeated_text("preview_text").alias("flat"), cleaning.block_text("preview_text").alias("block"))


@query()
def markdown_noise(spark, d):
    return table(spark, d, "parent_docs").select("parent_id", cleaning.strip_markdown_noise("content").alias("text"))


_LINES = f"list_filter(list_transform(string_split({newlines_sql('text')}, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"
_EDGES = f"""lined as (select coalesce(source, '-') as file, doc_id, {_LINES} as ls from documents where text is not null), both_edges as (select file, 'first' as edge, ls[1] as line from lined where len(ls) > 0 union all select file, 'last', ls[-1] from lined where len(ls) > 0),
 edges as (select file, edge, line, count(*) as n from both_edges where length(line) <= 80 group by all having count(*) >= 2)"""


def _pages(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("source", F.lit("-")).alias("file"), "text")


@query(f"with {_EDGES} select * from edges")
def repeated_edges(spark, d):
    return cleaning.repeated_edges(_pages(spark, d), "file", "text")


@query(f"""with {_EDGES}, e as (select file, list(distinct line) as held from edges group by 1) select doc_id, {normalize_sql("array_to_string(list_filter(ls, lambda x: not coalesce(list_contains(held, x), false) and not regexp_matches(x, '(?i)^(page\\s+)?\\d+$')), chr(10))")} as clean from lined left join e using (file)""")
def strip_edges(spark, d):
    return cleaning.strip_page_noise(_pages(spark, d), "file", "text").select("doc_id", "clean")


@query(f"""with {PARENTS}, h as (select *, list_filter(list_transform(string_split({newlines_sql('content')}, chr(10)), lambda x: {strip_sql('x')}), lambda x: starts_with(x, '#')) as heads from parents)
 select parent_id, coalesce(nullif(sheet_name, ''), nullif(heading_path, ''), case when cast(page_number as int) <> 0 and parent_id > '8' then 'Page ' || page_number end, {strip_sql("regexp_replace(heads[1], '^[# ]+', '')")}, '') as title from h""")
def section_titles(spark, d):
    page = F.when(F.col("parent_id") > "8", F.col("page_number").cast("int"))
    return fx.parents(spark, d).select("parent_id", cleaning.section_title("content", F.col("sheet_name"), F.col("heading_path"), page).alias("title"))


# structure of paged documents

_NUMBERED = f"""case when regexp_matches({{t}}, '^附录(?:\\s*[A-Za-z0-9一二三四五六七八九十]+)?(?:\\s+|$)') or regexp_matches({{t}}, '^[一二三四五六七八九十]+[、.．]\\S+') then 1
 when regexp_matches({{t}}, '^([1-9]\\d*(?:\\.\\d+)+)\\s+\\S+') then case when length(regexp_replace(regexp_extract({{t}}, '^([1-9]\\d*(?:\\.\\d+)+)\\s+\\S+', 1), '[^.]', '', 'g')) + 1 <= 2 then 2 else 3 end end"""
_T = collapse_sql("text")
_TOC_LINE = f"length({_T}) <= 220 and {_T} not in ('目录', '目 录') and regexp_matches({_T}, '(?:\\.{{3,}}|…{{2,}}|·{{3,}})\\s*\\d+\\s*$')"
_SENTENCE = "length(trim(replace(text, chr(10), ' '))) > 160 or regexp_matches(trim(replace(text, chr(10), ' ')), '[。！？；.!?;]$')"
_HEADING = structure.HEADING.replace("(?i)", "(?i)")
_FONTS = """fonts as (select file, size as body from (select file, size, row_number() over (partition by file order by long desc, n desc, first) as k from (select file, length(text) >= 20 as long, round_even(max_font_size, 1) as size, count(*) as n, min(ordinal) as first from blocks group by all)) where k = 1),
 titles as (select file, text as title from (select file, text, row_number() over (partition by file order by max_font_size desc, ordinal) as k from blocks join fonts using (file) where page_number = 1 and length(text) <= 80 and max_font_size >= body + 4) where k = 1)"""
_LEVELED = f"""leveled as (select b.file, page_number, ordinal, text, title, case when (coalesce(title, '') <> '' and page_number = 1 and text = title) or {_T} in ('目录', '目 录') or ({_TOC_LINE}) or (length({_T}) <= 10 and regexp_matches({_T}, '^[\\s\\-—–_·]+$')) or length(text) > 120 then null
 when {_SENTENCE} then null when ({_NUMBERED.format(t=_T)}) is not null then {_NUMBERED.format(t=_T)} when regexp_matches(trim(replace(text, chr(10), ' ')), '{_HEADING}') or max_font_size >= body + 1.5 then case when max_font_size >= body + 5 then 1 when max_font_size >= body + 2.5 then 2 else 3 end end as level
 from blocks b join fonts using (file) left join titles using (file) where not coalesce(page_number = 1 and text = title, false))"""


@query(f"with {BLOCKS}, {_FONTS} select file, body from fonts")
def body_fonts(spark, d):
    return structure.body_font(fx.blocks(spark, d))


@query(f"with {BLOCKS}, {_FONTS} select file, title from titles")
def document_titles(spark, d):
    b = fx.blocks(spark, d)
    return structure.document_title(b, structure.body_font(b))


@query(f"with {BLOCKS}, {_FONTS}, {_LEVELED} select file, ordinal, level from leveled")
def heading_levels(spark, d):
    return structure.leveled(fx.blocks(spark, d)).select("file", "ordinal", "level")


def _dotted(b: DataFrame) -> DataFrame:
    return b.withColumn("text", F.when(F.col("file") % 3 == 0, F.when(F.col("ordinal") % 5 == 1, "目录").otherwise(F.concat("text", F.lit(" ..... "), F.col("ordinal").cast("string")))).otherwise(F.col("text")))


@query(f"""with {BLOCKS}, b as (select file, page_number, ordinal, case when file % 3 = 0 then case when ordinal % 5 = 1 then '目录' else text || ' ..... ' || ordinal end else text end as text from blocks)
 select file, page_number from b group by all having (bool_or({_T} in ('目录', '目 录')) and count_if({_TOC_LINE}) >= 3) or count_if({_TOC_LINE}) >= 6""")
def toc_pages(spark, d):
    return structure.toc_pages(_dotted(fx.blocks(spark, d)))


def _by_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("file"))
    return fx.blocks(spark, d).withColumnRenamed("file", "doc_id").join(docs, "doc_id").select("file", F.col("doc_id").alias("page_number"), "text", "ordinal", "max_font_size")


@query(f"with {BLOCKS} select coalesce(source, '-') as file, {_T} as key, count(distinct doc_id) as pages from blocks b join documents d on d.doc_id = b.file where length({collapse_sql('b.text')}) between 1 and 80 and not regexp_matches({collapse_sql('b.text')}, '^第\\s*\\d+\\s*页$') group by all having count(distinct doc_id) >= 3".replace(_T, collapse_sql("b.text")))
def page_repeats(spark, d):
    return structure.repeated_headers(_by_source(spark, d))


@query(f"""with {BLOCKS}, {_FONTS}, {_LEVELED}, n as (select *, count(level) over (partition by file order by ordinal rows unbounded preceding) as section_no from leveled),
 s as (select file, section_no, max(level) as level, max(case when level is not null then text end) as title, string_agg(case when level is null then text end, chr(10) || chr(10) order by ordinal) as body, min(page_number) as page_start, max(page_number) as page_end, max(title) as document_title from n group by 1, 2)
 select file, section_no, coalesce(level, 1) as level, coalesce(title, document_title) as title, coalesce(body, '') as body, page_start, page_end from (select *, max(section_no) over (partition by file) as m from s) where m > 0 and (section_no > 0 or coalesce(document_title, '') <> '')""".replace("max(case when level is not null then text end) as title", "max(case when level is not null then text end) as title"))
def section_build(spark, d):
    return structure.sections(fx.blocks(spark, d)).select("file", "section_no", "level", "title", F.array_join("body_texts", "\n\n").alias("body"), "page_start", "page_end")


_BODY = "length(array_to_string(list_filter(body_texts, lambda x: x is not null and x <> ''), chr(10) || chr(10)))"


@query(f"select section_id, coalesce(level > 1 and (coalesce({_BODY}, 0) >= 300 or (page_end > page_start and coalesce({_BODY}, 0) >= 200) or (coalesce(len(body_texts), 0) >= 3 and coalesce({_BODY}, 0) >= 220)), false) as promoted from pdf_sections")
def promote_subsections(spark, d):
    return table(spark, d, "pdf_sections").select("section_id", structure.promoted("level", "body_texts", "page_start", "page_end").alias("promoted"))


@query()
def parent_drafts(spark, d):
    return structure.drafts(table(spark, d, "pdf_sections"), "file_path", "section_id").drop("document_title")


@query()
def paged_documents(spark, d):
    return structure.paged_documents(fx.blocks(spark, d))


_DRAFT_TEXT = "array_to_string(list_filter(texts, lambda x: x is not null and x <> ''), chr(10) || chr(10))"


@query(f"select draft_id, page_start = 1 and page_end = 1 and length({_DRAFT_TEXT}) <= 180 and (len(title_hierarchy) = 1 or regexp_matches({_DRAFT_TEXT}, '编制单位|编制日期|版本号')) as cover from pdf_drafts")
def cover_drafts(spark, d):
    return table(spark, d, "pdf_drafts").select("draft_id", structure.is_cover("title_hierarchy", "texts", "page_start", "page_end").alias("cover"))


@query("select draft_id, case when coalesce(section_title, '') <> '' then array_to_string(list_prepend(section_title, list_filter(coalesce(title_hierarchy, []), lambda x: x is not null and x <> '' and x <> section_title)), ' / ') else array_to_string(list_filter(coalesce(title_hierarchy, []), lambda x: x is not null and x <> ''), ' / ') end as path from pdf_drafts")
def draft_heading_paths(spark, d):
    return table(spark, d, "pdf_drafts").select("draft_id", structure.heading_path("section_title", "title_hierarchy").alias("path"))


# chunks

_LISTED = r"\n(\s*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|[（(]?\d+[）)]\s+|[一二三四五六七八九十]+[、.．]\s+))"
_MARKED = "regexp_replace(regexp_replace(text, '([。！？；!?])', '\\1' || chr(1), 'g'), '([.;])" + W + "+', '\\1' || chr(1), 'g')"
_MARKED = f"regexp_replace(regexp_replace(regexp_replace({_MARKED}, '\\n{{2,}}', chr(1), 'g'), '{_LISTED}', chr(1) || '\\1', 'g'), '{_LISTED}', chr(1) || '\\1', 'g')"


@query(f"select doc_id, array_to_string(list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda x: {strip_sql('x')}), lambda x: x <> ''), ' ¦ ') as units from documents where text is not null")
def sentence_units(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(chunking.sentence_units("text"), " ¦ ").alias("units"))


_C = collapse_sql("content")


@query(f"with {PARENTS}, {CHILDREN} select child_id, {_C} <> '' and length({_C}) <= 80 and (regexp_matches({_C}, '{chunking.STRUCTURAL}') or not regexp_matches({_C}, '{chunking.MEANING}')) as noise from children")
def noise_chunks(spark, d):
    return fx.children(spark, d).select("child_id", chunking.is_noise("content").alias("noise"))


_NEXT = f"({_C} <> '' and (regexp_matches({_C}, '{chunking.SHORT_HEADING}') or regexp_matches({_C}, '[：:]$')))"
_PREVIOUS = f"regexp_matches({_C}, '^[-*+] ')"


@query(f"with {PARENTS}, {CHILDREN} select child_id, {_NEXT} as label, {_PREVIOUS} as item, regexp_matches({_C}, '{chunking.MEANING}') and not {_NEXT} and not {_PREVIOUS} and length({_C}) <= 32 and not regexp_matches({_C}, '[。！？；，、,.!?;:：()（）\\[\\]{{}}]') as alone from children")
def chunk_kinds(spark, d):
    return fx.children(spark, d).select("child_id", chunking.attaches_to_next("content").alias("label"), chunking.attaches_to_previous("content").alias("item"), chunking.stands_alone("content").alias("alone"))


@query()
def recursive_split(spark, d):
    return chunking.recursive_pieces(fx.parents(spark, d), ["parent_id"], "content")


def _loaded(spark, d):
    return fx.parents(spark, d).select("file_path", "doc_type", F.row_number().over(chunking.Window.partitionBy("file_path").orderBy("parent_id")).alias("doc_no"), F.col("content").alias("text"), "heading_path", "section_title", "sheet_name", "page_number")


@query()
def parent_chunks(spark, d):
    return chunking.split_parents(_loaded(spark, d))


@query()
def child_chunks(spark, d):
    return chunking.split_children(fx.parents(spark, d).select("parent_id", "content"), lambda: embedding.HashingEncoder(64))


_STEPS = "steps as (select *, 1 - list_cosine_similarity(lag(v) over (partition by parent_id order by vec_id), v) as dist from vecs where parent_id is not null), cutoff as (select *, quantile_cont(dist, 0.95) over (partition by parent_id) as threshold from steps)"


@query(f"with {VECTORS}, {_STEPS} select vec_id, round(dist, 6) as distance, round(threshold, 6) as threshold, sum(case when dist > threshold then 1 else 0 end) over (partition by parent_id order by vec_id rows unbounded preceding)::bigint as part from cutoff")
def semantic_breaks(spark, d):
    rows = chunking.break_points(fx.proper_vectors(spark, d).where("parent_id is not null"), "parent_id", "vec_id", "vectors")
    return rows.select("vec_id", F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"), F.col("part").cast("long").alias("part"))


_HEADS = ", ".join(f"{strip_sql(h)}" for h in ("h1", "h2", "h3"))


@query(f"with {PARENTS} select parent_id, coalesce(nullif(array_to_string(list_filter([{_HEADS}], lambda x: x is not null and x <> ''), ' / '), ''), nullif(heading_path, ''), nullif(section_title, ''), '') as path from parents")
def heading_paths(spark, d):
    return fx.parents(spark, d).select("parent_id", chunking.heading_path("h1", "h2", "h3", "heading_path", "section_title").alias("path"))


def _clean_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#*_`>\\[\\]()]', ' ', 'g'), '{W}+', ' ', 'g'), '^[ /]+|[ /]+$', '', 'g')"


@query(f"""with {PARENTS}, s as (select parent_id, content, doc_type, lower({_clean_sql("substring(content, 1, 300)")}) as head, list_transform(string_split(coalesce(heading_path, h1, ''), '/'), lambda x: {_clean_sql('x')}) as segs from parents),
 p as (select *, {collapse_sql("array_to_string(list_filter(segs, lambda x: x <> '' and not contains(head, lower(x))), ' / ')")} as pre from s) select parent_id, length(case when doc_type = 'md' and pre <> '' then '章节：' || case when length(pre) <= 160 then pre else regexp_replace(substring(pre, 1, 160), '[ /]+$', '') end || chr(10) || chr(10) || content else content end) as n, case when doc_type = 'md' then pre else '' end as prefix from p""")
def embedding_texts(spark, d):
    path = F.coalesce("heading_path", "h1")
    full = fn.embedding_text("content", "doc_type", path)
    added = F.substring(full, F.lit(1), F.length(full) - F.length("content"))
    return fx.parents(spark, d).select("parent_id", F.length(full).alias("n"), F.when(F.col("content").isNull(), F.when(F.col("doc_type") == "md", F.lit(None)).otherwise("")).otherwise(F.regexp_replace(added, "^章节：|\n\n$", "")).alias("prefix"))


# figures

@query(f"with {FILES}, {PARENTS}, {CHILDREN} select (select count(*) from files) as files, (select count(*) from parents) as parents, (select count(*) from children) as children")
def kb_stats(spark, d):
    return quality.kb_stats(fx.files(spark, d), fx.parents(spark, d), fx.children(spark, d))


@query(f"""with {FILES}, {PARENTS}, {CHILDREN}, n as (select parent_id, count(*) as n from children group by 1), per as (select file_path, list(parent_id order by parent_id) as ids, sum(coalesce(n, 0)) as c from parents left join n using (parent_id) group by 1)
 select full_path as path, mtime, size, coalesce(array_to_string(ids, ','), '') as parent_ids, coalesce(c, 0)::bigint as child_count from files left join per on file_path = full_path""")
def manifest_files(spark, d):
    files = fx.files(spark, d).select(F.col("full_path").alias("path"), "mtime", "size")
    return quality.manifest_files(files, fx.parents(spark, d), fx.children(spark, d)).withColumn("parent_ids", F.array_join("parent_ids", ","))


_QUALITY = """q as (select (select count(*) from parents) as parents, (select coalesce(avg(length(content)), 0) from parents) as parent_mean, (select count_if(length(content) < 120)::bigint from parents) as short_parents, (select count_if(coalesce(trim(heading_path), '') = '')::bigint from parents) as no_heading,
 (select count(*) from children) as children, (select coalesce(avg(length(content)), 0) from children) as child_mean, (select count_if(length(content) < 80)::bigint from children) as short_children, (select count_if(length(content) < 50)::bigint from children) as very_short_children, (select count(*) from (select parent_id from children group by 1 having count(*) > 1)) as split_parents)"""


@query(f"with {PARENTS}, {CHILDREN}, {_QUALITY} select * from q")
def chunk_quality(spark, d):
    return quality.chunk_quality(fx.parents(spark, d), fx.children(spark, d))


@query(f"with {PARENTS}, {CHILDREN}, {_QUALITY} select parents, children, case when split_parents < greatest(2, parents // 10) then 'few_split' when short_children > children * 0.3 then 'many_short' else 'fine' end as verdict from q")
def index_conclusion(spark, d):
    return quality.conclusion(chunk_quality(spark, d)).select("parents", "children", "verdict")


_COUNTS = "n as (select parent_id, count(*) as n from children group by 1), counts as (select file_path, count(*) as parents, sum(coalesce(n, 0))::bigint as children from parents left join n using (parent_id) group by 1)"


@query(f"with {PARENTS}, {CHILDREN}, {_COUNTS} select * from counts")
def file_counts(spark, d):
    return quality.file_counts(fx.parents(spark, d), fx.children(spark, d))


@query(f"with {PARENTS}, {CHILDREN}, {_COUNTS} select *, 10 * parents + children as score from counts where file_path is not null order by score desc, file_path desc limit 8")
def focus_files(spark, d):
    return quality.focus_files(fx.parents(spark, d).where("file_path is not null"), fx.children(spark, d))


@query(f"with {PARENTS}, {CHILDREN} select 'parent' as chunk_level, parent_id, null as child_id, length(content) as char_count, {preview_sql('content', 300)} as preview from parents union all select 'child', parent_id, child_id, length(content), {preview_sql('content', 300)} from children")
def chunk_dump(spark, d):
    return sinks.chunk_dump(fx.parents(spark, d), fx.children(spark, d)).select("chunk_level", "parent_id", "child_id", "char_count", "preview")


@query()
def chunk_report(spark, d):
    return sinks.report_lines(fx.parents(spark, d), fx.children(spark, d))


# scalar functions

@query(f"select record_id, case when size is not null then {_size_sql('size')} end as shown from file_records")
def size_display(spark, d):
    return table(spark, d, "file_records").select("record_id", fn.size_display("size").alias("shown"))


@query("select record_id, case when record_id % 7 = 0 then '' else strftime(make_timestamp((cast(floor(mtime) as bigint)) * 1000000), '%Y-%m-%d %H:%M:%S') end as shown from file_records where mtime is not null")
def filetime_display(spark, d):
    ticks = F.when(F.col("record_id") % 7 == 0, F.lit(0)).otherwise((F.floor("mtime").cast("long") + fn.FILETIME_OFFSET) * fn.TICKS)
    return table(spark, d, "file_records").where("mtime is not null").select("record_id", fn.filetime_display(ticks).alias("shown"))


@query("select scan_id, case scan_id % 4 when 0 then '' when 1 then strftime(date_trunc('second', started_at), '%Y-%m-%d %H:%M:%S') when 2 then 'soon' else '2001-09-09 01:46:40' end as shown from scan_results")
def modified_display(spark, d):
    iso = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.when(F.col("scan_id") % 4 == 0, "  ").when(F.col("scan_id") % 4 == 1, iso).when(F.col("scan_id") % 4 == 2, " soon ").otherwise(F.lit(str((1_000_000_000 + fn.FILETIME_OFFSET) * fn.TICKS)))
    return table(spark, d, "scan_results").select("scan_id", fn.modified_display(value).alias("shown"))


@query(f"select doc_id, {preview_sql('text', 80)} as short, replace({preview_sql('text', 80)}, '|', '\\|') as cell from documents")
def text_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.preview("text", 80).alias("short"), fn.escape_table(fn.preview("text", 80)).alias("cell"))


_TT = strip_sql(newlines_sql("preview_text"))


@query(f"select preview_id, case when length({_TT}) > 200 then regexp_replace(substring({_TT}, 1, 200), '{W}+$', '') || '...' else {_TT} end as text, length({_TT}) > 200 as truncated from file_previews")
def truncated_previews(spark, d):
    return table(spark, d, "file_previews").select("preview_id", fn.truncate("preview_text", 200).alias("t")).select("preview_id", "t.text", "t.truncated")


@query(f"select parent_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split({newlines_sql('content')}, chr(10)), lambda x: regexp_replace(x, '{W}+$', '')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') as text from parent_docs")
def paragraphs(spark, d):
    return table(spark, d, "parent_docs").select("parent_id", fn.paragraph("content").alias("text"))


@query("select doc_id, coalesce(nullif(regexp_replace(regexp_replace(translate(lower(file_path), ' ./\\', '____'), '[^a-z0-9_-]', '', 'g'), '^_+|_+$', '', 'g'), ''), 'single_pdf') as slug from documents")
def slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.slugify("file_path").alias("slug"))


@query(f"select section_id, {_NUMBERED.format(t=collapse_sql('title'))} as level, least(greatest(try_cast(nullif(regexp_extract('Heading ' || level, '(?i)^heading\\s*(\\d{{1,4}})\\s*$', 1), '') as int), 1), 6) as style from pdf_sections")
def title_levels(spark, d):
    return table(spark, d, "pdf_sections").select("section_id", fn.numbered_level("title").alias("level"), fn.style_level(F.concat(F.lit("Heading "), F.col("level").cast("string"))).alias("style"))


@query("select event_id, strftime(ts, '%H:%M:%S.') || lpad(cast(epoch_us(ts) // 1000 % 1000 as varchar), 3, '0') as clock, case when value * 20 < 1000 then cast(floor(value * 20 + 0.5) as bigint) || 'ms' else cast(floor(value * 20 / 10 + 0.5) / 100 as decimal(18, 2)) || 's' end as took from events")
def clock_display(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", fn.clock(F.unix_millis(F.col("ts").cast("timestamp"))).alias("clock"), fn.duration_display(F.col("value") * 20).alias("took"))


@query("select event_id, case when event_id % 4 = 0 then false when event_id % 4 = 1 then true when event_id % 4 = 2 then false else true end as ok from events")
def payloads_ok(spark, d):
    raw = F.when(F.col("event_id") % 4 == 0, '{"ok": false}').when(F.col("event_id") % 4 == 1, F.col("props")).when(F.col("event_id") % 4 == 2, "not json").otherwise('{"ok": true}')
    return table(spark, d, "events").select("event_id", fn.payload_ok(raw).alias("ok"))


@query("select event_id, 'invalid_argument' as error_type, event_type as message, event_type as user_hint, false as ok from events")
def error_payloads(spark, d):
    made = table(spark, d, "events").select("event_id", fn.error_payload(F.lit("invalid_argument"), F.col("event_type")).alias("p"))
    get = lambda k: F.get_json_object("p", f"$.{k}").alias(k)
    return made.select("event_id", get("error_type"), get("message"), get("user_hint"), F.get_json_object("p", "$.ok").cast("boolean").alias("ok"))


@query("select draft_id, coalesce(array_to_string(list_filter(texts, lambda x: coalesce(x, '') <> ''), chr(10)), '') as joined from pdf_drafts")
def flattened_blocks(spark, d):
    blocks = F.transform("texts", lambda x: F.struct(F.lit("text").alias("type"), x.alias("text")))
    return table(spark, d, "pdf_drafts").select("draft_id", fn.flatten_blocks(F.concat(blocks, F.array(F.struct(F.lit("reasoning").alias("type"), F.lit("thought").alias("text"))))).alias("joined"))


@query("select scan_id, case when scan_id % 3 = 0 then '/home/u/Desktop' when scan_id % 3 = 1 then root_dir end as path from scan_results")
def resolved_folders(spark, d):
    value = F.when(F.col("scan_id") % 3 == 0, " 桌面").when(F.col("scan_id") % 3 == 1, F.col("root_dir")).otherwise("")
    return table(spark, d, "scan_results").select("scan_id", fn.resolve_folder(value, "/home/u").alias("path"))


# state of clients

@query(f"with {SNAPSHOTS} select client, source, seq, len(results) as count from latest")
def candidates_latest(spark, d):
    return registry.latest_candidates(fx.snapshots(spark, d)).select("client", "source", "seq", F.size("results").alias("count"))


@query(f"""with {SNAPSHOTS} select c.client, s.source, l.results is not null as has_candidates, coalesce(len(l.results), 0) as count from (select distinct client from snaps) c
 join (values ('search_files'), ('list_folder_contents')) s(source) on true left join latest l on l.client = c.client and l.source = s.source""")
def candidates_current(spark, d):
    events = fx.snapshots(spark, d)
    return registry.current_candidates(registry.latest_candidates(events), events)


@query("select scan_id, modified[cast(scan_id % 5 as int)] as candidate from scan_results where scan_id % 5 > 0 union all select scan_id, null from scan_results where scan_id % 5 = 0")
def candidate_lookup(spark, d):
    return table(spark, d, "scan_results").select("scan_id", registry.candidate_at(F.col("modified"), (F.col("scan_id") % 5).cast("int")).alias("candidate"))


@query(f"with {SNAPSHOTS} select client, count(*) as sources, sum(len(results))::bigint as items from latest group by 1")
def cleared_counts(spark, d):
    return registry.cleared_counts(registry.latest_candidates(fx.snapshots(spark, d)))


@query("""with p as (select props->>'$.k' as token, user_id as client, ts as created from events where event_type = 'signup'), l as (select token, arg_max(client, created) as client, max(created) as created from p group by 1),
 c as (select e.props->>'$.k' as token, e.user_id as client, ts as used, event_id as seq from events e where event_type = 'purchase') select token, client, seq from (select c.token, c.client, seq, row_number() over (partition by c.token order by used, seq) as k from c join l on l.token = c.token and l.client = c.client
 where used >= created and used <= created + interval 864000 second) where k = 1""")
def consumed_once(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.get_json_object("props", "$.k").alias("token"))
    prepared = e.where("event_type = 'signup'").select("token", F.col("user_id").alias("client"), F.col("ts").alias("created"))
    uses = e.where("event_type = 'purchase'").select("token", F.col("user_id").alias("client"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return registry.consumed(prepared, uses, 864_000)


@query("with h as (select user_id as thread_id, string_agg(event_type, ',' order by event_id) as messages from events where value > 10 group by 1) select * from h")
def thread_histories(spark, d):
    runs = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("message"), (F.col("value") > 10).alias("ok"))
    return registry.histories(runs).select("thread_id", F.array_join("messages", ",").alias("messages"))


@query("select scan_id, array_to_string(modified[3:], ',') as rest from scan_results where modified is not null")
def new_messages(spark, d):
    return table(spark, d, "scan_results").where("modified is not null").select("scan_id", F.array_join(registry.new_since(F.col("modified"), F.lit(2)), ",").alias("rest"))


@query("select scan_id, least(len(modified), 2) as files, case when len(modified) >= 2 then 1 when len(modified) = 1 then 2 else 3 end as errors from scan_results where modified is not null")
def prepared_sends(spark, d):
    results = F.transform("modified", lambda p: F.struct(p.alias("path"), F.lit(False).alias("is_dir")))
    made = registry.prepare_send(F.array(F.lit(1), F.lit(2), F.lit(1), F.lit(0)), results)
    return table(spark, d, "scan_results").where("modified is not null").select("scan_id", F.size(made["files"]).alias("files"), F.size(made["errors"]).alias("errors"))


# conversations and runs

@query(f"with {MESSAGES} select thread_id, idx, turn::bigint as turn, current from turned")
def turn_segments(spark, d):
    return msg.turns(fx.messages(spark, d)).select("thread_id", "idx", "turn", "current")


@query(f"with {MESSAGES} select thread_id, count_if(current and role = 'tool')::bigint as calls, count_if(current and role = 'tool') >= 10 as over_limit from turned group by 1")
def tool_limit(spark, d):
    return msg.tool_calls_in_turn(fx.messages(spark, d))


@query(f"with {MESSAGES} select thread_id, idx, case when current then reasoning end as reasoning from turned")
def strip_reasoning(spark, d):
    return msg.strip_reasoning(fx.messages(spark, d)).select("thread_id", "idx", "reasoning")


@query(f"with {MESSAGES} select thread_id, idx, sum(case when has_calls then 1 else 0 end) over (partition by thread_id order by idx rows unbounded preceding)::bigint as round_index from messages")
def tool_rounds(spark, d):
    return msg.rounds(fx.messages(spark, d)).select("thread_id", "idx", "round_index")


@query(f"""with {RUN_EVENTS}, r as (select thread_id, call_id, arg_max(value, seq) as result from run_events where type = 'tool_result' group by 1, 2) select c.thread_id, c.call_id, c.seq, coalesce(cast(result as varchar), 'no result') as result from run_events c left join r using (thread_id, call_id) where type = 'tool_call'""")
def tool_traces(spark, d):
    e = fx.run_events(spark, d)
    calls = e.where("type = 'tool_call'").select("thread_id", "call_id", "seq")
    results = e.where("type = 'tool_result'").select("thread_id", "call_id", "seq", F.col("value").cast("string").alias("result"))
    return msg.tool_traces(calls, results)


@query(f"""with {RUN_EVENTS}, r as (select thread_id, call_id, arg_min(ts, seq) as done from run_events where type = 'tool_result' and ts is not null group by 1, 2) select c.thread_id, c.call_id, c.seq, case when done is not null then greatest(0, done - ts) end as duration_ms, done is null as running from run_events c left join r using (thread_id, call_id) where type = 'tool_call'""")
def tool_latency(spark, d):
    return msg.tool_latency(fx.run_events(spark, d))


@query(f"""with {RUN_EVENTS}, f as (select *, case when type like '%\\_delta' escape '\\' and lag(type) over (partition by thread_id order by seq) = type then 0 else 1 end as fresh from run_events), i as (select *, sum(fresh) over (partition by thread_id order by seq rows unbounded preceding) as island from f)
 select thread_id, min(seq) as first_seq, min(type) as type, count(*) as n, sum(length(text))::bigint as chars, arg_min(ts, seq) as start_ts, arg_max(ts, seq) as end_ts from i group by thread_id, island""")
def delta_collapse(spark, d):
    return msg.collapse_deltas(fx.run_events(spark, d))


@query(f"with {RUN_EVENTS} select thread_id, type, call_id, min(seq) as seq from run_events where type in ('tool_call', 'tool_result') group by all")
def event_dedup(spark, d):
    return msg.dedup_calls(fx.run_events(spark, d)).select("thread_id", "type", "call_id", "seq")


@query(f"""with {RUN_EVENTS}, e as (select seq, type, case when seq % 2 = 0 then 'prepare_send' else 'search_files' end as tool, value > 20 as ok from run_events) select seq, 0 as part, type, null::int as expires_in from e
 union all select seq, 1, 'interrupt', 300 from e where type = 'tool_result' and tool = 'prepare_send' and ok""")
def interrupts(spark, d):
    e = fx.run_events(spark, d).select("seq", "type", F.when(F.col("seq") % 2 == 0, "prepare_send").otherwise("search_files").alias("tool"), (F.col("value") > 20).alias("ok"), F.lit("t").alias("token"))
    return msg.with_interrupts(e).select("seq", "part", "type", "expires_in")


@query(f"""with {RUN_EVENTS}, t as (select thread_id || ':' || seq % 31 as thread_id, case seq % 97 when 0 then 'error' when 1 then 'rejected' when 2 then 'sent' when 3 then 'confirmed' when 4 then 'message_error' else 'x' end as type from run_events), g as (select thread_id, bool_or(type = 'error') e, bool_or(type = 'rejected') r, bool_or(type = 'sent') s, bool_or(type = 'confirmed') c, bool_or(type = 'message_error') m from t group by 1)
 select thread_id, case when e then 'error' when r and s then 'error' when r then 'rejected' when c or s then 'confirmed' when m then 'error' else 'not_executed' end as status from g""")
def resolution_status(spark, d):
    kinds = F.create_map(*[x for k, v in enumerate(("error", "rejected", "sent", "confirmed", "message_error")) for x in (F.lit(k), F.lit(v))])
    return msg.resolution_status(fx.run_events(spark, d).select(F.concat("thread_id", F.lit(":"), F.col("seq") % 31).alias("thread_id"), F.coalesce(kinds[(F.col("seq") % 97).cast("int")], F.lit("x")).alias("type")))


@query(f"with {MESSAGES}, l as (select thread_id, arg_max(tool, idx) as tool, arg_max(ok, idx) as ok, arg_max(token, idx) as token from turned where current and role = 'tool' group by 1) select thread_id, token from l where tool = 'prepare_send' and ok")
def pending_sends(spark, d):
    return msg.pending_last_send(fx.messages(spark, d))


@query(f"with {MESSAGES} select thread_id, idx, coalesce(max(case when resolved then 1 else 0 end) over (partition by thread_id, turn order by idx rows between unbounded preceding and 1 preceding) = 1, false) as hidden from turned")
def hidden_debug(spark, d):
    return msg.hidden_debug(fx.messages(spark, d)).select("thread_id", "idx", "hidden")


@query(f"with {MESSAGES} select thread_id, max(case when role = 'assistant' then idx end) as idx, coalesce(arg_max(content, idx) filter (role = 'assistant'), '') as reply from messages group by 1")
def last_replies(spark, d):
    return msg.last_reply(fx.messages(spark, d))


@query(f"""with {RUN_EVENTS} select thread_id, coalesce(string_agg(text, '' order by seq) filter (type = 'assistant_delta'), '') as text, count_if(type = 'tool_call')::bigint as tool_count, arg_max(value, seq) as usage, arg_max(type, seq) as last_type from run_events group by 1""")
def conversation_state(spark, d):
    return msg.reduce_threads(fx.run_events(spark, d).withColumn("usage", F.col("value"))).select("thread_id", "text", "tool_count", "usage", "last_type")


@query("""select user_id as message_id, cast(event_id % 3 as int) as index, 'c' || max(event_id) as id, string_agg(event_type, '' order by event_id) as name, string_agg(props, '' order by event_id) as args from events group by 1, 2""")
def assembled_calls(spark, d):
    parts = table(spark, d, "events").select(F.col("user_id").alias("message_id"), (F.col("event_id") % 3).cast("int").alias("index"), F.col("event_id").alias("seq"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("name"), F.col("props").alias("args"))
    return msg.assembled_calls(parts)


@query(f"""with e as (select user_id as thread_id, event_id as seq, event_type as message_id, event_id % 7 = 0 as last from events), f as (select *, case when lag(message_id) over w = message_id and not lag(last) over w then 0 else 1 end as fresh from e window w as (partition by thread_id order by seq)),
 n as (select *, sum(fresh) over (partition by thread_id order by seq rows unbounded preceding)::bigint as message_no from f) select thread_id, message_no, min(message_id) as message_id, count(*) as n, bool_or(last) as closed from n group by 1, 2""")
def message_bounds(spark, d):
    return msg.message_bounds(table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("message_id"), (F.col("event_id") % 7 == 0).alias("last")))


@query("select doc_id, text as merged from documents where text is not null")
def stream_delta(spark, d):
    """Texts as streams of three parts, each of which repeats up to 200 signs of what came before."""
    n = F.length("text")
    part = lambda a, b: F.substring("text", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    one, two = F.floor(n / 3), F.floor(2 * n / 3)
    back = lambda at: F.greatest(at - 200, F.lit(0))
    parts = F.array(part(F.lit(0), one), part(back(one), two), part(back(two), n))
    return table(spark, d, "documents").where("text is not null").select("doc_id", msg.merged_stream(parts).alias("merged"))


@query(f"with {RUN_EVENTS} select seq, case when type in ('tool_call', 'tool_result') then text when type like '%\\_delta' escape '\\' then length(text) || ' chars' else text end as detail from run_events")
def event_details(spark, d):
    return fx.run_events(spark, d).select("seq", msg.event_detail(F.col("type"), F.col("text"), F.col("text"), F.col("text")).alias("detail"))


@query(f"with {RUN_EVENTS} select 'tools' as view, count(*) as n from run_events where type in ('tool_call', 'tool_result') union all select 'flow', count(*) from run_events where type = 'error' union all select 'all', count(*) from run_events")
def timeline_views(spark, d):
    e = fx.run_events(spark, d)
    one = lambda v: msg.timeline_view(e, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("view"), "n")
    return one("tools").unionByName(one("flow")).unionByName(one("all"))


@query("select scan_id, case when status is not null then status when kb_name <> '' then kb_name else 'default' end as key from scan_results")
def client_keys(spark, d):
    return table(spark, d, "scan_results").select("scan_id", msg.client_key(F.concat(F.lit(" "), "status", F.lit(" ")), F.col("kb_name")).alias("key"))


@query("select event_id, case event_id % 3 when 0 then event_type when 1 then 'hint' else 'the interrupted run failed' end as message from events")
def resume_errors(spark, d):
    payload = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("message")))).when(F.col("event_id") % 3 == 1, '{"message": " ", "user_hint": "hint"}').otherwise("{}")
    return table(spark, d, "events").select("event_id", msg.resume_error(payload, "the interrupted run failed").alias("message"))


@query("select event_id, case event_id % 3 when 0 then (props->>'$.k') || ' results' when 1 then 'error: bad' else 'ok' end as summary from events")
def tool_summaries(spark, d):
    tool = F.when(F.col("event_id") % 3 == 0, "search_files").otherwise("other")
    payload = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.get_json_object("props", "$.k").alias("count")))).when(F.col("event_id") % 3 == 1, '{"ok": false, "message": "bad"}').otherwise("{}")
    return table(spark, d, "events").select("event_id", msg.summary_of(tool, payload).alias("summary"))


@query("select user_id, 'agent' as node, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as pos, event_type as message from events")
def completed_messages(spark, d):
    held = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("m"))
    nodes = held.select(F.col("user_id").alias("run_id"), F.map_from_arrays(F.array(F.lit("agent"), F.lit("__start__")), F.array("m", "m")).alias("nodes"))
    return msg.flatten_nodes(nodes).withColumnRenamed("run_id", "user_id")


@query("select user_id, event_id as id, event_type as type, value from events")
def sse_round_trip(spark, d):
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), "value"))
    day = F.date_trunc("hour", "ts")
    streams = table(spark, d, "events").groupBy("user_id", day.alias("hour")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", frames.frame(payload).alias("f")))), lambda x: x["f"]), "").alias("text"))
    broken = streams.withColumn("text", F.concat("text", F.lit("data: {bad\n\n: comment\n\n")))
    return frames.parse_frames(broken, "text", "id long, type string, value double", "user_id").select("user_id", "id", "type", "value")


@query("select date_trunc('hour', ts) as start, event_type as type, count(*) as n, round(avg(value), 6) as mean_value from events group by 1, 2")
def latency_windows(spark, d):
    from docmill.streaming import state

    rows = table(spark, d, "events").select(F.col("ts").alias("at"), F.col("event_type").alias("type"), "value")
    return state.latency_windows(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "type", "n", F.round("mean_value", 6).alias("mean_value"))


@query("select draft_id, coalesce(array_to_string(list_filter(texts, lambda x: coalesce(x, '') <> ''), chr(10)), '') as text, array_to_string(list_filter(list_prepend('seen', title_hierarchy), lambda x: coalesce(x, '') <> ''), chr(10)) as reasoning from pdf_drafts")
def ai_contents(spark, d):
    part = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text")))
    made = table(spark, d, "pdf_drafts").select("draft_id", msg.ai_content(F.concat(part("title_hierarchy", "thinking"), part("texts", "output_text")), F.lit("seen")).alias("c"))
    return made.select("draft_id", "c.text", "c.reasoning")


@query(f"""with {RUN_EVENTS}, r as (select thread_id, call_id, arg_max(value, seq) as result from run_events where type = 'tool_result' group by 1, 2) select e.thread_id, e.seq, e.call_id as id, cast(result as varchar) as result from run_events e left join r using (thread_id, call_id) where e.type = 'tool_call'""")
def patched_tools(spark, d):
    e = fx.run_events(spark, d)
    held = e.where("type = 'tool_call'").select("thread_id", "seq", F.array(F.struct(F.col("call_id").alias("id"))).alias("tools"))
    results = e.where("type = 'tool_result'").select("thread_id", "call_id", "seq", F.col("value").cast("string").alias("result"))
    return msg.with_tool_results(held, results, "seq").select("thread_id", "seq", F.col("tools")[0]["id"].alias("id"), F.col("tools")[0]["result"].alias("result"))


_RUNS = "k as (select user_id as thread_id, event_id as seq, case event_type when 'view' then 'message_start' when 'purchase' then 'interrupt' when 'signup' then 'run_finished' else 'other' end as type, 't' || event_id as token from events)"


@query(f"""with {_RUNS}, n as (select *, coalesce(sum(case when type = 'run_finished' then 1 else 0 end) over (partition by thread_id order by seq rows between unbounded preceding and 1 preceding), 0) as run,
 max(case when type = 'message_start' then seq end) over (partition by thread_id order by seq rows between unbounded preceding and 1 preceding) as message_seq from k),
 t as (select *, max(case when type = 'interrupt' then seq end) over (partition by thread_id, run order by seq rows between unbounded preceding and 1 preceding) as i from n) select thread_id, seq as finished_seq, message_seq, 't' || i as token from t where type = 'run_finished' and i is not null""")
def attached_interrupts(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("view", "message_start", "purchase", "interrupt", "signup", "run_finished")])
    rows = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), F.coalesce(kind[F.col("event_type")], F.lit("other")).alias("type"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"))
    return msg.pending_interrupts(rows)


@query("select event_id, value > 25 or (event_id % 2 = 0 and event_id % 3 <> 0) or (event_id % 5 = 0 and not (event_id % 7 = 0 and event_id % 4 = 0)) as shown from events")
def visible_messages(spark, d):
    n = F.col("event_id")
    flags = msg.visible(F.when(F.col("value") > 25, "text"), F.when(n % 2 == 0, "thought"), F.array().cast("array<string>"), F.when(n % 5 == 0, "i"), F.when(n % 4 == 0, "pending"), n % 7 == 0, n % 3 == 0)
    return table(spark, d, "events").select("event_id", flags.alias("shown"))


@query("""with k as (select user_id as thread_id, event_id as seq, case event_type when 'signup' then 'interrupt_resolved' when 'purchase' then 'error' else 'x' end as type, case when event_id % 2 = 0 then 'confirmed' else 'error' end as status, case when event_id % 3 = 0 then '' else props end as message from events),
 g as (select thread_id, arg_max(status, seq) filter (type = 'interrupt_resolved') as s, arg_max(message, seq) filter (type = 'interrupt_resolved') as m, arg_max(message, seq) filter (type = 'error') as e from k group by 1)
 select thread_id, coalesce(s in ('confirmed', 'rejected'), false) as ok, case when not coalesce(s in ('confirmed', 'rejected'), false) then coalesce(nullif(m, ''), nullif(e, ''), 'none') end as error from g""")
def stream_outcomes(spark, d):
    kind = F.create_map(*[F.lit(x) for x in ("signup", "interrupt_resolved", "purchase", "error")])
    rows = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("seq"), F.coalesce(kind[F.col("event_type")], F.lit("x")).alias("type"), F.when(F.col("event_id") % 2 == 0, "confirmed").otherwise("error").alias("status"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("message"))
    return msg.stream_outcome(rows, "none")


@query("select event_type as name, count(*) as n from events where event_type <> 'clear_client_state' group by 1")
def offered_tools(spark, d):
    return msg.offered(table(spark, d, "events").select(F.col("event_type").alias("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("""select scan_id, case when status = 'success' then 'hits ' || n_files || ' | keyword=' || kb_name || ' | path=' || root_dir || coalesce(array_to_string(list_transform(modified[:3], lambda x: chr(10) || '- ' || regexp_extract(x, '([^/]+)$', 1) || chr(10) || '  ' || x), ''), '') else 'failed[' || coalesce(status, 'unknown') || ']: ' || kb_name end as shown from scan_results""")
def result_texts(spark, d):
    results = F.transform(F.coalesce("modified", F.array().cast("array<string>")), lambda x: F.struct(F.regexp_extract(x, "([^/]+)$", 1).alias("name"), x.alias("full_path")))
    good = F.to_json(F.struct(F.lit(True).alias("ok"), F.col("n_files").alias("count"), F.col("kb_name").alias("keyword"), F.col("root_dir").alias("path"), results.alias("results")))
    bad = F.to_json(F.struct(F.lit(False).alias("ok"), F.coalesce("status", F.lit("unknown")).alias("error_type"), F.col("kb_name").alias("message")))
    return table(spark, d, "scan_results").select("scan_id", msg.result_lines(F.when(F.col("status") == "success", good).otherwise(bad)).alias("shown"))


@query("select scan_id, cast(i - 1 as int) as pos, path, 'sent' as status from (select scan_id, unnest(modified) as path, generate_subscripts(modified, 1) as i from scan_results)")
def confirmed_files(spark, d):
    sent = table(spark, d, "scan_results").select(F.col("scan_id").alias("token"), F.col("modified").alias("files"))
    return msg.confirmed_files(sent).withColumnRenamed("token", "scan_id")


@query("select scan_id, kb_name as a, coalesce(status, 'none') as b, cast(n_files as varchar) as c from scan_results")
def merged_metadata(spark, d):
    common = F.create_map(F.lit("a"), F.col("kb_name"), F.lit("b"), F.lit("none"))
    extra = F.create_map(F.lit("b"), F.col("status"), F.lit("c"), F.col("n_files").cast("string"))
    m = table(spark, d, "scan_results").select("scan_id", msg.merged_metadata(common, extra).alias("m"))
    return m.select("scan_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


@query("""select record_id, case when record_id % 11 = 0 then 'invalid_argument' when record_id % 7 = 0 then 'candidate_not_found' when mtime is null then 'file_not_found' when record_id % 13 = 0 then 'directory_not_supported' end as reading,
 case when record_id % 11 = 0 then 'invalid_candidate_source' when record_id % 7 = 0 then 'candidate_not_found' when mtime is null then 'directory_not_found' when record_id % 13 <> 0 then 'not_a_directory' end as listing from file_records""")
def guards(spark, d):
    n, exists = F.col("record_id"), F.col("mtime").isNotNull()
    reading = msg.read_guard(n % 11 != 0, F.lit(True), n % 7 != 0, exists, n % 13 == 0, catalog.searchable("path"))
    listing = msg.folder_guard(n % 11 != 0, F.when(n % 7 != 0, n), exists, n % 13 == 0)
    return table(spark, d, "file_records").select("record_id", reading.alias("reading"), listing.alias("listing"))


@query("select scan_id, cast(n_files > 0 as varchar) as b, status as a, (n_files is not null)::int + (status is not null)::int as kept from scan_results")
def sanitized_metadata(spark, d):
    m = F.create_map(F.lit("a"), F.col("status"), F.lit("b"), (F.col("n_files") > 0).cast("string"), F.lit("c"), F.lit(""), F.lit("d"), F.lit(None).cast("string"))
    kept = table(spark, d, "scan_results").select("scan_id", sinks.sanitized(m).alias("m"))
    return kept.select("scan_id", F.col("m")["b"].alias("b"), F.col("m")["a"].alias("a"), F.size("m").alias("kept"))


@query(f"""with {MESSAGES}, l as (select thread_id, arg_max(tool, idx) as tool, arg_max(ok, idx) as ok from turned where current and role = 'tool' group by 1)
 select thread_id, coalesce(arg_max(content, idx) filter (role = 'assistant'), '') as reply, count_if(current and role = 'tool')::bigint as traces, coalesce(bool_or(l.tool = 'prepare_send' and l.ok), false) as needs_confirmation from turned left join l using (thread_id) group by 1""")
def replies_with_traces(spark, d):
    return msg.replies_with_traces(fx.messages(spark, d))


@query("""select event_id, case event_id % 4 when 0 then user_id::varchar else 'c' || (event_id % 5) end as client_id, case event_id % 4 when 1 then user_id when 2 then 0 when 3 then 7 else 0 end::int as sources, case when event_id % 4 = 1 then event_id else 0 end::int as items, 0 as pending from events""")
def clear_results(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    name = F.concat(F.lit("c"), (n % 5).cast("string"))
    good = F.to_json(F.struct(name.alias("client_id"), F.when(n % 4 == 1, F.col("user_id")).when(n % 4 == 3, F.lit(7)).alias("cleared_candidate_source_count"), F.when(n % 4 == 1, n).alias("cleared_candidate_item_count")))
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    blocks = F.when(n % 4 != 0, F.array(block("image", good), block("text", F.lit("no json")), block("text", good), block("text", F.lit("{}"))))
    return e.select("event_id", msg.clear_result(blocks, F.col("user_id").cast("string")).alias("c")).select("event_id", "c.*")


@query("select scan_id, case when status = 'failed' then 'candidate_not_found' when status = 'aborted' then 'invalid_candidate_source' when status is not null then 'invalid_argument' end as error_type from scan_results")
def argument_errors(spark, d):
    message = F.when(F.col("status") == "failed", "未找到对应的候选文件序号，请先重新搜索。").when(F.col("status") == "aborted", "candidate_source 仅支持 search_files 或 list_folder_contents。").when(F.col("status").isNotNull(), F.concat(F.lit("bad "), "kb_name"))
    return table(spark, d, "scan_results").select("scan_id", fn.argument_error(message).alias("error_type"))


@query("select scan_id, '{\"ok\":true,\"current_time\":\"' || strftime(date_trunc('second', started_at), '%Y-%m-%dT%H:%M:%S') || '\",\"timezone\":\"local\"}' as told from scan_results where started_at is not null")
def current_times(spark, d):
    return table(spark, d, "scan_results").where("started_at is not null").select("scan_id", fn.current_time(F.col("started_at")).alias("told"))


# files of known content

_BELOW = "chr(10) || chr(10)"
_TABLE = "'| ' || replace(t, '|', '\\|') || ' |'"


@query(f"""with {OFFICE} select '/o/' || section_id || '.docx' as path, 'docx' as kind, array_to_string(case when t <> '' then list_prepend(case when level is not null then repeat('#', least(greatest(level, 1), 6)::int) || ' ' else '' end || t, b) else b end, {_BELOW}) as text from office
 union all select '/o/' || section_id || '.txt', 'txt', array_to_string(l, chr(10)) from lines""")
def loaded_documents(spark, d):
    """Texts of Word and plain files as they are loaded for indexing."""
    made = office.files(spark, d).where(catalog.suffix_of("path").isin(".docx", ".txt"))
    return sources.load_documents(made).select(F.col("file_path").alias("path"), F.col("doc_type").alias("kind"), "text")


_CUT = "case when length(x) <= 8000 then x else regexp_replace(substring(x, 1, 8000), '[ \\n]+$', '') || '...' end"
_SHEET = "list_prepend(regexp_replace(t || ' | ' || coalesce(level::varchar, ''), '[ |]+$', ''), list_transform(b[:49], lambda y: regexp_replace(y, '[ |]+$', '')))"


@query(f"""with {OFFICE}, raw as (select '/o/' || section_id || '.docx' as path, array_to_string(l, chr(10)) as x, 'paragraph_count' as k, len(l) as n from lines union all select '/o/' || section_id || '.txt', array_to_string(l, chr(10)), 'line_count', len(l) from lines
 union all select '/o/' || section_id || '.pptx', array_to_string(l[:2], {_BELOW}), 'slide_count', len(l) from lines union all select '/o/' || section_id || '.xlsx', regexp_replace('[S]' || chr(10) || array_to_string({_SHEET}, chr(10)), '[ \\n]+$', ''), 'sheet_count', 1 from lines) select path, {_CUT} as shown, n::bigint as n, length(x) > 8000 as truncated from raw""")
def office_previews(spark, d):
    """Previews at the second depth, with a count and whether they are cut."""
    seen = sources.previews(office.files(spark, d), "L2")
    m = F.col("metadata")
    return seen.select("path", F.col("preview_text").alias("shown"), F.coalesce(m["paragraph_count"], m["line_count"], m["slide_count"], m["sheet_count"]).cast("long").alias("n"), m["truncated"].cast("boolean").alias("truncated"))


@query(f"""with {OFFICE} select '/o/' || section_id || '.xlsx' as path, 'S' as sheet_name, least(len(b), 49)::bigint as bodies from office where t <> '' or level is not null or len(b) > 0""")
def loaded_sheets(spark, d):
    """Sheets as they are loaded: the name and the number of table rows below the head, at most 49."""
    loaded = sources.load_documents(office.files(spark, d).where(catalog.suffix_of("path") == ".xlsx")).where("text <> ''")
    return loaded.select(F.col("file_path").alias("path"), "sheet_name", (F.size(F.split("text", "\n")) - 2).cast("long").alias("bodies"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
