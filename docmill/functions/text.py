"""Scalar text and display functions as Columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Names under which the usual folders can be given.
FOLDER_ALIASES = {"desktop": "Desktop", "桌面": "Desktop", "downloads": "Downloads", "下载": "Downloads", "documents": "Documents", "文档": "Documents"}
#: Seconds from 1601 to 1970, ticks in a second, and the format of times.
FILETIME_OFFSET, TICKS, TIME_FORMAT = 11_644_473_600, 10_000_000, "yyyy-MM-dd HH:mm:ss"
#: Shapes of numbered headings.
APPENDIX = r"^附录(?:\s*[A-Za-z0-9一二三四五六七八九十]+)?(?:\s+|$)"
CHINESE_TOP = r"^[一二三四五六七八九十]+[、.．]\S+"
DOTTED = r"^([1-9]\d*(?:\.\d+)+)\s+\S+"
#: What is decoration in a Markdown heading, and how much of a text is searched for its headings.
MD_LINK, MD_DECORATION, HEADING_WINDOW, PREFIX_MOST = r"\[([^\]]+)\]\([^)]+\)", r"[#*_`>\[\]()]", 300, 160


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without blanks of any script at both ends. Null stays null."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+$", "")


def collapse(c: Column | str) -> Column:
    """Runs of blanks of any script become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def blank_to_null(c: Column | str) -> Column:
    """Null for null, empty and blank text, else the stripped text."""
    return F.nullif(strip(c), F.lit(""))


def first_filled(*columns: Column | str) -> Column:
    """The first of several texts that isn't blank, stripped."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def size_display(size: Column | str) -> Column:
    """Bytes as B, KB, MB or GB with one decimal, half up: 1048575 gives 1024.0 KB. Null stays null."""
    n = col(size).cast("decimal(38,0)")
    scaled = lambda unit: F.round(n / F.lit(unit).cast("decimal(20,0)"), 1).cast("decimal(38,1)").cast("string")
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024**2, F.concat(scaled(1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(scaled(1024**2), F.lit(" MB")))
        .when(n >= 1024**3, F.concat(scaled(1024**3), F.lit(" GB")))
    )


def filetime_display(ticks: Column | str) -> Column:
    """Windows file time (ticks since 1601) as time of the session's zone; empty for zero and less."""
    t = col(ticks).cast("decimal(20,0)")
    seconds = F.floor(t / F.lit(TICKS).cast("decimal(10,0)")).cast("long") - FILETIME_OFFSET
    return F.when(t <= 0, F.lit("")).otherwise(F.date_format(F.timestamp_seconds(seconds), TIME_FORMAT))


def modified_display(value: Column | str) -> Column:
    """A time given as text: digits are a file time, ISO is formatted, null and blank are empty, anything else stays."""
    v = strip(value)
    iso = F.try_to_timestamp(F.regexp_replace(v, "Z$", "+00:00"))
    digits = v.rlike(r"^\d{1,19}$")
    return (
        F.when(v.isNull() | (v == ""), F.lit(""))
        .when(digits, filetime_display(F.when(digits, v).try_cast("decimal(20,0)")))
        .when(v.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)?)?$") & iso.isNotNull(), F.date_format(iso, TIME_FORMAT))
        .otherwise(v)
    )


def preview(text: Column | str, limit: int) -> Column:
    """One line of `limit` code points at most; three dots where it was cut."""
    one = collapse(text)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit)), F.lit("...")))


def escape_table(text: Column | str) -> Column:
    """Text for a cell of a Markdown table."""
    return F.replace(col(text), F.lit("|"), F.lit("\\|"))


def normalize_newlines(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "\r\n|\r", "\n")


def truncate(text: Column | str, limit: int) -> Column:
    """struct(text, truncated): normalised line ends, stripped, cut to `limit` code points with three dots."""
    t = strip(normalize_newlines(text))
    cut = F.length(t) > limit
    return F.struct(F.when(cut, F.concat(rstrip(F.substring(t, 1, limit)), F.lit("..."))).otherwise(t).alias("text"), cut.alias("truncated"))


def paragraph(text: Column | str) -> Column:
    """Lines without blanks at their ends, runs of empty lines as one, none at both ends."""
    lines = F.transform(F.split(normalize_newlines(text), "\n"), lambda x: rstrip(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def slugify(text: Column | str) -> Column:
    """Lower-case ASCII letters, digits, dashes and underscores; blanks, dots and slashes become underscores, none at the ends."""
    kept = F.regexp_replace(F.translate(F.lower(col(text)), " ./\\", "____"), "[^a-z0-9_-]", "")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+$", ""), F.lit("")), F.lit("single_pdf"))


def resolve_folder(path: Column | str, home: str) -> Column:
    """The folder that an alias stands for, else the path itself. Null and empty give null."""
    p = col(path)
    known = F.create_map(*[F.lit(x) for k, v in FOLDER_ALIASES.items() for x in (k, f"{home}/{v}")])
    return F.coalesce(known[F.lower(strip(p))], F.nullif(p, F.lit("")))


def clean_heading(text: Column | str) -> Column:
    """A heading segment without Markdown links and decoration; blanks and slashes at the ends go."""
    t = F.regexp_replace(F.regexp_replace(col(text), MD_LINK, "$1"), MD_DECORATION, " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^[ /]+|[ /]+$", "")


def heading_key(text: Column | str) -> Column:
    """A heading segment for comparison without case."""
    return F.lower(clean_heading(text))


def trim_prefix(text: Column | str, most: int = PREFIX_MOST) -> Column:
    t = collapse(text)
    return F.when(F.length(t) <= most, t).otherwise(F.regexp_replace(F.substring(t, 1, most), r"[ /]+$", ""))


def embedding_text(text: Column | str, doc_type: Column | str, heading_path: Column | str) -> Column:
    """What is embedded for a chunk: Markdown chunks get the headings that their start doesn't hold; others stay as they are."""
    t, path = col(text), F.coalesce(col(heading_path), F.lit(""))
    start = heading_key(F.substring(t, 1, HEADING_WINDOW))
    segments = F.transform(F.split(F.regexp_replace(path, MD_LINK, "$1"), "/"), lambda x: clean_heading(x))
    missing = F.filter(segments, lambda x: (x != "") & ~F.contains(start, F.lower(x)))
    prefix = trim_prefix(F.array_join(missing, " / "))
    return F.when((col(doc_type) == "md") & (prefix != ""), F.concat(F.lit("章节："), prefix, F.lit("\n\n"), t)).otherwise(t)


def style_level(style: Column | str) -> Column:
    """The level of a style named like "Heading 2", within 1 and 6; null for other styles."""
    n = F.regexp_extract(col(style), r"(?i)^heading\s*(\d{1,4})\s*$", 1)
    return F.when(n != "", F.least(F.greatest(n.try_cast("int"), F.lit(1)), F.lit(6)))


def numbered_level(text: Column | str) -> Column:
    """The level that a heading's number tells: 1 for an appendix or a Chinese numeral, 2 for a.b, 3 for more; else null."""
    t = collapse(text)
    depth = F.length(F.regexp_replace(F.regexp_extract(t, DOTTED, 1), r"[^.]", "")) + 1
    return F.when(t.rlike(APPENDIX) | t.rlike(CHINESE_TOP), 1).when(t.rlike(DOTTED), F.when(depth <= 2, 2).otherwise(3))


def clock(ms: Column | str) -> Column:
    """Epoch milliseconds as HH:mm:ss.SSS."""
    return F.date_format(F.timestamp_millis(col(ms).cast("long")), "HH:mm:ss.SSS")


def duration_display(ms: Column | str) -> Column:
    """Milliseconds below a second, else seconds with two decimals; null stays null."""
    m = col(ms).cast("double")
    return F.when(m < 1000, F.concat(F.floor(m + 0.5).cast("string"), F.lit("ms"))).otherwise(F.concat((F.floor(m / 10 + 0.5) / 100).cast("decimal(18,2)").cast("string"), F.lit("s")))


def flatten_blocks(blocks: Column | str, kind: str = "text", separator: str = "\n") -> Column:
    """The texts of the content blocks (structs of type and text) of one kind, joined; empty where there are none."""
    held = F.filter(F.coalesce(col(blocks), F.array()), lambda b: (b["type"] == kind) & (F.coalesce(b["text"], F.lit("")) != ""))
    return F.array_join(F.transform(held, lambda b: b["text"]), separator)


def payload_ok(raw: Column | str) -> Column:
    """Whether a tool's JSON payload reports success: its ok, true where the key is missing; false where it isn't an object."""
    is_object = F.try_parse_json(raw).isNotNull() & strip(raw).startswith("{")
    value = F.get_json_object(F.when(is_object, col(raw)), "$.ok")
    return F.when(~F.coalesce(is_object, F.lit(False)), False).otherwise(F.coalesce(F.lower(value) != "false", F.lit(True)))


def error_payload(error_type: Column, message: Column, retryable: Column | None = None, user_hint: Column | None = None, operator_hint: Column | None = None) -> Column:
    """The JSON of a failed tool call, with all its fields."""
    empty = F.lit("")
    return F.to_json(F.struct(F.lit(False).alias("ok"), error_type.alias("error_type"), message.alias("message"), message.alias("error"), (retryable if retryable is not None else F.lit(False)).alias("retryable"), (user_hint if user_hint is not None else message).alias("user_hint"), (operator_hint if operator_hint is not None else empty).alias("operator_hint")))


#: Messages of bad arguments and the type of error that each is told as; any other is an invalid argument.
ARGUMENT_ERRORS = {
    "必须提供 file_index 或 file_path。": "invalid_argument",
    "未找到对应的候选文件序号，请先重新搜索。": "candidate_not_found",
    "depth 仅支持 L1、L2、L3。": "invalid_argument",
    "candidate_source 仅支持 search_files 或 list_folder_contents。": "invalid_candidate_source",
}


def argument_error(message: Column | str) -> Column:
    """The type of error of an argument message; null for null."""
    m = col(message)
    known = F.create_map(*[F.lit(x) for pair in ARGUMENT_ERRORS.items() for x in pair])
    return F.when(m.isNotNull(), F.coalesce(known[m], F.lit("invalid_argument")))


def current_time(at: Column | None = None) -> Column:
    """A time, by default that of the query, in the session's time zone as ISO 8601 to the second, as the JSON that a tool returns."""
    now = F.current_timestamp() if at is None else at
    return F.to_json(F.struct(F.lit(True).alias("ok"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("current_time"), F.lit("local").alias("timezone")))
