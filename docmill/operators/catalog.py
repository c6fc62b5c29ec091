"""The file catalogue: which files count, what changed, which are duplicates, and search by name."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from docmill.functions.text import col, collapse

#: Defaults of a knowledge base.
INCLUDE_EXT = (".md", ".docx", ".pdf", ".xlsx", ".txt")
EXCLUDE_GLOB = ("**/.git/**", "**/node_modules/**", "**/__pycache__/**", "**/dist/**", "**/.vite/**", "**/.venv/**", "**/.idea/**")
#: Folders that are never searched, and names of temporary and system files.
BLOCKED_PARTS = ("$Recycle.Bin", ".cache", ".git", ".ssh", ".aws", ".vscode", "__pycache__", "node_modules", "AppData", "ProgramData", "Program Files", "Program Files (x86)", "System Volume Information", "Windows")
TEMPORARY = r"^(~\$|\.~|\._)|(?i)[^.]\.(tmp|temp|bak|swp)$|(?i)^(thumbs\.db|desktop\.ini|ntuser\.dat)$"
SYSTEM_ATTRIBUTES = 0x4 | 0x100
#: Which format of a document is preferred.
PRIORITY = {".md": 3, ".docx": 2, ".txt": 1}


def glob_regex(pattern: str) -> str:
    """A file-name pattern as a regular expression to be found in a path; * and ? cross slashes.

    Stars at the ends only lift the anchors, and neighbouring stars are one, so matching stays linear in the usual cases.
    """
    out, i = "", 0
    pattern = re.sub(r"\*+", "*", pattern)
    head, tail = "" if pattern.startswith("*") else "^", "" if pattern.endswith("*") else "$"
    pattern = pattern.strip("*") if pattern != "*" else ""
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner).replace("\\", r"\\") + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s){head}{out}{tail}"


def name_of(path: Column | str) -> Column:
    """The part of a path after the last slash or backslash."""
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def suffix_of(path: Column | str) -> Column:
    """The lower-case suffix with its dot, empty if the name has none or begins with its only dot."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^./\\]+)$", 1))


def stem_of(path: Column | str) -> Column:
    """The path without its suffix."""
    p = col(path)
    return F.substring(p, F.lit(1), F.length(p) - F.length(suffix_of(p)))


def excluded(path: Column | str, patterns: Sequence[str] = EXCLUDE_GLOB) -> Column:
    """Whether any of the patterns matches the path in slash notation."""
    p = F.translate(col(path), "\\", "/")
    return reduce(lambda a, b: a | b, [p.rlike(glob_regex(x)) for x in patterns], F.lit(False))


def skip_reason(path: Column | str, size: Column | str, max_mb: int = 50, include: Sequence[str] = INCLUDE_EXT, patterns: Sequence[str] = EXCLUDE_GLOB) -> Column:
    """Why a file isn't indexed, or null. A null size is not over the limit."""
    suffix = suffix_of(path)
    return (
        F.when(excluded(path, patterns), "excluded_by_glob")
        .when(suffix.isin(*[x.lower() for x in include]), F.when(col(size) > max_mb * 1024 * 1024, "size_exceeds_limit"))
        .when(suffix == ".pptx", "pptx_not_supported_in_step1")
        .otherwise("unsupported_extension")
    )


def suppress_duplicates(files: DataFrame, path: str = "path") -> DataFrame:
    """files with `duplicate_of`: for a PDF beside a preferred format of the same folder and stem, that format's suffix; else null.

    One aggregation by stem with two small columns; no file is dropped.
    """
    suffix = suffix_of(path)
    rank = F.coalesce(F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v)])[suffix], F.lit(0))
    best = files.select(stem_of(path).alias("_stem"), rank.alias("_rank"), suffix.alias("_suffix")).where("_rank > 0").groupBy("_stem").agg(F.max(F.struct("_rank", "_suffix"))["_suffix"].alias("_best"))
    joined = files.withColumn("_stem", stem_of(path)).join(best, "_stem", "left")
    return joined.withColumn("duplicate_of", F.when(suffix == ".pdf", F.col("_best"))).drop("_stem", "_best")


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of the union of both: added, modified, unchanged or deleted. Both have path, mtime, size.

    A null mtime or size in the manifest counts as 0. Rows with null path are left out; paths should be unique on each side.
    """
    c = current.where(F.col("path").isNotNull()).select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.lit(True).alias("here"))
    p = manifest.where(F.col("path").isNotNull()).select("path", F.coalesce("mtime", F.lit(0)).alias("pm"), F.coalesce("size", F.lit(0)).alias("ps"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "deleted").when(F.col("m").eqNullSafe(F.col("pm")) & F.col("s").eqNullSafe(F.col("ps")), "unchanged").otherwise("modified")
    return c.join(p, "path", "full_outer").select("path", status.alias("status"))


def scan(files: DataFrame, manifest: DataFrame, max_mb: int = 50, include: Sequence[str] = INCLUDE_EXT, patterns: Sequence[str] = EXCLUDE_GLOB) -> DataFrame:
    """(path, status, reason): every file of a listing or manifest; skipped files have their reason.

    A file that is skipped now and stands in the manifest is skipped and deleted. The listing is read once: duplicates are told
    within each folder and stem, then one full join with the manifest tells the rest. Paths should be unique on each side.
    """
    rows = files.select("path", "mtime", "size", skip_reason("path", "size", max_mb, include, patterns).alias("reason"))
    suffix = suffix_of("path")
    rank = F.coalesce(F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (k, v)])[suffix], F.lit(0))
    best = F.max(F.when(F.col("reason").isNull() & (rank > 0), F.struct(rank.alias("r"), suffix.alias("s")))).over(Window.partitionBy("_stem"))
    rows = rows.withColumn("_stem", F.when(F.col("reason").isNull(), stem_of("path")).otherwise(F.col("path"))).withColumn("_best", best["s"])
    doubled = F.when(F.col("reason").isNull() & (suffix == ".pdf") & F.col("_best").isNotNull(), F.concat(F.lit("duplicate_higher_priority_source:"), "_best"))
    rows = rows.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.coalesce("reason", doubled).alias("reason"), F.lit(True).alias("here"))
    known = manifest.where(F.col("path").isNotNull()).select("path", F.coalesce("mtime", F.lit(0)).alias("pm"), F.coalesce("size", F.lit(0)).alias("ps"), F.lit(True).alias("there"))
    both = rows.join(known, "path", "full_outer")
    one = lambda status, reason=F.lit(None).cast("string"): F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    told = (
        F.when(F.col("here").isNull(), F.array(one("deleted")))
        .when(F.col("reason").isNotNull() & F.col("there").isNotNull(), F.array(one("skipped", F.col("reason")), one("deleted")))
        .when(F.col("reason").isNotNull(), F.array(one("skipped", F.col("reason"))))
        .when(F.col("path").isNull(), F.array().cast("array<struct<status:string,reason:string>>"))
        .when(F.col("there").isNull(), F.array(one("added")))
        .when(F.col("m").eqNullSafe(F.col("pm")) & F.col("s").eqNullSafe(F.col("ps")), F.array(one("unchanged")))
        .otherwise(F.array(one("modified")))
    )
    return both.select("path", F.explode(told).alias("t")).select("path", "t.status", "t.reason")


def searchable(path: Column | str, attributes: Column | None = None) -> Column:
    """Whether a full path may be found: in no blocked folder, no temporary or system name, no such attribute."""
    parts = F.split(col(path), r"[/\\]")
    ok = ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in BLOCKED_PARTS])) & ~name_of(path).rlike(TEMPORARY)
    return ok if attributes is None else ok & (F.coalesce(attributes, F.lit(0)).bitwiseAND(F.lit(SYSTEM_ATTRIBUTES)) == 0)


def is_dir(*flags: Column) -> Column:
    """The first flag that is known, else false."""
    return F.coalesce(*flags, F.lit(False))


def search_score(name: Column, directory: Column, keyword: str) -> Column:
    """How well a name fits the keyword: exact, whole word, prefix, within the stem, within the name; folders first, hidden names last."""
    q = keyword.lower().strip()
    low = F.lower(name)
    stem = F.when(directory, low).otherwise(F.lower(stem_of(name)))
    base = (
        F.when((stem == q) | (low == q), 5000)
        .when(stem.rlike(r"(?<![0-9a-z_])" + re.escape(q) + r"(?![0-9a-z_])"), 3000)
        .when(stem.startswith(q), 2000)
        .when(F.contains(stem, F.lit(q)), 1000)
        .when(F.contains(low, F.lit(q)), 500)
        .otherwise(0)
    )
    return base + F.when(directory, 300).otherwise(0) - F.when(low.rlike(r"^(_|\.|~\$)"), 400).otherwise(0)


def simple_short(keyword: str) -> bool:
    """Short keywords of plain signs get exact recall besides the usual one."""
    return bool(re.fullmatch(r"[A-Za-z0-9._-]{1,8}", keyword.strip()))


def search(files: DataFrame, keyword: str, scope: str | None = None, limit: int = 20, recall: int | None = None) -> DataFrame:
    """The `limit` best files for a keyword, as rank, name, path, size, is_dir, full_path, score.

    files has name, path (the folder), size, is_dir and may have attributes. The recall branches are one predicate each and
    are told apart by `branch`; of rows with equal full path (without case) the first branch, then name, counts. Nothing is
    cut before ranking unless `recall` asks for the bounded recall of each branch. Ties end with the full path. Rows without
    name or path and empty files are left out. A blank keyword finds nothing; limit must be positive.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    word = " ".join(keyword.split())
    q, directory = word.lower(), is_dir(F.col("is_dir"))
    rows = files.where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != ""))
    if scope:
        base = scope.rstrip("/\\")
        rows = rows.where(F.col("path").startswith(base + "/") | F.col("path").startswith(base + "\\") | (F.col("path") == base))
    full = F.concat(F.regexp_replace("path", r"[/\\]$", ""), F.lit("/"), "name")
    size = F.when(directory, F.lit(0)).otherwise(F.coalesce(F.col("size"), F.lit(0)))
    rows = rows.select("name", "path", size.cast("long").alias("size"), directory.alias("is_dir"), full.alias("full_path"), *(["attributes"] if "attributes" in files.columns else []))
    rows = rows.where((F.col("is_dir") | (F.col("size") != 0)) & searchable("full_path", F.col("attributes") if "attributes" in files.columns else None))
    low = F.lower("name")
    whole = low.rlike(r"(?<![0-9a-z_])" + re.escape(q) + r"(?![0-9a-z_])")
    branches = [F.contains(low, F.lit(q)) if q else F.lit(False)]
    if simple_short(word):
        branches = [F.col("is_dir") & (low == q), F.col("is_dir") & whole, whole, *branches]
    branch = reduce(lambda c, ib: c.when(ib[1], ib[0]), list(enumerate(branches))[1:], F.when(branches[0], 0))
    hits = rows.withColumn("branch", branch).where(F.col("branch").isNotNull())
    if recall:
        hits = hits.withColumn("_n", F.row_number().over(Window.partitionBy("branch").orderBy("name", "full_path"))).where(F.col("_n") <= recall).drop("_n")
    first = Window.partitionBy(F.lower("full_path")).orderBy("branch", "name", "full_path")
    hits = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "branch")
    return ranked(hits, search_score(F.col("name"), F.col("is_dir"), word), limit)


def ranked(hits: DataFrame, score: Column, limit: int) -> DataFrame:
    """The best `limit` rows by score, length of stem, depth, length of path, name; with their rank."""
    stem = F.when(F.col("is_dir"), F.lower("name")).otherwise(F.lower(stem_of("name")))
    depth = F.length(F.regexp_replace("full_path", r"[^/\\]", ""))
    keys = [F.desc("score"), "_stem", "_depth", F.length("full_path"), F.lower("name"), "full_path"]
    best = hits.withColumn("score", score).withColumn("_stem", F.length(stem)).withColumn("_depth", depth).orderBy(*keys).limit(limit)
    one = Window.partitionBy(F.lit(0)).orderBy(*keys)  # `limit` rows
    return best.withColumn("rank", F.row_number().over(one)).select("rank", "name", "path", "size", "is_dir", "full_path", "score")


def children(files: DataFrame, folder: str | DataFrame, limit: int = 30) -> DataFrame:
    """The files and folders directly in a folder, folders first, then in the order of a search. The folder is a path, or a table of one row with it as `path`."""
    full = F.concat("path", F.lit("/"), "name")
    directory = is_dir(F.col("is_dir"))
    size = F.when(directory, F.lit(0)).otherwise(F.coalesce("size", F.lit(0))).cast("long")
    rows = files.where(F.col("path") == folder.rstrip("/\\")) if isinstance(folder, str) else files.join(F.broadcast(folder.select(F.regexp_replace("path", r"[/\\]+$", "").alias("path")).limit(1)), "path", "left_semi")
    rows = rows.select("name", "path", size.alias("size"), directory.alias("is_dir"), full.alias("full_path"))
    rows = rows.where((F.col("is_dir") | (F.col("size") != 0)) & (F.coalesce("name", F.lit("")) != "") & searchable("full_path"))
    low = F.lower("name").rlike(r"^(_|\.|~\$)")
    return ranked(rows, F.when(F.col("is_dir"), 300).otherwise(0) - F.when(low, 400).otherwise(0), limit)


def serialized(found: DataFrame) -> DataFrame:
    """Search results for display: folders have no size and read "folder"."""
    from docmill.functions.text import size_display

    return found.select(F.col("rank").alias("index"), "name", "full_path", F.when(~F.col("is_dir"), F.col("size")).alias("size"), F.when(F.col("is_dir"), "folder").otherwise(size_display("size")).alias("size_display"), "is_dir")


def scan_summary(scanned: DataFrame) -> DataFrame:
    """Files of each status."""
    return scanned.groupBy("status").agg(F.count("*").alias("n"))


def clean_keyword(keyword: Column | str) -> Column:
    return collapse(keyword)
