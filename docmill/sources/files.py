"""Files as rows: catalogues, text, Markdown, Word, Excel and PowerPoint documents, image headers. Only the standard library is needed.

Listing never reads content: the columns of `catalogue` come from the file system alone.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.operators.catalog import name_of, suffix_of

#: Suffixes of text and image files, rows, slides and signs of the preview depths, rows of a sheet that are indexed.
TEXT_SUFFIXES, IMAGE_SUFFIXES = (".csv", ".json", ".log", ".md", ".py", ".txt", ".yaml", ".yml"), (".bmp", ".gif", ".jpeg", ".jpg", ".png", ".webp")
DEPTHS = {"L1": (4000, 10, 1), "L2": (8000, 50, 2), "L3": (12000, 100, 3)}
SHEET_ROWS = 50
MAX_XML = 256 * 1024 * 1024


def depth_limits(depth: str) -> tuple[int, int, int]:
    """(signs, rows, pages) of a preview depth."""
    try:
        return DEPTHS[depth.strip().upper()]
    except KeyError:
        raise ValueError("depth must be L1, L2 or L3") from None


def check_root(spark: SparkSession, root: str) -> None:
    """Fails unless root is a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise FileNotFoundError(f"no such folder: {root}")


def binary_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """path, mtime (epoch seconds), size, content of all files below root; the listing is pruned by suffix before content is read."""
    check_root(spark, root)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "%20", " ")
    rows = rows.select(path.alias("path"), F.unix_micros("modificationTime").cast("double").alias("us"), F.col("length").alias("size"), "content")
    rows = rows.select("path", (F.col("us") / 1e6).alias("mtime"), "size", "content")
    return rows.where(suffix_of("path").isin(*suffixes)) if suffixes else rows


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, size of all files below root; content isn't read."""
    return binary_files(spark, root).drop("content")


# One file's bytes to rows


def decode_text(data: bytes) -> str:
    """UTF-8 (a byte order mark stays), else GBK; ValueError if neither fits."""
    for name in ("utf-8", "gbk"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor GBK")


def _part(data: bytes, name: str) -> ElementTree.Element | None:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if name not in z.namelist():
            return None
        if z.getinfo(name).file_size > MAX_XML:
            raise ValueError(f"{name} is too large")
        return ElementTree.fromstring(z.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _words(e: ElementTree.Element) -> str:
    """The text of the runs below an element; tabs and breaks as such."""
    return "".join(x.text or "" if _local(x) == "t" else "\t" if _local(x) == "tab" and x.text is None and not x.attrib else "\n" if _local(x) in ("br", "cr") else "" for x in e.iter())


def markdown_table(rows: list[list[str]]) -> str:
    """Rows with any value as a Markdown table, the first as its head; cells on one line."""
    rows = [[" ".join(c.split()) for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])])


def docx_parts(data: bytes) -> tuple[list[tuple[str, str]], list[list[list[str]]]]:
    """(style, text) of each paragraph of the body, and the cells of each table."""
    root, styles = _part(data, "word/document.xml"), _part(data, "word/styles.xml")
    names = {}
    for s in [] if styles is None else styles:
        if _local(s) == "style":
            names[_attribute(s, "styleId")] = next((_attribute(n, "val") for n in s if _local(n) == "name"), "") or ""
    paragraphs, tables = [], []
    body = next((e for e in ([] if root is None else root) if _local(e) == "body"), [])
    for e in body:
        if _local(e) == "p":
            style = next((_attribute(x, "val") for x in e.iter() if _local(x) == "pStyle"), "") or ""
            paragraphs.append((names.get(style) or style, _words(e)))
        elif _local(e) == "tbl":
            tables.append([["\n".join(_words(p) for p in c if _local(p) == "p") for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"])
    return paragraphs, tables


def docx_text(data: bytes) -> str:
    """Paragraphs with headings as #, then all tables, with empty lines between."""
    paragraphs, tables = docx_parts(data)
    out = []
    for style, text in paragraphs:
        if text.strip():
            m = re.fullmatch(r"heading\s*(\d+)", style.strip(), re.I)
            out.append(("#" * min(max(int(m[1]), 1), 6) + " " if m else "") + text.strip())
    return "\n\n".join([*out, *filter(None, map(markdown_table, tables))])


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx_sheets(data: bytes, limit: int) -> list[tuple[str, list[list[str]]]]:
    """(name, cells) of each sheet: the first `limit` physical rows."""
    book, links = _part(data, "xl/workbook.xml"), _part(data, "xl/_rels/workbook.xml.rels")
    shared = _part(data, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in ([] if shared is None else shared)]
    target = {r.get("Id"): r.get("Target", "") for r in ([] if links is None else links)}
    out = []
    for sheet in book.iter() if book is not None else []:
        if _local(sheet) != "sheet":
            continue
        ref = target.get(_attribute(sheet, "id"), "")
        page = _part(data, ref.lstrip("/") if ref.startswith("/") else f"xl/{ref}")
        rows: list[list[str]] = []
        for row in (r for r in page.iter() if _local(r) == "row") if page is not None else ():
            at = int(row.get("r") or len(rows) + 1)
            if at > limit:
                break
            rows += [[] for _ in range(at - 1 - len(rows))]
            cells: list[str] = []
            for c in row:
                i = _column(c.get("r") or "") if c.get("r") else len(cells)
                value = next((x for x in c if _local(x) in ("v", "is")), None)
                text = "" if value is None else "".join(t.text or "" for t in value.iter() if _local(t) in ("v", "t"))
                if c.get("t") == "s" and text.isdigit() and int(text) < len(strings):
                    text = strings[int(text)]
                cells += [""] * (i - len(cells)) + [text]
            rows.append(cells)
        out.append((sheet.get("name") or "", rows))
    return out


def pptx_slides(data: bytes) -> list[str]:
    """The text of each slide, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
    out = []
    for n in names:
        page = _part(data, n)
        out.append("\n".join(t for p in page.iter() if _local(p) == "p" and (t := _words(p).strip())))
    return out


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from the header of a PNG, GIF, BMP, JPEG or WebP image."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "PNG", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "GIF", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "BMP", w, abs(h)
    if data[:4] == b"RIFF" and data[8:15] == b"WEBPVP8" and len(data) >= 30:
        if data[15:16] == b"X":
            return "WEBP", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[15:16] == b"L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return "WEBP", *(x & 0x3FFF for x in struct.unpack("<HH", data[26:30]))
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
        elif 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return "JPEG", w, h
        else:
            at += 2 + (0 if data[at + 1] == 0xFF or 0xD0 <= data[at + 1] <= 0xD9 else struct.unpack(">H", data[at + 2 : at + 4])[0])
    return None


def is_blank_image(low: int, high: int, tolerance: int = 2) -> bool:
    """Whether grey values between low and high are all but black or all but white."""
    return high - low <= tolerance and (high <= tolerance or low >= 255 - tolerance)


DOCUMENT = "file_path string, doc_type string, doc_no long, text string, sheet_name string, page_number int, heading_path string, section_title string, mtime double, error string"


def load_documents(files: DataFrame) -> DataFrame:
    """Documents of files (path, mtime, content), by suffix: Markdown and text one each, Word one, Excel one a sheet.

    A file that can't be read gives one row without text and with the error; unknown suffixes give a row with that error.
    PDF goes by text blocks (docmill.sources.pdf and docmill.operators.structure). Null content is an error. Row by row, no shuffle.
    """

    def one(path: str, data: bytes | None) -> list[tuple]:
        suffix = "." + path.rpartition(".")[2].lower()
        if data is None:
            raise ValueError("no content")
        data = bytes(data)
        if suffix == ".md":
            return [("md", data.decode("utf-8"), None)]
        if suffix == ".txt":
            return [("txt", decode_text(data), None)]
        if suffix == ".docx":
            return [("docx", docx_text(data), None)]
        if suffix == ".xlsx":
            return [("xlsx", markdown_table(rows), name) for name, rows in xlsx_sheets(data, SHEET_ROWS)]
        raise ValueError(f"unsupported suffix {suffix}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DOCUMENT.split(", ")]
        for batch in batches:
            rows = []
            for path, mtime, data in batch.itertuples(index=False, name=None):
                try:
                    rows += [(path, kind, i, text, sheet, None, None, None, mtime, None) for i, (kind, text, sheet) in enumerate(one(path, data))]
                except Exception as error:  # noqa: BLE001 - one bad file must not end the scan
                    rows.append((path, None, 0, None, None, None, None, None, mtime, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "mtime", "content").mapInPandas(run, DOCUMENT)


class PreviewError(Exception):
    """Why a readable file has nothing to show: empty_file, no_pages or blank_pages."""


PREVIEW = "path string, file_type string, preview_text string, metadata map<string,string>, error_type string"


def previews(files: DataFrame, depth: str = "L1") -> DataFrame:
    """(path, file_type, preview_text, metadata, error_type): what a file shows at a depth; errors are a column, never an exception.

    files has path, size, content. Text is decoded as UTF-8 with replacement; counts are of the whole text. Images give
    their format and size, PDF files the text of their first pages. Unknown suffixes are unsupported.
    """
    signs, row_limit, slide_limit = depth_limits(depth)

    def cut(text: str) -> tuple[str, bool]:
        text = text.replace("\r\n", "\n").replace("\r", "\n").strip()
        return (text, False) if len(text) <= signs else (text[:signs].rstrip() + "...", True)

    def one(suffix: str, data: bytes) -> tuple[str, dict]:
        if suffix in TEXT_SUFFIXES:
            raw = data.decode("utf-8", "replace")
            text, short = cut(raw)
            return text, {"line_count": len(raw.splitlines()), "char_count": len(raw), "truncated": short}
        if suffix == ".docx":
            parts = [t.strip() for _, t in docx_parts(data)[0] if t.strip()]
            text, short = cut("\n".join(parts))
            return text, {"paragraph_count": len(parts), "char_count": sum(map(len, parts)), "truncated": short}
        if suffix == ".xlsx":
            sheets = xlsx_sheets(data, row_limit)
            text, short = cut("\n\n".join("\n".join([f"[{n}]", *(" | ".join(r).rstrip(" |") for r in rows)]) for n, rows in sheets))
            return text, {"sheet_count": len(sheets), "sheet_names": ", ".join(n for n, _ in sheets), "truncated": short}
        if suffix == ".pptx":
            slides = pptx_slides(data)
            text, short = cut("\n\n".join(slides[:slide_limit]))
            return text, {"slide_count": len(slides), "preview_slides": min(len(slides), slide_limit), "truncated": short}
        if suffix == ".pdf":
            from docmill.sources.pdf import page_texts

            if not data:
                raise PreviewError("empty_file")
            count, pages = page_texts(data, slide_limit)
            if not count:
                raise PreviewError("no_pages")
            text, short = cut("\n\n".join(pages))
            if not text:
                raise PreviewError("blank_pages")
            return text, {"page_count": count, "preview_pages": len(pages), "preview_mode": "text", "truncated": short}
        if suffix in IMAGE_SUFFIXES:
            seen = image_size(data)
            if not seen:
                raise ValueError("unreadable image")
            return "", {"format": seen[0], "width": seen[1], "height": seen[2], "preview_mode": "metadata"}
        raise LookupError(suffix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in batch.itertuples(index=False, name=None):
                suffix = "." + path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
                try:
                    text, meta = one(suffix, bytes(data or b""))
                    rows.append((path, suffix.lstrip("."), text, {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in meta.items()}, None))
                except PreviewError as error:
                    rows.append((path, suffix.lstrip("."), None, None, str(error)))
                except LookupError:
                    rows.append((path, None, None, None, "unsupported_file_type"))
                except Exception:  # noqa: BLE001
                    rows.append((path, suffix.lstrip("."), None, None, "read_failed"))
            yield pd.DataFrame(rows, columns=["path", "file_type", "preview_text", "metadata", "error_type"])

    return files.select("path", "content").mapInPandas(run, PREVIEW)


def common_metadata(files: DataFrame) -> DataFrame:
    """path, name, size, size_display, modified of a catalogue."""
    from docmill.functions.text import TIME_FORMAT, size_display

    return files.select("path", name_of("path").alias("name"), "size", size_display("size").alias("size_display"), F.date_format(F.timestamp_seconds("mtime"), TIME_FORMAT).alias("modified"))


