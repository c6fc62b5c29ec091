"""Small Office and text files made of the sections of PDF files, so that queries can read binary content of known text."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.functions.text import collapse
from docmill.plans.fixtures import collapse_sql
from docmill.session import table

KINDS = ("docx", "xlsx", "pptx", "txt")
#: The sections as SQL: title, level and filled body texts on one line each.
OFFICE = f"""office as (select section_id, level, coalesce({collapse_sql("title")}, '') as t, list_filter(list_transform(coalesce(body_texts, []), lambda x: {collapse_sql("x")}), lambda x: x is not null and x <> '') as b from pdf_sections),
 lines as (select *, case when t <> '' then list_prepend(t, b) else b end as l from office)"""


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(title: str, level: int | None, bodies: list[str]) -> bytes:
    para = lambda text, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>'
    style = f'<w:style w:styleId="H"><w:name w:val="heading {level}"/></w:style>' if level is not None else ""
    body = para(title, "H" if style else "") + "".join(map(para, bodies)) + para(" ")
    return _zip({"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>', "word/styles.xml": f'<w:styles xmlns:w="urn:w">{style}</w:styles>'})


def xlsx(title: str, level: int | None, bodies: list[str]) -> bytes:
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'
    rows = f'<row r="1">{cell("A1", title)}{f"""<c r="B1"><v>{level}</v></c>""" if level is not None else ""}</row>' + "".join(f'<row r="{i}">{cell(f"A{i}", b)}</row>' for i, b in enumerate(bodies, 2))
    return _zip({"xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})


def pptx(lines: list[str]) -> bytes:
    return _zip({f"ppt/slides/slide{i}.xml": f"<s><p><t>{escape(x)}</t></p></s>" for i, x in enumerate(lines, 1)} or {"ppt/presentation.xml": "<p/>"})


def files(spark: SparkSession, d: str) -> DataFrame:
    """(path, mtime, size, content): one file of each kind for every section."""
    filled = F.filter(F.transform(F.coalesce("body_texts", F.array().cast("array<string>")), lambda x: collapse(x)), lambda x: x.isNotNull() & (x != ""))
    rows = table(spark, d, "pdf_sections").select("section_id", F.col("level").cast("int").alias("level"), F.coalesce(collapse("title"), F.lit("")).alias("title"), filled.alias("bodies"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, level, title, bodies in batch.itertuples(index=False, name=None):
                level, bodies = None if pd.isna(level) else int(level), list(bodies)
                lines = [x for x in [title, *bodies] if x]
                for kind, data in zip(KINDS, (docx(title, level, bodies), xlsx(title, level, bodies), pptx(lines), "\n".join(lines).encode("utf-8", "surrogatepass"))):
                    out.append((f"/o/{n}.{kind}", float(n), len(data), data))
            yield pd.DataFrame(out, columns=["path", "mtime", "size", "content"])

    return rows.mapInPandas(run, "path string, mtime double, size long, content binary")
