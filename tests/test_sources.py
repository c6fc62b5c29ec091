import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from docmill.operators import embedding
from docmill.plans import index
from docmill.sources import files as f, frames, sinks

W = 'xmlns:w="urn:w"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") , text)
    return out.getvalue()


def docx():
    p = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return zipped(**{"word/document.xml": f"<w:document {W}><w:body>{p('H1', 'Title')}{table}{p('x', 'Body')}{p('x', ' ')}</w:body></w:document>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 2"/></w:style></w:styles>'})


def xlsx():
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>in</t></is></c></row><row r="60"><c r="A60"><v>9</v></c></row></sheetData></worksheet>'
    return zipped(**{"xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>head</t></si></sst>"})


def pdf(*pages, compress=False):
    """A small PDF; each page is a list of (size, x, y, text)."""
    import zlib

    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))), len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, page in enumerate(pages):
        body = b"BT\n" + b"".join(b"/F1 %d Tf 1 0 0 1 %d %d Tm (%s) Tj\n" % (size, x, y, text.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)")) for size, x, y, text in page) + b"ET"
        packed = zlib.compress(body) if compress else body
        objects += [b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i), b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(packed), b" /Filter /FlateDecode" if compress else b"", packed)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>\n"


PAGES = [[(20, 50, 700, "The Great Title"), (12, 50, 640, "1.1 Scope"), (10, 50, 600, "The body tells (of) cafés"), (10, 50, 588, "and goes on.")], [(12, 50, 700, "2.1 Terms"), (10, 50, 660, "More body.")]]


@pytest.mark.parametrize("compress", [False, True])
def test_pdf_blocks(spark, compress):
    from docmill.sources import pdf as p

    df = spark.createDataFrame([("/a.pdf", bytearray(pdf(*PAGES, compress=compress))), ("/b.pdf", bytearray(b"%PDF-1.4 broken")), ("/c.pdf", None)], "path string, content binary")
    rows = p.blocks(df).collect()
    got = [(r.page_number, r.text, r.max_font_size, r.line_count) for r in rows if r.file == "/a.pdf"]
    assert got == [(1, "The Great Title", 20.0, 1), (1, "1.1 Scope", 12.0, 1), (1, "The body tells (of) cafés\nand goes on.", 10.0, 2), (2, "2.1 Terms", 12.0, 1), (2, "More body.", 10.0, 1)]
    assert {r.file: r.error for r in rows if r.error} == {"/b.pdf": "no text", "/c.pdf": "ValueError: not a PDF"}
    seen = f.previews(df, "L1").collect()
    assert seen[0].metadata["page_count"] == "2" and seen[0].preview_text.startswith("The Great Title") and seen[2].error_type == "empty_file"


def test_pdf_maps():
    from docmill.sources import pdf as p

    table, width = p.unicode_map(b"2 beginbfchar <0001> <4E2D> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0061> <0062>] endbfrange")
    assert width == 2 and table[b"\0\x01"] == "中" and table[b"\0\x02"] == "fi" and table[b"\0\x12"] == "C" and table[b"\0\x21"] == "b"
    assert p.value(b"<< /A [1 2.5 (x\\051\\)) <414>] /B 3 0 R /C << /D /E#20F >> >>")[0] == {"A": [1, 2.5, b"x))", b"A@"], "B": 3, "C": {"D": "E F"}}
    assert p._unpredict(bytes([2, 1, 2, 2, 1, 1]), 2) == bytes([1, 2, 2, 3])


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20) + b"\x08\0\0\0\0"


@pytest.fixture()
def folder(tmp_path):
    for name, data in {"a.md": b"# Head\n\n" + b"Some words on rivers. " * 30, "b.txt": "中文".encode("gbk"), "c.docx": docx(), "d.xlsx": xlsx(), "bad.docx": b"no zip", "sub/e.txt": b"plain", "x.png": PNG, "y.bin": b"?", "a.pdf": b"%PDF", "p.pdf": pdf(*PAGES, compress=True)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_parsers():
    assert f.docx_text(docx()) == "## Title\n\nBody\n\n| a | b |\n| --- | --- |\n|  | 2 |"
    assert f.xlsx_sheets(xlsx(), 50) == [("S", [["head", "", "7"], [], ["in"]])]
    assert f.markdown_table([["a", "b"], ["", ""], ["c"]]) == "| a | b |\n| --- | --- |\n| c |  |" and f.markdown_table([[""]]) == ""
    assert f.pptx_slides(zipped(**{"ppt/slides/slide10.xml": "<s><p><t>ten</t></p></s>", "ppt/slides/slide2.xml": "<s><p><t>two</t></p></s>"})) == ["two", "ten"]
    assert f.image_size(PNG) == ("PNG", 30, 20) and f.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("GIF", 3, 4) and f.image_size(b"?") is None
    assert f.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x05\x00\x06" + b"\0" * 9) == ("JPEG", 6, 5)
    assert f.decode_text("﻿a".encode()) == "﻿a" and f.is_blank_image(0, 2) and not f.is_blank_image(0, 200)
    with pytest.raises(ValueError):
        f.decode_text(b"\xff\xff\xff")


def test_load_and_preview(spark, folder):
    assert f.catalogue(spark, folder).count() == 10
    docs = {r.file_path.rpartition("/")[2]: r for r in f.load_documents(f.binary_files(spark, folder)).collect()}
    assert docs["b.txt"].text == "中文" and docs["d.xlsx"].sheet_name == "S" and docs["bad.docx"].error and docs["y.bin"].text is None
    seen = {r.path.rpartition("/")[2]: r for r in f.previews(f.binary_files(spark, folder), "l1").collect()}
    assert seen["x.png"].metadata["width"] == "30" and seen["y.bin"].error_type == "unsupported_file_type" and seen["bad.docx"].error_type == "read_failed"
    assert seen["a.md"].metadata["line_count"] == "3"
    with pytest.raises(ValueError):
        f.previews(f.binary_files(spark, folder), "L9")
    with pytest.raises(FileNotFoundError):
        f.catalogue(spark, folder + "/none")


def test_index_round_trip(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("index"))
    kb = index.KnowledgeBase("kb", folder)
    counts = index.build(spark, kb, out)
    assert counts["files"] == 6 and counts["parents"] >= 6 and counts["children"] >= counts["parents"]
    again = index.build(spark, kb, out)
    assert again == counts
    best = index.query(spark, out, ["words on rivers"], 1).first()
    assert "rivers" in best.child_text and best.parent_text.startswith("# Head") and best.score > 0
    with open(folder + "/sub/e.txt", "w") as file:
        file.write("changed words on engines")
    with open(folder + "/new.txt", "w") as file:
        file.write("new words")
    more = index.build(spark, kb, out, incremental=True)
    assert more["files"] == 7 and more["parents"] == counts["parents"] + 1
    full = index.build(spark, kb, str(tmp_path_factory.mktemp("full")))
    assert full == more
    with pytest.raises(ValueError):
        index.build(spark, kb, out, dimension=32, incremental=True)
    wanted = spark.createDataFrame([("none",)], "parent_id string")
    assert sinks.get_parents(spark, index.current(spark, out), wanted).first().content is None
    with pytest.raises(ValueError):
        index.query(spark, out, [" "])


def test_index_versions(spark, folder, tmp_path_factory, monkeypatch):
    """A run that dies changes nothing; unreadable files are told and tried again; children keep what is known of their parents."""
    out = str(tmp_path_factory.mktemp("index"))
    kb = index.KnowledgeBase("kb", folder)
    first = index.build(spark, kb, out)
    at = index.current(spark, out)
    skipped = {r.path.rpartition("/")[2]: r.reason for r in spark.read.json(f"{at}/skipped").collect()}
    assert skipped["bad.docx"].startswith("load_failed: BadZipFile") and skipped["y.bin"] == "unsupported_extension" and skipped["a.pdf"].startswith("duplicate")
    children = {r.file_path.rpartition("/")[2]: r for r in spark.read.parquet(f"{at}/child_chunks").collect()}
    assert children["d.xlsx"].sheet_name == "S" and children["p.pdf"].page_number == 1 and all(c.kb_name == "kb" and c.mtime for c in children.values())
    head = index.json.loads(index.VersionedTarget(spark, out)._commit(1)["head"])
    assert head["stats"] == first and head["embedding_dimension"] == 64 and head["embedding_model"] == "hashed-trigrams"
    with open(folder + "/bad.docx", "wb") as file:
        file.write(docx())
    with open(folder + "/a.md", "a") as file:
        file.write("\nmore words")
    with monkeypatch.context() as m:
        m.setattr(sinks, "write_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.build(spark, kb, out, incremental=True)
    assert index.current(spark, out) == at and index.query(spark, out, ["words on rivers"], 1).count() == 1
    more = index.build(spark, kb, out, incremental=True)
    assert more["files"] == first["files"] + 1
    assert more == index.build(spark, kb, str(tmp_path_factory.mktemp("full")))


def test_heading_prefix_is_embedded(spark, folder, tmp_path_factory):
    seen = []

    class Encoder(embedding.HashingEncoder):
        def __call__(self, texts):
            with open(folder + "/../seen.txt", "a") as file:
                file.writelines(t.split("\n")[0] + "\n" for t in texts)
            return super().__call__(texts)

    (text := "# Head\n\n" + "".join(f"Sentence {i} is about {w}. " for i, w in enumerate(["rivers", "engines", "violins"] * 30)))
    with open(folder + "/a.md", "w") as file:
        file.write(text)
    index.build(spark, index.KnowledgeBase("kb", folder), str(tmp_path_factory.mktemp("index")), Encoder)
    with open(folder + "/../seen.txt") as file:
        seen = file.read().split("\n")
    assert "章节：Head" in seen


def test_reports(spark, tmp_path):
    quality = spark.createDataFrame([(2, 100.0, 1, 0, 5, 30.0, 4, 3, 2)], "parents long, parent_mean double, short_parents long, no_heading long, children long, child_mean double, short_children long, very_short_children long, split_parents long")
    focus = spark.createDataFrame([("/a.md", 2, 5)], "file_path string, parents long, children long")
    hits = spark.createDataFrame([(0, 1, 0.5, "a | b"), (0, 2, 0.25, None), (1, None, None, None)], "query_id int, rank int, score double, preview string")
    text = sinks.evaluation_report(spark, quality, focus, f"file://{tmp_path}/r.md", hits)
    assert (tmp_path / "r.md").read_text() == text and sinks.ADVICE["many_short"] in text and "| short children | 4 (80.0 %) |" in text
    assert "- 1. (0.5000) a \\| b\n- 2. (0.2500) \n## query 1\n- no hits\n" in text


def test_manifest_document(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text('{"kb_name": "k", "embedding_dimension": 8, "skipped": [{"path": "x", "reason": "r"}],\n "files": {"a": {"mtime": 1.5, "size": 2, "parent_ids": ["p"], "child_count": 3}}, "stats": {"files": 1}}')
    assert frames.read_manifest(spark, f"file://{path}").collect() == [("a", 1.5, 2, ["p"], 3)] and frames.read_skipped(spark, f"file://{path}").collect() == [("x", "r")]
    assert frames.read_manifest_document(spark, f"file://{path}").first().embedding_dimension == 8


def test_frames(spark):
    df = spark.createDataFrame([(1, 'data: {"a": 1}\n\ndata: {bad\n\n: note\n\ndata: {"a": 2}\r\n\r\n'), (2, None), (3, "")], "id int, t string")
    assert [(r.id, r.a) for r in frames.parse_frames(df, "t", "a int", "id").orderBy("pos").collect()] == [(1, 1), (1, 2)]
    assert frames.read_manifest(spark, "/nowhere/m.json").count() == 0
    kept = spark.createDataFrame([({"a": "0", "b": "", "c": None},)], "m map<string,string>").select(sinks.sanitized(F.col("m"))).first()[0]
    assert kept == {"a": "0"}
