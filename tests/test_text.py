import pytest
from pyspark.sql import functions as F

from docmill.functions import text as t
from docmill.operators import cleaning as c, messages as m


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, shown", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1075, "1.0 KB"), (1076, "1.1 KB"), (1_048_575, "1024.0 KB"), (1_048_576, "1.0 MB"), (5 * 1024**3, "5.0 GB"), (None, None)])
def test_size_display(spark, value, shown):
    assert one(spark, t.size_display, value, "long") == shown


@pytest.mark.parametrize("value, shown", [(None, ""), ("  ", ""), ("0", ""), ("116444736000000000", ""), ("132000000000000000", "2019-04-17 18:40:00"), ("2024-05-06T07:08:09Z", "2024-05-06 07:08:09"), ("2024-05-06", "2024-05-06 00:00:00"), ("yesterday", "yesterday")])
def test_modified_display(spark, value, shown):
    got = one(spark, t.modified_display, value)
    assert got == (shown if value != "116444736000000000" else "1970-01-01 00:00:00")


def test_previews_and_paragraphs(spark):
    assert one(spark, lambda x: t.preview(x, 5), " a b　c  defg ") == "a b c..."
    assert one(spark, lambda x: t.preview(x, 5), None) is None
    cut = one(spark, lambda x: t.truncate(x, 4), " ab\r\ncd ef")
    assert (cut.text, cut.truncated) == ("ab\nc...", True)
    assert one(spark, t.paragraph, "a  \n\n \n\nb\t") == "a\n\nb"
    assert one(spark, t.slugify, "My File/v1.2 (ü)") == "my_file_v1_2_" .strip("_") and one(spark, t.slugify, "ü") == "single_pdf"
    assert one(spark, t.escape_table, "a|b") == "a\\|b"


def test_levels(spark):
    assert [one(spark, t.numbered_level, x) for x in ("附录 A 表", "一、总则", "1.2 Scope", "1.2.3 Deep", "1. Not dotted", None)] == [1, 1, 2, 3, None, None]
    assert [one(spark, t.style_level, x) for x in ("Heading 2", "heading9", "Title", None)] == [2, 6, None, None]


def test_embedding_text(spark):
    rows = spark.createDataFrame([("md", "Guide / [Setup](a.md)", "text on Guide"), ("md", "Guide", "GUIDE"), ("md", None, "x"), ("txt", "Guide", "x")], "k string, p string, c string")
    got = [r[0] for r in rows.select(t.embedding_text("c", "k", "p")).collect()]
    assert got == ["章节：Setup\n\ntext on Guide", "GUIDE", "x", "x"]


def test_payloads(spark):
    assert [one(spark, t.payload_ok, x) for x in ('{"a": 1}', '{"ok": false}', "[1]", "bad", None, "")] == [True, False, False, False, False, False]


def test_cleaning(spark):
    assert one(spark, c.normalize, "　a\r\n\r\n\r\n\rb ") == "a\n\nb"
    text = "a​ ![x](u(1)2) b\n[TOC]\n***\n- \n```\n![k](v)\n---\n```\n<img src=x>c ![bad](open"
    assert one(spark, c.strip_markdown_noise, text) == "a  b\n```\n![k](v)\n---\n```\nc ![bad](open"
    assert c.without_images("![a](b)![c](d(e)f)x![") == "x!["
    pages = spark.createDataFrame([("f", "Head\nbody\n3", 1), ("f", "Head\nother\nPage 12", 2), ("g", "Head\nalone", 1), ("h", None, 1)], "file string, text string, clean int")
    assert {r.text: r.clean for r in c.strip_page_noise(pages.drop("clean"), "file", "text").collect()}["Head\nbody\n3"] == "body"
    assert c.repeated_edges(pages.limit(0), "file", "text").count() == 0


@pytest.mark.parametrize("before, incoming, added", [("hel", "lo", "o"), ("abc", "abcdef", "def"), ("abc", "xyz", "xyz"), ("", "a", "a"), ("ab", "", "")])
def test_new_part(spark, before, incoming, added):
    df = spark.createDataFrame([(before, incoming)], "a string, b string")
    assert df.select(m.new_part(F.col("a"), F.col("b"))).first()[0] == added


def test_overlap_is_capped(spark):
    df = spark.createDataFrame([("x" * 50 + "y" * 250, "y" * 250 + "z")], "a string, b string")
    assert df.select(m.new_part(F.col("a"), F.col("b"))).first()[0] == "y" * 50 + "z"
    assert df.select(m.new_part(F.col("a"), F.col("b"), None)).first()[0] == "z"
