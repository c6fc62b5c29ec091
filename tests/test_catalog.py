from fnmatch import fnmatchcase

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F
import re

from docmill.operators import catalog as c


@given(st.text(st.sampled_from("ab/.*?"), max_size=8), st.text(st.sampled_from("ab/."), max_size=10))
def test_globs(pattern, path):
    assert bool(re.search(c.glob_regex(pattern), path)) == fnmatchcase(path, pattern)


def test_skip_reasons(spark):
    rows = [("/k/a.md", 1), ("/k/.git/a.md", 1), ("/k/a.PPTX", 1), ("/k/a.exe", 1), ("/k/a.MD", 51 * 1024**2), ("/k/a.md", None), ("/k/noext", 1), (None, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "path string, size long").select(c.skip_reason("path", "size")).collect()]
    assert got == [None, "excluded_by_glob", "pptx_not_supported_in_step1", "unsupported_extension", "size_exceeds_limit", None, "unsupported_extension", "unsupported_extension"]


def test_duplicates(spark):
    paths = ["/a/x.pdf", "/a/x.md", "/a/x.txt", "/b/x.pdf", "/a/y.pdf", "/a/y.xlsx", "/a/z.pdf", "/a/z.docx"]
    got = {r.path: r.duplicate_of for r in c.suppress_duplicates(spark.createDataFrame([(p, 0) for p in paths], "path string, _best int").drop("_best")).collect()}
    assert got == {p: None for p in paths} | {"/a/x.pdf": ".md", "/a/z.pdf": ".docx"}


def test_diff_partitions_the_union(spark):
    cur = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1), ("c", 2.0, 1), ("e", 0.0, 0), (None, 1.0, 1)], "path string, mtime double, size long")
    man = spark.createDataFrame([("b", 1.0, 1), ("c", 1.0, 1), ("d", 1.0, 1), ("e", None, None)], "path string, mtime double, size long")
    assert {r.path: r.status for r in c.diff(cur, man).collect()} == {"a": "added", "b": "unchanged", "c": "modified", "d": "deleted", "e": "unchanged"}
    assert c.diff(cur.limit(0), man.limit(0)).count() == 0


FILES = "name string, path string, size long, is_dir boolean, attributes int"


def test_search_order_and_filters(spark):
    rows = [("v2", "/p", 0, True, 0), ("v2.md", "/p", 5, False, 0), ("my v2 plan.md", "/p", 5, False, 0), ("v2plan.md", "/p", 5, None, 0), ("xv2.md", "/p", 5, False, 0), ("a.v2", "/p", 5, False, 0), ("_v2.md", "/p", 5, False, 0),
            ("v2.md", "/p/node_modules", 5, False, 0), ("v2.tmp", "/p", 5, False, 0), ("v2e.md", "/p", 0, False, 0), ("v2s.md", "/p", 5, False, 4), ("V2.MD", "/p", 5, False, 0), (None, "/p", 5, False, 0), ("v2.md", None, 5, False, 0)]
    got = [r.name for r in c.search(spark.createDataFrame(rows, FILES), " v2 ").orderBy("rank").collect()]
    assert got[0] == "v2" and got[1].lower() == "v2.md" and got[2:] == ["my v2 plan.md", "v2plan.md", "xv2.md", "_v2.md", "a.v2"]
    assert c.search(spark.createDataFrame(rows, FILES), "  ").count() == 0
    assert c.search(spark.createDataFrame([], FILES), "v2").count() == 0
    with pytest.raises(ValueError):
        c.search(spark.createDataFrame([], FILES), "v2", limit=0)
    shown = c.serialized(c.children(spark.createDataFrame(rows, FILES), "/p")).orderBy("index").collect()
    assert shown[0].size is None and shown[0].size_display == "folder"
    assert spark.createDataFrame([(" a　 b ",)], "k string").select(c.clean_keyword("k")).first()[0] == "a b"


def test_scan(spark):
    files = spark.createDataFrame([("/k/a.md", 1.0, 5), ("/k/a.pdf", 1.0, 5), ("/k/b.exe", 1.0, 5)], "path string, mtime double, size long")
    manifest = spark.createDataFrame([("/k/a.md", 2.0, 5), ("/k/old.md", 1.0, 1)], "path string, mtime double, size long")
    assert {(r.path, r.status, r.reason) for r in c.scan(files, manifest).collect()} == {("/k/a.md", "modified", None), ("/k/old.md", "deleted", None), ("/k/a.pdf", "skipped", "duplicate_higher_priority_source:.md"), ("/k/b.exe", "skipped", "unsupported_extension")}
    assert c.is_dir(F.lit(None).cast("boolean"), F.lit(True)) is not None
