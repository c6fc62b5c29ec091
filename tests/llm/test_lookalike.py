from docmill.llm import lookalike as l

R = l.Rewriter({"a": 10, "e": 10, "о": 1, " ": 9, "中": 1, "目": 5})


def same(a, b):
    return R.skeleton(a) == R.skeleton(b)


def test_what_looks_the_same():
    assert same("Renée", "Renée") and same("ＡＢ１２", "AB12") and same("сору", "copy")
    assert same("a\u00a0b", "a b") and same("a\u3000b", "a\u202fb") and same("a​b﻿", "ab") and same("⽬前", "目前")
    assert same("Τhe Νote", "The Note") and same("line\r\nnext", "line\nnext") and same("ﬁn", "fin") and same("ё", "ë")


def test_what_does_not():
    for a, b in (("e", "é"), ("a", "A"), ("2", "²"), ("2", "②"), ("a  b", "a b"), ("l", "1"), ("a\tb", "a b"), ("ab", "a b")):
        assert not same(a, b), (a, b)
    assert not same("👩‍👧", "👩👧")  # a joiner that makes one picture


def test_display_keeps_scripts():
    for text in ("Сначала сорок", "The copy", "目前 Renée", "👩‍👧 ok"):
        assert R.display(R.skeleton(text)) == text
    assert R.display(R.skeleton("Τhe сору")) == "The copy"


def test_pairs(spark):
    rows = [("t", "1", "a\u00a0b"), ("t", "2", "a b"), ("t", "3", "a\u00a0b"), ("t", "3", "a\u00a0b"), ("t", "4", None), ("t", "5", ""), ("t", "6", " "), ("t", "7", "​"), ("u", "8", "a​ b"), ("t", "9", "x" * 50_000), ("t", "10", "х" + "x" * 49_999)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "tbl string, rec_id string, text string, look_key string")
    unified = l.unify(df, ["tbl", "rec_id"], "text")
    assert unified.count() == len(rows)
    pairs = {tuple(r) for r in l.same_look_pairs(unified, "tbl", "rec_id").collect()}
    assert pairs == {("t", "1", "2"), ("t", "2", "3"), ("t", "10", "9")}
    assert l.unify(df.limit(0), ["tbl", "rec_id"], "text").count() == 0


def test_private_signs_stay_themselves():
    r = l.Rewriter({})
    family = "\U0001F468\u200d\U0001F469"
    assert r.display(r.skeleton(family + "\U000f0000\U000f0001")) == family + "\U000f0000\U000f0001"
    assert r.skeleton(family) != r.skeleton("\U0001F468\U0001F469") and r.skeleton("a\u200db") == "ab"


def test_a_third_of_all_rows_and_three_variants(spark):
    rows = [("t", f"{i:06d}", "caf\u00e9 au lait", 1) for i in range(100_000)] + [("t", "x", "cafe\u0301 au lait", 2), ("t", "y", "caf\u00e9\u00a0au lait", 3), ("t", "z", "cafe\u0301 au lait", 4), ("u", "z", "cafe\u0301 au lait", 4)]
    unified = l.unify(spark.createDataFrame(rows, "tbl string, rec_id string, text string, size long"), ["tbl", "rec_id"], "text", with_text=False).cache()
    pairs = l.same_look_pairs(unified, "tbl", "rec_id")
    assert pairs.count() == 300_000 + 2 and pairs.where("tbl = 'u'").count() == 0
    assert set(map(tuple, pairs.where("a_id in ('x', 'y', 'z') and b_id in ('x', 'y', 'z')").select("a_id", "b_id").collect())) == {("x", "y"), ("y", "z")}
    links = {r.rec_id: (r.size, r.links) for r in l.look_members(unified, "tbl", "rec_id").where("tbl = 't' and rec_id in ('000000', 'x', 'y')").collect()}
    assert links == {"000000": (100_003, 3), "x": (100_003, 100_001), "y": (100_003, 100_002)}
