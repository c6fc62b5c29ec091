import random

from hypothesis import given, settings, strategies as st

from docmill.llm import splitting as s


def check(text, limit, overlap):
    spans = s.pieces(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert b - a <= limit
    for (_, b), (c, _) in zip(spans, spans[1:]):
        assert b - c == overlap
    return spans


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab c.\n。中文👩‍👧é́\r"), max_size=900))
def test_sizes_and_overlap(text):
    check(text, 120, 20)


def test_texts_without_boundaries_and_with_marks():
    check("x" * 10_001, 2000, 200)
    check("e" + "́" * 7000, 2000, 200)
    check("👩‍👧‍👦" * 1500, 2000, 200)


def sentences(n, seed):
    rng = random.Random(seed)
    return " ".join(" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(9)).capitalize() + "." for _ in range(n))


def test_cuts_fall_between_sentences():
    text = sentences(300, 1)
    for cut in s.cuts(text):
        assert text[cut - 2 : cut] == ". " or text[cut - 1] == " "


def test_an_edit_changes_only_pieces_near_it():
    text = sentences(600, 2)
    edited = text[:9000] + " Something quite new was written here. " + text[9000:]
    a = {text[x:y] for x, y in s.pieces(text)}
    b = {edited[x:y] for x, y in s.pieces(edited)}
    assert len(b - a) <= 5 and len(a & b) >= len(a) - 5


def test_split_oversized(spark):
    long = sentences(80, 3)
    rows = [("a", long, 1), ("a", long, 1), ("b", None, 2), ("c", "", 3), ("d", "short", 4), (None, long, 5)]
    df = spark.createDataFrame(rows, "item string, text string, piece_no int")
    out = s.split_oversized(df, ["item"], "text").collect()
    assert {r.item for r in out} == {"a", None}
    n = len(s.pieces(long))
    assert len(out) == 3 * n and all(len(r.piece) <= 2000 for r in out)
    assert s.split_oversized(df.limit(0), ["item"], "text").count() == 0


def test_joined(spark):
    df = spark.createDataFrame([([None, "", "a", "b"],), (None,), ([],)], "parts array<string>")
    assert [r[0] for r in df.select(s.joined("parts")).collect()] == ["a\n\nb", None, ""]
