import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from docmill.llm import tokens as t

try:
    CODER, SIZES = t.load(t.TOKENIZERS, "byte_bpe_50k")
except (OSError, ImportError):
    pytest.skip("no tokenizer files", allow_module_level=True)

SIGNS = st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "'s", "'ll", "'", "!", "1", "é", "中", "文。", "l", "re", "🙂", "́", "\t", " "]), max_size=60)


def assembled(text, places):
    parts, ids = t.split_document(text, places), []
    for k, (chunk, _, zone, after) in enumerate(parts):
        back = parts[k + 1][1] if k + 1 < len(parts) else 0
        ids += CODER.encode_ordinary(zone or "")
        ids += list(t.trim(np.array(CODER.encode_ordinary(chunk), np.int32), SIZES, after, back))
    return ids


@settings(max_examples=400, deadline=None)
@given(SIGNS, st.sets(st.integers(1, 120), max_size=9))
def test_joins_agree_with_the_whole(parts, places):
    text = "".join(parts)
    assert assembled(text, [(p, False) for p in sorted(places) if p < len(text)]) == CODER.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(SIGNS)
def test_places_behind_letters_need_no_repair(parts):
    text = "".join(parts)
    letter = t.letters()
    for p in range(1, len(text)):
        if letter[ord(text[p - 1])] and not letter[ord(text[p])]:
            assert CODER.encode_ordinary(text[:p]) + CODER.encode_ordinary(text[p:]) == CODER.encode_ordinary(text)


def test_corpus(spark):
    long = ("The same passage stands in many documents. " * 40 + "\n\n") * 3
    digits = "".join(str(i * 7919 % 1000) for i in range(4000))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, long), (4, "x " + long), (5, long), (6, "<|endoftext|>"), (7, "a" * 9000), (8, "重复的文本。" * 400), (9, digits), (10, "no. " + digits), (11, "alone"), (12, "a\ud800b")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, seq int, key string")
    want = {i: CODER.encode_ordinary(t.valid(x or "")) for i, x in rows if i != 12}
    for bits in (t.FILTER_BITS, 64):  # a full filter sends all documents the exact way
        got = [r for r in t.encode_corpus(df.union(df), bits=bits).collect()]
        assert len(got) == len(rows)
        assert {r.doc_id: r.ids for r in got if r.doc_id != 12} == want
    assert t.encode_corpus(df.limit(0)).count() == 0
    counts = {r.doc_id: r.tokens for r in t.token_counts(df, "text").collect() if r.doc_id != 12}
    assert counts == {i: len(x) for i, x in want.items()}


def test_one_id_with_two_texts(spark):
    df = spark.createDataFrame([(1, "one"), (1, "two"), (2, "one")], "doc_id long, text string")
    got = sorted((r.doc_id, r.ids) for r in t.encode_corpus(df).collect())
    assert got == sorted([(1, CODER.encode_ordinary("one")), (1, CODER.encode_ordinary("two")), (2, CODER.encode_ordinary("one"))])


def test_chunks_are_shared():
    body = "".join(f"Sentence number {i} says something of its own. " for i in range(200))
    cut = lambda x: {x[a:b] for a, b in zip([0, *t.chunk_places(x)], [*t.chunk_places(x), len(x)])}
    assert len(cut(body) & cut("A new beginning. " + body)) >= len(cut(body)) - 3
