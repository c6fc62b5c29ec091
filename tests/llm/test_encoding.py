import numpy as np
import pandas as pd
import pytest

from docmill.llm import encoding as e

RUSSIAN = ["Сначала второй тайм, потом пенальти, затем снова второй тайм.", "Просьба подтвердить, что ничего не пропало до закрытия отчёта.", "Кто хранит копию, пока неясно, но страница заменяет прошлогоднюю версию.", "Тема сравнивалась с темой до закрытия журнала, осталось десять дней.", "Предыстория открытых вопросов лежит в папке с понедельника."]
LATIN = ["Zoë Brandeck asked why the café was closed.", "Der Punkt wurde für die nächste Fassung geprüft, später mehr.", "Le résumé a été déplacé à l’été.", "“Leave it as it is,” said Renée — and we did."]
CHINESE = ["关于登录服务，目前共有条记录；编译器尚未整理。", "请在周五之前确认没有遗漏。其他事项没有定论，会议到此结束。"]


def frame(spark):
    rows = [("t", f"ok{i}", x) for i, x in enumerate((RUSSIAN + LATIN + CHINESE) * 12)]
    bad = {
        "utf8-1252": LATIN[1].encode().decode("cp1252"), "utf8-latin": LATIN[0].encode().decode("latin-1"), "utf8-mac": LATIN[2].encode().decode("mac_roman"),
        "utf8-gbk": CHINESE[1].encode().decode("gb18030", "replace"), "1251-1252": RUSSIAN[2].encode("cp1251").decode("cp1252"), "koi-1251": RUSSIAN[0].encode("koi8_r").decode("cp1251"),
        "gbk-1252": CHINESE[0].encode("gb18030").decode("latin-1"), "lost": "Ren�e asked", "kun": "锟斤拷锟斤拷", "twice": LATIN[0].encode().decode("cp1252").encode().decode("cp1252"),
    }
    rows += [("t", k, v) for k, v in bad.items()]
    rows += [("t", "none", None), ("t", "empty", ""), ("t", "signs", "© § ¶ ° ±0.5 µm √2"), ("t", "tree", "├── scans\n│   └── notes"), ("t", "pt", "As MAÇÃS e a LIÇÃO"), ("t", "mixed", "Тhе сору оf thе nоtе")]
    return spark.createDataFrame([(*r, 1) for r in rows], "tbl string, rec_id string, text string, swap int"), set(bad)


def test_finds_and_restores(spark):
    df, bad = frame(spark)
    assert {r.rec_id for r in e.garbled(df, ["tbl", "rec_id"]).collect()} == bad
    fixed = {r.rec_id: r for r in e.repaired(df, ["tbl", "rec_id"]).collect()}
    assert fixed["utf8-1252"].restored == LATIN[1] and fixed["twice"].restored == LATIN[0]
    assert fixed["koi-1251"].restored == RUSSIAN[0] and fixed["gbk-1252"].restored == CHINESE[0]
    assert fixed["lost"].lost and not fixed["utf8-mac"].lost


def test_empty(spark):
    df = spark.createDataFrame([], "tbl string, rec_id string, text string")
    assert e.garbled(df, ["tbl", "rec_id"]).count() == 0 and e.repaired(df, ["tbl", "rec_id"]).count() == 0


def test_learning_corrects_a_wrong_table():
    """Text in a page that differs from the table by two letters: bigrams tell."""
    text = " ".join(RUSSIAN * 60).lower()
    counts = np.zeros(e.BUCKETS)
    codes = e.fold(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    np.add.at(counts, e.bigram_buckets(codes), 1)
    model = e.Bigrams(counts, len(text))
    swapped = text.translate(str.maketrans("ое", "ео")).encode("koi8_r", "ignore").decode("cp1251")
    pairs = pd.Series(list(zip(swapped, swapped[1:]))).value_counts()
    table = pd.DataFrame({"x": [a for a, _ in pairs.index], "y": [b for _, b in pairs.index], "n": pairs.to_numpy()})
    learned = e.learn_letters(table, "koi8_r>cp1251", model)
    letters = dict(zip(learned.sign, learned.letter))
    plain = swapped.translate({ord(a): b for a, b in letters.items()})
    right = sum(a == b for a, b in zip(plain, text)) / len(text)
    table_alone = sum(a == b for a, b in zip(swapped.encode("cp1251").decode("koi8_r"), text)) / len(text)
    assert table_alone < 0.85 and right > 0.92


@pytest.mark.parametrize("name", e.SEEN_AS)
def test_shapes_decode(name):
    _, _, shape = e.shapes(name)
    seen = "".join(e.page(name)[b] for b in "é“中".encode())
    assert shape.fullmatch(seen) and seen.translate(e.to_bytes(name)).encode("latin-1").decode() == "é“中"


def distinct_texts(n):
    """Russian texts, no two alike."""
    rng = np.random.default_rng(5)
    words = [w for x in RUSSIAN for w in x.rstrip(".").lower().split()]
    return [" ".join(rng.choice(words, 14)).capitalize() + "." for _ in range(n)]


@pytest.mark.parametrize("seen", ["1251", "utf8"])
@pytest.mark.parametrize("source", ["copies", "many"])
def test_frequent_damage_is_found(spark, source, seen):
    """One garbled text copied to a third of all rows; damage of two fifths of the Russian volume, no text twice."""
    garble = lambda x: x.encode("koi8_r").decode("cp1251") if seen == "1251" else x.encode().decode("latin-1")
    fine, bad = distinct_texts(100), distinct_texts(170)[100:140] if source == "many" else [RUSSIAN[0]] * 70
    rows = [("t", f"ok{i}", x) for i, x in enumerate(fine + LATIN * 8)] + [("t", f"bad{i}", garble(x)) for i, x in enumerate(bad)]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string")
    assert {r.rec_id for r in e.garbled(df, ["tbl", "rec_id"]).collect()} == {f"bad{i}" for i in range(len(bad))}


def test_one_garbled_line_among_many_pieces_in_order(spark):
    """What is unusual but in order beside a garbled line does not acquit the record."""
    codes = lambda x: e.fold(np.frombuffer(x.encode("utf-32-le"), np.uint32))
    odd = " ".join(RUSSIAN).upper()  # capitals are rare in the corpus
    model = e.Bigrams(100.0 * e.tally(codes(" ".join(RUSSIAN))) + 60 * np.minimum(e.tally(codes(odd)), 1), 1_000_000)
    line = RUSSIAN[0].encode("koi8_r").decode("cp1251")
    df = spark.createDataFrame([("t", "bad", "\n".join([line, *[odd] * 8])), ("t", "ok", odd)], "tbl string, rec_id string, text string")
    got = [r for r in e.suspects(df, ["tbl", "rec_id"], "text", model).collect() if r.swap == "koi8_r>cp1251"]
    assert {r.rec_id for r in got if r.gain > 0} == {"bad"}


def test_a_mixed_word_leaves_the_rest_of_its_text(spark):
    line = RUSSIAN[0].encode("koi8_r").decode("cp1251")
    rows = [("t", f"ok{i}", x) for i, x in enumerate(distinct_texts(100))] + [("t", "both", f"Тhе сору\n{line}"), ("t", "bad", line), ("t", "mixed", "Тhе сору оf thе nоtе")]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string")
    assert {r.rec_id for r in e.garbled(df, ["tbl", "rec_id"]).collect()} == {"both", "bad"}
