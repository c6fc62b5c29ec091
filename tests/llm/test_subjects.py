import random

import pandas as pd

from docmill.llm import subjects as s

WORDS = {"law": "court judge contract statute appeal verdict".split(), "sport": "match goal referee league training score".split(), "music": "violin chord opera melody rehearsal choir".split()}


def sentence(rng, subject):
    if subject is None:
        return rng.choice(["Nothing else was decided.", "Please confirm by Friday.", "The copy is in the folder."])
    a, b = rng.sample(WORDS[subject], 2)
    return f"The {a} was compared with the {b} before the report closed."


def docs(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        own = rng.sample(list(WORDS), rng.choice([1, 1, 2]))
        parts = [sentence(rng, x) for x in own for _ in range(5)] + [sentence(rng, None) for _ in range(3)]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), None, own))
    return rows


AREAS = pd.DataFrame({"subject": list(WORDS), "description": ["", None, "x"]})


def test_held_out_accuracy(spark):
    rows = docs(400, 1)
    rng = random.Random(2)
    seeds = [(i, x if rng.random() > 0.04 else rng.choice(list(WORDS))) for i, _, _, own in rows[:200] for x in own]
    table = spark.createDataFrame([(i, t, p, "x") for i, t, p, _ in rows] + [(900, None, None, "x"), (901, "", "a", "x"), (902, " \n ", "a", "x"), (903, "Please confirm by Friday.", None, "x")], "doc_id long, text string, file_path string, share string")
    model = s.fit_subjects(table, spark.createDataFrame(seeds + [(1, None)], "doc_id long, subject string"), spark.createDataFrame(AREAS))
    got = {}
    for r in s.subjects_of(table, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert not set(got) & {900, 901, 902, 903}
    right = sum(got.get(i) == set(own) for i, _, _, own in rows[200:]) / 200
    assert right > 0.95


def test_without_labels(spark):
    table = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, file_path string")
    model = s.fit_subjects(table, spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame(AREAS))
    assert s.subjects_of(table, model).count() == 0
