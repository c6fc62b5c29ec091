import itertools
import random

import pytest

from docmill.llm import mixing, tokens

try:
    tokens.load(tokens.TOKENIZERS, "byte_bpe_50k")
except (OSError, ImportError):
    pytest.skip("no tokenizer files", allow_module_level=True)


def test_flow_prefers_fresh_text_and_respects_caps():
    flow = mixing.min_cost_flow({"ab": 100, "a": 50}, {"ab": ["a", "b"], "a": ["a"]}, {"a": 80, "b": 100}, {"a": 2, "b": 3})
    assert flow.total == 180 and flow.tokens["ab", "b"] == 100 and flow.tokens["a", "a"] == 50 and flow.tokens["ab", "a"] == 30
    capped = mixing.min_cost_flow({"a": 10}, {"a": ["a"]}, {"a": 100}, {"a": 2})
    assert capped.total == 20


def words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


def test_mix(spark):
    rows = [(i, words(i, 30), "small" if i < 40 else "large" if i < 400 else "other", "x") for i in range(500)]
    rows += [(900, None, "small", "x"), (901, "", "small", "x"), (902, words(3, 30), "large", "x"), (903, words(3, 30), "small", "x"), (904, words(7, 30), None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("small", 0.4, 3), ("large", 0.5, 2), ("absent", 0.1, 2), ("null", None, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, targets)
    got = mixed.collect()
    assert {(r.doc_id, r.source) for r in got} == {(r.doc_id, r.source) for r in mixed.collect()}
    assert all(1 <= r.repeats <= {"small": 3, "large": 2}[r.source] for r in got)
    assert len({(r.doc_id) for r in got}) == len(got) and not {900, 901, 903, 904} & {r.doc_id for r in got}
    report = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert report["small"].actual_share == pytest.approx(0.4 / 0.9, abs=0.01)
    assert report["large"].actual_share == pytest.approx(0.5 / 0.9, abs=0.01)
    assert report["absent"].tokens == 0 and report["absent"].actual_share == 0
    assert report["small"].most_used == 3


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(docs, targets).count() == 0
    assert mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.shares(mixing.mix(docs, targets), targets).first().actual_share == 0


def price(n, capacity):
    """Cost of n tokens of a pattern: the r-th use of a token costs r * r."""
    whole, rest = divmod(n, capacity)
    return capacity * sum(r * r for r in range(1, whole + 1)) + rest * (whole + 1) ** 2


@pytest.mark.parametrize("seed", range(6))
def test_flow_is_the_optimum_of_all_flows(seed):
    rng = random.Random(seed)
    capacity = {p: rng.randint(1, 2) for p in "xy"}
    members = {p: sorted(rng.sample("abc", rng.randint(2, 3))) for p in "xy"}
    repeats = {s: rng.randint(1, 2) for s in "abc"}
    quota = {s: rng.randint(0, 4) for s in "abc"}
    pairs = [(p, s) for p in "xy" for s in members[p]]
    best = None
    for held in itertools.product(*(range(capacity[p] * repeats[s] + 1) for p, s in pairs)):
        flow = dict(zip(pairs, held))
        used = {p: sum(n for (q, _), n in flow.items() if q == p) for p in "xy"}
        if any(used[p] > capacity[p] * max(repeats[s] for s in members[p]) for p in "xy") or any(sum(n for (_, t), n in flow.items() if t == s) > quota[s] for s in "abc"):
            continue
        cost = sum(price(used[p], capacity[p]) for p in "xy") + sum(price(n, capacity[p]) for (p, _), n in flow.items())
        best = max(best or (-1, 0), (sum(held), -cost))
    got = mixing.min_cost_flow(capacity, members, quota, repeats)
    used = {p: sum(n for (q, _), n in got.tokens.items() if q == p) for p in "xy"}
    cost = sum(price(used[p], capacity[p]) for p in "xy") + sum(price(n, capacity[p]) for (p, _), n in got.tokens.items())
    assert (got.total, -cost) == best
