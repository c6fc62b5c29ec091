"""Mixing sources to target weights as a min-cost flow over membership patterns.

A text kept in several sources can serve any of them. Texts are grouped by the set of sources that hold them; tokens flow from
the groups to the quotas of the sources, and using a group again costs more each time, so repetition is spread as thinly as
possible. The flow network has one node for each pattern and source, whatever the number of documents. Its result is a
fraction of each group per source; documents are then laid out by a seeded hash along the token axis of their group and
each source takes its interval.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from docmill.llm.tokens import TOKENIZERS, token_counts
from docmill.session import cut_lineage

#: Least number of slices of the hash axis, and texts that one slice should hold at most, so that one task lays it out with ease.
SLICES, SLICE_TEXTS = 8192, 50_000


@dataclass
class Flow:
    """tokens[(pattern, source)] is the number of tokens that a source takes from a pattern; total the size of the mix."""

    tokens: dict[tuple[str, str], int]
    total: int


def _residual_path(edges: list[list], out: dict, start, goal) -> list[int] | None:
    """Cheapest path over edges with room left (Bellman-Ford with a queue; costs may be negative on the way back)."""
    best, via, queue, inside = {start: 0}, {}, [start], {start}
    while queue:
        node = queue.pop(0)
        inside.discard(node)
        for e in out.get(node, ()):
            _, to, room, cost = edges[e]
            if room > 0 and best[node] + cost < best.get(to, float("inf")):
                best[to] = best[node] + cost
                via[to] = e
                if to not in inside:
                    queue.append(to)
                    inside.add(to)
    if goal not in best:
        return None
    path, node = [], goal
    while node != start:
        path.append(via[node])
        node = edges[via[node]][0]
    return path[::-1]


def min_cost_flow(capacity: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], repeats: dict[str, int]) -> Flow:
    """Routes tokens from patterns to source quotas. The r-th use of a pattern's tokens costs r * r, so costs are convex.

    A source uses a pattern at most repeats[source] times, and all sources together at most as often as the most generous of
    its members allows. Quotas that can't be met are met as far as possible.
    """
    edges: list[list] = []
    out: dict = {}

    def add(a, b, room, cost):
        out.setdefault(a, []).append(len(edges))
        edges.append([a, b, room, cost])
        out.setdefault(b, []).append(len(edges))
        edges.append([b, a, 0, -cost])

    for p, size in sorted(capacity.items()):
        for r in range(1, max(repeats[s] for s in members[p]) + 1):
            add("start", ("p", p), size, r * r)
        for s in sorted(members[p]):
            for r in range(1, repeats[s] + 1):
                add(("p", p), ("s", s), size, r * r)
    for s, size in sorted(quota.items()):
        add(("s", s), "goal", size, 0)
    while path := _residual_path(edges, out, "start", "goal"):
        push = min(edges[e][2] for e in path)
        for e in path:
            edges[e][2] -= push
            edges[e ^ 1][2] += push
    tokens: dict[tuple[str, str], int] = {}
    for e in range(0, len(edges), 2):
        a, b, _, _ = edges[e]
        if isinstance(a, tuple) and isinstance(b, tuple) and edges[e ^ 1][2]:
            tokens[a[1], b[1]] = tokens.get((a[1], b[1]), 0) + edges[e ^ 1][2]
    return Flow(tokens, sum(tokens.values()))


def plan_mix(capacity: dict[str, int], members: dict[str, list[str]], share: dict[str, float], repeats: dict[str, int], total: int | None = None) -> Flow:
    """The flow for a mix of `total` tokens, or of the largest size at which every source that has tokens keeps its share.

    Sources without any tokens can't contribute; the others keep their shares in proportion and the loss shows in the report.
    """
    held = {s for p in capacity if capacity[p] for s in members[p]}
    weights = {s: share[s] for s in share if s in held and share[s] > 0 and repeats[s] > 0}
    norm = sum(weights.values())
    if not weights or norm <= 0:
        return Flow({}, 0)
    usable = {p: n for p, n in capacity.items() if n > 0 and any(s in weights for s in members[p])}
    sources = {p: [s for s in members[p] if s in weights] for p in usable}
    quotas = lambda t: {s: int(t * w / norm) for s, w in weights.items()}
    if total is not None:
        return min_cost_flow(usable, sources, quotas(total), repeats)
    low, high = 0, sum(n * max(repeats[s] for s in sources[p]) for p, n in usable.items()) + 1
    while high - low > max(1, low // 100_000):  # by halving; feasible sizes form an interval
        middle = (low + high) // 2
        want = quotas(middle)
        if min_cost_flow(usable, sources, want, repeats).total >= sum(want.values()):
            low = middle
        else:
            high = middle
    return min_cost_flow(usable, sources, quotas(low), repeats)


def intervals(capacity: dict[str, int], flow: Flow) -> list[tuple[str, str, int, int, int]]:
    """(pattern, source, whole uses, from, to): the part of a pattern's token axis that a source takes once more than its whole uses.

    The parts follow one another round the axis, so no text is used more than one time above the average of its pattern.
    """
    rows, at = [], dict.fromkeys(capacity, 0)
    for (p, s), n in sorted(flow.tokens.items()):
        whole, rest = divmod(n, capacity[p])
        rows.append((p, s, whole, at[p], at[p] + rest))
        at[p] = (at[p] + rest) % capacity[p]
    return rows


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens, repeats): the documents of the mix and how often each is used, 1 at least.

    docs has doc_id, text, source; targets has source, target_share, max_repeats. Equal texts count as one text with several
    homes: a source uses its own copy with the smallest doc_id, and whichever source uses it, the text is used at most as
    often as its most generous home allows. Documents without text, source or target take no part; targets with null or
    non-positive share or repeats neither; of several targets of a source the largest share counts.
    A source's share is met up to one document per pattern of membership.

    Broadcast and collected are the targets and the patterns of membership, whose number depends on the targets only. Tokens
    are counted where a document is read and texts are told apart by a 128-bit hash, so no text is shuffled.
    """
    spark = docs.sparkSession
    want = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull())
    want = want.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    rows = want.collect()
    share = {r["source"]: float(r["target_share"]) for r in rows}
    repeats = {r["source"]: int(r["max_repeats"]) for r in rows}
    out = "doc_id long, source string, tokens int, repeats int"
    if not share:
        return spark.createDataFrame([], out)
    named = docs.where((F.length("text") > 0) & F.col("source").isin(*share)).select("doc_id", "source", "text")
    named = token_counts(named, "text", "tokens", tokenizer, folder).select("doc_id", "source", "tokens", F.unhex(F.md5("text")).alias("text_key"))
    copies = named.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = copies.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("homes"), F.max("tokens").alias("tokens"))
    first = F.col("homes")[0]["doc_id"]
    texts = texts.select("homes", "tokens", F.to_json(F.col("homes.source")).alias("pattern"), first.alias("first"), F.xxhash64(first, F.lit(seed)).alias("h"))
    # written once: the sizes of the patterns decide the plan before documents are selected
    texts = cut_lineage(texts)
    n_slices = max(SLICES, -(-texts.count() // SLICE_TEXTS))
    texts = texts.withColumn("slice", F.pmod(F.shiftrightunsigned("h", 16), F.lit(n_slices)).cast("int"))
    slices = texts.groupBy("pattern", "slice").agg(F.sum("tokens").alias("n"))
    sizes = {r["pattern"]: int(r["n"]) for r in slices.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    members = {p: json.loads(p) for p in sizes}
    flow = plan_mix(sizes, members, share, repeats, total)
    plan = intervals(sizes, flow)
    if not plan:
        return spark.createDataFrame([], out)
    before = F.sum("n").over(Window.partitionBy("pattern").orderBy("slice")) - F.col("n")  # two numbers a slice
    offsets = slices.select("pattern", "slice", before.alias("offset"))
    in_slice = Window.partitionBy("pattern", "slice").orderBy("h", "first").rowsBetween(Window.unboundedPreceding, -1)
    laid = texts.withColumn("inner", F.coalesce(F.sum("tokens").over(in_slice), F.lit(0))).join(offsets, ["pattern", "slice"])
    laid = laid.withColumn("at", F.col("offset") + F.col("inner"))
    parts = spark.createDataFrame([(p, s, w, a, b, sizes[p]) for p, s, w, a, b in plan], "pattern string, taker string, whole int, lo long, hi long, size long")
    used = laid.join(F.broadcast(parts), "pattern")
    extra = ((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))) | (F.col("at") < F.col("hi") - F.col("size"))
    used = used.withColumn("repeats", (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("int")).where(F.col("repeats") > 0)
    own = F.filter("homes", lambda x: x["source"] == F.col("taker"))[0]["doc_id"]
    return used.select(own.alias("doc_id"), F.col("taker").alias("source"), "tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_used, tokens, actual_share): what a mix really reached; sources without documents have 0."""
    reached = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.max("repeats").alias("most_used"), F.sum(F.col("tokens").cast("long") * F.col("repeats")).alias("tokens")
    )
    joined = targets.select("source", "target_share", "max_repeats").join(reached, "source", "left").fillna(0, ["documents", "most_used", "tokens"])
    every = Window.partitionBy(F.lit(0))  # one row a target
    return joined.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)))
