"""Subject areas of documents: one-versus-rest linear classifiers over hashed n-grams, applied sentence by sentence.

Labelled documents give weak labels to their sentences; address paths, headings, sources and document types give weak labels
to others, as far as the labelled documents bear them out. One classifier a subject is trained on them, each in a task of its
own; then the sentences are labelled anew by the classifiers within what their document allows and training goes on, so that
phrases of every document and wrong labels lose their weight. A document has each subject that holds a share of what its
sentences say on any subject; the least share is calibrated for each subject on labelled documents that took no part in training.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Size of the hash space of n-grams, and with it of the model.
FEATURES = 1 << 18
#: Most labelled documents that are used to fit the model, drawn by hash of their id; of these every HELD_OUT-th calibrates. Most documents with weak labels beside them.
MOST_LABELLED, HELD_OUT, SEED, MOST_WEAK = 4_000, 4, 29, 500
#: Passes of gradient descent in each round of labelling sentences anew, and in the last one over all labelled documents; gain of a pass below which a round ends; shrinkage.
PASSES, LAST_PASSES, ENOUGH, SHRINK = (40, 15, 15), 15, 2e-4, 2e-6
#: A sentence is on a subject from this probability; a document's subject needs about this share.
SURE, SHARE = 0.5, 0.25
#: Errors that a threshold of its own must save a subject.
CLEARLY = 4
#: Documents a cue must stand in, its least share of one subject (lower bound), and the weight of a document that only cues label.
CUE_DOCS, CUE_SURE, CUE_TRUST = 8, 0.8, 0.3

_token = regex.compile(r"\p{Han}|[\p{L}][\p{L}\p{M}]*(?<!\p{Han})")
_ends = re.compile("[\r\n]+|(?<=[。！？])|(?<=[.!?])\\s+|(?<=[.!?][”\"»)])\\s+")
#: A heading line of wiki markup or Markdown; written so that Java reads it alike.
HEADING = r"(?m)^[ \t]*(?:={2,}|#{1,6}|\*\*)[ \t]*(.+?)[ \t]*[=#*]*$"


def sentences(text: str) -> list[str]:
    """A text cut at line ends and after signs that end sentences; blank pieces are left out."""
    return [s for part in _ends.split(text) if (s := part.strip())]


class Hasher:
    """Features of sentences: words and pairs of words; of Chinese signs pairs and triples."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def _id(self, word: str) -> int:
        value = self.words.get(word)
        if value is None:
            if len(self.words) > 1_000_000:
                self.words.clear()
            value = self.words[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 1 | ("⺀" <= word[0] <= "鿿")
        return value

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature of each n-gram, its sentence), for all sentences at once."""
        tokens: list[str] = []
        lengths = []
        for t in texts:
            found = _token.findall(t.lower())
            tokens += found
            lengths.append(len(found))
        own = np.fromiter(map(self._id, tokens), np.uint64, len(tokens))
        of = np.repeat(np.arange(len(texts)), lengths)
        han = (own & np.uint64(1)).astype(bool)
        mix = lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xC2B2AE3D27D4EB4F)
        place = lambda h: ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)).astype(np.int64)
        pairs = mix(own[:-1], own[1:])
        same = of[:-1] == of[1:]
        triples = mix(pairs[:-1], own[2:]) if len(own) > 2 else own[:0]
        whole = (of[:-2] == of[2:]) & han[:-2] & han[1:-1] & han[2:] if len(own) > 2 else np.zeros(0, bool)
        feature = np.concatenate([place(own[~han]), place(pairs[same]), place(triples[whole])])
        sentence = np.concatenate([of[~han], of[:-1][same], of[:-2][whole]])
        order = np.argsort(sentence, kind="stable")
        return feature[order], sentence[order]


def total(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group; groups rise."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(groups):
        at = np.concatenate([[0], np.nonzero(np.diff(groups))[0] + 1])
        out[groups[at]] = np.add.reduceat(values, at, axis=0)
    return out


def scores(weights: np.ndarray, bias: np.ndarray, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    """One score for each sentence and subject: the mean weight of its n-grams, times the root of their number, and the bias."""
    count = np.maximum(np.bincount(sentence, minlength=n), 1)[:, None].astype(np.float32)
    return total(weights[feature], sentence, n) / np.sqrt(count) + bias


@dataclass
class Sentences:
    """Different sentences of labelled documents: their n-grams as places among the `used` features, and for each its number of copies and the subjects its document allows."""

    feature: np.ndarray
    sentence: np.ndarray
    used: np.ndarray
    copies: np.ndarray
    allowed: np.ndarray

    @classmethod
    def of(cls, docs: list[tuple[np.ndarray, np.ndarray]], allowed: np.ndarray, trust: np.ndarray) -> Sentences:
        """From (n-grams, their sentence) of each document. N-grams of one sentence only teach nothing that holds elsewhere and are left out; equal sentences of documents with equal labels become one."""
        seen: dict[bytes, int] = {}
        features, copies, rows = [], [], []
        for (feature, sentence), row, weight in zip(docs, allowed, trust):
            for part in np.split(feature, np.nonzero(np.diff(sentence))[0] + 1) if len(feature) else ():
                at = seen.setdefault(part.tobytes() + row.tobytes() + bytes([int(weight < 1)]), len(features))
                if at == len(features):
                    features.append(part)
                    rows.append(row)
                    copies.append(0.0)
                copies[at] += weight
        if not features:
            none = np.zeros(0, np.int64)
            return cls(none, none, none, np.zeros(0, np.float32), np.zeros((0, allowed.shape[1]), np.float32))
        feature, sentence = np.concatenate(features).astype(np.int64), np.repeat(np.arange(len(features)), [len(f) for f in features])
        often = np.bincount(feature, minlength=FEATURES) > 1
        keep = often[feature]
        used, place = np.unique(feature[keep], return_inverse=True)
        return cls(place, sentence[keep], used, np.array(copies, np.float32), np.array(rows, np.float32))

    def root(self) -> np.ndarray:
        """The root of each sentence's number of n-grams."""
        return np.sqrt(np.maximum(np.bincount(self.sentence, minlength=len(self.copies)), 1)).astype(np.float32)


def probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit(rows: Sentences, wanted: np.ndarray, trust: np.ndarray, passes: int, start: tuple | None = None) -> tuple[tuple, np.ndarray]:
    """Logistic regression of one subject against the rest, by gradient descent with a step of its own for each weight.

    Returns what descent goes on from (weights, sums of squared slopes, bias, its sum) and the probability of each sentence.
    It ends early once a pass gains hardly anything.
    """
    n = len(rows.copies)
    w, g2, b, b2 = start or (np.zeros(len(rows.used), np.float32), np.full(len(rows.used), 1e-4, np.float32), -2.0, 1e-4)
    root = rows.root()
    scale = 1 / max(float(trust.sum()), 1)
    edge = np.concatenate([[0], np.nonzero(np.diff(rows.sentence))[0] + 1]) if len(rows.sentence) else np.zeros(0, int)
    at = rows.sentence[edge]
    last = np.inf
    p = np.zeros(n, np.float32)
    for step in range(passes + 1):
        sums = np.zeros(n, np.float32)
        if len(edge):
            sums[at] = np.add.reduceat(w[rows.feature], edge)
        p = probability(sums / root + b)
        loss = -float((trust * np.log(np.where(wanted > 0, p, 1 - p) + 1e-9)).sum()) * scale
        if step == passes or last - loss < ENOUGH * last and step > 4:
            break
        last = loss
        error = (p - wanted) * trust * scale
        slope = np.bincount(rows.feature, (error / root)[rows.sentence], len(rows.used)).astype(np.float32) + SHRINK * w
        g2 = g2 + slope * slope * 1e6
        w = w - 0.5 * slope * 1e3 / np.sqrt(g2)
        slope_b = float(error.sum())
        b2 += slope_b * slope_b * 1e6
        b -= 0.1 * slope_b * 1e3 / b2**0.5
    return (w, g2, b, b2), p


def fit_all(spark: SparkSession | None, rows: Sentences, wanted: np.ndarray, trust: np.ndarray, passes: int, starts: list | None) -> tuple[list, np.ndarray]:
    """One classifier a subject, each trained by a task of its own; without a session one after another. What is sent and comes back is bounded by the labelled documents."""
    k = wanted.shape[1]
    if spark is None:
        done = [fit(rows, wanted[:, j], trust, passes, starts[j] if starts else None) for j in range(k)]
        return [d[0] for d in done], np.stack([d[1] for d in done], 1)
    shared = spark.sparkContext.broadcast((rows, wanted, trust, starts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, wanted, trust, starts = shared.value
        for batch in batches:
            for j in batch["id"]:
                (w, g2, b, b2), p = fit(rows, wanted[:, j], trust, passes, starts[j] if starts else None)
                yield pd.DataFrame({"id": [j], "w": [w.tobytes()], "g2": [g2.tobytes()], "b": [b], "b2": [b2], "p": [p.astype(np.float32).tobytes()]})

    got = sorted(spark.range(0, k, 1, k).mapInPandas(run, "id long, w binary, g2 binary, b double, b2 double, p binary").collect(), key=lambda r: r["id"])
    shared.destroy()
    states = [(np.frombuffer(r["w"], np.float32), np.frombuffer(r["g2"], np.float32), r["b"], r["b2"]) for r in got]
    return states, np.stack([np.frombuffer(r["p"], np.float32) for r in got], 1)


def relabel(p: np.ndarray, rows: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """(wanted, trust): each sentence is on the likeliest subject that its document allows, if on any; one that is clearly on another has no say, as the label may be wrong."""
    inside = p * (rows.allowed > 0)
    best, other = inside.max(1), (p * (rows.allowed == 0)).max(1)
    wanted = np.where((inside == best[:, None]) & (best[:, None] > 0.3), rows.allowed, 0).astype(np.float32)
    return wanted, np.where((other > 0.6) & (best < 0.3), 0, rows.copies).astype(np.float32)


def calibrate(got: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """The least share of each subject, from shares and labels of documents that took no part in training.

    The middle of the stretch with hardly more than the fewest errors over all subjects holds for a subject, unless another value saves it
    at least CLEARLY errors: labels are wrong now and then, and a subject alone has few documents near the border.
    """
    tries = np.arange(0.15, 0.351, 0.01)
    if len(got) < 8:
        return np.full(truth.shape[1], SHARE)
    errors = np.stack([((got >= t) != truth).sum(0) for t in tries])  # tries x subjects
    total = errors.sum(1)
    best = np.nonzero(total <= total.min() + max(2, len(got) // 200))[0]
    middle = int(best[len(best) // 2])
    own = errors.argmin(0)
    clear = errors[middle] - errors.min(0) >= CLEARLY
    return np.where(clear, tries[own], tries[middle])


@dataclass
class Model:
    """subjects, weights (FEATURES x subjects), bias, and the least share of each subject."""

    subjects: list[str]
    weights: np.ndarray
    bias: np.ndarray
    least: np.ndarray


def of_sentences(model_weights: np.ndarray, bias: np.ndarray, hasher: Hasher, parts: list[str]) -> np.ndarray:
    """For each sentence how much of it is on each subject: all classifiers that say so share it by their probability."""
    feature, sentence = hasher.features(parts)
    p = probability(scores(model_weights, bias, feature, sentence, len(parts)))
    p[p < SURE] = 0
    return p / np.maximum(p.sum(1, keepdims=True), 1e-9)


def shares(model_weights: np.ndarray, bias: np.ndarray, hasher: Hasher, texts: list[str], known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """For each document the share of each subject in what it says on any subject; zeros where it says nothing on any. `known` keeps sentences seen before."""
    k = model_weights.shape[1]
    known = {} if known is None else known
    if len(known) > 200_000:
        known.clear()
    parts = [sentences(t) for t in texts]
    new = list(dict.fromkeys(s for p in parts for s in p if s not in known))
    if new:
        known.update(zip(new, of_sentences(model_weights, bias, hasher, new)))
    flat = [s for p in parts for s in p]
    out = np.zeros((len(texts), k), np.float32)
    if flat:
        held = np.array([known[s] for s in flat], np.float32) * np.array([len(s) for s in flat], np.float32)[:, None]
        out = total(held, np.repeat(np.arange(len(texts)), [len(p) for p in parts]), len(texts))
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def words(text: str) -> list[str]:
    return [w for w in regex.findall(r"\p{L}+", text.lower()) if len(w) > 2]


def cues_of(text: str, path: str | None, source: str | None, kind: str | None) -> set[str]:
    """What is known of a document besides its text: words of its address path and of its headings, its source, its type."""
    out = {f"path:{w}" for w in words(path or "")} | {f"head:{w}" for h in regex.findall(HEADING, text) for w in words(h)}
    return out | ({f"source:{source}"} if source else set()) | ({f"type:{kind}"} if kind else set())


def weak_rules(labelled: pd.DataFrame, areas: pd.DataFrame) -> dict[str, str]:
    """{cue: subject}: cues whose labelled documents are of one subject nearly always (by a lower bound), and words of a subject's name and description in paths and headings, unless labelled documents speak against them."""
    n, hits = Counter(), Counter()
    for text, path, source, kind, held in zip(labelled.text, labelled.file_path, labelled.source, labelled.doc_type, labelled.subjects):
        for cue in cues_of(text, path, source, kind):
            n[cue] += 1
            hits.update((cue, s) for s in held)
    rules = {}
    for (cue, subject), k in sorted(hits.items()):
        mean = (k + 1) / (n[cue] + 2)
        if n[cue] >= CUE_DOCS and mean - 1.64 * (mean * (1 - mean) / (n[cue] + 3)) ** 0.5 >= CUE_SURE:
            rules[cue] = subject
    named = Counter(w for a, b in zip(areas.subject, areas.description) for w in {*words(a), *words(b or "")})
    for subject, description in zip(areas.subject, areas.description):
        for w in {*words(subject), *words(description or "")}:
            for cue in (f"path:{w}", f"head:{w}"):
                if named[w] == 1 and cue not in rules and (n[cue] == 0 or hits[cue, subject] >= CUE_SURE * n[cue]):
                    rules[cue] = subject
    return rules


def weakly_labelled(docs: DataFrame, seeds: DataFrame, rules: dict[str, str], most: int) -> DataFrame:
    """(doc_id, text, subjects): documents without label to which cues give one; `most` of them, the smallest by hash of their id. All documents are looked at."""
    by_kind: dict[str, dict[str, str]] = {}
    for cue, subject in rules.items():
        kind, _, value = cue.partition(":")
        by_kind.setdefault(kind, {})[value] = subject
    lookup = lambda kind: F.create_map(*[F.lit(x) for pair in by_kind[kind].items() for x in pair])
    cut = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}{3,})"), F.lit(1))
    found = F.array().cast("array<string>")
    if "path" in by_kind:
        found = F.concat(found, F.transform(cut(F.coalesce("file_path", F.lit(""))), lambda w: F.try_element_at(lookup("path"), w)))
    if "head" in by_kind:
        heads = F.array_join(F.regexp_extract_all("text", F.lit(HEADING), F.lit(1)), " ")
        found = F.concat(found, F.transform(cut(heads), lambda w: F.try_element_at(lookup("head"), w)))
    for kind, column in (("source", "source"), ("type", "doc_type")):
        if kind in by_kind:
            found = F.concat(found, F.array(F.try_element_at(lookup(kind), F.coalesce(column, F.lit("")))))
    rows = docs.where(F.length(F.trim("text")) > 0).withColumn("subjects", F.array_distinct(F.array_compact(found))).where(F.size("subjects") > 0)
    rows = rows.select("doc_id", "text", "subjects").join(seeds.select("doc_id").distinct(), "doc_id", "left_anti")
    return rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)


def ngrams(docs: DataFrame) -> pd.DataFrame:
    """The (bounded) documents with their n-grams and the sentence of each, taken out by the executors."""
    schema = "doc_id long, subjects array<string>, weak boolean, features binary, sentence binary, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for batch in batches:
            found = [hasher.features(sentences(t)) for t in batch["text"]]
            yield batch.assign(features=[f.astype(np.int32).tobytes() for f, _ in found], sentence=[s.astype(np.int32).tobytes() for _, s in found])[[c.split()[0] for c in schema.split(", ")]]

    return docs.mapInPandas(run, schema).toPandas()


def train(spark: SparkSession | None, labelled: pd.DataFrame, subjects: list[str]) -> Model:
    """A model from documents with doc_id, text, subjects (a list), weak (labelled by cues only), features and sentence as ngrams() gives them."""
    number = {s: i for i, s in enumerate(subjects)}
    known = np.zeros((len(labelled), len(subjects)), np.float32)
    for i, held in enumerate(labelled.subjects):
        for s in held:
            if s in number:
                known[i, number[s]] = 1
    weak = labelled.weak.to_numpy(bool)
    trust = np.where(weak, CUE_TRUST, 1.0)
    docs = [(np.frombuffer(f, np.int32), np.frombuffer(s, np.int32)) for f, s in zip(labelled.features, labelled.sentence)]
    folds = np.array([zlib.crc32(f"{SEED}:{d}".encode()) % HELD_OUT for d in labelled.doc_id])
    held = np.nonzero((folds == 0) & ~weak)[0]
    taught = np.nonzero((folds != 0) | weak)[0]

    def spread(rows: Sentences, states: list) -> tuple[np.ndarray, np.ndarray]:
        weights = np.zeros((FEATURES, len(subjects)), np.float32)
        weights[rows.used] = np.stack([s[0] for s in states], 1)
        return weights, np.array([s[2] for s in states], np.float32)

    rows = Sentences.of([docs[i] for i in taught], known[taught], trust[taught])
    wanted, sure, states = rows.allowed, rows.copies, None
    for passes in PASSES:
        states, p = fit_all(spark, rows, wanted, sure, passes, states)
        wanted, sure = relabel(p, rows)
    weights, bias = spread(rows, states)
    least = calibrate(shares(weights, bias, Hasher(), [labelled.text.iloc[i] for i in held]), known[held] >= 1)
    whole = Sentences.of(docs, known, trust)
    squares = np.full((FEATURES, len(subjects)), 1e-4, np.float32)
    squares[rows.used] = np.stack([s[1] for s in states], 1)
    starts = [(weights[whole.used, j], squares[whole.used, j], s[2], s[3]) for j, s in enumerate(states)]
    wanted, sure = relabel(probability(scores(weights[whole.used], bias, whole.feature, whole.sentence, len(whole.copies))), whole)
    states, _ = fit_all(spark, whole, wanted, sure, LAST_PASSES, starts)
    weights, bias = spread(whole, states)
    return Model(subjects, weights, bias, least)


def fit_subjects(docs: DataFrame, seeds: DataFrame, areas: DataFrame, most: int = MOST_LABELLED, weak: int = MOST_WEAK) -> Model:
    """Trains on at most `most` labelled documents, the smallest by hash of their id, and `weak` that cues label; labels count over all of them.

    docs has doc_id, text and may have file_path, source and doc_type, which give the cues.
    """
    for c in ("file_path", "source", "doc_type"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    held = areas.where(F.col("subject").isNotNull()).dropDuplicates(["subject"]).toPandas()
    subjects = sorted(held.subject)
    if not subjects:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
    seeds = seeds.where(F.col("subject").isNotNull())
    labels = seeds.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    chosen = labels.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
    texts = docs.where(F.length(F.trim("text")) > 0).select("doc_id", "text", "file_path", "source", "doc_type").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    labelled = texts.toPandas()
    rules = weak_rules(labelled, held)
    spark = docs.sparkSession
    both = spark.createDataFrame([], "doc_id long, text string, subjects array<string>, weak boolean")
    if len(labelled):
        rows = labelled[["doc_id", "text", "subjects"]].assign(subjects=[[str(x) for x in s] for s in labelled.subjects], weak=False)
        both = spark.createDataFrame(rows, both.schema).repartition(spark.sparkContext.defaultParallelism)
    if rules and weak:
        both = both.unionByName(weakly_labelled(docs, seeds, rules, weak).withColumn("weak", F.lit(True)))
    return train(spark, ngrams(both).sort_values("doc_id"), subjects)


def subjects_of(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, subject, share): the subjects of every document and their share in what it says on any subject.

    A document on no subject, and one with null, empty or blank text, gives no row; equal texts get equal subjects. The model
    has a fixed size and is broadcast. Other columns are ignored; nothing is shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.subjects, model.weights, model.bias, model.least))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, weights, bias, least = shared.value
        hasher, known = Hasher(), {}
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                got = shares(weights, bias, hasher, part["text"].tolist(), known)
                row, s = np.nonzero((got >= least[None, :]) & (got > 0))
                if not len(row):
                    continue
                yield pd.DataFrame({id_col: part["id"].to_numpy()[row], "subject": [names[j] for j in s], "share": got[row, s]})

    source = docs.where(F.length(F.trim(text_col)) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(run, f"`{id_col}` {kind}, subject string, share double")
