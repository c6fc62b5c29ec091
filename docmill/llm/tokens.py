"""Encoding a whole corpus with a public byte-level BPE, each shared chunk of text once.

Texts are cut at rolling-hash landmarks, so that equal passages in different documents give equal chunks. A first pass counts
chunks by hash; a chunk that occurs once is encoded where it stands, one that several documents share goes through a join by
its content and is encoded once for all of them. Landmarks snap to the end of a run of letters, where the pieces of the
tokenizer are the same whatever stands on the other side. A text without such a place is cut all the same, and the join is
repaired: pieces are scanned anew from a safe place before the join until a piece boundary of the joined text agrees with one
of the following chunk; from there on both encodings are the same.
"""

from __future__ import annotations

import base64
import os
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from docmill.llm.splitting import rolling_hash
from docmill.session import cut_lineage

#: Default folder of the vocabulary files, read on the driver; every operator takes it as a parameter.
TOKENIZERS = os.environ.get("DOCMILL_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that splits text into pieces before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Mean, least and largest length of a chunk, and how far a landmark may snap, in code points.
MEAN, LEAST, MOST, SNAP = 256, 64, 2048, 64
#: So many code points before a join no piece can depend on what follows it, if at least three pieces lie between.
REACH = 4
#: Bits of the filter that tells which chunks may be shared. Its size is fixed; the fuller it is, the more chunks take the exact way.
FILTER_BITS = 1 << 23
#: Parts over which the uses of a shared chunk are spread in the join.
SALTS = 8


def rank_file(folder: str, name: str) -> bytes:
    """The rank file of a tokenizer: a few hundred kilobytes, whatever the corpus."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def coder_of(ranks: bytes, name: str):
    """The tokenizer of a rank file and the byte length of each id; once per worker."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    coder = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    sizes = np.zeros(max(table.values()) + 1, np.int32)
    for token, i in table.items():
        sizes[i] = len(token)
    return coder, sizes


def load(folder: str, name: str):
    """The tokenizer and the byte length of each id, on the driver."""
    return coder_of(rank_file(folder, name), name)


def shared_ranks(spark: SparkSession, folder: str, name: str):
    """A broadcast of the rank file, so that executors need no folder of their own."""
    return spark.sparkContext.broadcast(rank_file(folder, name))


def valid(text: str) -> str:
    """The text with lone surrogates replaced, as an encoder of UTF-8 needs it."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters to the pattern."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}+", every):
        a, b = m.span()
        at = np.arange(a, b)
        out[np.where(at >= 0xD800, at + 0x800, at)] = True
    return out


def cut_places(texts: list[str], mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[list[tuple[int, bool]]]:
    """For each text the inner places at which it is cut, by content alone, and whether the join needs no repair.

    Between a letter and a sign that is none a piece always ends: no alternative of the pattern has letters before other
    signs, and what a piece looks at behind itself is part of the letters. So both sides encode alike alone and together.
    """
    sizes = [len(t) for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(sizes).tolist()
    if not len(codes):
        return [[] for _ in texts]
    letter = letters()[codes]
    sure = np.nonzero(letter[:-1] & ~letter[1:])[0] + 1
    marks = np.nonzero(rolling_hash(codes) % np.uint64(mean) == 0)[0]
    to = np.searchsorted(sure, marks)
    marks, to = marks[to < len(sure)], to[to < len(sure)]
    snapped = np.unique(sure[to][sure[to] - marks <= SNAP])
    marks, sure = snapped.tolist(), sure.tolist()
    out = []
    for size, end in zip(sizes, ends):
        start = first = end - size
        found: list[tuple[int, bool]] = []
        while end - start >= 2 * least:
            i = bisect_left(marks, start + least)
            cut, safe = marks[i] if i < len(marks) else end, True
            if min(cut, end) > start + most:
                j = bisect_right(sure, start + most) - 1
                cut, safe = (sure[j], True) if j >= 0 and sure[j] >= start + least else (start + most, False)
            if end - cut < least:
                break
            found.append((cut - first, safe))
            start = cut
        out.append(found)
    return out


def chunk_places(text: str, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Inner places at which a text is cut into chunks."""
    return [p for p, _ in cut_places([text], mean, least, most)[0]]


_pieces = regex.compile(PATTERN)


def join_zone(left: str, right: str) -> tuple[int, str, int, bool]:
    """The repair of one join: (bytes to drop from the end of left's encoding, the text between, bytes to drop from the start
    of right's, whether the text between begins at a piece boundary that is sure to be one within left).

    The text between never ends in white space unless right does: how a run of blanks is cut depends on what follows it.
    """
    spans = [m.span() for m in _pieces.finditer(left)]
    safe = 0
    for k in range(len(spans) - 3, -1, -1):  # what a piece is depends on the signs up to its end and two beyond
        if len(left) - spans[k][1] >= REACH:
            safe = spans[k][1]
            break
    text, at = left[safe:] + right, safe
    seam = len(left) - safe
    ours = _pieces.finditer(text)
    theirs = _pieces.finditer(right)
    there = seam
    for m in ours:
        while there is not None and there < m.start():
            nxt = next(theirs, None)
            there = seam + nxt.end() if nxt else None
        if m.start() >= seam and there == m.start() and not text[m.start() - 1].isspace():
            end = m.start()
            break
    else:
        end = len(text)
    return len(left[at:].encode()), text[:end], len(text[seam:end].encode()) if end > seam else 0, safe > 0


def split_document(text: str, places: list[tuple[int, bool]]) -> list[tuple[str, int, str | None, int]]:
    """Chunks with the repair of the join before each: (chunk, bytes to drop before, zone text or None, bytes to drop here).

    A zone is None where both encodings meet without change, as at places that need no repair. A place whose repair would
    reach into the repair before it is given up and its chunks become one, so that repairs never overlap.
    """
    starts: list[int] = [0]
    info: list[tuple[int, str | None, int]] = [(0, None, 0)]
    for (place, safe), end in zip(places, [*(p for p, _ in places[1:]), len(text)]):
        starts.append(place)
        info.append((0, None, 0))
        while len(starts) > 1 and not safe:
            left, right = text[starts[-2] : starts[-1]], text[starts[-1] : end]
            before, zone, after, sure = join_zone(left, right)
            if before <= len(left.encode()) - info[-2][2] and (sure or len(starts) == 2):
                info[-1] = (0, None, 0) if not after and _aligned(left, zone) else (before, zone, after)
                break
            starts.pop()
            info.pop()
    return [(text[a:b], *i) for a, b, i in zip(starts, [*starts[1:], len(text)], info)]


def _aligned(left: str, zone: str) -> bool:
    """Whether the last pieces of left are those of the zone, so that nothing needs repair."""
    tail = left[len(left) - len(zone) :]
    if tail != zone:
        return False
    start = len(left) - len(zone)
    ours = [m.end() + start for m in _pieces.finditer(zone)]
    return ours == [m.end() for m in _pieces.finditer(left) if m.end() > start]


def trim(ids: np.ndarray, sizes: np.ndarray, front: int, back: int) -> np.ndarray:
    """ids without the first `front` and last `back` bytes; both fall on piece boundaries."""
    if front or back:
        ends = np.cumsum(sizes[ids])
        total = int(ends[-1]) if len(ends) else 0
        lo = int(np.searchsorted(ends, front, "right")) if front else 0
        hi = int(np.searchsorted(ends, total - back, "right")) if back else len(ids)
        return ids[lo:hi]
    return ids


def _chunks(texts: list[str]) -> list[list[tuple[str, int, str | None, int]]]:
    return [split_document(t, p) for t, p in zip(texts, cut_places(texts))]


def _encoded(coder, texts: list[str]) -> pa.ListArray:
    """The ids of each text as one column."""
    held = [coder.encode_to_numpy(t, disallowed_special=()) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in held], dtype=np.int64)]).astype(np.int32)
    values = np.concatenate(held).astype(np.int32) if held else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _parts(batches: Iterator[pa.RecordBatch], signs: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts, of about so many signs each, so that long texts don't add up."""
    for batch in batches:
        texts = [valid(t) for t in batch.column("text").to_pylist()]
        start, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= signs or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0


def may_be_shared(source: DataFrame, bits: int = FILTER_BITS):
    """A broadcast of `bits` bits: set for every chunk that occurs more than once, and for some others by chance.

    Chunks are counted by hash over all documents; words of 64 bits are put together in Spark, so that bits / 64 rows at most
    reach the driver, whatever the corpus.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _parts(batches):
            held = [xxhash.xxh3_64_intdigest(c[0].encode()) for chunks in _chunks(texts) for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(held, np.uint64).view(np.int64))], ["h"])

    often = source.select("text").mapInArrow(hashes, "h long").groupBy("h").count().where(F.col("count") > 1)
    at = often.select(F.pmod("h", F.lit(bits)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).collect()
    table = np.zeros(bits // 64, np.int64)
    for r in words:
        table[r["word"]] = r["bits"]
    return source.sparkSession.sparkContext.broadcast(table.view(np.uint8))


def _in_filter(table: np.ndarray, chunks: list[str]) -> list[bool]:
    h = np.array([xxhash.xxh3_64_intdigest(c.encode()) for c in chunks], np.uint64) & np.uint64(len(table) * 8 - 1)
    return ((table[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).tolist()


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, bits: int = FILTER_BITS) -> DataFrame:
    """(id, ids): the token ids of every document, without special tokens. Null and empty texts give an empty list.

    The ids equal those of the whole text encoded at once. Strings of special tokens are ordinary text. Rows of equal id and
    text come out once, an id with several texts once for each; other columns are ignored.

    Documents none of whose chunks may be shared are encoded in place, without a shuffle. Of the others only the chunks that
    may be shared are shuffled, as text once a content (128-bit hash) and as a reference once a use; uses of one chunk are
    spread over SALTS parts.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    full = source.where(F.length("text") > 0)
    ranks, table = shared_ranks(spark, folder, tokenizer), may_be_shared(full, bits)

    def judged(batches: Iterator[pa.RecordBatch]):
        """Slices with their chunks, which of these may be shared, and which documents have one."""
        for batch, texts in _parts(batches):
            chunks = _chunks(texts)
            marked = iter(_in_filter(table.value, [c[0] for d in chunks for c in d]))
            shared = [[next(marked) for _ in d] for d in chunks]
            yield batch, texts, chunks, shared, [any(s) for s in shared]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = coder_of(ranks.value, tokenizer)
        for batch, texts, _, _, pending in judged(batches):
            at = [i for i, p in enumerate(pending) if not p]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(at, pa.int64())), _encoded(coder, [texts[i] for i in at])], ["doc", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of the other documents: stretches of own chunks with their ids, shared chunks with their text."""
        coder, _ = coder_of(ranks.value, tokenizer)
        for batch, texts, chunks, shared, pending in judged(batches):
            rows: list[tuple] = []
            own: list[str] = []
            for i in [i for i, p in enumerate(pending) if p]:
                whole = xxhash.xxh3_128_digest(texts[i].encode())
                stretch: list = []
                for (chunk, before, zone, after), common in zip(chunks[i], shared[i]):
                    if not common and stretch and stretch[-1][1] is None and zone is None and not (before or after):
                        stretch[-1][2] += chunk
                    else:
                        stretch.append([len(stretch), xxhash.xxh3_128_digest(chunk.encode()) if common else None, chunk, before, zone, after])
                for seq, key, chunk, before, zone, after in stretch:
                    rows.append((i, whole, seq, key, chunk if key else None, before, after))
                    own += ["" if key else chunk, zone or ""]
            ids = _encoded(coder, own)
            at, whole, seq, key, text, before, after = map(list, zip(*rows)) if rows else ([],) * 7
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(pa.array(at, pa.int64())), pa.array(whole, pa.binary()), pa.array(seq, pa.int32()), pa.array(key, pa.binary()), pa.array(text, pa.string()),
                    ids.take(pa.array(range(0, len(own), 2), pa.int64())), pa.array(before, pa.int32()), ids.take(pa.array(range(1, len(own), 2), pa.int64())), pa.array(after, pa.int32()),
                ],
                ["doc", "whole", "seq", "key", "text", "ids", "before", "zone_ids", "after"],
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = coder_of(ranks.value, tokenizer)
        for batch, texts in _parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), _encoded(coder, texts)], ["key", "ids"])

    @F.pandas_udf("array<int>")
    def assemble(parts: pd.Series) -> pd.Series:
        _, sizes = coder_of(ranks.value, tokenizer)
        out = []
        for chunks in parts:
            chunks = sorted(chunks, key=lambda c: c["seq"])
            ids = []
            for k, c in enumerate(chunks):
                back = chunks[k + 1]["before"] if k + 1 < len(chunks) else 0
                ids += [np.asarray(c["zone_ids"], np.int32), trim(np.asarray(c["ids"], np.int32), sizes, c["after"], back)]
            out.append(np.concatenate(ids))
        return pd.Series(out)

    names = ["doc", "whole", "seq", "before", "zone_ids", "after"]
    schema = f"doc {id_type}, whole binary, seq int, key binary, text string, ids array<int>, before int, zone_ids array<int>, after int"
    parts = cut_lineage(full.mapInArrow(split, schema))  # used three times below
    common = parts.where(F.col("key").isNotNull())
    once = common.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(encode, "key binary, ids array<int>")
    once = once.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    uses = common.select(*names, "key", F.pmod(F.xxhash64("whole", "doc", "seq"), F.lit(SALTS)).cast("int").alias("salt"))
    both = parts.where(F.col("key").isNull()).select(*names, "ids").unionByName(uses.join(once, ["key", "salt"]).select(*names, "ids"))
    both = both.dropDuplicates(["doc", "whole", "seq"])
    whole = both.groupBy("doc", "whole").agg(F.collect_list(F.struct("seq", "ids", "before", "zone_ids", "after")).alias("parts"))
    none = source.where((F.length("text") == 0) | F.col("text").isNull()).select("doc").distinct().select("doc", F.lit([]).cast("array<int>").alias("ids"))
    rows = full.mapInArrow(alone, f"doc {id_type}, ids array<int>").unionByName(whole.select("doc", assemble("parts").alias("ids"))).unionByName(none)
    return rows.withColumnRenamed("doc", id_col)


def token_counts(docs: DataFrame, text_col: str, out_col: str = "tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """docs with the number of tokens of a text column; 0 for null and empty text."""
    ranks = shared_ranks(docs.sparkSession, folder, tokenizer)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        coder, _ = coder_of(ranks.value, tokenizer)
        return pd.Series([len(coder.encode_to_numpy(valid(t or ""), disallowed_special=())) for t in texts], dtype="int32")

    return docs.withColumn(out_col, count(F.coalesce(F.col(text_col), F.lit(""))))


if sys.byteorder != "little":  # the hashes read code points as little-endian
    raise ImportError("a little-endian machine is needed")
