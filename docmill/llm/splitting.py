"""Splitting oversized texts at natural boundaries by content-defined chunking.

A hash rolls over the code points; where its low bits vanish lies a landmark, a place that depends on the text around it and
on nothing else. Every landmark snaps to the nearest natural boundary and the next cut is the best snapped landmark between
the minimum and the maximum size. An edit moves only landmarks near it, so the pieces further on stay the same.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: The hash covers WINDOW = 2 ** 5 code points; about every DIVISOR-th place is a landmark and snaps SNAP code points at most.
WINDOW_POWER, DIVISOR, SNAP = 5, 48, 160
BASE = 0x9E3779B97F4A7C15
#: Signs that end a sentence, and those that end a clause.
SENTENCE_ENDS, CLAUSE_ENDS, CLOSERS = ".!?。！？…", ";:,；：，、", "\"')]}”’»」』）》"


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """For every i a hash of the 32 code points before place i (fewer at the start)."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    factor = BASE
    for power in range(WINDOW_POWER):
        width = 1 << power
        moved = np.zeros_like(h)
        moved[width:] = h[:-width]
        h = h + moved * np.uint64(factor)
        factor = factor * factor % (1 << 64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def boundary_rank(text: str, codes: np.ndarray) -> np.ndarray:
    """For every place i (a cut before code point i) how natural it is: 5 paragraph, 4 line, 3 sentence, 2 clause, 1 blank, 0 none, -1 inside a character made of several code points."""
    n = len(codes)
    rank = np.zeros(n, np.int8)
    if n < 2:
        return rank
    blank = np.isin(codes, np.array([9, 10, 13, 32, 0xA0, 0x3000], np.uint32)) | ((codes >= 0x2000) & (codes <= 0x200A))
    line = codes == 10
    left, right_blank = codes[:-1], blank[1:]
    starts = blank[:-1] & ~right_blank
    rank[1:][starts] = 1
    marks = lambda signs: np.isin(codes, np.array([ord(c) for c in signs], np.uint32))
    ends, clauses, closers = marks(SENTENCE_ENDS), marks(CLAUSE_ENDS), marks(CLOSERS)
    wide = (codes >= 0x3000) & (codes <= 0xFFEF)
    before = np.maximum.accumulate(np.where(blank, -1, np.arange(n)))  # last place before with something visible
    at = np.arange(1, n)
    prev = before[at - 1]
    has = prev >= 0
    closed = has & closers[np.maximum(prev, 0)] & (prev > 0)
    sign = np.where(closed, prev - 1, prev)
    sign = np.maximum(sign, 0)
    can = (starts | (wide[sign] & ~right_blank)) & has & ~(closers[1:] & ~starts)
    rank[1:][can & clauses[sign]] = 2
    rank[1:][can & ends[sign] & ~ends[1:]] = 3
    after_line = starts & (left == 10)
    first_line = np.maximum.accumulate(np.where(line, np.arange(n), -1))
    rank[1:][starts & (first_line[at - 1] > prev)] = 4
    double = np.zeros(n, bool)
    runs = np.cumsum(line)
    double[1:] = starts & ((runs[at - 1] - np.where(has, runs[np.maximum(prev, 0)], 0)) >= 2)
    rank[double] = 5
    rank[1:][after_line & (rank[1:] < 4)] = 4
    odd = np.nonzero(codes >= 0x300)[0]
    for i in odd[(codes[odd] < 0x2E80) | (codes[odd] > 0xD7FF)]:  # Chinese and Korean code points stand alone
        c = int(codes[i])
        if i and (unicodedata.combining(chr(c)) or c == 0x200D or 0xFE00 <= c <= 0xFE0F or 0x1F3FB <= c <= 0x1F3FF):
            rank[i] = -1
        if c == 0x200D and i + 1 < n:
            rank[i + 1] = -1
    rank[1:][(left == 13) & line[1:]] = -1
    rank[0] = 0
    return rank


def cuts(text: str, limit: int = 2000, overlap: int = 200) -> list[int]:
    """Inner cut places of a text. Pieces run from cut - overlap to the next cut and hold `limit` code points at most."""
    if len(text) <= limit:
        return []
    longest = limit - overlap
    least = longest // 2
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    rank, hashes = boundary_rank(text, codes), rolling_hash(codes)
    natural = np.nonzero(rank > 0)[0]
    marks = np.nonzero(hashes % np.uint64(DIVISOR) == 0)[0]
    if len(natural) and len(marks):
        right = np.searchsorted(natural, marks)
        lo, hi = natural[np.maximum(right - 1, 0)], natural[np.minimum(right, len(natural) - 1)]
        snapped = np.where(np.abs(marks - lo) <= np.abs(hi - marks), lo, hi)
        snapped = np.unique(snapped[np.abs(snapped - marks) <= SNAP])
    else:
        snapped = np.zeros(0, np.int64)
    found, start = [], 0
    while len(text) - start > (limit if start == 0 else longest):
        low, high = start + least, start + longest
        for places in (snapped, natural):  # the best natural place; the smallest hash decides, not the position
            places = places[np.searchsorted(places, low) : np.searchsorted(places, high, "right")]
            if len(places):
                best = places[rank[places] == rank[places].max()]
                cut = int(best[np.argmin(hashes[best])])
                break
        else:
            inside = marks[np.searchsorted(marks, low) : np.searchsorted(marks, high, "right")]
            inside = inside[rank[inside] >= 0]
            cut = int(inside[np.argmin(hashes[inside])]) if len(inside) else high
            while cut > low and rank[cut] < 0:
                cut -= 1
            if rank[cut] < 0:
                cut = high
        found.append(cut)
        start = cut
    return found


def pieces(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of each piece; a text within the limit is one piece."""
    places = cuts(text, limit, overlap)
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip([0, *places], [*places, len(text)])]


def joined(parts: Column | str) -> Column:
    """The text of a list: its elements that are neither null nor empty, joined by two line feeds. Null for null."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n\n")


def split_oversized(items: DataFrame, keys: list[str], text_col: str, limit: int = 2000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """(keys..., piece_no, start, end, piece): the pieces of every item longer than `limit` code points.

    Consecutive pieces share exactly `overlap` code points, the new part of a piece holds at least half its room unless the
    text ends, and no piece exceeds the limit. Items within the limit, null and empty ones give no rows (they need no
    splitting). Other columns are ignored. Repeated items are split alike. Only oversized texts reach Python; nothing is
    shuffled, so one item is the unit of work.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be smaller than half the limit")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, text in batch.itertuples(index=False, name=None):
                rows += [(*key, i, a, b, text[a:b] if with_text else None) for i, (a, b) in enumerate(pieces(text, limit, overlap))]
            yield pd.DataFrame(rows, columns=[*keys, "piece_no", "start", "end", "piece"])

    long = items.select(*keys, F.col(text_col).alias("__text")).where(F.length("__text") > limit)
    return long.mapInPandas(run, key_schema + ", piece_no int, start int, end int, piece string")
