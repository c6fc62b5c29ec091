"""Text that was decoded with the wrong code page: which records are affected, and what they said.

A code-page swap is a substitution cipher: every letter (or the bytes of a letter) stands as other signs. Which swap a piece
of text went through, and which letter a byte stands for, are hidden; they are learned per source by expectation-maximization
against the bigrams of the corpus. The tables of public code pages are only where the learning starts. The expectation step
weighs, for each suspicious piece, every swap by the bigrams of what it would have said; the maximization step counts how
often each swap occurs in the source and which letter each byte stands for. The learned letters are applied with translate().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docmill.session import cut_lineage

#: Buckets of the table of bigrams: its size is fixed, whatever the corpus.
BUCKETS = 1 << 19
#: Code pages as which UTF-8 or two-byte text may have been read, and those in which text may have been written.
SEEN_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866")
LATIN, CYRILLIC = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250"), ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
DOUBLE = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr")
#: Signs that only a wrong decoding makes: the replacement sign, controls of the C1 block, private use; and what the replacement sign looks like, read as GBK.
LOST, LOST_RUNS = re.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff]"), ("锟斤", "斤拷", "烫烫烫", "屯屯屯")
#: Passes of learning; log-odds from which a reading is believed; mean of the logarithms above which bigrams are those of the corpus.
PASSES, BELIEVED, USUAL = 5, 0.0, -9.5
#: Weight of the public code table against one observed sign when letters are learned.
TABLE_WEIGHT = 20.0


def fold(codes: np.ndarray) -> np.ndarray:
    """Digits count as one sign, blanks as another, capitals of ASCII as small letters."""
    codes = codes.copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    codes[(codes == 9) | (codes == 10) | (codes == 13) | (codes == 0xA0)] = 32
    upper = (codes >= 65) & (codes <= 90)
    codes[upper] += 32
    return codes


def buckets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket of each pair of code points."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(45)).astype(np.int64)


#: The swaps of two Cyrillic pages (written, seen); the signs whose pairs are tabulated for them, and the place of each code point among these.
CIPHERS = [(a, b) for b in CYRILLIC for a in CYRILLIC if a != b]
KNOWN = np.concatenate([np.arange(128), np.arange(0x400, 0x460)]).astype(np.uint32)
PLACE = np.full(0x461, len(KNOWN))
PLACE[KNOWN] = np.arange(len(KNOWN))
#: Stands beside a sign for its own share in the table; how far a bigram falls short of chance if its signs never meet.
ALONE, APART = 0x1FFFFF, -3.0


def bigram_buckets(codes: np.ndarray) -> np.ndarray:
    """The bucket of each pair of neighbours."""
    return buckets(codes[:-1], codes[1:])


class Bigrams:
    """Logarithms of the shares of bigrams in the corpus, by bucket; unseen bigrams fall back on the shares of their signs."""

    def __init__(self, counts: np.ndarray, total: int):
        self.counts, self.total = counts, total
        self.logs = np.log(np.maximum(counts, 0.2) / max(total, 1)).astype(np.float32)
        self.usual = max(USUAL, float(np.log(5 / max(total, 1))))  # five times are usual in the smallest corpus only
        self.memo: dict[str, float | bool | None] = {}
        self.pieces: dict[tuple, list] = {}
        self.steps: np.ndarray | None = None
        self.least: float | None = None

    def share(self, df: DataFrame):
        """A broadcast of the table: BUCKETS numbers."""
        return df.sparkSession.sparkContext.broadcast((self.logs, self.usual))

    @classmethod
    def shared(cls, held: tuple[np.ndarray, float]) -> Bigrams:
        """The table on a worker."""
        own = cls.__new__(cls)
        own.logs, own.usual = held
        own.memo, own.pieces, own.steps, own.least = {}, {}, None, None
        return own

    def without(self, counts: np.ndarray) -> Bigrams:
        """The table less other counts."""
        return Bigrams(np.maximum(self.counts - counts, 0), self.total)

    def likelier(self, codes: np.ndarray) -> list[tuple[str, str]]:
        """The ciphers (written, seen) that make code points with Cyrillic letters likelier; signs that are neither ASCII nor Cyrillic leave some room."""
        if self.steps is None:
            codes_of = fold(KNOWN)
            own = self.logs[buckets(codes_of, np.full(len(KNOWN), ALONE, np.uint32))]
            side = len(KNOWN) + 1
            self.steps = np.zeros((side, side, len(CIPHERS)), np.float32)

            def pairs(signs: np.ndarray, alone: np.ndarray) -> np.ndarray:
                first, second = np.meshgrid(signs, signs, indexing="ij")
                return np.maximum(self.logs[buckets(first, second)], alone[:, None] + alone[None, :] + APART)

            before = pairs(codes_of, own)
            far = (KNOWN > 127)[:, None] | (KNOWN > 127)[None, :]
            for i, (written, seen) in enumerate(CIPHERS):
                table = to_bytes(seen)
                said = fold(np.array([c if c < 128 else ord(page(written)[table[c]]) if c in table else 0xFFFD for c in KNOWN.tolist()], np.uint32))
                after = pairs(said, self.logs[buckets(said, np.full(len(said), ALONE, np.uint32))])
                self.steps[:-1, :-1, i] = np.where(far, after - before, 0)
                lost = np.append(said == 0xFFFD, False)
                self.steps[lost, :, i] = self.steps[:, lost, i] = -50
        at = PLACE[np.minimum(codes, len(PLACE) - 1)]
        room = 4.0 if (at == len(KNOWN)).any() else 0.01
        return [CIPHERS[i] for i in np.nonzero(self.steps[at[:-1], at[1:]].sum(0) > -room)[0]]

    def met(self, sign: str) -> bool:
        """Whether the corpus holds a sign."""
        value = self.memo.get(sign)
        if value is None:
            if self.least is None:
                self.least = float(self.logs.min()) + 0.1
            value = self.memo[sign] = float(self.logs[buckets(np.array([ord(sign)]), np.array([ALONE]))][0]) > self.least
        return value

    def of(self, folded: np.ndarray) -> np.ndarray:
        """Of all neighbours in folded code points."""
        own = self.logs[buckets(folded, np.full(len(folded), ALONE, np.uint32))]
        return np.maximum(self.logs[bigram_buckets(folded)], own[:-1] + own[1:] + APART)

    def one(self, pair: str) -> float | None:
        """Of two neighbours; None where both are ASCII."""
        value = self.memo.get(pair, 0.0)
        if value == 0.0:
            if pair.isascii():
                value = None
            else:
                value = float(self.of(fold(np.array([ord(pair[0]), ord(pair[1])], np.uint32)))[0])
            if len(self.memo) > 400_000:
                self.memo.clear()
            self.memo[pair] = value
        return value

    def mean(self, text: str) -> tuple[float, int]:
        """Mean over the bigrams that hold a sign beyond ASCII, and their number. Where there is none, the mean of usual ones."""
        if len(text) < 48:
            values = [v for i in range(len(text) - 1) if (v := self.one(text[i : i + 2])) is not None]
            return (sum(values) / len(values), len(values)) if values else (-8.0, max(1, len(text) - 1))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        far = (codes[:-1] > 127) | (codes[1:] > 127)
        if not far.any():
            return -8.0, max(1, len(codes) - 1)
        values = self.of(fold(codes))[far]
        return float(values.mean()), int(far.sum())


class Means:
    """Means of the bigrams of pieces of one text, from running sums that are made when first needed."""

    def __init__(self, text: str, bigrams: Bigrams):
        self.text, self.bigrams, self.sums = text, bigrams, None

    def of(self, start: int, end: int) -> float:
        """Of the piece and the signs beside it."""
        if self.sums is None:
            self.codes = codes = np.frombuffer(f"\n{self.text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)
            far = (codes[:-1] > 127) | (codes[1:] > 127)
            values = np.where(far, self.bigrams.of(fold(codes)), 0)
            self.sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)]), np.concatenate([[0], np.cumsum(far)])
        sums, numbers = self.sums
        n = numbers[end + 1] - numbers[start]
        return (sums[end + 1] - sums[start]) / n if n else -8.0


def tally(codes: np.ndarray, hidden: np.ndarray | None = None) -> np.ndarray:
    """Counts per bucket of the pairs and signs beyond ASCII among code points, without those that `hidden` marks."""
    folded, near = fold(codes), codes > 127
    pairs = near[:-1] | near[1:]
    if hidden is not None:
        pairs &= ~(hidden[:-1] | hidden[1:])
    at = np.nonzero(pairs)[0]
    signs = np.bincount(folded if hidden is None else folded[~hidden])
    own = np.nonzero(signs)[0]
    counts = np.bincount(buckets(folded[at], folded[at + 1]), minlength=BUCKETS)
    np.add.at(counts, buckets(own, np.full(len(own), ALONE, np.uint32)), signs[own])
    return counts


def counted(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The sum of partial counts (bucket, n); bucket -1 holds the number of signs. BUCKETS rows at most reach the driver."""
    held = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.float64)
    inner = held[held.bucket >= 0]
    counts[inner.bucket.to_numpy()] = inner.n.to_numpy()
    return counts, int(held.n[held.bucket < 0].sum())


def count_bigrams(texts: DataFrame, text_col: str) -> Bigrams:
    """The bigrams of all different texts. Each task sends its counts per bucket once.

    Copies count once and letters that UTF-8 explains not at all, so that damage does not become usual by being frequent.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            joined = "\n".join(t for t in batch["text"] if t)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(codes) > 1:
                total += len(codes)
                counts += tally(codes, explained(codes))
        at = np.nonzero(counts)[0]
        yield pd.DataFrame({"bucket": np.append(at, -1).astype("int32"), "n": np.append(counts[at], total)})

    different = texts.select(F.col(text_col).alias("text")).where(F.length("text") > 0).distinct()
    return Bigrams(*counted(different.mapInPandas(count, "bucket int, n long")))


def count_pieces(pieces: DataFrame) -> np.ndarray:
    """The bigrams of suspicious pieces (swap, signs), equal rows once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            joined = "".join(f" {piece} " for signs in batch["signs"] for piece in signs)
            if joined:
                counts += tally(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
        at = np.nonzero(counts)[0]
        yield pd.DataFrame({"bucket": at.astype("int32"), "n": counts[at]})

    return counted(pieces.select("swap", "signs").distinct().mapInPandas(count, "bucket int, n long"))[0]


@lru_cache(maxsize=64)
def page(name: str) -> list[str]:
    """The sign of each byte of a single-byte code page; bytes without a sign stand for their control."""
    return [bytes([b]).decode(name, "replace").replace("�", chr(b)) for b in range(256)]


@lru_cache(maxsize=64)
def to_bytes(name: str) -> dict[int, int]:
    """For translate(): each sign of a code page beyond ASCII to its byte; controls of the C1 block too, as some readers leave them."""
    table = {c: c for c in range(0x80, 0xA0)}
    return table | {ord(s): b for b, s in enumerate(page(name)) if b > 127}


def _class(signs: set[str]) -> str:
    return "[" + "".join(re.escape(s) for s in sorted(signs)) + "]"


@lru_cache(maxsize=64)
def shapes(name: str) -> tuple[frozenset[str], frozenset[str], re.Pattern]:
    """What letters beyond ASCII in UTF-8 look like, read in this code page: leads, continuations, and one or more of them together."""
    back: dict[int, set[str]] = {}
    for sign, b in to_bytes(name).items():
        back.setdefault(b, set()).add(chr(sign))
    some = lambda lo, hi: {s for b in range(lo, hi + 1) for s in back.get(b, ())}
    tail = _class(some(0x80, 0xBF))
    pattern = f"(?:{_class(some(0xC2, 0xDF))}{tail}|{_class(some(0xE0, 0xEF))}{tail}{{2}}|{_class(some(0xF0, 0xF4))}{tail}{{3}})+"
    return frozenset(some(0xC2, 0xF4)), frozenset(some(0x80, 0xBF)), re.compile(pattern)


@lru_cache(maxsize=64)
def roles(name: str) -> np.ndarray:
    """What each code point can be in UTF-8 read in this code page: 1 a continuation, 2 to 4 the lead of so many bytes, else 0."""
    out = np.zeros(0x2600, np.uint8)
    for c, b in to_bytes(name).items():
        if c < len(out):
            out[c] = 1 if b < 0xC0 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    return out


def explained(codes: np.ndarray) -> np.ndarray:
    """Which signs are two or more letters of UTF-8 in a row, read in some code page: no text in order has these."""
    far = codes > 127
    kept = np.nonzero(far | np.append(False, far[:-1]))[0]
    signs = np.minimum(codes[kept], 0x25FF)
    n, out = len(signs), np.zeros(len(codes), bool)
    for name in SEEN_AS:
        role = roles(name)[signs]
        tail, length = role == 1, np.zeros(n + 1, np.int64)
        for size in (2, 3, 4):
            if n < size:
                continue
            fits = role[: n - size + 1] == size
            boxed = np.zeros(len(fits), bool)
            for k in range(size):
                fits = fits & tail[k : k + len(fits)] if k else fits
                boxed |= signs[k : k + len(fits)] >= 0x2500
            length[: len(fits)][fits & boxed if name in ("koi8_r", "cp866") else fits] = size
        first = np.nonzero(length)[0]
        first = first[length[first + length[first]] > 0]
        if len(first):
            second = first + length[first]
            edges = np.zeros(n + 1, np.int64)
            np.add.at(edges, first, 1)
            np.add.at(edges, second + length[second], -1)
            out[kept[np.cumsum(edges)[:n] > 0]] = True
    return out


_written = re.compile("^[\x20-\x7e\xa0-\u052f\u1e00-\u27bf\u2e80-\u9fff\uac00-\ud7ff\uf900-\ufaff\ufe0f\uff00-\uffef\U0001f000-\U0002ffff\n\r\t\ufeff]*$")
#: Cyrillic letters that look like Latin ones; words mixed of both are spelled oddly, not decoded wrongly.
_twins = frozenset("АВЕКМНОРСТУХІЈЅаеосрухіјѕ")
_mixed = re.compile("[A-Za-z][аеосрухіјѕ]|[АВЕКМНОРСТХІЈЅаеосрухіјѕ][A-Za-z]")
_word = re.compile("[A-Za-z\u0400-\u045f]+")
_foreign = re.compile("[\x80-\u024f\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{3,}")
_cyrillic = re.compile("(?<![A-Za-z])[\u0400-\u045f](?:[\u0400-\u045f ]*[\u0400-\u045f])?(?![A-Za-z])")
_boxes = re.compile("[\u2500-\u25a0\u0400-\u045f\u0370-\u03ff\xa0-\xff\u2219-\u2265]{3,}")
_box = re.compile("[\u2550-\u256c\u2580-\u2593]")
_han = re.compile("[\u2000-\u206f\u2e80-\ud7ff\uff00-\uffef\ue000-\uf8ff\u0370-\u04ff\u2190-\u27ff]*[\u3100-\u9fff\ue000-\uf8ff][\u2000-\u206f\u2e80-\ud7ff\uff00-\uffef\ue000-\uf8ff\u0370-\u04ff\u2190-\u27ff]*")
_runs = re.compile("[^\x00-\x7f]{2,}")
_boxed, _one_cyrillic = re.compile("[\u2500-\u25a0]"), re.compile("[\u0400-\u045f]")
_wide = re.compile("[\u3000-\u9fff\uac00-\ud7a3\uff00-\uffef]")
_far_east = re.compile("[\u3100-\u9fff]")


@dataclass(frozen=True)
class Reading:
    """One way to read a piece of a text: place, the swap (written in > seen as) and what it would have said."""

    start: int
    end: int
    swap: str
    said: str


def readings(text: str, bigrams: Bigrams) -> list[Reading]:
    """All readings of the suspicious pieces of a text, by every swap that its bytes allow."""
    out: list[Reading] = []
    signs = set(text)
    runs = [m.span() for m in _runs.finditer(text)]
    if not runs:
        return out if not _far_east.search(text) else _lone_han(text, out)
    means = Means(text, bigrams)
    boxed = _boxed.search(text) is not None  # what half the bytes are in these two code pages
    for name in SEEN_AS:
        leads, tails, shape = shapes(name)
        if leads.isdisjoint(signs) or tails.isdisjoint(signs) or name in ("koi8_r", "cp866") and not boxed:
            continue
        for m in [m for a, b in runs for m in shape.finditer(text, a, b)]:
            said = m[0]
            for _ in range(3):  # some texts were decoded wrongly twice
                said = shape.sub(lambda x: x[0].translate(to_bytes(name)).encode("latin-1").decode("utf-8", "replace"), said)
                if not shape.search(said):
                    break
            if _written.match(said) and not (len(m[0]) <= 4 and _twins.issuperset(m[0])):
                out.append(Reading(m.start(), m.end(), f"utf_8>{name}", said))
    if _far_east.search(text):
        _lone_han(text, out)
    for m in _foreign.finditer(text):
        _single(text, m.start(), m.end(), ("cp1252", "mac_roman"), means, out)
    if _one_cyrillic.search(text):
        spelled = text
        if _mixed.search(text):  # oddly spelled words, and whole words of twins beside them, are left out
            spelled = _word.sub(lambda w: "x" * len(w[0]) if _mixed.search(w[0]) or _twins.issuperset(w[0]) else w[0], text)
        for m in _cyrillic.finditer(spelled):
            if m.end() - m.start() > 2:
                _single(text, m.start(), m.end(), CYRILLIC, means, out)
    if boxed and _box.search(text):
        for m in _boxes.finditer(text):
            if _box.search(m[0]):
                _single(text, m.start(), m.end(), ("cp437", "cp866", "koi8_r"), means, out)
    return out


def _lone_han(text: str, out: list[Reading]) -> list[Reading]:
    """Adds the readings of pieces that hold Chinese signs as UTF-8 read as GB 18030."""
    for m in _han.finditer(text):
        said = m[0].encode("gb18030", "replace").decode("utf-8", "replace")
        if not said.isascii() and said.count("\ufffd") <= 0.25 * len(said):
            out.append(Reading(m.start(), m.end(), "utf_8>gb18030", said))
    return out


def _single(text: str, start: int, end: int, seen: tuple[str, ...], means: Means, out: list[Reading]) -> None:
    """Adds the readings of a piece with one or two bytes a letter. They depend on the piece and the signs beside it, so equal ones are read once a task."""
    memo = means.bigrams.pieces
    context = text[start - 1 : start] or "\n", text[start:end], text[end : end + 1] or "\n", seen
    held = memo.get(context)
    if held is None:
        if len(memo) > 100_000:
            memo.clear()
        held = memo[context] = _read_single(text, start, end, seen, means)
    out += [Reading(start + a, start + b, swap, said) for a, b, swap, said in held]


def _read_single(text: str, start: int, end: int, seen: tuple[str, ...], means: Means) -> list[tuple[int, int, str, str]]:
    """(start, end, swap, said) within the piece. A piece of usual bigrams is read only where that is likelier still."""
    piece = text[start:end]
    out: list[tuple[int, int, str, str]] = []
    usual = means.of(start, end) > means.bigrams.usual
    known = means.bigrams.likelier(means.codes[start : end + 2]) if usual and seen is CYRILLIC else None

    def add(a: int, b: int, swap: str, said: str) -> None:
        if not usual or gain(text, Reading(start + a, start + b, swap, said), means.bigrams) > 0:
            out.append((a, b, swap, said))

    for name in seen:
        try:
            held = piece.translate(to_bytes(name)).encode("latin-1")
        except UnicodeError:
            continue
        for written in CYRILLIC:  # a Latin text has no three accented letters in a row
            if written == name or known is not None and (written, name) not in known:
                continue
            said = held.decode(written, "replace")
            small = sum(map(str.islower, said))
            if small >= 0.5 * len(said.replace(" ", "")) and said != piece and ("\xa0" not in said or "\xa0" in piece):
                add(0, end - start, f"{written}>{name}", said)
        if name in ("cp1252", "mac_roman", "cp1251", "koi8_r", "cp437"):
            for written in DOUBLE:
                for skip in (0, 1):  # the piece may begin with a sign of its own
                    whole = skip + (len(held) - skip) // 2 * 2
                    try:
                        said = held[skip:whole].decode(written)
                    except UnicodeError:
                        continue
                    if not said or len(_wide.findall(said)) < 0.8 * len(said):
                        continue
                    if usual and sum(map(means.bigrams.met, said)) < 0.5 * len(said):
                        continue  # signs that the corpus never has are not likelier than usual bigrams
                    add(skip, whole, f"{written}>{name}", said)
                    break
    return out


def gain(text: str, r: Reading, bigrams: Bigrams) -> float:
    """How much likelier, in nats, the reading makes the bigrams of its piece and the signs beside it."""
    if r.said.isascii():
        return 0.0
    left, right = text[max(0, r.start - 1) : r.start] or "\n", text[r.end : r.end + 1] or "\n"
    before, _ = bigrams.mean(left + text[r.start : r.end] + right)
    after, n = bigrams.mean(left + r.said + right)
    spare = len(r.said.encode()) - len(r.said) if r.swap.startswith("utf_8>") else 0  # bytes that had to fit for the reading to exist
    return (after - before) * n + spare


def is_cipher(swap: str) -> bool:
    """Whether a swap stands one sign for one letter."""
    return swap.split(">")[0] in CYRILLIC


def suspects(records: DataFrame, keys: list[str], text_col: str, bigrams: Bigrams) -> DataFrame:
    """(keys..., lost, swap, gain, pieces, gains, signs): for each record the swaps by which pieces of it can be read.

    gain is that of the pieces of the record that this swap explains better than any other: of all together or of the best
    one, so that what is in order beside a garbled line doesn't speak for it. signs and gains are those of positive gain, for
    swaps that stand one sign for one letter. A row with null swap marks signs that no text in order has.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*keys).schema)
    shared = bigrams.share(records)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Bigrams.shared(shared.value)
        seen: dict[tuple, float] = {}
        for batch in batches:
            rows = []
            for *key, text in batch.itertuples(index=False, name=None):
                if text.isascii():
                    continue
                if LOST.search(text) or any(x in text for x in LOST_RUNS):
                    rows.append((*key, True, None, None, 0, None, None))
                pieces: dict[int, tuple[float, Reading]] = {}
                for r in readings(text, model):
                    context = text[max(0, r.start - 1) : r.end + 1], r.swap
                    value = seen.get(context)
                    if value is None:
                        value = gain(text, r, model)
                        if len(seen) > 200_000:
                            seen.clear()
                        seen[context] = value
                    if r.start not in pieces or value > pieces[r.start][0]:
                        pieces[r.start] = value, r
                swaps: dict[str, list] = {}
                for value, r in pieces.values():
                    held = swaps.setdefault(r.swap, [0.0, -np.inf, 0, [], []])
                    held[0] += value
                    held[1] = max(held[1], value)
                    held[2] += 1
                    if is_cipher(r.swap) and value > 0:
                        held[3].append(value)
                        held[4].append(text[r.start : r.end])
                rows += [(*key, False, swap, max(total, best), n, gains, signs) for swap, (total, best, n, gains, signs) in swaps.items() if max(total, best) > -20]
            yield pd.DataFrame(rows, columns=[*keys, "lost", "swap", "gain", "pieces", "gains", "signs"])

    source = records.select(*keys, F.col(text_col).alias("text")).where(F.length("text") > 0)
    return source.mapInPandas(run, schema + ", lost boolean, swap string, gain double, pieces int, gains array<double>, signs array<string>")


def learn_letters(pairs: pd.DataFrame, swap: str, bigrams: Bigrams) -> pd.DataFrame:
    """(sign, letter, sure): the cipher of one swap in one source, by expectation-maximization over counts of its bigrams.

    pairs has x, y, n. The letters behind x and y are hidden; their joint weight is that of the bigram of letters in the
    corpus times the present belief in each sign's letter. The public table gives the first belief and some weight later on.
    """
    written, seen = swap.split(">")
    table = {chr(s): page(written)[b] for s, b in to_bytes(seen).items() if page(written)[b].isalpha() and chr(s).isprintable()}
    letters = sorted(set(table.values()))
    signs = sorted((set(pairs.x) | set(pairs.y)) & set(table))
    if not signs or not letters:
        return pd.DataFrame({"sign": [], "letter": [], "sure": []})
    known = sorted((set(pairs.x) | set(pairs.y)) - set(table) - set(letters))
    states = letters + known
    number = {s: i for i, s in enumerate(states)}
    codes = fold(np.array([ord(s) for s in states], np.uint32))
    first, second = np.meshgrid(codes, codes, indexing="ij")
    joint = np.exp(np.maximum(bigrams.logs[buckets(first, second)], -25))
    start = np.full((len(signs), len(letters)), 0.2 / len(letters))
    for i, s in enumerate(signs):
        start[i, number[table[s]]] += 0.8
    belief = start.copy()
    row = {s: i for i, s in enumerate(signs)}
    xs, ys, ns = pairs.x.tolist(), pairs.y.tolist(), pairs.n.to_numpy(float)

    def of(s: str) -> np.ndarray:
        full = np.zeros(len(states))
        if s in row:
            full[: len(letters)] = belief[row[s]]
        else:
            full[number[s]] = 1
        return full

    for _ in range(PASSES):
        counted = TABLE_WEIGHT * start
        for x, y, n in zip(xs, ys, ns):
            q = joint * of(x)[:, None] * of(y)[None, :]
            total = q.sum()
            if total <= 0:
                continue
            if x in row:
                counted[row[x]] += n * q.sum(1)[: len(letters)] / total
            if y in row:
                counted[row[y]] += n * q.sum(0)[: len(letters)] / total
        belief = counted / counted.sum(1, keepdims=True)
    best = belief.argmax(1)
    return pd.DataFrame({"sign": signs, "letter": [letters[b] for b in best], "sure": belief.max(1)})


def learn_swaps(suspicious: DataFrame, source: str) -> DataFrame:
    """(source, swap, odds): the log-odds that a piece which a swap can explain went through it, by expectation-maximization.

    Gains are counted in steps of a quarter nat first, so a source gives a few thousand rows however many pieces it has.
    """
    bins = suspicious.where(F.col("swap").isNotNull()).groupBy(source, "swap", F.round(F.greatest(F.least(F.col("gain"), F.lit(40.0)), F.lit(-20.0)) * 4).cast("int").alias("bin")).count()
    kind = suspicious.schema[source].dataType.simpleString()

    def learn(held: pd.DataFrame) -> pd.DataFrame:
        gains, n = held["bin"].to_numpy() / 4, held["count"].to_numpy(float)
        odds = -1.0
        for _ in range(PASSES):
            share = (n / (1 + np.exp(-np.clip(gains + odds, -50, 50)))).sum() + 0.5
            odds = float(np.clip(np.log(share / (n.sum() + 1 - share)), -6, 6))
        return pd.DataFrame({source: [held[source].iloc[0]], "swap": [held["swap"].iloc[0]], "odds": [odds]})

    return bins.groupBy(source, "swap").applyInPandas(learn, f"`{source}` {kind}, swap string, odds double")


@dataclass
class Learned:
    """What one pass over the records taught: suspicious pieces with their belief, and the letters of the ciphers."""

    bigrams: Bigrams
    believed: DataFrame
    letters: dict[tuple, dict[str, str]]


def learn(records: DataFrame, keys: list[str], text_col: str, source: str) -> Learned:
    """Both steps of learning. `source` is one of the keys, with a few values that are never null: what was decoded in one place.

    believed has (keys..., lost, swap, gain, odds) for the readings that hold and the lost signs. A reading of a swap that
    stands one sign for one letter must also hold under the letters learned from all its pieces in the source, which are
    collected: at most 256 for each source and swap.
    """
    bigrams = count_bigrams(records, text_col)
    rows = cut_lineage(suspects(records, keys, text_col, bigrams))  # read three times below
    odds = learn_swaps(rows, source)
    judged = rows.join(odds, [source, "swap"], "left").withColumn("log_odds", F.coalesce(F.col("odds"), F.lit(0.0))).withColumn("odds", F.col("gain") + F.col("log_odds"))
    judged = judged.where(F.col("lost") | (F.col("odds") > BELIEVED))
    bigrams = bigrams.without(count_pieces(judged.where(F.size("signs") > 0)))  # what was believed is no part of the corpus
    piece = F.explode("signs")
    pieces = judged.where(F.size("signs") > 0).select(source, "swap", piece.alias("piece"))
    padded = F.concat(F.lit(" "), F.col("piece"), F.lit(" "))
    at = F.explode(F.sequence(F.lit(1), F.length("piece") + 1))
    pairs = pieces.select(source, "swap", padded.alias("p"), at.alias("i")).select(source, "swap", F.expr("substring(p, i, 1)").alias("x"), F.expr("substring(p, i + 1, 1)").alias("y"))
    pairs = pairs.groupBy(source, "swap", "x", "y").agg(F.count("*").alias("n"))
    shared = bigrams.share(records)

    def cipher(held: pd.DataFrame) -> pd.DataFrame:
        model = Bigrams.shared(shared.value)
        own, name = held[source].iloc[0], held["swap"].iloc[0]
        return learn_letters(held, name, model).assign(**{source: own, "swap": name})[[source, "swap", "sign", "letter", "sure"]]

    kind = records.schema[source].dataType.simpleString()
    letters: dict[tuple, dict[str, str]] = {}
    for r in pairs.groupBy(source, "swap").applyInPandas(cipher, f"`{source}` {kind}, swap string, sign string, letter string, sure double").collect():
        letters.setdefault((r[source], r["swap"]), {})[r["sign"]] = r["letter"]
    tables = {s: {ord(a): b for a, b in t.items()} for s, t in letters.items()}

    @F.pandas_udf("double")
    def anew(sources: pd.Series, swap: pd.Series, signs: pd.Series, gains: pd.Series, odds: pd.Series) -> pd.Series:
        """The mean gain of each bigram under the learned letters: of all pieces, or of the best that is believed by itself."""
        model = Bigrams.shared(shared.value)
        out = []
        for own, name, held, each, log_odds in zip(sources, swap, signs, gains, odds):
            if name is None or not is_cipher(name):
                out.append(99.0)
                continue
            best = -99.0
            for plain in [" ".join(held), *(p for p, g in zip(held, each) if g + log_odds > BELIEVED)] if len(held) else []:
                before, after = model.mean(f" {plain} ")[0], model.mean(f" {plain.translate(tables.get((own, name), {}))} ")[0]
                best = max(best, after - before)
            out.append(best)
        return pd.Series(out)

    held = judged.withColumn("anew", anew(source, "swap", "signs", "gains", "log_odds")).where(F.col("lost") | (F.col("anew") > 1.0))
    return Learned(bigrams, held.select(*keys, "lost", "swap", "gain", "odds"), letters)


def restore(text: str, swaps: set[str], letters: dict[str, dict[str, str]], bigrams: Bigrams) -> str:
    """The text with every piece read by the best of the believed swaps; twice over, as some texts were decoded wrongly twice."""
    tables = {s: {ord(a): b for a, b in letters.get(s, {}).items()} for s in swaps}
    for _ in range(3):
        best: dict[int, tuple[float, Reading, str]] = {}
        for r in readings(text, bigrams):
            if r.swap not in swaps:
                continue
            value = gain(text, r, bigrams)
            said = r.said
            if is_cipher(r.swap) and tables.get(r.swap):
                written, seen = r.swap.split(">")
                rest = {s: page(written)[b] for s, b in to_bytes(seen).items()}
                said = text[r.start : r.end].translate(rest | tables[r.swap])
            if value > (-6 if r.swap.startswith("utf_8>") else 0) and (r.start not in best or value > best[r.start][0]):
                best[r.start] = value, r, said
        if not best:
            break
        out, at = [], 0
        for start in sorted(best):
            _, r, said = best[start]
            if start >= at:
                out += [text[at:start], said]
                at = r.end
        text = "".join([*out, text[at:]])
    return text


def garbled(records: DataFrame, keys: list[str], text_col: str = "text", source: str = "tbl") -> DataFrame:
    """The keys of records in which signs stand for others because bytes were decoded wrongly, lost originals included.

    Null, empty and ASCII texts are never affected. Foreign words and symbols in order are none: a reading must make the
    bigrams likelier by what the source's own pieces taught. Repeated rows count once; other columns are ignored.
    """
    return learn(records, keys, text_col, source).believed.select(*keys).distinct()


def repaired(records: DataFrame, keys: list[str], text_col: str = "text", source: str = "tbl") -> DataFrame:
    """(keys..., restored, lost): the affected records with their text restored where it can be; lost says that some signs can't."""
    known = learn(records, keys, text_col, source)
    swaps = known.believed.groupBy(*keys).agg(F.collect_set("swap").alias("swaps"))
    texts = records.select(*keys, F.col(text_col).alias("text")).dropDuplicates(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*keys).schema)
    shared = known.bigrams.share(records)
    letters = known.letters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Bigrams.shared(shared.value)
        for batch in batches:
            rows = []
            for *key, text, names in batch.itertuples(index=False, name=None):
                own = key[keys.index(source)]
                text = restore(text, set(names), {s: t for (o, s), t in letters.items() if o == own}, model)
                rows.append((*key, text, bool(LOST.search(text) or any(x in text for x in LOST_RUNS))))
            yield pd.DataFrame(rows, columns=[*keys, "restored", "lost"])

    return texts.join(swaps, keys).select(*keys, "text", "swaps").mapInPandas(run, schema + ", restored string, lost boolean")
