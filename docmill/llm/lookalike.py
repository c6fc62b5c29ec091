"""One consistent spelling for texts that look the same.

Strings and code points that show the same are joined into classes by union-find: an accent composed or combining, full-width
and ordinary forms, radicals and ideographs, blanks of one role, letters of different scripts with one shape, and the empty
string with all signs of no width. Each class is represented by its member that is most frequent in the corpus. Texts are
rewritten greedily, longest match first, by an automaton over all other members; two records look the same exactly if they
are then equal.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from docmill.session import cut_lineage

#: Letters of one shape, a Latin letter and its Cyrillic and Greek look-alikes.
LETTERS = """
A АΑ  B ВΒ  C СϹ  E ЕΕ  H НΗ  I ІΙ  J ЈͿ  K КΚ  M МΜ  N Ν  O ОΟ  P РΡ  Q Ԛ  S Ѕ  T ТΤ  W Ԝ  X ХΧ  Y ҮΥ  Z Ζ
a а  c сϲ  d ԁ  e е  h һ  i і  j јϳ  l ӏ  o оο  p рρ  q ԛ  s ѕ  v ѵν  w ԝ  x х  y у
Г Γ  П Π  Ф Φ  к κ
"""
#: Signs of no width, blanks that stand between words, line ends.
NO_WIDTH = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
LINE_ENDS = ("\r\n", "\r", "\u0085", "\u2028", "\u2029")
#: Ranges whose compatibility forms look like what they stand for: radicals, ligatures, Arabic forms, half and full width.
SAME_LOOK = ((0x2E80, 0x2FDF), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFFEE))

#: Joiners between pictographs, and between letters of scripts that join, do change the picture; they stay.
_joining = regex.compile("(?<=[\\p{Extended_Pictographic}\ufe0f\U0001F3FB-\U0001F3FF])\u200d(?=\\p{Extended_Pictographic})|(?<=[\\p{Arabic}\\p{Syriac}\\p{Devanagari}\\p{Bengali}\\p{Tamil}\\p{Malayalam}\\p{Sinhala}\\p{Mongolian}]\\p{M}*)[\u200c\u200d](?=[\\p{Arabic}\\p{Syriac}\\p{Devanagari}\\p{Bengali}\\p{Tamil}\\p{Malayalam}\\p{Sinhala}\\p{Mongolian}])")


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@lru_cache(maxsize=1)
def look_alikes() -> tuple[list[list[str]], dict[str, dict[str, str]]]:
    """The classes, and for each script its own member of a class of letters: {script: {any member: own member}}."""
    classes, scripts = Classes(), {"Latin": {}, "Cyrillic": {}, "Greek": {}}
    letters = LETTERS.split()
    for one, others in zip(letters[::2], letters[1::2]):
        group = [one, *others]
        for x in others:
            classes.join(one, x)
        for script in scripts:
            own = [x for x in group if unicodedata.name(x).startswith(script.upper())]
            if own:
                scripts[script] |= {x: own[0] for x in group}
    for x in NO_WIDTH:
        classes.join("", x)
    for x in BLANKS:
        classes.join(" ", x)
    for x in LINE_ENDS:
        classes.join("\n", x)
    for low, high in SAME_LOOK:
        for code in range(low, high + 1):
            x = chr(code)
            plain = unicodedata.normalize("NFKC", x)
            if plain != x and not plain.startswith(" ") and unicodedata.category(x) != "Cn":
                classes.join(x, plain)
    for group in classes.members():  # full-width letters also take part in what their plain forms look like
        for x in group:
            if len(x) == 1 and len(y := unicodedata.normalize("NFC", x)) == 1:
                classes.join(x, y)
    return classes.members(), scripts


class Rewriter:
    """Rewrites texts to the representatives. counts: how often each code point occurs in the corpus.

    Members of several code points are found by an Aho-Corasick automaton, leftmost and longest first; those of one go through
    translate(), which does for them what the automaton would, at the speed of a table.
    """

    def __init__(self, counts: dict[str, int]):
        groups, self.scripts = look_alikes()
        self.singles: dict[int, str] = {}
        self.automaton = ahocorasick.Automaton()
        pairs = 0
        for group in groups:
            if "" in group:
                best = ""
            else:
                best = min(group, key=lambda x: (-min((counts.get(c, 0) for c in x), default=0), len(x), x))
                if best in LINE_ENDS:
                    best = "\n"
            best = unicodedata.normalize("NFD", best)
            for x in group:
                x = unicodedata.normalize("NFD", x)
                if x != best and len(x) == 1:
                    self.singles[ord(x)] = best
                elif x != best and x:
                    self.automaton.add_word(x, (len(x), best))
                    pairs += 1
        self.automaton.make_automaton()
        self.ascii_moves = any(code < 128 for code in self.singles)
        self.longer = regex.compile("|".join(regex.escape(x) for x in self.automaton.keys())) if pairs else None
        shared = {x for own in self.scripts.values() for x in own}
        self.only = {s: regex.compile(rf"(?![{''.join(sorted(shared))}])\p{{{s}}}") for s in self.scripts}
        self.words = regex.compile(r"[\p{L}\p{M}]+")
        self.back = {s: str.maketrans(own) for s, own in self.scripts.items()}

    def skeleton(self, text: str) -> str:
        """The rewritten text: equal for all texts that look the same. Joiners that stay part it, so that no other sign has to stand for them."""
        if "\u200c" not in text and "\u200d" not in text:
            return self._rewritten(text)
        out, at = [], 0
        for m in _joining.finditer(text):
            out += [self._rewritten(text[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, self._rewritten(text[at:])])

    def _rewritten(self, text: str) -> str:
        if not text.isascii():  # canonical decomposition: an accented letter is its letter and its accents, in one order
            text = unicodedata.normalize("NFD", text)
        if self.longer and self.longer.search(text):
            out, at = [], 0
            for end, (size, best) in self.automaton.iter_long(text):
                out += [text[at : end + 1 - size], best]
                at = end + 1
            text = "".join([*out, text[at:]])
        if self.ascii_moves or not text.isascii():
            text = unicodedata.normalize("NFD", text.translate(self.singles))
        return text

    def display(self, skeleton: str) -> str:
        """The skeleton for reading: each word in one script, accents composed. A function of the skeleton alone."""
        if not skeleton.isascii():
            votes = {s: len(p.findall(skeleton)) for s, p in self.only.items()}
            main = max(votes, key=lambda s: (votes[s], s == "Latin"))

            def one(m: regex.Match) -> str:
                word = m[0]
                mine = [s for s, p in self.only.items() if p.search(word)]
                return word.translate(self.back[mine[0] if len(mine) == 1 else main])

            if self.ascii_moves or votes["Cyrillic"] or votes["Greek"]:
                skeleton = self.words.sub(one, skeleton)
            skeleton = unicodedata.normalize("NFC", skeleton)
        return skeleton


def code_point_counts(texts: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How often each member of a class occurs in all texts. Counted per batch, summed in Spark; as many rows as the classes have code points."""
    watched = np.array(sorted({ord(c) for g in look_alikes()[0] for x in g for c in x}), np.uint32)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            joined = "".join(t for t in batch["text"] if t)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(codes):
                held = np.bincount(codes)
                total[: len(held)] += held
        at = watched[total[watched] > 0]
        yield pd.DataFrame({"code": at.astype("int32"), "n": total[at]})

    rows = texts.select(F.col(text_col).alias("text")).mapInPandas(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {chr(r["code"]): r["n"] for r in rows.collect()}


def unify(records: DataFrame, keys: list[str], text_col: str, with_text: bool = True) -> DataFrame:
    """(keys..., look_key, text_key, text): each record's text in the one consistent form.

    look_key is a 128-bit hash of the rewritten text, equal for records that look the same; text_key one of the text as it is.
    Null text gives null in all three columns; texts without any visible sign have a null look_key. Repeated rows are kept.
    Nothing is shuffled but the counts of code points. Other columns are ignored.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*keys).schema)
    counts = code_point_counts(records, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewriter = Rewriter(counts)
        for batch in batches:
            rows = []
            for *key, text in batch.itertuples(index=False, name=None):
                if text is None:
                    rows.append((*key, None, None, None))
                    continue
                skeleton = rewriter.skeleton(text)
                look = xxhash.xxh3_128_digest(skeleton.encode("utf-8", "surrogatepass")) if skeleton.strip() else None
                rows.append((*key, look, xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")), rewriter.display(skeleton) if with_text else None))
            yield pd.DataFrame(rows, columns=[*keys, "look_key", "text_key", "text"])

    return records.select(*keys, F.col(text_col)).mapInPandas(run, schema + ", look_key binary, text_key binary, text string")


#: Rows of a group of one look that one task joins with the rows of other spellings.
PART = 4_096


def look_members(unified: DataFrame, scope: str, id_col: str) -> DataFrame:
    """(scope, id, look_key, text_key, size, links, common, parts): the records of looks with several texts.

    size is the number of records of the look, links that of records with another text, common the text that most of them
    have, parts the number of parts into which a large group is cut. One row a record, whatever the number of links. Texts are
    rewritten once: the keys are written to the shared folder and read from there.
    """
    rows = cut_lineage(unified.where(F.col("look_key").isNotNull()).select(scope, id_col, "look_key", "text_key").distinct())
    texts = rows.groupBy(scope, "look_key", "text_key").agg(F.count("*").alias("copies"))
    groups = texts.groupBy(scope, "look_key").agg(F.sum("copies").alias("size"), F.count("*").alias("_texts"), F.max(F.struct("copies", "text_key"))["text_key"].alias("common")).where(F.col("_texts") > 1).drop("_texts")
    counted = texts.join(groups, [scope, "look_key"])
    members = rows.join(counted, [scope, "look_key", "text_key"])
    return members.select(scope, id_col, "look_key", "text_key", "size", (F.col("size") - F.col("copies")).alias("links"), "common", F.ceil(F.col("size") / PART).cast("int").alias("parts"))


def same_look_pairs(unified: DataFrame, scope: str, id_col: str) -> DataFrame:
    """(scope, a_id, b_id): pairs of records of one scope with equal look and different texts, the smaller id first.

    Groups of exact copies take no part: only looks with several texts go on. The records of a look are cut into parts of
    about PART, and each part meets the records of the rarer spellings only, so a text that a third of all rows share and one
    variant cost one pass over these rows. Records without visible text give none. look_members() is the form of bounded size.
    """
    held = look_members(unified, scope, id_col)
    part = F.pmod(F.xxhash64(id_col), "parts").cast("int")
    a = held.select(scope, "look_key", part.alias("part"), F.col(id_col).alias("x"), F.col("text_key").alias("x_text"), (F.col("text_key") == F.col("common")).alias("x_common"))
    rarer = held.where(F.col("text_key") != F.col("common"))
    b = rarer.select(scope, "look_key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(id_col).alias("y"), F.col("text_key").alias("y_text"))
    pairs = a.join(b, [scope, "look_key", "part"]).where((F.col("x_text") != F.col("y_text")) & (F.col("x_common") | (F.col("x") < F.col("y"))))
    return pairs.where(F.col("x") != F.col("y")).select(scope, F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).distinct()
