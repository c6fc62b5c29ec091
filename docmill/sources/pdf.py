"""Text blocks of PDF files with the standard library alone: objects, Flate streams, simple and composite fonts with ToUnicode maps.

What is read is the text that content streams show, with its place and size. Encrypted files, scanned pages and fonts without
any mapping to characters give no text; they are told apart by the error column, not by an exception.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Most bytes of a stream after inflation; a file with a larger one is an error, not cut.
MOST_BYTES = 64 * 1024 * 1024
_token = re.compile(rb"<<|>>|\[|\]|/[^\s/<>\[\](){}%]*|<[0-9A-Fa-f\s]*>|\(|[^\s/<>\[\](){}%]+|%[^\r\n]*")
_object = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The number of an object that stands elsewhere."""


class Name(str):
    """A name, without its slash."""


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Tokens from a place on, with the place after each: names, numbers, strings (bytes), and operators and brackets as text."""
    while m := _token.search(data, at):
        at, t = m.end(), m[0]
        if t == b"(":
            out, depth = bytearray(), 1
            while at < len(data) and depth:
                c = data[at : at + 1]
                at += 1
                if c == b"\\":
                    e = data[at : at + 1]
                    at += 1
                    if e in b"01234567" and e:
                        octal = re.match(rb"[0-7]{1,2}", data[at : at + 2])
                        digits = e + (octal[0] if octal else b"")
                        at += len(digits) - 1
                        out.append(int(digits, 8) & 255)
                    elif e in b"\r\n":
                        at += e == b"\r" and data[at : at + 1] == b"\n"
                    else:
                        out += _escapes.get(e, e)
                    continue
                depth += (c == b"(") - (c == b")")
                if depth:
                    out += c
            yield bytes(out), at
        elif t.startswith(b"%"):
            continue
        elif t.startswith(b"/"):
            yield Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1")), at
        elif t.startswith(b"<") and t != b"<<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            yield bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
        else:
            try:
                yield float(t) if b"." in t else int(t), at
            except ValueError:
                yield t.decode("latin-1"), at


def value(data: bytes, at: int = 0) -> tuple[object, int]:
    """One value (dictionary, array, reference, number, ...) and the place after it."""
    stack: list[list] = [[]]
    kinds: list[str] = []
    for t, at in tokens(data, at):
        if t in ("<<", "["):
            stack.append([])
            kinds.append(str(t))
            continue
        if t in (">>", "]") and kinds:
            items = stack.pop()
            kinds.pop()
            stack[-1].append(dict(zip(items[::2], items[1::2])) if t == ">>" else items)
        elif t == "R" and len(stack[-1]) >= 2:
            stack[-1][-2:] = [Ref(stack[-1][-2])]
        elif t in ("endobj", "stream") and not kinds:
            break
        else:
            stack[-1].append({"true": True, "false": False, "null": None}.get(t, t) if isinstance(t, str) and not isinstance(t, Name) else t)
        if not kinds and stack[0] and isinstance(stack[0][0], (dict, list)):
            break
    return (stack[0][-1] if stack[0] else None), at


class File:
    """The objects of a PDF, found by scanning, so that damaged cross-reference tables don't matter."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5].startswith(b"%PDF"):
            raise ValueError("not a PDF")
        self.data, self.places = data, {int(m[1]): m.end() for m in _object.finditer(data)}
        self.packed: dict[int, object] = {}
        self.cache: dict[int, object] = {}
        for n in list(self.places):
            o = self.get(Ref(n))
            if isinstance(o, dict) and o.get("Type") == "ObjStm":
                body, first = self.stream(Ref(n)), int(self.get(o.get("First")) or 0)
                head = [int(x) for x in re.findall(rb"\d+", body[:first])]
                for number, offset in zip(head[::2], head[1::2]):
                    self.packed.setdefault(number, value(body, first + offset)[0])
        trailers = [value(data, m.end())[0] for m in re.finditer(rb"\btrailer\b", data)]
        self.trailers = [t for t in trailers if isinstance(t, dict)] + [o for n in self.places if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "XRef"]
        if any("Encrypt" in t for t in self.trailers):
            raise ValueError("encrypted")

    def get(self, o):
        """The value itself, following references."""
        for _ in range(32):
            if not isinstance(o, Ref):
                return o
            n = int(o)
            if n not in self.cache:
                self.cache[n] = value(self.data, self.places[n])[0] if n in self.places else self.packed.get(n)
            o = self.cache[n]
        return None

    def stream(self, ref) -> bytes:
        """The decoded bytes of a stream object; empty where it isn't one or has an unknown filter."""
        if not isinstance(ref, Ref) or int(ref) not in self.places:
            return b""
        head, at = value(self.data, self.places[int(ref)])
        m = re.compile(rb"\s*stream\r?\n?").match(self.data, at)
        if not isinstance(head, dict) or not m:
            return b""
        length = self.get(head.get("Length"))
        end = m.end() + length if isinstance(length, int) and self.data[m.end() + length : m.end() + length + 20].lstrip().startswith(b"endstream") else self.data.find(b"endstream", m.end())
        body = self.data[m.end() : end if end >= 0 else len(self.data)]
        filters = self.get(head.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if f != "FlateDecode":
                return b""
            inflater = zlib.decompressobj()
            body = inflater.decompress(body, MOST_BYTES)
            if inflater.unconsumed_tail:
                raise ValueError(f"a stream holds more than {MOST_BYTES} bytes")
        parms = self.get(head.get("DecodeParms"))
        parms = self.get(parms[0]) if isinstance(parms, list) and parms else parms
        if isinstance(parms, dict) and int(parms.get("Predictor", 1)) >= 10:
            body = _unpredict(body, int(parms.get("Columns", 1)) * int(parms.get("Colors", 1)) * int(parms.get("BitsPerComponent", 8)) // 8)
        return body

    def pages(self) -> list[dict]:
        """The pages in order; where the tree is broken, in the order of their objects."""
        out: list[dict] = []
        seen: set[int] = set()

        def walk(o, inherited: dict) -> None:
            node = self.get(o)
            if not isinstance(node, dict) or id(node) in seen:
                return
            seen.add(id(node))
            own = {**inherited, **{k: node[k] for k in ("Resources", "MediaBox") if k in node}}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, own)
            else:
                out.append({**own, **node})

        for t in reversed(self.trailers):
            root = self.get(t.get("Root"))
            if isinstance(root, dict) and not out:
                walk(root.get("Pages"), {})
        return out or [o for n in sorted({*self.places, *self.packed}) if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Page"]


def _unpredict(data: bytes, width: int) -> bytes:
    """PNG prediction undone, for rows of `width` bytes with one byte of depth."""
    out, last = bytearray(), bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            a, b, c = (row[i - 1] if i else 0), last[i], (last[i - 1] if i else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[i] = (row[i] + (0, a, b, (a + b) // 2, paeth)[kind if kind < 5 else 0]) & 255
        out += row
        last = row
    return bytes(out)


def unicode_map(cmap: bytes) -> tuple[dict[bytes, str], int]:
    """A ToUnicode map: codes to text, and the bytes of a code."""
    table: dict[bytes, str] = {}
    mode, held = "", []
    text = lambda b: b.decode("utf-16-be", "replace")
    for t, _ in tokens(cmap):
        if isinstance(t, str) and not isinstance(t, Name) and t.startswith(("begin", "end")):
            if t == "endbfchar":
                table |= {a: text(b) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            mode, held = t, []
            continue
        if mode == "beginbfrange":
            held.append(t)
            if held[-1] == "]" and "[" in held or len(held) == 3 and isinstance(t, bytes):
                low, high = held[0], held[1]
                if isinstance(low, bytes) and isinstance(high, bytes) and int.from_bytes(high) - int.from_bytes(low) < 65_536:
                    for i, code in enumerate(range(int.from_bytes(low), int.from_bytes(high) + 1)):
                        if held[2] == "[":
                            to = held[3 + i] if 3 + i < len(held) - 1 else b""
                        else:
                            to = (int.from_bytes(held[2]) + i).to_bytes(len(held[2]) or 2)
                        if isinstance(to, bytes):
                            table[code.to_bytes(len(low))] = text(to)
                held = []
        else:
            held.append(t)
    return table, max(map(len, table), default=1)


def _times(a: list[float], b: list[float]) -> list[float]:
    """The product of two matrices of six numbers."""
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def shown(file: File, page: dict) -> list[tuple[float, float, float, str]]:
    """(x, y, size, text) of each piece of text that a page shows, in the order of its stream."""
    resources = file.get(page.get("Resources")) or {}
    fonts: dict[str, tuple[dict[bytes, str], int]] = {}
    for name, ref in (file.get(resources.get("Font")) or {}).items():
        font = file.get(ref) or {}
        to = font.get("ToUnicode")
        table, width = unicode_map(file.stream(to)) if isinstance(to, Ref) else ({}, 1)
        fonts[name] = table, (2 if font.get("Subtype") == "Type0" else width if table else 1)
    contents = page.get("Contents")
    listed = file.get(contents)
    body = b"\n".join(file.stream(r) for r in (listed if isinstance(listed, list) else [contents]))
    out: list[tuple[float, float, float, str]] = []
    unit = [1.0, 0, 0, 1, 0, 0]
    ctm, saved, tm, line, leading, size = unit, [], unit, unit, 0.0, 0.0
    table, width = {}, 1
    args: list = []

    def show(raw: bytes) -> None:
        text = "".join(table.get(raw[i : i + width], "") for i in range(0, len(raw), width)) if table else raw.decode("cp1252", "replace") if width == 1 else ""
        m = _times(tm, ctm)
        if text:
            out.append((m[4], m[5], size * (m[2] ** 2 + m[3] ** 2) ** 0.5, text))

    def move(x: float, y: float) -> None:
        nonlocal tm, line
        line = _times([1, 0, 0, 1, x, y], line)
        tm = line

    array: list | None = None
    for t, _ in tokens(body):
        if t == "[":
            array = []
        elif t == "]" and array is not None:
            args.append(array)
            array = None
        elif array is not None:
            array.append(t)
        elif not isinstance(t, str) or isinstance(t, Name):
            args.append(t)
        else:
            numbers = [float(a) for a in args if isinstance(a, (int, float))]
            if t == "q":
                saved.append(ctm)
            elif t == "Q" and saved:
                ctm = saved.pop()
            elif t == "cm" and len(numbers) == 6:
                ctm = _times(numbers, ctm)
            elif t == "BT":
                tm = line = unit
            elif t == "Tf" and args and numbers:
                table, width = fonts.get(str(args[0]), ({}, 1))
                size = numbers[-1]
            elif t == "TL" and numbers:
                leading = numbers[-1]
            elif t in ("Td", "TD") and len(numbers) >= 2:
                leading = -numbers[1] if t == "TD" else leading
                move(numbers[0], numbers[1])
            elif t == "Tm" and len(numbers) == 6:
                tm = line = numbers
            elif t in ("T*", "'", '"'):
                move(0, -leading)
            if t in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
                show(args[-1])
            elif t == "TJ" and args and isinstance(args[-1], list):
                spaced = b"".join(a if isinstance(a, bytes) else b"" for a in args[-1])
                if width == 1 and not table:  # wide gaps between letters stand for blanks
                    spaced = b"".join(a if isinstance(a, bytes) else b" " if isinstance(a, (int, float)) and a < -180 else b"" for a in args[-1])
                show(spaced)
            args = []
    return out


def page_blocks(file: File, page: dict) -> list[tuple[float, str, float, int]]:
    """(top, text, largest font size, lines) of the blocks of a page: pieces of one height are a line, lines close together and of like size a block."""
    box = file.get(page.get("MediaBox")) or [0, 0, 612, 792]
    height = float(file.get(box[3])) if len(box) == 4 else 792.0
    lines: list[list] = []
    for x, y, size, text in sorted(shown(file, page), key=lambda p: (-round(p[1]), p[0])):
        if lines and abs(lines[-1][0] - y) <= max(2.0, 0.3 * size):
            lines[-1][1].append(text)
            lines[-1][2] = max(lines[-1][2], size)
        else:
            lines.append([y, [text], size])
    blocks: list[list] = []
    for y, parts, size in lines:
        text = re.sub(r"\s+", " ", "".join(p if p.endswith(" ") or i + 1 == len(parts) else p + (" " if len(p) > 1 else "") for i, p in enumerate(parts))).strip()
        if not text:
            continue
        last = blocks[-1] if blocks else None
        if last and abs(last[2] - size) < 0.6 and last[4] - y <= 1.5 * max(size, 1):
            last[1].append(text)
            last[4] = y
        else:
            blocks.append([height - y - size, [text], size, 0, y])
    return [(top, "\n".join(t), size, len(t)) for top, t, size, _, _ in blocks]


BLOCKS = "file string, page_number int, ordinal int, text string, max_font_size double, top double, line_count int, error string"


def blocks(files: DataFrame) -> DataFrame:
    """The text blocks of PDF files (path, content), in the form that docmill.operators.structure takes.

    A file that can't be read, or has no text, gives one row without text and with the error; filter on it. Null content is an
    error. Row by row, no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        for batch in batches:
            rows = []
            for path, data in batch.itertuples(index=False, name=None):
                own = []
                try:
                    file = File(bytes(data or b""))
                    for number, page in enumerate(file.pages(), 1):
                        for top, text, size, lines in page_blocks(file, page):
                            own.append((path, number, len(own) + 1, text, round(size, 2), round(top, 2), lines, None))
                    error = None if own else "no text"
                except Exception as failure:  # noqa: BLE001 - one bad file must not end the scan
                    error = f"{type(failure).__name__}: {failure}"
                rows += own if error is None else [(path, 0, 0, None, None, None, None, error)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def page_texts(data: bytes, limit: int) -> tuple[int, list[str]]:
    """(number of pages, text of the first `limit` pages)."""
    file = File(data)
    pages = file.pages()
    return len(pages), ["\n".join(text for _, text, _, _ in page_blocks(file, p)) for p in pages[:limit]]
