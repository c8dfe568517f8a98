"""Personal data, also where it is disguised: text is normalised with a map back to its characters, and searched in both forms."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The runs below begin where no earlier character continues them, which is where a leftmost search finds them, too.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of local@domain.tld, looked for from each @: the local part is the whole run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            # what precedes this @ can't be part of a later local part
            end = at + 1
            at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start; code points, end exclusive."""
    out = list(emails(text))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(g := p.lstrip("0")) <= 3 and int(g or 0) <= 255 for p in m.groups())]
    out += [("card", *m.span()) for m in CARD.finditer(text) if len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


#: Letters of other scripts that look like ASCII ones. Full-width and styled forms follow from Unicode's compatibility mapping.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ո": "n", "м": "m", "к": "k", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "٠": "0", "١": "1", "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9",
}
#: Characters without width.
BLANK = set("­​‌‍⁠﻿")
NUMBERS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
WORDS = "|".join(NUMBERS)
#: One disguised piece for each alternative: at signs, dots, and runs of spelled digits.
TOKENS = re.compile(
    rf"""(?P<at>\s*[\[({{<]\s*(?:at|@)\s*[\])}}>]\s*|\s+at\s+(?=[A-Za-z0-9-]+(?:\s*[\[({{<]\s*(?:dot|\.)\s*[\])}}>]\s*|\s+dot\s+)[A-Za-z0-9])|&\#64;|&commat;|%40|(?<=[A-Za-z0-9])_at_(?=[A-Za-z0-9]))
    |(?P<dot>\s*[\[({{<]\s*(?:dot|\.)\s*[\])}}>]\s*|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9])|&\#46;|&period;|(?<=[A-Za-z0-9])_dot_(?=[A-Za-z0-9]))
    |(?P<num>\b(?:{WORDS})(?:[\s,-]+(?:{WORDS}))+\b)""",
    re.X | re.I,
)
#: What a text with any disguise holds; others aren't transduced.
HINT = re.compile(rf"[\[({{<]\s*(?:at|@|dot|\.)\s*[\])}}>]|\sdot\s|_(?:at|dot)_|&\#(?:64|46);|&commat;|&period;|%40|\b(?:{WORDS})[\s,-]+(?:{WORDS})\b", re.I)
NUMBER = re.compile(WORDS, re.I)


@lru_cache(maxsize=1)
def fold() -> tuple[dict[str, str], re.Pattern]:
    """Characters that are normalised one by one, and a pattern of them."""
    table = dict(LOOKALIKES) | {c: "" for c in BLANK}
    for c in map(chr, [*range(0x2070, 0x209F), *range(0x2460, 0x24FF), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]):
        n = unicodedata.normalize("NFKC", c)
        if len(n) == 1 and n.isascii():
            table[c] = n
    return table, re.compile("[" + "".join(map(re.escape, table)) + "]")


_ASCII = bytes(range(128))


def folds(text: str) -> bool:
    """Whether the text holds a character that is normalised. What isn't ASCII is little of most texts, and is taken out of the bytes before it is looked at."""
    if text.isascii():
        return False
    rest = text.encode("utf-8", "surrogatepass").translate(None, _ASCII).decode("utf-8", "surrogatepass")
    return not fold()[0].keys().isdisjoint(set(rest))


def normalise(text: str) -> tuple[str, list[int], list[int]]:
    """The text without disguises, and for each of its characters the source characters [start, end) that it stands for.

    First a transducer over single characters (lookalikes, widthless ones), then one over words (at, dot, spelled digits).
    """
    table, chars = fold()
    out, start, end, at = [], [], [], 0
    for m in chars.finditer(text):
        out.append(text[at : m.start()])
        start += range(at, m.start())
        if c := table[m[0]]:
            out.append(c)
            start.append(m.start())
        at = m.end()
    out.append(text[at:])
    start += range(at, len(text))
    flat = "".join(out)
    end = [s + 1 for s in start]
    out, lo, hi, at = [], [], [], 0

    def put(piece: str, a: int, b: int) -> None:
        out.append(piece)
        lo.extend([start[a]] * len(piece))
        hi.extend([end[b - 1]] * len(piece))

    for m in TOKENS.finditer(flat):
        out.append(flat[at : m.start()])
        lo += start[at : m.start()]
        hi += end[at : m.start()]
        if m["num"]:
            for w in NUMBER.finditer(flat, *m.span()):
                put(NUMBERS[w[0].lower()], *w.span())
        else:
            put("@" if m["at"] else ".", *m.span())
        at = m.end()
    out.append(flat[at:])
    return "".join(out), lo + start[at:], hi + end[at:]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by kind as listed, then start. Spans found in the normalised text come in unless they are equal to a base span of their kind or lie in one."""
    base = base_spans(text)
    if not (folds(text) or HINT.search(text)):
        return base, base
    flat, lo, hi = normalise(text)
    added = []
    for kind, s, e in base_spans(flat):
        a, b = lo[s], hi[e - 1]
        if not any(k == kind and x <= a and b <= y for k, x, y in base):
            added.append((kind, a, b))
    return base, sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if added else base


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_<kind>..., base_sha256, spans) per row; null texts count as empty, repeated rows stay."""

    def run(batches):
        for b in batches:
            rows = [find(t.as_py() or "") for t in b.column(1)]
            n = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], type=pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), *n, sha, pa.array([digest(x) for _, x in rows])], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return batched(docs).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def redact_text(text: str) -> str:
    """Each maximal covered stretch becomes <KIND> of its first span."""
    spans = sorted(find(text)[1], key=lambda x: (x[1], -x[2]))
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the found spans replaced in the text; every column and row stays, a null text stays null."""

    def run(batches):
        for b in batches:
            k = b.schema.get_field_index(text_col)
            new = pa.array([None if (t := x.as_py()) is None else redact_text(t) for x in b.column(k)], type=pa.string())
            yield b.set_column(k, b.schema.field(k).with_type(pa.string()), new)

    return batched(docs).mapInArrow(run, docs.schema)


def op7_pii(docs: DataFrame) -> DataFrame:
    """The contract's row per document. Null texts count as empty and hold nothing; rows of null or repeated ids are returned each; extra columns are ignored."""
    return detect(docs)
