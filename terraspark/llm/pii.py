"""Personal data in texts, in plain and in disguised form, with spans in source characters.

Base spans: e-mail addresses, IPv4 addresses, payment card numbers (Luhn) and
international phone numbers, by fixed patterns over the text as it is.

Added spans: a chain of transducers rewrites the text - look-alike letters and
digits of other scripts and invisible characters to ASCII, spelled digits to
digits, "[at]"/"(dot)"-like disguises to signs - and keeps for every rewritten
piece where it stood. The same patterns run over the result; a span found there
is mapped back to source characters and added unless it meets a base span of its
kind. A piece that is rewritten counts as one source unit: spans cover it whole.

Null texts count as empty; both have no spans. Every row gives one row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits starts: the look-behind changes no match, and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    if "." not in text:
        return
    for m in IP.finditer(text):
        # parts may have thousands of digits: only what leading zeros leave is read as a number
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans by kind: leftmost, not overlapping within a kind; failing matches are dropped, not retried."""
    return {kind: list(f(text)) for kind, f in FINDERS.items()}


# Look-alike characters and the ASCII character each stands for.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "в": "b", "к": "k", "м": "m", "т": "t", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3", "з": "3", "б": "6",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "․": ".", "。": ".", "．": ".", "｡": ".", "·": ".", "•": ".", "∙": ".", "⋅": ".", "‚": ",",
    "＠": "@", "﹫": "@", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "－": "-", "﹣": "-", "＿": "_",
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ", "（": "(", "）": ")",
}
# Characters that are not seen.
INVISIBLE = "­͏᠎​‌‍⁠⁡⁢⁣⁤﻿"
# Digits spelled in the corpus languages.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _single(c: str) -> str | None:
    """What a character of another script stands for: by table, by the blocks of wide and styled letters, or as a decimal digit."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in INVISIBLE:
        return ""
    n = ord(c)
    if n < 128:
        return None
    if 0xFF01 <= n <= 0xFF5E:
        return chr(n - 0xFEE0)
    if c.isdecimal():
        return str(int(c))
    if 0x1D400 <= n <= 0x1D6A3:  # styled letters come in runs of 52
        k = (n - 0x1D400) % 52
        return chr(ord("A") + k) if k < 26 else chr(ord("a") + k - 26)
    if 0x24D0 <= n <= 0x24E9:
        return chr(ord("a") + n - 0x24D0)
    if 0x24B6 <= n <= 0x24CF:
        return chr(ord("A") + n - 0x24B6)
    if 0x2460 <= n <= 0x2468:
        return str(n - 0x245F)
    return "0" if n == 0x24EA else None


ODD = re.compile("[^\x00-\xbe\xc0-ɏ]|[ ­·ı]")
_W = "|".join(sorted(SPELLED, key=len, reverse=True))
SPELLED_HINT = re.compile(rf"(?<![^\W_])(?:{_W})(?![^\W_])", re.IGNORECASE)
SPELLED_PART = re.compile(rf"(?<![^\W_])(?:(double|triple)\s+)?({_W}|[0-9]|dot|point|plus|dash|hyphen|minus)(?![^\W_])", re.IGNORECASE)
SPELLED_SIGN = {"dot": ".", "point": ".", "plus": "+", "dash": "-", "hyphen": "-", "minus": "-"}

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
#: "[at]", "(dot)", "{a}": a disguise by its brackets. Blanks around it are added by ``_signs``, so that long runs of them stay linear.
MARK = re.compile(rf"{_OPEN}\s*+(?:(at|arroba|@|ät|a|chez)|dot|punkt|point|punto|\.|d0t)\s*+{_CLOSE}", re.IGNORECASE)
# Last labels that make bare words "name at host dot label" an address, beside those of two letters.
LABELS = "com|org|net|edu|gov|mil|int|info|biz|example|test|dev|app|online|site|mail|email"
#: Bare words only as a whole address with a spelled dot; up to eight parts on either side.
WORDED = re.compile(
    rf"(?<![A-Za-z0-9._%+@-])([A-Za-z0-9_%+-]+(?:(?:\.|\s+dot\s+)[A-Za-z0-9_%+-]+){{0,7}})(\s+(?:at|arroba)\s+)"
    rf"([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){{0,7}}(?:\s+(?:dot|punkt|punto|point)\s+[A-Za-z0-9-]+){{0,7}}\s+(?:dot|punkt|punto|point)\s+(?:{LABELS}|(?!of|in|is|it|to|on|as|at|by|an|or|be|he|we|so|no|if|la|le|el|un|er|en)[a-z]{{2}}))(?![A-Za-z0-9])",
    re.IGNORECASE,
)
WORDED_DOT = re.compile(r"(?<!\s)\s++(?:dot|punkt|punto|point)\s++", re.IGNORECASE)
#: "name @ host . tld": spaces around the signs.
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\s+@\s+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\s+@(?=[A-Za-z0-9-]+\.)|(?<=[A-Za-z0-9])@\s+(?=[A-Za-z0-9-]+\.)")
SPACED_DOT = re.compile(r"(?<!\s)\s++\.\s*+|\.\s++")
AFTER_SPACED = re.compile(r"(?:[A-Za-z0-9-]+\s*\.\s*)+(?:com|org|net|edu|gov|io|de|fr|es|eu|uk|info|example)\b", re.IGNORECASE)


class Rewritten:
    """A text made from another by replacements, with the source span of every character."""

    def __init__(self, text: str):
        self.text = text
        #: Start of each piece here, its start and end in the source; a piece of equal length maps one to one.
        self.at, self.source, self.same = [0], [(0, len(text))], [True]

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """changes: (start, end, new) of this text, in order, not overlapping."""
        if not changes:
            return
        out: list[str] = []
        at: list[int] = []
        source: list[tuple[int, int]] = []
        same: list[bool] = []
        n = done = 0

        def keep(a: int, b: int) -> None:
            nonlocal n
            while a < b:
                k = bisect_right(self.at, a) - 1
                end = min(b, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                s, e = self.source[k]
                at.append(n)
                if self.same[k]:
                    source.append((s + a - self.at[k], s + end - self.at[k]))
                else:
                    source.append((s, e))
                same.append(self.same[k])
                out.append(self.text[a:end])
                n += end - a
                a = end

        for a, b, new in changes:
            keep(done, a)
            if new:
                at.append(n)
                source.append((self.back(a, a + 1)[0], self.back(b - 1, b)[1]))
                same.append(False)
                out.append(new)
                n += len(new)
            done = b
        keep(done, len(self.text))
        self.text = "".join(out)
        self.at, self.source, self.same = at or [0], source or [(0, 0)], same or [True]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of the characters start..end-1."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.source[i][0] + (start - self.at[i] if self.same[i] else 0)
        b = self.source[j][0] + (end - self.at[j]) if self.same[j] else self.source[j][1]
        return a, b


def _fold(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in ODD.finditer(text) if (new := _single(m[0])) is not None]


def _despell(text: str) -> list[tuple[int, int, str]]:
    """Runs of at least four digits, two or more of them spelled, to digits and signs."""
    out: list[tuple[int, int, str]] = []
    if not SPELLED_HINT.search(text):
        return out
    parts = list(SPELLED_PART.finditer(text))
    i = 0
    while i < len(parts):
        j = i
        while j + 1 < len(parts) and len(gap := text[parts[j].end() : parts[j + 1].start()]) <= 3 and not gap.strip(" \t.,()_/-+\n"):
            j += 1
        run = parts[i : j + 1]
        while run and run[-1][2].lower() in SPELLED_SIGN:
            run.pop()
        n = sum({"double": 2, "triple": 3}.get((p[1] or "").lower(), 1) for p in run if p[2].lower() not in SPELLED_SIGN)
        if n >= 4 and sum(p[2].lower() in SPELLED for p in run) >= 2:
            for k, p in enumerate(run):
                word = p[2].lower()
                new = SPELLED_SIGN.get(word) or SPELLED.get(word, word) * {"double": 2, "triple": 3}.get((p[1] or "").lower(), 1)
                # blanks around a spelled sign or between two spelled digits go with the word before
                end = p.end()
                if k + 1 < len(run) and not text[end : run[k + 1].start()].strip():
                    end = run[k + 1].start()
                out.append((p.start(), end, new))
        i = j + 1
    return out


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Bracketed signs with the blanks around them; blanks between two of them go with the first."""
    out: list[tuple[int, int, str]] = []
    done = 0
    for m in MARK.finditer(text):
        a, b = m.span()
        while a > done and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        out.append((a, b, "@" if m[1] else "."))
        done = b
    return out


def _words(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in WORDED.finditer(text):
        out += [(m.start(1) + d.start(), m.start(1) + d.end(), ".") for d in WORDED_DOT.finditer(m[1])]
        out.append((*m.span(2), "@"))
        out += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in WORDED_DOT.finditer(m[3])]
    if "@" in text:
        # what is changed so far lies in order and apart, and so does what is added: no host holds a sign
        taken, added = sorted(out), []
        inside = lambda spans, at: (k := bisect_right(spans, at, key=lambda s: s[0])) > 0 and at < spans[k - 1][1]
        for m in SPACED_AT.finditer(text):
            if (t := AFTER_SPACED.match(text, m.end())) and not inside(taken, m.start()) and not inside(added, m.start()):
                added.append((m.start(), m.end(), "@"))
                added += [(t.start() + d.start(), t.start() + d.end(), ".") for d in SPACED_DOT.finditer(t[0])]
        out += added
    return sorted(out)


MIXED_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?:\s++(?:dot|punkt|punto|point)\s++[A-Za-z0-9-]++)++", re.IGNORECASE)
MIXED_DOT = re.compile(r"(?<=[A-Za-z0-9])\s+(?:dot|punkt|punto|point)\s+(?=[A-Za-z0-9])", re.IGNORECASE)


def _mixed(text: str) -> list[tuple[int, int, str]]:
    """A spelled dot in the host of an address whose sign is there already."""
    out = []
    at = text.find("@")
    while at >= 0:
        if m := MIXED_HOST.match(text, at + 1):
            out += [(m.start() + d.start(), m.start() + d.end(), ".") for d in MIXED_DOT.finditer(m[0])]
            at = m.end() - 1
        at = text.find("@", at + 1)
    return out


def normalise(text: str) -> Rewritten | None:
    """The text after all transducers, or None if none of them changes it."""
    r = Rewritten(text)
    if not text.isascii():
        r.replace(_fold(text))
    if DIGIT_WORD.search(r.text):
        r.replace(_despell(r.text))
    for step in (_signs, _words, _mixed):
        if step is _signs and not BRACKETED.search(r.text):
            continue
        if step is not _signs and "@" not in r.text and not WORD_DOT.search(r.text):
            continue
        r.replace(step(r.text))
    return r if r.text != text else None


DIGIT_WORD = re.compile(rf"(?<![^\W_])(?:{_W})[ \t.,()_/-]{{1,3}}(?:double\s+|triple\s+)?(?:{_W}|[0-9]|dot|point|plus)(?![^\W_])", re.IGNORECASE)
BRACKETED = re.compile(rf"{_OPEN}\s*(?:at|arroba|@|ät|a|chez|dot|d0t|punkt|point|punto|\.)\s*{_CLOSE}", re.IGNORECASE)
WORD_DOT = re.compile(r"\s(?:dot|punkt|punto|point)\s", re.IGNORECASE)


def find_added(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the rewritten text shows, in source characters; none meets a base span of its kind."""
    added: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if (r := normalise(text)) is None:
        return added
    for kind, spans in find(r.text).items():
        taken = base[kind]
        starts = [a for a, _ in taken]
        for span in spans:
            a, b = r.back(*span)
            k = bisect_right(starts, a)
            if not (k and taken[k - 1][1] > a or k < len(taken) and taken[k][0] < b):
                added[kind].append((a, b))
    return added


def digest_text(spans: dict[str, list[tuple[int, int]]]) -> str:
    rows = sorted((a, KINDS.index(kind), b) for kind, found in spans.items() for a, b in found)
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone: base spans; base, spans: kind:start:end,...; n_added)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = find(text)
                added = find_added(text, base)
                both = {k: base[k] + added[k] for k in KINDS}
                rows.append([*(len(base[k]) for k in KINDS), digest_text(base), digest_text(both), sum(map(len, added.values()))])
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")


def mask(text: str | None) -> str | None:
    """The text with every found span replaced by its kind in angle brackets; overlapping spans are masked as one."""
    if not text:
        return text
    base = find(text)
    added = find_added(text, base)
    spans = sorted((a, b, kind) for kind in KINDS for a, b in base[kind] + added[kind])
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``; texts masked, and their length put right where such a column is given."""
    names = docs.columns
    # by position, so that clashing or odd names cannot matter
    at = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            texts = [mask(v.as_py()) for v in cols[at]]
            cols[at] = pa.array(texts, cols[at].type)
            if length is not None:
                cols[length] = pa.array([v.as_py() if t is None else len(t) for t, v in zip(texts, cols[length], strict=True)], cols[length].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
