"""Personal data in texts, disguised or not, at the places of the original characters.

Plain identifiers are found in the text as it is. Besides, transducers rewrite it - characters that look like
others, digits that are spelled as words, `at` and `dot` in brackets or between blanks - and keep for each
character of what they write the place that it comes from. Identifiers that are found in the rewritten text
are mapped back and added where they cover no identifier of the same kind.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm.common import map_rows, small_batches, table

#: Kinds in the order in which spans of equal start are listed, and what replaces them.
KINDS = ("email", "ip", "card", "phone")

# An address is found from its @: what may precede it is taken up to the last character that can't.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may stand before an @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Characters and what they look like.
LOOKS = str.maketrans(
    {
        **dict(zip("асеорхуіјѕԁ", "aceopxyijsd", strict=True)),
        **dict(zip("АВСЕНКМОРТХІЈЅ", "ABCEHKMOPTXIJS", strict=True)),
        **dict(zip("οανρι", "oavpi", strict=True)),
        **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX", strict=True)),
        "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ",
        **{chr(0xFF01 + k): chr(0x21 + k) for k in range(94)},
        **{chr(0x0660 + k): str(k) for k in range(10)},
        **{chr(0x06F0 + k): str(k) for k in range(10)},
        **{chr(0x0966 + k): str(k) for k in range(10)},
        **{chr(0x1D7CE + k): str(k % 10) for k in range(50)},
    }
)
LOOKING = re.compile("[" + re.escape("".join(map(chr, LOOKS))) + "]")
INVISIBLE = re.compile("[​‌‍⁠﻿­]")
#: Digits as words, by language.
SPELLED = {
    **{w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine".split())},
    "oh": "0",
    **{w: str(k) for k, w in enumerate("null eins zwei drei vier fünf sechs sieben acht neun".split())},
    **{w: str(k) for k, w in enumerate("zéro un deux trois quatre cinq six sept huit neuf".split())},
    **{w: str(k) for k, w in enumerate("cero uno dos tres cuatro cinco seis siete ocho nueve".split())},
}
DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
DOT_NAME = "dot|point|punkt|punto"
#: What runs of spelled digits are made of, and what may stand between.
SPELLING = re.compile(rf"(?<!\w)(?:(?P<word>{DIGIT_WORD})|(?P<dot>{DOT_NAME})|(?P<plus>plus)|(?P<digits>[0-9]+))(?!\w)", re.IGNORECASE)
BETWEEN, BEFORE_FIGURES = re.compile(r"[\s,.-]*"), re.compile(r"[\s-]*")
#: Digit words in a row, after at least one more digit or digit word, that make a run.
IN_A_ROW = 3
ANY_DIGIT_WORD = re.compile(rf"\b(?:{DIGIT_WORD})[\s,.-]+(?:{DIGIT_WORD})[\s,.-]+(?:{DIGIT_WORD})\b", re.IGNORECASE)
BRACKETED = re.compile(r"(?:\[\s*(?P<a>at|@|dot|\.)\s*\]|\(\s*(?P<b>at|@|dot|\.)\s*\)|\{\s*(?P<c>at|@|dot|\.)\s*\}|<\s*(?P<d>at|@|dot|\.)\s*>)\s*", re.IGNORECASE)
#: Words that `at` or `dot` between blanks stand beside in sentences; a host with one of them as a label isn't an address.
PROSE = "a|an|the|this|that|these|those|of|in|on|to|is|was|are|and|or|but|by|for|from|my|your|his|her|its|our|their|each|every|any|no|one|it|which|what|where|with|as|at|dot"
LABEL = rf"(?!(?:{PROSE})\b)[A-Za-z0-9-]+"
SPACED = re.compile(rf"(?<=[A-Za-z0-9])(?P<at>[ _]+at[ _]+)(?P<host>{LABEL}(?:(?:[ _]+dot[ _]+|\.){LABEL})*[ _]+dot[ _]+(?!(?:{PROSE})\b)[A-Za-z]{{2,24}}(?![A-Za-z0-9-]))", re.IGNORECASE)
DOT_WORD = re.compile(r"(?<![ _])[ _]+dot[ _]+", re.IGNORECASE)
AROUND_AT = re.compile(r"(?<=[A-Za-z0-9])[ \t]+@[ \t]*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[ \t]+(?=[A-Za-z0-9])")
#: What may stand in the part before an @, and a host whose labels are joined by dots or dot words.
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
HOST_DOTS = re.compile(r"(?<=[A-Za-z0-9._%+-]@)[A-Za-z0-9-]+(?:(?:[ _]+dot[ _]+|\.)[A-Za-z0-9-]+)+", re.IGNORECASE)
#: Four numbers, in figures or in up to three digit words each, between dots or dot words.
IP_SIGN = re.compile(rf"(?<![ _])[ _]+(?:{DOT_NAME})[ _]+(?:[0-9]|(?:{DIGIT_WORD})\b)", re.IGNORECASE)
IP_NUMBER = rf"(?:[0-9]+|(?:{DIGIT_WORD})(?:[ -]+(?:{DIGIT_WORD})){{0,2}})"
IP_DOT = rf"(?:[ _]+(?:{DOT_NAME})[ _]+|\.)"
IP_WORDS = re.compile(rf"(?:(?<![0-9])(?=[0-9])|(?<!\w)(?=[^\W0-9_])){IP_NUMBER}(?:{IP_DOT}{IP_NUMBER}){{3}}(?![^\W0-9_])", re.IGNORECASE)
IP_PART = re.compile(rf"(?P<figures>[0-9]+)|(?P<dot>[ _]+(?:{DOT_NAME})[ _]+|\.)|(?P<word>{DIGIT_WORD})|(?P<gap>[ -]+)", re.IGNORECASE)


def emails(text: str) -> Iterator[tuple[int, int]]:
    if "@" not in text:
        return
    done = 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = [ord(c) - 48 for c in m.group() if c.isdigit()] if m.end() - m.start() <= 40 else []
        if 12 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[d] for d in digits[-2::-2])) % 10 == 0:
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" not in text:
        return
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones), strict=True))


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of identifiers in the text as it is, leftmost and without overlap for each kind."""
    return sorted((a, b, k) for k, kind in enumerate(KINDS) for a, b in FINDERS[kind](text))


class Rewritten:
    """A text after transducers; `start[i]` and `end[i]` bound what its character i comes from."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Replaces stretches, given in order; each character written stands for all of its stretch."""
        if not changes:
            return
        start = self.start or list(range(len(self.text)))
        end = self.end or list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for a, b, new in changes:
            text += (self.text[at:a], new)
            starts += start[at:a]
            ends += end[at:a]
            if b > a:
                starts += [start[a]] * len(new)
                ends += [end[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end = starts + start[at:], ends + end[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def bracket_changes(text: str) -> Iterator[tuple[int, int, str]]:
    """Signs in brackets, with the blanks around them, to plain signs."""
    done = 0
    for m in BRACKETED.finditer(text):
        start = m.start()
        while start > done and text[start - 1].isspace():
            start -= 1
        done = m.end()
        yield start, done, "@" if (m["a"] or m["b"] or m["c"] or m["d"]).lower() in ("at", "@") else "."


def spelled_runs(text: str) -> Iterator[list[re.Match]]:
    """Runs of digits and digit words, in one pass; a sign word may lead a run, dot words may stand inside."""
    run: list[re.Match] = []
    for m in SPELLING.finditer(text):
        joined = run and (BEFORE_FIGURES if m["digits"] else BETWEEN).fullmatch(text, run[-1].end(), m.start())
        if joined and not m["plus"]:
            if not (m["dot"] and run[-1]["plus"]):
                run.append(m)
                continue
        yield run
        run = [] if m["dot"] else [m]
    yield run


def digit_changes(text: str) -> Iterator[tuple[int, int, str]]:
    """Spelled digits to figures, one change a word; what stands between goes."""
    for run in spelled_runs(text):
        row = best = 0
        for m in run[1 + bool(run and run[0]["plus"]) :]:
            row = row + 1 if m["word"] else 0
            best = max(best, row)
        if best < IN_A_ROW:
            continue
        for last, m in zip([None, *run], run, strict=False):
            if last is not None and m.start() > last.end():
                yield last.end(), m.start(), "." if text[last.end() : m.start()].strip() == "." else ""
            if not m["digits"]:
                yield *m.span(), "+" if m["plus"] else "." if m["dot"] else SPELLED[m["word"].lower()]


def local_changes(text: str) -> list[tuple[int, int, str]]:
    """Dot words of the part before an @ to dots; taken from the right, as only the last one meets the @."""
    changes, after, joined = [], len(text), False
    for d in reversed(list(DOT_WORD.finditer(text))):
        run = LOCAL_RUN.match(text, d.end(), after)
        joined = run is not None and (joined if run.end() == after else text[run.end()] == "@")
        after = d.start()
        if joined and LOCAL_RUN.match(text, max(0, after - 1), after):
            changes.append((*d.span(), "."))
    return changes[::-1]


def ip_changes(text: str) -> Iterator[tuple[int, int, str]]:
    """Four numbers between dot words to figures and dots."""
    for m in IP_WORDS.finditer(text):
        if not IP_SIGN.search(text, *m.span()):
            continue
        for p in IP_PART.finditer(text, m.start(), m.end()):
            new = p["figures"] or (SPELLED[p["word"].lower()] if p["word"] else "." if p["dot"] else "")
            if new != p.group():
                yield *p.span(), new


def deobfuscated(text: str) -> Rewritten | None:
    """The text after all transducers; None if none of them finds anything."""
    out = Rewritten(text)
    if not text.isascii():
        if INVISIBLE.search(text):
            out.replace([(*m.span(), "") for m in INVISIBLE.finditer(out.text)])
        if LOOKING.search(out.text):
            start, end = out.start, out.end
            out.text = out.text.translate(LOOKS)
            out.start, out.end = start or list(range(len(out.text))), end or list(range(1, len(out.text) + 1))
    if any(c in out.text for c in "[({<"):
        out.replace(list(bracket_changes(out.text)))
    lower = out.text.lower()
    if "dot" in lower and "at" in lower:
        changes = []
        for m in SPACED.finditer(out.text):
            changes.append((*m.span("at"), "@"))
            changes += [(*d.span(), ".") for d in DOT_WORD.finditer(out.text, *m.span("host"))]
        out.replace(changes)
    if " @" in out.text or "@ " in out.text:
        out.replace([(*m.span(), "@") for m in AROUND_AT.finditer(out.text)])
    if "@" in out.text and "dot" in lower:
        out.replace(local_changes(out.text))
        out.replace([(*d.span(), ".") for m in HOST_DOTS.finditer(out.text) for d in DOT_WORD.finditer(out.text, *m.span())])
    if ANY_DIGIT_WORD.search(out.text):
        out.replace(list(digit_changes(out.text)))
    if IP_SIGN.search(out.text):
        out.replace(list(ip_changes(out.text)))
    return None if out.start is None else out


def all_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Plain spans and those that only the rewritten text shows."""
    new = deobfuscated(text)
    if new is None:
        return plain
    spans = list(plain)
    for k, kind in enumerate(KINDS):
        starts, ends = ([s[c] for s in plain if s[2] == k] for c in (0, 1))
        for a, b in FINDERS[kind](new.text):
            a, b = new.source(a, b)
            if bisect.bisect_right(ends, a) == bisect.bisect_left(starts, b):  # those before it end before it
                spans.append((a, b, k))
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += (text[at:a], f"[{KINDS[k].upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): all identifiers of each text.

    `spans` lists kind:start:end, code points with end exclusive, by start, then kind; the counts are of these.
    `base_sha256` digests the same list of the identifiers that aren't disguised. Null text is empty; a row for
    each input row, repeated ones too; extra columns are ignored. One pass without a shuffle.
    """

    def make() -> Callable:
        def f(rows: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {"doc_id": rows[doc_id], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
            for t in rows[text]:
                plain = plain_spans(t or "")
                spans = all_spans(t or "", plain)
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[2] == k for s in spans))
                out["base_sha256"].append(hashlib.sha256(listed(plain).encode()).hexdigest())
                out["spans"].append(listed(spans))
            return out

        return f

    return map_rows(docs, [doc_id, text], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with identifiers in `text` replaced by their kinds; null stays null, and rows and other columns stay."""

    def make() -> Callable:
        return lambda rows: {text: [None if t is None else masked(t, all_spans(t, plain_spans(t))) for t in rows[text]]}

    return map_rows(docs, [text], f"`{text}` string", make, keep=True).select(*(F.col(f"`{c}`") for c in docs.columns))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return find(table(spark, sf_dir, "documents"))
