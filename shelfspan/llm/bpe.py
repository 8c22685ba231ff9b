"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table, counts at every prefix.

A merge list orders pairs by rank. Two neighbouring tokens can stand side by side in an encoding exactly
when merging the concatenation of their texts gives those two tokens back; an encoding is right exactly
when all its neighbours are compatible. So no merge loop is needed:

* `Encoder.encode_piece` takes the longest vocabulary match (one Aho-Corasick pass gives the longest match
  from each byte), keeps it if it is compatible with the token before it, and otherwise tries the next
  shorter one or steps back. A position from which no encoding leads on is never entered twice, so the
  work is linear in the piece.
* `Encoder.prefix_counts` fills, for each prefix, the only last token that is compatible with the last
  token of the shorter prefix, and with it the exact token count of that prefix.
* `Encoder.decode` gathers token bytes from one blob through an offset table.

Pieces are split off as the byte-level pre-tokeniser does; strings of added tokens are cut out first.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json

import ahocorasick
import numpy as np
import regex

#: Fixed value: the split pattern of byte-level pre-tokenisation.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLANK = regex.compile(r"\s")
BLANKS = regex.compile(r"\s*")
#: Entries that a table of remembered pieces or pairs holds before it starts afresh; bounds a worker's memory.
REMEMBERED = 100_000
#: Tokens that are decoded at a time.
DECODE_BLOCK = 1 << 16


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, to the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Remembered(dict):
    """A dict that computes what is missing and forgets everything once it holds `limit` entries.

    Keys of over LONGEST_KEY characters or items are computed anew each time.
    """

    LONGEST_KEY = 200

    def __init__(self, compute, limit: int = REMEMBERED):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if isinstance(key, int) or len(key) <= self.LONGEST_KEY:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Tables of one vocabulary file (`tokenizers` JSON with a byte-level BPE model)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        model = spec["model"]
        as_bytes = lambda t: bytes(to_byte[c] for c in t).decode("latin-1")
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if t not in self.added}
        size = max([*self.ids.values(), *self.added.values()]) + 1
        texts = [b""] * size
        for t, i in self.ids.items():
            texts[i] = t.encode("latin-1")
        for t, i in self.added.items():
            texts[i] = t.encode("utf-8")
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.length = [len(t) for t in texts]
        #: (left, right) -> rank and the merged token; halves[t] is the merge that made t, None for a byte.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, both = (self.ids[as_bytes(t)] for t in (a, b, a + b))
            self.merge[left, right] = (r, both)
            if self.halves[both] is None:
                self.halves[both], self.rank[both] = (left, right), r
        self.matcher = ahocorasick.Automaton()
        for t in self.ids:
            self.matcher.add_word(t, len(t))
        self.matcher.make_automaton()
        self.compatible = Remembered(self._compatible)
        self.shorter = Remembered(self._shorter, limit=size)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging the two tokens' joint text leaves just this boundary.

        Undo the two tokens' merges from the latest rank down. Whenever the parts that touch at the
        boundary could merge at a rank that comes before the merges undone so far, they would have.
        """
        left, right = pair
        undone = len(self.merge) + 1
        rank, halves, merge = self.rank, self.halves, self.merge
        while True:
            got = merge.get((left, right))
            if got is not None and got[0] < undone:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            # At equal rank the left one merges first, so the right one is undone first.
            if a > b:
                undone, left = a, halves[left][1]
            else:
                # A pair over the boundary of the same rank starts further left, so it too comes before this merge.
                undone, right = b + 1, halves[right][0]

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        text = bytes(self.blob[self.offsets[token] : self.offsets[token + 1]]).decode("latin-1")
        return next((self.ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.ids), -1)

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one pre-token."""
        text = piece.encode("utf-8").decode("latin-1")
        ids = self.ids
        if text in ids:
            return [ids[text]]
        n = len(text)
        longest = [1] * n
        for end, size in self.matcher.iter(text):  # by ascending end: the last one to start here is the longest
            longest[end - size + 1] = size
        compatible, shorter, length = self.compatible, self.shorter, self.length
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, ids[text[: longest[0]]]
        while True:
            while token >= 0 and (at + length[token] in dead or (out and not compatible[out[-1], token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                if at == n:
                    return out
                token = ids[text[at : at + longest[at]]]
            else:
                dead.add(at)
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def prefix_counts(self, piece: str) -> list[int]:
        """Token counts of a pre-token's prefixes by characters, from the empty one to the whole."""
        text = piece.encode("utf-8").decode("latin-1")
        n = len(text)
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for end, size in self.matcher.iter(text):
            ending[end + 1].append(size)
        ids, compatible = self.ids, self.compatible
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for size in ending[end]:
                token, before = ids[text[end - size : end]], last[end - size]
                if end == size or compatible[before, token]:
                    last[end], count[end] = token, count[end - size] + 1
                    break
        return [0, *(count[i] for i in range(1, n + 1) if i == n or not 0x80 <= ord(text[i]) < 0xC0)]

    def segments(self, text: str):
        """(pre-tokens, added token or None) pairs, in order."""
        if self.cut is None or not any(a in text for a in self.added):
            yield SPLIT.findall(text), None
            return
        at = 0
        for m in self.cut.finditer(text):
            yield SPLIT.findall(text[at : m.start()]), m.group()
            at = m.end()
        yield SPLIT.findall(text[at:]), None

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, gathered through the offset table block by block."""
        out = []
        for k in range(0, len(ids), DECODE_BLOCK):
            block = ids[k : k + DECODE_BLOCK]
            start = self.offsets[block]
            size = self.offsets[block + 1] - start
            shift = np.repeat(start - (np.cumsum(size) - size), size)
            out.append(self.blob[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)


@functools.cache
def load(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


class PrefixTokens:
    """Exact token counts of every prefix of one text, without encoding any prefix.

    The table has two levels: the count before each pre-token, for all of them, and the counts inside a
    pre-token (`Encoder.prefix_counts`) for those in which a prefix is cut. A prefix has the pre-tokens of
    the whole text that end inside it, and the beginning of one more, but in three places: white space that
    the prefix cuts off becomes one pre-token (tables of such runs are kept as well), and contractions or
    strings of added tokens that are cut in two are split again, a few characters each.
    """

    def __init__(self, encoder: Encoder, text: str, sizes: Remembered | None = None):
        """`sizes` remembers the token counts of whole pre-tokens from text to text."""
        self.encoder, self.text = encoder, text
        self.sizes = sizes if sizes is not None else sizes_of(encoder)
        self.starts, self.before, self.added = [], [], []
        at = total = 0
        for pieces, added in encoder.segments(text):
            self.starts += itertools.accumulate(map(len, pieces), initial=at)
            self.before += itertools.accumulate(map(self.sizes.__getitem__, pieces), initial=total)
            at, total = self.starts.pop(), self.before.pop()
            if added is not None:
                self.added.append(len(self.starts))
                self.starts.append(at)
                self.before.append(total)
                at += len(added)
                total += 1
        self.total = total
        self.tables: dict[int, list[int]] = {}

    def _is_added(self, k: int) -> bool:
        i = bisect.bisect_left(self.added, k)
        return i < len(self.added) and self.added[i] == k

    def _end(self, k: int) -> int:
        return self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)

    def _inside(self, start: int, end: int) -> list[int]:
        """Token counts of the beginnings of text[start:end], which is one pre-token."""
        if start not in self.tables:
            self.tables[start] = self.encoder.prefix_counts(self.text[start:end])
        return self.tables[start]

    def count(self, chars: int) -> int:
        """Tokens of text[:chars] encoded on its own."""
        text = self.text
        chars = min(chars, len(text))
        if chars <= 0:
            return 0
        if chars == len(text):
            return self.total
        k = bisect.bisect_left(self.starts, chars) - 1  # the pre-token that holds the last character
        if self._is_added(k):
            if chars == self._end(k):
                return self.before[k] + 1
            k = max(0, k - 1) if not self._is_added(k - 1) else k
            while k and not self._is_added(k - 1) and BLANK.match(text[self.starts[k]]) and BLANK.match(text[self.starts[k] - 1]):
                k -= 1
            return self.before[k] + sum(map(self.sizes.__getitem__, SPLIT.findall(text[self.starts[k] : chars])))
        start = self.starts[k]
        if BLANK.match(text[chars - 1]):
            while k and not self._is_added(k - 1) and BLANK.match(text[self.starts[k - 1]]) and BLANK.match(text[self.starts[k] - 1]):
                k -= 1
            start = self.starts[k]
            return self.before[k] + self._run(k)[chars - start]
        if chars == self._end(k):
            return self.before[k] + self.sizes[text[start:chars]]
        if text[start] == "'" and chars - start < 3:
            return self.before[k] + sum(map(self.sizes.__getitem__, SPLIT.findall(text[start:chars])))
        return self.before[k] + self._inside(start, self._end(k))[chars - start]

    def _run(self, k: int) -> list[int]:
        """Token counts of the beginnings of the blanks from pre-token k on, each of which is one pre-token where a prefix ends."""
        start = self.starts[k]
        if ~start not in self.tables:
            stop, i = BLANKS.match(self.text, start).end(), bisect.bisect_left(self.added, k)
            if i < len(self.added):
                stop = min(stop, self.starts[self.added[i]])
            self.tables[~start] = self.encoder.prefix_counts(self.text[start:stop])
        return self.tables[~start]

    def fit(self, limit: int) -> int:
        """Characters of the longest prefix that has at most `limit` tokens."""
        if self.total <= limit:
            return len(self.text)
        k = bisect.bisect_right(self.before, limit) - 1
        last = min(k + 3, len(self.starts))
        while last < len(self.starts) and BLANK.match(self.text[self.starts[last]]):
            last += 1
        end = self.starts[last] if last < len(self.starts) else len(self.text)
        return next((c for c in range(end, 0, -1) if self.count(c) <= limit), 0)


def sizes_of(encoder: Encoder) -> Remembered:
    """Token counts of whole pre-tokens."""
    return Remembered(lambda p: len(encoder.encode_piece(p)))
