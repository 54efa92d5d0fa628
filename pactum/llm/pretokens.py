"""The splitting step of a byte-level BPE, vectorised over whole columns.

The pattern is the public one of the vocabulary file: contractions, then letters, numbers or other signs with
an optional space before them, then white space, whose last character is left to what follows.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

from pactum.llm.buffers import ranges, span_hashes

SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
#: The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = classes()
    out = np.where(data < 0x80, table[:128][data & 0x7F], np.uint8(OTHER))
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        n = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        code = data[lead].astype(np.int64) & np.array([0, 0, 0x1F, 0x0F, 0x07])[n]
        for j in range(1, 4):
            has = n > j
            code[has] = (code[has] << 6) | (data[lead[has] + j] & 0x3F)
        kind = table[code]
        for j in range(4):
            has = n > j
            out[lead[has] + j] = kind[has]
    return out


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the pretokens, and for each text its first one's number (one more entry than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = byte_classes(data)
    white = kind <= WHITE
    group = np.maximum(kind, WHITE)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    same = np.zeros(n, bool)  # as the byte before, in the same text
    same[1:] = (group[1:] == group[:-1]) & ~first[1:n]
    start = ~same
    # a run of white space before something else leaves its last character, a space going with what follows
    after = np.flatnonzero(start & ~white & ~first[:n])
    after = after[white[after - 1]]
    last = after - 1
    while len(far := np.flatnonzero((data[last] & 0xC0) == 0x80)):  # to the first byte of that character
        last[far] -= 1
    start[last] = True
    start[after[kind[after - 1] == SPACE]] = False
    # contractions, where an apostrophe begins a pretoken
    quote = np.flatnonzero(start & (data == 39))
    if len(quote):
        tail = np.zeros(n + 3, np.uint8)
        tail[:n] = data
        stop = offsets[np.searchsorted(offsets, quote, side="right")]
        a = np.where(quote + 1 < stop, tail[quote + 1], 0)
        b = np.where(quote + 2 < stop, tail[quote + 2], 0)
        one = np.isin(a, [115, 116, 109, 100])  # 's 't 'm 'd
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # 're 've 'll
        start[quote[one | two] + 1] = False
        for at, size in ((quote[one], 2), (quote[two & ~one], 3)):
            at = at + size
            at = at[at < n]
            # what follows begins a pretoken; white space keeps what was found for it
            start[at] = True
    starts = np.flatnonzero(start)
    return starts, np.diff(np.r_[starts, n]), np.searchsorted(starts, offsets)


class Vocabulary:
    """Ids, byte strings and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        # the printable stand-ins for bytes: printable Latin-1 stands for itself, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        stand_in = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        spell = lambda s: bytes(stand_in[c] for c in s)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.ids = {spell(s): i for s, i in file["model"]["vocab"].items() if s not in self.special}
        self.strings: list[bytes] = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for s, i in self.ids.items():
            self.strings[i] = s
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        spelled = [(spell(a), spell(b)) for a, b in pairs]
        #: (left id, right id) -> (rank, id of both together)
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(spelled)}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memo:
    """What was worked out for each distinct pretoken: arrays laid end to end, found by the pretoken's hash.

    It holds about ``limit`` pretokens and is emptied when it is full, so its memory is bounded.
    """

    def __init__(self, solve, limit: int = 400_000):
        self.solve, self.limit = solve, limit
        self.clear()

    def clear(self):
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used, self.begin, self.size = np.zeros(1 << 16, np.int32), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """A slot for each pretoken, into begin and size."""
        if len(self.hashes) > self.limit:
            self.clear()
        found, rows, back = np.unique(span_hashes(data, starts, lens), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == found[inside]
        new = np.flatnonzero(~known)
        if len(new):
            body = data.tobytes()
            s = starts[rows[new]]
            answers = self.solve([body[a:b] for a, b in zip(s.tolist(), (s + lens[rows[new]]).tolist())])
            size = np.fromiter(map(len, answers), np.int64, len(new))
            total = int(size.sum())
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.int32)])
            self.flat[self.used : self.used + total] = [i for x in answers for i in x]
            slots = len(self.size) + np.arange(len(new))
            self.begin = np.concatenate([self.begin, self.used + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.used += total
            self.hashes = np.insert(self.hashes, at[new], found[new])
            self.slots = np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.hashes, found)
        return self.slots[at][back]


class Encoder:
    """Ids of whole columns: each distinct pretoken goes to ``solve`` once, special strings to their own ids.

    ``solve`` takes a list of pretokens (bytes) and gives a sequence of integers for each.
    """

    def __init__(self, special: dict[bytes, int], solve, limit: int = 400_000):
        self.special = special
        self.memo = Memo(self._solve, limit)
        self.inner = solve

    def _solve(self, words: list[bytes]):
        out = self.inner(words)
        for i, w in enumerate(words):
            if w in self.special:
                out[i] = [self.special[w]]
        return out

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pretokens and special strings begin, and their lengths."""
        spans = self._special_spans(data, offsets)
        starts, lens, _ = pretokens(data, np.union1d(offsets, np.asarray(spans, np.int64).ravel()) if spans else offsets)
        if spans:
            a, b = np.asarray(spans, np.int64).T
            inside = np.searchsorted(a, starts, side="right") - 1
            keep = (inside < 0) | (starts >= b[inside]) | (starts == a[inside])
            starts = starts[keep]
            lens = np.diff(np.r_[starts, len(data)])
        return starts, lens

    def solved(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``solve`` gave for the pretokens, end to end, and how much for each."""
        slots = self.memo.look_up(data, starts, lens) if len(starts) else np.zeros(0, np.int64)
        size = self.memo.size[slots]
        return self.memo.flat[ranges(self.memo.begin[slots], size)], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``solve`` gave for each text's pretokens, end to end, and where each text begins in it."""
        starts, lens = self.split(data, offsets)
        ids, size = self.solved(data, starts, lens)
        return ids, np.r_[0, np.cumsum(size)][np.searchsorted(starts, offsets)]

    def _special_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        body, out = data.tobytes(), []
        if not any(s in body for s in self.special):
            return out
        pattern = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        for m in pattern.finditer(body):
            if offsets[np.searchsorted(offsets, m.start(), side="right")] >= m.end():
                out.append(m.span())
        return out
