"""Byte-level BPE ids by the tokenizers library, with a cache of pre-tokens.

A text is cut at its spaces, each distinct unit into the pre-tokens that the vocabulary's
own pattern gives; each distinct pre-token is encoded once by the library's model and the
ids of a text are gathered by numpy. Texts with characters beyond U+024F, or with a special token's string, go to the library whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

#: Letters, numbers and white space up to U+024F, for the pattern of the byte-level pre-tokenizer.
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = r" \t-\r\x85\xa0"
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
BEYOND = re.compile("[^\\x00-\\u024f]")
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


#: Characters up to U+024F and the mark in the byte-level alphabet; plain characters aren't in it.
WRITTEN = {i: x for i in [*range(0x250), 0x2FF] if (x := "".join(ALPHABET[b] for b in chr(i).encode())) != chr(i)}


class Units(dict):
    """unit -> number, in order of first sight."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.fresh.append(unit)
        n = self[unit] = len(self)
        return n


#: Marks, beyond the plain characters, of a unit without the space before it.
BARE = "\u02ff"


class Encoder:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False).ids does.

    Plain texts are cut at single spaces: a space before another character always begins a
    pre-token, so what stands between two spaces can be encoded by itself. Beyond most_units
    only units seen twice or more are kept.
    """

    def __init__(self, path: str, most_units: int = 500_000):
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), most_units
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.stops = {p: self.piece(p) for p in ".,"}
        self.clear()

    def clear(self) -> None:
        self.units, self.known = Units(), 0
        self.flat, self.starts, self.seen = np.zeros(1 << 16, np.uint32), np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)

    def shrink(self) -> None:
        """Only units seen twice or more stay; none if these are too many, too."""
        names = [u for u, n in self.units.items() if self.seen[n] > 1]
        old = [(u, self.flat[self.starts[n] : self.starts[n + 1]]) for u in names if (n := self.units[u]) < self.known]
        self.clear()
        if 0 < len(old) <= self.most // 2:
            self.units.update((u, i) for i, (u, _) in enumerate(old))
            self.add([x for _, x in old])

    def add(self, ids: list) -> None:
        """Ids of the next units."""
        n, at = np.fromiter(map(len, ids), np.int64, len(ids)), int(self.starts[self.known])
        size = at + int(n.sum())
        while len(self.flat) < size:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.starts) <= self.known + len(ids):
            self.starts, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.seen))
        self.flat[at:size] = np.fromiter(chain.from_iterable(ids), np.uint32, size - at)
        self.starts[self.known + 1 : self.known + 1 + len(ids)] = at + np.cumsum(n)
        self.known += len(ids)

    def piece(self, p: str) -> list[int]:
        """Ids of one pre-token."""
        return [x.id for x in self.model.tokenize(p.translate(WRITTEN))]

    def unit(self, u: str) -> list[int]:
        """Ids of a unit."""
        if u[0] == BARE:
            return [i for p in SPLIT.findall(u[1:]) for i in self.piece(p)]
        if u[-1] in ".," and u[:-1].isalpha():
            return self.piece(" " + u[:-1]) + self.stops[u[-1]]
        return [i for p in SPLIT.findall(" " + u) for i in self.piece(p)]

    def encode_flat(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts side by side, each with end_id after it if one is given, and each text's number of ids."""
        if len(self.units) > self.most:
            self.shrink()
        get, numbers, whole, sizes = self.units.__getitem__, [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if not t.isascii() and BEYOND.search(t) or any(s in t for s in self.special):
                numbers.append(np.array([-1 - len(whole)]))
                whole.append(self.whole.encode(t, add_special_tokens=False).ids)
            elif "  " in t or t[:1] == " " or t[-1:] == " " or not t:
                numbers.append(np.fromiter(map(get, [BARE + p for p in SPLIT.findall(t)]), np.int64))
            else:
                parts = t.split(" ")
                parts[0] = BARE + parts[0]
                numbers.append(np.fromiter(map(get, parts), np.int64, len(parts)))
            sizes[i] = len(numbers[-1])
        model, space, fresh = self.model.tokenize, ALPHABET[32], []
        for u in self.units.fresh:
            word, stop = (u[:-1], self.stops[u[-1]]) if u[-1:] in self.stops else (u, [])
            if word.isalpha():
                fresh.append([x.id for x in model(space + (word if word.isascii() else word.translate(WRITTEN)))] + stop)
            else:
                fresh.append(self.unit(u))
        self.units.fresh.clear()
        if fresh:
            self.add(fresh)
        # whole texts and the end are units of this call only
        known = self.known
        self.add([*whole, [] if end_id is None else [end_id]])
        w = np.concatenate([x for n in numbers for x in (n, END)] or [END])
        w = np.where(w == END[0], self.known - 1, np.where(w < 0, known - 1 - w, w))
        self.seen[:known] += np.bincount(w[w < known], minlength=known).astype(np.int32)
        n = self.starts[w + 1] - self.starts[w]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[w] - (upto - n), n) + np.arange(upto[-1])] if len(texts) else np.zeros(0, np.uint32)
        self.known = known
        self.starts[known + 1 :] = 0
        ends = upto[np.cumsum(sizes + 1) - 1] if len(texts) else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, n = self.encode_flat(texts)
        return np.split(ids, np.cumsum(n)[:-1]) if len(texts) else []


#: Stands for the end of a text among the numbers of units.
END = np.array([np.iinfo(np.int64).min])


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]
