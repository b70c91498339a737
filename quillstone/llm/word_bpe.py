"""Token ids of a word-level byte-pair vocabulary, many words at a time.

In such a vocabulary white space is dropped and no token crosses it, so a text's ids are those of its words put
end to end. Parts of words are told apart by 64-bit hashes. Those seen before come from a bounded store; new ones of
ASCII and Latin-1 letters are merged together in numpy, one merge of every word a step; anything else goes through the
tokenizer library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
from quillstone.llm.common import LOWER, span_hashes, word_spans

#: Of each byte: 0 white space, 1 part of a letter, 2 digit, 3 other printable, 4 not handled here.
_KIND = np.full(256, 4, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[0x80:0xC0] = _KIND[0xC3] = 1
_ONE = np.frombuffer(b"stmd", np.uint8)
_TWO = np.array([a << 8 | b for a, b in (b"re", b"ve", b"ll")])
_NONE = np.int32(1 << 30)
_LONGEST = 24


def _byte_symbols() -> list[str]:
    """The usual printable stand-in of each byte: itself where printable, else the next free character from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordBpe:
    """ids(words) for one vocabulary file; ``most`` bounds the words remembered."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        self.path, self.most = path, most
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        symbols = _byte_symbols()
        self._inner = np.array([vocab[s] for s in symbols], np.int32)
        self._final = np.array([vocab[s + "</w>"] for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._table(np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64))
        self._known = _Store()
        self._library = None

    def _table(self, keys: np.ndarray) -> None:
        self._bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._rank = np.full(1 << self._bits, _NONE, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self._keys[slot] == -1
            at, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self._keys[at], self._rank[at] = keys[won], won
            lost = ~np.isin(left, won)
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or _NONE."""
        keys = a.astype(np.int64) << 16 | b
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._rank[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self._bits) - 1)
            found = self._keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self._rank[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _merge(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, given as bytes (words, length): ids (words, length) and how many of each count."""
        n, size = words.shape
        s = self._inner[words]
        s[:, -1] = self._final[words[:, -1]]
        out, used = s.copy(), np.full(n, size)
        if size == 1:
            return out, used
        rows, live = np.arange(n), np.full(n, size)
        r = self._ranks(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(n, size - 1)
        while len(rows):
            width = r.shape[1]
            j = r.argmin(1)
            best = r[np.arange(len(rows)), j]
            go = best < _NONE
            if not go.all():
                done = rows[~go]
                out[done, : s.shape[1]] = s[~go]
                used[done] = live[~go]
                rows, live, s, r, j, best = rows[go], live[go], s[go], r[go], j[go], best[go]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            cols = np.arange(width)[None, :]
            later = cols >= j[:, None] + 1
            s[:, 1:-1] = np.where(later[:, 1:], s[:, 2:], s[:, 1:-1])
            s[at, j] = self._merged[best]
            s = s[:, :-1]
            live -= 1
            if width == 1:
                out[rows, :1], used[rows] = s, live
                break
            r = np.where(later[:, : width - 1], r[:, 1:], r[:, :-1])
            left, right = np.flatnonzero(j > 0), np.flatnonzero(j < live - 1)
            r[left, j[left] - 1] = self._ranks(s[left, j[left] - 1], s[left, j[left]])
            if len(right):
                r[right, j[right]] = self._ranks(s[right, j[right]], s[right, j[right] + 1])
            end = np.flatnonzero(j >= live - 1)
            end = end[j[end] < r.shape[1]]
            r[end, j[end]] = _NONE
        return out, used

    def _whole(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, odd: np.ndarray) -> None:
        """Adds the ids of spans not known yet."""
        size = ends - starts
        slow = odd | (size > _LONGEST)
        for k in np.flatnonzero(slow):
            self._known.add(hashes[k : k + 1], self._whole(data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")), np.array([-1]))
        for n in np.unique(size[~slow]):
            at = np.flatnonzero(~slow & (size == n))
            ids, used = self._merge(data[starts[at][:, None] + np.arange(n)])
            self._known.add(hashes[at], ids[np.arange(n) < used[:, None]], used)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and the offsets of the rows in them."""
        data, starts, ends, row, odd = spans(data, off)
        hashes = span_hashes(data, starts, ends)
        hashes[odd] ^= np.uint64(0x5555555555555555)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        entry = self._known.find(unique)
        if (entry < 0).any():
            if len(self._known) + len(unique) > self.most:
                self._known = _Store()
                entry[:] = -1
            new = first[entry < 0]
            self._learn(data, starts[new], ends[new], hashes[new], odd[new])
            entry = self._known.find(unique)
        at, n = self._known.at[entry][back], self._known.n[entry][back]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._known.ids[np.repeat(at - (ends - n), n) + np.arange(total)]
        per_row = np.bincount(row, weights=n, minlength=len(off) - 1).astype(np.int64) if len(row) else np.zeros(len(off) - 1, np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_row)))


class _Store:
    """Hash of a span -> its ids: an open-addressed table over growing arrays."""

    def __init__(self) -> None:
        self._bits = 12
        self._slots = np.full(1 << self._bits, -1, np.int32)
        self._size = 0
        self._hashes, self.at, self.n = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.ids, self._used = np.zeros(1 << 12, np.uint16), 0

    def __len__(self) -> int:
        return self._size

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - self._bits)).astype(np.int64)
        while len(left):
            entry = self._slots[slot]
            there = entry >= 0
            same = there & (self._hashes[entry] == hashes[left])
            out[left[same]] = entry[same]
            more = there & ~same
            left, slot = left[more], (slot[more] + 1) & ((1 << self._bits) - 1)
        return out

    def _enter(self, entries: np.ndarray) -> None:
        left = entries
        slot = (self._hashes[left] >> np.uint64(64 - self._bits)).astype(np.int64)
        while len(left):
            free = self._slots[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            won = left[free][first]
            self._slots[at] = won
            lost = ~np.isin(left, won)
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self._bits) - 1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """New hashes with their ids end to end; n: ids of each, or -1 for all of them."""
        n = np.where(n < 0, len(ids), n)
        size, used = self._size + len(hashes), self._used + len(ids)
        while size > len(self._hashes):
            self._hashes, self.at, self.n = (np.concatenate((x, np.zeros_like(x))) for x in (self._hashes, self.at, self.n))
        while used > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        ends = np.cumsum(n)
        self._hashes[self._size : size], self.n[self._size : size] = hashes, n
        self.at[self._size : size] = self._used + ends - n
        self.ids[self._used : used] = ids
        entries = np.arange(self._size, size)
        self._size, self._used = size, used
        if 2 * size > len(self._slots):
            while 2 * size > 1 << self._bits:
                self._bits += 1
            self._slots = np.full(1 << self._bits, -1, np.int32)
            entries = np.arange(size)
        self._enter(entries)


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and the spans whose ids stand for themselves: start, end, row, and whether the library must encode it.

    A word, that is a run between ASCII white space, of printable ASCII and Latin-1 letters is cut where the
    vocabulary's pattern cuts it: letters, single digits, runs of other characters, and 's 't 're 've 'm 'll 'd where
    the apostrophe begins such a run. Any other word is one span, left to the library.
    """
    first, last, row = word_spans(data, off)
    if not len(first):
        return data, first, last, row, np.zeros(0, bool)
    kind = _KIND[data]
    prior = np.concatenate((np.zeros(1, np.uint8), data[:-1]))
    strange = kind == 4
    second = prior == 0xC3
    strange |= (data >= 0x80) & (data < 0xC0) & (~second | (data == 0x97) | (data == 0xB7))
    strange[1:] |= (data[1:] == 0x7C) & (data[:-1] == 0x3C)
    odd_word = np.add.reduceat(np.append(strange, False), first, dtype=np.int64) > 0 if strange.any() else np.zeros(len(first), bool)
    low = LOWER[data]
    low[second & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 0x20
    begin = np.zeros(len(data), bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin |= kind == 2
    begin[first] = True
    begin &= kind != 0
    quote = np.flatnonzero((data == 0x27) & begin)
    if len(quote):
        word_end = last[np.searchsorted(first, quote, "right") - 1]
        text = np.concatenate((low, np.zeros(3, np.uint8)))
        a, b = text[quote + 1], text[quote + 2]
        one = np.isin(a, _ONE) & (quote + 2 <= word_end)
        two = np.isin(a.astype(np.int64) << 8 | b, _TWO) & (quote + 3 <= word_end)
        for which, k in ((one, 2), (two & ~one, 3)):
            at = quote[which]
            for step in range(1, k):
                begin[at + step] = False
            after = at[at + k < word_end[which]] + k
            begin[after[kind[after] == 1]] = True
    if odd_word.any():
        inside = np.zeros(len(data) + 1, np.int64)
        inside[first[odd_word]] += 1
        inside[last[odd_word]] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        begin[inside] = False
        begin[first[odd_word]] = True
        low[inside] = data[inside]
    starts = np.flatnonzero(begin)
    word = np.searchsorted(first, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), last[word])
    return low, starts, ends, row[word], odd_word[word]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One tokenizer a worker process and file."""
    return WordBpe(path)
