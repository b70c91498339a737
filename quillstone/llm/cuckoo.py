"""Cuckoo filter over live digests, with the keys it stands for kept in buckets beside it."""

from __future__ import annotations

from array import array
from typing import Any

_SLOTS, _KICKS = 4, 64
_MASK = (1 << 64) - 1


class CuckooIndex:
    """Digest -> value. The filter answers most misses; a hit is held against the bucket's stored content keys.

    ``insert`` and ``delete`` keep filter and buckets in step. When an insertion finds no slot after a bounded
    number of moves, the filter doubles and is filled again from the stored keys, so no key is ever lost.
    """

    def __init__(self, buckets: int = 256) -> None:
        self._kept: dict[int, list[list[Any]]] = {}
        self.size = self.resizes = self.false_hits = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets  # a power of two
        self._slots = array("H", bytes(2 * _SLOTS * buckets))

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(digest[:8], "little")
        mark = (h >> 48) or 1
        first = h & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E9955BD1E995 & _MASK) >> 20 & (self.buckets - 1))

    def _put(self, digest: bytes) -> bool:
        mark, a, b = self._place(digest)
        for at in (a, b):
            for s in range(at * _SLOTS, at * _SLOTS + _SLOTS):
                if not self._slots[s]:
                    self._slots[s] = mark
                    return True
        at = a
        for kick in range(_KICKS):  # the moved mark changes with each kick, so a cycle of two buckets ends
            s = at * _SLOTS + (kick + mark) % _SLOTS
            mark, self._slots[s] = self._slots[s], mark
            at = self._other(at, mark)
            for s in range(at * _SLOTS, at * _SLOTS + _SLOTS):
                if not self._slots[s]:
                    self._slots[s] = mark
                    return True
        return False

    def _grow(self) -> None:
        while True:
            self.resizes += 1
            self._clear(self.buckets * 2)
            if all(self._put(row[0]) for bucket in self._kept.values() for row in bucket):
                return

    def maybe(self, digest: bytes) -> bool:
        """Whether the filter holds the digest's mark; False is certain."""
        mark, a, b = self._place(digest)
        s = self._slots
        return mark in s[a * _SLOTS : a * _SLOTS + _SLOTS] or mark in s[b * _SLOTS : b * _SLOTS + _SLOTS]

    def find(self, digest: bytes, content: bytes = b"") -> list[Any] | None:
        """The stored row [digest, content, value] if digest and content key both agree."""
        if not self.maybe(digest):
            return None
        for row in self._kept.get(int.from_bytes(digest[8:12], "little"), ()):
            if row[0] == digest and row[1] == content:
                return row
        self.false_hits += 1
        return None

    def insert(self, digest: bytes, content: bytes = b"", value: Any = None) -> list[Any]:
        row = self.find(digest, content)
        if row is not None:
            row[2] = value
            return row
        row = [digest, content, value]
        self._kept.setdefault(int.from_bytes(digest[8:12], "little"), []).append(row)
        self.size += 1
        if not self._put(digest):
            self._grow()
        return row

    def delete(self, digest: bytes, content: bytes = b"") -> bool:
        row = self.find(digest, content)
        if row is None:
            return False
        key = int.from_bytes(digest[8:12], "little")
        self._kept[key].remove(row)
        if not self._kept[key]:
            del self._kept[key]
        self.size -= 1
        mark, a, b = self._place(digest)
        for s in (*range(a * _SLOTS, a * _SLOTS + _SLOTS), *range(b * _SLOTS, b * _SLOTS + _SLOTS)):
            if self._slots[s] == mark:
                self._slots[s] = 0
                break
        return True

    def rows(self):
        for bucket in self._kept.values():
            yield from bucket
