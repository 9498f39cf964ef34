"""Words of many texts at once, as numpy arrays over an Arrow batch.

Inside a task the texts of a batch are one flat byte buffer. Word bounds come
from byte classes, equal words get one table entry, and per-word results
(token ids, features, hashes) are computed once for each new word and then
gathered. The table of a worker is bounded: when full, it starts afresh.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; long texts are cut between words, never inside one.
SEGMENT_BYTES = 1_000_000
#: Words and bytes that a worker's table holds before it starts afresh.
TABLE_WORDS = 1_000_000
TABLE_BYTES = 96_000_000

_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: UTF-8 forms of the white space outside ASCII: (lead bytes, lowest and highest last byte).
_WIDE_SPACE = (((0xC2,), 0x85, 0x85), ((0xC2,), 0xA0, 0xA0), ((0xE1, 0x9A), 0x80, 0x80), ((0xE2, 0x80), 0x80, 0x8A),
               ((0xE2, 0x80), 0xA8, 0xA9), ((0xE2, 0x80), 0xAF, 0xAF), ((0xE2, 0x81), 0x9F, 0x9F), ((0xE3, 0x80), 0x80, 0x80))


def _powers(base: np.uint64, n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i < n."""
    have = cache.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT_BYTES + 1024)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        if size <= SEGMENT_BYTES + 1024:
            cache[base] = have
    return have


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the low-order structure of a hash over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Texts:
    """The texts of an Arrow column as one byte buffer with offsets; null counts as empty."""

    def __init__(self, column: pa.Array):
        column = (column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())).fill_null("")
        _, bounds, data = column.buffers()
        offsets = np.frombuffer(bounds, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        self.data = whole[offsets[0]:offsets[-1]] if len(offsets) else whole[:0]
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, dtype=np.int64)
        self.count = len(column)

    def text(self, row: int) -> str:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes().decode()

    def space(self, wide: bool) -> np.ndarray:
        mask = _SPACE[self.data]
        if wide:
            for lead, low, high in _WIDE_SPACE:
                k = len(lead)
                at = self.data[:len(self.data) - k] == lead[0]
                if k == 2:
                    at = at & (self.data[1:len(self.data) - 1] == lead[1])
                last = self.data[k:]
                for i in np.flatnonzero(at & (last >= low) & (last <= high)):
                    mask[i:i + k + 1] = True
        return mask

    def words(self, wide: bool = False, lead_space: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and row of each word.

        A word is a run without white space. With ``lead_space`` the white
        space before a run belongs to it (and what trails the last run is a
        word of its own), so that the words of a text concatenate to the text.
        """
        solid = ~self.space(wide)
        n = len(solid)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        begin = self.offsets[:-1][np.diff(self.offsets) > 0]
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = solid[:-1]
        if lead_space:
            first = before & ~solid
            first[begin] = True
            starts = np.flatnonzero(first)
            ends = np.append(starts[1:], n)
        else:
            before[begin] = False
            starts = np.flatnonzero(solid & ~before)
            after = np.empty(n, dtype=bool)
            after[-1] = False
            after[:-1] = solid[1:]
            after[begin[begin > 0] - 1] = False
            ends = np.flatnonzero(solid & ~after) + 1
        rows = np.searchsorted(self.offsets, starts, side="right") - 1
        return starts, ends, rows

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each byte range (ranges in ascending order), equal on every worker."""
        out = np.empty(len(starts), dtype=np.uint64)
        at = 0
        while at < len(starts):
            stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT_BYTES, side="right")))
            low, high = int(starts[at]), int(ends[stop - 1])
            up, down = _powers(_BASES[which], high - low + 1)
            total = np.empty(high - low + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum((self.data[low:high].astype(np.uint64) + np.uint64(1)) * up[:high - low], out=total[1:])
            s, e = starts[at:stop] - low, ends[at:stop] - low
            out[at:stop] = (total[e] - total[s]) * down[s]
            at = stop
        return _mixed(out)


class WordTable:
    """Entries for the different words a worker has met.

    ``build(words)`` gets the new words as ``bytes`` and returns a list of
    arrays with one row per word; a ragged result is a pair (flat, lengths).
    """

    def __init__(self, build: Callable[[list[bytes]], list], limit: int = TABLE_WORDS):
        self.build, self.limit = build, limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.place = np.zeros(0, dtype=np.int64)
        self.check = np.zeros(0, dtype=np.uint64)
        self.parts: list = []

    def _bytes(self) -> int:
        arrays = [self.keys, self.place, self.check] + [a for p in self.parts for a in (p if isinstance(p, tuple) else (p,))]
        return sum(a.nbytes for a in arrays)

    def _add(self, words: list[bytes]) -> None:
        new = self.build(words)
        if not self.parts:
            self.parts = [self._ragged(p) if isinstance(p, tuple) else p for p in new]
            return
        for i, p in enumerate(new):
            if isinstance(p, tuple):
                flat, starts, lengths = self.parts[i]
                f, s, n = self._ragged(p)
                self.parts[i] = (np.concatenate([flat, f]), np.concatenate([starts, s + len(flat)]), np.concatenate([lengths, n]))
            else:
                self.parts[i] = np.concatenate([self.parts[i], p])

    @staticmethod
    def _ragged(p: tuple) -> tuple:
        flat, lengths = p
        lengths = np.asarray(lengths, dtype=np.int64)
        return np.asarray(flat), np.cumsum(lengths) - lengths, lengths

    def find(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each word; ``parts`` has the values of the entries."""
        keys = texts.hashes(starts, ends)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        full = len(self.keys) + np.count_nonzero(~known) > self.limit or self._bytes() > TABLE_BYTES
        if full and len(self.keys):
            self._clear()
            known[:] = False
            at[:] = 0
        check = texts.hashes(starts, ends, which=1)
        fresh = np.flatnonzero(~known)
        entries = np.empty(len(unique), dtype=np.int64)
        entries[known] = self.place[at[known]]
        if len(fresh):
            s, e = starts[first[fresh]].tolist(), ends[first[fresh]].tolist()
            raw = texts.data
            words = [raw[a:b].tobytes() for a, b in zip(s, e, strict=True)]
            entries[fresh] = np.arange(len(self.check), len(self.check) + len(fresh))
            self.check = np.concatenate([self.check, check[first[fresh]]])
            self._add(words)
            order = np.argsort(merged := np.concatenate([self.keys, unique[fresh]]), kind="stable")
            self.keys = merged[order]
            self.place = np.concatenate([self.place, entries[fresh]])[order]
        found = entries[inverse]
        if len(found) and not np.array_equal(self.check[found], check):
            return self._plain(texts, starts, ends)
        return found

    def _plain(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Different words share a hash: tell the words of this batch apart by their bytes, and start afresh."""
        seen: dict[bytes, int] = {}
        entries = [seen.setdefault(texts.data[a:b].tobytes(), len(seen))
                   for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self._clear()
        self._add(list(seen))
        self.check = np.zeros(len(seen), dtype=np.uint64)
        return np.array(entries, dtype=np.int64)


_kept: list[tuple] = []


def per_worker(kind: str, ident: str, make: Callable):
    """The value that ``make`` gives, kept by this worker process for its later tasks.

    A worker keeps one value: what an earlier stage left is dropped first, and its memory given back.
    """
    if not _kept or _kept[0][0] != (kind, ident):
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)  # freed arrays go back to the system, not to the next stage's peak
        _kept.append(((kind, ident), make()))
    return _kept[0][1]


def gather(part: tuple, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated values of a ragged part for the entries, and each entry's length."""
    flat, starts, lengths = part
    n = lengths[entries]
    ends = np.cumsum(n)
    index = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    index += np.repeat(starts[entries] - (ends - n), n)
    return flat[index], n


def slices(batch: pa.RecordBatch, column: str, size: int = SEGMENT_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each (at least one row)."""
    texts = batch.column(column)
    bounds = Texts(texts).offsets
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
