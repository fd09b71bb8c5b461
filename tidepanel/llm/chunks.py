"""Whole texts of Arrow batches as numpy arrays, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are worked on at once; one longer text makes a chunk of its own.
CHUNK_BYTES = 512 << 10

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
#: Words of more bytes are hashed one by one; masks that keep a number's low bytes.
LONG_WORD = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Windows are polynomials over the words' values modulo this prime; the two bases are drawn once.
PRIME = (1 << 61) - 1
BASES = tuple(int(x) for x in np.random.default_rng(20240301).integers(1 << 40, PRIME, 2))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser for 64-bit values (splitmix64)."""
    h = h + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have ``limit`` bytes at most, or are one text.

    Small batches in a row are joined up to the limit.
    """
    limit = limit or CHUNK_BYTES
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, before + limit - size, side="right")), at)
            if to == at and held:
                yield _joined(held)
                held, size = [], 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - before)
            at = to
            if size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)
    # workers are kept for later tasks; what this one no longer uses goes back
    held.clear()
    pa.default_memory_pool().release_unused()


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more entry at the end)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts of a chunk.

    starts, ends: byte places; first: index of each text's first word (one more entry at the end).
    """

    def __init__(self, texts: pa.Array, lower: bool):
        self.data, at = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~WHITE[self.data]
        begins, stops = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        begins[at], stops[at] = True, True
        begins[1:n] |= ~inside[: n - 1] if n else False
        stops[1:n] |= ~inside[1:] if n > 1 else False
        self.starts = np.flatnonzero(inside & begins[:n])
        self.ends = np.flatnonzero(inside & stops[1:]) + 1 if n else self.starts
        self.first = np.searchsorted(self.starts, at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit value of each word: its bytes are taken eight at a time and mixed in; long words by xxh3.

        Words of up to eight bytes never share a value with another word of their length.
        """
        sizes = self.ends - self.starts
        out = mix(sizes.astype(_U), 3)
        eights = np.ndarray(len(self.data), "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        left = np.flatnonzero(sizes <= LONG_WORD)
        for k in range(0, LONG_WORD, 8):
            left = left[sizes[left] > k]
            if not len(left):
                break
            keep = _KEEP[np.minimum(sizes[left] - k, 8)]
            out[left] = mix(out[left] ^ (eights[self.starts[left] + k] & keep), 4)
        for k in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.starts[k] : self.ends[k]])
        return out


def _folded(x: np.ndarray) -> np.ndarray:
    """A number below PRIME + 8 that equals x modulo PRIME."""
    return (x & _U(PRIME)) + (x >> _U(61))


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME for folded a, by halves of 32 bits."""
    high, low = a >> _U(32), a & _U(0xFFFFFFFF)
    b1, b0 = _U(b >> 32), _U(b & 0xFFFFFFFF)
    middle, least = high * b0 + low * b1, low * b0
    return _folded((high * b1 << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32)) + _folded(least))


def windows(words: np.ndarray, size: int, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp values of every ``size`` words in a row (over text borders too; callers mask those).

    A window's value is the polynomial of its words at ``base`` modulo a prime, put together from
    windows of half the length, so no structure of the words makes values meet: two different
    sequences agree at fewer than ``size`` of the 2**61 bases.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    power, length, block = base, 1, _folded(words)
    value, have = None, 0
    while True:
        if size & length:
            value = block if value is None else _folded(_times(value[: len(value) - length], power) + block[have:])
            have += length
            if have == size:
                break
        block = _folded(_times(block[:-length], power) + block[length:])
        power, length = power * power % PRIME, length * 2
    value = value[:n]
    return mix(np.where(value >= _U(PRIME), value - _U(PRIME), value), 2)


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted; (values, where each text's begin, one more at the end).

    A text with fewer words has its whole sequence as one shingle, one without words has none.
    """
    counts = np.diff(first)
    values, owner = [], []
    if len(w := windows(words, size)):
        whole = np.repeat(np.arange(len(counts)), counts)
        ok = np.flatnonzero(whole[: len(w)] == whole[size - 1 :])
        values.append(w[ok])
        owner.append(whole[ok])
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            values.append(mix(windows(words, n)[first[short]], 100 + n))
            owner.append(short)
    if not values:
        return np.zeros(0, _U), np.zeros(len(counts) + 1, np.int64)
    v, o = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((v, o))
    v, o = v[order], o[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(counts) + 1))
