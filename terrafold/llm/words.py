"""Vectorised words and shingles of whole texts inside Arrow tasks.

All functions work on the UTF-8 bytes of many texts at once. A word is a longest run of bytes of a class
(``PLAIN`` or ``ALNUM`` below); A-Z is lowered first and no other character is changed. Words and shingles are
represented by 64-bit hashes; for 1e12 different values the chance that any two meet is about 3 %, and where a result must be
exact the texts are compared afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes that make up a word. PLAIN: all but space, tab and the line and page breaks; ALNUM: digits, letters, bytes above 127.
PLAIN = np.ones(256, bool)
PLAIN[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text worked on at once; a longer text stays whole.
SLICE = 1 << 20
#: Longer words are digested one by one.
LONG_WORD = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Words(NamedTuple):
    hash: np.ndarray   # uint64 per word
    start: np.ndarray  # first byte in the slice
    end: np.ndarray    # byte after the last
    unit: np.ndarray   # index of the unit that holds the word


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of whole texts of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null(b"")
    if len(texts) == 0:
        return
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, bounds: np.ndarray, of: np.ndarray = PLAIN) -> Words:
    """Words of the units that ``bounds`` cuts ``data`` into; no word crosses a bound."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return Words(none.astype(np.uint64), none, none, none)
    inside = of[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = bounds[(bounds > 0) & (bounds < n)]
    first[inner] |= inside[inner]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[inner - 1] |= inside[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(_word_hashes(data, start, end), start, end, np.searchsorted(bounds, start, "right") - 1)


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word's lowered bytes, eight at a time; only words are touched, not every byte."""
    lowered = np.zeros(len(data) + 8, np.uint8)
    lowered[:-8] = LOWER[data]
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), lowered, strides=(1,))  # the eight bytes from each place on
    size = end - start
    out = mix((eight[start] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _BASE)
    at, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(at):
        block = eight[start[at] + done] & _FIRST_BYTES[np.minimum(size[at] - done, 8)]
        out[at] = mix(out[at] * _STEP + block)
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(lowered[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring words, unit bounds not regarded."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(k):
        total = total * _STEP + hashes[j:j + m]
    return mix(total + np.uint64(k))


def unit_shingles(found: Words, units: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, unit, first word of the unit) of every run of k words within a unit.

    A unit of fewer words gives its whole sequence as one shingle; a unit without words gives none.
    """
    count = np.bincount(found.unit, minlength=units)
    begin = np.concatenate(([0], np.cumsum(count)))
    every = shingles(found.hash, k)
    index = np.arange(len(every))
    inside = found.unit[:len(every)] == found.unit[k - 1:] if len(every) else np.zeros(0, bool)
    out, unit, at = [every[inside]], [found.unit[:len(every)][inside]], [index[inside]]
    for m in range(1, k):
        for u in np.flatnonzero(count == m):
            out.append(shingles(found.hash[begin[u]:begin[u + 1]], m))
            unit.append(np.array([u]))
            at.append(np.array([begin[u]]))
    unit = np.concatenate(unit)
    at = np.concatenate(at)
    order = np.argsort(unit, kind="stable")
    return np.concatenate(out)[order], unit[order], at[order] - begin[unit[order]]


def by_unit(value: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
    """Order by unit, then value: one sort of the unit and the value's upper bits, if these tell the values apart."""
    bits = max(1, int(units).bit_length())
    key = (unit.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits))
    order = np.argsort(key)
    key, found = key[order], value[order]
    if np.any((key[1:] == key[:-1]) & (found[1:] != found[:-1])):
        return np.lexsort((value, unit))
    return order


def by_rarity(rarity: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
    """Order by unit, then rarity; what is equal keeps its order."""
    bits = max(1, int(units).bit_length())
    top = np.uint64((1 << (64 - bits)) - 1)
    return np.argsort((unit.astype(np.uint64) << np.uint64(64 - bits)) | np.minimum(rarity, top), kind="stable")


def unit_sets(value: np.ndarray, unit: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each unit, sorted, and the bounds of the units in them."""
    order = by_unit(value, unit, units)
    value, unit = value[order], unit[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (unit[1:] != unit[:-1])
    value, unit = value[keep], unit[keep]
    return value, np.concatenate(([0], np.cumsum(np.bincount(unit, minlength=units))))


def set_digest(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set: sums of two mixings of its members and its size."""
    def total(x):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        return run[bounds[1:]] - run[bounds[:-1]]

    salt = np.uint64(0xA0761D6478BD642F)
    size = np.diff(bounds).astype(np.uint64)
    return mix(total(mix(value ^ salt)) * _BASE + mix(total(mix(value + salt)) + size))


def line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of lines, unit of each line, number of the line in its unit): every unit split at byte 10.

    The break belongs to the line before it, so the bounds leave no byte out.
    """
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.concatenate((bounds[:-1], breaks))
    unit = np.concatenate((np.arange(len(bounds) - 1), np.searchsorted(bounds, breaks - 1, "right") - 1))
    order = np.lexsort((starts, unit))
    starts, unit = starts[order], unit[order]
    number = np.arange(len(unit)) - np.searchsorted(unit, unit)
    return np.concatenate((starts, bounds[-1:])), unit, number
