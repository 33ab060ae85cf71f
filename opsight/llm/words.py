"""Words of a text and their hashes, computed on arrays of bytes."""

from __future__ import annotations

import re

import numpy as np

#: The characters that separate words and that are stripped from lines.
BLANKS = b" \t\n\x0b\x0c\r"
BLANK_CHARACTERS = BLANKS.decode()
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

#: Bytes of a word that are hashed by one table each; longer words are hashed in blocks.
BLOCK = 64
_random = np.random.default_rng(20240229)
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS, np.uint8))
# A random number for each place in a block and byte: different words of up to a block have
# different sums but for chance, whatever pattern they follow.
_CODES = _random.integers(0, 2**64, (BLOCK, 256), dtype=np.uint64)
_CODES[:, _IS_BLANK] = 0
_CODES = _CODES.reshape(-1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
SLICE = 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed permutation of the 64-bit numbers)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def spans(data: np.ndarray, separates: np.ndarray = _IS_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end; ``separates`` tells which bytes lie between words."""
    blank = separates[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    return edges[::2], edges[1::2]


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and where it starts."""
    starts, ends = spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    first = starts[0]
    lengths = ends - starts
    data, begins = data[first:], starts - first
    place = np.arange(len(data), dtype=np.int32) - np.repeat(
        begins.astype(np.int32), np.diff(np.append(begins, len(data)))
    )
    codes = _CODES[((place & (BLOCK - 1)) << 8) | data]
    if lengths.max() <= BLOCK:
        sums = np.add.reduceat(codes, begins)
        return mixed(sums + lengths.astype(np.uint64)), starts
    # Each block of a long word is mixed with its number before they are added.
    counts = -(-lengths // BLOCK)
    last = np.cumsum(counts)
    number = np.arange(last[-1]) - np.repeat(last - counts, counts)
    at = np.repeat(begins, counts) + BLOCK * number
    sums = np.add.reduceat(codes, at)
    sums = np.where(number > 0, mixed(sums ^ mixed(number.astype(np.uint64) * _STEP + _STEP)), sums)
    whole = np.add.reduceat(sums, last - counts)
    return mixed(whole + lengths.astype(np.uint64)), starts


def words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word, in order; long texts are cut between words."""
    if len(data) <= SLICE:
        return _hashed(data)
    hashes, starts, start = [], [], 0
    while start < len(data):
        end = start + SLICE
        if end < len(data):
            while end < len(data) and not _IS_BLANK[data[end]]:
                gap = np.flatnonzero(_IS_BLANK[data[end : end + SLICE]])
                end += int(gap[0]) if len(gap) else SLICE
            end = min(end, len(data))
        found, at = _hashed(data[start:end])
        hashes.append(found)
        starts.append(at + start)
        start = end
    return np.concatenate(hashes), np.concatenate(starts)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    return words_at(data)[0]


def as_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; the whole run if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    count = len(words) - size + 1
    out = np.full(count, np.uint64(size), np.uint64)
    for at in range(size):
        out = mixed(out * _STEP + words[at : at + count])
    return out
