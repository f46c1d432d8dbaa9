"""Words of texts as 64-bit codes, computed on whole buffers at once.

A word is a run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 those bytes never occur inside a longer character,
so cutting the bytes is the same as cutting the characters. A word's code is a sum of random byte values times powers
of an odd number, mod 2**64, then mixed: among n different words or word runs any two share a code with a chance of
about n**2 / 2**65 (10**8 words: 0.0003). Null texts have no words.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator, Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C13)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 18  # bytes looked at together
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def trim() -> None:
    """Gives freed memory back to the system, as worker processes stay while others start."""
    if "pyarrow" in sys.modules:
        sys.modules["pyarrow"].default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no visible structure (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
    if lower:
        table[65:91] = table[97:123]
    return table


_TABLES = {lower: _table(lower) for lower in (False, True)}
_SEP = np.zeros(256, dtype=bool)
_SEP[list(SPACE)] = True
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _codes(raw: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes and starts of the words of one buffer."""
    a = np.frombuffer(raw, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = ~_SEP[a]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    if word[-1]:
        edge = np.concatenate((edge, [len(a)]))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power(max(len(a), CHUNK))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLES[lower][a] * power[: len(a)], out=sums[1:])
    codes = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(codes + (ends - starts).astype(np.uint64) * _GOLDEN), starts


def word_codes(texts: Sequence[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of the texts in order, and the number of words of each text."""
    codes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for chunk in _chunks(texts):
        ends = np.cumsum([len(x) + 1 for x in chunk])
        found, starts = _codes(b" ".join(chunk), lower)
        codes.append(found)
        counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
    return np.concatenate(codes), np.concatenate(counts)


def _chunks(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(x := b"" if text is None else text.encode("utf-8", "surrogatepass"))
        size += len(x)
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def split_words(text: str | None) -> list[bytes]:
    """The words as UTF-8; bytes.split() cuts at exactly the six separators."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def gram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n codes; the caller leaves out runs that cross texts."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    total = np.zeros(len(codes) - n + 1, np.uint64)
    for j in range(n):
        total *= _BASE
        total += codes[j : len(codes) - n + 1 + j]
    return mix(total + np.uint64(n * int(_GOLDEN) % 2**64))


def ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, sorted, and which of them each one is. They are sorted by their upper bits together with their places, which one
    sort of numbers does; neighbours are told apart by all bits, and runs that only the lower bits tell apart are sorted again."""
    n = len(codes)
    low = np.uint64((1 << max(n - 1, 1).bit_length()) - 1)
    packed = codes & ~low
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int32 if n < 1 << 31 else np.int64)
    packed &= ~low
    same = packed[1:] == packed[:-1]
    del packed
    own = codes[order]
    new = np.ones(n, bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    mixed = np.flatnonzero(same & new[1:])  # a place after which the lower bits differ
    if len(mixed):
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        for run in np.unique(np.searchsorted(starts, mixed, "right") - 1).tolist():
            part = slice(starts[run], starts[run + 1] if run + 1 < len(starts) else n)
            order[part] = order[part][np.argsort(own[part], kind="stable")]
            own[part] = codes[order[part]]
            new[part][1:] = own[part][1:] != own[part][:-1]
    which = np.empty(n, np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return own[new], which


def shingle_sets(codes: np.ndarray, counts: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text its set of n-word shingles, sorted; the whole text as one shingle if it has fewer words, an empty
    set if it has none."""
    grams = gram_codes(codes, n)
    start = 0
    for count in counts.tolist():
        if count >= n:
            yield np.unique(grams[start : start + count - n + 1])
        elif count:
            yield gram_codes(codes[start : start + count], count)
        else:
            yield np.empty(0, np.uint64)
        start += count


def slices(texts, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow array of texts with about `most` bytes each, one text at least."""
    import pyarrow.compute as pc  # workers that see no Arrow data stay smaller without it

    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, before + most, "right")))
        yield start, stop
        trim()
        start = stop


def arrow_codes(texts, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """word_codes of an Arrow array of texts, read from its buffer as it is."""
    import pyarrow as pa

    if texts.null_count or not len(texts):
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if at else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    codes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    start = 0
    while start < len(at) - 1:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + CHUNK, "right")) - 1)
        own, n = _runs(raw[at[start] : at[stop]], at[start : stop + 1] - at[start], lower)
        codes.append(own)
        counts.append(n)
        start = stop
    return np.concatenate(codes), np.concatenate(counts)


def _runs(a: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of the texts that stand in a without gaps, cut at `at`, and the number of words of each."""
    if not len(a):
        return np.empty(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    word = np.zeros(len(a) + 2, bool)
    word[1:-1] = ~_SEP[a]
    first = word[1:-1] & ~word[:-2]
    last = word[1:-1] & ~word[2:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(a))]
    first[cut] |= word[1:-1][cut]
    last[cut - 1] |= word[1:-1][cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(max(len(a), CHUNK))
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_TABLES[lower][a] * power[: len(a)], out=sums[1:])
    codes = (sums[ends] - sums[starts]) * inverse[starts]
    codes = mix(codes + (ends - starts).astype(np.uint64) * _GOLDEN)
    return codes, np.diff(np.searchsorted(starts, at[1:]), prepend=0)


def block_sets(texts, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of an Arrow array of texts, one after the other and each sorted, and the size of each."""
    codes, counts = arrow_codes(texts, lower)
    grams = gram_codes(codes, width)
    out, sizes, start = [np.empty(0, np.uint64)], np.zeros(len(counts), np.int64), 0
    for i, count in enumerate(counts.tolist()):
        if count:
            own = grams[start : start + count - width + 1] if count >= width else gram_codes(codes[start : start + count], count)
            own = np.sort(own)
            if count > width:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            out.append(own)
            sizes[i] = len(own)
            start += count
    return np.concatenate(out), sizes


def set_keys(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A code for each of the sets that stand in codes one after the other; equal sets have equal ones, empty sets 0."""
    out, full = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = mix(np.add.reduceat(mix(codes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts) + sizes[full].astype(np.uint64))
    return out
