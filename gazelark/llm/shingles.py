"""Word-shingle sets of whole texts as 64-bit hashes, computed a chunk of texts at a time.

Words are maximal runs of bytes outside space and 0x09-0x0D after A-Z is lower-cased; a set
holds the distinct `width`-word shingles, or the whole word sequence when there are fewer
words; a null text or one without words has the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240611))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64)[_LOWER] * _IS_WORD.astype(np.uint64)
_BASE = int(_SEED.integers(2**60, 2**62)) | 5
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK_BYTES = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: the second half is the first times base**done
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 2**64))
        done += more
    return out


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES * 2, n)
    if size not in _powers:
        made = (_geometric(_BASE, size), _geometric(pow(_BASE, -1, 2**64), size))
        if size > CHUNK_BYTES * 2:
            return made  # a single very long text; its tables are not kept
        _powers[size] = made
    return _powers[size]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 of consecutive texts) of about CHUNK_BYTES together."""
    first, held, total = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and total + len(raw) > CHUNK_BYTES:
            yield first, held
            first, held, total = i, [], 0
        held.append(raw)
        total += len(raw) + 1
    if held:
        yield first, held


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in order, number of words of each text)."""
    buffer = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    power, inverse = _power_tables(len(buffer))
    flags = np.zeros(len(buffer) + 1, np.int8)
    flags[1:] = _IS_WORD[buffer]
    edges = np.diff(flags)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * power[: len(buffer)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + np.uint64(0x9E3779B97F4A7C15) * (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(r) + 1 for r in raws])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in the order of the texts."""
    for _, raws in chunks(texts):
        words, counts = word_hashes(raws)
        n = max(0, len(words) - width + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n] + np.uint64(k + 1))
        at = 0
        for count in counts:
            if count >= width:
                yield np.unique(rolled[at : at + count - width + 1])
            elif count:
                whole = np.uint64(count)
                for w in words[at : at + count]:
                    whole = mix(np.array([whole], np.uint64) * _M1 + w)[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.empty(0, np.uint64)
            at += count


def signature_coefficients(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**32, (2, size), dtype=np.uint64)
    return (drawn[0] | np.uint64(1)).astype(np.uint32), drawn[1].astype(np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash coordinates of a set; 8,192 members at a time."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 8192):
        part = np.multiply.outer(a, low[at : at + 8192])
        part += b[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best
