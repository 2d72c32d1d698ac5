"""Array helpers that run inside tasks: ragged gathers, slice hashes, word and shingle arrays.

Everything here works on one bounded chunk of an Arrow batch (``chunks``), so memory does not
depend on the number of rows in a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

U64 = np.uint64
#: Slices from this length on are hashed by xxhash: sums of powers modulo 2^64 collide on long regular strings.
_LONG = 64
#: Fixed odd multipliers of the polynomial slice hash and of the 5-word combination.
_BASE = 0x9E3779B97F4A7C15
_COMBINE = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x2545F4914F6CDD1D)
_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        p, q = np.full(size, _BASE, U64), np.full(size, inverse, U64)
        p[0] = q[0] = 1
        _powers, _inverses = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers, _inverses


def slice_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice ``codes[start:end]``; equal content gives equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, U64)
    p, q = _tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * p[: len(codes)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(U64) * U64(_COMBINE[4]))
    for i in np.flatnonzero(ends - starts >= _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(codes[starts[i] : ends[i]].tobytes())
    return out


def distinct_slices(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one slice of each content, and each slice's position among these.

    Slices meet by hash and are compared with their representative, so unequal ones are never taken for equal.
    """
    _, at, inverse = np.unique(slice_hashes(codes, starts, ends), return_index=True, return_inverse=True)
    lengths, other = ends - starts, at[inverse]
    wrong = lengths != lengths[other]
    shift = np.where(wrong, 0, starts[other] - starts)
    place = ragged(starts, lengths)
    unequal = np.flatnonzero(codes[place] != codes[place + np.repeat(shift, lengths)])
    wrong[np.searchsorted(np.cumsum(lengths), unequal, side="right")] = True
    if wrong.any():
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(wrong).tolist():
            inverse[i] = more.setdefault(codes[starts[i] : ends[i]].tobytes(), len(at))
            if inverse[i] == len(at):
                at = np.append(at, i)
    return at, inverse


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, runs one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def chunks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters (one row at least, whole texts always)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z lower-cased texts.

    Returns per word its hash and its text's index, then the joined bytes with word starts and ends.
    """
    parts = [t.encode("utf-8", "replace") for t in texts]
    joined = b" ".join(parts)
    raw = _LOWER[np.frombuffer(joined, np.uint8)]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    solid = np.zeros(len(raw) + 2, bool)
    np.logical_not(_SPACE[raw], out=solid[1:-1])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[0::2], edge[1::2]
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return slice_hashes(raw, starts, ends), owner, raw.tobytes(), starts, ends


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    With fewer words the whole sequence is the only shingle; without words the set is empty.
    """
    hashes, owner, *_ = word_arrays(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        combined = np.zeros(n, U64)
        for k in range(width):
            combined += mix(hashes[k : k + n] * U64(_COMBINE[k % 5] + 2 * (k // 5)))
        combined = mix(combined)
    out = []
    for i in range(len(texts)):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        if hi - lo >= width:
            out.append(np.unique(combined[lo : hi - width + 1]))
        elif hi > lo:
            h = np.array([hi - lo], U64)
            for k in range(lo, hi):
                h = mix(h * U64(_COMBINE[0]) + hashes[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, U64))
    return out
