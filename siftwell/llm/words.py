"""Vectorised words and hashes over Arrow text columns.

Everything here is a small helper that runs inside Spark tasks on one Arrow batch, in pieces of a few MB, so that
memory is bounded by the piece (or by the longest single document) and not by the batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 20
ODD = 0x9E3779B97F4A7C15
#: Bytes that separate words: space and the ASCII controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@functools.cache
def _lean() -> None:
    """In a worker: Arrow's own pools keep what they once had; the system's gives large buffers back to it."""
    if TaskContext.get() is not None:
        pa.set_memory_pool(pa.system_memory_pool())


def hash_sample(rows: DataFrame, key: str, n: int, size: int) -> DataFrame:
    """``size`` of the distinct rows in the order of a hash of the key, for about ``n`` rows in all.

    Where there are more, a limit on the hash keeps all but some more than ``size`` of them out of the sort.
    """
    h = F.xxhash64(key)
    share = (size + 8 * size**0.5 + 64) / max(1, n)
    if share < 1:
        rows = rows.where(h < int(share * 2.0**64) - 2**63)
    return rows.distinct().orderBy(h, key).limit(size)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal spans have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(_BASE[seed], len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(ODD))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string column; null counts as empty."""
    _lean()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offs, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def pieces(offs: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold up to ``size`` bytes together; a longer text stands alone."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of consecutive texts. ``offs`` are absolute in ``data``; so are the spans."""
    low, high = int(offs[0]), int(offs[-1])
    gap = separator[data[low:high]]
    inner = offs[1:-1] - low
    inner = inner[inner < high - low]
    left = np.empty(len(gap), bool)
    right = np.empty(len(gap), bool)
    if len(gap):
        left[0] = right[-1] = True
        left[1:], right[:-1] = gap[:-1], gap[1:]
        left[inner] = True
        right[inner[inner > 0] - 1] = True
    starts = np.flatnonzero(left & ~gap)
    ends = np.flatnonzero(right & ~gap) + 1
    rows = np.searchsorted(offs - low, starts, side="right") - 1
    return starts + low, ends + low, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word, computed in pieces of bytes that end between words."""
    out = np.empty(len(starts), np.uint64)
    lut = _BYTE[seed] if fold is None else _BYTE[seed][fold]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        out[at:to] = span_hash(lut[data[low:high]], starts[at:to] - low, ends[at:to] - low, seed)
        at = to
    return out


PRIME = np.uint64(2**31 - 1)
#: For each seed two bases of polynomials modulo PRIME, and for each byte a value under it for either.
_SOUND = [tuple(int(b) for b in _rng.integers(2**20, 2**31 - 2, 2)) for _ in range(2)]
_SOUND_BYTE = _rng.integers(1, 2**31 - 2, (2, 2, 256), dtype=np.int64).astype(np.uint64)
_sound_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo PRIME, of anything below 2**63."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def _powers_of(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = _reduced(out[:more] * np.uint64(pow(base, have, int(PRIME))))
        have += more
    return out


def sound_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo PRIME."""
    have = _sound_powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        have = _sound_powers[base] = (_powers_of(base, n), _powers_of(pow(base, -1, int(PRIME)), n))
    return have


def _sound(halves, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """62 bits of values[start:end], whose lower and upper halves (under 2**31) come one after the other from ``halves``.

    Polynomials modulo a prime at random bases: unlike those modulo 2**64 they have no inputs that collide whatever the base is.
    Two different spans of n values collide with a chance of about (n / 2**31)**2.
    """
    out = np.zeros(len(starts), np.uint64)
    for base, values in zip(_SOUND[seed], halves, strict=True):
        up, down = sound_powers(base, len(values) + 1)
        term = values * up[: len(values)]
        term = (term & PRIME) + (term >> np.uint64(31))
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(term, out=total[1:])  # under 2**32 each
        out = (out << np.uint64(31)) | _reduced(_reduced(total[ends] - total[starts]) * down[starts])
    return mix(out ^ mix((ends - starts).astype(np.uint64) * np.uint64(ODD)))


def sound_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """As ``span_hash``, where equal hashes must mean equal spans of 64-bit values."""
    return _sound((values & PRIME, values >> np.uint64(33)), starts, ends, seed)


def sound_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, fold: np.ndarray | None = None) -> np.ndarray:
    """As ``word_hashes``, where equal hashes must mean equal words."""
    out = np.empty(len(starts), np.uint64)
    lut = _SOUND_BYTE[seed] if fold is None else _SOUND_BYTE[seed][:, fold]
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        own = data[low:high]
        out[at:to] = _sound((half[own] for half in lut), starts[at:to] - low, ends[at:to] - low, seed)
        at = to
    return out


def grams(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of k consecutive values, at every start."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_BASE[seed]) + values[j : j + n]
    return mix(out)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, where its smallest stands; of equal ones the rightmost."""
    v, at, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(v) - step
        if n <= 0:
            return np.zeros(0, np.int64)
        right = v[step:] <= v[:n]
        v, at = np.where(right, v[step:], v[:n]), np.where(right, at[step:], at[:n])
        have += step
    return at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
