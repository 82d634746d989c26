"""Array kernels over batches of UTF-8 text that the operators share.

Arrow hands a batch of texts over as one byte buffer with offsets. The kernels
work on that buffer: no Python object is made for a character or a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress
from ctypes import CDLL
from hashlib import blake2b
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SEED = np.random.default_rng(20240501)
_BYTE = _SEED.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word separators: space and \t to \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("p", _BASE), ("i", _BASE_INV)):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["i"]


def give_back() -> None:
    """Returns memory that Arrow and the C library keep after use to the system: a worker lives on, through stages of other operators."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """The function for batches or for a group, leaving its worker no memory in use at the end of a task or a group."""
    if isgeneratorfunction(run):

        def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from run(batches)
            give_back()

        return batchwise

    def groupwise(*tables):
        out = run(*tables)
        give_back()
        return out

    # Spark tells the forms of a group function apart by the number of its parameters
    return (lambda left, right: groupwise(left, right)) if len(signature(run).parameters) == 2 else (lambda table: groupwise(table))


def kept(df: DataFrame, keep: list[str]) -> tuple[list[str], str]:
    """Names free of clashes, and their types as a schema, for columns that a batch function hands through."""
    names = [f"__kept{i}" for i in range(len(keep))]
    return names, ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def as_strings(column: pa.Array) -> pa.Array:
    """The column as string with 32-bit offsets, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each begins (one more offset than texts)."""
    column = as_strings(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, end row, bytes, offsets. A longer text is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Rolling:
    """Hash of any byte range of a buffer in constant time: a polynomial over random byte codes, modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.powers, self.inverses = _grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverses[start])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k bytes."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverses[:n]) if n > 0 else np.zeros(0, np.uint64)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word ``[^\\x20\\x09-\\x0D]+``."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.ones(n + 1, bool)
    inside[:n] = ~SPACE[data]
    inside[n] = False
    cut = offsets[(offsets > 0) & (offsets < n)]
    begin, end = inside[:n].copy(), inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    end &= ~inside[1:]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return begin, end, np.searchsorted(offsets, begin, "right") - 1


#: A longer word is hashed as a whole by another function, so that no buffer must hold it with its running sums.
LONG_WORD = 1 << 20


def parts(data: np.ndarray, most: int = 1 << 20, ends: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """Ranges of one text of about ``most`` bytes each that end before one of the bytes in ``ends``, so where a word ends; a longer word makes a longer range."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + most, n)
        while end < n and not ends[data[end]]:  # look on, a stretch at a time
            stretch = ends[data[end : end + 4096]]
            end += int(stretch.argmax()) if stretch.any() else len(stretch)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word; memory beyond these grows with ``most``, not with the texts."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, b, d, o in chunks(data, offsets, most):
        for low, high in parts(d, most) if b == a + 1 else [(0, len(d))]:
            if high - low > 2 * most:  # ends with a very long word
                inside = np.flatnonzero(SPACE[d[low:high]])
                begin = low + int(inside[-1]) + 1 if len(inside) else low
                found.append((_hashes(d[low:begin], np.array([0, begin - low]))[0], np.zeros(0, np.int64)))
                found[-1] = (found[-1][0], np.full(len(found[-1][0]), a))
                found.append((np.array([long_hash(d[begin:high])], np.uint64), np.array([a])))
                continue
            h, doc = _hashes(d[low:high], o if b > a + 1 else np.array([0, high - low]))
            found.append((h, doc + a))
    return np.concatenate([h for h, _ in found]), np.concatenate([doc for _, doc in found])


def long_hash(word: np.ndarray) -> int:
    return int.from_bytes(blake2b(word.tobytes(), digest_size=8).digest(), "little")


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end, doc = words(data, offsets)
    return range_hashes(data, Rolling(data), begin, end), doc


def range_hashes(data: np.ndarray, roll: Rolling, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; those longer than LONG_WORD by the other function."""
    out = roll.of(begin, end)
    for i in np.flatnonzero(end - begin > LONG_WORD).tolist():
        out[i] = long_hash(data[begin[i] : end[i]])
    return out


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n neighbours."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(n), np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[i : i + m]
        if i % 2:
            out ^= out >> np.uint64(29)
    return mix(out)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0] .. start[0]+length[0]-1, then those of start[1], ..."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(np.asarray(start, np.int64) - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return shift + np.arange(total)
