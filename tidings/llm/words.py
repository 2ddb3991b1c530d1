"""Words of whole Arrow batches as arrays: bounds, 64-bit hashes and shingles, without a loop over words.

A word is a maximal run of bytes other than space and 0x09-0x0D, the pattern `[^\\x20\\x09-\\x0D]+`
over UTF-8. A null text is an empty text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about this many bytes, so that memory doesn't depend on the batch.
RUN_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Any ASCII character but letters and digits stands between words.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]
SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOWER = SAME.copy()
LOWER[65:91] += np.uint64(32)

BASE = 0x9E3779B97F4A7C15          # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {"up": np.empty(0, np.uint64), "down": np.empty(0, np.uint64)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i below n, modulo 2^64."""
    if len(_powers["up"]) < n:
        size = max(n, RUN_BYTES + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, np.uint64(base), dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its rows in them."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    if not len(column) or bounds is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def runs(column: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of rows of about `size` bytes."""
    data, bounds = buffers(column)
    row = 0
    while row < len(bounds) - 1:
        after = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        yield row, after, data[bounds[row]:bounds[after]], bounds[row:after + 1] - bounds[row]
        row = after


class Words:
    """Words of a run: `start`, `end` (byte positions), `doc` (row), `hash`, and per row `first`
    (its first word; one entry more than rows)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool,
                 between: np.ndarray = IS_SPACE):
        word = np.zeros(len(data) + 2, dtype=np.int8)
        word[1:-1] = ~between[data]
        begins = word[1:] > word[:-1]        # begins[i]: a word starts at byte i
        ends = word[1:] < word[:-1]
        inner = bounds[1:-1]                 # a row's end also ends a word
        inner = inner[(inner > 0) & (inner < len(data))]
        touching = inner[(word[inner] == 1) & (word[inner + 1] == 1)]
        begins[touching] = True
        ends[touching] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.count)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((LOWER if lower else SAME)[data] * up[:-1], dtype=np.uint64, out=total[1:])
        self.total, self.down = total, down
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def beginnings(self, size: int) -> np.ndarray:
        """Hashes of the first `size` bytes of each word (of the whole word, if it is shorter)."""
        end = np.minimum(self.start + size, self.end)
        return mix((self.total[end] - self.total[self.start]) * self.down[self.start])

    def __len__(self) -> int:
        return len(self.start)


ORDER = [np.uint64(mix(np.array([i + 1], np.uint64))[0] | np.uint64(1)) for i in range(64)]


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` consecutive words of a row, the word each begins with, and how
    many each row has."""
    n = len(words)
    per_row = np.maximum(words.count - (size - 1), 0)
    if n < size:
        return np.empty(0, np.uint64), np.empty(0, np.int64), per_row
    hashed = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        hashed += words.hash[i:n - size + 1 + i] * ORDER[i]
    inside = np.flatnonzero(words.doc[:n - size + 1] == words.doc[size - 1:])
    return mix(hashed[inside]), inside, per_row


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingles of `size` lower-cased words (A-Z only). A row of fewer
    words has its whole sequence as one shingle; a row without words has none."""
    for _, _, data, bounds in runs(column):
        words = Words(data, bounds, lower=True)
        hashed, _, per_row = windows(words, size)
        at = np.concatenate([[0], np.cumsum(per_row)])
        for row, n in enumerate(words.count):
            if n >= size:
                mine = np.sort(hashed[at[row]:at[row + 1]])
                yield mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
            elif n:
                whole = words.hash[words.first[row]:words.first[row + 1]]
                total = np.uint64(n)
                with np.errstate(over="ignore"):
                    for i, h in enumerate(whole):
                        total += h * ORDER[32 + i]
                yield mix(np.array([total], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def signed(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as Spark's long."""
    return pa.array(values.view(np.int64))
