"""Words of Arrow text columns as 64-bit hashes, computed over whole byte buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The separators of [^\x20\x09-\x0D]+.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: The hash of the token that ends a text.
END = np.uint64(0x8F1BBCDCCA62C1D6)
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def combine(*parts: np.ndarray) -> np.ndarray:
    """One hash of a sequence of hashes."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), 0x243F6A8885A308D3, np.uint64)
        for x in parts:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
        return out


def coarse_order(values: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """An order of 64-bit values by their upper bits, ties in order of place, and the mask of these bits: places lie in the others, so numbers are sorted and not their places, which takes a fourth of the time."""
    low = np.uint64(2 ** max(1, len(values).bit_length()) - 1)
    packed = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    packed.sort()
    return (packed & low).astype(np.int64), ~low


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, ascending, a place of each, and which of them each value is."""
    order, upper = coarse_order(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.flatnonzero(new[1:])
    if (((ranked[at] ^ ranked[at + 1]) & upper) == 0).any():  # different values with the same upper bits
        order = np.argsort(values)
        ranked = values[order]
        new[1:] = ranked[1:] != ranked[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ranked[new], order[new], which


SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256), BASE, np.uint64)]), dtype=np.uint64)
    return _powers


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE, gaps: np.ndarray = BLANK) -> Iterator[tuple[int, int]]:
    """Ranges of about limit bytes that cut no word, so a very long text needs little memory. gaps: the bytes between words."""
    at, total = 0, int(offsets[-1])
    while at < total:
        end = at + limit
        if end >= total:
            end = total
        else:
            row = int(offsets[np.searchsorted(offsets, end)])
            for k in range(end, row, 4096):
                if len(hit := np.flatnonzero(gaps[data[k : min(k + 4096, row)]])):
                    end = k + int(hit[0])
                    break
            else:
                end = row
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = (), gaps: np.ndarray = BLANK) -> Iterator[tuple]:
    """For each piece: starts, lengths, rows and hashes of its lower-cased words, then the hashes of their first bytes for each of prefixes (0 where a word is shorter). gaps: the bytes between words."""
    for at, end in pieces(data, offsets, gaps=gaps):
        low = LOWER[data[at:end]]
        word = ~gaps[low]
        first, last = word.copy(), word.copy()
        edge = np.zeros(len(low) + 1, bool)
        edge[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at] = True
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        sizes = np.flatnonzero(last) + 1 - starts
        low, word = low[starts[0] :], word[starts[0] :]
        place = np.arange(len(low)) - np.repeat(starts - starts[0], np.diff(np.append(starts - starts[0], len(low))))
        with np.errstate(over="ignore"):
            value = SYMBOL[low] * powers(int(place.max()) + 1)[place]
            value[~word] = 0
            hashes = mix(np.add.reduceat(value, starts - starts[0]) + sizes.astype(np.uint64))
            heads = []
            for n in prefixes:
                head = mix(np.add.reduceat(np.where(place < n, value, np.uint64(0)), starts - starts[0]) + np.uint64(n << 32))
                heads.append(np.where(sizes >= n, head, np.uint64(0)))
        yield starts + at, sizes, np.searchsorted(offsets, starts + at, "right") - 1, hashes, *heads


def word_hash(word: str) -> np.uint64:
    """The hash that words() gives a single word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return next(words(data, np.array([0, len(data)])))[3][0]


def word_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, in order, and how many words each row has."""
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, row, h in words(data, offsets):
        hashes.append(h)
        rows.append(row)
    return np.concatenate(hashes), np.bincount(np.concatenate(rows), minlength=len(offsets) - 1)


def batches(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes, one row at least."""
    _, offsets = buffers(column)
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end
        at = end
