"""The word shingles of texts, as hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import buffers, combine, mix, word_table

SHINGLE = 5


def shingles(text: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct shingle of a text: row, hash and multiplicity; then each text's words and a 128-bit fingerprint of its word sequence (n, 2). A text of fewer words is one shingle; one without words has none."""
    hashes, size = word_table(*buffers(text))
    first = np.concatenate([[0], np.cumsum(size)])
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    grams = combine(*(padded[i : i + len(hashes)] for i in range(width)))
    row = np.repeat(np.arange(len(size)), size)
    left = first[row + 1] - np.arange(len(hashes))
    short = np.flatnonzero((size > 0) & (size < width))
    for r in short:
        grams[first[r]] = combine(np.array([size[r]], np.uint64), *(hashes[i : i + 1] for i in range(first[r], first[r + 1])))[0]
    ok = left >= width
    ok[first[short]] = True
    place = (np.arange(len(hashes)) - first[row]).astype(np.uint64)
    marks = np.zeros((len(size), 2), np.uint64)
    with np.errstate(over="ignore"):
        for k, seed in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            np.add.at(marks[:, k], row, mix(mix(hashes + np.uint64(seed)) + mix(place + np.uint64(seed))))
            marks[:, k] = mix(marks[:, k] + size.astype(np.uint64))
    row, grams = row[ok], grams[ok]
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return row[at], grams[at], np.diff(np.append(at, len(row))), size, marks
