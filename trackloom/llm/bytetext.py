"""Words, word hashes and shingles of Arrow text columns, as whole-batch numpy operations on the UTF-8 bytes.

A word is a maximal run of ``0-9``, ``A-Z``, ``a-z`` and non-ASCII characters; ``A-Z`` count as lower case.
Null texts are empty. Texts are never cut: a batch is processed in blocks of whole documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Words between blanks only.
UNSPACED = np.ones(256, dtype=bool)
UNSPACED[[9, 10, 11, 12, 13, 32]] = False
BASE = 0x9E3779B97F4A7C15 | 1
#: A random number for each of 64 places and 256 byte values.
TABLE = np.random.default_rng(20240301).integers(0, 1 << 64, 64 * 256, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs stay equal, others spread evenly."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Block:
    """Whole documents of one Arrow batch: rows first..last-1."""

    first: int
    last: int
    data: np.ndarray  # lower-cased bytes
    offsets: np.ndarray  # of documents in data, one more than documents

    def find_words(self, word: np.ndarray = WORD) -> Block:
        """Sets starts and ends of words (byte positions) and word_at, the number of words before each document. word: which bytes are of words."""
        is_word = word[self.data]
        before = np.empty_like(is_word)
        if len(before):
            before[0] = False
            before[1:] = is_word[:-1]
            before[self.offsets[:-1][self.offsets[:-1] < len(before)]] = False
        starts = is_word & ~before
        after = np.zeros_like(is_word)
        if len(after):
            after[:-1] = is_word[1:] & ~starts[1:]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(is_word & ~after) + 1
        self.word_at = np.searchsorted(self.starts, self.offsets)
        return self

    def hash_words(self) -> Block:
        """Sets words: a 64-bit hash for each word, equal for equal words everywhere.

        Each byte counts by a random number for its value and its place in the word, so no pattern of bytes is special.
        """
        sizes = self.ends - self.starts
        if not len(sizes):
            self.words = np.zeros(0, dtype=U)
            return self
        begin = np.cumsum(sizes) - sizes
        place = np.arange(begin[-1] + sizes[-1]) - np.repeat(begin, sizes)
        values = TABLE[((place & 63) << 8) | self.data[place + np.repeat(self.starts, sizes)]]
        far = np.flatnonzero(place > 63)
        if len(far):
            values[far] *= mix((place[far] >> 6).astype(U) * U(BASE)) | U(1)
        self.words = mix(np.add.reduceat(values, begin) + sizes.astype(U))
        return self

    def digests(self) -> np.ndarray:
        """Two longs for each document: a BLAKE2 digest of its words joined by blanks; of its bytes if it has no word."""
        sizes = self.ends - self.starts
        begin = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        joined = np.full(total + len(sizes), 32, dtype=np.uint8)
        within = np.arange(total) - np.repeat(begin, sizes)
        joined[within + np.repeat(begin + np.arange(len(sizes)), sizes)] = self.data[within + np.repeat(self.starts, sizes)]
        at = (np.append(begin, total)[self.word_at] + self.word_at).tolist()
        raw, joined, offsets = self.data, joined.tobytes(), self.offsets.tolist()
        out = []
        for d in range(len(at) - 1):
            own = joined[at[d] : at[d + 1]] or b"\0" + raw[offsets[d] : offsets[d + 1]].tobytes()
            out.append(hashlib.blake2b(own, digest_size=16).digest())
        return np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)

    def hash_shingles(self, n: int) -> Block:
        """Sets shingles (hashes of n consecutive words; a document of fewer words has one of all its words) and shingle_at."""
        counts = np.diff(self.word_at)
        full = np.zeros(max(0, len(self.words) - n + 1), dtype=U)
        for k in range(n):
            full = full * U(BASE) + self.words[k : k + len(full)]
        per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        self.shingle_at = np.concatenate([[0], np.cumsum(per)])
        source = np.arange(self.shingle_at[-1]) - np.repeat(self.shingle_at[:-1], per) + np.repeat(self.word_at[:-1], per)
        self.shingles = np.zeros(len(source), dtype=U)
        whole = np.repeat(counts >= n, per)
        self.shingles[whole] = full[source[whole]]
        for d in np.flatnonzero((counts > 0) & (counts < n)):
            h = 0
            for w in self.words[self.word_at[d] : self.word_at[d + 1]].tolist():
                h = (h * BASE + w + 1) % (1 << 64)
            self.shingles[self.shingle_at[d]] = U(h)
        self.shingles = mix(self.shingles)
        return self


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = 1 << 20, lower: bool = True) -> Iterator[Block]:
    """The column's rows in order, about ``size`` bytes of whole documents at a time."""
    data, at = text_buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        last = min(last, n)
        part = data[at[row] : at[last]]
        yield Block(row, last, LOWER[part] if lower else part, at[row : last + 1] - at[row])
        row = last
