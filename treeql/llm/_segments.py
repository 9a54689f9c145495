"""Segments: documents dealt evenly into groups of bounded text, which ask the whole corpus about what they hold.

A segment sends the distinct keys it holds (hashes, words, grams), packed by bucket, and gets an answer for them.
Keys are pre-aggregated in the segment before the shuffle, so a key that a third of all documents hold travels
once for each segment; the documents themselves travel once, for both sides of the exchange read one shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeql.llm._common import text_bytes

#: Bytes of text in a segment, the least number of segments, and words whose hash a worker remembers.
SEGMENT, LEAST, CACHED = 4 << 20, 24, 300_000


def segmented(df: DataFrame, text: str, key: str, total: int | None = None, size: int = SEGMENT) -> tuple[DataFrame, int]:
    """Rows (seg, key, text) dealt by the hash of key and text, the key as text; and the number of segments.

    A null key or text is hashed like any other; many rows alike in both would share a segment.
    """
    n = max(LEAST, -(-(text_bytes(df, text) if total is None else total) // size))
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.select(F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("int").alias("seg"), "key", "text").repartition("seg"), n


class WordHashes(dict):
    """Word -> 64-bit hash; starts anew beyond CACHED words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORD_HASHES = WordHashes()


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; by sorting, which is faster than numpy's hashing for what repeats as much."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's index in a sorted table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n (below 2^24) equal ranges of 64-bit keys each key falls in."""
    return ((keys >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)


def packets(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending keys: the ranges that are not empty, and where each begins and the last ends. No step is by range."""
    own = buckets_of(keys, n)
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    return own[cuts], np.append(cuts, len(keys))


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of an array of 8-byte values as binary cells over one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed cells, and where each cell's begin and the last ends."""
    values, cuts, held = [np.empty(0, kind)], [np.zeros(1, np.int64)], 0
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, 4 * chunk.offset).astype(np.int64) if len(chunk) else np.zeros(1, np.int64)
        own = np.frombuffer(chunk.buffers()[2], kind, int(ends[-1] - ends[0]) // 8, int(ends[0])) if ends[-1] > ends[0] else np.empty(0, kind)
        values.append(own)
        cuts.append((ends[1:] - ends[0]) // 8 + held)
        held += len(own)
    return np.concatenate(values), np.concatenate(cuts)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
