"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted over the whole corpus.

A segment of documents sends the hashes of its windows, each once and marked if it occurs twice there already;
each range of hashes is counted by one task; those that occur again anywhere go back to the segments that sent
them, where repeated windows merge into maximal intervals of words to remove.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeql.llm._common import text_bytes
from treeql.llm._segments import WORD_HASHES, distinct, find, packed, packets, segmented, unpacked, utf8

#: Base of the polynomial (odd, so that it has an inverse modulo 2^64), and windows counted by one task.
BASE, COUNTED = 0x9E3779B97F4A7C15, 1 << 20


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of word hashes: sum of id * BASE^place modulo 2^64, then mixed."""
    n = len(ids)
    if n < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, np.uint64), np.full(n - width + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * np.cumprod(up), dtype=np.uint64)])
        h = (prefix[width:] - prefix[:-width]) * np.cumprod(down)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return h


class _Words:
    """The words of a segment's documents in a row, with the hashes of all windows inside one document."""

    def __init__(self, texts: list[str | None], width: int):
        self.split = [utf8(t).split() for t in texts]
        self.lengths = np.array([len(w) for w in self.split], np.int64)
        self.ends = np.cumsum(self.lengths)
        ids = np.fromiter((WORD_HASHES[w] for words in self.split for w in words), np.uint64, int(self.lengths.sum()))
        all_of = window_hashes(ids, width)
        left = np.repeat(self.ends, self.lengths) - np.arange(len(ids))
        self.starts = np.flatnonzero(left[: len(all_of)] >= width)
        self.hashes = all_of[self.starts]


def repeated_spans(df: DataFrame, width: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key (as text), n_words, spans (array of start and end, in words: the maximal intervals covered by windows
    whose word sequence starts anywhere else too) and kept (the other words, joined by one space).

    Words are maximal runs without space, tab, newline, \\v, \\f and \\r, compared as they are. Windows are judged on the
    input. One row for each input row: null texts have no words and an empty kept text, texts shorter than a window
    lose nothing, and of rows with equal texts of at least a window every one loses all its words.
    """
    total = text_bytes(df, text)
    docs, _ = segmented(df, text, key, total)
    buckets = max(8, -(-total // (6 * COUNTED)))

    def send(part: pa.Table) -> pa.Table:
        hashes, n = np.unique(_Words(part["text"].to_pylist(), width).hashes, return_counts=True)
        # What occurs again here already is sent twice, so that it counts as repeated wherever it is met.
        hashes = np.repeat(hashes, np.minimum(n, 2))
        bucket, cuts = packets(hashes, buckets)
        return pa.table({"bucket": bucket, "seg": np.full(len(bucket), part["seg"][0].as_py(), np.int32), "hashes": packed(hashes, cuts)})

    def count(part: pa.Table) -> pa.Table:
        sent, cuts = unpacked(part["hashes"], np.uint64)
        every = np.sort(sent)
        again = distinct(every[1:][every[1:] == every[:-1]])
        hit = find(again, sent) >= 0
        held = np.concatenate([[0], np.cumsum(hit)])[cuts]
        some = np.flatnonzero(np.diff(held))
        return pa.table({"seg": part["seg"].to_numpy().astype(np.int32)[some], "again": packed(sent[hit], np.append(held[some], held[-1]))})

    def remove(docs_of: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs_of):
            return pd.DataFrame({"key": [], "n_words": [], "spans": [], "kept": []})
        own = _Words(docs_of["text"].tolist(), width)
        again = np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in answers["again"])]))
        at = own.starts[np.isin(own.hashes, again)]
        edge = np.zeros(int(own.lengths.sum()) + 1, np.int32)
        edge[at] += 1
        np.subtract.at(edge, at + width, 1)
        covered = np.cumsum(edge[:-1]) > 0
        spans, kept = [], []
        for words, end, n in zip(own.split, own.ends.tolist(), own.lengths.tolist(), strict=True):
            gone = covered[end - n : end]
            if gone.any():
                change = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                spans.append([{"start": a, "end": b} for a, b in zip(change[::2], change[1::2], strict=True)])
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                spans.append([])
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"key": docs_of["key"], "n_words": own.lengths, "spans": spans, "kept": kept})

    sent = docs.groupBy("seg").applyInArrow(send, "bucket int, seg int, hashes binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "seg int, again binary")
    return docs.groupBy("seg").cogroup(answers.groupBy("seg")).applyInPandas(remove, "key string, n_words long, spans array<struct<start:int,end:int>>, kept string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 from repeated_spans()'s rows."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("key").cast("long").alias("doc_id"), "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
