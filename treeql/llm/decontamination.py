"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments of bounded text; each segment stores, for every term in it, the ascending
positions at which it occurs, and a directory of its documents. Query phrases are a table too: each is joined to the
index by its rarest term in the whole corpus, so a segment only sees phrases that can occur in it, and
only segments with phrases send their postings of the benchmark's terms. There the terms' position lists, each shifted by the term's offset, are
intersected from the rarest term on. A document lies in one segment only, so every answer about it is made there;
nothing of the corpus or the benchmark reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeql.llm._arrow import release, text_runs
from treeql.llm._common import materialise

#: Characters of text in a segment (one document may exceed it); windows of the benchmark in a batch; terms of the benchmark that are broadcast.
SEGMENT, WINDOWS, SMALL = 8 << 20, 20_000, 1_000_000

#: Lower-cases A-Z and turns every other byte below 0x80 but digits and letters into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: The document key is held as text, so that pandas never turns it into a float.
SPANS = "array<struct<start:int,end:int>>"
INDEX = "segment long, term string, n long, postings binary, doc_id string, starts binary"


def terms_of(text: str | None) -> list[bytes]:
    """Words of digits, a-z and characters from U+0080 on, after lower-casing A-Z; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if isinstance(text, str) else []


class _Segment:
    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.keys, self.ends, self.held, self.words = [], [], [], 0, 0

    def add(self, key: object, text: str | None) -> None:
        words = terms_of(text)
        number = self.number
        self.ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        self.words += len(words)
        self.keys.append(key if isinstance(key, str) else None)
        self.ends.append(self.words)
        self.held += len(text) if isinstance(text, str) else 0

    def rows(self, segment: int) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        data = np.argsort(ids, kind="stable").astype(np.uint32)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(self.number)))])
        n, m = len(self.number), len(self.keys)
        bounds = np.array([[0, *self.ends[:-1]], self.ends], np.uint32).T
        # Postings are slices of one buffer; the directory's rows have none.
        offsets = np.concatenate([4 * cuts, np.full(m, 4 * cuts[-1])]).astype(np.int32)
        some = np.packbits(np.arange(n + m) < n, bitorder="little")
        postings = pa.Array.from_buffers(pa.binary(), n + m, [pa.py_buffer(some), pa.py_buffer(offsets), pa.py_buffer(data)], null_count=m)
        columns = [
            pa.array(np.full(n + m, segment, np.int64)),
            pa.array([*(t.decode("utf-8", "replace") for t in self.number), *[None] * m], pa.string()),
            pa.array(np.append(np.diff(cuts), np.zeros(m, np.int64))),
            postings,
            pa.array([*[None] * n, *self.keys], pa.string()),
            pa.array([*[None] * n, *(row.tobytes() for row in bounds)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "term", "n", "postings", "doc_id", "starts"])


def build_index(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The stored index: rows with a term have its postings in the segment (uint32, ascending) and their number n; rows without
    one are the directory: a document's key and its first and last position.

    Written once to the shared folder, so segments stay the same whatever executors are lost later.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, now = TaskContext.get().partitionId() << 32, 0, _Segment()
        for batch in batches:
            keys = batch.column("k").to_pylist()
            for a, texts in text_runs(batch.column("t"), SEGMENT):
                for k, t in zip(keys[a:], texts, strict=False):
                    if now.held and now.held + len(t or "") > SEGMENT:
                        yield now.rows(base + made)
                        made, now = made + 1, _Segment()
                    now.add(k, t)
        if now.keys:
            yield now.rows(base + made)
        del now
        release()

    rows = df.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return materialise(rows.mapInArrow(build, INDEX), "postings")


def windows(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """Every run of `width` words; fewer words, but not none, are one window."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return list(dict.fromkeys(zip(*(words[i:] for i in range(width)), strict=False)))


def phrases_of(benchmark: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(phrase, item): every window of every item, each pair once; a phrase is its words joined by one space."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, body in zip(batch["item"], batch["body"], strict=True):
                found = [b" ".join(w).decode("utf-8", "replace") for w in windows(terms_of(body), width)]
                for a in range(0, len(found), WINDOWS):
                    yield pd.DataFrame({"phrase": found[a : a + WINDOWS], "item": item})

    rows = benchmark.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("body"))
    return rows.filter(F.col("body").isNotNull()).mapInPandas(cut, "phrase string, item string").distinct()


def phrase_matches(words: list[str], anchor: int, postings: dict[str, np.ndarray], bounds: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first position, last position) of every match, one for each position of the anchor term at which there is one.

    bounds: first position of each document and the position behind its last. Offset-adjusted lists intersect, the rarest
    first. With slop, every other term may stand up to so many places before or after its place beside the anchor's,
    within the anchor's document; the nearest counts, of two the earlier.
    """
    none = np.empty(0, np.int64)
    if any(w not in postings for w in words):
        return none, none, none
    at = postings[words[anchor]]
    if slop == 0:
        first = at - anchor
        for i in sorted((i for i in range(len(words)) if i != anchor), key=lambda i: len(postings[words[i]])):
            found, want = postings[words[i]], first + i
            first = first[found[np.minimum(np.searchsorted(found, want), len(found) - 1)] == want]
            if not len(first):
                return none, none, none
        own = np.searchsorted(bounds[:, 0], first, side="right") - 1
        whole = (own >= 0) & (first + len(words) <= bounds[own, 1])
        return own[whole], first[whole], first[whole] + len(words) - 1
    own = np.searchsorted(bounds[:, 0], at, side="right") - 1
    low = high = at
    for i in sorted((i for i in range(len(words)) if i != anchor), key=lambda i: len(postings[words[i]])):
        if not len(at):
            break
        found, (start, end) = postings[words[i]], bounds[own].T
        want = at + (i - anchor)
        near = np.clip(want, start, end - 1)
        right = np.minimum(np.searchsorted(found, near), len(found) - 1)
        left = np.maximum(np.searchsorted(found, near, side="right") - 1, 0)
        fits = lambda x: (x >= start) & (x < end) & (np.abs(x - want) <= slop)  # noqa: E731, B023
        a, b = found[left], found[right]
        before = fits(a) & (~fits(b) | (np.abs(a - want) <= np.abs(b - want)))  # noqa: B023
        place, kept = np.where(before, a, b), fits(a) | fits(b)
        at, own, low, high = at[kept], own[kept], np.minimum(low, place)[kept], np.maximum(high, place)[kept]
    return own, low, high


FOUND = f"segment long, ordinal int, doc_id string, n_words long, spans {SPANS}, items array<string>"


def search(index: DataFrame, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """Match (phrase, item) rows in the index. A row for each document, matched or not: segment, ordinal (in the segment), doc_id,
    n_words, spans (start and end, in words, of each maximal run of words hit), items (those with a match).
    """
    named = index.filter(F.col("term").isNotNull())
    single = phrases.select("phrase").distinct()
    terms = single.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("term"))
    vocabulary = materialise(terms.select("term").distinct(), "terms")
    # The benchmark's vocabulary is broadcast while it is small, so that the index is not shuffled to find its terms.
    vocabulary = F.broadcast(vocabulary) if vocabulary.count() <= SMALL else vocabulary
    named = named.join(vocabulary, "term", "left_semi")
    counts = named.groupBy("term").agg(F.sum("n").alias("n"))
    # Phrases of which a term occurs nowhere are left out; the others go where their rarest term is.
    rarest = terms.join(counts, "term", "left").groupBy("phrase").agg(F.min(F.struct("n", "term")).alias("r"), F.max(F.col("n").isNull()).alias("gone")).filter(~F.col("gone")).select("phrase", F.col("r.term").alias("term"))
    sent = materialise(named.select("segment", "term").join(rarest, "term"), "phrases")
    asked = sent.withColumnRenamed("term", "anchor").join(phrases, "phrase")
    null = lambda kind: F.lit(None).cast(kind)
    column = lambda name, kind, own: F.col(name) if name in own else null(kind).alias(name)
    shape = [("segment", "long"), ("term", "string"), ("postings", "binary"), ("doc_id", "string"), ("starts", "binary"), ("phrase", "string"), ("anchor", "string"), ("item", "string")]
    parts = [
        (named.join(sent.select("segment").distinct(), "segment", "left_semi"), ("segment", "term", "postings")),
        (index.filter(F.col("term").isNull()), ("segment", "doc_id", "starts")),
        (asked, ("segment", "phrase", "anchor", "item")),
    ]
    rows = [df.select(*[column(n, k, own) for n, k in shape]) for df, own in parts]

    def match(part: pd.DataFrame) -> pd.DataFrame:
        of_term, of_phrase = part["term"].notna().to_numpy(), part["phrase"].notna().to_numpy()
        postings = {t: np.frombuffer(p, np.uint32).astype(np.int64) for t, p in zip(part["term"][of_term], part["postings"][of_term], strict=True)}
        docs = part[~of_term & ~of_phrase]
        bounds = np.frombuffer(b"".join(docs["starts"]), np.uint32).reshape(-1, 2).astype(np.int64)
        order = np.lexsort((bounds[:, 1], bounds[:, 0]))
        bounds, keys = bounds[order], docs["doc_id"].to_numpy()[order]
        # Documents without words hold no position; those with words stand in order.
        full = np.flatnonzero(bounds[:, 1] > bounds[:, 0])
        edge = np.zeros(int(bounds[:, 1].max(initial=0)) + 2, np.int32)
        found: dict[int, set[str]] = {}
        asking: dict[tuple[str, str], list[str]] = {}
        for phrase, anchor, item in zip(*(part[c][of_phrase] for c in ("phrase", "anchor", "item")), strict=True):
            asking.setdefault((phrase, anchor), []).append(item)
        held = bounds[full]
        for (phrase, anchor), items in asking.items():
            words = phrase.split(" ")
            own, low, high = phrase_matches(words, words.index(anchor), postings, held, slop)
            if not len(own):
                continue
            np.add.at(edge, low, 1)
            np.add.at(edge, high + 1, -1)
            for k in full[np.unique(own)].tolist():
                found.setdefault(k, set()).update(items)
        spans = [[] for _ in keys]
        hit = np.cumsum(edge) > 0
        for k in found:
            a, b = bounds[k]
            change = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))).tolist()
            spans[k] = [{"start": x, "end": y} for x, y in zip(change[::2], change[1::2], strict=True)]
        out = pd.DataFrame({
            "segment": np.full(len(keys), part["segment"].iloc[0]),
            "ordinal": np.arange(len(keys), dtype=np.int32),
            "doc_id": keys,
            "n_words": bounds[:, 1] - bounds[:, 0],
            "spans": spans,
            "items": [sorted(found.get(k, ())) for k in range(len(keys))],
        })
        del postings
        release()
        return out

    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("segment").applyInPandas(match, FOUND)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", width: int = 10, slop: int = 0) -> DataFrame:
    """Exact phrase (slop 0) or proximity matches of every benchmark window in every document.

    One row for each document row: doc_id (the key as text), n_words, spans (maximal runs of words hit), items (those with an
    occurring window, as text, in order). Null texts and texts without words have no words, no spans and no
    items; an item without words has no window; repeated rows each get their row; other columns of either
    table are not read. An empty benchmark hits nothing. With slop, words from the first to the last term of a match are hit.
    """
    found = search(build_index(df, text, key), phrases_of(benchmark, item_text, item_key, width), slop)
    return found.drop("segment", "ordinal")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated from decontaminate()'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
