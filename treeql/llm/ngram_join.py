"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A text has a signature of LONGEST min-hashes in each of TREES trees; a tree is the prefix trie of its signatures, and
a trie node the texts that share a prefix. Matching begins at the whole signature. Each round, texts under one node
are brought together and verified on their whole shingle sets; from the links found, each text's share of links
still missed at this length is estimated (a link of similarity s is met at length d with probability 1 - (1 - s^d)^TREES).
Texts whose estimate reaches the target recall are settled; for the others the prefix is shortened by one, until
even a lone link at the threshold is met with the target recall. Candidate groups, not pairs, are carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeql.llm._arrow import release, text_runs
from treeql.llm._common import materialise, runs, spare
from treeql.llm._components import roots
from treeql.llm._segments import WORD_HASHES, utf8
from treeql.llm.substring_dedup import window_hashes

#: Trees, min-hashes of a signature in a tree, recall wanted of every text's links.
TREES, LONGEST, RECALL = 20, 6, 0.9999
#: Texts of a block and their shingles, about, and texts verified by one call.
BLOCK, BLOCK_SHINGLES, PACK = 1024, 1 << 20, 400
#: Characters whose shingles are hashed together.
CHARS = 1 << 19


def missed(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """Links not met at a prefix length for each one met, expected, at a similarity."""
    no = (1 - np.asarray(similarity, np.float64) ** depth) ** trees
    return no / np.maximum(1 - no, 1e-300)


def shortest(threshold: float, trees: int, longest: int, recall: float) -> int:
    """The prefix length at which a lone link at the threshold is met with the wanted recall: no text goes below."""
    return next((d for d in range(longest, 1, -1) if missed(threshold, d, trees) <= 1 - recall), 1)


def shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, text after text, and how many each text has.

    Words: runs without white space (space, tab, newline, \\v, \\f, \\r) with A-Z lower-cased. A text of fewer words, but not none, has
    one shingle of all its words.
    """
    split = [utf8(t).lower().split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    ids = np.fromiter((WORD_HASHES[w] for words in split for w in words), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    count = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    out = np.empty(int(count.sum()), np.uint64)
    starts = np.cumsum(count) - count
    every = window_hashes(ids, width)
    left = np.repeat(ends, lengths) - np.arange(len(ids))
    whole = np.flatnonzero(left[: len(every)] >= width)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    place = np.ones(len(out), bool)
    place[starts[short]] = False
    out[place] = every[whole]
    for i in short.tolist():
        n = int(lengths[i])
        out[starts[i]] = window_hashes(ids[ends[i] - n : ends[i]], n)[0] ^ np.uint64(n)
    return out, count


def _keys(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_101)
    a = rng.integers(0, 1 << 63, trees * depth, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, trees * depth, np.uint64)


def signatures(texts: list[str | None], width: int) -> tuple[list[np.ndarray | None], np.ndarray]:
    """For each text the min-hashes (32 bits) of all trees, one tree's after the other's, None without words; and its shingles."""
    a, b = _keys(TREES, LONGEST)
    out: list[np.ndarray | None] = []
    sizes = []
    for lo, hi in runs([len(t or "") for t in texts], CHARS):
        h, count = shingles(texts[lo:hi], width)
        some = np.flatnonzero(count)
        made: list[np.ndarray | None] = [None] * (hi - lo)
        if len(some):
            starts, least = (np.cumsum(count) - count)[some], np.empty((len(some), TREES * LONGEST), np.int32)
            with np.errstate(over="ignore"):
                for k in range(TREES * LONGEST):
                    least[:, k] = (np.minimum.reduceat(h * a[k] + b[k], starts) >> np.uint64(20)).astype(np.uint32).view(np.int32)
            for i, row in zip(some.tolist(), least, strict=True):
                made[i] = row
        out += made
        sizes.append(count)
    return out, np.concatenate(sizes) if sizes else np.empty(0, np.int64)


def overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """[i, j]: how many shingles set i of the first `left` shares with set j of the others, or of all if left is their number."""
    first = 0 if left == len(sets) else left
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one set alone are left out first.
    shared = held > 1
    number = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, col = owner[keep], number[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((left, len(sets) - first), np.float64)
    for a in range(0, int(shared.sum()), 4096):
        x, y = np.searchsorted(col, [a, a + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[x:y], col[x:y] - a] = 1
        out += part[:left] @ part[first:].T
    return out


def similar(texts: list[str | None], left: int, width: int, threshold: float) -> np.ndarray:
    """[i, j]: the Jaccard similarity of the shingle sets of text i of the first `left` and text j of the others (all, if left is their number), 0 where it is
    below the threshold, and of a text to itself."""
    h, count = shingles(texts, width)
    ends = np.cumsum(count)
    sets = [np.unique(h[e - n : e]) for e, n in zip(ends.tolist(), count.tolist(), strict=True)]
    both = overlaps(sets, left)
    sizes = np.array([len(s) for s in sets], np.float64)
    either = sizes[:left, None] + sizes[None, len(sets) - both.shape[1] :] - both
    out = np.where((both >= threshold * either - 1e-9) & (both > 0), both / np.maximum(either, 1), 0.0)
    if left == len(sets):
        np.fill_diagonal(out, 0.0)
    return out


def _labels(near: np.ndarray) -> np.ndarray:
    """The least index of each row's component; near: symmetric."""
    label = np.arange(len(near))
    while True:
        moved = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        moved = moved[moved]
        if (moved == label).all():
            return label
        label = moved


LINKS = "root long, node long, to long, links long, pairs long, missed array<double>"


def _verified(groups: DataFrame, texts: DataFrame, bodies: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links of the groups (node, root), whole: for each text with a link (in each block pair) its rows linked, texts linked, links missed by prefix length, and a text it is connected to.

    A group of several blocks is verified by pairs of blocks, small groups together in packs.
    """
    sizes = groups.join(texts.select("node", "shingles"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    packs = max(8, -(-groups.count() // PACK))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sent = groups.join(sizes, "root").join(texts.select("node", "md5", "copies"), "node").withColumn("own", own)
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "md5", "node", "copies", "root", "own",
        F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.col("root")).alias("pack"),
        F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
    )
    full = sent.join(bodies, "md5").drop("md5")

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for root, group in part.groupby("root", sort=False):
            whole = group["a"].iloc[0] == group["b"].iloc[0]
            group = group.sort_values(["own", "node"])
            node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            left = len(group) if whole else int((group["own"] == group["a"]).sum())
            if len(group) < 2 or not 0 < left or (left == len(group)) != whole:
                continue
            close = similar(group["text"].tolist(), left, width, threshold)
            near = close > 0
            if not near.any():
                continue
            lost = [np.where(near, missed(close, d, TREES), 0.0) for d in range(1, LONGEST + 1)]
            square = near if whole else np.block([[np.zeros((left, left), bool), near], [near.T, np.zeros((len(node) - left,) * 2, bool)]])
            label = _labels(square)
            sides = [(slice(None), near, copies, lost)] if whole else [(slice(left), near, copies[left:], lost), (slice(left, None), near.T, copies[:left], [x.T for x in lost])]
            for rows, linked, weight, gone in sides:
                some = linked.any(axis=1)
                out.append(pd.DataFrame({"root": root, "node": node[rows][some], "to": node[label[rows][some]], "links": (linked @ weight)[some], "pairs": linked.sum(axis=1)[some], "missed": list(np.stack([x.sum(axis=1) for x in gone], axis=1)[some])}))
        release()
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in LINKS.split(", ")})

    return full.groupBy("pack", "a", "b").applyInPandas(verify, LINKS)


def _prefixes(depth: int) -> Column:
    """The trie node of each tree at a depth, as one number."""
    return F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.slice("sig", t * LONGEST + 1, depth)))


def _matched(rows: DataFrame, texts: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All verified links of texts, and the candidate groups that they were found in."""
    spark = texts.sparkSession
    last = shortest(threshold, TREES, LONGEST, RECALL)
    # The tries are pruned first: a text alone at the shortest prefix of every tree meets none at any length.
    met = texts.select("node", F.explode(_prefixes(last)).alias("at"))
    shared = met.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1").select("at")
    texts = materialise(texts.join(met.join(shared, "at", "left_semi").select("node").distinct(), "node", "left_semi"), "tries")
    whole = lambda c: F.coalesce(c, F.lit(-1 << 63))
    # One row of each of their texts; null keys match too.
    wanted = texts.select("md5", whole(F.col("key")).alias("rowkey"))
    bodies = rows.select("text", "md5", whole(F.col("key")).alias("rowkey")).join(wanted, ["md5", "rowkey"], "left_semi").dropDuplicates(["md5"])
    bodies = materialise(bodies.select("md5", "text"), "bodies")
    groups, links = spark.createDataFrame([], "node long, root long"), spark.createDataFrame([], LINKS)
    settled = spark.createDataFrame([], "node long, settled boolean")
    for depth in range(LONGEST, last - 1, -1):
        # What is one group already is one member of every node.
        placed = texts.select("node", "sig").join(groups, "node", "left").join(settled, "node", "left")
        met = placed.select(F.coalesce("root", "node").alias("head"), F.col("settled").isNull().alias("open"), F.explode(_prefixes(depth)).alias("at"))
        # A trie node counts if a text that is not settled is under it, beside another group.
        joins = met.groupBy("at").agg(F.min("head").alias("to"), F.max("head").alias("most"), F.max("open").alias("open")).filter(F.col("open") & (F.col("to") < F.col("most"))).select("at", "to")
        merged = materialise(roots(met.join(joins, "at").filter(F.col("head") != F.col("to")).select(F.col("head").alias("u"), F.col("to").alias("v")).distinct()), "merged")
        if not merged.isEmpty():
            old = groups.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            groups = materialise(old.unionByName(merged.join(groups.select("node"), "node", "left_anti").select("node", "root")), "groups")
            changed = groups.join(merged.select("root").distinct(), "root", "left_semi").select("node", "root")
            kept = links.join(merged.select(F.col("node").alias("root")), "root", "left_anti").select(*links.columns)
            links = materialise(kept.unionByName(_verified(changed, texts, bodies, width, threshold)), "links")
        if depth > last:
            # A text's share of links not met, with one link at the threshold that was not seen.
            lone, gone = float(missed(threshold, depth, TREES)), F.sum(F.col("missed")[depth - 1])
            done = links.groupBy("node").agg(gone.alias("gone"), F.sum("pairs").alias("pairs")).filter(F.col("gone") + lone <= (1 - RECALL) * (F.col("pairs") + F.col("gone") + 1))
            settled = materialise(done.select("node", F.lit(True).alias("settled")), "settled")
    return links, groups


def jaccard_join(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each row of df: key (long), class_id (least key of its class), n_links, class_size, kept.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of `threshold` or more; a class is
    what links connect. n_links counts the other rows linked to a row, copies of its text included. kept marks
    one row of each class: that with the least key (null is greatest), of rows alike there one. Null texts and texts without words
    are never linked: each such row is a class of its own, with its own key. Keys must be integers;
    an empty table gives an empty result; other columns are not read.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("md5", F.md5(F.coalesce(F.col("text"), F.lit(""))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in text_runs(batch.column("text"), CHARS):
                signed, sizes = signatures(texts, width)
                own = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("md5"), pa.array(signed, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], names=["key", "md5", "sig", "shingles"])
        release()

    signed = materialise(rows.mapInArrow(sign, "key long, md5 string, sig array<int>, shingles long"), "signed")
    # Copies of a text are one node from here on.
    texts = signed.filter("sig IS NOT NULL").groupBy("md5").agg(F.min("key").alias("key"), F.count("*").alias("copies"), F.min("sig").alias("sig"), F.min("shingles").alias("shingles"))
    texts = materialise(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    verified, _ = _matched(rows, texts, width, threshold)
    classes = roots(verified.select(F.col("node").alias("u"), F.col("to").alias("v")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    placed = texts.select("node", "md5", "key", "copies").join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    last = F.struct(F.col("key").isNull().alias("none"), "key", "md5")
    of_class = placed.groupBy("root").agg(F.min(last).alias("first"), F.sum("copies").alias("class_size"))
    by_text = placed.join(of_class, "root").select("md5", F.col("first.key").alias("class_id"), F.col("first.md5").alias("first_md5"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_size")
    # Rows alike in key and text are counted, so that one of them is kept.
    alike = signed.groupBy("key", "md5", F.col("sig").isNull().alias("bare")).agg(F.count("*").alias("n"))
    out = alike.join(by_text, "md5", "left")
    first = F.col("bare") | (F.col("key").eqNullSafe(F.col("class_id")) & (F.col("md5") == F.col("first_md5")))
    return out.select(
        "key", F.when(F.col("bare"), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("bare"), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(F.col("bare"), 1).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        first.alias("first"), "bare", "md5", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"),
    ).withColumn("kept", F.col("bare") | (F.col("first") & (F.col("copy") == 1))).drop("first", "bare", "copy")


def drop_near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """df with one row of each class of jaccard_join(); texts without words all stay. All columns pass through."""
    own, md5 = spare(df, "key"), spare(df, "md5")
    kept = jaccard_join(df, text, key, width, threshold).filter("kept").select(F.struct("key").alias(own), F.col("md5").alias(md5)).distinct()
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # In a struct a null key equals itself and no number.
    marked = df.withColumns({md5: F.md5(body), own: F.struct(F.col(f"`{key}`").cast("long").alias("key"))})
    marked = marked.join(kept, [md5, own], "left_semi")
    wordless = ~F.rlike(body, F.lit(r"[^\x20\x09-\x0D]"))
    one = marked.filter(~wordless).dropDuplicates([md5, own])
    return one.unionByName(marked.filter(wordless)).drop(md5, own)
