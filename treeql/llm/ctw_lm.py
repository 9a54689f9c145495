"""Context-tree weighting over bytes.

Each byte is eight binary decisions; a decision's context is the bytes before, up to `DEPTH` of them, and the
bits already known. Every context of every depth keeps a Krichevsky-Trofimov estimate of its decisions in the
training texts; the tree weights a context's own estimate against those of its longer contexts by how well
either coded the training texts, which mixes all depths. Counts of grams (DEPTH bytes and the next) hold all that
is needed: they are summed in Spark, the tree is computed by packs of suffixes of three bytes, contexts of two bytes are summed over
packs, and only the two topmost depths (at most 257 x 255 decisions) meet on the driver. A text's probability is the product over its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeql.llm._common import materialise, runs, text_bytes
from treeql.llm._segments import WORD_HASHES, distinct, find, packed, packets, segmented, unpacked, utf8

#: Bytes of context; bytes of text in a segment and in a block; keys looked up by one task.
DEPTH, SEGMENT, BLOCK, ASKED = 5, 4 << 20, 1 << 20, 1 << 20
#: Last bytes of a context by which grams are dealt, and grams of a pack.
TOP, PACKED = 3, 100_000
#: Of each kind, so many most frequent keys are broadcast (16 bytes each); only others are asked for.
HEAD = 1 << 17
#: What ends every text: a token of its own and the last byte. Texts also begin behind DEPTH of them.
END = b"\n"
#: An odd number: multiplying grams by it deals them evenly over the 64-bit keys.
SPREAD = 0x9E3779B97F4A7C15
WORDS, GRAMS = 0, 1


def normal_words(text: str | None) -> list[bytes]:
    """Runs without space, tab, newline, \\v, \\f and \\r, with A-Z lower-cased; null has none."""
    return utf8(text).lower().split()


def stream(words: list[bytes]) -> bytes:
    return END * DEPTH + b" ".join(words) + END


def grams(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte of every stream but its first DEPTH, and where each stream's begin."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    n = len(data) - DEPTH
    code = np.zeros(n, np.uint64)
    for j in range(DEPTH + 1):
        code <<= np.uint64(8)
        code |= data[j : j + n]
    ends = np.cumsum([len(s) for s in streams])
    # The DEPTH codes that cross into the next stream are left out.
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[e - DEPTH : e] = False
    sizes = np.array([len(s) - DEPTH for s in streams], np.int64)
    return code[inside], np.cumsum(sizes) - sizes


class Tally:
    """Keys with counts, added up when more than `most` have gathered."""

    def __init__(self, most: int = 1_500_000):
        self.most, self.held, self.parts = most, 0, []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held > self.most:
            self.most = max(self.most, 2 * len(self.sum()[0]))

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip((np.empty(0, np.uint64), np.empty(0, np.int64)), *self.parts, strict=True))
        codes, values = pd.factorize(keys)
        self.parts = [(values, np.bincount(codes, n, len(values)).astype(np.int64))]
        self.held = len(values)
        return self.parts[0]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of gamma for x >= 1/2: Stirling's series after eight steps of the recurrence."""
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the KT probability of any one sequence of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class SuffixTree:
    """All contexts from depth `top` on that end on one suffix of `top` bytes, from grams and their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, top: int):
        self.codes, self.top = codes, top
        symbol = codes & 0xFF
        # decision[g, j]: the node (1 and the bits known) of the j-th bit of the gram's last byte
        steps = np.arange(8)
        self.node = (1 << steps)[None, :] | (symbol[:, None] >> (8 - steps)[None, :])
        self.bit = (symbol[:, None] >> (7 - steps)[None, :]) & 1
        self.at, self.counts, self.own, self.whole = {}, {}, {}, {}
        weight = np.repeat(counts.astype(np.float64), 8)
        below: np.ndarray | None = None
        for depth in range(DEPTH, top - 1, -1):
            context = (codes >> 8) & ((1 << (8 * depth)) - 1)
            key = ((context[:, None] << 8) | self.node).reshape(-1)
            at, keys = pd.factorize(key)
            n1 = np.bincount(at, weight * self.bit.reshape(-1), len(keys))
            n0 = np.bincount(at, weight, len(keys)) - n1
            own = log_kt(n0, n1)
            if below is None:
                whole = own
            else:
                # Each deeper decision belongs to one here; the deeper keys' first grams tell which.
                parent = np.zeros(len(below), np.int64)
                parent[self.at[depth + 1]] = at
                whole = np.logaddexp(own, np.bincount(parent, below, len(keys))) - math.log(2)
            self.at[depth], self.counts[depth], self.own[depth], self.whole[depth] = at, (n0, n1), own, whole
            below = whole
        self.keys = keys

    def mixed(self) -> np.ndarray:
        """[gram, bit]: probability of the bit that the gram has, from depth `top` on."""
        bit = self.bit.reshape(-1)
        p: np.ndarray | None = None
        for depth in range(DEPTH, self.top - 1, -1):
            at, (n0, n1) = self.at[depth], self.counts[depth]
            kt = (np.where(bit == 1, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
            if p is None:
                p = kt
            else:
                w = 0.5 * np.exp(self.own[depth] - self.whole[depth])[at]
                p = w * kt + (1 - w) * p
        return p.reshape(-1, 8)


def _level(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes with counts and their children's logs: log of the weighted probability, own weight and P(1)."""
    own = log_kt(n0, n1)
    whole = np.logaddexp(own, below) - math.log(2)
    return whole, 0.5 * np.exp(own - whole), (n1 + 0.5) / (n0 + n1 + 1)


def _top_of_tree(sums: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """From counts and children's logs by (last byte, decision): own weight and P(1) at depths 1 and 0."""
    n0, n1, below = np.zeros((3, 256, 256))
    at = sums["byte"].to_numpy(), sums["node"].to_numpy()
    n0[at], n1[at], below[at] = sums["n0"], sums["n1"], sums["whole"]
    whole, w1, p1 = _level(n0, n1, below)
    _, w0, p0 = _level(n0.sum(axis=0), n1.sum(axis=0), whole.sum(axis=0))
    return w1, p1, w0, p0


def gram_logs(counted: DataFrame) -> DataFrame:
    """(gram, its spread key, log10 of the probability of its last byte, n) for every row (gram, n) of counts; n may be 0.

    Grams are dealt by the last TOP bytes of their context, many such suffixes to a pack: a pack computes all deeper
    contexts. Contexts of TOP - 1 = 2 bytes are sums over packs, made in Spark; those of one byte and none, on the driver.
    """
    spark = counted.sparkSession
    packs = max(8, -(-counted.count() // PACKED))
    dealt = counted.withColumn("pack", F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND((1 << 8 * TOP) - 1)), F.lit(packs)))

    def weigh(part: pd.DataFrame) -> pd.DataFrame:
        tree = SuffixTree(part["gram"].to_numpy(), part["n"].to_numpy(), TOP)
        n0, n1 = tree.counts[TOP]
        # Nodes of one pack and of one context of two bytes are added up before they travel.
        at, keys = pd.factorize(tree.keys & 0xFFFFFF)
        added = [np.bincount(at, x, len(keys)) for x in (n0, n1, tree.whole[TOP])]
        return pd.DataFrame({"pack": np.full(len(keys), part["pack"].iloc[0]), "key": keys, "n0": added[0], "n1": added[1], "whole": added[2]})

    def levelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole, w, p = _level(b["n0"].to_numpy(), b["n1"].to_numpy(), b["whole"].to_numpy())
            yield b.assign(whole=whole, w=w, p=p)

    weighed = materialise(dealt.groupBy("pack").applyInPandas(weigh, "pack long, key long, n0 double, n1 double, whole double"), "suffixes")
    second = weighed.groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("whole").alias("whole")).mapInPandas(levelled, "key long, n0 double, n1 double, whole double, w double, p double")
    second = materialise(second, "suffixes")
    sums = second.groupBy(F.shiftright("key", 8).bitwiseAND(0xFF).cast("int").alias("byte"), F.col("key").bitwiseAND(0xFF).cast("int").alias("node"))
    sums = sums.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("whole").alias("whole")).toPandas()
    sent = spark.sparkContext.broadcast(_top_of_tree(sums))
    above = weighed.select("pack", "key").join(second.select("key", "w", "p"), "key")

    def mix(part: pd.DataFrame, second_of: pd.DataFrame) -> pd.DataFrame:
        w1, p1, w0, p0 = sent.value
        tree = SuffixTree(part["gram"].to_numpy(), part["n"].to_numpy(), TOP)
        order = np.argsort(second_of["key"].to_numpy())
        at = order[np.searchsorted(second_of["key"].to_numpy()[order], ((tree.codes >> 8 & 0xFFFF) << 8)[:, None] | tree.node)]
        w2, p2 = second_of["w"].to_numpy()[at], second_of["p"].to_numpy()[at]
        byte = np.repeat(tree.codes >> 8 & 0xFF, 8).reshape(-1, 8)
        of = lambda p: np.where(tree.bit == 1, p, 1 - p)
        p = w2 * of(p2) + (1 - w2) * tree.mixed()
        p = w1[byte, tree.node] * of(p1[byte, tree.node]) + (1 - w1[byte, tree.node]) * p
        p = w0[tree.node] * of(p0[tree.node]) + (1 - w0[tree.node]) * p
        return pd.DataFrame({"gram": tree.codes, "spread": spread(tree.codes).view(np.int64), "log": np.log10(p).sum(axis=1), "n": part["n"]})

    return dealt.groupBy("pack").cogroup(above.groupBy("pack")).applyInPandas(mix, "gram long, spread long, log double, n long")


def head_of(known: DataFrame, most: int) -> pd.DataFrame:
    """(kind, key, value) of the most frequent keys of each kind, `most` at most: those from a count on, found from a histogram of counts."""
    scale = F.floor(F.log2(F.col("n") + 1) * 16).cast("int")
    bars, held = {WORDS: 1 << 30, GRAMS: 1 << 30}, {WORDS: 0, GRAMS: 0}
    for r in sorted(known.groupBy("kind", scale.alias("bar")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["bar"]):
        held[r["kind"]] += r["rows"]
        if held[r["kind"]] <= most:
            bars[r["kind"]] = r["bar"]
    return known.filter(scale >= F.when(F.col("kind") == WORDS, bars[WORDS]).otherwise(bars[GRAMS])).select("kind", "key", "value").toPandas()


def spread(code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return code.view(np.uint64) * np.uint64(SPREAD)


class _Held:
    """What a segment's texts hold: tokens' and bytes' keys in order, and the distinct ones of each kind."""

    def __init__(self, texts: list[str | None]):
        split = [normal_words(t) for t in texts]
        self.n_tokens = np.array([len(w) + 1 for w in split], np.int64)
        end = WORD_HASHES[END]
        tokens = np.fromiter((h for words in split for h in (*map(WORD_HASHES.__getitem__, words), end)), np.uint64, int(self.n_tokens.sum()))
        code, self.firsts = grams([stream(w) for w in split])
        self.keys = {WORDS: tokens, GRAMS: code}


def _asked(texts: list[str | None], kind: int, head: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The distinct keys of a kind that are not of the head, in ascending order."""
    held = _Held(texts)
    keys = distinct(held.keys[kind] if kind == WORDS else spread(held.keys[kind]))
    return keys[find(head[kind][0], keys) < 0]


def score_texts(df: DataFrame, train: Column, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key (as text), n_tokens, n_known, train_tokens, base_score, score, code_bits (the model's bits per byte).

    The model learns from rows where `train` holds (null: does not) and scores every row, learned from or not. Both scores are of
    the words with A-Z lower-cased: the base adds over tokens (words and one end) log10((c + 0.1) / (N + 0.1 (V + 1)));
    score is the tree's log10 probability of the words joined by single spaces and an end byte. A null text is empty: one
    token, one byte. Without a training row N and V are 0 and every bit costs one bit. One row for each input row;
    columns other than text, key and what `train` reads play no part. Words are told apart by 64-bit hashes.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies = {WORDS: Tally(), GRAMS: Tally()}
        for batch in batches:
            texts, learns = batch["text"].tolist(), batch["train"].to_numpy(bool)
            for a, b in runs([len(t or "") for t in texts], BLOCK):
                held = _Held(texts[a:b])
                lengths = {WORDS: held.n_tokens, GRAMS: np.diff(np.append(held.firsts, len(held.keys[GRAMS])))}
                for kind, tally in tallies.items():
                    own = np.repeat(learns[a:b], lengths[kind])
                    tally.add(*np.unique(held.keys[kind][own], return_counts=True))
                    if kind == GRAMS:
                        # Grams of texts not learned from are known too, with no count.
                        rest = distinct(held.keys[kind][~own])
                        tally.add(rest, np.zeros(len(rest), np.int64))
        for kind, tally in tallies.items():
            keys, n = tally.sum()
            for a in range(0, len(keys), 200_000):
                yield pd.DataFrame({"kind": np.full(len(keys[a : a + 200_000]), kind, np.int32), "key": keys[a : a + 200_000].view(np.int64), "n": n[a : a + 200_000]})

    total = text_bytes(df, text)
    counts = rows.select("text", "train").mapInPandas(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "counts")
    sums = counts.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, vocabulary = sums["n"], sums["v"]

    logs = gram_logs(counts.filter(F.col("kind") == GRAMS).select(F.col("key").alias("gram"), "n"))
    known = counts.filter(F.col("kind") == WORDS).select("kind", "key", F.col("n").cast("double").alias("value"), "n").unionByName(logs.select(F.lit(GRAMS).alias("kind"), F.col("spread").alias("key"), F.col("log").alias("value"), "n"))
    buckets = max(8, -(-total // (12 * ASKED)))
    known = materialise(known, "model").withColumn("bucket", F.shiftright(F.shiftrightunsigned("key", 40) * buckets, 24).cast("int"))
    frequent, head = head_of(known, HEAD), {}
    for kind in (WORDS, GRAMS):
        own = frequent[frequent["kind"] == kind]
        keys = own["key"].to_numpy(np.int64).view(np.uint64)
        head[kind] = keys[np.argsort(keys)], own["value"].to_numpy(np.float64)[np.argsort(keys)]
    sent = spark.sparkContext.broadcast(head)
    known = known.drop("n")
    docs, _ = segmented(df, text, key, total, SEGMENT)
    wanted = "kind int, bucket int, seg int, keys binary"

    def ask(part: pa.Table) -> pa.Table:
        texts, out = part["text"].to_pylist(), []
        for kind in (WORDS, GRAMS):
            keys = _asked(texts, kind, sent.value)
            bucket, cuts = packets(keys, buckets)
            out.append(pa.table({"kind": np.full(len(bucket), kind, np.int32), "bucket": bucket, "seg": np.full(len(bucket), part["seg"][0].as_py(), np.int32), "keys": packed(keys, cuts)}))
        return pa.concat_tables(out)

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        kinds, found = asked["kind"].to_numpy(), []
        held_kinds, held_keys, held_values = held["kind"].to_numpy(), held["key"].to_numpy().view(np.uint64), held["value"].to_numpy()
        for kind in (WORDS, GRAMS):
            own = asked.filter(pa.array(kinds == kind))
            want, cuts = unpacked(own["keys"], np.uint64)
            mine = held_kinds == kind
            order = np.argsort(held_keys[mine])
            at = find(held_keys[mine][order], want)
            # What is not found has value 0.
            values = np.append(held_values[mine][order], 0.0)[at]
            found.append(pa.table({"kind": own["kind"].to_numpy(), "bucket": own["bucket"].to_numpy(), "seg": own["seg"].to_numpy(), "found": packed(values, cuts)}))
        return pa.concat_tables(found)

    def score(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"key": [], "n_tokens": [], "n_known": [], "base": [], "score": [], "n_bytes": []})
        held = _Held(part["text"].tolist())
        of = {}
        for kind in (WORDS, GRAMS):
            own = answers[answers["kind"] == kind].sort_values("bucket")
            every = held.keys[kind] if kind == WORDS else spread(held.keys[kind])
            codes, keys = pd.factorize(every)
            order = np.argsort(keys)
            table, values = sent.value[kind]
            at = find(table, keys[order])
            # The keys asked for, in order, take the answers, in order.
            value = np.empty(len(keys))
            value[at >= 0] = values[at[at >= 0]]
            value[at < 0] = np.frombuffer(b"".join(own["found"]), np.float64)
            by_code = np.empty(len(keys))
            by_code[order] = value
            of[kind] = by_code[codes]
        c, log = of[WORDS], of[GRAMS]
        starts = np.cumsum(held.n_tokens) - held.n_tokens
        return pd.DataFrame({
            "key": part["key"],
            "n_tokens": held.n_tokens,
            "n_known": np.add.reduceat((c > 0).astype(np.int64), starts),
            "base": np.add.reduceat(np.log10((c + 0.1) / (n_train + 0.1 * (vocabulary + 1))), starts),
            "score": np.add.reduceat(log, held.firsts),
            "n_bytes": np.diff(np.append(held.firsts, len(log))),
        })

    asked = docs.groupBy("seg").applyInArrow(ask, wanted)
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "kind int, bucket int, seg int, found binary")
    scored = docs.groupBy("seg").cogroup(answers.groupBy("seg")).applyInPandas(score, "key string, n_tokens long, n_known long, base double, score double, n_bytes long")
    return scored.select("key", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("code_bits"))
