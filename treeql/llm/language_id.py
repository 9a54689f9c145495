"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability under a
language is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words. Piece probabilities come from expectation maximisation (forward-backward expected
counts) over a bounded sample of labelled texts; counts are summed in Spark and only vocabulary x languages
numbers reach the driver.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeql.llm._arrow import release
from treeql.llm._common import materialise, runs

#: Words stand behind this mark, as in the vocabulary; those of more characters go through the lattice with somewhat longer ones.
MARK, LONGEST = "▁", 32
#: Stands behind the end of a word beside longer ones; no code point. Steps of the forward sum after which it is scaled.
PAD, STEPS = 0x1FFFFF, 8
#: Words remembered by a worker, words that pass the lattice together, and characters tokenised together.
CACHED, LOCKSTEP, BLOCK = 300_000, 10_000, 1 << 20
#: Probability of a character outside the vocabulary, the same in every language so that it speaks for none; added to every count.
UNSEEN, SMOOTHING = 1e-11, 0.02


def public_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


class Lattice:
    """All segmentations of many words at once; unknown characters are the piece numbered len(pieces)."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.deepest = max(map(len, pieces), default=1)
        numbers, tokens = {}, [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = numbers.setdefault(node << 21 | ord(c), len(numbers) + 1)
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = k
        keys = np.array(sorted(numbers), np.int64)
        self.keys = np.append(keys, np.int64(1) << 62)
        self.nodes = np.array([numbers[k] for k in keys.tolist()] + [0], np.int64)
        self.token = np.array(tokens, np.int64)

    def arcs(self, words: np.ndarray, back: bool = False) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
        """words: [n, length] code points, padded. Each start, from the last if `back`, with its (width, rows, pieces); PAD is the piece unknown + 1."""
        n, length = words.shape
        # Many starts of few words are looked up together.
        block = max(1, LOCKSTEP // n)
        firsts = range(0, length, block)
        for first in reversed(firsts) if back else firsts:
            m = min(block, length - first)
            start, rows = np.repeat(np.arange(first, first + m), n), np.tile(np.arange(n), m)
            node, here, single = np.zeros(n * m, np.int64), [[] for _ in range(m)], np.zeros((m, n), bool)
            for d in range(1, min(self.deepest, length - first) + 1):
                inside = start + d <= length
                start, rows, node = start[inside], rows[inside], node[inside]
                key = node << 21 | words[rows, start + d - 1]
                at = np.searchsorted(self.keys, key)
                alive = self.keys[at] == key
                start, rows, node = start[alive], rows[alive], self.nodes[at[alive]]
                token = self.token[node]
                ends = token >= 0
                if ends.any():
                    own, own_rows, own_token = start[ends] - first, rows[ends], token[ends]
                    cuts = np.searchsorted(own, np.arange(m + 1)).tolist()
                    for i in np.unique(own).tolist():
                        here[i].append((d, own_rows[cuts[i] : cuts[i + 1]], own_token[cuts[i] : cuts[i + 1]]))
                    if d == 1:
                        single[own, own_rows] = True
                if not len(rows):
                    break
            for i in np.flatnonzero(~single.all(axis=1)).tolist():
                lone = np.flatnonzero(~single[i])
                here[i].append((1, lone, np.where(words[lone, first + i] == PAD, self.unknown + 1, self.unknown)))
            for i in reversed(range(m)) if back else range(m):
                yield first + i, here[i]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index arrays of words of one length, or of similar ones beyond LONGEST, with their code points behind MARK, padded; LOCKSTEP words at most."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    ordered, a = lengths[order], 0
    while a < len(order):
        n = int(ordered[a])
        widest = n if n <= LONGEST else n * 5 // 4
        most = max(1, LOCKSTEP * min(LONGEST, widest + 1) // (widest + 1))
        at = order[a : min(a + most, int(np.searchsorted(ordered, widest, "right")))]
        a += len(at)
        width = int(lengths[at[-1]]) + 1
        points = np.full((len(at), width), PAD, np.int64)
        flat = "".join(MARK + words[i] for i in at)
        points[np.arange(width) <= lengths[at][:, None]] = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        yield at, points


def _with_pad(p: np.ndarray, points: np.ndarray) -> np.ndarray:
    """p with probability 1 for PAD, if it occurs."""
    return np.concatenate([p, np.ones((1, *p.shape[1:]))]) if (points[:, -1] == PAD).any() else p


def log_probabilities(lattice: Lattice, p: np.ndarray, words: list[str]) -> np.ndarray:
    """[word, language]: log of the summed probability of all segmentations; p: [piece, language]."""
    out = np.zeros((len(words), p.shape[1]))
    for at, points in _by_length(words):
        q, length = _with_pad(p, points), points.shape[1]
        # Sums are held for the positions that a piece can still reach, divided by exp(logs) together.
        held = min(lattice.deepest, length) + 1
        alpha, logs = np.zeros((held, len(at), p.shape[1])), np.zeros((len(at), p.shape[1]))
        alpha[0] = 1
        for i, here in lattice.arcs(points):
            if i and i % STEPS == 0:
                logs += _rescale(alpha)
            own = alpha[i % held]
            for d, rows, token in here:
                alpha[(i + d) % held, rows] += own[rows] * q[token]
            own[:] = 0
        out[at] = logs + np.log(alpha[length % held])
    return out


def _rescale(sums: np.ndarray) -> np.ndarray:
    """Divide by the greatest along the first axis; its logs."""
    top = sums.max(axis=0)
    top[top == 0] = 1
    sums /= top
    return np.log(top)


def expected_counts(lattice: Lattice, p: np.ndarray, words: list[str], n: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur n times; p: by piece, of one language."""
    out = np.zeros(len(p) + 1)
    for at, points in _by_length(words):
        q, length = np.append(p, 1.0), points.shape[1]
        held = min(lattice.deepest, length) + 1
        # alpha[i] exp(scale[i]) is the forward sum; met is the probability of a piece's end at a position, which needs no scaling.
        alpha, scale, logs = np.zeros((length + 1, len(at))), np.zeros((length + 1, len(at))), np.zeros(len(at))
        alpha[0] = 1
        for i, here in lattice.arcs(points):
            if i and i % STEPS == 0:
                logs = logs + _rescale(alpha[i : i + held])
            scale[i] = logs
            for d, rows, token in here:
                alpha[i + d, rows] += alpha[i, rows] * q[token]
        scale[length] = logs
        with np.errstate(divide="ignore"):
            above = np.log(alpha) + scale
        under, met = np.where(alpha > 0, above, np.inf), np.zeros((length + 1, len(at)))
        met[length] = 1
        for i, here in lattice.arcs(points, back=True):
            for d, rows, token in here:
                got = met[i + d, rows] * q[token] * np.exp(above[i, rows] - under[i + d, rows])
                met[i, rows] += got
                got *= n[at[rows]]
                if len(rows) < 1000:
                    np.add.at(out, token, got)
                else:
                    out += np.bincount(token, got, len(out))
    return out[:-1]


def words_of(text: str) -> list[str]:
    """White-space words."""
    return text.split()


@dataclass(frozen=True)
class Model:
    pieces: list[str]
    languages: list[str]
    p: np.ndarray
    log_prior: np.ndarray

    @property
    def key(self) -> str:
        return hashlib.sha256(self.p.tobytes() + self.log_prior.tobytes() + repr(self.languages).encode() + str(len(self.pieces)).encode()).hexdigest()


class Scorer(dict):
    """Word -> row of its log probabilities; starts anew beyond CACHED words, or LONGEST times as many characters."""

    def __init__(self, model: Model):
        import regex

        self.model, self.lattice = model, Lattice(model.pieces)
        self.letter = regex.compile(r"\p{L}")
        self.logs, self.held = np.zeros((0, len(model.languages)), np.float64), 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        self.held += len(word)
        return n

    def _block(self, texts: list[str]) -> np.ndarray:
        if len(self) > CACHED or self.held > CACHED * LONGEST:
            self.clear()
            self.logs, self.held = self.logs[:0], 0
        self.new: list[str] = []
        split = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in split])
        at = np.fromiter((self[w] for words in split for w in words), np.int64, int(lengths.sum()))
        if self.new:
            self.logs = np.concatenate([self.logs, log_probabilities(self.lattice, self.model.p, self.new)])
        # Each text is summed by itself; those without words stay at 0.
        out = np.zeros((len(texts), self.logs.shape[1]))
        if len(at):
            some = lengths > 0
            out[some] = np.add.reduceat(self.logs[at], (np.cumsum(lengths) - lengths)[some], axis=0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        languages, best, score = self.model.languages, ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and languages and self.letter.search(t)]
        for a, b in runs([len(texts[i]) for i in known], BLOCK):
            own = known[a:b]
            logs = self._block([texts[i] for i in own]) + self.model.log_prior
            top = logs.argmax(axis=1)
            score[own] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k in zip(own, top.tolist(), strict=True):
                best[i] = languages[k]
        return best, score


_SCORERS: dict[str, Scorer] = {}


def scorer(model: Model) -> Scorer:
    """One scorer in each Python worker."""
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model)
    return _SCORERS[model.key]


def fit(df: DataFrame, pieces: list[str], train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = 400, rounds: int = 3) -> Model:
    """Learn from rows where `train` holds and text and lang are not null.

    docs_per_language bounds the sample: where a language has more such rows, a row is used if the hash of its
    key falls below bound / rows, so about that many are. Priors come from all of them. Languages are in order
    of their code points, which also settles ties of a prediction. Without a labelled row the model is empty.
    """
    spark = df.sparkSession
    rows = df.select(F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"), F.xxhash64(F.col(key).cast("string")).alias("__hash"), train.alias("__train"))
    rows = rows.filter(F.col("__train") & F.col("__text").isNotNull() & F.col("__lang").isNotNull())
    seen = sorted((r["__lang"], r["n"]) for r in rows.groupBy("__lang").agg(F.count("*").alias("n")).collect())
    languages, counts = [x for x, _ in seen], [n for _, n in seen]
    if (len(pieces) + 1) * len(languages) > 1 << 24:
        raise ValueError("too many languages for the vocabulary: the model would pass 128 MB")
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces) + 1, 0)), np.zeros(0))
    number = {x: i for i, x in enumerate(languages)}
    share = F.lit(0)
    for x, n in seen:
        share = F.when(F.col("__lang") == x, int(min(1.0, docs_per_language / n) * (1 << 20))).otherwise(share)
    sample = rows.filter(F.pmod(F.col("__hash"), F.lit(1 << 20)) < share).select("__lang", "__text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, own in batch.groupby("__lang"):
                for a, b in runs([len(t) for t in own["__text"]], BLOCK):
                    n = Counter(w for t in own["__text"].iloc[a:b] for w in words_of(t))
                    yield pd.DataFrame({"k": np.full(len(n), number[x], np.int32), "word": list(n), "n": list(n.values())})

    types = materialise(sample.mapInPandas(count, "k int, word string, n long").groupBy("k", "word").agg(F.sum("n").alias("n")), "words")
    p = np.full((len(pieces) + 1, len(languages)), 1 / max(1, len(pieces)))
    p[-1] = UNSEEN
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, p))

        def expect(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own_pieces, own_p = sent.value
            lattice = Lattice(own_pieces)
            total = np.zeros_like(own_p)
            for batch in batches:
                for k, own in batch.groupby("k"):
                    total[:, k] += expected_counts(lattice, own_p[:, k], own["word"].tolist(), own["n"].to_numpy(np.float64))
            piece, k = np.nonzero(total)
            yield pd.DataFrame({"k": k.astype(np.int32), "piece": piece.astype(np.int32), "n": total[piece, k]})

        got = types.mapInPandas(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(p.shape, SMOOTHING)
        total[got["piece"], got["k"]] += got["n"].to_numpy().round(6)
        p = total / total[:-1].sum(axis=0)
        p[-1] = UNSEEN
    return Model(pieces, languages, p, np.log(np.array(counts) / sum(counts)))


def identify(df: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language and its posterior probability.

    Null texts and texts without a letter get `und` and 0.0, as does every text under an empty model. One row
    out for each row in, repeated or not; all columns pass through, except that earlier columns of the two
    result names are replaced. No shuffle; the model is broadcast, at most 128 MB by fit().
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in (lang_out, score_out)])
    others = [c for c in kept.columns if c != text]
    names = [f"c{i}" for i in range(len(others))]
    plain = kept.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)])
    schema = plain.withColumns({"__lang": F.lit(""), "__score": F.lit(0.0)}).schema

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = scorer(sent.value)
        for batch in batches:
            best, score = own.predict([t if isinstance(t, str) else None for t in batch["__text"]])
            yield batch.assign(__lang=best, __score=score)
        batch = best = score = None
        release()

    made = plain.mapInPandas(each, schema)
    back = dict(zip(others, names, strict=True)) | {text: "__text"}
    return made.select(*[F.col(back[c]).alias(c) for c in kept.columns], F.col("__lang").alias(lang_out), F.col("__score").alias(score_out))

