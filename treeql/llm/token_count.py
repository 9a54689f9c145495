"""Token counts by finite-state tokenizer compilation.

Two deterministic transducers are compiled from a byte-level BPE vocabulary:

* the *split* transducer, over character classes, whose transitions say where a pre-token begins (at
  this character, or, once the look-ahead is resolved, at the one before). A block of texts is cut into
  equal chunks; every chunk's map from entry state to exit state is computed for all states in
  lockstep, the maps compose by a parallel prefix scan, and a last pass from the now known entry states
  emits the boundaries. No character is handled by a Python loop.
* the *merge* transducer, over bytes, whose transitions carry how many tokens they add (zero or
  negative where the byte joins tokens already counted). Its states are determinised on demand: a state
  holds, for each suffix of the bytes read that could still grow into a longer token, the last token
  before that suffix and the tokens counted since. A token may follow another only where merging the
  two together gives just these two, which is all that canonical BPE needs.

Only a pre-token not met before runs through the merge transducer; its count is kept per Python worker
in a table that starts anew beyond CACHED entries.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeql.llm._common import runs

#: Characters of a chunk, characters handled together, and pre-tokens remembered by a worker.
CHUNK, BLOCK, CACHED = 256, 1 << 20, 400_000
#: Bytes of a pre-token between two looks at the size of the table; characters of the longest pre-token remembered.
SLICE, LONGEST = 1 << 14, 256

# Character classes and states of the split transducer.
LETTER, STMD, ELL, VEE, ARR, EEE, NUMBER, SPACE, WHITE, APOS, OTHER, EDGE = range(12)
FRESH, LETTERS, NUMBERS, OTHERS, APOSTROPHE, APOS_L, APOS_V, APOS_R, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE = range(12)

#: The code points of Unicode's White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _class_table() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, whole):
            a, b = ord(whole[m.start()]), ord(whole[m.end() - 1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    table[ord("'")] = APOS
    for chars, kind in (("stmd", STMD), ("l", ELL), ("v", VEE), ("r", ARR), ("e", EEE)):
        table[[ord(c) for c in chars]] = kind
    return table


def _open(c: int) -> int:
    """The state after a pre-token's first character."""
    if c <= EEE:
        return LETTERS
    return {NUMBER: NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, APOS: APOSTROPHE, OTHER: OTHERS, EDGE: FRESH}[c]


def _split_step(s: int, c: int) -> tuple[int, int]:
    """Next state and emission: bit 0, a pre-token begins at this character; bit 1, at the one before."""
    word, contraction = c <= EEE, {APOS_L: ELL, APOS_V: EEE, APOS_R: EEE}
    if s in contraction:
        if c == contraction[s]:
            return FRESH, 0
        after, bits = _split_step(LETTERS, c)
        return after, bits | 2
    if c == EDGE:
        return FRESH, 1
    if s in (ONE_SPACE, RUN_SPACE, ONE_WHITE, RUN_WHITE):
        if c in (SPACE, WHITE):
            return (RUN_SPACE if c == SPACE else RUN_WHITE), 0
        late = 2 if s in (RUN_SPACE, RUN_WHITE) else 0
        if s in (ONE_WHITE, RUN_WHITE):
            return _open(c), 1 | late
        return (OTHERS if c == APOS else _open(c)), late
    joins = {LETTERS: word, NUMBERS: c == NUMBER, OTHERS: c in (OTHER, APOS)}
    if joins.get(s):
        return s, 0
    if s == APOSTROPHE:
        if c in (OTHER, APOS):
            return OTHERS, 0
        if c in (STMD, ELL, VEE, ARR):
            return {STMD: FRESH, ELL: APOS_L, VEE: APOS_V, ARR: APOS_R}[c], 0
    return _open(c), 1


#: Next state and emission by 16 * state + class.
_NEXT, _EMIT = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
for _s in range(12):
    for _c in range(12):
        _NEXT[_s * 16 + _c], _EMIT[_s * 16 + _c] = _split_step(_s, _c)


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """[chunk, state]: where each chunk of classes (a row) leads from every state."""
    at = np.broadcast_to(np.arange(12, dtype=np.uint8), (len(classes), 12)).copy()
    for column in classes.T:
        at = _NEXT[(at << 4) | column[:, None]]
    return at


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of the maps, in log2(n) doubling steps."""
    done, step = maps, 1
    while step < len(done):
        both = done.copy()
        both[step:] = np.take_along_axis(done[step:], done[:-step].astype(np.intp), axis=1)
        done, step = both, step * 2
    return done


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each character; the block starts afresh and ends on an EDGE."""
    n = len(classes)
    width = min(CHUNK, max(1, n))
    padded = np.full(-(-n // width) * width, EDGE, np.uint8)
    padded[:n] = classes
    grid = padded.reshape(-1, width)
    at = np.full(len(grid), FRESH, np.uint8)
    at[1:] = scan_maps(chunk_maps(grid))[:-1, FRESH]
    emitted = np.empty_like(grid)
    for j in range(width):
        code = (at << 4) | grid[:, j]
        emitted[:, j] = _EMIT[code]
        at = _NEXT[code]
    bits = emitted.reshape(-1)[:n]
    begins = (bits & 1).astype(bool)
    begins[:-1] |= bits[1:] > 1
    return begins


class MergeTransducer:
    """Bytes in, token counts out; states and transitions are made when first needed.

    The table of transitions starts anew when it has passed `most` entries, looked at every SLICE bytes, so no text can fill memory. To keep it small,
    an entry of a state is one number, node << 48 | (last token + 1) << 24 | tokens since; so is a transition,
    state << 8 | (tokens added + 128).
    """

    def __init__(self, merges: list[tuple[bytes, bytes]], tokens: list[bytes], most: int = 600_000):
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.tokens, self.most = tokens, most
        self.child: dict[int, int] = {}
        self.token_at, self.grows = [-1], [False]
        for k, token in enumerate(tokens):
            node = 0
            for b in token:
                self.grows[node] = True
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
                node = self.child[key]
            self.token_at[node] = k
        self._clear()

    def _clear(self) -> None:
        self.states, self.number, self.table, self.follows = [(0,)], {(0,): 0}, {}, {}

    def merged(self, data: bytes) -> list[bytes]:
        """BPE as defined: the adjacent pair of least rank merges first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, last: int, token: int) -> bool:
        key = (last + 1) << 24 | token
        found = self.follows.get(key)
        if found is None:
            both = [self.tokens[k] for k in (last, token) if k >= 0]
            found = self.follows[key] = self.merged(b"".join(both)) == both
        return found

    def _make(self, state: int, byte: int) -> int:
        """Compile one transition; entries stand longest suffix first."""
        grown = []
        for entry in self.states[state]:
            node = self.child.get(entry >> 48 << 8 | byte)
            if node is not None:
                grown.append((node, (entry >> 24 & 0xFFFFFF) - 1, (entry & 0xFFFFFF) - (1 << 23) if entry & 0xFFFFFF else 0))
        for node, last, since in grown:
            token = self.token_at[node]
            if token >= 0 and self.may_follow(last, token):
                break
        added = 1 - since
        pack = lambda n, before, c: n << 48 | (before + 1) << 24 | (c + (1 << 23) if c else 0)
        key = (*(pack(n, before, c + added) for n, before, c in grown if self.grows[n]), pack(0, token, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        self.table[state << 8 | byte] = found = to << 8 | (added + 128)
        return found

    def count(self, data: bytes) -> int:
        state = total = 0
        for a in range(0, len(data), SLICE):
            if len(self.table) > self.most:
                # A long pre-token goes on from the state it had come to.
                here = self.states[state]
                self._clear()
                state = self.number.setdefault(here, len(self.states))
                if state == len(self.states):
                    self.states.append(here)
            get = self.table.get
            for byte in data[a : a + SLICE]:
                found = get(state << 8 | byte) or self._make(state, byte)
                state = found >> 8
                total += (found & 255) - 128
        return total


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter(dict):
    """Pre-token -> tokens, filled through the merge transducer."""

    def __init__(self, spec: bytes):
        model = json.loads(spec)
        back = _byte_chars()
        raw = lambda s: bytes(back[c] for c in s)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["model"]["merges"]]
        self.special = [x["content"] for x in model["added_tokens"]]
        self.machine = MergeTransducer([(raw(a), raw(b)) for a, b in pairs], [raw(t) for t in model["model"]["vocab"] if t not in self.special])
        self.classes = _class_table()

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        n = self.machine.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONGEST:
            self[piece] = n
        return n

    def texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. Special strings inside a text are one token, as the library has it by default."""
        import regex

        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        for i, text in enumerate(texts):
            cut = special.split(text) if special and any(s in text for s in self.special) else [text]
            total[i] += len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        owner = np.array(owner, np.int64)
        for a, b in runs([len(p) for p in parts], BLOCK):
            total += np.bincount(owner[a:b], self._block(parts[a:b]), len(texts)).astype(np.int64)
        return total

    def _block(self, parts: list[str]) -> np.ndarray:
        whole = "\n" + "\n".join(parts) + "\n"
        lengths = np.array([len(p) for p in parts], np.int64)
        edges = np.concatenate([[0], np.cumsum(lengths + 1)])
        classes = self.classes[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
        classes[edges] = EDGE
        begins = np.flatnonzero(boundaries(classes))
        ends = np.append(begins[1:], len(whole))
        kept = classes[begins] != EDGE
        begins, ends = begins[kept], ends[kept]
        counts = np.fromiter(map(self.__getitem__, [whole[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]), np.int64, len(begins))
        return np.bincount(np.searchsorted(edges, begins) - 1, counts, len(parts))


_COMPILED: dict[str, Counter] = {}


def compiled(spec: bytes) -> Counter:
    """The counter of a vocabulary, compiled once in each Python worker."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Counter(spec)
    return _COMPILED[key]


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, limit: int = 1024) -> DataFrame:
    """Columns `keep` (all but the text if None), n_bytes, n_tokens and over_limit (more than `limit` tokens).

    tokenizer: a byte-level BPE file of the `tokenizers` library, read by the driver; it has a fixed size
    (it is refused beyond 64 MB) and reaches the executors as a broadcast. One row out for each row in:
    null text counts as empty (0 bytes, 0 tokens), repeated rows and null ids are kept as they are, an
    empty table gives an empty result, and any kept columns pass through whatever their names
    (only n_bytes, n_tokens and over_limit are refused as names). There is no shuffle.
    """
    with open(tokenizer, "rb") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("the vocabulary is too large to broadcast")
    keep = [c for c in df.columns if c != text] if keep is None else keep
    if clash := {"n_bytes", "n_tokens", "over_limit"} & {c.lower() for c in keep}:
        raise ValueError(f"columns to keep clash with results: {sorted(clash)}")
    sent = df.sparkSession.sparkContext.broadcast(spec)

    names = [f"c{i}" for i in range(len(keep))]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = compiled(sent.value)
        for batch in batches:
            texts = batch.pop("body").tolist()
            batch["n_tokens"] = counter.texts(texts)
            yield batch

    kept = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    kept = kept.withColumn("n_bytes", F.octet_length("body").cast("long"))
    schema = kept.drop("body").withColumn("n_tokens", F.lit(0).cast("long")).schema
    made = kept.mapInPandas(each, schema)
    return made.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
