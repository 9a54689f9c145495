"""Each operator against a brute-force version on small tables with the odd cases in them."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeql.llm._common import crc_of_id
from treeql.llm.queries import public_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, seg string, size string"
WORDS = ["the", "of", "and", "run", "Über", "naïve", "42", "end.", "state", "of-the", "x", "grün", "don't", "we'll"]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", str(rng.randrange(60))]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, shared passages, repeated rows, a null id."""
    rng = random.Random(5)
    passage, out = text_of(rng, 60), []
    for i in range(60):
        out.append((i, text_of(rng, rng.randrange(1, 120))))
    base = text_of(rng, 100).split()
    for i in range(60, 80):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        out.append((i, " ".join(words)))
    out += [(80 + i, f"{text_of(rng, 30)} {passage}\n{text_of(rng, 20)}") for i in range(4)]
    out += [(90, None), (91, ""), (92, " \t\n"), (93, "!!! ..."), (94, "one two three"), (95, "one two three"), (96, text_of(rng, 6000)), (97, "x" * 5000), (5, out[5][1]), (5, out[5][1]), (None, "a text without an id " * 12)]
    out += [(100 + i, "same same text of ten words, all copies of it alike") for i in range(30)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][(i or 0) % 3], ["b", "a", "c", None][(i or 0) % 4], None, "k", 1, "s", "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, none, texts):
    from tokenizers import Tokenizer

    from treeql.llm.token_count import count_tokens

    file = public_file("byte_bpe_50k.json")
    got = count_tokens(docs, file, keep=["doc_id", "size"]).collect()
    lib = Tokenizer.from_file(file)
    want = sorted((i or -1, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got) and any(r["over_limit"] for r in got)
    assert count_tokens(none, file).count() == 0
    with pytest.raises(ValueError):
        count_tokens(docs.withColumn("n_tokens", F.lit(1)), file)
    odd = count_tokens(docs.select("doc_id", "text", F.lit(1).alias("__text"), F.lit(2).alias("body"), F.lit(3).alias("c0")), file)
    assert odd.columns[:4] == ["doc_id", "__text", "body", "c0"] and {tuple(r[1:4]) for r in odd.collect()} == {(1, 2, 3)}


def test_token_edges():
    from tokenizers import Tokenizer

    from treeql.llm.token_count import Counter, _split_step, boundaries, chunk_maps, scan_maps

    file = public_file("byte_bpe_50k.json")
    with open(file, "rb") as f:
        counter = Counter(f.read())
    lib = Tokenizer.from_file(file)
    rng = random.Random(1)
    odd = ["", " ", "  a", "it's 'll 'l 've'v're re're", "\n\n x \n y\t\tz  ", "a<|endoftext|>b<|endoftext|>", "日本語テキスト ñ 123²½", "''s !'s  's \n's", "a\u0085b \x1c\x1d z", " " * 300 + "q", "-" * 500, "👨‍👩‍👧"]
    odd += ["".join(rng.choice("a'sltver 1\n\t.é<|") for _ in range(rng.randrange(700))) for _ in range(300)]
    assert counter.texts(odd).tolist() == [len(x.ids) for x in lib.encode_batch(odd, add_special_tokens=False)]
    # The table starts anew inside a long pre-token as well.
    long = ["".join(rng.choice("abcdefghijé") for _ in range(40_000)), "x" * 30_000]
    counter.machine.most = 50
    from treeql.llm import token_count as T

    kept, T.SLICE = T.SLICE, 64
    try:
        assert counter.texts(long).tolist() == [len(x.ids) for x in lib.encode_batch(long, add_special_tokens=False)]
    finally:
        T.SLICE = kept
    assert len(counter.machine.table) < 50 + 64 + 1
    # Composing chunks' maps is running the machine.
    classes = np.array([rng.randrange(12) for _ in range(64)], np.uint8)
    maps = scan_maps(chunk_maps(classes.reshape(8, 8)))
    state = 0
    for i, c in enumerate(classes):
        state = _split_step(state, int(c))[0]
        if i % 8 == 7:
            assert maps[i // 8, 0] == state
    assert boundaries(np.empty(0, np.uint8)).tolist() == []


def test_language_model():
    from treeql.llm.language_id import Lattice, expected_counts, log_probabilities

    pieces = ["▁", "▁a", "a", "b", "ab", "aba", "▁ab"]
    p = np.random.default_rng(0).random((len(pieces) + 1, 2))

    def brute(word, k):
        w, total = "▁" + word, 0.0
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, at = [], 0
            for j, c in enumerate((*cuts, 1)):
                if c:
                    parts.append(w[at : j + 1])
                    at = j + 1
            total += math.prod(p[pieces.index(x), k] if x in pieces else p[-1, k] if len(x) == 1 and x not in pieces else 0 for x in parts)
        return total

    words = ["a", "ab", "abab", "abaq", ""]
    got = log_probabilities(Lattice(pieces), p, words)
    assert np.allclose(np.exp(got), [[brute(w, 0), brute(w, 1)] for w in words])
    counts = expected_counts(Lattice(["▁", "a"]), np.array([0.5, 0.5, 0.1]), ["aa"], np.array([3.0]))
    assert np.allclose(counts, [3, 6, 0])


def test_language_model_of_long_words():
    from treeql.llm.language_id import Lattice, Model, Scorer, expected_counts, log_probabilities

    pieces = ["▁", "▁a", "a", "b", "ab", "aba", "▁ab"]
    p = np.array([[0.2, 0.1, 0.3, 0.2, 0.1, 0.05, 0.05, 1e-12], [0.1, 0.3, 0.2, 0.1, 0.2, 0.02, 0.08, 1e-11]]).T
    rng = random.Random(6)

    def brute(word, k):
        w = "▁" + word
        sums = [(1, 0)] + [(0, 0)] * len(w)  # mantissa and exponent of 2, exact enough at any length
        for i in range(len(w)):
            for j in range(i + 1, min(i + 3, len(w)) + 1):
                x = w[i:j]
                q = p[pieces.index(x), k] if x in pieces else p[-1, k] if j == i + 1 else 0
                if q:
                    m, e = math.frexp(sums[i][0] * q)
                    e += sums[i][1]
                    top = max(e, sums[j][1]) if sums[j][0] else e
                    sums[j] = math.ldexp(m, e - top) + math.ldexp(sums[j][0], sums[j][1] - top), top
        return math.log(sums[-1][0]) + sums[-1][1] * math.log(2)

    words = ["".join(rng.choice(kind) for _ in range(n)) for n in (1, 9, 31, 32, 33, 34, 40, 41, 300, 330, 20_000) for kind in ("ab", "abq", "qr")]
    lattice = Lattice(pieces)
    want = np.array([[brute(w, 0), brute(w, 1)] for w in words])
    assert np.allclose(log_probabilities(lattice, p, words), want, rtol=1e-10, atol=1e-9)
    # An expected count is the derivative of the log probability by the piece's own.
    few, times = [w for w in words if len(w) < 999], np.arange(1.0, 31)
    for piece in (0, 2, 4, 7):
        up, down = p.copy(), p.copy()
        up[piece] *= 1 + 1e-5
        down[piece] *= 1 - 1e-5
        slope = (log_probabilities(lattice, up, few) - log_probabilities(lattice, down, few))[:, 0] / 2e-5
        assert np.isclose(expected_counts(lattice, p[:, 0], few, times)[piece], slope @ times, rtol=1e-6)
    assert np.isfinite(expected_counts(lattice, p[:, 0], words, np.ones(len(words)))).all()
    # Unknown characters in a row leave later texts of the block alone.
    scorer = Scorer(Model(pieces, ["xx", "yy"], p, np.log([0.5, 0.5])))
    clean = ["ab aba", "b b b", "a"]
    best, score = scorer.predict(["ａ" * 40, *clean, "Ꭰ" * 5000, *clean])
    alone = [scorer.predict([t]) for t in clean]
    assert np.isfinite(score).all() and best[1:4] == best[5:] == [b[0] for b, _ in alone] and np.allclose(score[1:4], [s[0] for _, s in alone]) and np.allclose(score[1:4], score[5:])
    assert best[0] == best[4] == "yy" and score[0] > 0.99


def test_language_fit_by_brute_force(spark):
    from treeql.llm import language_id as I

    pieces = ["▁", "▁a", "a", "b", "ab", "aba", "▁ab"]
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(k) for _ in range(rng.randrange(1, 6))) for _ in range(6)), lang) for i in range(30) for lang, k in [rng.choice([("xx", "aab"), ("yy", "abbq")])]]
    rows += [(30, None, "xx"), (31, "ab", None), (32, "", "yy")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    used = [r for r in rows if r[0] % 3 != 1 and r[1] is not None and r[2]]

    def ways(word):
        w = "▁" + word
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, at = [], 0
            for j, c in enumerate((*cuts, 1)):
                if c:
                    parts.append(w[at : j + 1])
                    at = j + 1
            numbers = [pieces.index(x) if x in pieces else len(pieces) if len(x) == 1 else -1 for x in parts]
            if -1 not in numbers:
                yield numbers

    langs = ["xx", "yy"]
    p = np.full((8, 2), 1 / 7)
    p[-1] = I.UNSEEN
    for _ in range(3):
        total = np.full((8, 2), I.SMOOTHING)
        for _, text, lang in used:
            for word in text.split():
                k = langs.index(lang)
                weights = [(math.prod(p[x, k] for x in way), way) for way in ways(word)]
                for weight, way in weights:
                    for x in way:
                        total[x, k] += weight / sum(w for w, _ in weights)
        p = total / total[:-1].sum(axis=0)
        p[-1] = I.UNSEEN
    model = I.fit(train, pieces, F.col("doc_id") % 3 != 1)
    assert model.languages == langs and np.allclose(model.p, p, rtol=1e-4)
    prior = np.log([sum(r[2] == x for r in used) / len(used) for x in langs])
    assert np.allclose(model.log_prior, prior)
    tests = ["ab aba", "q b", "ｑ" * 70, "aab ｑｑ", "a" * 9, None, "12"]
    got = {r["text"]: r for r in I.identify(spark.createDataFrame([(t,) for t in tests], "text string"), model).collect()}
    for t in tests[:5]:
        logs = np.array([prior[k] + sum(math.log(sum(math.prod(model.p[x, k] for x in way) for way in ways(w))) for w in t.split() if "ｑ" * 70 != w) for k in (0, 1)])
        if t == "ｑ" * 70:
            logs = prior + [math.log(model.p[0, k]) + 70 * math.log(I.UNSEEN) for k in (0, 1)]
        post = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert got[t]["lang_pred"] == langs[int(post.argmax())] and abs(got[t]["score"] - post.max()) < 1e-9
    assert got[None]["lang_pred"] == got["12"]["lang_pred"] == "und"


def test_language_id(spark, docs, none):
    from treeql.llm.language_id import fit, identify, public_pieces

    rng = random.Random(3)
    kinds = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["uno", "dos", "tres", "cuatro"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) + rng.choice(["", "s", "n"]) for _ in range(20)), k) for i in range(200) for k in [rng.choice(["xx", "yy"])]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = public_pieces(public_file("piece_bpe_32k.model"))
    model = fit(train, pieces, F.col("doc_id") % 3 != 1, docs_per_language=30)
    got = identify(train, model).filter("doc_id % 3 = 1").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in identify(docs, model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (90, 91, 92, 93)) and odd[96]["lang_pred"] in ("xx", "yy") and odd[0]["key"] == "k"
    empty = fit(none, pieces, F.lit(True))
    assert empty.languages == [] and {r["lang_pred"] for r in identify(docs, empty).collect()} == {"und"} and identify(none, model).count() == 0


def low_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def test_decontamination(spark, docs, none, texts):
    from treeql.llm import decontamination as D

    long = low_words(texts[80][1])
    items = [(1, " ".join(long[35:60])), (2, "ONE two Three"), (3, None), (4, ""), (5, "not there at all"), (6, texts[7][1]), (7, "same same")]
    benchmark = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    found = D.digest(D.decontaminate(docs, benchmark)).collect()
    windows = {}
    for i, t in items:
        w = low_words(t)
        windows[str(i)] = {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    want = []
    for i, t in texts:
        w = low_words(t)
        hit, names = [False] * len(w), set()
        for name, ws in windows.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        names.add(name)
                        hit[k : k + len(x)] = [True] * len(x)
        want.append((-1 if i is None else i, len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in found]
    assert sorted(got) == sorted(want)
    assert sum(r["contaminated"] for r in found) > 10
    assert D.decontaminate(none, benchmark).count() == 0
    empty = spark.createDataFrame([], benchmark.schema)
    assert not any(r["contaminated"] for r in D.digest(D.decontaminate(docs, empty)).collect())
    # In small segments the result is the same.
    kept, D.SEGMENT = D.SEGMENT, 700
    try:
        again = D.digest(D.decontaminate(docs.repartition(1), benchmark)).collect()
    finally:
        D.SEGMENT = kept
    assert sorted(again, key=str) == sorted(found, key=str)


def test_proximity(spark):
    from treeql.llm import decontamination as D

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(9)))) for i in range(80)] + [(80, "b a"), (81, "x b a y"), (82, None)]
    items = [(1, "a b"), (2, "c c d"), (3, "g z"), (4, "e"), (5, "f a x")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    total = collections.Counter(w for _, t in rows for w in (t or "").split())
    for slop in (0, 1, 2):
        want = []
        for i, t in rows:
            words, hit, names = (t or "").split(), set(), []
            for name, phrase in items:
                parts = phrase.split()
                anchor = parts.index(min(parts, key=lambda w: (total[w], w)))
                for at, w in enumerate(words):
                    places = [min((abs(q - (at + k - anchor)), q) for q, v in enumerate(words) if v == p) if p in words else (99, 0) for k, p in enumerate(parts)]
                    places[anchor] = (0, at)
                    if w == parts[anchor] and all(d <= slop for d, _ in places):
                        names.append(str(name))
                        hit |= set(range(min(q for _, q in places), max(q for _, q in places) + 1))
            want.append((str(i), len(words), sorted(hit), sorted(set(names))))
        got = [(r["doc_id"], r["n_words"], [x for s in r["spans"] for x in range(s["start"], s["end"])], r["items"]) for r in D.decontaminate(docs, benchmark, slop=slop).collect()]
        assert sorted(got) == sorted(want)
    assert {r[0]: r[3] for r in want}["80"] == ["1"]


def test_kd_sharding(spark, docs, none, texts):
    from treeql.llm.kd_sharding import shard_documents

    got = shard_documents(docs, keep=["doc_id", "key"]).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((size(t), zlib.crc32((t or "").encode())) for _, t in texts)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(8)) and all(sorted(x["slot"] for x in rows) == list(range(len(rows))) for rows in by.values())
    homes = collections.defaultdict(set)
    for r in got:
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in homes.values())
    assert shard_documents(none).count() == 0
    # Even sizes where texts allow it; a group of copies as heavy as a third of all is dealt out.
    rng = random.Random(9)
    rows = [(i, "copy of a text " * 4 if i % 3 == 0 else text_of(rng, rng.randrange(5, 15))) for i in range(3000)]
    many = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(many) == 8 and max(r["n"] for r in many) < 1.05 * min(r["n"] for r in many)


def kd_by_hand(rows, shards):
    """(values, tie, weight) of each row -> its shard, by definition: split at the weighted median of the widest dimension."""
    total = sum(w for _, _, w in rows)
    dims, slack, out = range(len(rows[0][0])), total // shards // 100, [0] * len(rows)
    wide = lambda at, i: max(rows[k][0][i] for k in at) - min(rows[k][0][i] for k in at)
    spread = [max(1, wide(range(len(rows)), i)) for i in dims]

    def median(pairs, want, left):
        for v in sorted({v for v, _ in pairs}):
            own = sum(w for x, w in pairs if x == v)
            if left + own >= want:
                return v, left, own
            left += own

    def split(at, n, first):
        if n == 1 or not at:
            for k in at:
                out[k] = first
            return
        i = max(dims, key=lambda i: (wide(at, i) / spread[i], -i))
        want = sum(rows[k][2] for k in at) * (n // 2) // n
        v, left, own = median([(rows[k][0][i], rows[k][2]) for k in at], want, 0)
        tie = (1 << 32) if left + own - want <= want - left else -1
        if min(want - left, left + own - want) > slack:
            tie = median([(rows[k][1], rows[k][2]) for k in at if rows[k][0][i] == v], want, left)[0]
        below = [k for k in at if rows[k][0][i] < v or rows[k][0][i] == v and rows[k][1] <= tie]
        split(below, n // 2, first)
        split([k for k in at if k not in set(below)], n - n // 2, first + n // 2)

    split(list(range(len(rows))), shards, 0)
    return out


@pytest.mark.parametrize("buckets", [1 << 16, 40])
def test_kd_tree_by_definition(spark, monkeypatch, buckets):
    from treeql.llm import kd_sharding as K

    monkeypatch.setattr(K, "BUCKETS", buckets)
    rng = random.Random(11)
    data = [(i, rng.choice([7, 7, rng.randrange(10**6)]), rng.randrange(50), rng.randrange(1, 3000), rng.randrange(9), rng.randrange(1 << 32)) for i in range(700)]
    data += [(1000 + i, 7, 3, 500, 5, rng.randrange(1 << 32)) for i in range(300)] + [(2000, None, 2, None, 1, 1)]
    df = spark.createDataFrame(data, "id long, x long, y long, w long, g long, t long")
    for shards in (1, 3, 8):
        got = {r["id"]: r["shard"] for r in K.kd_shards(df, {"x": F.col("x"), "y": F.col("y")}, F.col("w"), F.col("g"), F.col("t"), shards=shards).collect()}
        want = kd_by_hand([(((x or 0) << 32 | g, y << 32 | g), t, w or 1) for _, x, y, w, g, t in data], shards)
        assert [got[r[0]] for r in data] == want
    # Of 300 equal rows that weigh a third of all, one group is split.
    homes = collections.defaultdict(set)
    for r, shard in zip(data, want, strict=True):
        homes[r[1:3], r[4]].add(shard)
    assert 1 <= sum(len(x) > 1 for x in homes.values()) <= 7


def shingle_sets(texts, width=5):
    out = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def test_jaccard_join(docs, none, texts):
    from treeql.llm import ngram_join as J

    sets = shingle_sets(texts)
    links, parent = collections.Counter(), list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    classes = collections.defaultdict(list)
    for i in range(len(sets)):
        classes[find(i)].append(i)
    wide = lambda found: sorted((-1 if r["key"] is None else r["key"], -1 if r["class_id"] is None else r["class_id"], r["n_links"], r["class_size"]) for r in found)
    want = sorted((-1 if texts[i][0] is None else texts[i][0], min((texts[j][0] for j in own if texts[j][0] is not None), default=-1), links[i], len(own)) for own in classes.values() for i in own)
    assert wide(J.jaccard_join(docs).collect()) == want
    block, J.BLOCK = J.BLOCK, 4
    try:
        assert wide(J.jaccard_join(docs).collect()) == want
    finally:
        J.BLOCK = block
    clash = docs.withColumnsRenamed({"lang": "__key", "source": "__md5", "key": "__MD5_"})
    kept = J.drop_near_duplicates(clash)
    assert kept.columns == clash.columns and kept.count() == len(classes)
    least = docs.sparkSession.createDataFrame([(-(1 << 63), "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l")], "doc_id long, text string")
    assert J.drop_near_duplicates(least).orderBy("text").collect() == [(-(1 << 63), "a b c d e f"), (None, "g h i j k l")]
    assert J.jaccard_join(none).count() == 0 and J.drop_near_duplicates(none).count() == 0


def test_forest_is_shortened_per_text(spark):
    from treeql.llm import ngram_join as J

    assert J.shortest(0.8, 20, 6, 0.9999) == 4 and J.shortest(0.95, 20, 6, 0.9999) == 6 and abs(J.missed(0.8, 4, 20) - (1 - 0.8**4) ** 20) < 1e-8
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        words[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(words)))
    for i in range(60, 400, 2):
        # Pairs at and just above the threshold: 5-word windows around a few changed words.
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((i, " ".join(words)))
        for p in rng.sample(range(10, 190, 6), 4):
            words[p] = f"y{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text_rows = df.select(F.col("doc_id").alias("key"), "text", F.md5("text").alias("md5"))
    signed, sizes = J.signatures([t for _, t in rows], 5)
    texts = spark.createDataFrame([(hashlib.md5(t.encode()).hexdigest(), i, 1, x.tolist(), int(n), i) for (i, t), x, n in zip(rows, signed, sizes, strict=True)], "md5 string, key long, copies long, sig array<int>, shingles long, node long")
    got = {r["node"]: r for r in J._matched(text_rows, texts, 5, 0.8)[0].groupBy("node").agg(F.sum("pairs").alias("pairs"), F.sum(F.col("missed")[5]).alias("far"), F.sum(F.col("missed")[3]).alias("near")).collect()}
    sets = shingle_sets(rows)
    links = collections.Counter()
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            links[rows[a][0]] += 1
            links[rows[b][0]] += 1
    assert {k: r["pairs"] for k, r in got.items()} == dict(links) and sum(links[i] for i in range(60, 400)) > 200
    # Members of the large group are settled at the whole signature, pairs near the threshold are not.
    settled = lambda r: r["far"] + J.missed(0.8, 6, 20) <= 1e-4 * (r["pairs"] + r["far"] + 1)
    assert all(settled(got[i]) for i in range(60)) and not any(settled(got[i]) for i in got if i >= 60)


def test_components(spark):
    from treeql.llm._components import roots

    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300, 360)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_neighbours(spark):
    from treeql.llm.ann_forest import neighbours

    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 16)).astype(np.float32)
    v[300:420] = v[300]
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)] + [(1000, None, 0), (1050, [0.0] * 16, 0), (1100, [float("nan")] + [1.0] * 15, 0), (1150, [1.0, 2.0], 0), (None, v[0].tolist(), 0), (50, v[50].tolist(), 9), (1200, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours(df, F.col("vec_id") % 50 == 0, visited=12 * 450).collect()
    exact = v.astype(np.float64)
    norm = np.sqrt((exact**2).sum(axis=1))
    hits = total = 0
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r)
    assert set(by) == set(range(0, 900, 50))
    for q, found in by.items():
        scores = exact @ exact[q] / (norm * norm[q])
        scores[q] = -9
        order = np.lexsort((np.arange(900), -np.round(scores, 12)))[:5].tolist()
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5] and all(abs(r["score"] - scores[r["vec_id"]]) < 1e-12 for r in found)
        hits, total = hits + len({r["vec_id"] for r in found} & set(order)), total + 5
        if q == 350:
            assert [r["vec_id"] for r in found] == order
    assert hits / total >= 0.9
    # Tiny and huge norms are directions like others.
    wide = spark.createDataFrame([(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [2.0, 1.0]), (3, [5e-324, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"], round(r["score"], 12)) for r in neighbours(wide, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1.0), (0, 2, 0.8), (0, 3, round(1 / math.sqrt(5), 12))]
    assert neighbours(df.limit(0), F.lit(True)).count() == 0 and neighbours(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).count() == 2


def test_neighbours_visit_more_where_needed(spark):
    from treeql.llm.ann_forest import neighbours

    v = np.random.default_rng(8).normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    # 1200 rows over 12 trees are 100 of the 6000 a tree: without the measurement 388 of the 500 neighbours are met (forest grown on all rows).
    got = neighbours(df, F.col("vec_id") % 60 == 0, visited=1200).collect()
    unit = v.astype(np.float64) / np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    hits = 0
    for q in range(0, 6000, 60):
        scores = unit @ unit[q]
        scores[q] = -9
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-scores)[:5].tolist()))
    assert hits >= 0.95 * 500 and {r["query_id"] for r in got} == set(range(0, 6000, 60))


def test_nearest_of():
    from treeql.llm.ann_forest import nearest_of

    rng = np.random.default_rng(3)
    w = np.concatenate([rng.normal(size=(50, 4)), np.ones((9, 4))])
    ids = rng.permutation(59)
    v, own = w[[3, 50, 55]], ids[[3, 50, 55]]
    for n in (1, 5, 58, 80):
        row, col, score = nearest_of(v, own, w, ids, n)
        for q in range(3):
            exact = np.array([v[q] @ x / math.sqrt(v[q] @ v[q]) / math.sqrt(x @ x) for x in w])
            order = [i for i in np.lexsort((ids, -np.round(exact, 12))) if ids[i] != own[q]][:n]
            assert col[row == q].tolist() == order and np.allclose(score[row == q], exact[order])


def test_warc(spark, tmp_path):
    from treeql.llm.warc_archive import archive_and_read, export, read_archive, write_archive

    big = "<p>" + "é" * 700
    pages = [(1, "http://a/x%20y%0Dz", big), (9, "http://a/9", big), (4, "u\r\nX: y%", big), (2, None, "small"), (3, "http://s", "small"), (5, "e", None), (6, "e", ""), (7, "h", "t" * 1000), (7, "h", "t" * 1000), (None, "n", "q" * 2000)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, sha256 string")
    got = archive_and_read(df).collect()
    assert len(got) == len(pages)
    assert sorted((r["page_id"] or 0, r["url"] or "", bytes(r["payload"]).decode()) for r in got) == sorted((i or 0, u or "", h or "") for i, u, h in pages)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == sorted([(0, "response", None), (1, "revisit", 9), (2, "response", None), (3, "response", None), (4, "revisit", 9), (5, "response", None), (6, "response", None), (7, "response", None), (7, "revisit", 7), (9, "response", None)], key=lambda x: (x[0], x[1]))
    for r in got:
        assert r["payload_digest"] == hashlib.sha1(bytes(r["payload"])).hexdigest()
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest == (b"" if r["record_type"] == "revisit" else bytes(r["payload"])) + b"\r\n\r\n"
        assert (b"WARC-Target-URI: " + (r["url"] or "about:blank").encode() + b"\r\n" in bytes(r["record"])) == ("\n" not in (r["url"] or ""))
    # Exported files are whole records: read by length, each with an id of its own that revisits refer to.
    files = str(tmp_path / "files")
    export(archive_and_read(df), files)
    found = []
    for name in sorted(n for n in os.listdir(files) if n.startswith("part-")):
        with open(os.path.join(files, name), "rb") as f:
            data = f.read()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            found.append((fields, data[:n]))
            assert data[n : n + 4] == b"\r\n\r\n"
            data = data[n + 4 :]
    ids = {f["WARC-Record-ID"]: f for f, _ in found}
    assert len(found) == len(ids) == len(pages) and all({"WARC-Type", "WARC-Target-URI", "WARC-Date"} <= set(f) for f, _ in found)
    for f, body in found:
        if f["WARC-Type"] == "revisit":
            assert body == b"" and ids[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and ids[f["WARC-Refers-To"]]["WARC-Type"] == "response"
        else:
            assert f["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(body).hexdigest()
    path = str(tmp_path / "w")
    write_archive(df.limit(0), path)
    assert read_archive(spark, path).count() == 0
    bad = str(tmp_path / "bad")
    write_archive(df, bad)
    spark.read.schema("sha256 string, bytes binary, kind string").parquet(bad).withColumn("bytes", F.when(F.col("kind") == "payload", F.lit(b"forged")).otherwise(F.col("bytes"))).write.partitionBy("kind").parquet(bad + "2")
    with pytest.raises(Exception, match="match"):
        read_archive(spark, bad + "2").collect()


def test_warc_disk(spark, tmp_path):
    """Payloads travel once when archived; when read, only those that records share do, and none if only their lengths and digests are asked for."""
    from treeql.llm.queries import op7_warc_archive
    from treeql.llm.warc_archive import archive_and_read, read_archive, write_archive

    def shuffled(act):
        """Bytes of the shuffle files that act leaves, and what it returns."""
        files = lambda: {f.getName(): f.length() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
        before = files()
        got = act()
        return sum(n for name, n in files().items() if name.startswith("shuffle_") and name not in before), got

    rng = random.Random(8)
    body = lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(5000))
    alone, pairs = [(i, f"u{i}", body()) for i in range(120)], [(i, f"u{i}", html) for i, html in enumerate(body() for _ in range(60))]
    pairs += [(1000 + i, u, html) for i, u, html in pairs]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for k, (pages, whole, lean) in enumerate(((alone, 0.1, 0.1), (pairs, 0.7, 0.1))):
            total, sf = sum(len(h.encode()) for _, _, h in pages), str(tmp_path / f"sf{k}")
            spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
            path = f"{sf}/w"
            sent, _ = shuffled(lambda sf=sf, path=path: write_archive(spark.read.parquet(f"{sf}/pages.parquet"), path))
            assert 0.5 * total < sent < 1.2 * total
            # What is compared travels by no shuffle, or by what is allowed.
            sent, got = shuffled(lambda path=path: read_archive(spark, path).select("page_id", "url", "payload", "record").collect())
            assert sent < whole * total and sorted((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in got) == sorted(pages)
            sent, got = shuffled(lambda sf=sf: op7_warc_archive(spark, sf).collect())
            assert sent < (1.2 + lean) * total
            top = {h: i for i, _, h in sorted(pages)}
            want = [(i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response" if top[h] == i else "revisit", None if top[h] == i else top[h]) for i, _, h in pages]
            assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The header beside a payload is held against it too, and an archive with all headers apart is read as well.
    stored = spark.read.schema("sha256 string, bytes binary, header binary, kind string").parquet(f"{tmp_path}/sf0/w")
    assert stored.filter("kind = 'payload' AND header IS NOT NULL").count() == len(alone) == stored.count()
    for name, header in (("forged", F.expr("cast(replace(cast(header AS string), 'sha1:', 'sha1:0') AS binary)")), ("apart", F.lit(None).cast("binary"))):
        stored.withColumn("header", header).write.partitionBy("kind").parquet(f"{tmp_path}/{name}")
    stored.select("sha256", F.col("header").alias("bytes"), F.lit("header").alias("kind")).write.mode("append").partitionBy("kind").parquet(f"{tmp_path}/apart")
    with pytest.raises(Exception, match="match"):
        read_archive(spark, f"{tmp_path}/forged").collect()
    assert sorted(r["page_id"] for r in read_archive(spark, f"{tmp_path}/apart").collect()) == sorted(i for i, _, _ in alone)
    assert archive_and_read(spark.createDataFrame(alone, "page_id long, url string, html string")).select("header").distinct().count() == len(alone)


def test_substring_dedup(docs, none, texts):
    from treeql.llm.substring_dedup import digest, repeated_spans

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    seen = collections.Counter(tuple(w[k : k + 35]) for w in split for k in range(len(w) - 34))
    want = []
    for (i, _), w in zip(texts, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((-1 if i is None else i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in digest(repeated_spans(docs)).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 200
    assert repeated_spans(none).count() == 0


def kt_tree(data, depth):
    """Context-tree weighting by definition, for one string: node (context, bits known) -> counts and logs."""
    counts = collections.defaultdict(lambda: [0, 0])
    for s in data:
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                for j in range(8):
                    counts[s[i - d : i], s[i] >> (8 - j) | 1 << j][s[i] >> (7 - j) & 1] += 1
    return counts


def test_context_tree(spark, docs, none, texts):
    from treeql.llm import ctw_lm as L

    small = [(i, t) for i, t in texts if len(t or "") < 900][:40] + [(None, "without an id"), (90, None), (91, "")]
    held = crc_of_id(F.col("doc_id")) % 10 == 0
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in small], "doc_id long, text string, train string, n long")
    got = {(r["key"], r["n_tokens"]): r for r in L.score_texts(df, ~held).collect()}
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    split = [(i, (t or "").encode().lower().split()) for i, t in small]
    c = collections.Counter(w for i, s in split if learns(i) for w in [*s, b"\n"])
    n, v = sum(c.values()), len(c)
    streams = [L.stream(s) for _, s in split]
    counts = kt_tree([x for (i, _), x in zip(split, streams, strict=True) if learns(i)], L.DEPTH)
    below = collections.defaultdict(set)
    for ctx, node in counts:
        if ctx:
            below[ctx[1:], node].add(ctx)
    logs = {}

    def whole(ctx, node):
        if (ctx, node) not in logs:
            a, b = counts.get((ctx, node), (0, 0))
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(ctx) == L.DEPTH:
                logs[ctx, node] = own, own
            else:
                deeper = sum(whole(x, node)[1] for x in below[ctx, node])
                top = max(own, deeper)
                logs[ctx, node] = own, top + math.log(math.exp(own - top) + math.exp(deeper - top)) - math.log(2)
        return logs[ctx, node]

    def score(s):
        total = 0.0
        for i in range(L.DEPTH, len(s)):
            for j in range(8):
                node, bit, p = s[i] >> (8 - j) | 1 << j, s[i] >> (7 - j) & 1, None
                for d in range(L.DEPTH, -1, -1):
                    ctx = s[i - d : i]
                    k = counts.get((ctx, node), (0, 0))
                    kt = (k[bit] + 0.5) / (sum(k) + 1)
                    w = 0.5 * math.exp(whole(ctx, node)[0] - whole(ctx, node)[1])
                    p = kt if p is None else w * kt + (1 - w) * p
                total += math.log10(p)
        return total

    for (i, s), x in zip(split, streams, strict=True):
        r = got[None if i is None else str(i), len(s) + 1]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*s, b"\n"])
        assert r["train_tokens"] == n and r["n_known"] == sum(c[w] > 0 for w in [*s, b"\n"]) and abs(r["base_score"] - base) < 1e-9 * abs(base) + 1e-12
        assert abs(r["score"] - score(x)) < 1e-7 * abs(score(x)) + 1e-9
    head, L.HEAD = L.HEAD, 5
    try:
        again = {(r["key"], r["n_tokens"]): r["score"] for r in L.score_texts(df, ~held).collect()}
    finally:
        L.HEAD = head
    assert all(abs(again[k] - r["score"]) < 1e-9 * abs(r["score"]) + 1e-9 for k, r in got.items())
    assert L.score_texts(none, F.lit(True)).count() == 0
    untrained = L.score_texts(df, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and abs(r["code_bits"] - 8) < 1e-9 for r in untrained)


def test_log_gamma():
    from treeql.llm.ctw_lm import log_gamma

    x = np.array([0.5, 1, 1.5, 7.5, 1e3, 1e9])
    assert np.allclose(log_gamma(x), [math.lgamma(y) for y in x], rtol=1e-9, atol=1e-9)


def shared_out(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by definition, source -> words."""
    ordered = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(ordered)}
    goal, free = {}, list(ordered)
    while True:
        left = sum(sizes.values()) - sum(goal.values())
        full = [x for x in free if left * weight[x] / sum(weight[y] for y in free) > repeats * sizes[x]]
        if not full:
            return goal | {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        goal |= {x: repeats * sizes[x] for x in full}
        free = [x for x in free if x not in full]


def mix_by_hand(df):
    """(row, size, taken, copies) of df's rows: blocks, slots and what they take, by definition; only the shuffled order comes from Spark's hash."""
    from treeql.llm import mixing as M

    order = F.struct(F.pmod(F.xxhash64("h", "crc"), F.lit(max(1, -(-df.count() // M.SUMMED)))).alias("part"), "h", F.col("doc_id").cast("string").alias("key"))
    hashed = df.withColumns({"h": F.xxhash64(F.col("doc_id").cast("string")), "crc": F.crc32(F.col("text").cast("binary"))}).withColumn("o", order).collect()
    sizes = collections.Counter()
    for r in hashed:
        sizes[r["source"]] += len((r["text"] or "").split())
    goal, slots, blocks, start, at = shared_out(sizes), {}, {}, {}, 0
    for s in sorted(sizes, key=lambda x: (x is None, x or "")):
        blocks[s] = max(-(-sizes[s] // M.BLOCK), min(sizes[s], M.LEAST))
        slots[s] = min(3 * blocks[s], math.floor(blocks[s] * goal[s] / sizes[s] + 0.5)) if sizes[s] else 0
        start[s], at = at, at + slots[s]
    bits = (at - 1).bit_length()
    times = {s: collections.Counter(r % blocks[s] for r, _ in enumerate(sorted(int(f"{p:0{bits}b}"[::-1], 2) for p in range(start[s], start[s] + slots[s])))) for s in sizes}
    out = []
    for s in sizes:
        own = sorted((r for r in hashed if r["source"] == s), key=lambda r: (r["o"]["part"], r["o"]["h"], r["o"]["key"] or ""))
        base, rem = divmod(sizes[s], blocks[s]) if sizes[s] else (0, 0)
        of_word = [b for b in range(blocks[s]) for _ in range(base + (b < rem))]
        place = 0
        for r in own:
            n = len((r["text"] or "").split())
            out.append((r, n, sum(times[s][of_word[w]] for w in range(place, place + n)), times[s][of_word[place + n // 2]] if n else 0))
            place += n
    return out


@pytest.mark.parametrize("small", [False, True])
def test_mixing(spark, docs, none, texts, small, monkeypatch):
    from treeql.llm import mixing as M

    if small:
        for k, v in (("BLOCK", 7), ("LEAST", 3), ("RANKED", 64), ("SUMMED", 50), ("SMALL", 1)):
            monkeypatch.setattr(M, k, v)
    rows = [(i, text_of(random.Random(i), 5 + i % 50), None if i % 41 == 0 else "hot" if i % 3 else f"s{i % 4}") for i in range(1200)]
    rows += [(5000, "tiny text", "rare"), (5001, None, "none"), (7, rows[7][1], rows[7][2]), (None, "a b c", "hot"), (5002, " ".join(f"w{i}" for i in range(9000)), "s0")]
    big = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(big, keep=["doc_id", "source"]).collect()
    assert sorted(map(tuple, M.mix(big.repartition(7), keep=["doc_id", "source"]).collect()), key=str) == sorted(map(tuple, got), key=str)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    goal = shared_out(sizes)
    want = [(-1 if r["doc_id"] is None else r["doc_id"], r["source"], n, sizes[r["source"]], round(goal[r["source"]], 6), taken, copies) for r, n, taken, copies in mix_by_hand(big)]
    assert sorted(want, key=str) == sorted(((-1 if r[0] is None else r[0], *r[1:4], round(r["target"], 6), *r[5:]) for r in got), key=str)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and max(r["taken"] for r in got if r["size"]) > 0
    for s in ("hot", "s0", None):
        assert abs(sum(r["taken"] for r in got if r["source"] == s) / goal[s] - 1) < 0.02
    odd = M.mix(docs)
    assert odd.count() == len(texts) and "key" in odd.columns and {r["taken"] for r in odd.filter("size = 0").collect()} == {0}
    assert M.mix(none).count() == 0


def test_mixing_of_many_words(spark, monkeypatch):
    from treeql.llm import mixing as M

    monkeypatch.setattr(M, "BLOCKS", 1 << 12)
    sizes = {"a": 10**12, "b": 3 * 10**12, "c": 5, None: 10**9}
    sources, n = M.plan_sources(spark.createDataFrame(list(sizes.items()), "src string, size long"))
    goal = shared_out(sizes)
    assert {r["src"]: round(r["target"]) for r in sources.collect()} == {s: round(g) for s, g in goal.items()}
    got = M.schedule(sources, n).collect()
    assert len(got) == n < 1 << 14 and len({r["slot"] for r in got}) == n
    # Every run of the mix is near the targets.
    ordered = [r["k"] for r in sorted(got, key=lambda r: r["slot"])]
    for a in range(0, n - 400, 400):
        assert abs(ordered[a : a + 400].count(0) - ordered.count(0) / n * 400) < 12
    # Thousands of sources.
    many = [(f"s{i:05}", 1 + i % 90) for i in range(3000)]
    sources, n = M.plan_sources(spark.createDataFrame(many, "src string, size long"))
    goal = shared_out(dict(many))
    assert all(abs(r["target"] - goal[r["src"]]) < 1e-6 for r in sources.collect()) and [r["k"] for r in sorted(sources.collect(), key=lambda r: r["src"])] == list(range(3000))


def test_pipeline(spark, docs, none, tmp_path):
    import corpus_pipeline as P

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    sf = str(tmp_path)
    docs.select(columns).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    out = P.run(spark, sf).collect()
    assert out and {"doc_id", "shard", "slot"} <= set(out[0].asDict())
    assert not {90, 91, 92, 93, 94, 95} & {r["doc_id"] for r in out} and len({r["doc_id"] for r in out if r["doc_id"] and 100 <= r["doc_id"] < 130}) <= 1
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, none.select(columns), sf).columns == columns
    assert P.STAGES[-1][1](spark, none.select(columns), sf).count() == 0


def test_pipeline_stages_by_definition(spark, tmp_path, monkeypatch):
    import corpus_pipeline as P
    from treeql.llm.language_id import fit, public_pieces

    rng, sf = random.Random(21), str(tmp_path)
    kinds = {"xx": ["alpha", "beta", "gamma", "delta"], "yy": ["uno", "dos", "tres", "cuatro"], "zz": ["eins", "zwei", "drei", "vier"]}
    words = lambda k, n: [rng.choice(kinds[k]) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(n)]
    rows = []
    for i in range(90):
        k = rng.choice(list(kinds))
        rows.append((i, "\n".join(" ".join(words(k, rng.randrange(3, 12))) for _ in range(rng.randrange(1, 4))), rng.choice([k, k, None])))
    base = words("xx", 60)
    for i in range(90, 100):
        near = list(base)
        for _ in range(i % 3):
            near[rng.randrange(60)] = f"new{rng.choice('abc')}"
        rows.append((i, " ".join(near), None))
    rows += [(100 + i, rows[i][1], "yy") for i in range(6)] + [(110, "123 456", None), (111, None, "yy"), (112, "", None), (113, "ｑ", None), (114, "ｑｗ ｑ", None), (None, " ".join(words("zz", 9)), "zz")]
    bench = [(1, " ".join(rows[3][1].split()[:12])), (2, "Tiny item"), (3, None), (4, " ".join(words("yy", 15)))]
    rows += [(120, f"beta tiny item, {' '.join(words('xx', 8))}", "xx"), (121, f"{' '.join(words('yy', 5))} {bench[3][1]} uno", "yy"), (122, "tiny beta item dos uno", "yy")]
    data = [(i, t, k, ["b", "a", None, "hot", "hot"][(i or 0) % 5], len(t or "")) for i, t, k in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, same = spark.read.parquet(f"{sf}/documents.parquet"), lambda found: sorted(map(str, map(tuple, found)))

    def staged(k):
        found = P.STAGES[k][1](spark, docs, sf)
        found.write.parquet(f"{sf}/stage{k}.parquet")
        return spark.read.parquet(f"{sf}/stage{k}.parquet")

    # Language ID: a posterior of at least a half, all segmentations of every word summed.
    model = fit(docs, public_pieces(public_file("piece_bpe_32k.model")), crc_of_id(F.col("doc_id")) % 3 != 1)
    number, longest = {x: i for i, x in enumerate(model.pieces)}, max(map(len, model.pieces))

    def posterior(text):
        logs = model.log_prior.copy()
        for word in text.split():
            w = "\u2581" + word
            sums = [np.ones(3)] + [np.zeros(3)] * len(w)
            for i in range(len(w)):
                for j in range(i + 1, min(i + longest, len(w)) + 1):
                    k = number.get(w[i:j], -1 if j == i + 1 else None)
                    if k is not None:
                        sums[j] = sums[j] + sums[i] * model.p[k]
            logs += np.log(sums[-1])
        return 1 / np.exp(logs - logs.max()).sum()

    scored = [(r, posterior(r[1])) for r in data if r[1] and any(c.isalpha() for c in r[1])]
    left = [r for r, p in scored if p >= P.LEAST_SCORE]
    with monkeypatch.context() as m:
        # These texts are sure of their language; a higher bar tells them apart.
        m.setattr(P, "LEAST_SCORE", (min(p for _, p in scored) + 1) / 2)
        high = [r for r, p in scored if p >= P.LEAST_SCORE]
        assert same(P.language_id(spark, docs, sf).collect()) == same(high) and 50 < len(high) < len(scored)
    docs = staged(0)
    assert same(docs.collect()) == same(left)
    # Near duplicates: the least of every class that links connect.
    sets, class_of = shingle_sets([r[:2] for r in left]), list(range(len(left)))
    for a, b in itertools.combinations(range(len(left)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            class_of = [class_of[a] if c == class_of[b] else c for c in class_of]
    first = {c: min((i for i in range(len(left)) if class_of[i] == c), key=lambda i: (left[i][0] is None, left[i][0] or 0)) for c in class_of}
    assert len(first) < len(left) - 6
    left = [left[i] for i in first.values()]
    docs = staged(1)
    assert same(docs.collect()) == same(left)
    # Decontamination: no window of an item.
    windows = [w[i : i + 10] for _, t in bench if (w := low_words(t)) for i in range(max(1, len(w) - 9))]
    hit = lambda t: any(w[i : i + len(x)] == x for w in [low_words(t)] for x in windows for i in range(len(w) - len(x) + 1))
    assert {3, 120, 121} <= {r[0] for r in left if hit(r[1])} and not hit(rows[-1][1])
    left = [r for r in left if not hit(r[1])]
    docs = staged(2)
    assert same(docs.collect()) == same(left)
    # Mixing: as often as the block at a document's middle is taken.
    mixed = [tuple(r)[:5] for r, _, _, copies in mix_by_hand(docs) for _ in range(copies)]
    docs = staged(3)
    assert same(docs.collect()) == same(mixed) and len(set(mixed)) < len(mixed)
    # Sharding: the k-d tree.
    tie = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 32))
    inner, own = [], docs.select("*", tie.alias("tie")).collect()
    for r in own:
        raw = r["text"].encode()
        crc = zlib.crc32(raw)
        inner.append(([x << 32 | crc for x in (len(raw) + 1, r["text"].count("\n"), crc >> 1)], r["tie"], len(raw) + 1))
    want = [(r["doc_id"], r["lang"], r["source"], x[2], zlib.crc32(r["text"].encode()), shard) for r, x, shard in zip(own, inner, kd_by_hand(inner, 8), strict=True)]
    for found in (staged(4).collect(), P.run(spark, sf).collect()):
        assert same((r["doc_id"], r["lang"], r["source"], r["size"], r["text_crc32"], r["shard"]) for r in found) == same(want)
        for shard, n in collections.Counter(r["shard"] for r in found).items():
            assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(n))


def test_pipeline_decontaminates_by_row(spark, tmp_path):
    import corpus_pipeline as P

    sf = str(tmp_path)
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    bad, good = "here one two three again", "one two and three"
    rows = [(None, bad), (None, good), (None, None), (7, bad), (7, good), (7, good), (8, None), (9, ""), (10, bad)]
    got = P.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert got.columns == ["doc_id", "text"] and sorted(map(tuple, got.collect()), key=str) == sorted((r for r in rows if r[1] != bad), key=str)


def test_kd_target_bytes(spark):
    from treeql.llm.kd_sharding import kd_shards

    df = spark.range(5000).selectExpr("id", "id % 97 + 1 AS bytes", "id % 13 AS x", "id * 7 % 1001 AS y")
    got = kd_shards(df, {"x": F.col("x"), "y": F.col("y")}, F.col("bytes"), F.crc32(F.col("id").cast("string")), F.col("id"), target_bytes=12_000)
    sums = [r["n"] for r in got.groupBy("shard").agg(F.sum("bytes").alias("n"), F.count("*").alias("c")).collect()]
    total = sum(i % 97 + 1 for i in range(5000))
    assert len(sums) == -(-total // 12_000) and max(sums) < 1.1 * 12_000 and sum(sums) == total


def test_text_runs():
    import pyarrow as pa

    from treeql.llm._arrow import text_runs

    texts = ["aa", None, "", "é" * 5, "x", "yyy", None]
    for column in (pa.array(texts, pa.string()), pa.array(["0", *texts], pa.string()).slice(1)):
        for most in (1, 4, 1000):
            found = list(text_runs(column, most))
            assert [t for _, own in found for t in own] == texts and [a for a, _ in found] == list(itertools.accumulate([len(own) for _, own in found], initial=0))[:-1]
            assert all(len(list(filter(None, own))) == 1 or sum(len((t or "").encode()) for t in own) <= most for _, own in found)
    assert list(text_runs(pa.array([], pa.string()), 5)) == []


def test_language_id_keeps_other_columns(spark):
    from treeql.llm.language_id import Model, identify

    df = spark.sql("""select 'the text' as text, timestamp'2020-01-02 03:04:05.678901' as a, timestamp_ntz'2020-01-02 03:04:05' as b, date'2020-02-03' as c, 1.25BD as d, array(1, null) as e,
        named_struct('x', 'y', 'z', array('q')) as f, map('k', 2.5D) as g, x'00ff' as h, true as i, cast(null as string) as j union all select null, null, null, null, null, null, null, null, null, null, 'j'""")
    model = Model(["\u2581", "the", "t"], ["en"], np.array([[0.5], [0.3], [0.1], [0.1]]), np.zeros(1))
    found = identify(df, model)
    assert found.columns == [*df.columns, "lang_pred", "score"] and found.drop("lang_pred", "score").dtypes == df.dtypes
    assert sorted(map(str, found.drop("lang_pred", "score").collect())) == sorted(map(str, df.collect()))
    assert sorted(r["lang_pred"] for r in found.collect()) == ["en", "und"]
