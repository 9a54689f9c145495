"""Approximate nearest neighbours by a forest of random-projection trees.

The trees' splits are learned from a bounded sample; every row is then filed in a leaf of every tree. A query
walks all trees through one priority queue, ordered by the squared margins to the splits crossed on the way, until the leaves
met hold enough rows; the rows of these leaves are ranked by their exact cosine. How many are enough is measured on
the table: some queries are compared with every row, and the walks go as far as finds the wanted share of their neighbours.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeql.llm._common import materialise

#: Rows that the splits are learned from at most (all are filed), trees, wanted rows of a leaf, rows and queries of a block.
SAMPLE, TREES, LEAF, MEMBERS, QUERIES = 20_000, 12, 128, 4096, 1024
#: Pairs scored one by one together.
PAIRS = 100_000
#: Rows that the leaves a query visits hold together at least, counted anew in every tree.
VISITED = 32_000
#: Share of the true neighbours that the walks are to find, and queries at most that it is measured on.
RECALL, PROBES = 0.95, 200


@dataclass(frozen=True)
class Tree:
    """Node i splits by normals[i] . v > 0 into children[i] (below, above); a child -1 - n is leaf n."""

    normals: np.ndarray
    children: np.ndarray
    shares: np.ndarray


def grow(sample: np.ndarray, leaf: float, seed: int) -> Tree:
    """Split at the hyperplane through the origin midway between two random members, to leaves of `leaf` rows.

    sample: unit vectors. Halves that come out worse than 1 to 19 are split at random.
    """
    rng = np.random.default_rng(seed)
    normals, children, shares = [], [], []
    stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
    while stack:
        own, parent, side = stack.pop()
        split = None
        if len(own) > leaf:
            for _ in range(4):
                a, b = sample[rng.choice(own, 2, replace=False)]
                above = sample[own] @ (a - b) > 0
                if 0.05 < above.mean() < 0.95:
                    split = (a - b) / max(np.linalg.norm(a - b), 1e-12)
                    break
        if split is None:
            at = -1 - len(shares)
            shares.append(len(own) / max(1, len(sample)))
        else:
            at = len(normals)
            normals.append(split)
            children.append([0, 0])
            stack += [(own[~above], at, 0), (own[above], at, 1)]
        if parent >= 0:
            children[parent][side] = at
    width = sample.shape[1]
    return Tree(np.array(normals).reshape(-1, width), np.array(children, np.int64).reshape(-1, 2), np.array(shares))


def leaves(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    at = np.zeros(len(vectors), np.int64) if len(tree.normals) else np.full(len(vectors), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        here = at[inner]
        above = np.einsum("ij,ij->i", tree.normals[here], vectors[inner]) > 0
        at[inner] = tree.children[here, above.astype(np.int64)]
    return -1 - at


def visits(trees: list[Tree], vector: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of a queue shared by all trees, to the last leaf."""
    margins = [t.normals @ vector for t in trees]
    queue = [(0.0, k, 0 if len(t.normals) else -1) for k, t in enumerate(trees)]
    heapq.heapify(queue)
    while queue:
        cost, k, at = heapq.heappop(queue)
        while at >= 0:
            m = margins[k][at]
            below, above = trees[k].children[at]
            near, far = (above, below) if m > 0 else (below, above)
            heapq.heappush(queue, (cost + m * m, k, far))
            at = near
        yield k, -1 - at


def walk(trees: list[Tree], vector: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """The visits until their shares add up to `enough`."""
    out, met = [], 0.0
    for k, leaf in visits(trees, vector):
        if met >= enough:
            break
        out.append((k, leaf))
        met += trees[k].shares[leaf]
    return out


def needed(trees: list[Tree], vector: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted unit vector, the sum of shares that a walk has to pass to visit a leaf that holds it."""
    homes = [leaves(t, wanted) for t in trees]
    out, met = np.full(len(wanted), np.inf), 0.0
    for k, leaf in visits(trees, vector):
        out[np.isinf(out) & (homes[k] == leaf)] = met
        if np.isfinite(out).all():
            break
        met += trees[k].shares[leaf]
    return out


def _matrix(values: pd.Series) -> np.ndarray:
    """Vectors as rows, each divided by a power of two near its largest component: directions are kept exactly, and no norm overflows or vanishes."""
    v = np.stack(values.to_numpy()).astype(np.float64)
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / _norms(v)[:, None]


def nearest_of(v: np.ndarray, own: np.ndarray, w: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of v the n nearest rows of w whose id is not its own: (row, index in w, cosine), best first, ties to the smaller id.

    One matrix product leaves the n best and what is as near but for rounding; only these are scored pair by pair.
    """
    nv, nw = _norms(v), _norms(w)
    rough = (v / nv[:, None]) @ (w / nw[:, None]).T
    rough[own[:, None] == ids[None, :]] = -np.inf
    bar = np.partition(rough, rough.shape[1] - n, axis=1)[:, rough.shape[1] - n] if rough.shape[1] > n else np.full(len(v), -2.0)
    row, col = np.nonzero(rough >= np.maximum(bar, -2.0)[:, None] - 1e-9)
    score = np.empty(len(row))
    for a in range(0, len(row), PAIRS):
        i, j = row[a : a + PAIRS], col[a : a + PAIRS]
        score[a : a + PAIRS] = np.einsum("ij,ij->i", v[i], w[j]) / (nv[i] * nw[j])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], col[place < n], score[place < n]


def top(ids: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n best: by score, ties to the smaller id. All equals of the last are looked at."""
    if len(scores) > n:
        bar = np.partition(scores, len(scores) - n)[len(scores) - n]
        at = np.flatnonzero(scores >= bar)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:n]


def _enough(rows: DataFrame, probes: pd.DataFrame, forest: Broadcast, k: int, recall: float) -> float:
    """The sum of shares by which walks have found `recall` of the k true neighbours of the probes (id, v) in rows (id, v).

    One pass over the rows; k rows a probe and task are kept.
    """
    if not len(probes):
        return 0.0
    unit = _unit(_matrix(probes["v"]))
    asked = rows.sparkSession.sparkContext.broadcast((probes["id"].to_numpy(), unit))
    place = f"q int, id long, score double, v {rows.schema['v'].dataType.simpleString()}"

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = asked.value
        best = None
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.iloc[a : a + 2000]
                own, scores = part["id"].to_numpy(), vectors @ _unit(_matrix(part["v"])).T
                scores[ids[:, None] == own] = -np.inf
                at = [top(own, x, k) for x in scores]
                flat = np.concatenate(at)
                q = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in at])
                found = pd.DataFrame({"q": q, "id": own[flat], "score": scores[q, flat], "v": part["v"].to_numpy()[flat]})
                found = found[found["score"] > -np.inf]
                best = (found if best is None else pd.concat([best, found])).sort_values(["q", "score", "id"], ascending=[True, False, True])
                best = best.drop_duplicates(["q", "id"]).groupby("q").head(k)
        if best is not None:
            yield best

    def cost(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["score", "id"], ascending=[False, True]).drop_duplicates("id").head(k)
        return pd.DataFrame({"met": needed(forest.value, asked.value[1][own["q"].iloc[0]], _unit(_matrix(own["v"])))})

    met = rows.select("id", "v").mapInPandas(nearest, place).repartition(16, "q").groupBy("q").applyInPandas(cost, "met double").toPandas()["met"].sort_values().to_numpy()
    return float(np.nextafter(met[max(0, math.ceil(recall * len(met)) - 1)], np.inf)) if len(met) else 0.0


def neighbours(df: DataFrame, query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", visited: int = VISITED, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (cosine, double precision) of the k nearest found of each query row.

    query: which rows of df ask; candidates are all rows but those with the query's own key. visited: how many
    rows the leaves that a query visits hold together at least, a row counted in every tree; with few rows all are found.
    recall: PROBES queries, or all where fewer, are compared with every row; all queries visit as much as finds this share of those neighbours.
    Vectors that are null, zero, hold null or non-finite values, or are not of the commonest length, and null keys take no part.
    Of rows alike in key the best counts once; a query key asked by several rows is answered for one of them (the
    least vector). Ties go to the smaller key. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    raw = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = raw.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine).withColumn("n", F.size("v"))
    rows = materialise(rows, "vectors")
    lengths = rows.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    schema = "query_id long, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = lengths[0]["n"], lengths[0]["rows"]
    rows = rows.filter(F.col("n") == width)
    used = min(1.0, SAMPLE / total)
    picked = rows.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int(used * (1 << 20)) + 1).select("id", "v").orderBy("id", "v").limit(2 * SAMPLE).toPandas()
    sample = _matrix(picked["v"]) if len(picked) else np.zeros((0, width))
    sample = _unit(sample)
    # Leaves of about LEAF rows of the whole table, as far as the sample can tell them apart.
    leaf = max(4.0, LEAF * len(sample) / total)
    forest = [grow(sample, leaf, seed) for seed in range(trees)]
    sent = spark.sparkContext.broadcast(forest)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.iloc[a : a + 2000]
                v = _unit(_matrix(part["v"]))
                for t, tree in enumerate(sent.value):
                    yield pd.DataFrame({"tree": np.full(len(part), t, np.int32), "leaf": leaves(tree, v).astype(np.int32), "id": part["id"].to_numpy(), "v": part["v"].to_numpy()})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.iloc[a : a + 200]
                met = [walk(sent.value, v, enough) for v in _unit(_matrix(part["v"]))]
                n = [len(x) for x in met]
                flat = np.array([x for own in met for x in own], np.int32).reshape(-1, 2)
                at = np.repeat(np.arange(len(part)), n)
                yield pd.DataFrame({"tree": flat[:, 0], "leaf": flat[:, 1], "id": part["id"].to_numpy()[at], "v": part["v"].to_numpy()[at]})

    place = f"tree int, leaf int, id long, v {rows.schema['v'].dataType.simpleString()}"
    filed = rows.select("id", "v").mapInPandas(file, place)
    # Queries are small but take long: they are dealt out by number, not by bytes.
    asking = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v")).repartition(max(16, total // 10_000), "id")
    probes = asking.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(PROBES).toPandas()
    enough = max(visited / total, _enough(rows, probes, sent, k, recall))
    asked = asking.mapInPandas(ask, place)
    # A leaf may hold any share of the rows (copies of one vector): it is dealt into blocks of members and of queries.
    sizes = filed.groupBy("tree", "leaf").agg(F.count("*").alias("members")).join(asked.groupBy("tree", "leaf").agg(F.count("*").alias("asking")), ["tree", "leaf"])
    sizes = materialise(sizes.select("tree", "leaf", F.ceil(F.col("members") / MEMBERS).cast("int").alias("mb"), F.ceil(F.col("asking") / QUERIES).cast("int").alias("qb")), "leaves")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    members = filed.join(sizes, ["tree", "leaf"]).select("tree", "leaf", "id", "v", F.pmod(F.xxhash64("id"), F.col("mb")).cast("int").alias("m"), F.explode(every("qb")).alias("q"))
    queries = asked.join(sizes, ["tree", "leaf"]).select("tree", "leaf", "id", "v", F.explode(every("mb")).alias("m"), F.pmod(F.xxhash64("id"), F.col("qb")).cast("int").alias("q"))

    def rank(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, own = held["id"].to_numpy(), asking["id"].to_numpy()
        row, col, score = nearest_of(_matrix(asking["v"]), own, _matrix(held["v"]), ids, k)
        return pd.DataFrame({"query_id": own[row], "vec_id": ids[col], "score": score})

    keys = ["tree", "leaf", "m", "q"]
    near = queries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(rank, schema)
    # Each (query, leaf block) has given k rows at most: what meets here is bounded by the leaves visited.
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
