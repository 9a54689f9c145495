"""K-d tree sharding in DataFrame operations only.

Every node of the tree is split at the weighted median (weights: bytes) of its widest dimension until a leaf
holds the target bytes; a level handles all its nodes together. A median is searched by histograms: bytes by
node and bucket are summed in Spark, and the bucket that holds the median is cut into buckets again. Where a bucket
has no more rows than a pass may have buckets, its values are summed singly, so the passes grow with the logarithm
of the rows, not with the width of the values. Only nodes x buckets sums reach the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeql.llm._common import materialise

#: Buckets of all histograms of a pass together (at least LEAST each; their sums reach the driver), and rows numbered in one window.
BUCKETS, LEAST, NUMBERED = 1 << 16, 16, 20_000


def small_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A table of the driver's values (here: a row for each open node), made and broadcast inside the JVM."""
    names = [x.split()[0] for x in schema.split(", ")]
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{schema.replace(' ', ':').replace(',:', ', ')}>>"))))


@dataclass
class _Search:
    """A node's median search along one dimension: the first value whose bytes from the left reach `want`. n: its rows from low to high."""

    dim: int
    low: int
    high: int
    want: int
    n: int
    left: int = 0

    def width(self, buckets: int) -> int:
        return 1 if self.n <= buckets else max(1, -(-(self.high - self.low + 1) // buckets))


def _medians(rows: DataFrame, open_: dict[int, _Search]) -> dict[int, tuple[int, int, int, int]]:
    """By node: the value that holds the median, the bytes left of it, its own bytes and rows. rows: node, values, weight."""
    done: dict[int, tuple[int, int, int, int]] = {}
    while open_:
        buckets = max(LEAST, BUCKETS // len(open_))
        asked = small_table(rows.sparkSession, "node long, dim int, low long, high long, width long", [(k, s.dim, s.low, s.high, s.width(buckets)) for k, s in open_.items()])
        held = rows.join(asked, "node").withColumn("v", F.col("values")[F.col("dim")]).filter(F.col("v").between(F.col("low"), F.col("high")))
        offset = F.col("v") - F.col("low")
        sums: dict[int, list] = {}
        for r in held.groupBy("node", (offset - F.pmod(offset, F.col("width"))).alias("bucket")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect():
            sums.setdefault(r["node"], []).append((r["bucket"], r["weight"], r["n"]))
        for k, s in list(open_.items()):
            left, width = s.left, s.width(buckets)
            for bucket, weight, n in sorted(sums[k]):  # noqa: B007
                if left + weight >= s.want:
                    break
                left += weight
            start = s.low + bucket
            if width == 1:
                done[k] = (start, left, weight, n)
                del open_[k]
            else:
                open_[k] = _Search(s.dim, start, min(s.high, start + width - 1), s.want, n, left)
    return done


def kd_shards(df: DataFrame, dims: dict[str, Column], weight: Column, group: Column, tie: Column, shards: int | None = None, target_bytes: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all if None) of df with `shard` (from 0) and `slot` (gapless from 0 in each shard).

    dims: name -> integer column from 0 to 2^31 - 1 (null counts as 0). group: a 32-bit number; rows of equal
    dims and group stay in one shard, unless keeping them together would put a split off its weighted median by
    over a hundredth of the target: then they are dealt by `tie` (a 32-bit number as well). With target_bytes, the number of leaves is
    total / target_bytes, rounded up; else it is `shards`.

    Repeated rows each keep their place; null weights count as 1; an empty table gives an empty result. shard
    and slot replace columns of those names; no other name clashes.
    """
    spark = df.sparkSession
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("shard", "slot")]
    inner = [f"c{i}" for i in range(len(kept))]
    number = F.pmod(group.cast("long"), F.lit(1 << 32))
    values = [F.shiftleft(F.coalesce(c.cast("long"), F.lit(0).cast("long")), 32) + number for c in dims.values()]
    rows = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)], F.array(*values, F.pmod(tie.cast("long"), F.lit(1 << 32))).alias("values"), F.coalesce(weight.cast("long"), F.lit(1).cast("long")).alias("weight"))
    # The root's number is stored, so that joins by node stay equi-joins where it is the same in all rows.
    rows = materialise(rows.withColumns({"row": F.monotonically_increasing_id(), "node": F.lit(0).cast("long")}), "kd")
    ends = [f(F.col("values")[i]).alias(f"{p}{i}") for i in range(len(dims)) for p, f in (("lo", F.min), ("hi", F.max))]
    total = rows.agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), *ends).first()
    named = [F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)]
    if not total["n"]:
        return rows.select(*named, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaves = shards or max(1, -(-total["weight"] // target_bytes))
    slack = total["weight"] // leaves // 100
    spread = [max(1, total[f"hi{i}"] - total[f"lo{i}"]) for i in range(len(dims))]
    tree = rows
    #: node -> its leaves to make and the number of the first of them
    open_, closed, made, level = {0: (leaves, 0)}, {}, 1, 0
    while True:
        closed |= {k: first for k, (n, first) in open_.items() if n == 1}
        open_ = {k: x for k, x in open_.items() if k not in closed}
        if not open_:
            break
        stats = {r["node"]: r for r in tree.groupBy("node").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), *ends).collect()} if level else {0: total}
        open_ = {k: x for k, x in open_.items() if k in stats}
        dim = {k: max(range(len(dims)), key=lambda i: ((stats[k][f"hi{i}"] - stats[k][f"lo{i}"]) / spread[i], -i)) for k in open_}
        want = {k: stats[k]["weight"] * (n // 2) // n for k, (n, _) in open_.items()}
        found = _medians(tree, {k: _Search(dim[k], stats[k][f"lo{dim[k]}"], stats[k][f"hi{dim[k]}"], want[k], stats[k]["n"]) for k in open_})
        heavy = {k: x for k, x in found.items() if min(want[k] - x[1], x[1] + x[2] - want[k]) > slack}
        ties: dict[int, tuple[int, int, int]] = {}
        if heavy:
            own = small_table(spark, "node long, dim int, split long", [(k, dim[k], v) for k, (v, _, _, _) in heavy.items()])
            one = tree.join(own, "node").filter(F.col("values")[F.col("dim")] == F.col("split")).drop("dim", "split")
            ties = _medians(one, {k: _Search(len(dims), 0, (1 << 32) - 1, want[k], n, left) for k, (_, left, _, n) in heavy.items()})
        steps = []
        for k, (n, first) in open_.copy().items():
            v, left, weight_here, _ = found[k]
            together = left + weight_here - want[k] <= want[k] - left
            tie_at = ties[k][0] if k in ties else (1 << 32) if together else -1
            steps.append((k, dim[k], v, tie_at, made, made + 1))
            del open_[k]
            open_[made], open_[made + 1] = (n // 2, first), (n - n // 2, first + n // 2)
            made += 2
        at = small_table(spark, "node long, dim int, split long, tie_at long, below long, above long", steps)
        here, tie_here = F.col("values")[F.col("dim")], F.col("values")[len(dims)]
        goes_below = (here < F.col("split")) | ((here == F.col("split")) & (tie_here <= F.col("tie_at")))
        moved = F.when(F.col("split").isNull(), F.col("node")).when(goes_below, F.col("below")).otherwise(F.col("above"))
        tree = tree.join(at, "node", "left").withColumn("node", moved).drop("dim", "split", "tie_at", "below", "above")
        level += 1
        if level % 4 == 0:
            tree = materialise(tree, "kd")
    leaf = small_table(spark, "node long, shard int", list(closed.items()))
    return number_rows(tree.join(leaf, "node"), total["n"]).select(*named, "shard", "slot")


def number_rows(placed: DataFrame, n: int) -> DataFrame:
    """`slot`: a gapless number in each shard. Rows are dealt to parts by their row number's hash; each part is
    numbered by itself from the count of the parts before it, so no task holds a shard.
    """
    parts = max(1, -(-n // NUMBERED))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("row")
    numbered = dealt.withColumn("rank", F.row_number().over(within))
    return numbered.join(offsets, ["shard", "part"]).withColumn("slot", F.col("offset") + F.col("rank") - 1)


def shard_documents(df: DataFrame, text: str = "text", key: str = "doc_id", shards: int = 8, keep: list[str] | None = None) -> DataFrame:
    """Documents in `shards` shards of near-equal bytes (UTF-8 bytes of the text, null: none, plus 1).

    Dimensions are the text's bytes, lines and checksum, all functions of the text, so that equal texts stay together; a group of
    them is dealt out by a hash of the key only where its bytes would put a split off its median by over a hundredth of a
    shard, since the law is bytes: at most one group for every split, 7 of 8 shards. Null texts are empty. Columns `keep` (all if None), size, text_crc32, shard and slot.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("size", "text_crc32")]
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)],
        F.col(f"`{text}`").alias("body"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(7)).alias("tie"),
    )
    lines = F.length("body") - F.length(F.replace(F.col("body"), F.lit("\n"), F.lit("")))
    dims = {"size": F.col("size"), "lines": lines, "checksum": F.shiftright(F.col("text_crc32"), 1)}
    names = [f"k{i}" for i in range(len(kept))]
    out = kd_shards(rows, dims, F.col("size"), F.col("text_crc32"), F.col("tie"), shards=shards, keep=[*names, "size", "text_crc32"])
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], "size", "text_crc32", "shard", "slot")
