"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of 2^m slots; slot i stands at the i-th point of the van der Corput sequence (the bits of i
reversed), and the cumulative slots of the sources say whose slot it is. A source's slots, ranked, take its blocks
in turn: runs of equally many words of its documents in shuffled order, begun anew when all are taken. All counts
are integers, so reruns agree; sources, slots and documents are tables, none of which reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeql.llm._common import materialise

#: Least words of a block; least blocks of a source (if it has so many words); blocks of all sources by length, about, at most: blocks grow with the words beyond.
BLOCK, LEAST, BLOCKS = 512, 512, 1 << 27
#: Slots ranked by one task, rows summed by one, and sources that are broadcast at most.
RANKED, SUMMED, SMALL = 1 << 20, 10_000, 100_000
#: A source may be taken so many times, and sources weigh so, in order of their code points, null last.
REPEATS, WEIGHTS = 3, (5, 2, 1)


def div(a: Column, b: Column) -> Column:
    """Whole quotient of longs that are not negative."""
    return ((a - a % b) / b).cast("long")


def _before(df: DataFrame, group: list[str], order: str, n: str, out: str) -> DataFrame:
    """With `out`: the sum of n over the group's rows before this one."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(n).over(before), F.lit(0)))


def plan_sources(sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, int]:
    """From (src, size), one row a source: k (its number, in order of code points, null last), target, blocks, base and
    rem (the first rem blocks have base + 1 words, the others base), slots and start (of its points); and the number of all slots.

    Targets share all words by weight, none above `repeats` times its source's size; what is above is shared
    by weight among the others until none is.
    """
    ordered = sums.repartitionByRange(F.col("src").isNull(), F.col("src")).sortWithinPartitions(F.col("src").isNull(), "src")
    # Ids rise in the order of the range partitions and of the rows in each.
    ordered = materialise(ordered.withColumn("id", F.monotonically_increasing_id()), "sources").withColumns({"part": F.shiftright("id", 33), "at": F.col("id").bitwiseAND((1 << 33) - 1)})

    def numbered(df: DataFrame, n: str, out: str) -> DataFrame:
        """With the sum of n over all sources before: by partition, then inside it."""
        parts = df.groupBy("part").agg(F.sum(n).alias("own")).withColumn("all", F.lit(0))
        offsets = _before(parts, ["all"], "part", "own", "offset").select("part", "offset")
        return _before(df, ["part"], "at", n, out).join(F.broadcast(offsets), "part").withColumn(out, F.col(out) + F.col("offset")).drop("offset")

    known = numbered(ordered.withColumn("one", F.lit(1).cast("long")), "one", "k")
    known = known.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
    known = materialise(known.select("src", "size", "part", "at", "k", "w"), "sources")
    full = lambda share: F.lit(share) * F.col("w") > repeats * F.col("size")
    share = -1.0
    while True:
        # A source that is full stays full: shares only rise.
        r = known.agg(F.sum("size").alias("all"), F.sum(F.when(full(share), F.col("size"))).alias("full"), F.sum(F.when(~full(share), F.col("w"))).alias("w")).first()
        now = ((r["all"] or 0) - repeats * (r["full"] or 0)) / r["w"] if r["w"] else share
        if now == share:
            break
        share = now
    words = max(BLOCK, -(-(r["all"] or 0) // BLOCKS))
    size = F.col("size")
    known = known.withColumn("target", F.when(full(share), (repeats * size).cast("double")).otherwise(F.lit(max(share, 0.0)) * F.col("w")))
    known = known.withColumn("blocks", F.greatest(div(size + (words - 1), F.lit(words).cast("long")), F.least(size, F.lit(LEAST).cast("long"))))
    some = F.greatest(F.col("blocks"), F.lit(1).cast("long"))
    known = known.withColumns({"base": div(size, some), "rem": size % some})
    known = known.withColumn("slots", F.when(size > 0, F.least(F.round(F.col("blocks") * F.col("target") / size).cast("long"), repeats * F.col("blocks"))).otherwise(0))
    known = materialise(numbered(known, "slots", "start").drop("part", "at", "w"), "sources")
    return known, int(known.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"])


def schedule(sources: DataFrame, n: int) -> DataFrame:
    """The mix of plan_sources()' rows: slot, k (number of its source), rank (in the source's slots), block, epoch.

    Slots are numbered up to the next power of two; those whose points are past all sources' stay empty and are left out.
    """
    bits = max(0, math.ceil(math.log2(n))) if n > 1 else 0
    held = F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("slots") - 1, F.lit(RANKED).cast("long"))))
    chunks = sources.filter("slots > 0").select("k", "blocks", "start", "slots", held.alias("chunk"))
    # Every chunk of a source's points is dealt by itself: one source may own most of them.
    chunks = chunks.repartition("k", "chunk") if n > RANKED else chunks
    first = F.col("start") + F.col("chunk") * RANKED
    points = chunks.select("k", "blocks", F.explode(F.sequence(first, F.least(first + RANKED, F.col("start") + F.col("slots")) - 1)).alias("point"))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long") if bits else F.col("point")
    part_bits = max(0, bits - (RANKED.bit_length() - 1))
    slots = points.select("k", "blocks", slot.alias("slot")).withColumn("part", F.shiftright("slot", bits - part_bits))
    counts = slots.groupBy("k", "part").agg(F.count("*").alias("n"))
    offsets = _before(counts, ["k"], "part", "n", "offset").select("k", "part", "offset")
    within = Window.partitionBy("k", "part").orderBy("slot")
    ranked = slots.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["k", "part"]).withColumn("rank", F.col("rank") + F.col("offset"))
    return ranked.select("slot", "k", "rank", (F.col("rank") % F.col("blocks")).alias("block"), div(F.col("rank"), F.col("blocks")).cast("int").alias("epoch"))


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all if None) of df, then size, source_size, target, taken (words the mix takes of the
    document, repeats counted) and copies (how often it takes the block at the document's middle).

    Size is the number of words (runs without white space); a null text has none, is never taken, and its source may have
    target 0. Null is a source of its own, the last. Documents of a source are shuffled by a hash of their key,
    rows alike in key, size and text in any order among each other. Repeated rows are mixed as rows of their own; an empty
    table gives an empty result. Columns of the result's names are replaced. There may be any number of sources.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("size", "source_size", "target", "taken", "copies")]
    inner = [f"c{i}" for i in range(len(kept))]
    rows = df.select(
        *[F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)],
        F.col(f"`{source}`").cast("string").alias("src"),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h"),
        F.col(f"`{key}`").cast("string").alias("key"),
        F.crc32(F.col(f"`{text}`").cast("binary")).alias("crc"),
    )
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "mix")
    sources, slots = plan_sources(rows.groupBy("src").agg(F.sum("size").alias("size")), weights, repeats)
    counted = sources.agg(F.count("*").alias("n")).first()["n"]
    parts = max(1, -(-rows.count() // SUMMED))
    known = sources.select(F.col("src").alias("of"), "k", F.col("size").alias("source_size"), "target", "base", "rem")
    # A row for each source: beyond a proven small number Spark chooses the join, and splits a hot source where it is skewed.
    known = F.broadcast(known) if counted <= SMALL else known
    dealt = rows.join(known, F.col("src").eqNullSafe(F.col("of"))).withColumn("part", F.pmod(F.xxhash64("h", "crc"), F.lit(parts)).cast("int"))
    held = dealt.groupBy("k", "part").agg(F.sum("size").alias("n"))
    offsets = _before(held, ["k"], "part", "n", "offset").select("k", "part", "offset")
    small = dealt.select("row", "k", "part", "h", "key", "size", "crc", "base", "rem")
    within = Window.partitionBy("k", "part").orderBy("h", "key", "size", "crc", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["k", "part"]).withColumn("start", F.col("start") + F.col("offset"))

    def block_of(at: Column) -> Column:
        long = F.col("rem") * (F.col("base") + 1)
        return F.when(at < long, div(at, F.col("base") + 1)).otherwise(F.col("rem") + div(at - long, F.greatest("base", F.lit(1))))

    spans = placed.filter("size > 0").withColumns({"first": block_of(F.col("start")), "last": block_of(F.col("start") + F.col("size") - 1), "middle": block_of(F.col("start") + F.expr("size div 2"))})
    pieces = spans.select("row", "k", "start", "size", "base", "rem", "middle", F.explode(F.sequence("first", "last")).alias("block"))
    begin = lambda b: b * F.col("base") + F.least(b, F.col("rem"))
    overlap = F.least(F.col("start") + F.col("size"), begin(F.col("block") + 1)) - F.greatest(F.col("start"), begin(F.col("block")))
    times = schedule(sources, slots).groupBy("k", "block").agg(F.count("*").alias("times"))
    taken = pieces.withColumn("words", overlap).join(times, ["k", "block"]).groupBy("row").agg(
        F.sum(F.col("words") * F.col("times")).alias("taken"),
        F.max(F.when(F.col("block") == F.col("middle"), F.col("times"))).alias("copies"),
    )
    out = dealt.select("row", *inner, "size", "source_size", "target").join(taken, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*[F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)], "size", "source_size", "target", zero("taken"), zero("copies"))
