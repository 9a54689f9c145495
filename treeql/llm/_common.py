"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where lineage is cut if the session names no folder; only ever used on a local master.
LOCAL_SHARED = "/tmp/checkpoints/treeql"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, read from the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_SHARED


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, lost executors lose nothing.

    Every call writes to a folder of its own, so a retried or repeated call never sees stale rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/treeql-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spare(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to about `most` each; an item over it stands alone."""
    cuts, held = [0], 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            cuts.append(i)
            held = 0
        held += n
    cuts.append(len(sizes))
    return ((a, b) for a, b in pairwise(cuts) if b > a)


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text, unsigned; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts together: what partition counts are sized by."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"])
