"""The corpus pipeline: language ID, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeql.llm._common import crc_of_id, materialise, spare
from treeql.llm.queries import public_file, table

#: A document whose best language has a lower posterior is rejected.
LEAST_SCORE = 0.5


def named(docs: DataFrame) -> list[Column]:
    """All columns of documents, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language in particular, go."""
    from treeql.llm.language_id import fit, identify, public_pieces

    model = fit(docs, public_pieces(public_file("piece_bpe_32k.model")), crc_of_id(F.col("doc_id")) % 3 != 1)
    lang, score = spare(docs, "lang"), spare(docs, "score")
    scored = identify(docs, model, lang_out=lang, score_out=score)
    return scored.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*named(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays."""
    from treeql.llm.ngram_join import drop_near_duplicates

    return drop_near_duplicates(docs).select(*named(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    from treeql.llm.decontamination import decontaminate

    # A text alone settles whether it is hit, so texts are told apart by their digest, whatever their ids; null texts have none and stay.
    digest = spare(docs, "digest")
    told = docs.withColumn(digest, F.sha2(F.col("text").cast("binary"), 256))
    found = decontaminate(told, table(spark, sf_dir, "benchmark"), key=digest)
    hit = found.filter(F.size("items") > 0).select(F.col("doc_id").alias(digest)).distinct()
    return told.join(hit, digest, "left_anti").select(*named(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes the block at its middle."""
    from treeql.llm.mixing import mix

    # Columns of the mix's own names pass through under others.
    inner = [f"c{i}" for i in range(len(docs.columns))]
    mixed = mix(docs.toDF(*inner), **{k: inner[docs.columns.index(c)] for k, c in (("text", "text"), ("key", "doc_id"), ("source", "source"))}).filter("copies > 0")
    each = mixed.select(*inner, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select(*[F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True)])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: its id, language and source, size, checksum, shard and slot."""
    from treeql.llm.kd_sharding import shard_documents

    return shard_documents(docs, keep=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: Language models and min-hash forests are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not sharding:
            docs = materialise(docs, name.split()[0].lower())
    return docs
