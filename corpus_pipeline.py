"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. language ID: documents whose language is unknown or uncertain go;
2. n-gram Jaccard join: one document of each group of near copies stays, the one with the least doc_id;
3. benchmark decontamination: contaminated documents go;
4. mixing sources to target weights: all documents stay and are written in the order of the mix; a source that
   runs out leaves the mix to the others;
5. token-ID output: the documents are written as token files in the order of that table, which is the mix, and their
   index is read back.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.decontaminate import decontaminate
from shelfwise.llm.jaccard_join import jaccard_components
from shelfwise.llm.language_crf import keep_known
from shelfwise.llm.mixing import schedule
from shelfwise.llm.token_files import token_index, write_token_files
from shelfwise.session import fits, partitions, settle, shared_dir

#: Ids that may be broadcast to drop their documents; beyond, the same join shuffles.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose id is not in ``ids``; documents without an id stay."""
    ids = settle(ids.select("doc_id").distinct(), "gone")
    return docs.join(F.broadcast(ids) if fits(ids, BROADCAST_ROWS) else ids, "doc_id", "left_anti").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that get a language stay, repeated rows and rows without an id too. Null and empty texts and texts
    without letters get none and go; where no row has a language to learn from, all stay. Columns stay as they are.
    """
    return keep_known(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the least doc_id stays. Documents without words link with nothing and stay,
    rows without an id too. Repeated rows of one doc_id are one document: one of them stays. Columns stay as they are.
    """
    found = jaccard_components(docs)
    kept = _without(docs, found.where("doc_id <> component_id"))
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null")) if repeated else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not contaminated stay; null and empty texts are not, an empty benchmark leaves all. Repeated
    rows are judged alike. Columns stay as they are.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents by their place in the mix; rows of one doc_id, or without one, stand at its first place. A null
    source counts as the empty name. Columns stay as they are.
    """
    places = settle(schedule(docs).groupBy("doc_id").agg(F.min("position").alias("__at")).withColumnRenamed("doc_id", "__of"), "places")
    total = (places.agg(F.max("__at")).first()[0] or 0) + 1
    placed = docs.join(F.broadcast(places) if fits(places, BROADCAST_ROWS) else places, F.col("doc_id").eqNullSafe(F.col("__of")), "left")
    n = partitions(spark)
    return placed.repartitionById(n, F.expr(f"cast(__at * {n} div {total} as int)")).sortWithinPartitions("__at").select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str, order: str = "doc_id") -> DataFrame:
    """One row a document of the token files, which are in the order of the column ``order``; null and empty texts hold
    the end id alone, repeated rows repeat, by doc_id rows without one come first.
    """
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), order)
    return token_index(spark, path)


def token_output_in_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``token_output`` in the order in which the rows stand in the files of ``docs``, a table that the stage before wrote;
    by doc_id if it is no table in files.
    """
    number = lambda pattern: F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).cast("long")
    try:
        docs = docs.withColumn("__place", F.struct(number("part-([0-9]+)"), number("-c([0-9]+)"), F.col("_metadata.row_index")))
    except AnalysisException:
        return token_output(spark, docs, sf_dir)
    return token_output(spark, docs, sf_dir, "__place")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_output_in_order),
]

#: Models, a schedule and a tokenizer are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = settle(out, f"stage{k}") if k < len(STAGES) - 1 else out
    return docs
