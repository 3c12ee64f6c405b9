"""From raw documents to packed training sequences: four stages, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept and takes (spark, docs, sf_dir). All but the last return the columns of ``documents``.

Defined cases: other columns, of any name and type, pass through unchanged up to the packing, which names none but its own; null, empty and
blank texts are rejected by the first stage; a null source shares bins with any other; rows that share an id but not the text are documents
of their own; rows equal in id and text, with or without an id, are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.langid import LangParams, fit, predict
from ledgerloom.llm.merkle import placed
from ledgerloom.llm.packing import best_fit
from ledgerloom.llm.phrases import remove_repeats
from ledgerloom.llm.probminhash import near_duplicates
from ledgerloom.llm.shared import materialise
from ledgerloom.session import discard, shared_dir, written

#: A document whose leading language holds less than this share of its letters is rejected.
LEAST_LANGUAGE_SHARE = 0.5


_left: dict[str, list[str]] = {}


def staged(function):
    """A stage that first deletes its predecessor's intermediate tables, unless ``docs`` is still computed from them."""

    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        read = " ".join(docs.inputFiles())
        discard(spark, [p for p in _left.pop(app, []) if p.rpartition("/")[2] not in read])
        before = set(written(spark))
        out = function(spark, docs, sf_dir)
        _left[app] = [p for p in written(spark) if p not in before]
        return out

    return stage


def text_key() -> Column:
    return F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-"))


def without(docs: DataFrame, rejected: DataFrame, key: Column) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in ``rejected`` (one column)."""
    name = f"__{uuid.uuid4().hex}"
    return docs.join(rejected.toDF(name).distinct(), key == F.col(name), "left_anti")


@staged
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (null, no letter) or without a leading one. Equal texts share the decision, whatever their ids."""
    found = predict(docs.select(text_key().alias("doc_id"), "text"), fit(docs, LangParams()))
    rejected = found.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE_SHARE)).select("doc_id")
    return without(docs, materialise(rejected, "rejected"), text_key())


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, the one with the smallest doc_id (rows without an id come last).

    Where an id repeats or is null, rows are numbered by (doc_id, text) and decided one by one; else the ids are the numbers.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] == ids["d"]:
        classes = near_duplicates(docs.select("doc_id", "text"))
        return without(docs, materialise(classes.filter("class_id <> doc_id").select("doc_id"), "rejected"), F.col("doc_id"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keys = [F.lit(0).alias("tree"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), text_key().alias("key")]
    numbered = materialise(placed(docs.select(*keys, whole), ["tree", "last", "id", "key"]), "numbered")
    classes = near_duplicates(numbered.select(F.col("pos").alias("doc_id"), "row.text"))
    kept = without(numbered, materialise(classes.filter("class_id <> doc_id").select("doc_id"), "rejected"), F.col("pos"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@staged
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; a document of which nothing is left goes."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = remove_repeats(docs, with_text=True, extra=rest).filter("n_removed < n_words or n_words = 0")
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[own[c].alias(c) if c in own else F.col("extra")[c].alias(c) for c in docs.columns])


@staged
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in sequences of fixed capacity."""
    return best_fit(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: No stage but the packing of a single shard could be put in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's table is deleted when the next one is written; the last one stays, as the result is read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, [before])
        before = path
    return docs
