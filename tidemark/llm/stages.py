"""Stages of a corpus pipeline: each is one operator whose decision takes effect.

A stage takes documents and returns the documents it keeps, with all their
columns; the last one returns pieces. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import saved, table
from tidemark.llm.knn_quality import fit_neighbours, quality_scores
from tidemark.llm.mixing import mixed_documents
from tidemark.llm.ngram_join import similar_documents
from tidemark.llm.piece_codec import piece_ids, read_model
from tidemark.llm.queries import PIECE_MODEL, QUALITY_THRESHOLD
from tidemark.llm.secret_scan import secret_spans


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this input's labelled rows, does not reject.

    NULL and empty texts get the mean label of the sample; repeated rows stay repeated.
    """
    model = fit_neighbours(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, model, carry=True).filter(F.col("score") >= QUALITY_THRESHOLD).select("row.*")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of similar texts.

    Of several such rows the first by hash of text, then of the other columns, stays, so
    reruns agree. Texts without words are in no group: of equal ones under one id, one
    stays. Rows without an id cannot be told apart by it, and stay, once for each text.
    NULLs, long texts and an empty table are as in `similar_documents`.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select("*", F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key"),
                       F.md5(F.to_json(F.struct(*others)).cast("binary")).alias("__mark"))
    own = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("~")), F.col("text_key").cast("string"))
    class_of = F.when(F.col("id").isNotNull(), F.hex("class_key"))
    classes = (similar_documents(docs).select(F.col("id").alias("__id"), F.col("text_key").alias("__key"),
                                              F.coalesce(class_of, own).alias("class")).distinct())
    marks = rows.groupBy("__id", "__key", "__mark").agg(F.count("*").alias("n"))
    same = marks["__id"].eqNullSafe(classes["__id"]) & (marks["__key"] == classes["__key"])
    placed = marks.join(classes, same).select("class", marks["__id"], marks["__key"], "__mark", "n")
    first = saved(placed.groupBy("class").agg(F.min(F.struct("__id", "__key", "__mark", "n")).alias("first"))
                  .select("first.*"), "first")

    def kept(which: DataFrame) -> DataFrame:
        condition = (rows["__id"].eqNullSafe(which["__id"]) & (rows["__key"] == which["__key"])
                     & (rows["__mark"] == which["__mark"]))
        return rows.join(which, condition, "left_semi")

    several = kept(first.filter("n > 1")).dropDuplicates(["__id", "__key", "__mark"])
    return kept(first.filter("n = 1")).unionAll(several).drop("__id", "__key", "__mark")


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a secret; NULL and empty texts have none, long ones are read whole, repeated
    rows stay repeated."""
    return secret_spans(docs, carry=True).filter("n_spans = 0").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are not in it, a NULL source
    is a source of its own, and repeated rows are taken alike."""
    return mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of each row of the mix, whole; a NULL or empty text has no ids."""
    encoded = piece_ids(docs, read_model(PIECE_MODEL))
    return encoded.select(F.col("id").alias("doc_id"), "ids", F.size("ids").cast("long").alias("n_tokens"))
