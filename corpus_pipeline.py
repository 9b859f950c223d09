"""From raw documents to packed sequences: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the
columns of documents; the last returns the pieces of the packed sequences. run() writes
each stage as Parquet into the shared folder and reads it again for the next.

Defined results, of every stage: an empty table gives an empty table; other columns than
doc_id, text, lang and n_chars are carried along as they are, whatever their names. Rows
whose doc_id is null are documents of their own. What each does with null texts, ties
and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import common, exact, langid, minhash, pii, queries, tokens

#: Near copies of the stage; op2 alone has a threshold of 85.
NEAR_PERCENT = 80
#: A document whose best language is less likely than this is in none.
LEAST_SCORE = 0.4
#: The languages that the corpus is to keep; None: all that the network has learned.
LANGUAGES: tuple[str, ...] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of LANGUAGES: texts that are null or have no letter go, those whose best language has a score under LEAST_SCORE, and those of other languages.

    The network learns from the rows that are not held out and have a language; where
    there are none, only null and letterless texts go. Repeated rows share their fate.
    """
    net = langid.fit(docs.where(~queries.held_out()))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told, score = common.unused(docs, "told", "score")
    found = langid.predict(docs, net, lang_out=told, score_out=score)
    wanted = F.col(told) != langid.UNKNOWN if LANGUAGES is None else F.col(told).isin(*LANGUAGES)
    return found.where(wanted & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id; null text equals empty text.

    Rows of the winning doc_id stay once if they are equal in full, and all of them if
    other columns differ. Of equal texts without any doc_id every one stays.
    """
    found = common.saved(exact.exact_duplicates(docs).select("row", "kept"), "copies")
    (row,) = common.unused(docs, "row")
    keyed = docs.withColumn(row, exact.row_key(F.col("doc_id"), F.col("text")))
    again = found.where("kept").groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row")
    left = common.without(keyed, row, found.where("not kept").select("row").distinct())
    if not again.isEmpty():
        numbered = common.among(left.where(F.col("doc_id").isNotNull()), row, again).dropDuplicates()
        left = common.without(left, row, again).unionByName(numbered).unionByName(common.among(left.where(F.col("doc_id").isNull()), row, again))
    return left.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies: similarity NEAR_PERCENT or more on five-word shingles.

    Null and empty texts are near nothing. Rows that share a doc_id stay or go together.
    """
    gone = minhash.near_duplicates(docs, percent=NEAR_PERCENT).where("not kept").select(F.col("id").alias("doc_id")).distinct()
    return common.without(docs, "doc_id", gone)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced; n_chars follows the text, and is null for a null one. Rows with equal doc_id and text get equal texts."""
    return pii.sanitised(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeated rows one by one; a null text is an end token alone."""
    return tokens.pack(docs, queries.vocabulary_path()).withColumnRenamed("id", "doc_id")


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packed)]

#: A trained network, sketches and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs
