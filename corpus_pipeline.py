"""From raw documents to packed training sequences: STAGES, and run() over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import exact_dedup, langid, mixing, near_dedup, packing
from kvlake.llm.common import Scratch, passing
from kvlake.llm.queries import held_out, tokenizer_path

#: A document is rejected when it has no letter or its language is less likely than this.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told, with their columns. A null, empty or letterless text is rejected, and
    one whose likeliest language is less likely than LEAST_SCORE. Rows that repeat are judged alike and stay as often.
    An empty table, or one without labelled rows, keeps none."""
    model = langid.fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    whole = docs.select(F.struct("*").alias("row"), "text")
    told = langid.predict(whole, model, keep=("row",))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays; of rows that repeat an id and a text, one. A null text
    equals an empty one. An empty table stays empty."""

    def key(digest: F.Column) -> F.Column:  # never null, so that the join and the repeats share one exchange
        return F.concat(digest, F.coalesce(F.concat(F.lit("+"), F.col("doc_id").cast("string")), F.lit("-")))

    kept = exact_dedup.exact_dedup(docs, keep="min").where("kept").select(key(F.col("text_sha256")).alias("key"))
    whole = docs.select(key(exact_dedup.digest(F.col("text"))).alias("key"), F.struct("*").alias("row"))
    return whole.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays. Documents without an id or without words are
    no one's duplicates and stay. Rows that repeat an id share its fate. An empty table stays empty."""
    dropped = near_dedup.near_dedup(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["doc_id"], "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: 0, 1 or 2 times; one without words once. Null is a source of
    its own. Of rows that share an id, or have none, each follows the mean of that id. An empty table stays empty."""
    return mixing.copies_of(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences. A null text has the end id alone. Rows that repeat,
    such as the mix's copies, are packed each by itself, told apart by the column copy. An empty table gives no row."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: Naive Bayes, tilted rates and the tokenizer are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents. Each stage's result is written, and what came before goes: the result
    before, and all tables that the stage's operator wrote. After an error nothing stays; the last result goes when the
    driver's Python ends."""
    docs, tables, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    try:
        for name, stage in STAGES:
            with passing():
                docs = tables.save(stage(spark, docs, sf_dir), name)
            if before:
                tables.drop(before)
            before = name
    except BaseException:
        tables.end()
        raise
    return docs
