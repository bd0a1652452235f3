"""A corpus pipeline over documents: language ID, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bloom, exact, langid, minhash, mixing, packing
from tessitura.llm.common import release, store, table

#: A text is rejected whose likeliest language has a lower posterior, or that has no language at all.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can be told, by a model of the stage's own rows with a language.

    Null and empty texts and texts without a letter go. Repeated rows stay or go together, very long texts are read whole, and
    without any row that has a language (an empty table, say) nothing stays. Stored, for small batches to Python.
    """
    judged = langid.predict(docs, langid.train(docs))
    return store(judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns), "language")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the least doc_id, null ids last; of repeated rows one. Null counts as empty text."""
    return exact.exact_dedup(docs).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): that with the least doc_id, null ids last.

    Rows without words are near nothing and stay. Repeated rows, and rows of one id and text, stay or go together. Rows that
    go are told by id and text.
    """
    rows = store(minhash.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct(), "dropped")
    marked = bloom.mark(docs.withColumn("__text", F.xxhash64("text")), F.col("__text"), bloom.sieve(rows.select("__text")), "__maybe")
    some = marked.filter("__maybe").alias("d")
    kept = some.join(rows.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.__id")) & (F.col("d.__text") == F.col("r.__text")), "left_anti")
    return marked.filter("not __maybe").select(*docs.columns).unionByName(kept.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: weights 5, 2, 1 over 150 % of all words, twice at most.

    Rows are told apart by all their columns; of rows that agree in all, which any mix takes alike, one stands for all with the
    sum of their times. Texts without words (null, empty) count no words and are not taken. A null source is a source.
    """
    keyed = docs.withColumn("__key", F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    mixed = mixing.mix(keyed, "__key", mixing.word_count(), F.array("source"))
    times = mixed.groupBy("doc_id").agg(F.sum("times").alias("__times"), F.count("*").alias("__rows")).filter("__times > 0").withColumnRenamed("doc_id", "__key")
    met = keyed.join(times, "__key")
    once = met.filter("__rows = 1").unionByName(met.filter("__rows > 1").dropDuplicates(["__key"]))
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: what pack_documents says of nulls, empty and long texts and repeated rows. Empty in, empty out."""
    return packing.pack_documents(docs)


def _alone(stage: Callable) -> Callable:
    """The stage, begun without the tables that earlier ones left and nothing reads any more."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _alone(f)) for name, f in (("language_id", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack))]
#: Language ID, signatures and packing are not for SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
