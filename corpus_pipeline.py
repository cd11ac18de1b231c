"""The corpus pipeline: quality, near-duplicates, secrets, packing. Each stage works on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet under the shared folder and
reads it again for the next one, so a stage that is done survives lost executors. All but the last return the columns of
``documents``, in their order; further columns of docs pass through. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Similarity in hundredths from which the pipeline takes documents for near copies; a pair at it is missed once in 5,000 times.
SIMILAR = 80
#: Ids up to which those that go are broadcast (8 bytes each).
MOST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null texts count as empty; equal rows go or stay together; rows without an id are judged like others; without labels of both classes
    all stay.
    """
    from weft.llm.common import table
    from weft.llm.quality import fit, keep_good

    return keep_good(docs, fit(spark, docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id stays. Stages link from a similarity of SIMILAR
    hundredths on; op1's own threshold is stricter.

    Null, empty and blank texts are linked with nothing and stay. Of equal rows (id and text) one stays; rows that share an id but not a
    text go or stay together. A row without an id goes if a row with one has its text, else it stays.
    """
    from weft.llm.common import Scratch, checked_broadcast
    from weft.llm.minhash import near_duplicates

    scratch = Scratch(spark, "dedup")
    marks = scratch.keep(near_duplicates(spark, docs, hundredths=SIMILAR).select("doc_id", "component_id", "kept"), "marks")
    gone = marks.where("not kept and doc_id is not null").select("doc_id").distinct()
    left = docs.join(checked_broadcast(gone, gone.count(), MOST_IDS), "doc_id", "left_anti").select(*docs.columns)
    # Ids and hashes alone are moved to find what occurs twice; texts move for those rows only.
    same = F.xxhash64("text")
    keys = left.select("doc_id", same.alias("same"))
    twice = keys.where("doc_id is not null").groupBy("doc_id", "same").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "same")
    n = twice.count()
    if n:
        marked = left.withColumn("__same", same).join(checked_broadcast(twice.select(F.col("doc_id").alias("__id"), F.col("same").alias("__s"), F.lit(True).alias("__twice")), n, MOST_IDS), (F.col("doc_id") == F.col("__id")) & (F.col("__same") == F.col("__s")), "left")
        once = marked.where("__twice is null").select(*docs.columns)
        left = once.unionByName(marked.where("__twice").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
    if marks.where("doc_id is null and not kept").isEmpty():
        return left
    # Rows without an id whose text a row with an id has: their sets decide, so they are judged again on their own.
    named, nameless = left.where("doc_id is not null"), left.where("doc_id is null")
    texts = docs.where("doc_id is not null").select("text").distinct()
    return named.unionByName(nameless.join(texts, "text", "left_anti").select(*docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans with secrets are replaced by marks; n_chars follows the text.

    Row by row, so ties and repeated rows don't matter; null and empty texts stay as they are.
    """
    from weft.llm.common import bounded_batches
    from weft.llm.secret_scan import corpus_identifiers, redact_documents

    bounded_batches(spark)
    return redact_documents(docs, identifiers=corpus_identifiers(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets.

    A null or empty text is the one piece [0]; equal pieces get a place each; ties between pieces go by id and piece.
    """
    import public_tokenizers

    from weft.llm.packing import pack

    return pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: No stage but the last one's arithmetic can be said in SQL; tests/llm holds near_dedup, secrets and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    from weft.llm.common import Scratch, table

    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
