"""Document fingerprints: canonical exact digests, with DataFrame functions only.

Canonical form: compatibility composition (NFKC), full case folding, NFKC again, white space runs as one space, trimmed.
Normalisation and folding come from the Unicode library that ships with Spark, called by SQL's reflect(). The fingerprint
is a wide xxhash: two 64-bit hashes with different seeds. Documents that share it form a bucket; inside buckets with
several rows the canonical bytes themselves are compared (a grouping by hash and bytes), and a text that differs from the
bucket's first one gets an ordinal, so equal fingerprints of documents mean equal canonical bytes. Likeness is exact: 1.0 where
hashes and canonical bytes agree, else 0.0.

The next document. Rows with equal id and text (by a wide hash of it) are one key with a count. Keys are put in descending order by a range
partitioning on id and hash, so neither sparse ids nor one id for many texts fill a task; a key's successor is the next one of its part,
or the first key of the next part. Texts are grouped by key once; a row's next text travels as the prefix that its edit needs.

Defined results: null and empty texts are the empty text, all alike; rows with one id follow each other in the order of their texts' hashes,
equal rows among them are each other's next, but for the last one; rows without an id come after all others; a single document is its own
next; a very long text is one value in one task; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import Scratch, checked_broadcast

#: Rows up to which bucket keys (16 bytes and a count each) are broadcast.
MOST_KEYS = 200_000
#: What tells texts of one id apart, and the columns of a key.
KEY = ["doc_id", "h1", "h2"]


def canonical(text: Column) -> Column:
    def composed(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = composed(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\p{Z}]+", " "))


def _half(canon: Column, seed: str) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), canon))), 16, "0")


def wide_hash(canon: Column) -> Column:
    """128 bits in hexadecimal digits: two hashes whose seeds come from different leading values."""
    return F.concat(_half(canon, "first half"), _half(canon, "second half"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h1, h2, text: texts without nulls, with the hashes that tell them apart."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.withColumns({"h1": F.xxhash64(F.lit("first half"), "text"), "h2": F.xxhash64(F.lit("second half"), "text")})


def successors(scratch: Scratch, keys: DataFrame) -> DataFrame:
    """keys with n_id, n_h1, n_h2, n_print: the key that follows by descending id, hash and hash; after the last one comes the first.

    Only keys are moved, none of their texts; one row a part is looked at together.
    """
    down = [F.desc_nulls_last("doc_id"), F.desc("h1"), F.desc("h2")]
    parts = scratch.keep(keys.repartitionByRange(*down).withColumn("part", F.spark_partition_id()), "ordered")
    me = F.struct(*KEY, "fingerprint")
    inside = parts.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy(*down)))
    tops = parts.groupBy("part").agg(F.max_by(me, F.struct(F.col("doc_id").isNotNull(), *KEY)).alias("top"))
    # As many rows as there are parts.
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    tops = tops.select("part", F.coalesce(F.lead("top").over(every), F.first("top").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    n = F.coalesce("next", "after")
    return inside.join(F.broadcast(tops), "part").select(*keys.columns, n["doc_id"].alias("n_id"), n["h1"].alias("n_h1"), n["h2"].alias("n_h2"), n["fingerprint"].alias("n_print"))


def likeness(hash_a: Column, hash_b: Column, canon_a: Column, canon_b: Column) -> Column:
    """Bytes are compared where the hashes agree."""
    return F.when((hash_a == hash_b) & (canon_a == canon_b), F.lit(1.0)).otherwise(F.lit(0.0))


def colliding_texts(keys: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(fingerprint, h1, h2, ordinal >= 1) of the texts whose fingerprint another canonical text has; None if there are none.

    keys: fingerprint, h1, h2, rows; texts: h1, h2, text. Texts are moved only for fingerprints of several different texts.
    """
    shared = keys.select("fingerprint", "h1", "h2").distinct().groupBy("fingerprint").agg(F.count("*").alias("texts")).where("texts > 1").select("fingerprint")
    n = shared.count()
    if not n:
        return None
    wanted = keys.join(checked_broadcast(shared, n, MOST_KEYS), "fingerprint", "left_semi").select("fingerprint", "h1", "h2").distinct()
    canon = texts.join(checked_broadcast(wanted, wanted.count(), MOST_KEYS), ["h1", "h2"]).select("fingerprint", "h1", "h2", canonical(F.col("text")).alias("canon"))
    # A group holds one row a canonical text, so it has more than one only where hashes collide.
    forms = canon.groupBy("fingerprint", "canon").agg(F.lit(1).alias("one"))
    several = forms.groupBy("fingerprint").agg(F.count("*").alias("forms")).where("forms > 1")
    if several.isEmpty():
        return None
    nth = F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon")) - 1
    forms = forms.join(several, "fingerprint", "left_semi").select("fingerprint", "canon", nth.alias("ordinal")).where("ordinal > 0")
    return canon.join(forms, ["fingerprint", "canon"]).select("fingerprint", "h1", "h2", "ordinal").distinct()


def fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and the likeness to the edited and to the next text."""
    scratch, d = Scratch(spark, "fingerprint"), keyed(docs, id_col, text_col)
    prints = d.select(*KEY, F.char_length("text").alias("n_chars"), wide_hash(canonical(F.col("text"))).alias("fingerprint"))
    # Counted before the shuffle, so equal rows are one row a task there.
    keys = scratch.keep(prints.groupBy(*KEY, "n_chars", "fingerprint").agg(F.count("*").alias("rows")), "keys")
    collisions = colliding_texts(keys, d)
    if collisions is not None:
        named = keys.join(collisions, ["fingerprint", "h1", "h2"], "left")
        keys = scratch.keep(named.withColumn("fingerprint", F.concat_ws("-", "fingerprint", F.col("ordinal").cast("string"))).drop("ordinal"), "named")
    follow = scratch.keep(successors(scratch, keys), "follow")
    # One text a key: both sides below read this one shuffle. Null ids go as a text of their own kind.
    own = [F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("id"), "h1", "h2"]
    texts = d.select(*own, "text").groupBy("id", "h1", "h2").agg(F.any_value("text").alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    plan = follow.select("*", half.alias("half"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("id"))
    after = plan.select(F.col("id").alias("of_id"), F.col("h1").alias("of_h1"), F.col("h2").alias("of_h2"), "half", F.coalesce(F.col("n_id").cast("string"), F.lit("none")).alias("id"), F.col("n_h1").alias("h1"), F.col("n_h2").alias("h2"))
    prefix = after.join(texts, ["id", "h1", "h2"]).select(F.col("of_id").alias("id"), F.col("of_h1").alias("h1"), F.col("of_h2").alias("h2"), F.expr("left(text, half)").alias("prefix"))
    rows = plan.join(texts, ["id", "h1", "h2"]).join(prefix, ["id", "h1", "h2"])
    # Of equal rows all but one are followed by their equal.
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, n_chars - half)"), F.when(F.col("nth") == 1, F.col("prefix")).otherwise(F.expr("left(text, half)"))))
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "fingerprint", "n_print", "nth", "text", F.sha2(F.col("edited"), 256).alias("edited_sha256"), canonical(F.col("edited")).alias("c_edited"))
    rows = rows.withColumn("edited_fingerprint", wide_hash(F.col("c_edited")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        F.when(F.substring("fingerprint", 1, 32) == F.col("edited_fingerprint"), likeness(F.lit(1), F.lit(1), canonical(F.col("text")), F.col("c_edited"))).otherwise(F.lit(0.0)).alias("near_edited"),
        F.when((F.col("nth") > 1) | (F.col("fingerprint") == F.col("n_print")), F.lit(1.0)).otherwise(F.lit(0.0)).alias("near_next"),
    )
