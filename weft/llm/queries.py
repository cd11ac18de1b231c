"""The registered queries of this subpackage and their SQL: thin wrappers that derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.llm.common import bounded_batches, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.minhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.katz import score

    return score(spark, table(spark, sf_dir, "documents"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.quality import co_train, score_views

    model, views = co_train(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_views(views, model)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.secret_scan import corpus_identifiers, scan_secrets

    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, identifiers=corpus_identifiers(docs)).drop("clean_text")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.pii import find_pii

    return find_pii(spark, table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), _tokenizer(WORD_BPE))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.common import Scratch
    from weft.llm.warc import archive_rows, plan_records, write_archive

    path = Scratch(spark, "warc").path("archive")
    write_archive(plan_records(table(spark, sf_dir, "pages")), path)
    return archive_rows(spark, path)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.fingerprint import fingerprints

    return fingerprints(spark, table(spark, sf_dir, "documents"))


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.bpe import encode_documents

    bounded_batches(spark)
    return encode_documents(table(spark, sf_dir, "documents"), _tokenizer(BYTE_BPE), keep_ids=False).drop("ids")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.llm.media import media_columns

    return media_columns(spark, table(spark, sf_dir, "documents")).drop("media")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_katz": op2_katz,
    "op3_cotraining": op3_cotraining,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii": op5_pii,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_fingerprint": op8_fingerprint,
    "op9_bpe_automaton": op9_bpe_automaton,
    "op10_media_columns": op10_media_columns,
    "pipeline": pipeline,
}

_UPPER, _BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: DuckDB SQL of what SQL can say: exact links by counting shared shingles, and what archives say of pages. The other operators rest on
#: models, tokenizers, compressors or Unicode forms that SQL lacks; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^ 	-]+') AS words FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' '))) END AS shingles FROM w),
    x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
    linked AS (SELECT a, b FROM shared JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 85 * (len(sa.shingles) + len(sb.shingles) - n)),
    edge AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
    reach(doc_id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.far),
    least AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id)
    SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least USING (doc_id)""",
    "op7_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hexed, min(page_id) OVER (PARTITION BY html) AS first FROM p),
    f AS (SELECT *, list_transform(range(0, 8), lambda k: CAST(concat('0x', substr(hexed, CAST(5 * k + 1 AS BIGINT), 5)) AS INTEGER)) AS fives FROM d)
    SELECT page_id, payload_bytes, array_to_string(list_transform(fives, lambda v: concat({", ".join(f"substr('{_BASE32}', ((v >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))})), '') AS payload_digest,
    CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f""",
}
