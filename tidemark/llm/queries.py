"""The registered queries of this package and the SQL twins of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.alignment import alignment
from tidemark.llm.decontamination import contaminated
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.fertility import quality
from tidemark.llm.html_extract import extract
from tidemark.llm.language_id import fit, held_out, identify
from tidemark.llm.lexical_search import ranked
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.pii import KINDS, labelled_table, personal_data
from tidemark.llm.pii import fit as fit_field
from tidemark.llm.substring_dedup import without_repeats
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_files import stored_documents, write_token_files
from tidemark.session import shared_folder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _base_of(kind: str):
    return lambda s: s.base & (s.kind == kind)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_documents(spark, sf_dir), fit_field(labelled_table(spark)))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.base)
    counts = [F.size(F.filter("spans", _base_of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"
    return stored_documents(write_token_files(_documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = mix(_documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixture.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return quality(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_source_mixing": op6_source_mixing,
    "op7_language_id": op7_language_id,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_near_dedup": op10_near_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_quality_rules": op12_quality_rules,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_source_mixing": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS u FROM documents),
        s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
        s1 AS (SELECT *, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
        s2 AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS w,
                      coalesce(sum(source_size) OVER o, 0) AS full_before, coalesce(sum(weight) OVER o, 0) AS w_before
               FROM s1 WINDOW o AS (ORDER BY source_size / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s3 AS (SELECT *, 3 * total - 4 * full_before AS num, w - w_before AS lft FROM s2),
        s4 AS (SELECT *, weight * num >= 4 * source_size * lft AS above FROM s3),
        lv AS (SELECT arg_max(num, lft) AS num, max(lft) AS lft FROM s4 WHERE NOT above),
        s AS (SELECT s4.source, s4.source_size, CASE WHEN s4.above OR lv.num IS NULL THEN (2 * s4.source_size)::DOUBLE
                     ELSE (s4.weight * lv.num)::DOUBLE / (2 * lv.lft)::DOUBLE END AS target FROM s4, lv),
        p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS passes FROM s),
        r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, round(p.target)::BIGINT - p.passes * p.source_size AS part,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
              FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               (size * (passes + CASE WHEN 2 * bef + size <= 2 * part THEN 1 ELSE 0 END))::BIGINT AS taken FROM r""",
    "op13_lexical_search": r"""
        WITH d AS (
          SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        k AS (SELECT count(*)::BIGINT AS nd, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
        i AS (
          SELECT item_id, row_number() OVER () AS q, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
        it AS (SELECT item_id, q, unnest(terms) AS term FROM i),
        f AS (SELECT doc_id, r, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
        tf AS (SELECT doc_id, r, n, term, count(*)::BIGINT AS tf FROM f WHERE term IN (SELECT term FROM it) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * max(k.nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, k GROUP BY term),
        s AS (SELECT it.item_id, it.q, tf.doc_id, tf.r,
                     sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * tf.n * k.nd) // k.l))))::BIGINT AS score
              FROM it JOIN tf USING (term) JOIN w USING (term), k GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10""",
}
