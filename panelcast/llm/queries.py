"""Registered queries of the operators for training data, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import (
    bpe,
    chat,
    decontaminate,
    html_extract,
    jaccard_join,
    language,
    lexical,
    licenses,
    manifest,
    paragraph_dedup,
    quality,
    suffix_dedup,
    toxicity,
)
from panelcast.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(read_table(spark, folder, "conversations"))


def bpe_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(read_table(spark, folder, "documents"), tokenizer_path(), digests=True)


def quality_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read_table(spark, folder, "documents"))


def language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    model = language.train(language.training_rows(docs))
    rows = language.identify(docs.select("doc_id", "text"), model)
    return rows.select(
        "doc_id",
        F.coalesce(language.held_out(), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        F.array_join("langs", ",").alias("langs"),
    )


def spaced_seed_leaks(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    return decontaminate.contaminated(docs, benchmark).drop("row")


def license_diagonals(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, folder, "documents"))[0]


def suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    rows = suffix_dedup.remove_repeats(docs)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(read_table(spark, folder, "documents"))[0]


def paragraph_repeats(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    rows = paragraph_dedup.remove_similar(docs)
    return rows.select(
        "doc_id", "n_paragraphs", "n_removed", "n_removed_words", F.sha2("kept", 256).alias("kept_sha256")
    )


def wrapper_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.main_text(read_table(spark, folder, "pages"))


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.manifest(read_table(spark, folder, "documents"))


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def toxicity_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = toxicity.score_texts(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))
    return rows.select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Query] = {
    "op1_suffix_repeats": suffix_repeats,
    "op2_chat_rotation": chat_rotation,
    "op3_bpe_tokens": bpe_tokens,
    "op4_jaccard_components": jaccard_components,
    "op5_wrapper_text": wrapper_text,
    "op6_quality_outliers": quality_outliers,
    "op7_paragraph_repeats": paragraph_repeats,
    "op8_language_mixture": language_mixture,
    "op9_spaced_seed_leaks": spaced_seed_leaks,
    "op10_license_diagonals": license_diagonals,
    "op11_merkle_versions": merkle_manifest,
    "op12_automaton_search": lexical_search,
    "op13_toxicity_neighbours": toxicity_neighbours,
}

ORACLES: dict[str, str] = {
    "op2_chat_rotation": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
                replace(replace(coalesce(text, ''), '<|', '<\\|'), '|>', '|\\>') AS text,
                CAST(floor(turn / 64) AS BIGINT) AS part
            FROM conversations
        ), speakers AS (
            SELECT DISTINCT conv_id, role AS speaker FROM turns
        ), said AS (
            SELECT t.*, s.speaker, t.role = s.speaker AS mine,
                CASE WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10)
                    ELSE '<|user name=' || replace(replace(t.role, '<|', '<\\|'), '|>', '|\\>') || '|>' || chr(10) END AS head
            FROM turns t JOIN speakers s USING (conv_id)
        ), placed AS (
            SELECT *, sum(length(head) + length(text) + 1) OVER (
                PARTITION BY conv_id, speaker, part ORDER BY turn, role, text
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW
            ) - length(head) - length(text) - 1 AS begins
            FROM said
        ), parts AS (
            SELECT conv_id, speaker, part, count(*) AS n_turns,
                string_agg(head || text || chr(10), '' ORDER BY turn, role, text) AS rendered,
                coalesce(string_agg(
                    CAST(CAST(begins AS BIGINT) + length(head) AS VARCHAR) || '-'
                        || CAST(CAST(begins AS BIGINT) + length(head) + length(text) AS VARCHAR), ','
                    ORDER BY turn, role, text
                ) FILTER (WHERE mine), '') AS mask,
                CAST(coalesce(sum(length(text)) FILTER (WHERE mine), 0) AS BIGINT) AS n_masked
            FROM placed GROUP BY ALL
        )
        SELECT conv_id, speaker, part, n_turns,
            CAST(coalesce(sum(length(rendered)) OVER (
                PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
            ), 0) AS BIGINT) AS starts_at, rendered, mask, n_masked
        FROM parts
    """,
    "op11_merkle_versions": """
        WITH RECURSIVE fields AS (
            SELECT row_number() OVER (ORDER BY doc_id, source, text, lang, n_chars) AS id, doc_id, source, text,
                coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
                    || coalesce(octet_length(encode(source)) || ':' || source, '-')
                    || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
                    || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
            FROM documents
        ), marked AS (
            SELECT *, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
                string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]
            ))), lambda crc, s: CASE WHEN s >= 0 THEN xor(crc, s)
                ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END) END)) % 2 = 0, false) AS changed FROM fields
        ), hashed AS (
            SELECT id, doc_id, source,
                sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                CASE WHEN changed THEN sha256(head || coalesce(
                    octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) END AS other
            FROM marked
        ), placed AS (
            SELECT *, row_number() OVER (
                PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf
            ) - 1 AS pos FROM hashed
        ), inside(source, level, pos, digest, n) AS (
            SELECT source, 0, pos, leaf, count(*) OVER (PARTITION BY source) FROM placed
            UNION ALL
            SELECT DISTINCT source, level + 1, pos // 3,
                sha256(string_agg(digest, '' ORDER BY pos) OVER run), (n + 2) // 3
            FROM inside WHERE n > 1
            WINDOW run AS (PARTITION BY source, pos // 3)
        ), subroots AS (
            SELECT source, digest AS subroot,
                row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
            FROM inside WHERE n = 1
        ), above(level, pos, digest, n) AS (
            SELECT 0, pos, subroot, count(*) OVER () FROM subroots
            UNION ALL
            SELECT DISTINCT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos) OVER run), (n + 2) // 3
            FROM above WHERE n > 1
            WINDOW run AS (PARTITION BY pos // 3)
        ), below(id, source, level, pos, folded, siblings) AS (
            SELECT id, source, 0, pos, coalesce(other, leaf), '' FROM placed
            UNION ALL
            SELECT b.id, b.source, b.level + 1, b.pos // 3,
                sha256(string_agg(CASE WHEN i.pos = b.pos THEN b.folded ELSE i.digest END, '' ORDER BY i.pos)),
                any_value(b.siblings) || coalesce(string_agg(i.digest, '' ORDER BY i.pos) FILTER (WHERE i.pos <> b.pos), '')
            FROM below b JOIN inside i
                ON i.source IS NOT DISTINCT FROM b.source AND i.level = b.level AND i.n > 1 AND i.pos // 3 = b.pos // 3
            GROUP BY b.id, b.source, b.level, b.pos
        ), led AS (
            SELECT b.id, s.pos, b.folded, b.siblings, s.subroot
            FROM (SELECT *, max(level) OVER (PARTITION BY id) AS top FROM below) b
            JOIN subroots s ON s.source IS NOT DISTINCT FROM b.source
            WHERE b.level = b.top
        ), upper(id, level, pos, folded, siblings) AS (
            SELECT id, 0, pos, folded, siblings FROM led
            UNION ALL
            SELECT u.id, u.level + 1, u.pos // 3,
                sha256(string_agg(CASE WHEN a.pos = u.pos THEN u.folded ELSE a.digest END, '' ORDER BY a.pos)),
                any_value(u.siblings) || coalesce(string_agg(a.digest, '' ORDER BY a.pos) FILTER (WHERE a.pos <> u.pos), '')
            FROM upper u JOIN above a ON a.level = u.level AND a.n > 1 AND a.pos // 3 = u.pos // 3
            GROUP BY u.id, u.level, u.pos
        ), ended AS (
            SELECT *, max(level) OVER (PARTITION BY id) AS top FROM upper
        )
        SELECT p.doc_id, p.leaf, l.subroot, r.digest AS root, sha256(e.siblings) AS proof_sha256,
            e.folded AS folded_root, e.folded = r.digest AS verified
        FROM placed p JOIN led l USING (id) JOIN ended e USING (id), (SELECT digest FROM above WHERE n = 1) r
        WHERE e.level = e.top
    """,
    "op12_automaton_search": """
        WITH terms AS (
            SELECT doc, doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS doc, doc_id, text FROM documents)
        ), asked AS (
            SELECT DISTINCT item, item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
        ), sizes AS (
            SELECT doc, count(*) AS n FROM terms GROUP BY doc
        ), corpus AS (
            SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS length FROM sizes
        ), counted AS (
            SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY doc, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * total + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counted, corpus GROUP BY term, total
        ), worth AS (
            SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * total) // length))) AS points
            FROM counted JOIN sizes USING (doc) JOIN weights USING (term), corpus
        ), scores AS (
            SELECT item, any_value(item_id) AS item_id, doc, any_value(doc_id) AS doc_id, CAST(sum(points) AS BIGINT) AS score
            FROM asked JOIN worth USING (term) GROUP BY item, doc
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
