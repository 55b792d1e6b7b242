"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.cap_filters import near_vectors
from tidemark.llm.common import table
from tidemark.llm.divergence import source_divergence
from tidemark.llm.fill_in_middle import fill_in_middle, restored_texts
from tidemark.llm.knn_quality import fit_neighbours, held_out, quality_scores
from tidemark.llm.mixing import mix_plan
from tidemark.llm.ngram_join import similar_documents
from tidemark.llm.piece_codec import piece_digests, read_model
from tidemark.llm.quality_rules import fit_rules, quality_verdicts
from tidemark.llm.secret_scan import secret_spans
from tidemark.llm.sharding import stratified_shards
from tidemark.llm.token_counts import piece_vocabulary, token_counts
from tidemark.llm.toxicity import fit_toxicity, held_out as toxicity_held_out, toxicity_scores
from tidemark.llm.url_filter import url_verdicts

#: Host labels (between dots and dashes) that put a host on the block list.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")
_LISTED = rf"(^|[.-])({'|'.join(LISTED_WORDS)})([.-]|$)"


PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: A score from here on is predicted as label 1.
QUALITY_THRESHOLD = TOXICITY_THRESHOLD = 0.3


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    return quality_verdicts(docs, rules).withColumnRenamed("id", "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), read_model(PIECE_MODEL)).withColumnRenamed("id", "doc_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_neighbours(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return (plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial, continuing = piece_vocabulary(PIECE_MODEL)
    return token_counts(table(spark, sf_dir, "documents"), initial, continuing).withColumnRenamed("id", "doc_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = stratified_shards(table(spark, sf_dir, "documents"))
    return shards.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def listed_host(host: Column) -> Column:
    return host.rlike(_LISTED)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = url_verdicts(table(spark, sf_dir, "pages"), listed_host)
    return verdicts.withColumnRenamed("id", "page_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity_scores(docs, model).select(
        F.col("id").alias("doc_id"), toxicity_held_out("id").alias("held_out"), "score",
        (F.col("score") >= TOXICITY_THRESHOLD).cast("int").alias("predicted"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored_texts(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_piece_codec": op2_piece_codec,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_neighbours": op4_quality_neighbours,
    "op5_cap_filters": op5_cap_filters,
    "op6_mixing": op6_mixing,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_ngram_join": op9_ngram_join,
    "op10_url_filters": op10_url_filters,
    "op11_source_divergence": op11_source_divergence,
    "op12_toxicity": op12_toxicity,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL = {
    "op6_mixing": r"""
        WITH rows AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                md5(concat('42', coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '~'),
                    coalesce(length(source) || ':' || source, '~'), coalesce(md5(text), '~'))) AS k
            FROM documents),
        sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
            FROM rows GROUP BY source),
        ordered AS (
            SELECT *, 2 * source_size / weight AS ratio,
                coalesce(sum(2 * source_size) OVER before, 0) AS capped,
                sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest,
                sum(source_size) OVER () AS total
            FROM sources
            WINDOW before AS (ORDER BY 2 * source_size / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (
            SELECT *, (1.5::DOUBLE * total::DOUBLE - capped::DOUBLE) / rest::DOUBLE AS level FROM ordered),
        targets AS (
            SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce(
                (SELECT min_by(level, ratio) FROM levels WHERE ratio >= level) * weight,
                2.0::DOUBLE * source_size))::DOUBLE AS target
            FROM levels),
        placed AS (
            SELECT rows.*, source_size, target,
                coalesce(sum(size) OVER (PARTITION BY rows.source ORDER BY k, doc_id, size
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
            FROM rows JOIN targets ON rows.source IS NOT DISTINCT FROM targets.source)
        SELECT doc_id, size::BIGINT AS size, source_size, target,
            (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - start)))::BIGINT AS taken
        FROM placed""",
    "op8_sharding": r"""
        WITH bits AS MATERIALIZED (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)),
                lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS of_byte),
        bytes AS (
            SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                lambda h: CAST('0x' || h AS BIGINT)) AS bytes
            FROM documents),
        rows AS (
            SELECT doc_id, coalesce('=' || source, '~') AS source_key, 1 + len(bytes) AS size,
                xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
                    lambda c, b: xor(c >> 8, of_byte[xor(c, b) % 256 + 1]))) AS text_crc32,
                CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' ||
                    coalesce(md5(text), '~')), 1, 15) AS BIGINT) AS key
            FROM bytes, bits),
        placed AS (
            SELECT *, (row_number() OVER (PARTITION BY source_key ORDER BY key, doc_id NULLS FIRST, size, text_crc32) - 1
                + CAST('0x' || substr(md5('42:' || source_key), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496::DOUBLE)
                / (count(*) OVER (PARTITION BY source_key))::DOUBLE AS place
            FROM rows),
        ordered AS (
            SELECT *, count(*) OVER () AS total, row_number() OVER (
                ORDER BY place, source_key, key, doc_id NULLS FIRST, size, text_crc32) - 1 AS position
            FROM placed)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
            (position * 8 // total)::INT AS shard,
            (position - ((position * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard
        FROM ordered""",
    "op9_ngram_join": r"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        sets AS MATERIALIZED (
            SELECT r, doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5
                THEN [array_to_string(words, ' ')]
                ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS grams
            FROM docs),
        grams AS MATERIALIZED (SELECT r, len(grams) AS n, unnest(grams) AS gram FROM sets),
        links AS MATERIALIZED (
            SELECT a.r AS a, b.r AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.r <> b.r
            GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        reached AS (
            SELECT r, r AS other FROM sets
            UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.other)
        SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
        FROM sets s JOIN reached ON reached.r = s.r JOIN sets o ON o.r = reached.other
        GROUP BY s.r, s.doc_id, s.grams""",
    "op10_url_filters": rf"""
        WITH parts AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        split AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS authority, rest FROM parts),
        parsed AS (
            SELECT page_id, translate(authority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*') AS path
            FROM split),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/')
                    THEN 'www.example.com/en/'
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/')
                    THEN 'example.com/en/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
                WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule
            FROM parsed)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '{_LISTED}') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op11_source_divergence": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        kept AS (
            SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs)
            GROUP BY lang, term HAVING count(*) >= 30),
        counted AS (
            SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs)
            SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        grid AS (
            SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n,
                coalesce(sum(n) OVER (PARTITION BY lang, source), 0)::HUGEINT AS group_n,
                coalesce(sum(n) OVER (PARTITION BY lang), 0)::HUGEINT AS lang_n,
                coalesce(sum(n) OVER (PARTITION BY lang, term), 0)::HUGEINT AS term_n,
                (SELECT count(*) FROM kept k WHERE k.lang = groups.lang)::HUGEINT AS v
            FROM groups JOIN kept USING (lang) LEFT JOIN counted USING (lang, source, term)),
        shares AS (
            SELECT *, 1 + 1000000000::HUGEINT * (n + 5) // (group_n + 5 * v) AS p,
                1 + 1000000000::HUGEINT * (term_n + 5) // (lang_n + 5 * v) AS q
            FROM grid),
        differences AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN differences d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
        WHERE part = 'pair' OR rank <= 50""",
    "op13_fill_in_middle": r"""
        WITH rows AS (
            SELECT doc_id, coalesce(text, '') AS text,
                sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
        drawn AS (
            SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
                [CAST('0x' || substr(digest, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM rows),
        cut AS (
            SELECT *, len(lines) AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS first,
                greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS second,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                    OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn),
        parts AS (
            SELECT *, array_to_string(list_slice(lines, 1, first), '') AS prefix,
                array_to_string(list_slice(lines, first + 1, second), '') AS middle,
                array_to_string(list_slice(lines, second + 1, n), '') AS suffix
            FROM cut)
        SELECT doc_id, n::BIGINT AS n, form,
            CASE WHEN form <> 'plain' THEN len(prefix) END::BIGINT AS prefix_chars,
            CASE WHEN form <> 'plain' THEN len(middle) END::BIGINT AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM parts""",
}
