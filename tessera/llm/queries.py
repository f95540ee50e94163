"""The queries opN_<name> of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lines, lm, media, mixing, packing, quality, simhash, toxicity, urls
from .common import crc32_mod, materialize, read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.round("__target", 6).alias("target"), F.col("__taken").alias("taken"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 5) == 0
    model = toxicity.train(read(spark, sf_dir, "labels").where(~held_out), docs)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.media_columns(read(spark, sf_dir, "documents")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target are all documents labelled as of good quality, the background all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # written, so that its size is known: it is broadcast if that is within Spark's bound
    good = materialize(read(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct())
    found = lm.score(docs.join(good, "doc_id", "left"), F.col("good"))
    return found.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_filter(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_media": op3_media,
    "op4_lines": op4_lines,
    "op5_urls": op5_urls,
    "op6_simhash": op6_simhash,
    "op7_packing": op7_packing,
    "op8_lm": op8_lm,
    "op9_quality": op9_quality,
    "op10_langid": op10_langid,
}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SEPARATOR = r"[^0-9a-z\x{80}-\x{10FFFF}]"


def _pattern_sql(pattern: str) -> str:
    """A pattern rule as a regular expression of DuckDB."""
    parts = {"*": ".*", "^": f"(?:{_SEPARATOR}|\\A|\\z)", ".": "[.]"}
    begin, end = pattern.startswith("|"), pattern.endswith("|")
    return "\\A" * begin + "".join(parts.get(c, c) for c in pattern[begin : len(pattern) - end]) + "\\z" * end


#: The longest pattern that fits says what happens.
_PATTERNS = "\n            ".join(f"WHEN regexp_matches(whole, '{_pattern_sql(r.name)}', 's') THEN '{r.action}'" for r in sorted(urls.PATTERN_RULES, key=lambda r: (-len(r.name), r.name)))
_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"

ORACLE_SQL = {
    "op1_mixing": """
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(1) || coalesce(text, chr(0))), 1, 15))::BIGINT AS key
            FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
            FROM sized GROUP BY source),
        shared(round, source, source_size, weight, target, changed) AS (
            SELECT 0, source, source_size, weight, NULL::DOUBLE, true FROM sources
            UNION ALL
            SELECT round + 1, source, source_size, weight,
                CASE WHEN target IS NOT NULL THEN target WHEN part >= 2.0 * source_size THEN 2.0 * source_size END,
                bool_or(target IS NULL AND part >= 2.0 * source_size) OVER ()
            FROM (
                SELECT *, weight * (1.5 * sum(source_size) OVER () - coalesce(sum(target) OVER (), 0))
                    / sum(CASE WHEN target IS NULL THEN weight END) OVER () AS part
                FROM shared WHERE changed)),
        ended AS (SELECT * FROM shared WHERE round = (SELECT max(round) FROM shared)),
        targets AS (
            SELECT source, source_size, coalesce(target, weight * (1.5 * sum(source_size) OVER () - coalesce(sum(target) OVER (), 0))
                / sum(CASE WHEN target IS NULL THEN weight END) OVER ()) AS target
            FROM ended),
        placed AS (
            SELECT s.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
                sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS ahead
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target,
            (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
                + least(greatest(budget % source_size - ahead, 0), size) END)::BIGINT AS taken
        FROM placed""",
    "op5_urls": f"""
        WITH parts AS (
            SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), {_LETTERS}) AS host,
                regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE
                WHEN {_FITS.format('example.com', '/en/7')} THEN 'example.com/en/7'
                WHEN {_FITS.format('example.net', '/de/8')} THEN 'example.net/de/8'
                WHEN {_FITS.format('com', '/en/')} THEN 'com/en/'
                WHEN {_FITS.format('net', '/de/')} THEN 'net/de/'
                WHEN {_FITS.format('org', '/es/')} THEN 'org/es/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            {_PATTERNS}
            ELSE 'allow' END AS verdict
        FROM (SELECT *, translate(host || path, {_LETTERS}) AS whole FROM ruled)""",
}
