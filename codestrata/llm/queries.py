"""Queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from codestrata.llm import credentials, format_duplicates, generated, languages, mixing, scans, source_syntax, tokenization
from codestrata.session import load


def p2_found(spark, sf):
    return source_syntax.invalid_files(load(spark, sf, "file_records"), load(spark, sf, "ext_languages"))


def p2_parse_rates(spark, sf):
    return source_syntax.parse_rates(load(spark, sf, "file_records"), load(spark, sf, "fn_defs"), load(spark, sf, "ext_languages"))


def p3_found(spark, sf):
    return format_duplicates.entity_copies(load(spark, sf, "kg_entities"))


def p3_unique_entities(spark, sf):
    return format_duplicates.unique_entities(load(spark, sf, "kg_entities"))


def p5_found(spark, sf):
    return generated.not_handwritten(load(spark, sf, "file_records")).select("repo_id", "path")


def p5_not_handwritten(spark, sf):
    return generated.not_handwritten(load(spark, sf, "file_records"))


def _scans(spark, sf):
    return scans.repaired_chunks(load(spark, sf, "kg_chunks"), load(spark, sf, "kg_docs"))


def p6_found(spark, sf):
    return _scans(spark, sf).select("id", F.explode("noise").alias("noise"))


def p6_repaired(spark, sf):
    return _scans(spark, sf)


def _credentials(spark, sf):
    return credentials.verified(load(spark, sf, "file_records"), load(spark, sf, "fn_defs"))


def p7_found(spark, sf):
    c = _credentials(spark, sf).select("source_table", "row_id", F.explode("found").alias("f"))
    return c.select("source_table", "row_id", "f.line_no").dropDuplicates()


def p7_redacted(spark, sf):
    return _credentials(spark, sf).select("source_table", "row_id", F.size("found").alias("n_credentials"), F.array_sort(F.array_distinct("found.rule")).alias("rules"), "redacted")


def p8_ids(spark, sf):
    return tokenization.encode_column(load(spark, sf, "documents"), "doc_id", "text")


def p8_round_trip(spark, sf):
    """Documents whose ids do not decode to their text: none."""
    d = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = tokenization.decode_column(tokenization.encode_column(d, "doc_id", "text"), "doc_id").withColumnRenamed("text", "back")
    return d.join(back, "doc_id").where(F.col("text") != F.col("back")).select("doc_id")


def p9_mix(spark, sf):
    return mixing.mixed_documents(load(spark, sf, "documents"), load(spark, sf, "mix_targets"))


def p9_shares(spark, sf):
    return mixing.reached_shares(load(spark, sf, "documents"), load(spark, sf, "mix_targets"))


def _languages(spark, sf):
    return languages.document_languages(load(spark, sf, "documents"), load(spark, sf, "lang_codes"))


def p10_found(spark, sf):
    return languages.language_findings(_languages(spark, sf))


def p10_languages(spark, sf):
    return _languages(spark, sf)


QUERIES = {f.__name__: f for f in (p2_found, p2_parse_rates, p3_found, p3_unique_entities, p5_found, p5_not_handwritten, p6_found, p6_repaired, p7_found, p7_redacted, p8_ids, p8_round_trip, p9_mix, p9_shares, p10_found, p10_languages)}

_P3 = r"""
WITH n AS (SELECT id, coalesce('v' || lower(regexp_replace(name, '[^\p{L}\p{N}]+', '', 'g')), 'n') a, coalesce('v' || lower(regexp_replace(type, '[^\p{L}\p{N}]+', '', 'g')), 'n') b, mentions,
  coalesce('v' || array_to_string(list_sort(list_transform(list_filter(string_split(attrs, ';'), lambda p: length(regexp_replace(p, '[^\p{L}\p{N}]+', '', 'g')) > 0),
    lambda p: lower(regexp_replace(split_part(p, '=', 1), '[^\p{L}\p{N}]+', '', 'g')) || '=' || lower(regexp_replace(regexp_replace(p, '^[^=]*=?', ''), '[^\p{L}\p{N}]+', '', 'g')))), ';'), 'n') c FROM kg_entities),
g AS (SELECT a, b, mentions, c, min(id) keep_id, count(*) n_rows, count(DISTINCT id) n_ids FROM n GROUP BY ALL)
"""
SQL = {
    "p3_found": _P3 + "SELECT DISTINCT keep_id, id FROM n JOIN g ON n.a = g.a AND n.b = g.b AND n.c = g.c AND n.mentions IS NOT DISTINCT FROM g.mentions WHERE id <> keep_id",
    "p3_unique_entities": _P3 + "SELECT keep_id, CAST(n_rows AS BIGINT) n_rows, n_ids FROM g",
    "p8_round_trip": "SELECT doc_id FROM documents WHERE false",
}
