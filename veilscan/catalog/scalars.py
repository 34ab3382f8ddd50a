"""Check sums, masks and text functions over numbers, letters and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilscan.catalog import corpus, oracle, query
from veilscan.catalog.detection import document_chunks, letter_chunks, letters_source
from veilscan.functions import checksums as check
from veilscan.functions import text as txt
from veilscan.functions.masking import mask_value, sha256_hex
from veilscan.functions.regex import strip
from veilscan.operators import detect as det

_MRZ_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _register_check(name: str, column, sql: str, *inputs: str) -> None:
    listed = ", ".join(inputs)

    @query(f"val_{name}", f"SELECT doc_id, {listed}, {sql} AS valid FROM ({corpus.numbers_sql()})")
    def run(spark, sf_dir):
        rows = corpus.numbers(spark, sf_dir)
        return rows.select("doc_id", *inputs, column(*[F.col(c) for c in inputs]).alias("valid"))


_register_check("digits", check.digits, oracle.only_digits("card"), "card")
_register_check("luhn", check.luhn_check, oracle.luhn("card"), "card")
_register_check("snils", check.snils_check, oracle.snils("snils"), "snils")
_register_check("inn10", check.inn_check, oracle.inn("inn10"), "inn10")
_register_check("inn12", check.inn_check, oracle.inn("inn12"), "inn12")
_register_check("bik", check.bik_check, oracle.bik("bik"), "bik")
_register_check("account", check.account_check, oracle.account("account", "bik"), "account", "bik")
_register_check("ogrn13", check.ogrn_check, oracle.ogrn("ogrn13"), "ogrn13")
_register_check("ogrn15", check.ogrn_check, oracle.ogrn("ogrn15"), "ogrn15")
_register_check(
    "mrz_checkdigit",
    check.mrz_checkdigit,
    f"""CASE WHEN regexp_full_match(mrz_field, '[0-9A-Z<]*') THEN CAST(list_sum(list_transform(range(1, length(mrz_field) + 1), lambda i:
      (CASE WHEN substr(mrz_field, i, 1) = '<' THEN 0 ELSE instr('{_MRZ_ALPHABET}', substr(mrz_field, i, 1)) - 1 END)
      * (CASE (i - 1) % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END))) AS BIGINT) % 10 ELSE -1 END""",
    "mrz_field",
)
_MRZ_LINE = (
    "(length(trim({0})) IN (30, 36, 44) AND regexp_full_match(trim({0}), '[\\p{{L}}\\p{{N}}<]+') "
    "AND length({0}) - length(replace({0}, '<', '')) >= 3)"
)
_register_check("mrz_line", check.is_mrz_line, _MRZ_LINE.format("mrz_line"), "mrz_line")
_register_check(
    "mrz_block",
    lambda a, b: check.mrz_block_valid(F.array(a, b)),
    f"({_MRZ_LINE.format('mrz_line')} AND {_MRZ_LINE.format('mrz_field')})",
    "mrz_line",
    "mrz_field",
)


def _register_mask(category: str) -> None:
    """Mask every found value of a category, and every letter as if it were such a value."""
    sql = (
        oracle.spans(letters_source())
        + f"""SELECT value, {oracle.masked('value', "'" + category + "'")} AS masked, count(*) AS n
        FROM (SELECT value FROM spans WHERE category = '{category}' UNION ALL SELECT trim(text) FROM t) GROUP BY ALL"""
    )

    @query(f"mask_{category}", sql)
    def run(spark, sf_dir):
        letters = letter_chunks(spark, sf_dir)
        found = det.detect(letters).filter(F.col("category") == category).select("value")
        values = found.unionByName(letters.select(strip(F.col("text")).alias("value")))
        return values.groupBy("value", mask_value(F.col("value"), F.lit(category)).alias("masked")).agg(
            F.count(F.lit(1)).alias("n")
        )


for _category in (
    "phone", "email", "bank_card", "snils", "passport_rf", "inn_personal", "inn_legal", "bank_account", "bik", "cvv",
    "mrz", "driver_license", "fio", "address", "birth_date", "health",
):
    _register_mask(_category)


@query(
    "mask_hash_only",
    f"SELECT path, chunk_no, 'sha256:' || substr(sha256(trim(text)), 1, 12) AS masked FROM ({letters_source()})",
)
def mask_hash_only(spark, sf_dir):
    return letter_chunks(spark, sf_dir).select(
        "path", "chunk_no", mask_value(F.col("text"), F.lit("fio"), "hash_only").alias("masked")
    )


@query(
    "mask_full",
    """SELECT doc_id, repeat('*', least(length(regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')), 8)) AS masked FROM documents""",
)
def mask_full(spark, sf_dir):
    return document_chunks(spark, sf_dir).select(
        F.col("path").alias("doc_id"), mask_value(F.col("text"), F.lit("fio"), "full").alias("masked")
    )


@query("value_hash", f"SELECT path, chunk_no, sha256(trim(text)) AS value_hash FROM ({letters_source()})")
def value_hash(spark, sf_dir):
    return letter_chunks(spark, sf_dir).select("path", "chunk_no", sha256_hex(strip(F.col("text"))).alias("value_hash"))


@query("txt_length", "SELECT source, CAST(sum(length(text)) AS BIGINT) AS text_length FROM documents GROUP BY source")
def txt_length(spark, sf_dir):
    return corpus.documents(spark, sf_dir).groupBy("source").agg(F.sum(F.length("text")).alias("text_length"))


@query(
    "txt_collapse",
    "SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t ​ ]+', ' ', 'g'), ' \t\n\r\v\f ')) AS text_hash FROM documents",
)
def txt_collapse(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("doc_id", F.sha2(txt.collapse_whitespace(F.col("text")), 256).alias("text_hash"))


@query("txt_yo_to_ye", f"SELECT path, chunk_no, replace(replace(text, 'ё', 'е'), 'Ё', 'Е') AS text FROM ({letters_source()})")
def txt_yo_to_ye(spark, sf_dir):
    return letter_chunks(spark, sf_dir).select("path", "chunk_no", txt.lower_yo_to_ye(F.col("text")).alias("text"))


@query("txt_strip_diacritics", "SELECT doc_id, sha256(strip_accents(text)) AS text_hash FROM documents")
def txt_strip_diacritics(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("doc_id", F.sha2(txt.strip_diacritics(F.col("text")), 256).alias("text_hash"))
