import random

import pytest
from pyspark.sql import functions as F

from veilscan.functions import checksums as check

CASES = [
    ("luhn", "4111 1111 1111 1111", True),
    ("luhn", "5500 0000 0000 0004", True),
    ("luhn", "3400 0000 0000 009", True),
    ("luhn", "4111 1111 1111 1112", False),
    ("luhn", "4111111", False),
    ("snils", "112-233-445 95", True),
    ("snils", "11223344595", True),
    ("snils", "112-233-445 96", False),
    ("snils", "11223344", False),
    ("inn", "7707083893", True),
    ("inn", "500100732259", True),
    ("inn", "1234567890", False),
    ("inn", "123456789012", False),
    ("inn", "123", False),
    ("inn", "", False),
    ("bik", "044525225", True),
    ("bik", "12345", False),
    ("bik", "123456789", False),
    ("ogrn", "1027700132195", True),
    ("ogrn", "1027700132196", False),
    ("ogrn", "123", False),
    ("mrz_line", "P<RUSIVANOV<<IVAN<<<<<<<<<<<<<<<<<<<<<<<<<<<", True),
    ("mrz_line", "Hello world this is normal text", False),
    # digits of another script count as digits, except for the Luhn sum and the bank code
    ("snils", "١١٢-٢٣٣-٤٤٥ ٩٥", True),
    ("inn", "٧٧٠٧٠٨٣٨٩٣", True),
    ("bik", "٠٤٤٥٢٥٢٢٥", False),
]
CHECKS = {
    "luhn": check.luhn_check,
    "snils": check.snils_check,
    "inn": check.inn_check,
    "bik": check.bik_check,
    "ogrn": check.ogrn_check,
    "mrz_line": check.is_mrz_line,
}


@pytest.mark.parametrize("kind", CHECKS)
def test_known_numbers(spark, kind):
    cases = [(v, e) for k, v, e in CASES if k == kind]
    rows = spark.createDataFrame(cases, "value string, expected boolean")
    got = rows.select("value", "expected", CHECKS[kind](F.col("value")).alias("valid")).collect()
    assert [(r["value"], r["valid"]) for r in got] == cases


def test_account_fits_only_its_bank(spark):
    rng = random.Random(5)

    def fits(account, bik):
        joined = bik[-3:] + account
        return sum(int(c) * (7, 1, 3)[i % 3] for i, c in enumerate(joined)) % 10 == 0

    pairs = [
        ("".join(rng.choices("0123456789", k=20)), "04" + "".join(rng.choices("0123456789", k=7))) for _ in range(300)
    ]
    rows = spark.createDataFrame(pairs + [("123", "044525225"), ("1" * 20, "0445")], "a string, b string")
    got = rows.select("a", "b", check.account_check(F.col("a"), F.col("b")).alias("v")).collect()
    for r in got[:300]:
        assert r["v"] == fits(r["a"], r["b"])
    assert not got[300]["v"] and not got[301]["v"]


def test_mrz(spark):
    cases = [("520727", 3), ("AB2134<<<", 5), ("", 0), ("ab", -1), ("D23145890734", 9)]
    rows = spark.createDataFrame(cases, "s string, e int")
    got = rows.select("s", check.mrz_checkdigit(F.col("s")).cast("int").alias("d")).collect()
    assert [(r["s"], r["d"]) for r in got] == cases
    good = ["P<RUSIVANOV<<IVAN<<<<<<<<<<<<<<<<<<<<<<<<<<<", "1234567897RUS8001017M2501017<<<<<<<<<<<<<<00"]
    blocks = spark.createDataFrame([(good,), (good[:1],), ([*good, "no"],)], "lines array<string>")
    assert [r[0] for r in blocks.select(check.mrz_block_valid(F.col("lines"))).collect()] == [True, False, False]
