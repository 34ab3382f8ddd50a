"""Native offsets and rewritten patterns against Python's own ``re``."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilscan.functions import patterns
from veilscan.functions.regex import java, strip, words
from veilscan.functions.spans import context_window, find_spans

_ATOMS = [
    *"0123456789", *"0123456789", " ", " ", "\n", "-", ".", ",", ";", "/", "(", ")", "+7", "8", "800", "№", "@", "_", "\t", "\r",
    "\x1d", " ", " ", "\u0085", "é", "é", "😀", "٣", "1988", "17.11.1988", "05/1/2001", "4111 1111 1111 1111",
    "паспорт ", "серии 1", "серия ", "Иванов Иван Иванович", "И. И. Иванов", "Петров П.С.", "СНИЛС ", "инн", "ИНН ", "водительск",
    "ву", "driver", "карта", "visa", "мир ", "р/с", "счет", "счёт ", "бик", "БИК ", "огрн", "cvv", "CVC2", "cvv2", "код безопасности",
    "д.р.", "г. рождения", "dob", "место рождения: Москва", "м.р. ", "г. Москва", "ул. Ленина, д. 5, кв. 7", "село Ёлки",
    "отпечатки пальцев", "диагноз", "МКБ10", "вич", "православные", "католик", "член партии", "этническое происхождение",
    "info@a.ru", "ivan.petrov@Mail.Example.com", "e-mail", "почта", "адрес", "тел.", "phone", "имя", "фамилия", "[[PII_DIRECT:email:a@b.ru]]",
    "[[PII_DIRECT:", "]]", "ſ", "K", "İ", "ß", "ᲀ",
]


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(_ATOMS, k=rng.randint(1, 25))) for _ in range(n)] + ["", " "]


_ALL = (
    {f"detect_{k}": v for k, v in patterns.DETECT.items()}
    | {f"near_{k}": (v, True) for k, v in patterns.NEAR.items()}
    | {f"boost_{k}": (v, True) for k, v in patterns.BOOST.items()}
    | {f"column_{k}": (v, True) for k, v in patterns.COLUMN_CATEGORY.items()}
    | {f"profile_{k}": (v, True) for k, v in patterns.PROFILE_COLUMN.items()}
    | {f"name_{k}": (v, True) for k, v in patterns.SUSPICIOUS_NAME.items()}
)


def test_spans_equal_re(spark):
    texts = _texts(1500, 7)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8).cache()
    names = list(_ALL)
    for at in range(0, len(names), 12):
        some = names[at : at + 12]
        got = rows.select("i", *[find_spans(F.col("text"), java(*_ALL[n]), side=9).alias(n) for n in some]).collect()
        for n in some:
            pattern, ignore_case = _ALL[n]
            compiled = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
            for r in got:
                text = texts[r["i"]]
                expected = [
                    (m.group(0), m.start(), m.end(), text[max(0, m.start() - 9) : m.start()], text[m.end() : m.end() + 9])
                    for m in compiled.finditer(text)
                ]
                assert [tuple(s) for s in r[n]] == expected, (n, text)


def test_many_matches_stay_exact(spark):
    text = "".join(f"a{i}😀" for i in range(3000))
    row = spark.createDataFrame([(text,)], "text string")
    got = row.select(find_spans(F.col("text"), "[0-9]+", side=3).alias("s")).first()["s"]
    expected = [(m.group(0), m.start(), m.end()) for m in re.finditer("[0-9]+", text)]
    assert [(s["value"], s["start"], s["end"]) for s in got] == expected


def test_windows(spark):
    text = "абв😀где"
    rows = spark.createDataFrame([(0, 1), (3, 4), (6, 7)], "s int, e int")
    got = rows.select(context_window(F.lit(text), F.col("s"), F.col("e"), 2)).collect()
    assert [r[0] for r in got] == [text[max(0, s - 2) : e + 2] for s, e in ((0, 1), (3, 4), (6, 7))]


@pytest.mark.parametrize("value", [" a b ", " x ", "\x1c y\x85", "", "  ", "a\n b\tc"])
def test_strip_and_words(spark, value):
    row = spark.createDataFrame([(value,)], "v string").select(strip(F.col("v")).alias("s"), words(F.col("v")).alias("w")).first()
    assert row["s"] == value.strip()
    assert row["w"] == value.split()
