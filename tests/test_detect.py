import random

from pyspark.sql import functions as F

from veilscan.functions.checksums import MRZ_LENGTHS
from veilscan.operators.detect import detect, first_of_equal, with_spans
from veilscan.operators.entities import entity_spans, new_entities, slices, wants_entities
from veilscan.schema import SPANS

LETTER = (
    "Заявитель: Лебедева Ольга Викторовна\nдата рождения 03.04.1979\nдокумент: паспорт 63 08 № 574120\n"
    "звонить вечером на +7 927 301-55-46 или писать на lebedeva@post.test\nналоговый номер (ИНН) 631204857136"
)
# text, detector, category, count
CASES = [
    ("копию шлите на olga.l@pochta.test и buh7@pochta.test", "email", "email", 2),
    ("общий ящик info@pochta.test", "email", "email", 0),
    ("моб. +7 927 301-55-46, звоните", "phone", "phone", 1),
    ("факс 8(846)301-55-46", "phone", "phone", 1),
    ("бесплатно 8 800 301 55 46", "phone", "phone", 0),
    ("предъявлен паспорт серии 63 08 № 574120", "passport", "passport_rf", 1),
    ("на складе 6308 574120 деталей", "passport", "passport_rf", 0),
    ("страховой номер (СНИЛС) 148-307-265 65", "snils", "snils", 1),
    ("поставщик, ИНН 6312048577", "inn", "inn_legal", 1),
    ("оплата картой 4276 0123 4567 8902 прошла", "bank_card", "bank_card", 1),
    ("счётчик 4276 0123 4567 8903 заменён", "bank_card", "bank_card", 0),
    ("реквизиты: БИК 043601607", "bik", "bik", 1),
    ("на обороте CVV 482", "cvv", "cvv", 1),
    ("cvv cvc 482", "cvv", "cvv", 1),
    ("доверяю Лебедева Ольга Викторовна получить груз", "fio", "fio", 1),
    ("дата рождения 03.04.1979 указана верно", "birth_date", "birth_date", 1),
    ("накладная от 03.04.1979", "birth_date", "birth_date", 0),
    ("сняты отпечатки пальцев для пропуска", "biometric", "biometric", 1),
    ("в карточке записан диагноз", "health", "health", 1),
    ("адрес: 443001 Самара", "postal", "address", 1),
    ("", "email", "email", 0),
]


def test_sentences(spark):
    for name in {c[1] for c in CASES}:
        cases = [c for c in CASES if c[1] == name]
        rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
        found = detect(rows, detectors=(name,)).groupBy("i", "category").count().collect()
        got = {(r["i"], r["category"]): r["count"] for r in found}
        for i, (text, _, category, count) in enumerate(cases):
            assert got.get((i, category), 0) == count, text


def test_letter_and_markers(spark):
    marker = "[[PII_DIRECT:email:a@b.ru]]; Диагноз=нет"
    rows = spark.createDataFrame([(0, LETTER), (1, marker), (2, None)], "i int, text string")
    found = detect(rows, min_confidence=0.5).collect()
    letter = {r["category"] for r in found if r["i"] == 0}
    assert letter >= {"fio", "birth_date", "passport_rf", "phone", "email", "inn_personal"}
    # the value inside a marker is found a second time; terms are not searched in marked rows
    assert [(r["category"], r["value"]) for r in found if r["i"] == 1] == [("email", "a@b.ru")] * 2
    assert not [r for r in found if r["i"] == 2]


def test_confidence_steps(spark):
    rows = spark.createDataFrame(
        [(0, "д.р. 01.02.1990"), (1, "01.02.1990"), (2, "112-233-445 95"), (3, "снилс 112-233-445 96"), (4, "снилс 112-233-445 95")],
        "i int, text string",
    )
    found = detect(rows, min_confidence=0.0, detectors=("snils", "birth_date")).collect()
    assert {r["i"]: r["confidence"] for r in found} == {0: 1.0, 1: 0.4, 2: 0.85, 3: 0.95, 4: 1.0}


def test_account_is_checked_against_any_bank_of_the_text(spark):
    def fits(account, bik):
        return sum(int(c) * (7, 1, 3)[i % 3] for i, c in enumerate(bik[-3:] + account)) % 10 == 0

    rng = random.Random(3)
    texts, expected = [], []
    for _ in range(60):
        account = "".join(rng.choices("0123456789", k=20))
        biks = ["04" + "".join(rng.choices("0123456789", k=7)) for _ in range(rng.randint(0, 3))]
        texts.append(f"перевод {account} и {' и '.join(biks)}")
        expected.append([0.95] if any(fits(account, b) for b in biks) else [])
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = detect(rows, detectors=("bank_account",), min_confidence=0.0).collect()
    got = [[r["confidence"] for r in found if r["i"] == i] for i in range(len(texts))]
    assert got == expected


def _mrz_blocks(text):
    """Greedy search line by line."""
    is_line = lambda s: len(s.strip()) in MRZ_LENGTHS and all(c.isalnum() or c == "<" for c in s.strip()) and s.count("<") >= 3
    lines = text.splitlines(keepends=True)
    bare = [line.rstrip("\r\n") for line in lines]
    found, i = [], 0
    while i < len(lines):
        n = 0
        while n < 3 and i + n < len(lines) and is_line(bare[i + n]):
            n += 1
        if n >= 2:
            start = sum(len(line) for line in lines[:i])
            value = "\n".join(bare[i : i + n])
            found.append((value, start, min(start + len(value) + 1, len(text))))
        i += max(n, 1)
    return found


def test_machine_readable_zones(spark):
    rng = random.Random(11)
    line = "P<RUSIVANOV<<IVAN<<<<<<<<<<<<<<<<<<<<<<<<<<<"
    parts = [line, line[:36], line[:30], " " + line, line + "\t", line[:43], "text", "", "I<UTO<" + "Я" * 24]
    ends = ["\n", "\r\n", "\r", " ", "\x0b", "\x1c", "\n\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.randint(1, 9))) + rng.choice(["", line]) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    got = with_spans(rows, detectors=("mrz",)).collect()
    for r in got:
        assert [(s["value"], s["start"], s["end"]) for s in r["spans"]] == _mrz_blocks(texts[r["i"]]), repr(texts[r["i"]])


def test_first_of_equal_spans_stays(spark):
    spans = [("fio", "a", 5, 6, 0.4), ("fio", "b", 1, 2, 0.7), ("fio", "c", 5, 6, 0.9), ("email", "d", 5, 6, 0.9)]
    row = spark.createDataFrame([(spans,)], f"s {SPANS.simpleString()}")
    got = row.select(first_of_equal(F.col("s")).alias("s")).first()["s"]
    assert [tuple(s) for s in got] == [spans[0], spans[1], spans[3]]


def test_entities(spark):
    texts = spark.createDataFrame(
        [("a", 0, "Москва " * 10), ("b", 0, "London " * 10), ("c", 0, "Москва"), ("d", 0, "[[PII_DIRECT:fio:x]]" + "Москва " * 10)],
        "path string, chunk_no long, text string",
    )
    assert [r[0] for r in texts.select(wants_entities(F.col("text"))).collect()] == [True, False, False, False]
    cut = slices(texts.filter("path = 'a'"), 30).collect()
    assert [(r["offset"], len(r["text"])) for r in cut] == [(0, 30), (30, 30), (60, 10)]
    model = spark.createDataFrame(
        [("a", 0, "PER", "Иван", 0, 4), ("a", 0, "PER", "Ivan", 0, 4), ("a", 0, "LOC", "Тверь", 9, 14), ("a", 0, "ORG", "Рога", 1, 5)],
        "path string, chunk_no long, type string, value string, start int, end int",
    )
    found = spark.createDataFrame([("a", 0, "fio", 0, 4)], "path string, chunk_no long, category string, start int, end int")
    new = new_entities(entity_spans(model), found).collect()
    assert [(r["category"], r["value"], r["confidence"]) for r in new] == [("address", "Тверь", 0.85)]
