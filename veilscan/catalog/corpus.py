"""Russian letters and file facts derived from the given tables.

The given texts hold no Cyrillic words. So letters are composed from the keys of ``orders``, by one SQL
text that Spark and the checking engine both run. The tables grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.session import spread

K = "o_orderkey"


def _digits(factor: int, n: int) -> str:
    """``n`` digits that follow from the key."""
    return f"lpad(CAST(({K} * {factor} + {factor}) % {10 ** n} AS STRING), {n}, '0')"


# kinds of letters; which variant of a kind a key gets depends on the quotient
_KINDS = 28


def _pick(modulus: int, *texts: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts[:-1]))
    return f"CASE CAST(floor({K} / {_KINDS}) AS BIGINT) % {modulus} {cases} ELSE {texts[-1]} END"


D2, D3, D4, D6 = (_digits(f, n) for f, n in ((37, 2), (7919, 3), (104729, 4), (7919, 6)))
D8, D9, D10 = (_digits(f, n) for f, n in ((15485863, 8), (32452843, 9), (179424673, 10)))
E3, E9 = _digits(6007, 3), _digits(86028121, 9)

_NAME = _pick(
    4, "'Иванов Иван Иванович'", "'Петрова Анна Сергеевна'", "'Сидоров Пётр Ильич'", "'Кузнецова Мария Олеговна'"
)
_DATE = f"lpad(CAST({K} % 28 + 1 AS STRING), 2, '0') || '.' || lpad(CAST({K} % 12 + 1 AS STRING), 2, '0') || '.' || CAST(1950 + {K} % 60 AS STRING)"

_LETTERS = (
    _pick(3, f"'Предъявлен паспорт: 60 04 № ' || {D6}", f"'документ, удостоверяющий личность: 4510 ' || {D6}", f"'на складе 5217 ' || {D6} || ' деталей'"),
    _pick(2, f"'СНИЛС: ' || {D3} || '-' || {E3} || '-' || {D3} || ' ' || {D2}", f"'код ' || {D9} || {D2} || ' в списке'"),
    _pick(2, f"'поставщик, ИНН ' || {D10}", f"'запись ' || {D10} || ' из реестра'"),
    _pick(2, f"'ИНН ' || {D10} || {D2} || ' физлица'", f"'строка ' || {D10} || {D2}"),
    _pick(2, f"'ОГРН ' || {D10} || {D3}", f"'номер ' || {D10} || {D3}"),
    f"'ОГРН ' || {D10} || {D3} || {D2}",
    _pick(2, f"'Водительское удостоверение 77 АВ ' || {D6}", f"'driver 99 16 ' || {D6} || ' выдано'"),
    _pick(3, f"'оплата картой 2200 ' || {D4} || ' ' || {D4} || ' 7' || {D3} || ' прошла'", f"'код 5500-0000-' || {D4} || '-' || {D4}", f"'visa 4' || {D9} || {D6}"),
    _pick(3, f"'БИК банка 04' || {_digits(7919, 7)}", f"'bik 04' || {_digits(7919, 7)} || ' ок'", f"'число 04' || {_digits(7919, 7)}"),
    f"'р/с 40702' || {D9} || {D6} || ' в банке, БИК 044525' || {E3}",
    f"'перевод 40817' || {D9} || {D6} || '; 044030' || {E3}",
    _pick(3, f"'CVV: ' || {D3}", f"'cvc2 код ' || {D4} || ' cvv ' || {D3}", f"'код безопасности карты равен ' || {D3}"),
    _pick(2, f"'Я, ' || {_NAME} || ', подписал заявление ' || CAST({K} AS STRING)", f"'ФИО: ' || {_NAME}"),
    _pick(2, "'Директор Иванов И. И. утвердил'", f"'Исполнитель П.С. Петров, № ' || CAST({K} AS STRING)"),
    _pick(3, f"'Дата рождения ' || {_DATE}", f"'Отчёт от ' || {_DATE}", f"'Адрес дан, дата ' || {_DATE}"),
    _pick(2, "'Место рождения: г. Казань\nдалее'", "'м.р. Тула, Тульская область; рост 180'"),
    _pick(3, f"'Проживает: г. Москва, ул. Ленина, д. ' || {D2} || ', кв. ' || {D3}", "'адрес регистрации: село Берёзовка'", f"'поехал на проспект Мира ' || {D2}"),
    _pick(2, f"'Почтовый адрес ' || {D6} || ', Тверь'", f"'заказ ' || {D6} || ' готов'"),
    _pick(2, "'сняты отпечатки пальцев для пропуска'", "'биометрические данные и слепок голоса; голосовой слепок'"),
    _pick(3, "'в карточке записан диагноз и хроническое заболевание'", "'медицинская карта; группа крови 2, резус плюс'", "'без подиагноза'"),
    _pick(2, "'православный приход, католик и мусульманин'", "'буддистские книги'"),
    _pick(2, "'политические взгляды и член партии'", "'партийная принадлежность'"),
    "'этническое происхождение указано'",
    _pick(3, f"'email: user' || CAST({K} AS STRING) || '@mail.ru'", "'писать на info@company.ru и sales@company.ru'", f"'почта A.B-' || {D3} || '@Sub.Example.com, копия'"),
    _pick(4, f"'моб. +7 953 ' || {D3} || '-' || {D2} || '-07'", f"'контактный телефон 8(812)' || {D3} || '-60-' || {D2}", f"'горячая линия 8 800 ' || {D3} || ' 11 22'", f"'звонить +7926' || {_digits(15485863, 7)}"),
    _pick(2, f"'[[PII_DIRECT:email:user' || CAST({K} AS STRING) || '@mail.ru]]; [[PII_DIRECT:fio:Иванов Иван Иванович]]; Диагноз=нет'", "'[[PII_DIRECT:unknown:x]]; [[PII_DIRECT:address:  г. Тверь ]]'"),
    f"'P<RUSIVANOV<<IVAN<<<<<<<<<<<<<<<<<<<<<<<<<<<\n' || {D10} || 'RUS8001017M2501017<<<<<<<<<<<<<<' || {D2} || '\nконец'",
    f"'Заявление ' || CAST({K} AS STRING) || ': ничего личного'",
)

assert len(_LETTERS) == _KINDS


def letters_sql() -> str:
    """doc_id, path, chunk_no and text: one letter per order, one file per customer."""
    cases = "\n".join(f"    WHEN {i} THEN {text}" for i, text in enumerate(_LETTERS[:-1]))
    return f"""SELECT {K} AS doc_id,
  '/archive/client_' || CAST(o_custkey AS STRING) || CASE WHEN o_custkey % 3 = 0 THEN '.txt' WHEN o_custkey % 3 = 1 THEN '.html' ELSE '' END AS path,
  {K} AS chunk_no,
  CASE {K} % {_KINDS}
{cases}
    ELSE {_LETTERS[-1]}
  END AS text
FROM orders"""


def numbers_sql() -> str:
    """doc_id and digit strings of all lengths the check sums know, some of them with separators."""
    return f"""SELECT {K} AS doc_id,
  CASE {K} % 3 WHEN 0 THEN '4111 ' || {D4} || ' ' || {D4} || ' ' || {D4} WHEN 1 THEN {D10} || {D3} ELSE {D9} END AS card,
  {D3} || '-' || {E3} || '-' || {D3} || ' ' || {D2} AS snils,
  {D10} AS inn10,
  {D10} || {D2} AS inn12,
  CASE {K} % 2 WHEN 0 THEN '04' ELSE '14' END || {_digits(7919, 7)} AS bik,
  '40702' || {D9} || {D6} AS account,
  {D10} || {D3} AS ogrn13,
  {D10} || {D3} || {D2} AS ogrn15,
  'AB' || {D6} || CASE WHEN {K} % 5 = 0 THEN '<<x' ELSE '<<' END AS mrz_field,
  'P<RUS' || CASE WHEN {K} % 2 = 0 THEN 'IVANOV<<IVAN' ELSE 'PETROV__PETR' END || '<<<<<<<<<<<<<<<<<<<<' || {D6} || CASE WHEN {K} % 3 = 0 THEN '9' ELSE '' END AS mrz_line
FROM orders"""


# name parts that the rules of the profile look for, and some they do not
_STEMS = (
    "passport_scan_", "договор_", "report_", "CA01_", "клиент_", "salary-list-", "снилс_", "photo", "согласие_",
    "hr_staff_", "notes_", "резюме_", "my_inn_", "card_account_",
)
_EXTENSIONS = (
    ".pdf", ".docx", ".csv", ".json", ".html", ".jpg", ".mp4", ".txt", ".xlsx", ".parquet", "", ".TIF", ".zip", ".py", ".xyz",
    ".tar.gz", ".jsonl", ".log",
)


def files_sql() -> str:
    """File facts of documents and pages: path, size, mtime and content."""
    stem = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_STEMS))
    ext = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EXTENSIONS))
    return f"""SELECT '/share/' || lang || '/' || CASE WHEN doc_id % 4 = 0 THEN source || '/' ELSE '' END
    || CASE doc_id % {len(_STEMS)} {stem} END || CAST(doc_id AS STRING)
    || CASE doc_id % {len(_EXTENSIONS)} {ext} END AS path,
  CASE WHEN doc_id % 97 = 0 THEN 0 WHEN doc_id % 11 = 0 THEN n_chars * n_chars ELSE n_chars END AS size,
  CAST(CAST('2015-03-01' AS DATE) + CAST(doc_id * 31 % 3600 AS INT) AS TIMESTAMP) AS mtime,
  text AS content
FROM documents
UNION ALL
SELECT '/share/web/' || substr(url, instr(url, '//') + 2) AS path,
  CAST(length(html) AS BIGINT) AS size,
  CAST(CAST('2021-06-01' AS DATE) + CAST(page_id % 1000 AS INT) AS TIMESTAMP) AS mtime,
  html AS content
FROM pages"""


def _run(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run a text over given tables without leaving named views behind."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: spread(table(spark, sf_dir, t)) for t in tables})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, letters_sql(), "orders")


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, numbers_sql(), "orders")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, files_sql(), "documents", "pages")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over all cores for the detectors."""
    return spread(documents(spark, sf_dir).select("doc_id", "source", "text"))
