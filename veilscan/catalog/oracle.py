"""The detection rules once more, as SQL for the checking engine.

Its regular expressions know no lookaround, so every rule here has a core pattern and conditions on the
characters beside a match. Offsets come from the pieces between the matches, windows from the offsets.
"""

from __future__ import annotations

W = r"[\p{L}\p{N}_]"

# Conditions on the characters before and after a match.
_NO_DIGITS = "NOT regexp_matches(prev, '[0-9]') AND NOT regexp_matches(next, '[0-9]')"
_WORD_START = f"NOT regexp_matches(prev, '{W}')"
_WORD = f"{_WORD_START} AND NOT regexp_matches(next, '{W}')"


def _near(words: str, radius: int) -> str:
    return f"regexp_matches({window(radius)}, '(?i){words}')"


def window(radius: int) -> str:
    low = f"greatest(s - {radius}, 0)"
    return f"substr(text, CAST({low} + 1 AS BIGINT), CAST(least(length(text), e + {radius}) - {low} AS BIGINT))"


def digit(text: str, i: int) -> str:
    return f"CAST(substr({text}, {i}, 1) AS INTEGER)"


def weighted(text: str, weights: tuple[int, ...], offset: int = 0) -> str:
    return "(" + " + ".join(f"{digit(text, i + offset)} * {w}" for i, w in enumerate(weights, 1)) + ")"


def only_digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn(v: str) -> str:
    d = only_digits(v)
    n = f"length({d})"
    twice = f"CAST(substr({d}, i, 1) AS INTEGER) * 2"
    term = (
        f"CASE WHEN (i - 1) % 2 = {n} % 2 THEN CASE WHEN {twice} > 9 THEN {twice} - 9 ELSE {twice} END "
        f"ELSE CAST(substr({d}, i, 1) AS INTEGER) END"
    )
    return f"({n} BETWEEN 12 AND 19 AND coalesce(list_sum(list_transform(range(1, {n} + 1), lambda i: {term})), 0) % 10 = 0)"


def snils(v: str) -> str:
    d = only_digits(v)
    total = weighted(d, (9, 8, 7, 6, 5, 4, 3, 2, 1))
    check = f"CASE WHEN {total} < 100 THEN {total} WHEN {total} % 101 = 100 THEN 0 ELSE {total} % 101 END"
    return f"(CASE WHEN length({d}) = 11 THEN ({check}) = CAST(substr({d}, 10, 2) AS INTEGER) ELSE false END)"


def inn(v: str) -> str:
    d = only_digits(v)
    ten = f"{weighted(d, (2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = {digit(d, 10)}"
    twelve = (
        f"{weighted(d, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = {digit(d, 11)} AND "
        f"{weighted(d, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8))} % 11 % 10 = {digit(d, 12)}"
    )
    return f"(CASE length({d}) WHEN 10 THEN {ten} WHEN 12 THEN {twelve} ELSE false END)"


def ogrn(v: str) -> str:
    d = only_digits(v)
    return (
        f"(CASE length({d}) WHEN 13 THEN CAST(substr({d}, 1, 12) AS BIGINT) % 11 % 10 = {digit(d, 13)} "
        f"WHEN 15 THEN CAST(substr({d}, 1, 14) AS BIGINT) % 13 % 10 = {digit(d, 15)} ELSE false END)"
    )


def bik(v: str) -> str:
    return f"(length({only_digits(v)}) = 9 AND starts_with({only_digits(v)}, '04'))"


def account(v: str, b: str) -> str:
    joined = f"(substr({only_digits(b)}, 7, 3) || {only_digits(v)})"
    weights = tuple((7, 1, 3)[i % 3] for i in range(23))
    return (
        f"(CASE WHEN length({only_digits(v)}) = 20 AND length({only_digits(b)}) = 9 "
        f"THEN {weighted(joined, weights)} % 10 = 0 ELSE false END)"
    )


# Words that lift the confidence of a category.
_BOOST = {
    "passport_rf": r"(паспорт|серии?\s+\d|серия\s+(?:и\s+)?номер|документ,?\s+удостоверяющ|удостоверение\s+личности)",
    "snils": r"(снилс|пенсионн|страхов(?:ой|ое)\s+свидет)",
    "inn_personal": "(инн|идентификационн)",
    "inn_legal": "(инн|кпп|идентификационн)",
    "driver_license": rf"(водит{W}+|вод\.?\s*удост|ву(?:$|[^\p{{L}}\p{{N}}_])|driver)",
    "bank_card": rf"(карт{W}+|card|visa|mastercard|мир(?:$|[^\p{{L}}\p{{N}}_]))",
    "bank_account": r"(счет|счёт|расч[её]тн|р/с|account|iban)",
    "bik": r"(бик(?:$|[^\p{L}\p{N}_])|bik(?:$|[^\p{L}\p{N}_]))",
    "cvv": r"(cvv|cvc|код\s+безопасн)",
    "ogrn": "(огрн)",
    "phone": rf"(тел\.?|телеф|phone|моб\.?|mobile|конт{W}+\s+тел)",
    "email": r"(e[\-\s]?mail|почт|эл\.?\s*адрес)",
    "birth_date": r"(д\.?\s*р\.?|год\s+рожд|г\.?\s*р\.?|рожден|date\s+of\s+birth|dob)",
    "fio": r"(ф\.?\s*и\.?\s*о\.?|фамилия|имя|отчеств)",
    "address": "(адрес|регистрац|прописк|жительств)",
}

_ROLES = (
    "info|support|help|admin|sales|contact|press|pr|marketing|hello|career|hr|job|docflow|zamena|legal|"
    "zakaz|b2b|office|noreply|feedback"
)
_WORDS = {
    "passport": r"(паспорт|серии?\s+\d|серия|документ,?\s+удостоверяющий)",
    "snils": "(снилс|пенсионн)",
    "inn": r"(инн|идентификационный\s+номер)",
    "driver": r"(водительск|вод\.?\s*удостоверен|ву(?:$|[^\p{L}\p{N}_])|driver)",
    "card": r"(карт[аыеу]|card|visa|mastercard|мир(?:$|[^\p{L}\p{N}_]))",
    "account": r"(расч[её]тн|р/с|счет(?:$|[^\p{L}\p{N}_])|счёт(?:$|[^\p{L}\p{N}_])|account)",
    "bik": "(бик|bik)",
    "ogrn": "(огрн)",
    "birth": r"(д\.?\s*р\.?|год\s+рождения|г\.?\s*р\.?|рожд|date\s+of\s+birth|dob)",
}
_ADDRESS = (
    r"(?:г\.|город|с\.|село|пгт\.?|пос\.?)\s+[А-ЯЁ][А-Яа-яЁё\-]+"
    r"|(?:ул\.|улица|пр\.|проспект|пер\.|переулок|пл\.|площадь|шоссе|ш\.|наб\.|набережная|бульвар|б-р)"
    r"\s+[А-ЯЁ][А-Яа-яЁё0-9\.\-\s]{1,40}(?:,?\s*д\.?\s*\d+[А-Яа-яЁё]?)?(?:,?\s*кв\.?\s*\d+)?"
)
_N = r"[А-ЯЁ][а-яё]{1,30}"


def _ladder(valid: str, words: str, both: float, alone: float, words_only: float) -> str:
    return f"CASE WHEN {valid} AND {words} THEN {both} WHEN {valid} THEN {alone} WHEN {words} THEN {words_only} END"


# name: core pattern, condition beside it, category, base confidence (null drops), runs on marked rows
RULES: dict[str, tuple[str, str, str, str, bool]] = {
    "email": (
        r"(?i)[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
        f"{_WORD} AND NOT regexp_matches(v, '(?i)^({_ROLES})@')",
        "'email'", "0.95", True,
    ),
    "phone": (
        r"(?:\+7|8)[\s\-\(\)]*\d{3}[\s\-\(\)]*\d{3}[\s\-\(\)]*\d{2}[\s\-\(\)]*\d{2}",
        rf"{_NO_DIGITS} AND NOT regexp_matches(v, '^(?:\+7|8)[\s\-\(\)]*800(?:[\s\-\(\)])')",
        "'phone'", "0.85", True,
    ),
    "passport": (
        r"\d{2}\s?\d{2}\s?(?:№\s*)?\d{6}", _NO_DIGITS, "'passport_rf'",
        f"CASE WHEN {_near(_WORDS['passport'], 80)} THEN 0.85 END", True,
    ),
    "snils": (
        r"\d{3}[\-\s]?\d{3}[\-\s]?\d{3}[\-\s]?\d{2}", _NO_DIGITS, "'snils'",
        _ladder(snils("v"), _near(_WORDS["snils"], 60), 0.98, 0.85, 0.7), True,
    ),
    "inn": (
        r"[0-9]+", "length(v) IN (10, 12)", "CASE WHEN length(v) = 12 THEN 'inn_personal' ELSE 'inn_legal' END",
        _ladder(inn("v"), _near(_WORDS["inn"], 60), 0.98, 0.8, 0.7), True,
    ),
    "ogrn": (
        r"[0-9]+", "length(v) IN (13, 15)", "'ogrn'",
        f"CASE WHEN {ogrn('v')} AND {_near(_WORDS['ogrn'], 60)} THEN 0.9 END", True,
    ),
    "driver_license": (
        r"(?:\d{2}\s?\d{2}\s?\d{6}|[А-ЯA-Z]{2}\s?\d{6})", _NO_DIGITS, "'driver_license'",
        f"CASE WHEN {_near(_WORDS['driver'], 60)} THEN 0.8 END", True,
    ),
    "bik": (
        r"[0-9]+", "length(v) = 9", "'bik'", f"CASE WHEN {bik('v')} AND {_near(_WORDS['bik'], 40)} THEN 0.9 END", True,
    ),
    "bank_account": (
        r"[0-9]+", "length(v) = 20", "'bank_account'",
        "CASE WHEN len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda b: "
        f"{bik('b')} AND {account('v', 'b')})) > 0 THEN 0.95 WHEN {_near(_WORDS['account'], 80)} THEN 0.75 END",
        True,
    ),
    "fio": (rf"{_N}\s+{_N}\s+{_N}(?:ич|вна|вич|на|евна|ова|ев|ин|ын|ский|ской|ской)?", _WORD, "'fio'", "0.7", True),
    "fio_initials": (
        rf"{_N}\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.|[А-ЯЁ]\.\s*[А-ЯЁ]\.\s*{_N}", "true", "'fio'", "0.7", True,
    ),
    "birth_date": (
        r"(?:0?[1-9]|[12]\d|3[01])[.\-/](?:0?[1-9]|1[0-2])[.\-/](?:19|20)\d{2}", _NO_DIGITS, "'birth_date'",
        f"CASE WHEN {_near(_WORDS['birth'], 40)} THEN 0.9 ELSE 0.4 END", True,
    ),
    "address": (_ADDRESS, "true", "'address'", "0.7", False),
    "postal": (
        r"[0-9]+", f"length(v) = 6 AND {_WORD}", "'address'",
        f"CASE WHEN regexp_matches(lower({window(40)}), '(адрес|регистр|г[.]|город)') THEN 0.6 END", False,
    ),
    "biometric": (
        rf"(?i)(?:отпечат{W}+\s+пальц{W}+|радужн{W}+\s+оболочк{W}+|голосов{W}+\s+(?:образ{W}+|слепок)|"
        rf"геометри{W}+\s+лиц{W}+|биометрическ{W}+\s+(?:данн{W}+|шаблон{W}+))",
        _WORD_START, "'biometric'", "0.85", False,
    ),
    "health": (
        rf"(?i)(?:диагноз|анамнез|заболеван{W}+|медицинск{W}+\s+(?:карт{W}+|справ{W}+|заключен{W}+|тайн{W}+)|"
        rf"группа\s+крови|резус|беремен{W}+|инвалидност{W}+|МКБ-?10|психиатр{W}+|нарколог{W}+|вич|спид|гепатит)",
        _WORD_START, "'health'", "0.8", False,
    ),
    "religion": (
        rf"(?i)(?:православн{W}+|католи[кч]{W}*|мусульман{W}+|иудаист{W}+|буддист{W}+)", _WORD, "'religion'", "0.75", False,
    ),
    "politics": (
        rf"(?i)(?:политическ{W}+\s+(?:взгляд{W}+|убежден{W}+|принадлежн{W}+|партия)|"
        rf"член\s+парти{W}+|партийн{W}+\s+принадлеж{W}+)",
        _WORD_START, "'politics'", "0.75", False,
    ),
    "race": (rf"(?i)этническ{W}+\s+происхожден{W}+", _WORD_START, "'race'", "0.75", False),
}
# in the order in which the detectors are asked
ORDER = (
    "marker", "email", "phone", "passport", "snils", "inn", "ogrn", "driver_license", "mrz", "bank_card", "bik",
    "bank_account", "cvv", "fio", "fio_initials", "birth_date", "birth_place", "address", "postal", "biometric",
    "health", "religion", "politics", "race",
)
FIELDS = "path, chunk_no, det, category, v, s, e, base, text"


def hits(pattern: str, source: str = "t") -> str:
    """All matches in all texts with their offsets."""
    return f"""SELECT path, chunk_no, text, ms[i] AS v,
      CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
      s + length(ms[i]) AS e
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT path, chunk_no, text, regexp_extract_all(text, '{pattern}', 0) AS ms,
        regexp_split_to_array(text, '{pattern}') AS ps FROM {source}))"""


def _generic(name: str) -> str:
    pattern, beside, category, base, marked = RULES[name]
    source = "t" if marked else "(SELECT * FROM t WHERE NOT contains(text, '[[PII_DIRECT:'))"
    return f"""SELECT path, chunk_no, {ORDER.index(name)} AS det, {category} AS category, v, s, e, CAST({base} AS DOUBLE) AS base, text
  FROM (SELECT *, CASE WHEN s = 0 THEN '' ELSE substr(text, s, 1) END AS prev, substr(text, e + 1, 1) AS next
    FROM ({hits(pattern, source)}))
  WHERE {beside}"""


def _marker(categories: tuple[str, ...]) -> str:
    pattern = r"\[\[PII_DIRECT:([^:]+):(.*?)\]\]"
    known = ", ".join(f"'{c}'" for c in categories)
    return f"""SELECT path, chunk_no, 0 AS det, regexp_extract(v, '{pattern}', 1) AS category,
    trim(regexp_extract(v, '{pattern}', 2)) AS v, s, e, CAST(1.0 AS DOUBLE) AS base, text
  FROM ({hits(pattern)}) WHERE regexp_extract(v, '{pattern}', 1) IN ({known}) AND trim(regexp_extract(v, '{pattern}', 2)) <> ''"""


def _cvv() -> str:
    words = r"(?i)cvv2?|cvc2?|код\s+безопасности"
    beside = f"(regexp_matches(v, '(?i)^код') OR ({_WORD}))"
    return f"""SELECT DISTINCT path, chunk_no, {ORDER.index('cvv')} AS det, 'cvv' AS category, v, e0 + s AS s, e0 + e AS e, CAST(0.8 AS DOUBLE) AS base, whole AS text
  FROM (SELECT k.path, k.chunk_no, ms[i] AS v, k.e0, k.whole,
      CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, s + length(ms[i]) AS e
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT path, chunk_no, text AS whole, e AS e0, regexp_extract_all(substr(text, e + 1, 30), '[0-9]+', 0) AS ms,
        regexp_split_to_array(substr(text, e + 1, 30), '[0-9]+') AS ps
      FROM (SELECT *, CASE WHEN s = 0 THEN '' ELSE substr(text, s, 1) END AS prev, substr(text, e + 1, 1) AS next FROM ({hits(words)}))
      WHERE {beside})) k)
  WHERE length(v) IN (3, 4)"""


def _bank_card() -> str:
    """The character behind a number is matched with it, so that greed stops where it must."""
    pattern = r"(?:[0-9][ \-]?){12,18}[0-9](?:[^0-9]|$)"
    base = f"CASE WHEN {luhn('v')} THEN 0.95 WHEN {_near(_WORDS['card'], 60)} THEN 0.75 END"
    return f"""SELECT path, chunk_no, {ORDER.index('bank_card')} AS det, 'bank_card' AS category, v, s, e, CAST({base} AS DOUBLE) AS base, text
  FROM (SELECT path, chunk_no, text, s, regexp_replace(v, '[^0-9]$', '') AS v, s + length(regexp_replace(v, '[^0-9]$', '')) AS e
    FROM (SELECT * FROM ({hits(pattern)}) WHERE s = 0 OR NOT regexp_matches(substr(text, s, 1), '[0-9]')))"""


def _driver_license() -> str:
    """As with bank cards; else two letters and the first six of more digits would hide what begins behind them."""
    pattern = r"(?:[0-9]{2}\s?[0-9]{2}\s?[0-9]{6}|[А-ЯA-Z]{2}\s?[0-9]{6})(?:[^0-9]|$)"
    _, _, category, base, _ = RULES["driver_license"]
    return f"""SELECT path, chunk_no, {ORDER.index('driver_license')} AS det, {category} AS category, v, s, e, CAST({base} AS DOUBLE) AS base, text
  FROM (SELECT path, chunk_no, text, s, regexp_replace(v, '[^0-9]$', '') AS v, s + length(regexp_replace(v, '[^0-9]$', '')) AS e
    FROM (SELECT * FROM ({hits(pattern)}) WHERE s = 0 OR NOT regexp_matches(substr(text, s, 1), '[0-9]')))"""


def _birth_place() -> str:
    pattern = r"(?i)(?:место\s+рождения|м\.р\.)[\s:;]+([А-ЯЁ][а-яёА-ЯЁ0-9\s\,\.\-]+)"
    return f"""SELECT path, chunk_no, {ORDER.index('birth_place')} AS det, 'birth_place' AS category, trim(p, ' \n') AS v,
    e - length(p) AS s, e, CAST(0.85 AS DOUBLE) AS base, text
  FROM (SELECT path, chunk_no, text, regexp_extract(v, '{pattern}', 1) AS p0,
      CASE WHEN substr(text, e + 1, 1) IN ('', ';') THEN p0
        ELSE regexp_extract(p0, '(?s)^(.*)\n', 1) END AS p,
      e - length(p0) + length(p) AS e
    FROM ({hits(pattern, "(SELECT * FROM t WHERE NOT contains(text, '[[PII_DIRECT:'))")})) WHERE p <> ''"""


def _mrz() -> str:
    """Runs of machine readable lines, cut into blocks of three: gaps and islands over the lines."""
    return f"""SELECT path, chunk_no, {ORDER.index('mrz')} AS det, 'mrz' AS category, string_agg(line, chr(10) ORDER BY n) AS v,
    min(pos) AS s, least(min(pos) + CAST(sum(length(line) + 1) AS BIGINT), length(any_value(text))) AS e, CAST(0.95 AS DOUBLE) AS base, any_value(text) AS text
  FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY path, chunk_no, island ORDER BY n) - 1) / 3) AS BIGINT) AS block
    FROM (SELECT *, n - row_number() OVER (PARTITION BY path, chunk_no ORDER BY n) AS island
      FROM (SELECT path, chunk_no, text, ls[n] AS line, n,
          CAST(coalesce(list_sum(list_transform(ls[1:n - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS pos
        FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS n FROM (
          SELECT *, string_split(text, chr(10)) AS ls FROM t WHERE NOT contains(text, '[[PII_DIRECT:'))))
      WHERE length(trim(line)) IN (30, 36, 44) AND regexp_matches(trim(line), '^[\\p{{L}}\\p{{N}}<]+$')
        AND length(line) - length(replace(line, '<', '')) >= 3))
  GROUP BY path, chunk_no, island, block HAVING count(*) >= 2"""


def detector(name: str) -> str:
    from veilscan.schema import CATEGORIES

    special = {"marker": lambda: _marker(CATEGORIES), "cvv": _cvv, "bank_card": _bank_card, "driver_license": _driver_license, "birth_place": _birth_place, "mrz": _mrz}
    return special[name]() if name in special else _generic(name)


def boosted() -> str:
    cases = " ".join(f"WHEN category = '{c}' THEN {_near(words, 60)}" for c, words in _BOOST.items())
    return f"CASE WHEN (CASE {cases} ELSE false END) THEN least(1.0, base + 0.25) ELSE base END"


def spans(source: str, names: tuple[str, ...] = ORDER, cut: float | None = 0.6) -> str:
    """Spans of the named detectors over ``source`` (path, chunk_no, text), boosted, resolved and cut."""
    found = "\n  UNION ALL ".join(detector(n) for n in names)
    keep = "" if cut is None else f"WHERE confidence >= {cut}"
    return f"""WITH t AS ({source}),
found AS ({found}),
scored AS (SELECT path, chunk_no, det, category, CASE WHEN category = 'address' THEN trim(v) ELSE v END AS value, s, e,
    CAST({boosted()} AS DOUBLE) AS confidence
  FROM found WHERE base IS NOT NULL),
resolved AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY path, chunk_no, category, s, e ORDER BY det) = 1),
spans AS (SELECT * FROM resolved {keep})
"""


def masked(v: str = "value", c: str = "category") -> str:
    d = only_digits(v)

    def ends(front: int, middle: str, back: int) -> str:
        return f"substr({d}, 1, {front}) || '{middle}' || right({d}, {back})"

    return f"""CASE
    WHEN {c} = 'phone' AND length({d}) >= 10 THEN '+' || substr({d}, 1, 1) || ' ' || substr({d}, 2, 3) || ' ***-**-' || right({d}, 2)
    WHEN {c} = 'email' AND contains({v}, '@') THEN substr(split_part({v}, '@', 1), 1, 1) || repeat('*', greatest(instr({v}, '@') - 2, 0)) || substr({v}, instr({v}, '@'))
    WHEN {c} = 'bank_card' AND length({d}) >= 12 THEN {ends(4, ' **** **** ', 4)}
    WHEN {c} = 'snils' AND length({d}) = 11 THEN {ends(3, '-***-*** ', 2)}
    WHEN {c} IN ('passport_rf', 'driver_license') AND length({d}) >= 6 THEN {ends(2, '** ****', 2)}
    WHEN {c} IN ('inn_personal', 'inn_legal') AND length({d}) >= 4 THEN {ends(2, '***', 2)}
    WHEN {c} = 'bank_account' AND length({d}) >= 6 THEN {ends(5, '***********', 4)}
    WHEN {c} = 'bik' AND length({d}) = 9 THEN {ends(4, '***', 2)}
    WHEN {c} = 'cvv' THEN '***'
    WHEN {c} = 'mrz' THEN substr({v}, 1, 3) || '***'
    WHEN {c} = 'fio' AND {v} <> '' THEN list_aggregate(list_transform(regexp_extract_all({v}, '\\S+'), lambda w: substr(w, 1, 1) || '.'), 'string_agg', ' ')
    WHEN {c} = 'address' THEN substr(split_part({v}, ',', 1), 1, 6) || '…'
    WHEN {c} = 'birth_date' THEN '**.**.****'
    WHEN length({v}) <= 4 THEN repeat('*', length({v}))
    ELSE substr({v}, 1, 2) || repeat('*', length({v}) - 4) || right({v}, 2) END"""


GROUPS = {
    "regular": ("fio", "phone", "email", "birth_date", "birth_place", "address"),
    "state_id": ("passport_rf", "snils", "inn_personal", "driver_license", "mrz"),
    "payment": ("bank_card", "bank_account", "bik", "cvv"),
    "special": ("biometric", "health", "religion", "politics", "race", "other_sensitive"),
}


def level(sums: dict[str, str], rows: str = "0") -> str:
    """Level ladder over the sums of the groups."""

    def large(n: str, count: int, ratio: float) -> str:
        return f"({n} >= {count} OR ({rows} > 0 AND {n} >= {ratio} * {rows}))"

    s = sums
    return (
        f"CASE WHEN {s['special']} > 0 THEN 'УЗ-1' "
        f"WHEN {s['payment']} > 0 OR {large(s['state_id'], 10, 0.01)} THEN 'УЗ-2' "
        f"WHEN {s['state_id']} > 0 OR {large(s['regular'], 50, 0.1)} THEN 'УЗ-3' "
        f"WHEN {s['regular']} > 0 THEN 'УЗ-4' ELSE 'Без ПДн' END"
    )


def group_sum(group: str, n: str = "n") -> str:
    members = ", ".join(f"'{c}'" for c in GROUPS[group])
    return f"CAST(coalesce(sum(CASE WHEN category IN ({members}) THEN {n} END), 0) AS BIGINT)"
