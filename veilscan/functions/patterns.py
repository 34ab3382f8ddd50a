"""Patterns of the detectors, written in Python ``re`` syntax.

They are kept in this form so that tests can hold Spark's result against ``re`` itself;
:mod:`veilscan.functions.regex` turns them into the dialect of the JVM.
"""

from __future__ import annotations

# What each detector looks for, and whether case is ignored.
DETECT: dict[str, tuple[str, bool]] = {
    "marker": (r"\[\[PII_DIRECT:([^:]+):(.*?)\]\]", False),
    "email": (
        r"\b(?!(?:info|support|help|admin|sales|contact|press|pr|marketing|"
        r"hello|career|hr|job|docflow|zamena|legal|zakaz|b2b|office|noreply|feedback)@)"
        r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
        True,
    ),
    "phone": (
        r"(?<!\d)(?:\+7|8)[\s\-\(\)]*(?!800\b)\d{3}[\s\-\(\)]*\d{3}[\s\-\(\)]*\d{2}[\s\-\(\)]*\d{2}(?!\d)",
        False,
    ),
    "passport": (r"(?<!\d)(\d{2})\s?(\d{2})\s?(?:№\s*)?(\d{6})(?!\d)", False),
    "snils": (r"(?<!\d)\d{3}[\-\s]?\d{3}[\-\s]?\d{3}[\-\s]?\d{2}(?!\d)", False),
    "inn": (r"(?<!\d)\d{10}(?!\d)|(?<!\d)\d{12}(?!\d)", False),
    "ogrn": (r"(?<!\d)(?:\d{13}|\d{15})(?!\d)", False),
    "driver_license": (r"(?<!\d)(?:\d{2}\s?\d{2}\s?\d{6}|[А-ЯA-Z]{2}\s?\d{6})(?!\d)", False),
    "bank_card": (r"(?<!\d)(?:\d[ \-]?){12,18}\d(?!\d)", False),
    "bik": (r"(?<!\d)\d{9}(?!\d)", False),
    "bank_account": (r"(?<!\d)\d{20}(?!\d)", False),
    "cvv_word": (r"\bcvv2?\b|\bcvc2?\b|код\s+безопасности", True),
    "cvv": (r"(?<!\d)\d{3,4}(?!\d)", False),
    "fio": (
        r"\b[А-ЯЁ][а-яё]{1,30}\s+[А-ЯЁ][а-яё]{1,30}\s+[А-ЯЁ][а-яё]{1,30}"
        r"(?:ич|вна|вич|на|евна|ова|ев|ин|ын|ский|ской|ской)?\b",
        False,
    ),
    "fio_initials": (
        r"\b[А-ЯЁ][а-яё]{1,30}\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.|[А-ЯЁ]\.\s*[А-ЯЁ]\.\s*[А-ЯЁ][а-яё]{1,30}",
        False,
    ),
    "birth_date": (
        r"(?<!\d)(?:0?[1-9]|[12]\d|3[01])[.\-/](?:0?[1-9]|1[0-2])[.\-/](?:19|20)\d{2}(?!\d)",
        False,
    ),
    "birth_place": (
        r"(?:место\s+рождения|м\.р\.)[\s:;]+([А-ЯЁ][а-яёА-ЯЁ0-9\s\,\.\-]+)(?=\n|;|$)",
        True,
    ),
    "address": (
        r"(?:г\.|город|с\.|село|пгт\.?|пос\.?)\s+[А-ЯЁ][А-Яа-яЁё\-]+"
        r"|(?:ул\.|улица|пр\.|проспект|пер\.|переулок|пл\.|площадь|шоссе|ш\.|наб\.|набережная|бульвар|б-р)"
        r"\s+[А-ЯЁ][А-Яа-яЁё0-9\.\-\s]{1,40}"
        r"(?:,?\s*д\.?\s*\d+[А-Яа-яЁё]?)?(?:,?\s*кв\.?\s*\d+)?",
        False,
    ),
    "postal": (r"\b\d{6}\b", False),
    "biometric": (
        r"\b(?:отпечат\w+\s+пальц\w+|радужн\w+\s+оболочк\w+|"
        r"голосов\w+\s+(?:образ\w+|слепок)|"
        r"геометри\w+\s+лиц\w+|биометрическ\w+\s+(?:данн\w+|шаблон\w+))",
        True,
    ),
    "health": (
        r"\b(?:диагноз|анамнез|заболеван\w+|медицинск\w+\s+(?:карт\w+|справ\w+|заключен\w+|тайн\w+)|"
        r"группа\s+крови|резус|беремен\w+|инвалидност\w+|МКБ-?10|психиатр\w+|нарколог\w+|вич|спид|гепатит)",
        True,
    ),
    "religion": (r"\b(?:православн\w+|католи[кч]\w*|мусульман\w+|иудаист\w+|буддист\w+)\b", True),
    "politics": (
        r"\b(?:политическ\w+\s+(?:взгляд\w+|убежден\w+|принадлежн\w+|партия)|"
        r"член\s+парти\w+|партийн\w+\s+принадлеж\w+)",
        True,
    ),
    "race": (r"\b(?:этническ\w+\s+происхожден\w+)", True),
}

# Words a detector needs, or values more, near its number; case is ignored.
NEAR: dict[str, str] = {
    "passport": r"паспорт|серии?\s+\d|серия|документ,?\s+удостоверяющий",
    "snils": r"снилс|пенсионн",
    "inn": r"инн|идентификационный\s+номер",
    "driver_license": r"водительск|вод\.?\s*удостоверен|ву\b|driver",
    "bank_card": r"карт[аыеу]|card|visa|mastercard|мир\b",
    "bank_account": r"расч[её]тн|р/с|счет\b|счёт\b|account",
    "bik": r"бик|bik",
    "ogrn": r"огрн",
    "birth_date": r"д\.?\s*р\.?|год\s+рождения|г\.?\s*р\.?|рожд|date\s+of\s+birth|dob",
}

# Words around a span that raise its confidence, per category; case is ignored.
BOOST: dict[str, str] = {
    "passport_rf": r"паспорт|серии?\s+\d|серия\s+(?:и\s+)?номер|документ,?\s+удостоверяющ|удостоверение\s+личности",
    "snils": r"снилс|пенсионн|страхов(?:ой|ое)\s+свидет",
    "inn_personal": r"инн|идентификационн",
    "inn_legal": r"инн|кпп|идентификационн",
    "driver_license": r"водит\w+|вод\.?\s*удост|ву\b|driver",
    "bank_card": r"карт\w+|card|visa|mastercard|мир\b",
    "bank_account": r"счет|счёт|расч[её]тн|р/с|account|iban",
    "bik": r"бик\b|bik\b",
    "cvv": r"cvv|cvc|код\s+безопасн",
    "ogrn": r"огрн",
    "phone": r"тел\.?|телеф|phone|моб\.?|mobile|конт\w+\s+тел",
    "email": r"e[\-\s]?mail|почт|эл\.?\s*адрес",
    "birth_date": r"д\.?\s*р\.?|год\s+рожд|г\.?\s*р\.?|рожден|date\s+of\s+birth|dob",
    "fio": r"ф\.?\s*и\.?\s*о\.?|фамилия|имя|отчеств",
    "address": r"адрес|регистрац|прописк|жительств",
}
BOOST_STEP = 0.25

# What must stand near six digits for them to be a postal code.
POSTAL_NEAR = ("адрес", "регистр", "г.", "город")

# Column name rules of structured sources, first hit wins; case is ignored.
COLUMN_CATEGORY: dict[str, str] = {
    "email": r"^(e[._-]?mail|почта)$",
    "phone": r"^(phone|tel|телефон|моб|сотов)",
    "fio": r"^(fio|fullname|full_name|фио|name|surname|фамил|patronymic|отчеств)",
    "passport_rf": r"^(passport|паспорт|документ)",
    "snils": r"^(snils|снилс|pension)",
    "inn_personal": r"^(inn|инн|tax)",
    "birth_date": r"(birth|др|dob|рожден|birthday)",
    "address": r"^(address|адрес|город|city|страна|регион|region)",
    "bank_card": r"(card|карт|pan)",
    "bank_account": r"(account|счет|р/с)",
}

# Column name rules of the dataset profile, first hit wins; case is ignored.
PROFILE_COLUMN: dict[str, str] = {
    "email": r"^(e[._-]?mail|mail|почта|email)$",
    "phone": r"^(phone|tel|телефон|tel_no|mobile|mob|sotov)",
    "fio": r"^(fio|fullname|full_name|фио|имя|name|surname|фамил|patronymic|отчеств)",
    "passport": r"^(passport|паспорт|pasport|series|серия|number|номер_документ)",
    "snils": r"^(snils|снилс|pension)",
    "inn": r"^(inn|инн|tax)",
    "ogrn": r"^(ogrn|огрн)",
    "birth": r"(birth|др|d[._-]?o[._-]?b|dob|рожден|birthday|birth_date)",
    "address": r"^(address|адрес|street|улиц|город|city|country|страна|регион|region)",
    "card": r"(card|карт|pan|card_no|card_number)",
    "account": r"(account|счет|account_no|sch[_-]?ras)",
    "bik": r"^(bik|бик)$",
    "salary": r"^(salary|зарплат|оклад|payroll|earnings)",
    "gender": r"^(gender|sex|пол)$",
    "diagnosis": r"(diagnos|диагноз)",
    "religion": r"(религ|religion|confess)",
}

# File name rules of the dataset profile, all hits count; case is ignored.
SUSPICIOUS_NAME: dict[str, str] = {
    "passport": r"паспорт|passport|pasport",
    "snils": r"снилс|snils",
    "inn": r"\binn\b|инн[_-]?\d?",
    "ogrn": r"огрн|ogrn",
    "driver_license": r"водит|driver[_-]?lic|вод[_-]?удост|prava|права\b",
    "certificate": r"справк[аи]|certificate|сертификат",
    "pd_consent": r"согласие|consent|agreement|обработк[ау][_ ]п[дн]н",
    "contract": r"договор|contract|dogovor|соглашен",
    "form": r"анкет|questionnaire|form_app",
    "resume": r"резюме|resume|\bcv[_ -]",
    "clients": r"клиент|client|customer|customers",
    "employees": r"сотрудник|employee|staff|personnel|hr_",
    "salary": r"зарплат|salary|payroll|оклад",
    "individuals": r"physical|physic|individual|fiz_lic|физ[_-]?лиц",
    "health": r"диагноз|diagnos|медицин|medical|health",
    "payment": r"банк|bank|счет|account|карт[аы]|card",
    "scan_archive": r"\bca\d+_\d+",
}
