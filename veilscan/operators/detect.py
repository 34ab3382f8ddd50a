"""Detectors: chunk text to spans, in one projection without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import checksums as check
from veilscan.functions import patterns
from veilscan.functions.regex import detect_regex, java, near, strip
from veilscan.functions.spans import around, find_spans, head, let, pieces, walk
from veilscan.schema import CATEGORIES, SPANS

MARKER = "[[PII_DIRECT:"
CONTEXT_WINDOW = 60
MIN_CONFIDENCE = 0.6
# Columns of rows that are windows of a larger text; null where a row is a whole text.
OWN_FROM, OWN_TO, FILE_MARKED, FILE_RESIDUES = "own_from", "own_to", "file_marked", "file_residues"

# What a text must hold before any detector of the family can hit. Each test is a necessary
# condition: three digits close together, a Cyrillic letter, or both.
_GATES = {
    "marked": lambda t: F.coalesce(t.contains(MARKER), F.lit(False)),
    "at": lambda t: t.contains("@"),
    "filler": lambda t: t.contains("<"),
    "number": lambda t: t.rlike(r"(?U)\d[ \-]?\d[ \-]?\d"),
    "cyrillic": lambda t: t.rlike(r"[\x{0400}-\x{052f}\x{1c80}-\x{1c8f}]"),
}
# Words, or beginnings of words, without which a rule has no hit.
_KEYWORDS = {
    "passport": ("паспорт", "сери", "документ"),
    "ogrn": ("огрн",),
    "driver_license": ("вод", "ву", "driver"),
    "bik": ("бик", "bik"),
    "cvv": ("cvv", "cvc", "код"),
    "birth_place": ("место", "м.р."),
    "postal": ("адрес", "регистр", "г.", "город"),
    "biometric": ("отпечат", "радужн", "голосов", "геометри", "биометрическ"),
    "health": (
        "диагноз", "анамнез", "заболеван", "медицинск", "группа", "резус", "беремен", "инвалидност", "мкб", "психиатр",
        "нарколог", "вич", "спид", "гепатит",
    ),
    "religion": ("православн", "католи", "мусульман", "иудаист", "буддист"),
    "politics": ("политическ", "член", "партийн"),
    "race": ("этническ",),
}
# Digits that a text must hold for a hit of a pattern.
_DIGITS = {
    "phone": 10, "passport": 10, "snils": 11, "inn": 10, "ogrn": 13, "driver_license": 6, "bank_card": 13, "bik": 9,
    "bank_account": 20, "birth_date": 6, "postal": 6,
}
# Letters that only a case-blind comparison takes for others: with one of them no keyword is asked for.
_ODD_CASE = "ſİıK" + "".join(map(chr, range(0x1C80, 0x1C89)))


@dataclass(frozen=True)
class Detector:
    """A named rule from the matches of its patterns to candidates.

    ``rule(text, *hits)`` gets one array of spans per pattern and returns an array of candidates, see
    :func:`_candidate`; ``gates`` names the necessary conditions; ``tables`` tells if the rule also
    runs on marked table rows.
    """

    name: str
    patterns: tuple[str, ...]
    rule: Callable[..., Column]
    gates: tuple[str, ...] = ()
    tables: bool = True


def _candidate(s: Column, category: Column, confidence: Column, **changed: Column) -> Column:
    """A span with its category and confidence; a null confidence drops it later."""
    fields = {name: changed.get(name, s[name]) for name in ("value", "start", "end", "left", "right")}
    return F.struct(
        category.alias("category"),
        confidence.cast("double").alias("confidence"),
        *[column.alias(name) for name, column in fields.items()],
    )


_CANDIDATES = (
    "array<struct<category:string,confidence:double,value:string,start:int,end:int,left:string,right:string>>"
)


def _plain(category: str, confidence: float) -> Callable[..., Column]:
    """A rule that takes every match."""

    def rule(text: Column, hits: Column) -> Column:
        return F.transform(hits, lambda s: _candidate(s, F.lit(category), F.lit(confidence)))

    return rule


def _number(name: str, category: str, reach: int, score: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    """A rule whose score looks at the value and at the words within ``reach`` of it."""

    def rule(text: Column, hits: Column) -> Column:
        return F.transform(
            hits, lambda s: _candidate(s, F.lit(category), score(s["value"], near(name, around(s, reach))))
        )

    return rule


def _checked(
    test: Callable[[Column], Column], both: float, valid: float, words: float
) -> Callable[[Column, Column], Column]:
    """Confidence by check sum and context; without either the span is dropped."""

    def score(value: Column, has_words: Column) -> Column:
        passed = F.when(has_words, F.lit(both)).otherwise(F.lit(valid))
        return F.when(test(value), passed).when(has_words, F.lit(words))

    return score


def _needs_words(
    confidence: float, test: Callable[[Column], Column] | None = None
) -> Callable[[Column, Column], Column]:
    """The words must be there; a test of the value comes first because it is cheaper."""

    def score(value: Column, has_words: Column) -> Column:
        return F.when(has_words if test is None else test(value) & has_words, F.lit(confidence))

    return score


def _card_score(value: Column, has_words: Column) -> Column:
    return F.when(check.luhn_check(value), F.lit(0.95)).when(has_words, F.lit(0.75))


def _birth_date_score(value: Column, has_words: Column) -> Column:
    # a bare date stays as a weak candidate: only a boost can lift it over the cut
    return F.when(has_words, F.lit(0.9)).otherwise(F.lit(0.4))


def _marker(text: Column, hits: Column) -> Column:
    pattern = detect_regex("marker")

    def candidate(s: Column) -> Column:
        category = F.regexp_extract(s["value"], pattern, 1)
        value = strip(F.regexp_extract(s["value"], pattern, 2))
        known = category.isin(list(CATEGORIES)) & (value != "")
        return _candidate(s, category, F.when(known, F.lit(1.0)), value=value)

    return F.transform(hits, candidate)


def _inn(text: Column, hits: Column) -> Column:
    score = _checked(check.inn_check, 0.98, 0.8, 0.7)

    def candidate(s: Column) -> Column:
        category = F.when(F.length(s["value"]) == 12, F.lit("inn_personal")).otherwise(F.lit("inn_legal"))
        return _candidate(s, category, score(s["value"], near("inn", around(s, 60))))

    return F.transform(hits, candidate)


def _bank_account(text: Column, hits: Column, nine_digits: Column, known: Column | None = None) -> Column:
    # a BIK takes part by its residue only, so ten values stand for any number of them
    biks = F.filter(nine_digits, lambda s: check.bik_check(s["value"]))
    residues = F.array_distinct(F.transform(biks, lambda s: check.bik_residue(s["value"])))
    if known is not None:
        residues = F.array_union(residues, F.coalesce(known, F.array().cast("array<int>")))

    def candidates(known: Column) -> Column:
        def candidate(s: Column) -> Column:
            fits = F.array_contains(known, check.account_residue(s["value"]))
            words = near("bank_account", around(s, 80))
            return _candidate(s, F.lit("bank_account"), F.when(fits, F.lit(0.95)).when(words, F.lit(0.75)))

        return F.transform(hits, candidate)

    return let(residues, candidates)


# Fixed value: how far behind its keyword a card code may stand.
_CVV_REACH = 30


def _cvv(text: Column, keywords: Column) -> Column:
    def after(word: Column) -> Column:
        # the window is cut, so digits may end at its edge
        window = head(word["right"], _CVV_REACH)
        before = F.concat(word["left"], word["value"])
        return F.transform(
            find_spans(window, detect_regex("cvv"), side=_CVV_REACH),
            lambda s: _candidate(
                s,
                F.lit("cvv"),
                F.lit(0.8),
                start=word["end"] + s["start"],
                end=word["end"] + s["end"],
                left=F.concat(before, s["left"]),
                right=F.substring(word["right"], s["end"] + 1, F.length(word["right"])),
            ),
        )

    return F.flatten(F.transform(keywords, after))


def _birth_place(text: Column, hits: Column) -> Column:
    pattern = detect_regex("birth_place")

    def candidate(s: Column) -> Column:
        # the place is the end of the match, after the keyword
        place = F.regexp_extract(s["value"], pattern, 1)
        return _candidate(
            s, F.lit("birth_place"), F.lit(0.85), value=strip(place), start=s["end"] - F.length(place)
        )

    return F.transform(hits, candidate)


def _postal(text: Column, hits: Column) -> Column:
    def candidate(s: Column) -> Column:
        window = F.lower(around(s, 40))
        hit = F.lit(False)
        for word in patterns.POSTAL_NEAR:
            hit = hit | window.contains(word)
        return _candidate(s, F.lit("address"), F.when(hit, F.lit(0.6)))

    return F.transform(hits, candidate)


# characters a line of a machine readable zone may end with, and blanks within it
_LINE_END = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
_BLANKS = r"[\t\x1f\p{Zs}]*"
_MRZ_CORE = "|".join(r"[\p{L}\p{N}<]{%d}" % n for n in sorted(check.MRZ_LENGTHS, reverse=True))
_MRZ_LINE = rf"{_BLANKS}(?=(?:[\p{{L}}\p{{N}}]*<){{3}})(?:{_MRZ_CORE}){_BLANKS}"
_MRZ_BREAK = rf"(?:\r\n|[{_LINE_END}])"
MRZ_BLOCK = rf"(?:(?<=[{_LINE_END}])|\A){_MRZ_LINE}(?:{_MRZ_BREAK}{_MRZ_LINE}){{1,2}}(?=[{_LINE_END}]|\z)"


def _mrz(text: Column, hits: Column) -> Column:
    """Two or three machine readable lines in a row.

    Greedy matching takes up to three lines and goes on behind them, so longer runs fall into
    blocks of three, and a single line that is left over does not count.
    """
    # line ends other than CR and LF stay part of their line
    odd = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

    def candidate(s: Column, length: Column) -> Column:
        lines = F.regexp_replace(F.regexp_replace(s["value"], r"\r\n?", "\n"), f"({odd})", "$1\n")
        value = F.concat(lines, F.regexp_extract(s["right"], rf"\A{odd}", 0))
        end = F.least(s["start"] + F.length(value) + 1, length)
        return _candidate(s, F.lit("mrz"), F.lit(0.95), value=value, end=end)

    # the length of the text is counted once, not for every block
    return let(F.length(text), lambda length: F.transform(hits, lambda s: candidate(s, length)))


# The order counts: of equal spans the first one stays.
DETECTORS: tuple[Detector, ...] = (
    Detector("marker", ("marker",), _marker, ("marked",)),
    Detector("email", ("email",), _plain("email", 0.95), ("at",)),
    Detector("phone", ("phone",), _plain("phone", 0.85), ("number",)),
    Detector(
        "passport", ("passport",), _number("passport", "passport_rf", 80, _needs_words(0.85)), ("number", "cyrillic")
    ),
    Detector("snils", ("snils",), _number("snils", "snils", 60, _checked(check.snils_check, 0.98, 0.85, 0.7)), ("number",)),
    Detector("inn", ("inn",), _inn, ("number",)),
    Detector("ogrn", ("ogrn",), _number("ogrn", "ogrn", 60, _needs_words(0.9, check.ogrn_check)), ("number", "cyrillic")),
    Detector(
        "driver_license", ("driver_license",), _number("driver_license", "driver_license", 60, _needs_words(0.8)), ("number",)
    ),
    Detector("mrz", ("mrz",), _mrz, ("filler",), tables=False),
    Detector("bank_card", ("bank_card",), _number("bank_card", "bank_card", 60, _card_score), ("number",)),
    Detector("bik", ("bik",), _number("bik", "bik", 40, _needs_words(0.9, check.bik_check)), ("number",)),
    Detector("bank_account", ("bank_account", "bik"), _bank_account, ("number",)),
    Detector("cvv", ("cvv_word",), _cvv, ("number",)),
    Detector("fio", ("fio",), _plain("fio", 0.7), ("cyrillic",)),
    Detector("fio_initials", ("fio_initials",), _plain("fio", 0.7), ("cyrillic",)),
    Detector("birth_date", ("birth_date",), _number("birth_date", "birth_date", 40, _birth_date_score), ("number",)),
    Detector("birth_place", ("birth_place",), _birth_place, ("cyrillic",), tables=False),
    Detector("address", ("address",), _plain("address", 0.7), ("cyrillic",), tables=False),
    Detector("postal", ("postal",), _postal, ("number", "cyrillic"), tables=False),
    Detector("biometric", ("biometric",), _plain("biometric", 0.85), ("cyrillic",), tables=False),
    Detector("health", ("health",), _plain("health", 0.8), ("cyrillic",), tables=False),
    Detector("religion", ("religion",), _plain("religion", 0.75), ("cyrillic",), tables=False),
    Detector("politics", ("politics",), _plain("politics", 0.75), ("cyrillic",), tables=False),
    Detector("race", ("race",), _plain("race", 0.75), ("cyrillic",), tables=False),
)
BY_NAME = {d.name: d for d in DETECTORS}


def _pattern(name: str) -> str:
    return MRZ_BLOCK if name == "mrz" else detect_regex(name)


def boost(category: Column, base: Column, window: Column) -> Column:
    """Confidence lifted, up to 1, when the window holds words that speak for the category."""
    words = F.lit(False)
    for name, pattern in patterns.BOOST.items():
        words = F.when(category == name, window.rlike(java(pattern, True))).otherwise(words)
    return F.when(words, F.least(F.lit(1.0), base + patterns.BOOST_STEP)).otherwise(base)


def _finished(candidates: Column, radius: int) -> Column:
    """Drop what no rule wanted, boost the rest and leave the context behind."""
    wanted = F.filter(candidates, lambda s: s["confidence"].isNotNull())
    return F.transform(
        wanted,
        lambda s: F.struct(
            s["category"].alias("category"),
            # only addresses still carry blanks at their ends here
            F.when(s["category"] == "address", strip(s["value"])).otherwise(s["value"]).alias("value"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            boost(s["category"], s["confidence"], around(s, radius)).alias("confidence"),
        ),
    ).cast(SPANS)


def first_of_equal(spans: Column) -> Column:
    """Keep the first of all spans with the same category, start and end, order unchanged."""
    keyed = F.array_sort(
        F.transform(
            spans,
            lambda s, i: F.struct(
                s["category"].alias("category"), s["start"].alias("start"), s["end"].alias("end"),
                i.alias("at"), s["value"].alias("value"), s["confidence"].alias("confidence"),
            ),
        )
    )

    def is_first(all_keyed: Column, s: Column, i: Column) -> Column:
        before = F.get(all_keyed, i - 1)
        same = (
            (before["category"] == s["category"]) & (before["start"] == s["start"]) & (before["end"] == s["end"])
        )
        return (i == 0) | ~same

    firsts = let(keyed, lambda ks: F.filter(ks, lambda s, i: is_first(ks, s, i)))
    in_order = F.array_sort(
        F.transform(
            firsts,
            lambda s: F.struct(
                s["at"].alias("at"), s["category"].alias("category"), s["value"].alias("value"),
                s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence"),
            ),
        )
    )
    resolved = F.transform(
        in_order,
        lambda s: F.struct(*[s[f.name].alias(f.name) for f in SPANS.elementType.fields]),
    ).cast(SPANS)
    return F.when(F.size(spans) < 2, spans).otherwise(resolved)


@dataclass(frozen=True)
class _Stages:
    """The expressions of a detector set, one projection each."""

    gates: dict[str, Column]
    n_digits: Column
    lowered: Column
    odd_case: Column
    words: dict[str, Column]
    hits: Column
    found: Column
    resolved: Column


def _all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


@lru_cache(maxsize=64)
def _stages(text: str, radius: int, names: tuple[str, ...], windows: bool = False) -> _Stages:
    """Build the expressions once and use them again: they have thousands of nodes, each a round trip."""
    column = F.col(text)
    used = [BY_NAME[n] for n in names]
    gates = {g: _GATES[g](column) for g in _GATES if g == "marked" or any(g in d.gates for d in used)}
    if windows:
        # a mark anywhere in the file counts for all its windows
        gates["marked"] = gates["marked"] | F.coalesce(F.col(FILE_MARKED), F.lit(False))

    def basic(d: Detector) -> list[Column]:
        return ([] if d.tables else [~F.col("_gate_marked")]) + [F.col(f"_gate_{g}") for g in d.gates]

    n_digits = F.when(F.col("_gate_number"), F.length(F.regexp_replace(column, r"(?U)\D+", ""))) if "number" in gates else F.lit(0)

    def has_word(d: Detector) -> Column:
        test = F.col("_odd_case")
        for word in _KEYWORDS[d.name]:
            test = test | F.col("_lowered").contains(word)
        return _all(basic(d)) & test

    words = {d.name: has_word(d) for d in used if d.name in _KEYWORDS}
    needed = [F.col(f"_gate_{g}") for g in ("number", "cyrillic") if g in gates]
    searchable = ~_all([~g for g in needed])
    # plain searches for single characters are much cheaper than a character class
    odd_case = searchable & ~_all([~column.contains(c) for c in _ODD_CASE])
    lowered = F.when(searchable, F.lower(column))

    def allowed(d: Detector) -> Column:
        return F.col(f"_word_{d.name}") if d.name in words else _all(basic(d))

    # each pattern is searched once, even when two rules use it
    wanted: dict[str, Column] = {}
    for d in used:
        for p in d.patterns:
            test = allowed(d) & (F.col("_n_digits") >= _DIGITS[p]) if p in _DIGITS else allowed(d)
            wanted[p] = wanted[p] | test if p in wanted else test
    side = max(80, radius + _CVV_REACH)
    no_context = {"marker", "birth_place", "biometric", "health", "religion", "politics", "race"}
    searched = [
        F.when(test, pieces(column, _pattern(p), 0 if p in no_context else side)) for p, test in wanted.items()
    ]
    hits = F.transform(F.array(*searched), lambda found: walk(found, side))

    order = {p: i for i, p in enumerate(wanted)}

    def candidates(d: Detector) -> Column:
        hits_of = [F.get(F.col("_hits"), F.lit(order[p])) for p in d.patterns]
        if windows and d.name == "bank_account":
            return _bank_account(column, *hits_of, known=F.col(FILE_RESIDUES))
        return d.rule(column, *hits_of)

    parts = [F.when(allowed(d), candidates(d).cast(_CANDIDATES)) for d in used]
    # only rules with a hit have a part
    hit = F.filter(F.array(*parts), lambda p: F.size(p) > 0)
    found = _finished(F.flatten(hit), radius)
    return _Stages(gates, n_digits, lowered, odd_case, words, hits, found, first_of_equal(F.col("_found")))


def with_spans(
    df: DataFrame,
    text: str = "text",
    *,
    context_window: int = CONTEXT_WINDOW,
    detectors: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``spans``: every candidate of every detector, boosted and resolved, before the cut.

    All detectors share one narrow pass over the scan. ``detectors`` picks some by name. Rows that are windows of a
    larger text (see ``sources.windows``) keep the spans that start in the part they own; offsets count from the window's beginning.
    """
    names = tuple(BY_NAME) if detectors is None else tuple(detectors)
    windows = {OWN_FROM, OWN_TO, FILE_MARKED, FILE_RESIDUES} <= set(df.columns)
    s = _stages(text, context_window, names, windows)
    # one step per stage: Catalyst keeps them apart because later ones use a column more than once
    out = df.select("*", *[test.alias(f"_gate_{g}") for g, test in s.gates.items()])
    out = out.select("*", s.n_digits.alias("_n_digits"))
    if s.words:
        kept = out.columns
        out = out.select("*", s.lowered.alias("_lowered"), s.odd_case.alias("_odd_case"))
        out = out.select(*kept, *[test.alias(f"_word_{n}") for n, test in s.words.items()])
    out = out.select("*", s.hits.alias("_hits")).select(*df.columns, s.found.alias("_found"))
    spans = s.resolved
    if windows:
        owned = F.filter(F.col("spans"), lambda x: (x["start"] >= F.col(OWN_FROM)) & (x["start"] < F.col(OWN_TO)))
        whole = out.select(*df.columns, spans.alias("spans"))
        return whole.withColumn("spans", F.when(F.col(OWN_FROM).isNull(), F.col("spans")).otherwise(owned))
    return out.select(*df.columns, spans.alias("spans"))


def detect(
    df: DataFrame,
    text: str = "text",
    *,
    min_confidence: float = MIN_CONFIDENCE,
    context_window: int = CONTEXT_WINDOW,
    detectors: Sequence[str] | None = None,
) -> DataFrame:
    """One row per span that passes the cut; ``span_no`` is its rank within the chunk."""
    found = with_spans(df, text, context_window=context_window, detectors=detectors)
    return explode_spans(found, [c for c in df.columns if c != text]).filter(
        F.col("confidence") >= min_confidence
    )


def explode_spans(found: DataFrame, kept: Sequence[str]) -> DataFrame:
    """One row per span, and one row without a span for a chunk that has none.

    The outer form matters: for the inner one Catalyst infers a filter on the size of the array,
    pushes it below the projection and so detects everything twice.
    """
    return found.select(*kept, F.posexplode_outer("spans").alias("span_no", "span")).select(
        *kept, "span_no", "span.*"
    )
