"""Safe display forms of found values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.checksums import digits
from veilscan.functions.regex import strip, words
from veilscan.functions.spans import head, tail

MODES = ("partial", "full", "hash_only")


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(n, F.lit(0)))


def _fallback(v: Column) -> Column:
    """Two characters at both ends, stars between; short values are all stars."""
    n = F.length(v)
    return F.when(n <= 4, _stars(n)).otherwise(F.concat(head(v, 2), _stars(n - 4), tail(v, 2)))


def _phone(v: Column) -> Column:
    d = digits(v)
    shown = F.concat(F.lit("+"), head(d, 1), F.lit(" "), F.substring(d, 2, 3), F.lit(" ***-**-"), tail(d, 2))
    return F.when(F.length(d) >= 10, shown)


def _email(v: Column) -> Column:
    at = F.instr(v, "@")
    shown = F.concat(head(v, 1), _stars(at - 2), F.substring(v, at, F.length(v)))
    # an empty local part leaves nothing to show before the sign
    return F.when(at > 1, shown).when(at == 1, v)


def _ends(v: Column, front: int, middle: str, back: int, low: int, high: int | None = None) -> Column:
    """First and last digits around a fixed middle, when the count of digits fits."""
    d = digits(v)
    fits = F.length(d) >= low if high is None else F.length(d).between(low, high)
    return F.when(fits, F.concat(head(d, front), F.lit(middle), tail(d, back)))


def _initials(v: Column) -> Column:
    return F.array_join(F.transform(words(v), lambda w: F.concat(head(w, 1), F.lit("."))), " ")


def _partial(v: Column, category: Column) -> Column:
    # The shape of each mask.
    shapes = {
        ("phone",): _phone(v),
        ("email",): _email(v),
        ("bank_card",): _ends(v, 4, " **** **** ", 4, 12),
        ("snils",): _ends(v, 3, "-***-*** ", 2, 11, 11),
        ("passport_rf", "driver_license"): _ends(v, 2, "** ****", 2, 6),
        ("inn_personal", "inn_legal"): _ends(v, 2, "***", 2, 4),
        ("bank_account",): _ends(v, 5, "***********", 4, 6),
        ("bik",): _ends(v, 4, "***", 2, 9, 9),
        ("cvv",): F.lit("***"),
        ("mrz",): F.concat(head(v, 3), F.lit("***")),
        ("fio",): F.when(v != "", _initials(v)),
        ("address",): F.concat(head(F.substring_index(v, ",", 1), 6), F.lit("…")),
        ("birth_date",): F.lit("**.**.****"),
    }
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for names, shown in shapes.items():
        out = out.when(category.isin(list(names)), shown)
    return F.coalesce(out, _fallback(v))


def mask_value(value: Column, category: Column, mode: str = "partial") -> Column:
    """Mask a value: by the rule of its category, wholly, or by a short hash."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    v = strip(value)
    if mode == "hash_only":
        return F.concat(F.lit("sha256:"), head(sha256_hex(v), 12))
    if mode == "full":
        return _stars(F.least(F.length(v), F.lit(8)))
    return _partial(v, category)
