"""Check digits of identifiers and payment numbers as column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions.regex import java, strip
from veilscan.functions.spans import let

# Weights of the check sums.
INN10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS_1 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12_WEIGHTS_2 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
ACCOUNT_WEIGHTS = (7, 1, 3)
MRZ_WEIGHTS = (7, 3, 1)
MRZ_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MRZ_LENGTHS = (30, 36, 44)

# every decimal digit outside ASCII and the ASCII digit it stands for
_OTHER_DIGITS = [
    c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
]
_OTHER_AS_ASCII = "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS)


def digits(value: Column) -> Column:
    """Only the digits of a value."""
    return F.regexp_replace(value, r"(?U)\D+", "")


def _ascii_digits(value: Column) -> Column:
    plain = digits(value)
    other = F.translate(plain, "".join(_OTHER_DIGITS), _OTHER_AS_ASCII)
    return F.when(plain.rlike("[^0-9]"), other).otherwise(plain)


def _at(d: Column, i: Column | int) -> Column:
    """Numeric value of the i-th (1-based) digit."""
    position = F.lit(i) if isinstance(i, int) else i
    return F.ascii(F.substring(d, position, F.lit(1))) - 48


def weighted_sum(d: Column, weights: tuple[int, ...], offset: int = 0) -> Column:
    """Digits from ``offset`` on, times their weights, summed."""
    table = F.array(*[F.lit(w) for w in weights])
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(len(weights))),
        F.lit(0),
        lambda acc, i: acc + _at(d, i + offset) * F.get(table, i - 1),
    )


def luhn_check(value: Column) -> Column:
    """12 to 19 digits whose Luhn sum ends in 0."""

    def test(d: Column) -> Column:
        n = F.length(d)

        def term(i: Column) -> Column:
            once = _at(d, i)
            twice = once * 2
            # positions count from 1 here, so the parity test is turned around
            doubled = F.when(twice > 9, twice - 9).otherwise(twice)
            return F.when((i - 1) % 2 == n % 2, doubled).otherwise(once)

        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + term(i))
        return F.when(n.between(12, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(digits(value), test)


def snils_check(value: Column) -> Column:
    """11 digits, the last two being the control number."""

    def test(d: Column) -> Column:
        # below 100 the remainder is the sum itself; 100 and 101 both stand for 0
        rest = weighted_sum(d, SNILS_WEIGHTS) % 101
        check = F.when(rest == 100, F.lit(0)).otherwise(rest)
        return F.when(F.length(d) == 11, check == _at(d, 10) * 10 + _at(d, 11)).otherwise(F.lit(False))

    return let(_ascii_digits(value), test)


def inn_check(value: Column) -> Column:
    """10 digits with one check digit or 12 digits with two."""

    def test(d: Column) -> Column:
        ten = weighted_sum(d, INN10_WEIGHTS) % 11 % 10 == _at(d, 10)
        twelve = (weighted_sum(d, INN12_WEIGHTS_1) % 11 % 10 == _at(d, 11)) & (
            weighted_sum(d, INN12_WEIGHTS_2) % 11 % 10 == _at(d, 12)
        )
        return F.when(F.length(d) == 10, ten).when(F.length(d) == 12, twelve).otherwise(F.lit(False))

    return let(_ascii_digits(value), test)


def bik_check(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) == 9) & d.startswith("04")


def bik_residue(bik: Column) -> Column:
    """What the last three digits of a BIK add to an account's sum, modulo 10."""
    return let(_ascii_digits(bik), lambda d: weighted_sum(d, ACCOUNT_WEIGHTS, offset=6) % 10)


def account_residue(account: Column) -> Column:
    """What a BIK has to add so that the account's sum ends in 0."""
    weights = tuple(ACCOUNT_WEIGHTS[i % 3] for i in range(20))
    return let(_ascii_digits(account), lambda d: (10 - weighted_sum(d, weights) % 10) % 10)


def account_check(account: Column, bik: Column) -> Column:
    """20-digit account that fits the 9-digit BIK."""
    sized = (F.length(digits(account)) == 20) & (F.length(digits(bik)) == 9)
    return F.when(sized, account_residue(account) == bik_residue(bik)).otherwise(F.lit(False))


def ogrn_check(value: Column) -> Column:
    """13 digits (modulo 11) or 15 digits (modulo 13), then modulo 10."""

    def test(d: Column) -> Column:
        def fits(size: int, modulus: int) -> Column:
            body = F.substring(d, 1, size - 1).try_cast("bigint")
            return body % modulus % 10 == _at(d, size)

        return F.when(F.length(d) == 13, fits(13, 11)).when(F.length(d) == 15, fits(15, 13)).otherwise(F.lit(False))

    return let(_ascii_digits(value), test)


def mrz_checkdigit(value: Column) -> Column:
    """Check digit of a machine readable field; -1 when a character has no value."""
    table = F.array(*[F.lit(w) for w in MRZ_WEIGHTS])

    alphabet = F.lit(MRZ_ALPHABET)

    def number(i: Column) -> Column:
        ch = F.substring(value, i, F.lit(1))
        return F.when(ch == "<", F.lit(0)).otherwise(F.instr(alphabet, ch) - 1)

    total = F.aggregate(
        F.sequence(F.lit(1), F.length(value)),
        F.lit(0),
        lambda acc, i: acc + number(i) * F.get(table, (i - 1) % 3),
    )
    return (
        F.when(value == "", F.lit(0))
        .when(value.rlike(r"\A[0-9A-Z<]+\z"), total % 10)
        .otherwise(F.lit(-1))
    )


def is_mrz_line(line: Column) -> Column:
    """A line of 30, 36 or 44 letters, digits and fillers, at least three of them fillers."""
    core = strip(line)
    return (
        F.length(core).isin(list(MRZ_LENGTHS))
        & core.rlike(java(r"^[\w<]+$"))
        & ~core.contains("_")
        & ~core.contains("\n")
        & (F.length(core) - F.length(F.replace(core, F.lit("<"), F.lit(""))) >= 3)
    )


def mrz_block_valid(lines: Column) -> Column:
    """At least two lines, and the first three of them machine readable."""
    return (F.size(lines) >= 2) & F.forall(F.slice(lines, 1, 3), is_mrz_line)
