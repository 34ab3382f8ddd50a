"""Protection level, recommendation and the strict filter for confident files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.schema import CATEGORY_GROUP, LEVELS, LINKING_CATEGORIES, STRONG_CATEGORIES

# Advice per level.
RECOMMENDATIONS = {
    "УЗ-1": (
        "Максимальный уровень защиты: шифрование, изолированное хранение, "
        "контроль доступа, аудит, уведомление РКН при инцидентах."
    ),
    "УЗ-2": (
        "Высокий уровень: шифрование при передаче, ограничение доступа, "
        "журналирование операций, регулярные аудиты."
    ),
    "УЗ-3": "Стандартный уровень: контроль доступа, ролевая модель, хранение в защищённых хранилищах.",
    "УЗ-4": (
        "Базовый уровень: парольный доступ, минимизация копий, "
        "соблюдение принципа минимальной достаточности."
    ),
    "Без ПДн": "ПДн не обнаружены — стандартные меры ИБ.",
}

# From which count, or share of rows, on a group is large.
STATE_ID_LARGE_COUNT = 10
STATE_ID_LARGE_RATIO = 0.01
REGULAR_LARGE_COUNT = 50
REGULAR_LARGE_RATIO = 0.10
LONE_CATEGORY_MIN = 3


def total(counts: Column) -> Column:
    """Sum over a map of counts; 0 for an empty or missing one."""
    values = F.coalesce(F.map_values(counts), F.array().cast("array<bigint>"))
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def group_sum(counts: Column, group: str) -> Column:
    """Findings of one category group."""
    members = [c for c, g in CATEGORY_GROUP.items() if g == group]
    return total(F.map_filter(counts, lambda category, n: category.isin(members)))


def level_from_sums(
    sensitive: Column,
    biometric: Column,
    payment: Column,
    state_id: Column,
    regular: Column,
    rows: Column,
    *,
    state_id_large_count: int = STATE_ID_LARGE_COUNT,
    state_id_large_ratio: float = STATE_ID_LARGE_RATIO,
    regular_large_count: int = REGULAR_LARGE_COUNT,
    regular_large_ratio: float = REGULAR_LARGE_RATIO,
) -> Column:
    """The level ladder, strictest rung first; shares count only where rows are known."""

    def large(n: Column, count: int, ratio: float) -> Column:
        share = n / F.nullif(rows, F.lit(0))
        return (n >= count) | F.coalesce((rows > 0) & (share >= ratio), F.lit(False))

    return (
        F.when((sensitive > 0) | (biometric > 0), F.lit(LEVELS[0]))
        .when((payment > 0) | large(state_id, state_id_large_count, state_id_large_ratio), F.lit(LEVELS[1]))
        .when((state_id > 0) | large(regular, regular_large_count, regular_large_ratio), F.lit(LEVELS[2]))
        .when(regular > 0, F.lit(LEVELS[3]))
        .otherwise(F.lit(LEVELS[4]))
    )


def protection_level(counts: Column, rows: Column | None = None, **thresholds: float) -> Column:
    """Level of a file from its map of category counts."""
    sums = [group_sum(counts, g) for g in ("sensitive", "biometric", "payment", "state_id", "regular")]
    return level_from_sums(*sums, F.lit(0) if rows is None else rows, **thresholds)


def recommendation(level: Column) -> Column:
    """Advice for a level; empty for an unknown one."""
    out = F.lit("")
    for name, text in RECOMMENDATIONS.items():
        out = F.when(level == name, F.lit(text)).otherwise(out)
    return out


def is_confident(counts: Column) -> Column:
    """A strong category, or a linking one together with another category or at least three times."""
    names = F.map_keys(counts)
    strong = F.arrays_overlap(names, F.array(*[F.lit(c) for c in STRONG_CATEGORIES]))
    linking = F.arrays_overlap(names, F.array(*[F.lit(c) for c in LINKING_CATEGORIES]))
    enough = (F.size(names) >= 2) | (total(counts) >= LONE_CATEGORY_MIN)
    return F.coalesce(strong | (linking & enough), F.lit(False))
