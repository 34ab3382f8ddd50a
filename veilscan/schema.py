"""Categories, groups, protection levels and the table schemas of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Category names and the group each one counts towards.
# inn_legal and ogrn belong to no group.
CATEGORY_GROUP: dict[str, str | None] = {
    "fio": "regular",
    "phone": "regular",
    "email": "regular",
    "birth_date": "regular",
    "birth_place": "regular",
    "address": "regular",
    "passport_rf": "state_id",
    "snils": "state_id",
    "inn_personal": "state_id",
    "inn_legal": None,
    "driver_license": "state_id",
    "mrz": "state_id",
    "ogrn": None,
    "bank_card": "payment",
    "bank_account": "payment",
    "bik": "payment",
    "cvv": "payment",
    "biometric": "biometric",
    "health": "sensitive",
    "religion": "sensitive",
    "politics": "sensitive",
    "race": "sensitive",
    "other_sensitive": "sensitive",
}
CATEGORIES = tuple(CATEGORY_GROUP)

# Protection levels, strictest first.
LEVELS = ("УЗ-1", "УЗ-2", "УЗ-3", "УЗ-4", "Без ПДн")
NO_LEVEL = LEVELS[-1]

# Categories that alone prove personal data, and those that link a name to a person.
STRONG_CATEGORIES = (
    "passport_rf", "snils", "inn_personal", "driver_license", "mrz",
    "bank_card", "bank_account", "bik", "cvv",
    "biometric", "health", "religion", "politics", "race", "other_sensitive",
)
LINKING_CATEGORIES = ("email", "phone", "birth_date")

SPAN = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
SPANS = T.ArrayType(SPAN)

CHUNKS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("chunk_no", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("locator", T.StringType()),
    ]
)

REPORTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
        T.StructField("extension", T.StringType()),
        T.StructField("mime", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("category_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("protection_level", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("text_length", T.LongType()),
        T.StructField("rows_processed", T.LongType()),
    ]
)


def group_of(category: Column) -> Column:
    """Group of a category, null for the two that count towards none."""
    out = F.lit(None).cast("string")
    for group in ("regular", "state_id", "payment", "biometric", "sensitive"):
        members = [c for c, g in CATEGORY_GROUP.items() if g == group]
        out = F.when(category.isin(members), F.lit(group)).otherwise(out)
    return out


def level_rank(level: Column) -> Column:
    """Position of a level in the strictest-first order, for sorting."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level).cast("int")
