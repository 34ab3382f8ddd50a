"""Offsets of regex matches with built-in functions only.

Spark returns the matches of a pattern and the pieces between them, but no offsets. Both lists
together give the offsets by one running sum. The text on either side of a match, which the
context rules need, comes from the same walk: the left side is carried along, the right side is
captured by a lookahead. So the work stays linear in the text however many matches it holds.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Appending to an array copies it, so matches are gathered in blocks of this many.
_BLOCK = 256

_SPANS = "array<struct<value:string,start:int,end:int,left:string,right:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def tail(text: Column, n: int) -> Column:
    return F.substring(text, -n, n)


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


# Stands for a match while the text is split; a code point that is never a character.
_CUT = "﷑"


def _between(text: Column, pattern: str) -> Column:
    """The pieces between the matches.

    ``split`` compiles its pattern for every row unless it is a single plain character, so the matches
    are first replaced by one. A text that holds this very code point is split by the pattern itself.
    """
    by_character = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(_CUT)), _CUT, -1)
    return F.when(text.contains(_CUT), F.split(text, pattern, -1)).otherwise(by_character)


def pieces(text: Column, pattern: str, side: int = 0) -> Column:
    """The matches of a pattern, each with the text before it and up to ``side`` characters after it.

    A text without a match pays for one scan that stops early, nothing else.
    """
    if side:
        groups = re.compile(r"(?<!\\)\((?!\?)").findall(pattern)
        with_right = f"(?:{pattern})(?=([\\s\\S]{{0,{side}}}))"
        after = F.regexp_extract_all(text, F.lit(with_right), F.lit(len(groups) + 1))
    else:
        after = F.array().cast("array<string>")
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        _between(text, pattern).alias("piece"),
        after.alias("after"),
    )
    # the piece after the last match has no partner and falls away
    paired = F.filter(found, lambda e: e["match"].isNotNull())
    return F.when(text.rlike(pattern), paired).otherwise(
        F.array().cast("array<struct<match:string,piece:string,after:string>>")
    )


def _walk_block(block: Column, begin: Column, side: int) -> Column:
    """Fold one block of pieces; ``begin`` holds the position and the text before it."""
    zero = F.struct(
        begin["pos"].alias("pos"), begin["before"].alias("before"), F.array().cast(_SPANS).alias("out")
    )

    def step(acc: Column, e: Column) -> Column:
        start = acc["pos"] + F.length(e["piece"])
        end = start + F.length(e["match"])
        left = tail(F.concat(acc["before"], e["piece"]), side)
        span = F.struct(
            e["match"].alias("value"),
            start.alias("start"),
            end.alias("end"),
            left.alias("left"),
            F.coalesce(e["after"], F.lit("")).alias("right"),
        )
        return F.struct(
            end.alias("pos"),
            tail(F.concat(left, e["match"]), side).alias("before"),
            F.concat(acc["out"], F.array(span)).cast(_SPANS).alias("out"),
        )

    return F.aggregate(block, zero, step)


def walk(found: Column, side: int = 0) -> Column:
    """Turn pieces into spans of value, start and end, with the text on both sides."""
    begin = F.struct(F.lit(0).alias("pos"), F.lit("").alias("before"))
    # most texts have a few matches, which need no blocks
    one_block = _walk_block(found, begin, side)["out"]
    blocks = let(
        found,
        lambda es: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(es) - 1) / _BLOCK).cast("int")),
            lambda b: F.slice(es, b * _BLOCK + 1, _BLOCK),
        ),
    )
    nested = f"array<{_SPANS}>"
    zero = F.struct(begin["pos"].alias("pos"), begin["before"].alias("before"), F.array().cast(nested).alias("out"))

    def block_step(acc: Column, block: Column) -> Column:
        return let(
            _walk_block(block, acc, side),
            lambda w: F.struct(
                w["pos"].alias("pos"),
                w["before"].alias("before"),
                F.concat(acc["out"], F.array(w["out"])).cast(nested).alias("out"),
            ),
        )

    spans = F.flatten(F.aggregate(blocks, zero, block_step)["out"])
    return F.when(F.size(found) > _BLOCK, spans).when(F.size(found) > 0, one_block).otherwise(F.array().cast(_SPANS))


def find_spans(text: Column, pattern: str, side: int = 0) -> Column:
    """All non-overlapping matches as structs of value, start, end, left and right.

    Offsets count code points and are half-open; ``left`` and ``right`` hold up to ``side`` characters.
    """
    return let(pieces(text, pattern, side), lambda found: walk(found, side))


def context_window(text: Column, start: Column, end: Column, radius: int) -> Column:
    """Text from ``radius`` characters before a span to ``radius`` after it."""
    low = F.greatest(start - radius, F.lit(0))
    high = F.least(F.length(text), end + radius)
    return F.substring(text, low + 1, high - low)


def around(span: Column, radius: int) -> Column:
    """The same window, taken from a span that carries its sides."""
    return F.concat(tail(span["left"], radius), span["value"], head(span["right"], radius))
