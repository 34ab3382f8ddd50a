"""Visible text of web pages with built-in functions only."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


# Stands for removed markup while the text is taken apart; never a character of a text.
_GAP = "﷐"

# Elements whose content is not shown.
_HIDDEN = ("script", "style", "noscript")


def _code_point(number: Column) -> Column:
    """The character with a code point; the replacement character where there is none."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    as_bytes = F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD))), 8, "0"))
    return F.decode(as_bytes, "UTF-32")


def _entity(body: Column) -> Column:
    """Text of one character reference, given without its ``&`` and ``;``."""
    named = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])
    hexadecimal = F.conv(F.substring(body, 3, 8), 16, 10).try_cast("bigint")
    decimal = F.substring(body, 2, 10).try_cast("bigint")
    return (
        F.when(body.rlike("^#[xX]"), _code_point(F.coalesce(hexadecimal, F.lit(0))))
        .when(body.startswith("#"), _code_point(F.coalesce(decimal, F.lit(0))))
        .otherwise(F.coalesce(F.try_element_at(named, body), F.concat(F.lit("&"), body, F.lit(";"))))
    )


def unescape(text: Column) -> Column:
    """Replace character references, each exactly once."""
    pattern = "&(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
    plain = F.split(text, pattern, -1)
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    pieces = F.zip_with(
        plain, bodies, lambda a, b: F.concat(a, F.when(b.isNull(), F.lit("")).otherwise(_entity(b)))
    )
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def html_text(html: Column) -> Column:
    """Text of the body, its pieces joined by a blank; scripts, styles and comments are left out."""
    gap = F.lit(_GAP)
    out = F.regexp_replace(html, F.lit(r"(?s)<!--.*?-->"), gap)
    for name in _HIDDEN:
        # one that is never closed hides the rest
        out = F.regexp_replace(out, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>.*?(?:</{name}\s*>|\z)"), gap)
    opened = F.regexp_replace(out, r"(?is)\A.*?<body(?:\s[^>]*)?>", "")
    body = F.regexp_replace(opened, r"(?is)</body\s*>.*\z", "")
    # quoted attributes may hold a closing bracket; where quotes don't pair, the first one ends the tag
    quoted = F.regexp_replace(body, F.lit(r"""<[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), gap)
    no_tags = F.regexp_replace(quoted, F.lit(r"<[a-zA-Z/!?][^>]*>"), gap)
    # no blank before the first piece and behind the last one
    inner = F.regexp_replace(no_tags, rf"\A{_GAP}+|{_GAP}+\z", "")
    return unescape(F.regexp_replace(inner, f"{_GAP}+", " "))
