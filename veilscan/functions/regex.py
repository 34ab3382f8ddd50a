"""Python ``re`` patterns in the dialect of the JVM, with equal matches."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.functions import patterns

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\s\x1c-\x1f"
# The JVM counts combining marks as word characters and knows fewer spaces than Python.
_OUTSIDE = {
    "w": f"[{_WORD}]",
    "W": f"[^{_WORD}]",
    "s": f"[{_SPACE}]",
    "b": f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))",
}
_INSIDE = {"w": _WORD, "s": _SPACE}


_WORD_BEFORE = f"(?<![{_WORD}])"


def _set_of_letters(rest: str) -> str | None:
    """The character set a pattern starts with, when it holds nothing but letters and digits."""
    if not rest.startswith("[") or rest.startswith("[^"):
        return None
    inner = rest[1 : rest.index("]")]
    return f"[{inner}]" if all(c.isalnum() or c == "-" for c in inner.rstrip("-")) and not inner.endswith("-") else None


def _starts_with_letter(rest: str) -> bool:
    """True when a match of ``rest`` surely starts with a letter or digit."""
    if rest.startswith("(?:"):
        depth, fresh = 1, True
        for ch in rest[3:]:
            if fresh and not (ch.isalnum()):
                return False
            fresh = False
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                return True
            fresh = ch == "|" and depth == 1
        return False
    return rest[:1].isalnum() or rest.startswith(r"\d") or _set_of_letters(rest) is not None


def _boundary(rest: str) -> str:
    """A word boundary; before a letter it only has to look back, after a quick test of that letter."""
    first = _set_of_letters(rest)
    if first is not None:
        return f"(?={first}){_WORD_BEFORE}"
    return _WORD_BEFORE if _starts_with_letter(rest) else _OUTSIDE["b"]


def _alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between the bars that are not within a group or set."""
    parts, depth, in_set, escaped = [""], 0, False, False
    for ch in pattern:
        if ch == "|" and not (depth or in_set or escaped):
            parts.append("")
            continue
        parts[-1] += ch
        if not escaped:
            in_set = ch == "[" or (in_set and ch != "]")
            depth += 0 if in_set else (ch == "(") - (ch == ")")
        escaped = ch == "\\" and not escaped
    return parts


def _first_letters(pattern: str) -> set[str] | None:
    """The letters a match can start with, when every alternative starts with a plain letter."""
    out: set[str] = set()
    for part in _alternatives(pattern):
        if part.startswith("(?:"):
            letters = _first_letters(part[3 : _group_end(part)])
        else:
            letters = {part[0]} if part[:1].isalpha() else None
        if letters is None:
            return None
        out |= letters
    return out


def _group_end(pattern: str) -> int:
    """Index of the bracket that closes the group a pattern starts with."""
    depth = 0
    for at, ch in enumerate(pattern):
        depth += (ch == "(") - (ch == ")")
        if depth == 0:
            return at
    return len(pattern)


def _starts_with_digit(rest: str) -> bool:
    """True when a match of ``rest`` surely starts with a digit."""
    if rest.startswith("("):
        inner = rest[: _group_end(rest)].removeprefix("(").removeprefix("?:")
        return all(_starts_with_digit(part) for part in _alternatives(inner))
    if rest.startswith(r"\d") or (rest.startswith("[") and rest[1 : rest.index("]")].isdigit()):
        return True
    # an optional digit may be missing, so what follows it counts as well
    return rest[:1].isdigit() and (rest[1:2] != "?" or rest[2:3] == "[")


_NO_DIGIT_BEFORE = r"(?<!\d)"


def _with_quick_tests(pattern: str, ignore_case: bool) -> str:
    """Put a test of the next character first where that leaves the matches as they are.

    Most positions of a text fail it, and it is cheaper than looking back or trying every alternative.
    """
    parts = [
        r"(?=\d)" + p
        if p.startswith(_NO_DIGIT_BEFORE) and _starts_with_digit(p.removeprefix(_NO_DIGIT_BEFORE))
        else p
        for p in _alternatives(pattern)
    ]
    pattern = "|".join(parts)
    letters = None if ignore_case or len(parts) == 1 else _first_letters(pattern)
    return f"(?=[{''.join(sorted(letters))}])(?:{pattern})" if letters else pattern


@lru_cache(maxsize=None)
def java(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite a Python pattern so that ``java.util.regex`` finds the same spans."""
    out = ["(?iU)" if ignore_case else "(?U)"]
    pattern = _with_quick_tests(pattern, ignore_case)
    in_set = False
    escaped = False
    for at, ch in enumerate(pattern):
        if escaped:
            if ch == "b" and not in_set:
                out.append(_boundary(pattern[at + 1 :]))
            else:
                out.append((_INSIDE if in_set else _OUTSIDE).get(ch, "\\" + ch))
            escaped = False
        elif ch == "\\":
            escaped = True
        elif in_set:
            in_set = ch != "]"
            out.append("\\[" if ch == "[" else ch)
        elif ch == "[":
            in_set = True
            out.append(ch)
        elif ch == ".":
            out.append(r"[^\n]")
        elif ch == "$":
            out.append(r"(?=\n?\z)")
        else:
            out.append(ch)
    return "".join(out)


def detect_regex(name: str) -> str:
    return java(*patterns.DETECT[name])


def near(name: str, window: Column) -> Column:
    """True when the window holds a word the detector asks for."""
    return window.rlike(java(patterns.NEAR[name], True))


def first_rule(name: Column, rules: dict[str, str]) -> Column:
    """Label of the first rule that hits a name; null when none does."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, pattern in rules.items():
        out = out.when(name.rlike(java(pattern, True)), F.lit(label))
    return out


def strip(value: Column) -> Column:
    """Python's ``str.strip``: removes every kind of Unicode space at both ends."""
    return F.regexp_replace(value, rf"(?U)\A[{_SPACE}]+|[{_SPACE}]+\z", "")


def words(value: Column) -> Column:
    """Python's ``str.split()`` without arguments."""
    return F.regexp_extract_all(value, F.lit(rf"(?U)[^{_SPACE}]+"), F.lit(0))
