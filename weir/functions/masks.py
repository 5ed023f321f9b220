"""Character-class masks: a value generalised to the pattern of its characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _parser as _regex
except ImportError:  # the parser is not part of the language; without it values are their own masks
    _regex = None

# Character class and the sign that stands for it, in the order they are replaced.
CLASSES = [("[0-9]", "9"), ("[A-Z]+", "A"), ("[a-z]+", "a"), ("[^\\x00-\\x7F]+", "u"), ("\\s+", " ")]
# The characters that end a line, and those of the classes \d, \w and \s, as code points.
LINE_ENDS = [(10, 10), (13, 13), (0x85, 0x85), (0x2028, 0x2028), (0x2029, 0x2029)]
CATEGORIES = {"DIGIT": [(48, 57)], "WORD": [(48, 57), (65, 90), (95, 95), (97, 122)], "SPACE": [(9, 13), (32, 32)]}
_LAST = 0x10FFFF


def value_mask(text: Column) -> Column:
    """Digits one by one as 9; runs of upper case as A, of lower case as a, of anything beyond ASCII
    as u, of white space as one space; other characters stay. Null stays null, empty stays empty."""
    text = F.translate(text, "0123456789", "9" * 10)
    for pattern, sign in CLASSES[1:]:
        text = F.regexp_replace(text, pattern, sign)
    return text


def number_mask(text: Column) -> Column:
    """``value_mask`` of a number's text: digits, a point, a sign and an exponent, or an infinity."""
    return F.when(text.endswith("y"), value_mask(text)).otherwise(F.translate(text, "0123456789E", "9" * 10 + "A"))


#: Characters up to which the classes of a pattern are translated at once; larger ones are replaced.
SMALL_CLASS = 256


def _sets(parsed) -> list[list[tuple[int, int]]] | None:
    """The sets of characters that a parsed pattern tells apart; None if it does more than that."""
    found: list[list[tuple[int, int]]] = []
    for op, given in parsed:
        name = str(op)
        if name in ("LITERAL", "NOT_LITERAL"):
            found.append([(given, given)])
        elif name == "IN":
            for kind, value in given:
                if str(kind) == "NEGATE":
                    continue
                if str(kind) == "CATEGORY":
                    found.append(CATEGORIES[str(value).split("_")[-1]])
                else:
                    found.append([value if str(kind) == "RANGE" else (value, value)])
        elif name == "ANY":
            found.append(LINE_ENDS)
        elif name == "AT":
            found += [CATEGORIES["WORD"]] if "BOUNDARY" in str(given) else []
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT", "SUBPATTERN", "BRANCH", "ASSERT", "ASSERT_NOT", "ATOMIC_GROUP"):
            if name == "SUBPATTERN" and (given[1] or given[2]):
                return None  # flags
            inner = given[1] if name == "BRANCH" else [given] if name == "ATOMIC_GROUP" else [given[-1]]
            for part in inner:
                own = _sets(part)
                if own is None:
                    return None
                found += own
        else:
            return None
    return found


def pattern_classes(pattern: str | None) -> list[tuple[list[tuple[int, int]], str]] | None:
    """(ranges of code points, the sign that stands for them): the characters that ``pattern`` cannot
    tell apart. None if it may tell any two apart (back references, flags, other syntaxes)."""
    if not pattern or _regex is None:
        return None
    try:
        parsed = _regex.parse(pattern)
        sets = None if parsed.state.flags & ~32 else _sets(parsed)
    except Exception:  # noqa: BLE001 a pattern of another syntax
        sets = None
    if sets is None:
        return None
    sets = [*sets, *([r] for r in LINE_ENDS)]
    bounds = sorted({0, _LAST + 1, *(x for s in sets for low, high in s for x in (low, high + 1))})
    classes: dict[tuple, list[tuple[int, int]]] = {}
    for low, high in zip(bounds, bounds[1:], strict=False):
        classes.setdefault(tuple(any(a <= low <= b for a, b in s) for s in sets), []).append((low, high - 1))
    out = []
    for ranges in classes.values():
        if len(ranges) > 1 or ranges[0][0] < ranges[0][1]:
            out.append((ranges, next((c for c in "9aAu#?~" if any(a <= ord(c) <= b for a, b in ranges)), None) or chr(ranges[0][0])))
    return out


def pattern_mask(text: Column, pattern: str | None) -> Column:
    """The mask of ``text`` under a declared pattern: every character as the sign of its class, so the
    mask matches the pattern if and only if the value does. A value is its own mask where the pattern
    may tell any characters apart; without pattern the mask is ``value_mask``."""
    if not pattern:
        return value_mask(text)
    found, signs = "", ""
    for ranges, sign in pattern_classes(pattern) or []:
        if sum(b - a + 1 for a, b in ranges) <= SMALL_CLASS:
            own = "".join(chr(x) for a, b in ranges for x in range(a, b + 1))
            found, signs = found + own, signs + sign * len(own)
        else:
            of = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"
            text = F.regexp_replace(text, of, "\\" + sign if sign in "\\$" else sign)
    return F.translate(text, found, signs) if found else text
