"""Text normal forms that agree with Python's Unicode string methods."""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() and \s use this set; Java's trim and \s do not.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_or_null(text: Column) -> Column:
    """Surrounding whitespace removed, nothing left is null."""
    return F.nullif(strip(text), F.lit(""))


def without_whitespace(text: Column) -> Column:
    return F.translate(text, WHITESPACE, "")


@lru_cache(maxsize=1)
def _foreign_digits() -> tuple[str, str]:
    """Decimal digits outside ASCII and their ASCII values."""
    digits = [chr(i) for i in range(0x80, 0x110000) if unicodedata.category(chr(i)) == "Nd"]
    return "".join(digits), "".join(str(unicodedata.decimal(d)) for d in digits)


def ascii_digits(text: Column) -> Column:
    """Full-width and other Unicode decimal digits become 0-9."""
    source, target = _foreign_digits()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, source, target)).otherwise(text)


@lru_cache(maxsize=1)
def _case_folds() -> dict[str, str]:
    """Characters whose case-folded form is not their lower-case form."""
    folds = {}
    for i in range(0x110000):
        lowered = chr(i).lower()
        if len(lowered) == 1 and lowered.casefold() != lowered:
            folds[lowered] = lowered.casefold()
    return folds


def casefold(text: Column) -> Column:
    """Python's casefold: lower case, then the few characters that fold further."""
    lowered = F.lower(text)
    folds = _case_folds()
    single = {k: f for k, f in folds.items() if len(f) == 1}
    # The sharp s is common, all other folds to several characters are rare.
    several = {k: f for k, f in folds.items() if len(f) > 1 and k != "ß"}
    folded = F.replace(
        F.translate(lowered, "".join(single), "".join(single.values())), F.lit("ß"), F.lit("ss")
    )
    pairs = F.create_map(*[F.lit(part) for pair in several.items() for part in pair])
    by_char = F.array_join(
        F.transform(F.split(folded, ""), lambda ch: F.coalesce(F.try_element_at(pairs, ch), ch)), ""
    )
    return (
        F.when(~lowered.rlike(_char_class(folds)), lowered)
        .when(~lowered.rlike(_char_class(several)), folded)
        .otherwise(by_char)
    )


def _char_class(chars: dict[str, str]) -> str:
    """A few ranges that cover the characters: cheap to test, may match others."""
    ranges: list[list[str]] = []
    for ch in sorted(chars):
        if ranges and ord(ch) - ord(ranges[-1][1]) < 0x200 and ord(ranges[-1][0]) > 0xFF:
            ranges[-1][1] = ch
        else:
            ranges.append([ch, ch])
    return "[" + "".join(f"{a}-{b}" for a, b in ranges) + "]"


def entity_key(text: Column) -> Column:
    """Letters and numbers only, case-folded."""
    return casefold(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def fill(template: str, **parts: Column | str) -> Column:
    """A text template with its {names} replaced by columns."""
    pieces: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            part = parts[name]
            pieces.append(F.lit(part) if isinstance(part, str) else part.cast("string"))
    return F.concat(*pieces)
