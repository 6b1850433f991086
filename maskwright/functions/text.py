"""Scalar helpers over text columns; all of them plain Catalyst expressions."""

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed
from maskwright.functions.dialect import SPACE, SPACE_CHARS, java
from maskwright.functions.sweep import let


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE_CHARS))


# Code points per block of a long text. ``substring`` walks from the start of its input: from a block it never walks far.
TEXT_BLOCK = 4096


def in_blocks(text: Column) -> Column:
    """``text`` as an array of stretches of ``TEXT_BLOCK`` code points, for ``cut``."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return F.when(F.length(text) <= TEXT_BLOCK, F.array(text)).otherwise(pieces)


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a text in blocks; time does not depend on where they stand."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    last = F.least(F.floor((end - 1) / TEXT_BLOCK).cast("int"), F.size(blocks) - 1)
    one = F.get(blocks, first)
    several = F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(blocks, i)), "")
    holder = F.when(first == last, one).otherwise(several)
    return F.when((start < end) & (first <= last), F.substring(holder, start - first * TEXT_BLOCK + 1, end - start)).otherwise("")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """What case folding changes beyond lower-casing: one-to-one pairs and expansions."""
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    pairs = {c: c.casefold() for c in chars if c.casefold() != c.lower()}
    single = {c: f for c, f in pairs.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in pairs.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full Unicode case folding; ASCII text pays for ``lower`` only."""
    source, target, expansions = _folds()
    pairs = ",".join(f"{c}:{folded}" for c, folded in expansions.items())
    table = F.str_to_map(F.lit(pairs), F.lit(","), F.lit(":"))

    def folded(lowered: Column) -> Column:
        full = F.array_join(
            F.transform(
                F.split(F.translate(lowered, source, target), ""),
                lambda c: F.coalesce(F.try_element_at(table, c), c),
            ),
            "",
        )
        # In ASCII text, and in no other, characters are as many as bytes.
        return F.when(F.length(lowered) == F.octet_length(lowered), lowered).otherwise(full)

    return let(F.lower(text), folded)


def normalise(value: Column) -> Column:
    """The key under which equal values share one replacement."""
    return casefold(F.regexp_replace(strip(value), f"[{SPACE}]+", " "))


@cache
def _decimal_digits() -> tuple[str, str]:
    chars = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.decimal(c)) for c in chars)


def digits(text: Column) -> Column:
    """The decimal digits of ``text``, of any script, as ASCII digits."""
    only = F.regexp_replace(text, java(r"\D+"), "")
    as_ascii = lambda d: F.when(F.length(d) == F.octet_length(d), d).otherwise(
        F.translate(d, *_decimal_digits())
    )
    return let(only, as_ascii)


def luhn(number: Column) -> Column:
    """Check-digit test on 13 to 19 digits."""
    return let(digits(number), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))


def word_count(text: Column) -> Column:
    count = lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, f"[{SPACE}]+")))
    return let(strip(text), count)


def has_postal(text: Column) -> Column:
    return text.rlike(java(fixed.POSTAL))


def has_address_hint(text: Column) -> Column:
    return text.rlike(java(fixed.ADDRESS_HINT))


def is_person(text: Column) -> Column:
    return text.rlike(rf"\A(?:{java(fixed.PERSON)})\z")


@cache
def _folding_to_ascii() -> str:
    """Letters beyond ASCII whose folded form has ASCII letters in it, such as the ligatures."""
    return "".join(
        c for c in map(chr, range(128, 0x10000)) if any(f.isascii() and f.isalnum() for f in c.casefold())
    )


def label_type(text: Column) -> Column:
    """The type a paragraph announces for its successor, or null."""
    # No label has more than three words: a long paragraph is out after its fourth.
    word = f"A-Za-z0-9{_folding_to_ascii()}"
    short = text.rlike(rf"\A(?:[^{word}]*+[{word}]++){{1,3}}[^{word}]*+\z")
    # An earlier type keeps a label it shares with a later one.
    types = {label: kind for kind, labels in reversed(fixed.LABELS.items()) for label in labels}
    table = F.str_to_map(
        F.lit(",".join(f"{label}:{kind}" for label, kind in types.items() if len(label) <= fixed.LABEL_MAX)),
        F.lit(","),
        F.lit(":"),
    )
    normal = F.trim(F.regexp_replace(casefold(text), "[^a-z0-9]+", " "))
    return F.when((F.octet_length(text) <= 64) | short, F.try_element_at(table, normal))


def hash_bucket(key: Column) -> Column:
    """The first 32 bits of the key's SHA-256, as an integer."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
