"""Redaction: starring out, scrambling, arithmetic, joined columns, text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.draw import Draws

# Characters that count as blank: fixed value.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0"
INVALID_FILE_CHARACTERS = '"<>|:*?\\/'


def is_blank(text: Column) -> Column:
    """Empty or only whitespace."""
    return F.btrim(text, F.lit(BLANKS)) == ""


def mask_left(text: Column, size: int) -> Column:
    """Star out the first ``size`` characters of a longer text."""
    starred = F.concat(F.lit("*" * size), F.substring(text, size + 1, 2**30))
    return F.when((F.length(text) > size) & ~is_blank(text), starred).otherwise(text)


def mask_right(text: Column, size: int) -> Column:
    """Star out the last of the chunks of ``size`` characters counted from the left."""
    length = F.length(text)
    last = (length - 1) % size + 1
    starred = F.concat(F.substring(text, F.lit(1), length - last), F.repeat(F.lit("*"), last))
    return F.when((length > size) & ~is_blank(text), starred).otherwise(text)


def mask_middle(text: Column, size: int) -> Column:
    """Star out everything between the first and the last chunk."""
    length = F.length(text)
    last = (length - 1) % size + 1
    starred = F.concat(
        F.substring(text, 1, size), F.repeat(F.lit("*"), length - last - size), F.right(text, last)
    )
    return F.when((length > 2 * size) & ~is_blank(text), starred).otherwise(text)


MASKING_OUT = {"maskingleft": mask_left, "maskingright": mask_right, "maskingmiddle": mask_middle}


# Characters one digest gives sort keys for, and digests spelled out before a lambda takes over.
_KEYS_PER_DIGEST = 8
_SPELLED_DIGESTS = (1, 4)


def permuted(text: Column, draws: Draws) -> Column:
    """The characters of a text in the order of a keyed hash: four hex digits per character.

    Zip, sort and join are built in; only digests of long texts run through a lambda. Digits beyond the last
    character pair up with null, which the join leaves out.
    """
    length = F.length(text)
    last = F.call_function("div", F.greatest(length - 1, F.lit(0)), F.lit(_KEYS_PER_DIGEST)).cast("int")
    digests = F
    for count in _SPELLED_DIGESTS:
        spelled = F.concat(*[draws.digest(f"p{b}") for b in range(count)])
        digests = digests.when(length <= _KEYS_PER_DIGEST * count, spelled)
    digests = digests.otherwise(F.array_join(F.transform(F.sequence(F.lit(0), last), draws.digest_of), ""))
    ranked = F.arrays_zip(
        F.regexp_extract_all(digests, F.lit("...."), F.lit(0)).alias("h"), F.split(text, "").alias("c")
    )
    return F.array_join(F.sort_array(ranked)["c"], "")


Hold = Callable[[Column], Column]


def scramble_text(text: Column, draws: Draws, hold: Hold = lambda mixed: mixed) -> Column:
    """Permute the characters; if the order came out the same, rotate by one."""
    mixed = hold(permuted(text, draws))
    turned = F.concat(F.substring(text, 2, 2**30), F.substring(text, 1, 1))
    return F.when(F.length(text) <= 1, text).otherwise(F.when(mixed == text, turned).otherwise(mixed))


def scramble_whole(number: Column, draws: Draws, kind: str, hold: Hold = lambda mixed: mixed) -> Column:
    """Permute the digits of a whole number; leading zeros drop, the sign stays in front.

    A permutation that does not fit the type (9 in front of ten digits) keeps the number.
    """
    mixed = scramble_text(F.abs(number.cast("decimal(38,0)")).cast("string"), draws, hold)
    value = mixed.cast("decimal(38,0)")
    signed = F.when(number < 0, -value).otherwise(value)
    return F.coalesce(signed.try_cast(kind), number)


def scramble_decimal(number: Column, draws: Draws, kind: str, hold: Hold = lambda mixed: mixed) -> Column:
    """Permute the digits left of the point and keep the fraction."""
    text = F.abs(number).cast("string")
    point = F.instr(text, ".")
    whole = F.when(point > 0, F.substring_index(text, ".", 1)).otherwise(text)
    rest = F.when(point > 0, F.concat(F.lit("."), F.substring_index(text, ".", -1))).otherwise(F.lit(""))
    value = F.concat(scramble_text(whole, draws, hold), rest).try_cast(kind)
    return F.coalesce(F.when(number < 0, -value).otherwise(value), number)


# Arithmetic -------------------------------------------------------------------------------------

# Operator names: fixed values, spelled as rule sheets spell them.
OPERATORS = ["addition", "avarage", "substraction", "multiplication", "division", "percentage", "randomPercentage"]


def math_value(operator: str, sources: list[Column], factor: int, draws: Draws) -> Column | None:
    """The result of an arithmetic rule; None for an operator without a formula."""
    numbers = [F.coalesce(s.cast("double"), F.lit(0.0)) for s in sources]
    total = numbers[0]
    for number in numbers[1:]:
        total = total + number
    match (operator or "").lower():
        case "addition":
            return total
        case "substraction":
            return F.lit(0.0) - total
        case "percentage":
            return F.lit(factor) / F.lit(100.0) * numbers[0]
        case "randompercentage":
            share = F.lit(factor) + draws(0) % F.lit(max(1, 100 - factor))
            return share.cast("double") / F.lit(100.0) * numbers[0]
        case "avarage":
            return total / F.lit(float(len(numbers)))
        case "division":
            return F.try_divide(numbers[0], F.lit(float(factor)))
    return None


def is_numeric(text: Column) -> Column:
    """Whether a text reads as a number; null counts as zero."""
    return text.isNull() | text.try_cast("double").isNotNull()


def computed(sources: list[Column], separator: str) -> Column:
    """Columns joined by a separator; nulls leave an empty place."""
    return F.concat_ws(separator, *[F.coalesce(s.cast("string"), F.lit("")) for s in sources])


# Text helpers -----------------------------------------------------------------------------------


def clean_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def clean_file_name(text: Column) -> Column:
    return F.translate(text, INVALID_FILE_CHARACTERS, "_" * len(INVALID_FILE_CHARACTERS))


def clean_special_chars(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\w.@-]", "_")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def hex_dump(data: Column, length: int) -> Column:
    """Upper-case hex of a binary value, cut to ``length`` characters."""
    return F.substring(F.hex(data), 1, length)
