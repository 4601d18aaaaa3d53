"""Column expressions over single cells: text, numbers, booleans, states, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Python ``str.strip()`` removes.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())

# Text that Python's ``float()`` takes: digits with single underscores, exponent, inf, nan.
_DIGITS = r"\d+(?:_\d+)*"
_FLOAT_TEXT = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf(?:inity)?|nan)$"
)


def strip(c: Column) -> Column:
    """Trim as Python does; cells that begin and end with plain characters pass untouched."""
    first, last = F.ascii(c), F.ascii(F.right(c, F.lit(1)))
    plain = (first > 32) & (first < 127) & (last > 32) & (last < 127)
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def may_need_strip(line: Column) -> Column:
    """Could a cell of this delimited line begin or end with white space?  Only if a space stands
    beside a comma, a quote or an end of the line, or there is any other white space."""
    beside = any_of([line.contains(text) for text in (" ,", ", ", ' "', '" ')])
    other = "".join(f"\\u{ord(c):04x}" for c in WHITESPACE if c != " ")
    return beside | line.startswith(" ") | line.endswith(" ") | line.rlike(f"[{other}]")


def as_number(c: Column) -> Column:
    """Stripped text to double, NULL where it is no number.

    The plain cast also takes Java spellings (``1.5d``, ``0x1p3``) and refuses digit
    underscores, so text with such letters goes through the stricter pattern.  Such spellings
    end in a letter or hold an x or an underscore, all of which come after the digits in the
    order of characters: text without any later one, which is most, is asked no further.
    """
    strict = F.when(c.rlike(_FLOAT_TEXT), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))
    odd = (F.ascii(F.right(c, F.lit(1))) > 57) | c.contains("_") | c.contains("x") | c.contains("X")
    plain = c.try_cast("double")
    return F.when(c.rlike(r"[^\x00-9]"), F.when(odd, strict).otherwise(plain)).otherwise(plain)


def is_non_numeric(c: Column) -> Column:
    """True for a filled cell that is no number; a blank or missing cell is fine."""
    text = F.coalesce(c, F.lit(""))
    return (text != "") & as_number(text).isNull()


def any_of(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def normalize_word(c: Column) -> Column:
    """Trimmed lower-case text; serves boolean and on/off cells, unknown words stay."""
    return F.lower(strip(c))


def encode_words(c: Column, one: str, zero: str) -> Column:
    word = normalize_word(c)
    return F.when(word == one, F.lit(1)).when(word == zero, F.lit(0)).cast("int")


def encode_boolean(c: Column) -> Column:
    return encode_words(c, "true", "false")


def encode_state(c: Column) -> Column:
    return encode_words(c, "on", "off")


def flag_text(c: Column) -> Column:
    return F.when(c, F.lit("true")).otherwise(F.lit("false"))


def flag_int(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("int")


def round_half_even(c: Column, places: int = 6) -> Column:
    """Round a double to ``places`` digits, ties to even; zero comes out without a sign.

    ``bround`` goes through a decimal object per cell.  Where the shifted value still is an
    exact integer range for doubles, shifting and ``rint`` do the same several times faster.
    """
    factor = 10.0**places
    shifted = F.rint(c * F.lit(factor)) / F.lit(factor) + F.lit(0.0)
    return F.when(F.abs(c) < F.lit(2.0**52 / factor), shifted).otherwise(F.bround(c, places))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def missing_percent(missing: Column, total: Column) -> Column:
    """Share of missing cells in percent, two places; NULL for a table without rows."""
    return F.bround(F.try_divide(missing.cast("double") * F.lit(100.0), total.cast("double")), 2)
