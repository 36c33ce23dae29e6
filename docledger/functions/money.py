"""Amounts in text and their printed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.binding import let
from docledger.schemas import AMOUNT

# ---- fixed values: amount patterns ----
MONEY = (
    r"(?<![A-Za-z0-9])"
    r"(?:[A-Z]{1,3}\$|[€$£])?\s*-?\(?\d[\d,]*(?:\.\d{1,4})?\)?"
    r"(?:\s*(?:EUR|USD|GBP))?"
    r"(?!\s*%)"
    r"(?![A-Za-z0-9])"
)
NUMBER = r"-?\(?\d[\d,]*(?:\.\d+)?\)?"
CURRENCY_WORD = r"(?iU)\b(?:EUR|USD|GBP)\b"
JOINING_WORD = r"(?i)[,-](?:EUR|USD|GBP)[(,.)]"
QUANTITY = r"^\d+(?:\.\d+)?$"
# ---------------------------------------

# More fraction digits than AMOUNT has, other than zeros.
TOO_FINE = r"\.\d{6}0*[1-9]"

# A number is readable when it has no parenthesis, or a balanced pair around it.
_READABLE = r"^(?:[^()]*|[^()-]*\([^()]+\)[^()]*)$"


def money_tokens(line: Column) -> Column:
    """All money-like pieces of a line, in order."""
    return F.regexp_extract_all(line, F.lit(MONEY), F.lit(0))


def parse_decimal(value: Column) -> Column:
    """First number of a text as a decimal; NULL when there is none or it is malformed.

    ``(12.50)`` is negative; currency signs and words are ignored. A number that AMOUNT can't hold
    to its last digit is unreadable, too: nothing is rounded here.
    """
    # Replacements search bytes; a translation looks up every character.
    unsigned = value
    for sign in ("US$", "$", "€", "£"):
        unsigned = F.replace(unsigned, F.lit(sign), F.lit(""))

    def number(text: Column) -> Column:
        # Dropping a currency word only matters where that joins pieces of a number.
        bare = F.when(
            text.rlike(JOINING_WORD), F.regexp_replace(text, CURRENCY_WORD, "")
        ).otherwise(text)
        return F.regexp_extract(bare, NUMBER, 0)

    def convert(number: Column) -> Column:
        inside = F.substr(number, F.lit(2), F.length(number) - 2)
        negative = F.when(number.endswith(")"), F.concat(F.lit("-"), inside))
        signed = F.when(number.startswith("("), negative).otherwise(number)
        return let(
            F.replace(signed, F.lit(","), F.lit("")),
            lambda digits: F.when(~digits.rlike(TOO_FINE), digits.try_cast(AMOUNT)),
        )

    return let(let(unsigned, number), convert)


def decimal_values(line: Column) -> Column:
    """All readable amounts of a line, in order."""
    return F.filter(F.transform(money_tokens(line), parse_decimal), lambda v: v.isNotNull())


def last_token(line: Column) -> Column:
    """Last money-like piece of a line, readable or not."""
    return F.try_element_at(money_tokens(line), F.lit(-1))


def last_decimal(line: Column) -> Column:
    """Last readable amount of a line; only that one piece is converted."""
    readable = F.filter(money_tokens(line), lambda t: t.rlike(_READABLE))
    return F.when(line.rlike("[0-9]"), parse_decimal(F.try_element_at(readable, F.lit(-1))))


def contains_amount(line: Column) -> Column:
    return last_decimal(line).isNotNull()


def is_quantity(line: Column) -> Column:
    return line.rlike(QUANTITY)


def money_text(amount: Column) -> Column:
    """Two decimals, half-up."""
    return F.round(amount, 2).cast("decimal(28,2)").cast("string")


def plain_number(value: Column) -> Column:
    """Shortest form: trailing zeros and a bare decimal point dropped."""
    return F.regexp_replace(value.cast(AMOUNT).cast("string"), r"\.?0+$", "")
