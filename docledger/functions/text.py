"""Line cleaning and text predicates."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.binding import let

# ---- fixed values: characters, prefixes and words that define the results ----
BREAKS = r"\n\u000b\f\r\u001c-\u001e\u0085\u2028\u2029"
OTHER_BREAKS = "\u000b\f\r\u001c\u001d\u001e\u0085\u2028\u2029"
BESIDE_BREAKS = (" \n", "\n ")
# UTF-8 of the blanks other than one space, or how several of them begin.
BLANK_BYTES = (b"  ", b"\t", b"\x1f", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
BLANKS = r"\t\u001f\u0020\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
IGNORED_LINE_PREFIXES = ("--- page ", "Synthetic test invoice", "Page ")
SEPARATORS = " :#-/"
ROLE_WORDS = ("supplier", "seller", "customer", "buyer", "client")
METADATA_WORDS = (
    "invoice",
    "receipt",
    "date",
    "address",
    "code",
    "vat",
    "pvm",
    "total",
    "amount",
    "price",
    "tax",
    "page",
)
FULL_FOLDS = {
    "ß": "ss",
    "ſ": "s",
    "ﬀ": "ff",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
}
# ------------------------------------------------------------------------------



def _white(characters: str) -> str:
    # The intersection lets the regex engine reject printable ASCII with one test.
    return rf"[[^!-~]&&[{characters}]]"


def _squeeze(text: Column, white: str) -> Column:
    # Matches only what has to change, so ordinary single spaces are not rewritten: more than one
    # character, or one that is no space. Each character of a text is tested once.
    return F.regexp_replace(text, rf"{_white(white)}(?:{_white(white)}+|(?<! ))", " ")


def _without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit("-"))


def normalize_line(line: Column) -> Column:
    """NUL to '-', any whitespace run to one space, ends trimmed."""
    return F.trim(_squeeze(_without_nul(line), BREAKS + BLANKS))


def clean_line_array(text: Column) -> Column:
    """Ordered normalized lines of a document, blank and ignored lines dropped.

    Whitespace is squeezed and lines are cut over the whole text; only the final filter looks at
    lines one by one. Breaks and the blanks beside them are searched as bytes: a pattern for them
    looks behind and ahead at every line end, which costs more than all else here.
    """

    def squeezed(text: Column) -> Column:
        # Few texts hold such bytes; only those are worth the pattern.
        return F.when(contains_any(text.cast("binary"), BLANK_BYTES), _squeeze(text, BLANKS)).otherwise(text)

    def cut(text: Column) -> Column:
        for a_break in OTHER_BREAKS:
            text = F.replace(text, F.lit(a_break), F.lit("\n"))
        # A run of blanks is one space by now, so one on either side of a line end is all there can be.
        for beside in BESIDE_BREAKS:
            text = F.replace(text, F.lit(beside), F.lit("\n"))
        return text

    def plain(text: Column) -> Column:
        return F.when(contains_any(text, (*OTHER_BREAKS, *BESIDE_BREAKS)), cut(text)).otherwise(text)

    lines = F.split(let(F.trim(let(_without_nul(text), squeezed)), plain), "\n")

    def keep(line: Column) -> Column:
        kept = line != ""
        for prefix in IGNORED_LINE_PREFIXES:
            kept = kept & ~line.startswith(prefix)
        return kept

    return F.filter(lines, keep)


def casefold(text: Column) -> Column:
    """Case-insensitive comparison form (lower case plus expanding letters)."""
    low = F.lower(text)
    expanded = low
    for letter, plain in FULL_FOLDS.items():
        expanded = F.replace(expanded, F.lit(letter), F.lit(plain))
    special = r"[[^\x00-\x7f]&&[" + "".join(FULL_FOLDS) + "]]"
    return F.when(low.rlike(special), expanded).otherwise(low)


def english_side(line: Column) -> Column:
    """Text after the last '/' of a bilingual label."""
    return F.when(line.contains("/"), F.trim(F.substring_index(line, "/", -1))).otherwise(line)


def has_label(folded_line: Column, label: str) -> Column:
    # The English side is part of the line, so one containment test covers both.
    return folded_line.contains(label.lower())


def value_after_label(line: Column, folded_line: Column, label: str) -> Column:
    """Text after the first occurrence of the label, separators stripped; '' if absent."""
    at = F.instr(folded_line, label.lower())
    rest = F.substr(line, at + F.lit(len(label)))
    return F.when(at > 0, F.btrim(rest, F.lit(SEPARATORS))).otherwise("")


def is_separator(line: Column) -> Column:
    return F.btrim(line, F.lit(SEPARATORS)) == ""


def is_label_only(value: Column) -> Column:
    return (value == "") | casefold(value).isin(*ROLE_WORDS)


def looks_like_metadata(folded_line: Column, has_amount: Column) -> Column:
    return has_amount | folded_line.contains("@") | contains_any(folded_line, METADATA_WORDS)


def contains_any(text: Column, tokens: Iterable[str | bytes]) -> Column:
    """Whether any token occurs (bytes in binary values); plain searches in the bytes cost less than a pattern."""
    return let(text, lambda t: reduce(or_, (t.contains(token) for token in tokens)))


def starts_with_any(text: Column, tokens: Iterable[str]) -> Column:
    return let(text, lambda t: reduce(or_, (t.startswith(token) for token in tokens)))


def quoted(value: Column) -> Column:
    """Quote a value for an error message, preferring single quotes."""
    escaped = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return (
        F.when(~value.contains("'"), F.concat(F.lit("'"), escaped, F.lit("'")))
        .when(~value.contains('"'), F.concat(F.lit('"'), escaped, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )
