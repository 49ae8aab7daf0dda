"""Text expressions: words, pre-tokens and marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space without the vertical tab, spelled out because engines differ on the class.
_SPACE = r"\t\n\f\r "
#: Pre-tokens without a look-ahead branch (fixed value).
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+"
LANGUAGE_TOKEN = r"^<\|[a-z]{2,3}\|>$"
SENTENCE_MARKS = ".。!！?？"


def plain_lower(text: Column) -> Column:
    """Lower case letter by letter: the two letters whose full mapping would differ go first."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and numbers, with ё written as е."""
    return F.regexp_extract_all(F.translate(plain_lower(text), "ё", "е"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def pretokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + PRETOKEN + ")"), F.lit(1))


def is_language_token(token: Column) -> Column:
    return token.rlike(LANGUAGE_TOKEN)


def language_code(token: Column) -> Column:
    """xx of <|xx|>, anything else as it is."""
    return F.regexp_replace(token, r"^<\|([a-z]{2,3})\|>$", "$1")


def is_punctuation_byte(text: Column) -> Column:
    """One byte long and ASCII punctuation."""
    return (F.octet_length(text) == 1) & text.rlike(r"^\p{Punct}$")


def ends_sentence(unit: Column) -> Column:
    """Ends in . ! ? or an ellipsis, closing quotes and brackets aside."""
    return F.trim(unit).rlike(r"""[.!?…]["'»”)\]]*$""")


def starts_upper(unit: Column) -> Column:
    """The first letter is upper case."""
    return F.regexp_extract(unit, r"(\p{L})", 1).rlike(r"^\p{Lu}$")


def has_sentence_mark(word: Column) -> Column:
    return F.trim(word).rlike("[" + SENTENCE_MARKS + "]")


def plain_text(text: Column) -> Column:
    """For error rates, without compatibility forms: lower case, anything but word characters to single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))
