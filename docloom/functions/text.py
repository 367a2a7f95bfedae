"""Text functions, each ``Column -> Column``.

All of them stay in the JVM except :func:`fix_unicode`, whose normalisation has no Spark built-in.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import patterns as P

MIN_CONTENT_CHARS = 3


def newline_to_space(c: Column) -> Column:
    """Each line feed becomes one space; runs are kept."""
    return F.translate(c, "\n", " ")


def strip_cr(c: Column) -> Column:
    return F.translate(c, "\r", "")


def has_min_content(c: Column, min_chars: int = MIN_CONTENT_CHARS) -> Column:
    """At least ``min_chars`` code points besides line feeds and spaces; null counts as empty."""
    return F.coalesce(F.length(F.translate(c, "\n ", "")) >= min_chars, F.lit(False))


# --- tokens -----------------------------------------------------------------------------------


def tokenize_words(c: Column) -> Column:
    addressed = c.contains("@") | c.contains("://")
    plain = F.regexp_extract_all(c, F.lit(P.PLAIN_TOKEN), F.lit(0))
    return F.when(addressed, F.regexp_extract_all(c, F.lit(P.TOKEN), F.lit(0))).otherwise(plain)


def count_words(c: Column) -> Column:
    """The number of tokens, without making them."""
    return F.regexp_count(c, F.lit(P.TOKEN))


def is_numeric_token(c: Column) -> Column:
    return c.rlike(P.NUMERIC_TOKEN)


def is_alnum_token(c: Column) -> Column:
    return c.rlike(P.ALNUM_TOKEN)


def stopword_filter(tokens: Column, stop_words: Sequence[str] = P.STOP_WORDS) -> Column:
    """Lower-case the tokens and drop the stop words."""
    words = [str(w) for w in stop_words]
    return F.filter(F.transform(tokens, F.lower), lambda t: ~t.isin(words))


def kept_words(tokens: Column, stop_words: Sequence[str] = P.STOP_WORDS) -> Column:
    """Lower-cased letter/digit tokens that are no stop words, in text order."""
    return stopword_filter(F.filter(tokens, is_alnum_token), stop_words)


def neighbour_pairs(words: Column) -> Column:
    """Each word joined with its successor; empty for fewer than two words."""
    n = F.size(words)
    return F.when(
        n >= 2,
        F.zip_with(
            F.slice(words, F.lit(1), n - 1),
            F.slice(words, F.lit(2), n - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))


# --- cleaner ----------------------------------------------------------------------------------

_CP1252 = {
    bytes([b]).decode("cp1252"): b for b in range(0x80, 0x100) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
} | {chr(b): b for b in range(0x80, 0x100)}

def _chars(first: int, last: int) -> str:
    return "[" + "".join(re.escape(ch) for ch, b in _CP1252.items() if first <= b <= last) + "]"


_TRAIL = _chars(0x80, 0xBF)
# UTF-8 read as a one-byte encoding: Latin letters, general punctuation and symbols, pictographs, the
# byte-order mark. Other lead bytes are everyday letters that may well stand before a closing quote
# or a no-break space, so they are left alone.
_MOJIBAKE = re.compile(f"(?:[ÂÃ]{_TRAIL}|â{_chars(0x80, 0x84)}{_TRAIL}|ð{_chars(0x9F, 0x9F)}{_TRAIL}{{2}}|ï»¿)+")


_CLOSING = "»\u00a0"


def _repair_match(match: re.Match) -> str:
    before = match.string[match.start() - 1 : match.start()]
    if len(match.group()) == 2 and match.group()[1] in _CLOSING and before.isupper():
        # A word in capitals that ends in such a letter, before a closing quote or a no-break space.
        return match.group()
    try:
        return bytes(_CP1252[ch] if ch in _CP1252 else ord(ch) for ch in match.group()).decode("utf-8")
    except (UnicodeDecodeError, ValueError):
        return match.group()


def repair_text(text: str) -> str:
    """Undo wrongly decoded UTF-8, then compose to NFC."""
    return unicodedata.normalize("NFC", _MOJIBAKE.sub(_repair_match, text))


# Texts of a batch that are Python strings at one time; the batch itself stays in Arrow.
_REPAIRED_AT_ONCE = 64


@F.arrow_udf(T.StringType())
def _repair(texts: pa.Array) -> pa.Array:
    parts = []
    for i in range(0, len(texts), _REPAIRED_AT_ONCE):
        part = texts.slice(i, _REPAIRED_AT_ONCE).to_pylist()
        parts.append(pa.array([t if t is None else repair_text(t) for t in part], pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def fix_unicode(c: Column) -> Column:
    """Repair broken Unicode. ASCII texts reach Python as nulls, so they cost no transfer."""
    return F.coalesce(_repair(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def no_line_breaks(c: Column) -> Column:
    return F.regexp_replace(c, P.LINE_BREAKS, " ")


def mask_urls(c: Column) -> Column:
    return F.regexp_replace(c, P.URL, "<url>")


def mask_emails(c: Column) -> Column:
    return F.regexp_replace(c, P.EMAIL, "<email>")


def mask_dates(c: Column) -> Column:
    return F.regexp_replace(c, P.DATE, "<date>")


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, P.NUMBER, "<number>")


def mask_digits(c: Column) -> Column:
    return F.regexp_replace(c, P.DIGITS, "<number>")


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(c, P.SPACES, " ")


def _chain(c: Column, *steps: Callable[[Column], Column]) -> Column:
    for step in steps:
        c = step(c)
    return c


def clean_text(c: Column, repair_unicode: bool = True) -> Column:
    """The whole cleaner as one projection; dates go before numbers, which would eat their digits.

    A quick look at the raw text spares it the masks that cannot match: no earlier step can bring in a
    digit, an "@" or a URL.
    """
    text = no_line_breaks(fix_unicode(c) if repair_unicode else c)
    digits = (mask_dates, mask_numbers, mask_digits, squeeze_spaces)
    return (
        F.when(~c.rlike(P.MASKABLE), squeeze_spaces(text))
        .when(~c.contains("@"), _chain(text, mask_urls, *digits))
        .otherwise(_chain(text, mask_urls, mask_emails, *digits))
    )
