"""Text functions: Column in, Column out, JVM-side only.

Default behaviour uses the fixed patterns as they are (ASCII word characters, an
unescaped dot after ``www``, mentions before e-mails). ``strict_unicode`` and
``email_first`` switch to the stricter readings.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def strip_mentions(text: Column | str, strict_unicode: bool = False) -> Column:
    pattern = "(?U)" + V.MENTION if strict_unicode else V.MENTION
    return F.regexp_replace(_column(text), pattern, "")


def unwrap_hashtags(text: Column | str, strict_unicode: bool = False) -> Column:
    pattern = "(?U)" + V.HASHTAG if strict_unicode else V.HASHTAG
    return F.regexp_replace(_column(text), pattern, "$1")


def strip_urls(text: Column | str, strict_unicode: bool = False) -> Column:
    pattern = "(?U)" + V.URL.replace("(www.)", r"(www\.)") if strict_unicode else V.URL
    return F.regexp_replace(_column(text), pattern, "")


def strip_emails(text: Column | str, strict_unicode: bool = False) -> Column:
    pattern = "(?U)" + V.EMAIL if strict_unicode else V.EMAIL
    return F.regexp_replace(_column(text), pattern, "")


def squeeze_spaces(text: Column | str) -> Column:
    """Runs of the space character become one; other white space stays."""
    return F.regexp_replace(_column(text), " +", " ")


def normalise(
    text: Column | str, strict_unicode: bool = False, email_first: bool = False
) -> Column:
    """The whole cleaning chain as one expression; NULL stays NULL.

    A pattern can only match if its marker is in the text (``@`` for mentions and
    e-mails; ``#``, ``www`` or ``://`` for the rest), so plain texts skip the
    regular expressions. Removing a match never brings in a marker that a later
    pattern of the same branch is not run for.
    """
    text = _column(text)

    def tags_and_urls(c: Column) -> Column:
        return strip_urls(unwrap_hashtags(c, strict_unicode), strict_unicode)

    if email_first:
        full = tags_and_urls(strip_mentions(strip_emails(text, strict_unicode), strict_unicode))
    else:
        full = strip_emails(tags_and_urls(strip_mentions(text, strict_unicode)), strict_unicode)

    cleaned = (
        F.when(F.contains(text, F.lit("@")), squeeze_spaces(full))
        .when(
            F.contains(text, F.lit("#"))
            | F.contains(text, F.lit("www"))
            | F.contains(text, F.lit("://")),
            squeeze_spaces(tags_and_urls(text)),
        )
        .when(F.contains(text, F.lit("  ")), squeeze_spaces(text))
        .otherwise(text)
    )
    return F.lower(F.trim(cleaned))


def emoji_pattern(extended: bool = False) -> str:
    ranges = V.EMOJI_RANGES + (V.EMOJI_EXTENDED_RANGES if extended else ())
    return "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]+"


def may_hold_emoji(text: Column | str) -> Column:
    """Cheap test: all default ranges start with the same two UTF-8 bytes."""
    lead = F.unhex(F.lit("F09F"))
    return F.contains(_column(text).cast("binary"), lead)


def strip_emoji(text: Column | str, extended: bool = False) -> Column:
    text = _column(text)
    stripped = F.regexp_replace(text, emoji_pattern(extended), "")
    return stripped if extended else F.when(may_hold_emoji(text), stripped).otherwise(text)


def _spaced(text: Column | str, characters: str) -> Column:
    return F.translate(_column(text), characters, " " * len(characters))


def _split_at(text: Column | str, characters: str) -> Column:
    """Non-empty pieces between the given characters. Mapping characters to a space and
    splitting at the single space needs no regular expression."""
    return F.filter(F.split(_spaced(text, characters), " "), lambda w: w != "")


def words(text: Column | str) -> Column:
    """White-space separated words (Unicode white space), no empty ones."""
    return _split_at(text, V.WHITESPACE_CHARACTERS)


def strip(text: Column | str) -> Column:
    """White space (Unicode) off both ends."""
    return F.regexp_replace(
        _column(text), f"^[{V.WHITESPACE_CLASS}]+|[{V.WHITESPACE_CLASS}]+$", ""
    )


def drop_stop_words(text: Column | str, stop_words: Iterable[str]) -> Column:
    """Remove listed words and re-join with single spaces.

    The list becomes a hashed set inside the expression, so the price per word
    does not depend on the list length. The list must be of bounded size; see
    ``operators.stop_words`` for lists of any size.
    """
    listed = sorted(set(stop_words))
    kept = words(text)
    if listed:
        kept = F.filter(kept, lambda w: ~w.isin(listed))
    return F.array_join(kept, " ")


def preprocess(
    text: Column | str,
    stop_words: Iterable[str] = (),
    lowercased: bool = True,
    extended_emoji: bool = False,
) -> Column:
    """Stop words out, emoji out, lower case. Joining compound words comes before
    this one (``operators.phrases.join_phrases``) because it needs a lexicon."""
    kept = drop_stop_words(text, stop_words)
    stripped = F.regexp_replace(kept, emoji_pattern(extended_emoji), "")
    # Test the input, not the long expression: dropping words adds no emoji.
    out = stripped if extended_emoji else F.when(may_hold_emoji(text), stripped).otherwise(kept)
    return F.lower(out) if lowercased else out


def vocabulary_words(text: Column | str) -> Column:
    """Words as the vocabulary sees them: listed punctuation, tab and newline are
    separators, case is kept, apostrophe and underscore belong to words."""
    return _split_at(text, V.VOCABULARY_SEPARATORS)


def vocabulary_line(text: Column | str) -> Column:
    """The text with ``vocabulary_words`` between single spaces or runs of them."""
    return _spaced(text, V.VOCABULARY_SEPARATORS)


def strip_punctuation(text: Column | str) -> Column:
    """Drop everything but letters, digits, underscore and white space."""
    return F.regexp_replace(_column(text), rf"[^\p{{L}}\p{{N}}_{V.WHITESPACE_CLASS}]", "")


def display_words(text: Column | str) -> Column:
    """Words for the word cloud: lower case, no punctuation."""
    return words(strip_punctuation(F.lower(_column(text))))


def strip_outer_quotes(text: Column | str) -> Column:
    return F.regexp_replace(_column(text), '^"+|"+$', "")
