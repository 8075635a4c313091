"""Text columns. All are built-in expressions but for keyword matching."""

from __future__ import annotations

import html.entities
import json
import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidings import fixed_values as fixed

SENTENCE_GAP = rf"(?<=[.!?]){fixed.SPACE}+"
TAG = r"<[^>]+>"
# Classes that first rule out printable ASCII, most of any text, with a single comparison.
ODD_SPACE = rf"[[^ -~]&&{fixed.SPACE}]"
WORD_GAP = r"[[^a-z]&&[^\p{L}\p{N}]]+"


def strip(text: Column) -> Column:
    """Drop Unicode white space at both ends (``trim`` alone drops spaces only)."""
    return F.trim(text, F.lit(fixed.SPACE_CHARS))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space to one space. Odd characters become spaces first: rewriting every gap
    between words costs far more."""
    return F.regexp_replace(F.regexp_replace(text, ODD_SPACE, " "), " {2,}", " ")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``.

    A plain column used inside an array lambda is evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def or_else(text: Column, default: Column | str) -> Column:
    """``text`` unless it is NULL or empty."""
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def decode_entities(text: Column) -> Column:
    """HTML character references to characters, as HTML reads them in text.

    A text is cut at its ampersands; what follows one is a number, or a name with its semicolon, or
    the longest of the old names that need none, or no reference at all.
    """
    pieces = F.split(text, "&")
    decoded = bind(
        pieces,
        lambda ps: F.concat(
            F.get(ps, F.lit(0)),
            F.array_join(F.transform(F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(0))), _referred), ""),
        ),
    )
    return F.when(text.contains("&"), decoded).otherwise(text)


# Fixed value: how a reference may begin, up to 32 characters of a name.
REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# Names by which HTML knows characters; those without a semicolon are looked for first.
NAMES = dict(sorted(html.entities.html5.items(), key=lambda item: item[0].endswith(";")))
SHORT_NAMES = sorted((name for name in NAMES if not name.endswith(";")), key=len, reverse=True)
LAST_POINT, NO_CHARACTER = 0x10FFFF, "\ufffd"


def _referred(piece: Column) -> Column:
    """What follows an ampersand, with the reference it begins with replaced."""

    def by_name(told: Column) -> Column:
        names = F.from_json(F.lit(json.dumps(NAMES)), "map<string, string>")
        whole = F.try_element_at(names, told)
        short = F.regexp_extract(told, f"^(?:{'|'.join(SHORT_NAMES)})", 0)
        return F.coalesce(
            F.concat(whole, F.substr(piece, F.length(told) + 1)),
            F.when(short != "", F.concat(F.try_element_at(names, short), F.substr(piece, F.length(short) + 1))),
            F.concat(F.lit("&"), piece),
        )

    def by_number(told: Column) -> Column:
        digits = F.ltrim(F.regexp_extract(told, "([0-9a-fA-F]+);?$", 1), F.lit("0"))
        number = F.when(F.rlike(told, F.lit("^#[xX]")), F.conv(digits, 16, 10)).otherwise(digits)
        # Nine digits without leading zeros are beyond the last character.
        point = F.when(F.length(digits) > 8, LAST_POINT + 1).when(digits == "", 0).otherwise(number.cast("long"))
        return F.concat(bind(point, _character), F.substr(piece, F.length(told) + 1))

    return bind(
        F.regexp_extract(piece, REFERENCE, 1),
        lambda told: F.when(told == "", F.concat(F.lit("&"), piece))
        .when(F.startswith(told, F.lit("#")), by_number(told))
        .otherwise(by_name(told)),
    )


def _character(point: Column) -> Column:
    """The character of a number: the 128 to 159 mean those of the old Windows table, controls and
    non-characters mean nothing, and what is no code point is marked."""
    windows = "".join(bytes([code]).decode("cp1252", "ignore") or chr(code) for code in range(0x80, 0xA0))
    control = point.between(1, 8) | (point == 0xB) | point.between(0xE, 0x1F) | (point == 0x7F)
    unused = point.between(0xFDD0, 0xFDEF) | (point % 0x10000 >= 0xFFFE)
    bad = (point == 0) | point.between(0xD800, 0xDFFF) | (point > LAST_POINT)
    own = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    return (
        F.when(bad, NO_CHARACTER)
        .when(point.between(0x80, 0x9F), F.substr(F.lit(windows), (point - 0x7F).cast("int"), F.lit(1)))
        .when(control | unused, "")
        .otherwise(own)
    )


def clean_decoded(text: Column) -> Column:
    """:func:`clean_text` for text whose entities are already decoded."""
    untagged = F.regexp_replace(F.coalesce(text, F.lit("")), TAG, " ")
    return F.trim(collapse_spaces(untagged))


def clean_text(text: Column) -> Column:
    """Entities decoded, then tags dropped, white space collapsed to single spaces."""
    return clean_decoded(decode_entities(text))


def clean_summary_text(text: Column) -> Column:
    """As :func:`clean_text`, but line breaks and single blank lines stay."""
    cleaned = F.coalesce(decode_entities(text), F.lit(""))
    for pattern, replacement in (
        (TAG, " "),
        (r"\r\n?", "\n"),
        (r"[ \t]+", " "),
        (r"\n{3,}", "\n\n"),
        (r"\n[ \t]+", "\n"),
    ):
        cleaned = F.regexp_replace(cleaned, pattern, replacement)
    return strip(cleaned)


def sentences(text: Column) -> Column:
    """Array of sentences, cut at white space after ``.``, ``!`` or ``?``."""
    pieces = F.transform(F.split(text, SENTENCE_GAP), strip)
    return F.filter(pieces, lambda piece: piece != "")


def fallback_summary(text: Column) -> Column:
    """The first three sentences on three lines, padded when there are fewer."""
    lines = fixed.SUMMARY_LINES
    body = strip(F.coalesce(text, F.lit("")))
    # Stripped text has no blank pieces, so splitting can stop after the lines needed.
    first = F.slice(F.split(body, SENTENCE_GAP, lines + 1), 1, lines)
    padded = F.slice(F.concat(first, F.array_repeat(F.lit(fixed.PAD_LINE), lines)), 1, lines)
    return F.when(body == "", fixed.NO_SUMMARY).otherwise(F.array_join(padded, "\n"))


def details(title: Column, description: Column) -> Column:
    """The description, or the title where there is none."""
    return F.coalesce(F.nullif(description, F.lit("")), title, F.lit(""))


def summary_or_fallback(summary: Column, title: Column, description: Column) -> Column:
    return or_else(strip(summary), fallback_summary(details(title, description)))


def premise(title: Column, description: Column) -> Column:
    """Text that is scored against the labels."""
    return strip(F.concat(title, F.lit(". "), F.coalesce(description, F.lit(""))))


def word_pieces(text: Column) -> Column:
    """Lower-case words of a text; the first or last piece may be empty."""
    return F.split(F.lower(text), WORD_GAP)


def tokens(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.array_remove(word_pieces(text), "")


def label_name(label: Column) -> Column:
    """Display form of a label: ``_`` and ``-`` to spaces, title case, never blank."""
    spaced = strip(F.regexp_replace(F.coalesce(label, F.lit("")), "[_-]+", " "))
    return or_else(F.initcap(spaced), fixed.UNKNOWN)


def hypothesis_text(template: Column, label: Column) -> Column:
    return F.replace(template, F.lit("{}"), label)


# Letters that match i when case is ignored; Arrow's pattern engine folds all others itself.
LIKE_I = "iI\u0130\u0131"


def keyword_pattern(words: list[str]) -> str:
    """Pattern that, with case ignored, finds any of the words."""
    return "|".join(
        "".join(f"[{LIKE_I}]" if char in LIKE_I else re.escape(char) for char in word)
        for word in words
    )


def _matcher(words: list[str]) -> Callable[[Column], Column]:
    """Arrow function that finds any of the words with one linear-time pattern."""
    pattern = keyword_pattern(words)

    def match(values: pa.Array) -> pa.Array:
        return pc.match_substring_regex(values, pattern, ignore_case=True)

    return F.arrow_udf(match, BooleanType())


def contains_any(text: Column, words: list[str], whole_words: bool = False) -> Column:
    """True where any of the words occurs, ignoring case; NULL text and an empty list give false.

    Lists of any length are read by Arrow's pattern engine, which reads the text once; a Java
    pattern, which tries every word at every character, took 35 times as long with 69 words. Whole
    words need Unicode word boundaries, which only Java's engine has.
    """
    if not words:
        return F.lit(False)
    if whole_words:
        pattern = "|".join(r"\Q" + word + r"\E" for word in words)
        found = text.rlike(rf"(?iu)\b(?:{pattern})\b")
    else:
        found = _matcher(words)(text)
    return F.coalesce(found, F.lit(False))


def card_heading(title: Column, link: Column) -> Column:
    return F.format_string(fixed.CARD_HEADING, title, link)


def card_caption(source: Column, published: Column, confidence: Column) -> Column:
    when = F.coalesce(published, F.lit(fixed.NO_DATE))
    return F.format_string(fixed.CARD_CAPTION, source, when, confidence)


def subject_line(subject: str, as_of: Column) -> Column:
    return F.concat(
        F.lit(f"Subject: {subject} ("), F.date_format(as_of, fixed.DIGEST_DATE), F.lit(")")
    )


def indented(summary: Column) -> Column:
    """Every line of a summary moved in by three spaces, one line per line break."""
    lines = F.split(summary, fixed.LINE_BREAK)
    moved = F.transform(lines, lambda line: F.concat(F.lit(fixed.LINE_INDENT), line))
    return F.array_join(moved, "\n")


def digest_block(title: Column, category: Column, source: Column, summary: Column) -> Column:
    """Lines of one article in a digest, without its number and closing blank line."""
    head = F.concat(title, F.lit(" ("), category, F.lit(", "), source, F.lit(")"))
    return F.concat(head, F.lit("\n"), indented(summary))
