"""Publication times as UTC timestamps (the session time zone must be UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.text import bind, or_else, strip

# Names in mail dates, and the offsets of its zones in minutes; any other zone is UTC.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
          "october", "november", "december"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
ZONES = {
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420,
    "MDT": -360, "PST": -480, "PDT": -420,
}
# Two-digit years from here on lie in the century before.
FIRST_OLD_YEAR = 69


def _names(words: list[str]) -> str:
    """Any of the words in full or by its first three letters."""
    return "|".join(f"{word[:3]}(?:{word[3:]})?" if word[3:] else word for word in words)


WEEKDAY = rf"(?:[a-z]+,\s*|(?:{_names(DAYS)})\s+)?"
MONTH, DAY, YEAR = rf"({_names(MONTHS)})", r"(\d{1,2})", r"(\d{4}|\d{2})"
CLOCK = r"(\d{1,2}:\d{1,2}(?::\d{1,2})?)"
ZONE = r"([a-z]+|[+-]\d{3,4})"
# The orders in which a mail date may name its parts, and where each part then is.
MAIL_ORDERS = [
    (rf"{WEEKDAY}{DAY}[\s-]+{MONTH}[\s-]+{YEAR}(?:\s+{CLOCK}(?:\s*{ZONE})?.*)?", "$3 $2 $1 $4 $5"),
    (rf"{WEEKDAY}{MONTH}\s+{DAY},?\s+{YEAR}(?:\s+{CLOCK}(?:\s*{ZONE})?.*)?", "$3 $1 $2 $4 $5"),
    (rf"{WEEKDAY}{MONTH}\s+{DAY}\s+{CLOCK}\s+(?:{ZONE}\s+)?{YEAR}", "$5 $1 $2 $3 $4"),
]
# Other date formats of feeds and tables, each with the shape of text it can match.
# Checking the shape first keeps parse failures, which are slow, off the common path.
ISO_SHAPE = r"^\d{4}(-|$)"
DAY_SHAPE, DAY_FORMAT = r"^\d{8}$", "yyyyMMdd"
SECOND_SHAPE, SECOND_FORMAT = r"^\d{14}$", "yyyyMMddHHmmss"
SLASH_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}"
SLASH_FORMATS = ["M/d/yyyy HH:mm[:ss]", "M/d/yyyy"]


def _parse(text: Column, shape: str, *formats: str) -> Column:
    shaped = F.when(text.rlike(shape), text)
    if not formats:
        return F.try_to_timestamp(shaped)
    return F.coalesce(*(F.try_to_timestamp(shaped, F.lit(fmt)) for fmt in formats))


def mail_time(text: Column) -> Column:
    """The time a mail-style date names, NULL where it is none.

    The parts are put into one order by a pattern and read one by one: a name of the month in full or
    short, a year of two or four digits, a time with or without seconds, and an offset or the name of
    a zone. Without a time it is midnight, without a zone UTC.
    """
    ordered = F.lower(text)
    for pattern, order in MAIL_ORDERS:
        ordered = F.regexp_replace(ordered, f"^{pattern}$", f"={order}")
    # Only what a pattern has put into order begins with "=".
    named = F.when(text.rlike("[A-Za-z]") & F.startswith(ordered, F.lit("=")), F.substring(ordered, 2, 99))
    return bind(F.split(named, " "), _mail_parts)


def _mail_parts(parts: Column) -> Column:
    def part(place: int) -> Column:
        return F.get(parts, F.lit(place))

    short = F.array(*(F.lit(month[:3]) for month in MONTHS))
    year = part(0).cast("int")
    century = F.when(year >= FIRST_OLD_YEAR, 1900).otherwise(2000)
    full_year = F.when(F.length(part(0)) == 2, year + century).otherwise(year)
    month = F.array_position(short, F.substring(part(1), 1, 3)).cast("int")
    clock = F.split(F.concat(or_else(part(3), "0:0"), F.lit(":0")), ":")
    hour, minute, second = (F.get(clock, F.lit(place)).cast("int") for place in range(3))
    local = F.try_make_timestamp(full_year, month, part(2).cast("int"), hour, minute, second)
    return F.timestamp_add("MINUTE", -_offset(F.upper(part(4))), local)


def _offset(zone: Column) -> Column:
    """Minutes ahead of UTC, from the name of a zone or digits of which the last two are minutes."""
    number = zone.try_cast("int")
    digits = F.sign(number) * (F.floor(F.abs(number) / 100) * 60 + F.abs(number) % 100)
    named = F.lit(0)
    for name, minutes in ZONES.items():
        named = F.when(zone == name, minutes).otherwise(named)
    return F.coalesce(digits.cast("int"), named)


def feed_time(text: Column) -> Column:
    """A mail-style or ISO date; no zone means UTC; NULL where it is neither."""
    bare = strip(text)
    # The default parser also reads a bare time as today's, which the ISO shape rules out.
    return F.coalesce(_parse(bare, ISO_SHAPE), mail_time(bare))


def published_time(*candidates: Column) -> Column:
    """The first candidate that is a valid date."""
    return F.coalesce(*(feed_time(candidate) for candidate in candidates))


def table_time(text: Column) -> Column:
    """A date in any format seen in tables; NULL where it is none."""
    bare = strip(text.cast("string"))
    return F.coalesce(
        feed_time(bare),
        _parse(bare, DAY_SHAPE, DAY_FORMAT),
        _parse(bare, SECOND_SHAPE, SECOND_FORMAT),
        _parse(bare, SLASH_SHAPE, *SLASH_FORMATS),
    )
