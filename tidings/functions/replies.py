"""Reply columns: payload extraction, repair and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings import fixed_values as fixed
from tidings.functions.text import contains_any, or_else, strip


def json_payload(text: Column) -> Column:
    """JSON part of a reply: code fence dropped, then the widest list, else the widest object."""
    bare = strip(F.coalesce(text, F.lit("")))
    opened = F.regexp_replace(bare, rf"^```[a-zA-Z0-9]*{fixed.SPACE}*", "")
    closed = F.regexp_replace(opened, rf"{fixed.SPACE}*```\z", "")
    unfenced = F.when(bare.startswith("```"), closed).otherwise(bare)
    widest_list = F.regexp_extract(unfenced, r"\[[\s\S]*\]", 0)
    widest_object = F.regexp_extract(unfenced, r"\{[\s\S]*\}", 0)
    return or_else(widest_list, or_else(widest_object, unfenced))


def without_trailing_commas(payload: Column) -> Column:
    return F.regexp_replace(payload, rf",{fixed.SPACE}*([}}\]])", "$1")


def repaired_payload(text: Column) -> Column:
    """Payload ready for a JSON parser that allows raw line breaks inside strings."""
    return without_trailing_commas(json_payload(text))


def parsed_items(text: Column) -> Column:
    """Elements of the reply's list as variants; NULL unless the payload is a list."""
    return F.from_json(
        repaired_payload(text), "array<variant>", {"allowUnquotedControlChars": "true"}
    )


def is_rate_limited(error: Column, status: Column | None = None) -> Column:
    """Whether a reply was refused for rate or quota, by its status or by its error text."""
    told = contains_any(error, fixed.RATE_LIMIT_TOKENS)
    if status is None:
        return told
    return F.coalesce(status == fixed.TOO_MANY_REQUESTS, F.lit(False)) | told


def reply_content(status: Column, body: Column) -> Column:
    """Text of a successful reply, else NULL."""
    return F.when(status < 400, F.get_json_object(body, fixed.CONTENT_PATH))
