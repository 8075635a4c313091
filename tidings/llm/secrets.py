"""Secrets in text: fixed patterns, and a guess-cost model for values in credential context.

The cost of guessing a value is the least over all its segmentations into common words, dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming; a value that costs
much to guess is no placeholder and no prose.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame

from tidings.llm.common import released, with_text_columns

# Fixed values of the base patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

# Words after which a value may be a credential, beyond those of the base patterns: anywhere in a name,
# or where a part of a name begins (DB_PASS, smtpPass).
KEYWORD = re.compile(
    r"(?=[abclpst])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|"
    r"(?:(?<![^\W_])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass|access[ _-]?key|private[ _-]?key|"
    r"client[ _-]?secret|credentials?|auth(?:orization)?|bearer|login|pin))",
    re.IGNORECASE | re.ASCII,
)
NAME = re.compile(r"[\w-]*", re.ASCII)
# What may stand between the keyword, or a name that goes on after it, and the value.
ASSIGNED = r"""\x20*(?:=>|:=|[:=])\x20*(?:bearer\x20+|basic\x20+)?"""
AFTER_KEYWORD = re.compile(
    rf"""["']?(?:\x20+(?:is|was)\x20+|{ASSIGNED}|\x20+)["'`]?(?=[^\s"'`<>,;])""", re.IGNORECASE | re.ASCII
)
AFTER_NAME = re.compile(rf"""["']?{ASSIGNED}["'`]?(?=[^\s"'`<>,;])""", re.IGNORECASE | re.ASCII)
VALUE = re.compile(r"""[^\s"'`<>,;]*""", re.ASCII)
IN_URL = re.compile(r"://[^/\s:@]+:([^@\s/]+)@", re.ASCII)
CONTEXT_HINT = re.compile(r"pass|pwd|secret|token|key|cred|auth|bearer|login|pin|://", re.I | re.A)
GUESS = "guess"
# A value this costly to guess (power of ten) and this long is a secret.
LEAST_COST = 10.0
LEAST_LENGTH = 8

COMMON_WORDS = (
    "password pass word admin administrator root user guest login welcome default change changeme "
    "secret token key api test testing demo example sample dummy placeholder your here none null "
    "undefined empty required optional enter insert value string name email server client service "
    "access private public account database master system hello world love letmein monkey dragon "
    "shadow sunshine princess football baseball superman batman trustno1 iloveyou qwerty abc "
    "summer winter spring autumn january february march april may june july august september "
    "october november december monday tuesday wednesday thursday friday saturday sunday the and "
    "for with this that from have not are was you all can will one our out has new more when time"
).split()
RANKS = {word: rank + 2 for rank, word in enumerate(dict.fromkeys(COMMON_WORDS))}
LONGEST_WORD = max(map(len, RANKS))
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACES = {key: (row, column) for row, keys in enumerate(ROWS) for column, key in enumerate(keys)}
DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"
)
LEET = str.maketrans("4@310!5$7", "aaeoiisst")
# Segments other than brute force and whole runs are looked for up to this length.
SEGMENT = 64
# So often it is checked whether the cost can still stay low.
CHECK = 16
COST_OF_DATE = log10(365 * 120)
COST_OF_YEAR = log10(120)


def _character_cost(value: str) -> float:
    """Brute force: the power of ten of the alphabet that the value draws from."""
    size = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value)
    size += 26 * any(c.isupper() for c in value) + 33 * any(not c.isalnum() for c in value)
    return log10(max(10, size))


def _neighbours(a: str, b: str) -> bool:
    (row, column), (other, place) = PLACES.get(a, (9, 9)), PLACES.get(b, (-9, -9))
    return abs(row - other) <= 1 and abs(column - place) <= 1 and a != b


def _runs(low: str, width: int) -> list[int]:
    """For each place, where the run of equal blocks of ``width`` characters that begins there ends."""
    ends = [0] * len(low)
    for start in range(len(low) - 1, -1, -1):
        along = start + width < len(low) and low[start] == low[start + width]
        ends[start] = ends[start + 1] if along else start + width
    return ends


def guess_cost(value: str, enough: float = float("inf")) -> float:
    """The power of ten of the guesses that the cheapest segmentation of ``value`` needs; a cost of
    ``enough`` or more is given as ``enough``, as soon as no segmentation can be cheaper.

    A repeat is any piece of a run of equal blocks; where what is left of a run is longer than ``SEGMENT``
    characters, it is all of that, or all but the last block.
    """
    low, size = value.lower(), len(value)
    plain = low.translate(LEET)
    brute = _character_cost(value)
    best = [0.0] + [float("inf")] * size
    runs = {width: _runs(low[:size], width) for width in range(1, 5)}
    # Where runs end that are longer than SEGMENT.
    far: set[int] = set()

    def offer(end: int, cost: float) -> None:
        if cost < best[end]:
            best[end] = cost

    for start in range(size):
        if start % CHECK == 0:
            # All segments that begin earlier have been offered, and any other begins here or later.
            far = {end for end in far if end >= start}
            if min(best[start : start + SEGMENT + 4] + [best[end] for end in far]) >= enough:
                return enough
        base = best[start]
        offer(start + 1, base + brute)
        for end in range(start + 2, min(size, start + LONGEST_WORD) + 1):
            rank = RANKS.get(plain[start:end])
            if rank:
                # Capitals and substituted characters each double the guesses at least.
                changed = sum(a != b for a, b in zip(value[start:end], plain[start:end], strict=True))
                offer(end, base + log10(rank) + 0.3 * changed + 0.3)
        date = DATE.match(low[:size], start) if low[start].isdigit() else None
        if date:
            year = date.end() - start == 4
            offer(date.end(), base + (COST_OF_YEAR if year else COST_OF_DATE))
        for width, ends in runs.items():
            times = (ends[start] - start) // width
            if times < 2:
                continue
            long = times * width > SEGMENT
            for many in (times - 1, times) if long else range(2, times + 1):
                end = start + many * width
                if end - start >= 3:
                    offer(end, base + brute * width + log10(many))
                if long:
                    far.add(end)
        # Walks over the keyboard and runs of the alphabet or of digits.
        end, turns = start + 1, 0
        while end < size and end - start < SEGMENT:
            step = ord(low[end]) - ord(low[end - 1])
            if not (_neighbours(low[end - 1], low[end]) or abs(step) == 1):
                break
            if end - start >= 2 and step != ord(low[end - 1]) - ord(low[end - 2]):
                turns += 1
            end += 1
            if end - start >= 4:
                offer(end, base + log10(47 * (end - start)) + turns * 0.6)
    return min(best[size], enough)


_cached_cost = lru_cache(maxsize=1 << 14)(guess_cost)


def costs_much(value: str) -> bool:
    """Whether ``value`` takes 10 ** ``LEAST_COST`` guesses; short values are remembered."""
    return (_cached_cost if len(value) <= SEGMENT else guess_cost)(value, LEAST_COST) >= LEAST_COST


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind as listed; code points."""
    found = [
        (match.start(), 0, match.end())
        for match in ASSIGN.finditer(text)
        if match.end(2) - match.start(2) >= LEAST_ASSIGN
    ]
    if "AKIA" in text:
        found += [
            (match.start(), 1, match.end())
            for match in ACCESS.finditer(text)
            if match.end() - match.start() >= LEAST_ACCESS
        ]
    found += [(match.start(), 2, match.end()) for match in HEX.finditer(text)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def context_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands in credential context, by start. A value that is the name of a
    further context ("secret password: ...") is none. Every name and value is run over once."""
    names, values = set(), {}
    name_start = name_end = value_end = 0
    for match in KEYWORD.finditer(text):
        start, end = match.span()
        if start >= name_end:
            name_start = start
            while name_start and NAME.fullmatch(text[name_start - 1]):
                name_start -= 1
        if end > name_end:
            name_end = NAME.match(text, end).end()
        if end == name_end:
            between = AFTER_KEYWORD.match(text, end)
        elif text[end] in "_-0123456789" or (text[end - 1].islower() and text[end].isupper()):
            between = AFTER_NAME.match(text, name_end)
        else:
            continue
        if between:
            if between.end() >= value_end:
                value_end = VALUE.match(text, between.end()).end()
            names.add(name_start)
            values[between.end()] = value_end
    found = [span for span in values.items() if span[0] not in names]
    return sorted({*found, *(match.span(1) for match in IN_URL.finditer(text))})


def guessed_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of costly values in credential context that no base span touches; of values one inside
    the other the outer one."""
    if not CONTEXT_HINT.search(text):
        return []
    out, covered = [], 0
    for start, end in context_values(text):
        if start < covered:
            continue
        value = text[start:end].rstrip(".:)]}!?")
        end = start + len(value)
        if len(value) < LEAST_LENGTH or any(s < end and start < e for _, s, e in base):
            continue
        # Prose after such a word is letters only; a value mixes kinds of characters.
        if value.isalpha() and (value.islower() or value.istitle() or value.isupper()):
            continue
        if costs_much(value):
            out.append((GUESS, start, end))
            covered = end
    return out


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, each by start, then kind."""
    base = base_spans(text)
    order = (*KINDS, GUESS)
    spans = base + guessed_spans(text, base)
    return base, sorted(spans, key=lambda span: (span[1], order.index(span[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_secrets(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add n_assign, n_access, n_hex, n_guess, base_sha256 and spans to the columns ``keep`` (all
    but the text if none are named). Whole texts are read; null counts as empty. Columns of the
    same names are replaced."""
    made = {f"n_{kind}": "long" for kind in (*KINDS, GUESS)} | {
        "base_sha256": "string",
        "spans": "string",
    }

    def scan(texts: list[str]) -> list:
        rows = []
        for text in texts:
            base, spans = scan_text(text)
            counts = [sum(kind == one for one, _, _ in spans) for kind in (*KINDS, GUESS)]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((*counts, digest, joined(spans)))
        return list(zip(*rows, strict=True))

    return with_text_columns(docs, text_col, keep, made, scan)


def redact(
    docs: DataFrame, text_col: str = "text", count_col: str | None = None, mark: str = "[SECRET]"
) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (spans that touch become one mark) and, if
    ``count_col`` is named, the code points counted anew. Texts without a span stay as they are;
    null stays null."""
    names = docs.columns
    place, count = names.index(text_col), names.index(count_col) if count_col else None

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = batch.column(place).to_pylist(), {}
            for row, text in enumerate(texts):
                spans = scan_text(text)[1] if text else []
                if spans:
                    texts[row] = _blotted(text, spans, mark)
                    sizes[row] = len(texts[row])
            if sizes:
                batch = batch.set_column(place, names[place], pa.array(texts, batch.column(place).type))
                if count_col:
                    old = batch.column(count)
                    new = [sizes.get(row, value) for row, value in enumerate(old.to_pylist())]
                    batch = batch.set_column(count, names[count], pa.array(new, old.type))
            yield batch

    return docs.mapInArrow(released(hide), docs.schema)


def _blotted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    pieces, at = [], 0
    for _, start, end in spans:
        if start > at or not pieces:
            pieces += [text[at:start], mark]
        at = max(at, end)
    return "".join([*pieces, text[at:]])
