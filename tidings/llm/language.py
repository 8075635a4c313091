"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, at every place of a new text, the
longest phrase that the labelled text holds. A text is cut greedily into such phrases; the fewer
it needs, the nearer it is to the language (Ziv and Merhav's cross parsing).
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import held_out, letters, with_text_columns

# Labelled text per language: the windows of one row in each of these buckets of hashed rows.
BUCKETS = 64
WINDOW = 400
# Texts are parsed in pieces of so many letters and spaces, many side by side.
PIECE = 256
UNKNOWN = "und"
SPACE = 1


def labelled_windows(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    buckets: int = BUCKETS,
    window: int = WINDOW,
) -> dict[str, str]:
    """A bounded sample of labelled text: for each language and each of ``buckets`` hash buckets
    one row's ``window`` characters, from a place that its hash gives; at most
    ``buckets * window`` characters a language. Rows of the held-out fold are left out.
    """
    order = F.xxhash64(F.lit(7), F.col(text_col))
    room = F.greatest(F.char_length(text_col) - window, F.lit(0))
    cut = F.substr(F.col(text_col), (F.pmod(order, room + 1) + 1).cast("int"), F.lit(window))
    rows = (
        docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}"))
        .select(F.col(lang_col).alias("lang"), order.alias("order"), cut.alias("piece"))
        .groupBy("lang", F.pmod("order", F.lit(buckets)).alias("bucket"))
        .agg(F.min(F.struct("order", "piece")).alias("least"))
        .select("lang", "bucket", "least.piece")
        .orderBy("lang", "bucket")
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for row in rows:
        samples.setdefault(row.lang, []).append(row.piece)
    return {lang: "\n".join(pieces) for lang, pieces in samples.items()}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that reads exactly the substrings of ``codes``; 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        state = last
        while state != -1 and code not in steps[state]:
            steps[state][code] = new
            state = link[state]
        if state != -1:
            target = steps[state][code]
            if length[state] + 1 == length[target]:
                link[new] = target
            else:
                twin = len(steps)
                steps.append(dict(steps[target]))
                length.append(length[state] + 1)
                link.append(link[target])
                while state != -1 and steps[state].get(code) == target:
                    steps[state][code] = twin
                    state = link[state]
                link[target] = link[new] = twin
        last = new
    return steps


@cache
def _machine(samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, int, list[np.ndarray], list]:
    """Codes of letters, their number, and for each language the parsing table and its bits.

    A table holds for state and letter the next state, and a mark where a new phrase begins there:
    the letter does not continue the phrase, so the parse goes on from the start with that letter.
    """
    texts = [_squeezed(letters([text])[0]) for _, text in samples]
    known = np.unique(np.concatenate(texts))
    known = known[known > SPACE]
    code = np.full(1 << 16, len(known) + 2, np.uint8 if len(known) < 250 else np.uint16)
    code[0], code[SPACE] = 0, 1
    code[known] = np.arange(2, len(known) + 2)
    width = len(known) + 3
    tables, bits = [], []
    for text in texts:
        steps = suffix_automaton(code[text].tolist())
        start = np.full(width, 1, np.int32)
        for letter, state in steps[0].items():
            start[letter] = (state * width << 1) | 1
        start[0] = 0
        out = np.tile(start, (len(steps), 1))
        for state, row in enumerate(steps):
            for letter, target in row.items():
                out[state, letter] = target * width << 1
        # The first letter of a text begins a phrase as well.
        out[0, 1:] |= 1
        out[:, 0] = 0
        tables.append(out.ravel())
        bits.append(np.log2(max(2, len(text))))
    return code, width, tables, bits


def _squeezed(folded: np.ndarray) -> np.ndarray:
    """Runs of what is no letter become one space."""
    keep = folded != 0
    keep[1:] |= folded[:-1] != 0
    return np.where(folded == 0, np.uint16(SPACE), folded)[keep]


def _phrases(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases in each row of ``codes`` (one row per piece), read letter by letter side by side."""
    state = np.zeros(len(codes), np.int32)
    count = np.zeros(len(codes), np.int32)
    for column in np.ascontiguousarray(codes.T):
        found = table[(state >> 1) + column]
        count += found & 1
        state = found
    return count


def parsing_costs(texts: list[str], samples: tuple[tuple[str, str], ...]):
    """Bits per letter of each text (rows) for each language (columns), and the letters."""
    code, _, tables, bits = _machine(samples)
    folded, starts = letters(texts)
    keep = folded != 0
    keep[1:] |= folded[:-1] != 0
    # What is no letter counts between letters and at the end of a text; separators do not.
    keep[starts[1:-1] - 1] = False
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(folded)][keep]
    coded = code[np.where(folded == 0, SPACE, folded)[keep]]
    sizes = np.bincount(doc, minlength=len(texts))
    firsts = np.cumsum(sizes) - sizes
    # Pieces are rows of a matrix that ends with 0, for which no phrase is counted.
    pieces = -(-sizes // PIECE)
    rows = np.repeat(np.cumsum(pieces) - pieces, sizes)
    within = np.arange(len(coded)) - np.repeat(firsts, sizes)
    matrix = np.zeros((int(pieces.sum()), PIECE), code.dtype)
    matrix[rows + within // PIECE, within % PIECE] = coded
    owner = np.repeat(np.arange(len(texts)), pieces)
    order = np.zeros((len(texts), len(tables)))
    for place, (one, bit) in enumerate(zip(tables, bits, strict=True)):
        total = np.bincount(owner, _phrases(matrix, one), minlength=len(texts))
        order[:, place] = total * bit / np.maximum(sizes, 1)
    found = np.bincount(doc, coded > 1, minlength=len(texts))
    return order, found


def identify(
    docs: DataFrame, samples: dict[str, str], text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to the columns ``keep`` (all but the text if none are named).

    Whole texts are read, whatever their length. ``score`` is 1 minus the ratio of the least cost
    to the next (1 if one language is known). A text that is null or has no letter is "und" with
    score 0, and so is every text if no language was learnt. Of equal costs the first language in
    alphabetical order wins. Columns of the same names are replaced.
    """
    learnt = tuple(sorted(samples.items()))
    names = np.array([lang for lang, _ in learnt], object)

    def predict(texts: list[str]) -> list:
        if not learnt:
            return [[UNKNOWN] * len(texts), np.zeros(len(texts))]
        costs, found = parsing_costs(texts, learnt)
        least = np.sort(costs, axis=1)[:, :2]
        sure = 1 - least[:, 0] / np.maximum(least[:, -1], 1e-9)
        sure = sure if len(names) > 1 else np.ones(len(texts))
        labels = np.where(found > 0, names[costs.argmin(axis=1)], UNKNOWN)
        return [labels.tolist(), np.where(found > 0, np.clip(sure, 0, 1), 0)]

    made = {"lang_pred": "string", "score": "double"}
    return with_text_columns(docs, text_col, keep, made, predict)
