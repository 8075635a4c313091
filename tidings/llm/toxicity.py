"""Toxicity by a learnt lexicon whose misspelled forms are found as well.

The lexicon is a trie of stems that mark toxic labelled texts. It is intersected with Levenshtein
automata of distance 1, two letters in the wrong order counted as one edit, and the product is made
deterministic once, so every word of a text is read by one table whatever the number of stems. A
misspelled stem adds a share of the stem's weight, less where clean labelled texts hold words that are
spelled like it. Hits inside quotation marks count less than
hits outside, and hits that stand close together count as a window; a logistic regression over these
sums, in which no hit outside quotation marks can lower the score, gives it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import held_out, letters, released, text_slices, with_text_columns
from tidings.session import pin

# Bounds of the labelled sample, by label.
TOXIC_ROWS = 4000
CLEAN_ROWS = 8000
# Letters of a stem, and how much likelier toxic texts must be to hold it.
SHORTEST, LONGEST = 4, 12
LEAST_RATIO = 4.0
# By how many standard deviations a stem must be more frequent in toxic texts than in others.
LEAST_EXCESS = 4.0
ROWS_AT_ONCE = 20_000
# Stems of so many letters are found misspelled too; shorter ones would be found in words of all kinds.
FUZZY_LENGTH = 5
# A misspelled stem counts this share of the stem's weight at most. Before any is seen, so many are
# expected in toxic texts for each stem spelled well.
NEAR_SHARE, NEAR_EXPECTED = 0.8, 0.02
# One of these between two letters stands for a letter.
STAND_INS = "0123456789*@$#!|"
# Words to either side of a hit that make its window.
WINDOW = 20
QUOTES = (("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’"))
FEATURES = ["plain", "stems", "window", "strongest", "density", "quoted", "size"]
# Features of hits outside quotation marks come first; their coefficients are 0 at least.
N_PLAIN = 5


@dataclass(frozen=True)
class Lexicon:
    """Stems with their log ratios, and what they add misspelled; no stem begins with another."""

    weights: tuple[tuple[str, float, float], ...]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    coefficients: tuple[float, ...]
    intercept: float


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "toxic",
    toxic_rows: int = TOXIC_ROWS,
    clean_rows: int = CLEAN_ROWS,
) -> DataFrame:
    """Distinct labelled texts outside the held-out fold, ``toxic_rows`` and ``clean_rows`` of them
    at most, chosen by a hash. A document labelled both ways counts as toxic."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("labelled"))
        .agg(F.max(label_col).alias("label"))
        .withColumn("order", F.xxhash64(F.lit(11), "labelled"))
    )
    bounds = {1: toxic_rows, 0: clean_rows}
    parts = [
        known.where(F.col("label") == label).orderBy("order", "labelled").limit(bound)
        for label, bound in bounds.items()
    ]
    # At most toxic_rows + clean_rows pairs of numbers are broadcast.
    chosen = F.broadcast(parts[0].unionAll(parts[1]).select("labelled", "label"))
    texts = docs.select(F.col(id_col).alias("labelled"), F.col(text_col).alias("text"))
    return (
        texts.where(F.col("text").isNotNull())
        .join(chosen, "labelled")
        .groupBy("text")
        .agg(F.max("label").cast("int").alias("label"))
    )


def read_letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """As ``letters``, with what stands for a letter inside a word as a letter of no alphabet."""
    folded, starts = letters(texts)
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)
    if len(points) > 2:
        inner = np.flatnonzero((folded[1:-1] == 0) & (folded[:-2] > 0) & (folded[2:] > 0)) + 1
        folded[inner[np.isin(points[inner], list(map(ord, STAND_INS)))]] = 1
    return folded, starts


def _sizes(sample: DataFrame) -> tuple[int, int]:
    """Toxic texts and others."""
    found = {row.label: row["count"] for row in sample.groupBy("label").count().collect()}
    return found.get(1, 0), found.get(0, 0)


def learn_stems(sample: DataFrame) -> list[tuple[str, float, int]]:
    """Stems that mark the toxic texts of ``sample`` (columns text, label), with their log ratios and the
    number of toxic texts with them: all beginnings of words that pass both tests and neither begin
    with a better one nor are its beginning. The sample alone bounds their number."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                folded = letters([text])[0]
                words = set("".join(map(chr, np.where(folded == 0, 32, folded))).split())
                stems = {
                    word[:size]
                    for word in words
                    for size in range(SHORTEST, min(len(word), LONGEST) + 1)
                }
                seen[label].update(stems)
        keys = list(seen[0] | seen[1])
        for place in range(0, len(keys), ROWS_AT_ONCE):
            part = keys[place : place + ROWS_AT_ONCE]
            yield pd.DataFrame(
                {
                    "stem": pd.Series(part, dtype=object),
                    "bad": [seen[1][stem] for stem in part],
                    "good": [seen[0][stem] for stem in part],
                }
            )

    bad, good = _sizes(sample)
    if not bad:
        return []
    ratio = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
    found = (
        sample.mapInPandas(count, "stem string, bad long, good long")
        .groupBy("stem")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .withColumn("ratio", ratio)
        .withColumn("chance", F.col("good") * (bad / max(1, good)))
        .where(F.col("ratio") >= float(np.log(LEAST_RATIO)))
        .where(F.col("bad") - F.col("chance") >= LEAST_EXCESS * F.sqrt(F.col("chance") + 1))
        .withColumn("worth", F.col("bad") * F.col("ratio"))
        .orderBy(F.desc("worth"), F.desc(F.char_length("stem")), "stem")
        .collect()
    )
    kept: list[tuple[str, float, int]] = []
    beginnings: set[str] = set()
    for row in found:
        own = {row.stem[:size] for size in range(SHORTEST, len(row.stem) + 1)}
        # It is the beginning of a kept stem, or a kept stem is its beginning.
        if row.stem in beginnings or any(stem in own for stem, _, _ in kept):
            continue
        kept.append((row.stem, float(row.ratio), row.bad))
        beginnings |= own
    return sorted(kept)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Stems, and what each adds where it is misspelled: how much likelier toxic texts of ``sample`` are
    to hold it so than others, a share of the stem's own weight at most and nothing at least."""
    stems = learn_stems(sample)
    automaton = Automaton([stem for stem, _, _ in stems])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, len(stems)), np.int64)
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                _, _, _, stem, wrong, _ = automaton.hits(read_letters([text])[0])
                seen[label, np.unique(stem[wrong == 1])] += 1
        yield pd.DataFrame({"stem": np.arange(len(stems)), "bad": seen[1], "good": seen[0]})

    if not stems:
        return Lexicon(())
    counted = sample.mapInPandas(count, "stem long, bad long, good long").groupBy("stem")
    near = {row.stem: row for row in counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()}
    bad, good = _sizes(sample)
    weights = []
    for place, (stem, weight, n_bad) in enumerate(stems):
        held = (near[place].bad + NEAR_EXPECTED * n_bad) / bad
        ratio = float(np.log(held / ((near[place].good + 0.5) / (good + 1))))
        weights.append((stem, weight, min(max(ratio, 0.0), NEAR_SHARE * weight)))
    return Lexicon(tuple(weights))


class Automaton:
    """The trie of stems intersected with Levenshtein automata of distance 1, as one table.

    ``step[state, class]`` is the next state, 0 where nothing can match any more. Of a state, ``begun``
    is 1 + the longest stem that the word begins with, ``near`` 1 + one of ``FUZZY_LENGTH`` letters that
    the word equals but for one edit if it ends there, and ``near_begun`` 1 + the one that it begins
    with but for one edit before the stem's last letter.
    """

    def __init__(self, stems: list[str]):
        children: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        fuzzy = [any(len(stem) >= FUZZY_LENGTH for stem in stems)]
        for place, stem in enumerate(stems):
            node = 0
            for char in stem:
                if char not in children[node]:
                    children.append({})
                    fuzzy.append(False)
                    children[node][char] = len(children) - 1
                node = children[node][char]
                fuzzy[node] |= len(stem) >= FUZZY_LENGTH
            ends[node] = place
        long = {node: place for node, place in ends.items() if len(stems[place]) >= FUZZY_LENGTH}
        alphabet = sorted({char for stem in stems for char in stem})
        self.classes = np.zeros(1 << 16, np.uint8 if len(alphabet) < 250 else np.uint16)
        for place, char in enumerate(alphabet):
            self.classes[ord(char)] = place + 1

        # A part of a state: (node, errors, letter that is still due, whether the last one was read as
        # it should be).
        def shorter(parts: set) -> set:
            """Add what the loss of a letter of the stem allows."""
            lost = {
                (child, 1, "", False)
                for node, errors, due, _ in parts
                if not errors and not due
                for child in children[node].values()
                if fuzzy[child]
            }
            return parts | lost

        def read(state: frozenset, char: str | None) -> frozenset:
            out = set()
            for node, errors, due, _ in state:
                if due:
                    if char == due:
                        out.add((node, 1, "", True))
                    continue
                if char in children[node] and (not errors or fuzzy[children[node][char]]):
                    out.add((children[node][char], errors, "", True))
                if errors:
                    continue
                if fuzzy[node]:
                    out.add((node, 1, "", False))
                for first, child in children[node].items():
                    if not fuzzy[child]:
                        continue
                    out.add((child, 1, "", False))
                    # Two letters in the wrong order: this one is the second of them.
                    if char != first and char in children[child] and fuzzy[children[child][char]]:
                        out.add((children[child][char], 1, first, False))
            return frozenset(shorter(out))

        begin = frozenset(shorter({(0, 0, "", False)}))
        numbers: dict[frozenset, int] = {frozenset(): 0, begin: 1}
        todo, rows = [begin], {0: [0] * (len(alphabet) + 1)}
        marks: dict[str, dict[int, int]] = {"begun": {}, "near": {}, "near_begun": {}}
        while todo:
            state = todo.pop()
            number = numbers[state]
            for node, errors, due, matched in sorted(state):
                if due or node not in ends:
                    continue
                kinds = ["near", "near_begun"] if errors and matched else ["near"] if errors else ["begun"]
                for kind in kinds:
                    if kind == "begun" or node in long:
                        marks[kind][number] = ends[node] + 1
            rows[number] = []
            for char in [None, *alphabet]:
                following = read(state, char)
                if following not in numbers:
                    numbers[following] = len(numbers)
                    todo.append(following)
                rows[number].append(numbers[following])
        self.step = np.array([rows[number] for number in range(len(numbers))], np.int32)
        for kind, found in marks.items():
            setattr(self, kind, _by_state(found, len(numbers)))

    def hits(self, folded: np.ndarray) -> tuple[np.ndarray, ...]:
        """(number of the word, its start, its end, stem, 1 if misspelled) of each word that begins with a
        stem, or does so but for an edit, and the starts of all words, in folded letters.

        Of several stems the longest one counts, misspelled ones only where there is none spelled well."""
        inside = np.concatenate([[False], folded != 0, [False]])
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        classes = self.classes[folded]
        good, close = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
        active, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        depth = 0
        while len(active):
            state = self.step[state, classes[starts[active] + depth]]
            depth += 1
            over = ends[active] - starts[active] == depth
            begun = self.begun[state]
            good[active[begun > 0]] = begun[begun > 0]
            near = np.where(over & (self.near[state] > 0), self.near[state], self.near_begun[state])
            close[active[near > 0]] = near[near > 0]
            on = (state > 0) & ~over
            active, state = active[on], state[on]
        word = np.flatnonzero(good | close)
        wrong = good[word] == 0
        stem = np.where(wrong, close[word], good[word]) - 1
        return word, starts[word], ends[word], stem, wrong.astype(np.int64), starts


def _by_state(values: dict[int, int], size: int) -> np.ndarray:
    out = np.zeros(size, np.int32)
    out[list(values)] = list(values.values())
    return out


def _places(pattern: str, text: str) -> np.ndarray:
    return np.array([match.start() for match in re.finditer(pattern, text)], np.int64)


def quoted(text: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which hits stand between quotation marks of their own line, however long it is. An apostrophe
    between two letters is no mark."""
    edges = np.concatenate([[-1], _places("\n", text), [len(text)]])
    line = np.searchsorted(edges, start)
    low, high = edges[line - 1], edges[line]
    marks = _places('"', text)
    before = np.searchsorted(marks, start) - np.searchsorted(marks, low)
    out = (before % 2 == 1) & (np.searchsorted(marks, end) < np.searchsorted(marks, high))
    for opening, closing in QUOTES:
        opened = np.append(-1, _places(opening, text))
        if len(opened) == 1:
            continue
        closed = _places(r"(?<!\w)’|’(?!\w)" if closing == "’" else closing, text)
        last = opened[np.searchsorted(opened[1:], start)]
        ended = np.append(-1, closed)[np.searchsorted(closed, start)]
        following = np.append(closed, len(text))[np.searchsorted(closed, end)]
        out |= (last > low) & (last > ended) & (following < high)
    return out


def features(texts: list[str], automaton: Automaton, weights: np.ndarray) -> np.ndarray:
    """The sums of each text that the score is made of, in the order of ``FEATURES``; ``weights`` has two
    for each stem, spelled well and misspelled. A hit without weight is none."""
    folded, firsts = read_letters(texts)
    word, start, end, stem, kind, starts = automaton.hits(folded)
    worth = weights[stem, kind] if len(word) else np.zeros(0)
    word, start, end, stem, worth = (one[worth > 0] for one in (word, start, end, stem, worth))
    words = np.searchsorted(starts, firsts[1:]) - np.searchsorted(starts, firsts[:-1])
    out = np.zeros((len(texts), len(FEATURES)))
    out[:, -1] = np.log1p(words)
    owner = np.searchsorted(firsts, start, "right") - 1
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for hits in np.split(np.arange(len(word)), cuts) if len(word) else ():
        doc = int(owner[hits[0]])
        weight = worth[hits]
        marked = quoted(texts[doc], start[hits] - firsts[doc], end[hits] - firsts[doc])
        plain = np.where(marked, 0.0, weight)
        total = np.concatenate([[0.0], np.cumsum(plain)])
        low = np.searchsorted(word[hits], word[hits] - WINDOW)
        high = np.searchsorted(word[hits], word[hits] + WINDOW, "right")
        out[doc, :-1] = np.log1p(
            [
                plain.sum(),
                len(set(stem[hits][~marked].tolist())),
                (total[high] - total[low]).max(),
                plain.max(),
                100 * plain.sum() / max(1, words[doc]),
                weight[marked].sum(),
            ]
        )
    return out


def _machine(lexicon: Lexicon) -> tuple[Automaton, np.ndarray]:
    weights = np.array([both for _, *both in lexicon.weights] or [[0.0, 0.0]])
    return Automaton([stem for stem, *_ in lexicon.weights]), weights


def learn(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "toxic",
) -> Model:
    """Learn stems and score from labelled documents outside the held-out fold (a bounded sample)."""
    sample = pin(labelled_sample(docs, labels, text_col, id_col, label_col), "toxic-sample")
    lexicon = learn_lexicon(sample)
    machine = _machine(lexicon)
    sums = with_text_columns(
        sample, "text", ["label"], dict.fromkeys(FEATURES, "double"),
        lambda texts: list(features(texts, *machine).T),
    )
    rows = pin(sums, "toxic-features")
    classes = {row.label: row["count"] for row in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        # Without both labels nothing can be told apart: no text is called toxic.
        return Model(lexicon, (0.0,) * len(FEATURES), -4.0)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows)
    # A bound that is not finite is none where a feature is the same in all rows.
    floor = [0.0] * N_PLAIN + [-1e6] * (len(FEATURES) - N_PLAIN)
    fitted = LogisticRegression(
        featuresCol="vector", labelCol="label", maxIter=50, regParam=0.001,
        lowerBoundsOnCoefficients=DenseMatrix(1, len(FEATURES), floor),
    ).fit(vectors)
    return Model(lexicon, tuple(map(float, fitted.coefficients)), float(fitted.intercept))


def score(
    docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from 0.5 on) to the
    columns ``keep`` (all but the text if none are named).

    Whole texts are read. Null and empty texts get the score of a text without hits. Columns of the
    same names are replaced.
    """
    machine = _machine(model.lexicon)

    def judge(texts: list[str]) -> list:
        given = _chances(features(texts, *machine), model)
        return [given, (given >= 0.5).astype(np.int32)]

    return with_text_columns(docs, text_col, keep, {"score": "double", "predicted": "int"}, judge)


def filter_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model calls toxic; all columns stay as they are."""
    machine, place = _machine(model.lexicon), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, texts in text_slices(batch.column(place)):
                clean = _chances(features(texts, *machine), model) < 0.5
                yield batch.slice(start, stop - start).filter(pa.array(clean))

    return docs.mapInArrow(released(run), docs.schema)


def _chances(sums: np.ndarray, model: Model) -> np.ndarray:
    total = sums @ np.array(model.coefficients) + model.intercept
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))
