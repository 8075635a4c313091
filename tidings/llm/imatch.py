"""I-Match fingerprints with randomised lexicons.

Terms whose inverse document frequency lies in a band form the lexicon. A text's distinct lexicon
terms, sorted, are hashed once for each of several random subsets of the lexicon; two texts are as
like as the share of their subset hashes that agree. A coarse family of subsets serves short texts
and a fine one long texts, whose many terms would hardly ever agree on a large subset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import (
    STEP, WIDE, Words, bitmap, byte_slices, folded, in_bitmap, mixed, powers, slices,
)

# The band, as shares of documents that hold a term: exp(-idf).
LEAST_SHARE, MOST_SHARE = 0.002, 0.1
# Families of subsets: each subset keeps 1/2**bits of the lexicon; so many subsets are hashed.
FAMILIES = (6, 10)
SUBSETS = 64
# A family tells two texts' likeness if so many of its subsets hold a term; the last resort is 1.
ENOUGH = 16
# A text with fewer lexicon terms is known by all its terms.
FEW_TERMS = 8
BITMAP = 24


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term hash) of the distinct words of every text, sorted."""
    words = Words(folded(data) if len(data) else data, offsets)
    order = np.lexsort((words.hash, words.doc))
    doc, terms = words.doc[order], words.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (terms[1:] != terms[:-1])
    return doc[new], terms[new]


def _term_counts(docs: DataFrame, text_col: str, least: float, marked=None, bits: int = BITMAP) -> DataFrame:
    """(term, texts) per partition: the terms in a share ``least`` of its texts or, given a bitmap,
    all terms marked there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, size, held = [], [], 0, 0

        def merged():
            if not terms:
                return np.zeros(0, WIDE), np.zeros(0, np.int64)
            values, back = np.unique(np.concatenate(terms), return_inverse=True)
            return values, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            size += batch.num_rows
            for _, _, data, offsets in byte_slices(batch.column(0)):
                _, found = distinct_terms(data, offsets)
                if marked is not None:
                    found = found[in_bitmap(marked.value, found, bits)]
                values, number = np.unique(found, return_counts=True)
                terms.append(values)
                counts.append(number)
                held += len(values)
                if held > 1 << 22:
                    values, number = merged()
                    terms, counts, held = [values], [number], 0
        values, number = merged()
        if marked is None:
            often = number >= max(1.0, least * size)
            values, number = values[often], number[often]
        yield pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(number)], ["term", "texts"]
        )

    return docs.select(text_col).mapInArrow(run, "term long, texts long")


def learn_lexicon(
    docs: DataFrame,
    text_col: str = "text",
    least: float = LEAST_SHARE,
    most: float = MOST_SHARE,
    bits: int = BITMAP,
) -> np.ndarray:
    """Hashes of all terms that a share of ``least`` to ``most`` of the texts hold, sorted.

    There are at most (distinct terms per text on average) / ``least`` of them, however many texts.
    A term this frequent overall is so in one partition at least: a first pass finds those, a
    second counts them everywhere.
    """
    total = docs.count()
    frequent = _term_counts(docs, text_col, least)
    marked = docs.sparkSession.sparkContext.broadcast(bitmap(frequent, "term", bits))
    rows = (
        _term_counts(docs, text_col, least, marked, bits)
        .groupBy("term")
        .agg(F.sum("texts").alias("texts"))
        .where((F.col("texts") >= least * total) & (F.col("texts") <= max(1.0, most * total)))
        .select("term")
        .toPandas()
    )
    return np.sort(rows["term"].to_numpy(np.int64).view(WIDE))


def fingerprints(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """One row per text with the hash of each subset of each family, 0 where it has no term."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FAMILIES) * SUBSETS), np.uint32)
    doc, terms = distinct_terms(data, offsets)
    if not len(doc):
        return out
    at = np.minimum(np.searchsorted(lexicon, terms), max(0, len(lexicon) - 1))
    known = lexicon[at] == terms if len(lexicon) else np.zeros(len(terms), bool)
    few = np.bincount(doc, known, minlength=rows) < FEW_TERMS
    chosen = known | few[doc]
    doc, terms = doc[chosen], terms[chosen]
    for number, bits in enumerate(FAMILIES):
        subset = (mixed(terms + WIDE(number + 1)) >> WIDE(64 - bits)).astype(np.int64)
        kept = subset < SUBSETS
        group, own = doc[kept] * SUBSETS + subset[kept], terms[kept]
        order = np.argsort(group, kind="stable")
        group, own = group[order], own[order]
        if not len(group):
            continue
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        # Terms are sorted in each group; their places go into the hash.
        hashes = np.add.reduceat(own * powers(STEP, int(place.max()) + 1)[place], starts)
        hashes = (mixed(hashes) >> WIDE(32)).astype(np.uint32) | np.uint32(1)
        found = group[starts]
        out[found // SUBSETS, number * SUBSETS + found % SUBSETS] = hashes
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: the share of subset hashes that agree, in the finest family with enough of them;
    1 for two texts without terms."""
    result = np.full(len(a), -1.0)
    for number in reversed(range(len(FAMILIES))):
        own = slice(number * SUBSETS, (number + 1) * SUBSETS)
        filled = ((a[:, own] > 0) | (b[:, own] > 0)).sum(axis=1)
        agreed = ((a[:, own] > 0) & (a[:, own] == b[:, own])).sum(axis=1)
        good = (result < 0) & (filled >= (ENOUGH if number else 1))
        result[good] = agreed[good] / filled[good]
    return np.where(result < 0, 1.0, result)


def _as_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [text.encode("utf-8", "replace") for text in texts]
    offsets = np.cumsum([0, *map(len, coded)])
    return np.frombuffer(b"".join(coded), np.uint8), offsets


def fingerprint(
    docs: DataFrame, lexicon: np.ndarray, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``fingerprint`` (hexadecimal) to the columns ``keep`` (all but the text if none are
    named). Null counts as empty, and equal texts have equal fingerprints."""
    keep = [name for name in (keep or docs.columns) if name not in ("fingerprint", text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in byte_slices(batch.column(len(keep))):
                made = fingerprints(data, offsets, shared.value)
                columns = [batch.column(place).slice(start, stop - start) for place in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([row.tobytes().hex() for row in made])], [*keep, "fingerprint"]
                )

    schema = docs.select(*keep).schema.add("fingerprint", "string")
    return docs.select(*keep, text_col).mapInArrow(run, schema)


def with_next(docs: DataFrame, id_col: str, parts: int) -> DataFrame:
    """``docs`` sorted over partitions so that, in descending order of the numeric ``id_col`` (nulls
    last), every row is followed by the next one, and the last by the first.

    Rows are dealt to ``parts`` ranges of identifiers; the first row of a range follows the range
    before as well, marked by the column ``_extra``. Only one number per range reaches the driver.
    """
    place = F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))
    cuts = docs.select(place.alias("place")).where("place > double('-inf')")
    bounds = cuts.approxQuantile("place", [k / parts for k in range(1, parts)], 0.2 / parts)
    edges = F.array(*[F.lit(float(bound)) for bound in sorted(set(bounds))])
    block = F.size(F.filter(edges, lambda edge: edge >= place)) if bounds else F.lit(0)
    dealt = docs.withColumn("_block", block)
    key = F.struct(F.col(id_col).isNotNull(), F.col(id_col))
    firsts = [
        (row["_block"], row["first"][1])
        for row in dealt.groupBy("_block").agg(F.max(key).alias("first")).orderBy("_block").collect()
    ]
    if not firsts:
        return dealt.withColumn("_extra", F.lit(False))
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = [number for number, _ in firsts]
    extra = docs.sparkSession.createDataFrame(
        [(first, before) for (_, first), before in zip(firsts, [blocks[-1], *blocks[:-1]], strict=True)],
        f"_first {kind}, _before int",
    )
    # One row per range: the number of ranges bounds it.
    copies = dealt.join(F.broadcast(extra), F.col(id_col).eqNullSafe(F.col("_first")))
    copies = copies.withColumn("_block", F.col("_before")).drop("_first", "_before")
    both = dealt.withColumn("_extra", F.lit(False)).unionByName(copies.withColumn("_extra", F.lit(True)))
    order = ["_block", "_extra", F.col(id_col).desc_nulls_last()]
    return both.repartition(parts, "_block").sortWithinPartitions(*order)


def compare_edited(
    docs: DataFrame, lexicon: np.ndarray, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's, with their
    likeness: the edited text is the text with its last floor(n/3) of n code points replaced by the
    first as many (or all) of the next document in descending order of ``id_col``.

    Null texts count as empty. Of rows that share a doc_id any may come first.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = (column.to_pylist() for column in batch.columns)
            rows = held + list(zip(*columns, strict=True))
            sizes = np.array([len(row[1] or "") for row in rows[:-1]], np.int64)
            for start, stop in slices(sizes):
                yield _compared(rows[start : stop + 1], shared.value, batch.schema.field(0).type)
            held = rows[-1:]

    kind = docs.schema[id_col].dataType.simpleString()
    paired = with_next(given, "doc_id", parts).select("doc_id", "text", "_block", "_extra")
    return paired.mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


def _compared(rows: list[tuple], lexicon: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """The results for all rows but the last one and the extra ones."""
    texts = [row[1] or "" for row in rows]
    edited = []
    for text, following in zip(texts, texts[1:], strict=False):
        third = len(text) // 3
        edited.append(text[: len(text) - third] + following[:third])
    own = fingerprints(*_as_bytes(texts), lexicon)
    new = fingerprints(*_as_bytes(edited), lexicon)
    near_edited, near_next = likeness(own[:-1], new), likeness(own[:-1], own[1:])
    chosen = [place for place, row in enumerate(rows[:-1]) if not row[3]]
    digest = [hashlib.sha256(edited[place].encode("utf-8", "replace")).hexdigest() for place in chosen]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[place][0] for place in chosen], kind),
            pa.array([len(texts[place]) for place in chosen], pa.int64()),
            pa.array(digest, pa.string()),
            pa.array([own[place].tobytes().hex() for place in chosen], pa.string()),
            pa.array([new[place].tobytes().hex() for place in chosen], pa.string()),
            pa.array(near_edited[chosen]),
            pa.array(near_next[chosen]),
        ],
        [
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            "near_edited", "near_next",
        ],
    )
