"""Token ids in ORC files.

Documents lie in ascending order of their identifiers, over range partitions that are one file
each. ORC keeps whole numbers run-length encoded, with least and greatest values for every stripe
and row group and a Bloom filter on the identifiers, so a reader takes stripes in parallel and
skips those that cannot hold what it looks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import byte_slices, lists
from tidings.llm.encode import encoder, with_end

STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX = 1000
FALSE_POSITIVES = 0.01
COLUMNS = "part int, first long, n_tokens long, ids array<int>"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    text_col: str = "text",
    id_col: str = "doc_id",
    stripe_bytes: int = STRIPE_BYTES,
    rows_per_index: int = ROWS_PER_INDEX,
) -> None:
    """Write doc_id, part, first (ids of the documents before it in its part), n_tokens and ids.

    ``tokenizer`` is a tokenizers file at the same path on every executor; ``end_id`` follows each
    text. Null and empty texts are the end id alone. Null doc_ids come first; rows of one doc_id
    stay apart, in any order, and may lie in several parts.
    """
    # The place in the scan splits a doc_id that very many rows share.
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, first = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, stop, data, offsets in byte_slices(batch.column(1)):
                ids, sizes = with_end(*tokens.encode(data, offsets), end_id)
                before = first + np.cumsum(sizes) - sizes
                first += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array(np.full(stop - start, part, np.int32)),
                        pa.array(before),
                        pa.array(sizes),
                        lists(ids.view(np.int32), sizes, pa.int32()),
                    ],
                    ["doc_id", "part", "first", "n_tokens", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    encoded = ordered.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")
    (
        encoded.write.option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", str(rows_per_index))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(FALSE_POSITIVES))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The written rows; filters on doc_id reach stripes and row groups."""
    return spark.read.schema(f"doc_id {id_type}, {COLUMNS}").orc(path)


def token_spans(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as
    little-endian 32-bit numbers), all from the files' own ids."""
    rows = read_token_files(spark, path, id_type)
    # One row per file: small however many documents there are.
    totals = rows.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = totals.select(F.col("part").alias("of"), F.coalesce(before, F.lit(0)).alias("shift"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            edges = column.offsets.to_numpy().tolist()
            values = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<i4")
            data = memoryview(values).cast("B")
            spans = list(zip(edges, edges[1:], strict=False))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(place) for place in range(3)),
                    pa.array([b - a for a, b in spans], pa.int64()),
                    pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                ],
                ["doc_id", "part", "first", "n_tokens", "ids_crc32"],
            )

    checked = rows.select("doc_id", "part", "first", "ids").mapInArrow(
        run, f"doc_id {id_type}, part int, first long, n_tokens long, ids_crc32 long"
    )
    return checked.join(shifts, F.col("part") == F.col("of")).select(
        "doc_id", (F.col("first") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32"
    )
