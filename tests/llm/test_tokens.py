"""Token ids, packing and token files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tokenizers import Tokenizer

from tidings.llm import packing, token_files
from tidings.llm.encode import Encoder
from tidings.session import scratch_path

WORD, BYTE = (public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string"


def as_bytes(texts):
    coded = [text.encode() for text in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_give_the_tokenizer_s_ids(path):
    random_ = random.Random(1)
    signs = list("ab é'ÉßſİΣ.,\n\n  1_%&×日…\t\r  ́\x1c")
    texts = ["", " ", "\n", "we'll go", "a.\nB", "x  y", "<|endoftext|> a", "don't,'s 'S"]
    texts += ["".join(random_.choices(signs, k=random_.randrange(30))) for _ in range(1500)]
    texts += [f"{random_.choice(signs)}<|endoftext|>{random_.choice(signs)}<|startoftext|><|endof" for _ in range(50)]
    texts += ["<|endoftext|>", "text|>", "<|endoftext|><|endoftext|>", "<|end", "oftext|>", "x<|startoftext|>"]
    random_.shuffle(texts)
    encoder = Encoder(path)
    ids, counts = encoder.encode(*as_bytes(texts))
    ends = np.cumsum(counts)
    whole = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for text, end, size, one in zip(texts, ends, counts, whole, strict=True):
        assert ids[end - size : end].tolist() == one.ids, repr(text)


def plain_first_fit(sizes, capacity):
    bins, out = [], {}
    for item in sorted(range(len(sizes)), key=lambda item: -sizes[item]):
        for place, used in enumerate(bins):
            if used + sizes[item] <= capacity:
                break
        else:
            place, used = len(bins), 0
            bins.append(0)
        out[item] = (place, used)
        bins[place] = used + sizes[item]
    return [out[item] for item in range(len(sizes))]


def test_tournament_equals_plain_first_fit():
    random_ = random.Random(7)
    for count in (0, 1, 2, 3, 50, 200):
        sizes = [random_.randrange(1, 65) for _ in range(count)]
        assert packing.first_fit_decreasing(sizes, 64) == plain_first_fit(sizes, 64)


@pytest.mark.parametrize("sizes", [[1], [64], [63, 63, 63], [200, 5, 5, 5, 30, 40, 64, 1], [3] * 50])
def test_pieces_cover_everything_once(sizes):
    pieces = packing.plan_pieces(sizes, 64, 2)
    for item, size in enumerate(sizes):
        at = 0
        for _, start, length, _, _ in sorted(piece for piece in pieces if piece[0] == item):
            assert start == at and length > 0
            at += length
        assert at == size
    filled = {}
    for _, _, length, sequence, offset in sorted(pieces, key=lambda piece: piece[3:]):
        assert offset == filled.get(sequence, 0)
        filled[sequence] = offset + length
    assert all(n <= 64 and (n >= 62 or n & (n - 1) == 0) for n in filled.values())


def rows_with_oddities():
    texts = ["The cat's mat. ", None, "", "x", "word " * 5000, "same", "same", "é\nü"] * 3
    rows = [(100 - place, text) for place, text in enumerate(texts)]
    return [*rows, (None, "nobody"), (50, "twin"), (50, "twin")]


def test_packing(spark):
    rows = rows_with_oddities()
    docs = spark.createDataFrame([(*row, 1) for row in rows], SCHEMA + ", start long")
    found = packing.pack(docs, WORD, 2, group=5).collect()
    tokenizer = Encoder(WORD).tokenizer
    total = sum(len(tokenizer.encode(text or "").ids) + 1 for _, text in rows)
    assert sum(row.length for row in found) == total
    by_id = {key: text for key, text in rows if key not in (None, 50)}
    for row in found:
        if row.doc_id in by_id:
            ids = np.array(tokenizer.encode(by_id[row.doc_id] or "").ids + [2], "<u4")
            piece = ids[row.start : row.start + row.length]
            assert zlib.crc32(piece.tobytes()) == row.ids_crc32 and row.doc_tokens == len(ids)
    filled = {}
    for row in sorted(found, key=lambda row: (row.sequence_id, row.offset)):
        assert row.offset == filled.get(row.sequence_id, 0)
        filled[row.sequence_id] = row.offset + row.length
    assert packing.pack(docs.limit(0), WORD, 2).count() == 0
    # The same rows again give the same sequences.
    assert sorted(map(repr, packing.pack(docs, WORD, 2, group=5).collect())) == sorted(map(repr, found))


def test_groups_of_long_texts(spark):
    """Groups are bounded by bytes too, and a group of many batches is encoded batch by batch."""
    rows = [(place, f"w{place} " * 400) for place in range(300)] + [(1000, "long " * 50_000), (1001, "a<|endoftext|>b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = packing.pack(docs, WORD, 2, group_bytes=20_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({row.sequence_id >> packing.GROUP_BITS for row in found}) > 20
    tokenizer, lengths = Tokenizer.from_file(WORD), {}
    for row in found:
        lengths[row.doc_id] = lengths.get(row.doc_id, 0) + row.length
    assert lengths == {key: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1 for key, text in rows}


def test_token_files(spark):
    rows = rows_with_oddities()
    docs = spark.createDataFrame([(*row, 1) for row in rows], SCHEMA + ", part long")
    path = scratch_path(spark, "token-test")
    token_files.write_token_files(docs, path, BYTE, 0)
    found = sorted(token_files.token_spans(spark, path).collect(), key=lambda row: row.start)
    keys = [row.doc_id for row in found]
    assert keys == [None, *sorted(key for key, _ in rows if key is not None)]
    tokenizer, texts, at = Encoder(BYTE).tokenizer, dict(rows), 0
    for row in found:
        ids = np.array(tokenizer.encode(texts[row.doc_id] or "").ids + [0], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    one = token_files.read_token_files(spark, path).where("doc_id = 50")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,50)]" in one._jdf.queryExecution().toString()
    assert one.count() == 2
    empty = scratch_path(spark, "token-test")
    token_files.write_token_files(docs.limit(0), empty, BYTE, 0)
    assert token_files.token_spans(spark, empty).count() == 0
