"""The registered queries and the pipeline on the smallest tables."""

from collections import Counter
from zlib import crc32

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidings.llm.common import table
from tidings.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
# The columns each query must give, at least.
COLUMNS = {
    "op1_language": "doc_id held_out lang_pred score",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op4_repeated_spans": "doc_id text",
    "op5_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op6_main_text": "page_id url text n_chars",
    "op7_decontamination": "doc_id item_id",
    "op8_ngram_join": "doc_id class_id n_links",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_token_files": "doc_id start n_tokens ids_crc32",
    "op11_minhash_dedup": "doc_id n_shingles component_id kept",
    "op12_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op13_conversations": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}
ONE_ROW_EACH = [f"op{n}_" for n in (1, 2, 3, 4, 5, 8, 10, 11)]


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    found = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name].split()) <= set(found.columns)
    rows = found.collect()
    if name.startswith(tuple(ONE_ROW_EACH)):
        ids = [row.doc_id for row in table(spark, FOLDER, "documents").select("doc_id").collect()]
        assert Counter(row.doc_id for row in rows) == Counter(ids)
    if "held_out" in found.columns:
        assert all(row.held_out == (crc32(str(row.doc_id).encode()) % 5 == 0) for row in rows)


def test_held_out_languages(spark):
    found = QUERIES["op1_language"](spark, "/root/testdata/sf0.01").where("held_out")
    true = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    rows = found.join(true, "doc_id").select("lang", "lang_pred").collect()
    assert sum(row.lang == row.lang_pred for row in rows) >= 0.95 * len(rows)


def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    before = {row.doc_id: row for row in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.pin(stage(spark, docs, FOLDER), "test-stage")
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append({row.doc_id: row for row in docs.collect()})
    assert len(before) > len(seen[0]) > len(seen[1]) >= len(seen[2]) == len(seen[3]) > 0
    for kept in seen[:3]:
        assert all(before[key] == row for key, row in kept.items())
    changed = [key for key, row in seen[3].items() if row.text != before[key].text]
    assert all("[SECRET]" in seen[3][key].text for key in changed)
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    sizes = {key: len(tokenizer.encode(row.text or "", add_special_tokens=False).ids) + 1 for key, row in seen[3].items()}
    total = Counter()
    for row in pieces:
        total[row.doc_id] += row.length
    assert total == sizes


def test_stages_on_empty_tables(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
