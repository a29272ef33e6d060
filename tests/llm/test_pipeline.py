"""Registered queries against plain versions on the small tables, and the pipeline stage by stage."""

from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import compare, oracle
from conftest import SF_DIR
from test_near import kept_ids

from httploom.llm import queries

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def rows_of(spark, name, *columns):
    return Counter(tuple(r) for r in queries.QUERIES[name](spark, SF_DIR).select(*columns).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    assert compare(spark, oracle(SF_DIR), name, queries.QUERIES[name], queries.ORACLE[name], SF_DIR) == ""


@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_line_dedup_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    stripped = Counter((k, w, r, d, len(t), brute.sha(t)) for k, t, w, d, r in brute.line_dedup(docs))
    columns = ["doc_id", "n_lines", "n_recurring", "n_dropped", "kept_chars", "kept_sha256"]
    assert Counter(tuple(r) for r in queries.op4_line_dedup(spark, sf_dir).select(*columns).collect()) == stripped


def test_registered_queries(spark, rows):
    docs = rows("documents", "doc_id", "text")
    counts = brute.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert rows_of(spark, "op1_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter((*r, r[2] > 4096) for r in counts)
    urls = brute.url_verdicts(rows("pages", "page_id", "url"), queries.URL_RULES)
    assert rows_of(spark, "op2_url_filter", "page_id", "host", "path", "rule", "verdict") == Counter(urls)
    ids = brute.bpe_ids([t for _, t in docs], RANKS, PATTERN)
    wanted = Counter((k, len(i), brute.sha(np.array(i, "<u4").tobytes()), brute.sha(t)) for (k, t), i in zip(docs, ids))
    assert rows_of(spark, "op3_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == wanted
    found = brute.contamination(docs, rows("benchmark", "item_id", "text"))
    wanted = Counter((k, w, h, len(i), brute.sha(",".join(i)), h > 0) for k, w, h, i in found)
    assert rows_of(spark, "op5_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == wanted
    pages = Counter(brute.warc_rows(rows("pages", "page_id", "html")))
    assert rows_of(spark, "op6_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == pages
    assert rows_of(spark, "op7_suffix_array_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.repeats(docs))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(spark, "op8_quality_rules", *columns) == Counter(brute.measures(docs))
    turns = rows("conversations", "conv_id", "turn", "role", "text") + [(-1, i, r, queries.CONTROL_TEXT) for i, r in enumerate(("user", "assistant"))]
    assert rows_of(spark, "op9_chat_format", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == Counter(brute.conversations(turns))
    assert rows_of(spark, "op10_simhash", "doc_id", "fingerprint", "component_id") == Counter(brute.near_duplicates(docs))


def test_pipeline_stages(spark, tmp_path):
    """Each stage keeps the columns, and keeps exactly the rows that the plain version of its operator keeps."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(path := f"{tmp_path}/{number}")
        docs = spark.read.parquet(path)
        if number == 4:
            break
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality rules":
            failed = {r[0] for r in brute.measures(kept) if r[-1]}
            assert set(after) <= set(kept) and not failed & {k for k, _ in after} and len(after) > 0.7 * len(kept)
        elif name == "line dedup":
            assert Counter(after) == Counter(r[:2] for r in brute.line_dedup(kept))
            assert docs.where("n_chars <> length(text)").count() == 0
        elif name == "near-duplicates":
            assert sorted(k for k, _ in after) == kept_ids(kept)
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
            assert sorted(k for k, _ in after) == sorted(r[0] for r in brute.contamination(kept, items) if not r[2])
        kept = after
    ids = {k: i for (k, _), i in zip(kept, brute.bpe_ids([t for _, t in kept], RANKS, PATTERN))}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in docs.collect()} == ids


def test_run_gives_the_last_stage(spark):
    result = corpus_pipeline.run(spark, SF_DIR)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and 0 < result.count() < 200
