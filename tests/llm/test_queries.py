"""Each numbered query on the smallest tables: its columns, its rows, its SQL where there is one."""

import os

import pytest

import __spark_entry__ as entry
import check
from assetlake.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")

COLUMNS = {
    "op1_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op2_lm_scoring": [
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
    ],
    "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op5_license_scans": [
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
    ],
    "op6_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op7_decontamination": [
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
    ],
    "op8_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op9_topk_search": ["query_id", "rank", "vec_id", "score"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op12_fill_in_middle": [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256",
    ],
    "op13_dataset_manifest": [
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
    ],
}


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS)
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS[name]) <= set(df.columns)
    verdict, _, rows = check.compare(spark, duck, name, FOLDER)
    assert verdict == ("ok" if name in ORACLE else "rows only")
    table = {"op6_html_extraction": "pages", "op9_topk_search": None}.get(name, "documents")
    if table:
        assert rows == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
