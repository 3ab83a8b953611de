"""The registered queries on a small table: schema, SQL where there is some, one row per input row."""

import pytest
from oracle import compare

from shotloom.llm import queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op2_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op5_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_pack": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op10_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op11_align": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op12_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op13_whiten": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    out = queries.queries()[name](spark, SF)
    kinds = dict(out.dtypes)
    for c in filter(None, COLUMNS.get(name, "").split(", ")):
        column, kind = c.split()
        assert kinds[column] == kind
    read = spark.read.parquet(f"{SF}/{'pages' if 'html' in name else 'embeddings' if 'whiten' in name else 'documents'}.parquet")
    key = read.columns[0]
    assert {r[0] for r in out.select(key).distinct().collect()} == {r[0] for r in read.select(key).collect()}
    if name not in ("op1_mix_sources", "op8_pack"):
        assert out.count() == read.count() * (32 if name == "op13_whiten" else 1)
    if name in queries.oracle_sql():
        compare(out, queries.oracle_sql()[name], SF)
