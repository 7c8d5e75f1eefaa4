"""The registered queries: contract columns, and oracle SQL where there is one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphmill.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
COLUMNS = {
    "op1_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op2_stratified_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_token_count": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op4_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5_bpe_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_decontamination": ["doc_id", "contaminated"],
    "op8_toxicity": ["doc_id", "severity", "toxic"],
    "op9_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op10_lz_fingerprint": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_every_document(spark, name):
    out = entry.queries()[name](spark, DATA)
    assert set(COLUMNS[name]) <= set(out.columns)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, DATA).select(*columns).collect())) == sorted(result.fetchall())


def test_languages_held_out(spark):
    out = entry.queries()["op6_language_id"](spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()
