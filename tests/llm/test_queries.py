"""The registered queries on the smallest tables: their rows, columns and types; against SQL where there is some."""

import duckdb
import pytest

from quernstone.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_html_extraction": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op2_pii": ("documents", "doc_id bigint, text string"),
    "op3_ngram_jaccard_join": ("documents", "doc_id bigint, n_shingles bigint, component_id bigint"),
    "op4_sharding": ("documents", "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int"),
    "op5_benchmark_decontamination": (None, "doc_id bigint, item_id bigint"),
    "op6_url_filters": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op7_embedding_dedup": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op8_packing": (None, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"),
    "op9_secret_scans": ("documents", "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"),
    "op10_quality_classifier": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op11_embedding_whitening": (None, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"),
    "op12_chat_formatting": (None, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"),
    "op13_conversation_repair": (None, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"),
}


def test_all_are_here():
    assert set(COLUMNS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir):
    table, columns = COLUMNS[name]
    df = QUERIES[name](spark, sf_dir)
    wanted = dict(c.split() for c in columns.split(", "))
    assert list(wanted.items()) == df.dtypes[: len(wanted)]
    rows = df.collect()
    if table:
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = con.sql(ORACLE_SQL[name])
        assert found.columns == df.columns
        assert sorted(map(tuple, rows)) == sorted(found.fetchall())
