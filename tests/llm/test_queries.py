import duckdb
import pytest

from chromaloom.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
COLUMNS = {
    "op1_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_quality": "doc_id held_out score predicted",
    "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op7_topk": "query_id rank vec_id score",
    "op8_simhash": "doc_id fingerprint component_id",
    "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_bpe_transducer": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_importance": "doc_id n_features weight score rank",
    "op12_toxicity": "doc_id held_out score predicted",
    "op13_lexical": "item_id rank doc_id score",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_give_their_columns_and_equal_duckdb(spark, name):
    frame = queries.QUERIES[name](spark, DATA)
    assert frame.columns == COLUMNS[name].split()
    rows = [tuple(r) for r in frame.collect()]
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    if name in queries.ORACLE:
        got = con.execute(f"select {', '.join(frame.columns)} from ({queries.ORACLE[name]}) x").fetchall()
        assert sorted(rows, key=repr) == sorted(got, key=repr)
    elif name != "op7_topk":
        ids = [r[0] for r in con.execute("select doc_id from documents").fetchall()]
        assert sorted(r[0] for r in rows) == sorted(ids)


def test_every_query_is_listed():
    assert set(queries.QUERIES) == set(COLUMNS)
