"""The registered queries on the smallest tables: columns, folds, and the result of SQL where there is one."""

import os
import zlib

import pytest

from siltstone.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_mix_sources": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op6_embeddings": ["vec_id", "n_links", "component_id", "kept"],
    "op7_repeats": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8_url_rules": ["page_id", "host", "path", "rule", "verdict"],
    "op9_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op12_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}
FOLDS = {"op2_language": 4, "op9_lm_score": 7, "op10_toxicity": 4}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, name):
    got = Q.queries()[name](spark, SF)
    rows = got.collect()
    assert set(COLUMNS.get(name, [])) <= set(got.columns)
    if name in COLUMNS:
        source = {"op6_embeddings": "embeddings", "op8_url_rules": "pages"}.get(name, "documents")
        assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name in FOLDS:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % FOLDS[name] == 2) for r in rows)
    if name not in Q.oracle_sql():
        return
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = db.sql(Q.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
