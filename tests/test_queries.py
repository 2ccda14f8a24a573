import os

import pytest

import siltstone.plans.model_queries  # noqa: F401  registers its queries
import siltstone.plans.record_queries  # noqa: F401
from siltstone.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SOME = ["code_metrics", "normalized_dedup", "hash_split", "rank_global", "fuse_final", "line_scores_topk", "roc_pr_auc", "grouped_ranking", "method_matrix", "span_range_join", "khop_slice", "cost_summary", "topk_verdict_analysis", "parse_verdicts", "wrap_offsets", "devign_records", "bigvul_records", "graph_files", "graphml_files", "sarif_alerts", "matrix_cells", "matrix_curves", "verification_packets", "client_verdicts", "test_only_audit", "findings_report", "sarif_report", "node_hash_vectors", "tfidf_weights", "graph_encoder", "token_means"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
