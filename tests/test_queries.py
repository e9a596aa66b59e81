"""Registered queries against their SQL on the smallest tables, where these are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from riskweave.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each kind; cmp runs of all are part of each round.
NAMES = [
    "fil_01_clean", "fil_08_validation", "joi_08_interval", "joi_10_mentioned", "joi_11_techniques", "joi_13_group_pairs", "agg_09_crosstab", "agg_12_describe", "agg_19_scaling", "win_04_global_rank", "win_05_average_rank",
    "fea_02_record", "fea_03_vector", "fea_09_publication", "lab_03_weak", "lab_04_forward", "sco_01_05_scores", "mod_09_contributions", "spl_02_by_share", "spl_08_group_folds", "eva_01_05_macro", "eva_07_linear_ndcg",
    "sig_01_wilcoxon", "sig_03_corrections", "ens_04_reciprocal_rank", "gra_04_diffusion", "gra_02_similar", "txt_01_04_health", "dq_01_record_issues", "qry_02_top_records", "str_02_over_budget", "fn_06_dates",
    "joi_12_two_stages", "txt_07_flag", "txt_08_term_list", "txt_09_technique_info", "spl_04_by_cutoff", "spl_10_interval", "eva_12_slices", "eva_16_long_table", "sig_04_all_pairs", "mod_03_preference_pairs",
    "gra_06_08_filled", "gra_09_vendor_edges", "dq_03_combined", "qry_01_recommendations", "qry_03_recent", "src_01_record_pages", "src_08_snapshots", "src_14_newest_file", "snk_05_scored_output", "str_01_04_ingest",
    "str_02_budget_stream", "str_05_enriched_stream", "str_06_horizon_stream", "str_07_trace_stream", "fn_07_numeric", "fn_09_arrays", "fn_10_map", "fn_11_printed_names", "fea_15_common", "fea_17_fitted_codes", "dq_04_contract", "txt_05_coverage",
    "fea_05_reports", "fea_06_reports", "txt_01_04_reports", "txt_11_reports", "fn_05_reports", "joi_11_reports", "joi_11_passages", "joi_12_reports", "txt_07_reports",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value + 0.0:.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    want = duck.execute(oracle_sql()[name])
    assert table(got.columns, got.collect()) == table([d[0] for d in want.description], want.fetchall())


def test_names_and_flagship(spark):
    assert set(oracle_sql()) <= set(queries()) and set(queries()) <= set(entry.queries())
    assert entry.entry(spark).count() == 50
