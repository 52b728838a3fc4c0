"""Queries against their SQL in DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = [
    "baf_logr", "run_islands", "interval_disjoin", "interval_overlap", "assign_points_to_intervals", "complement_intervals", "nearest_join", "running_median",
        "rho_psi_grid", "score_grid_ascat_1", "local_minima",
    "select_ascat_optimum", "centroid_optimum", "refine_bounds", "candidate_edges", "phase_switches", "phase_evidence", "pseudo_normal_counts", "haplotype_baf",
        "apply_external_haplotypes", "union_breakpoints",
    "phased_genotypes", "imbalanced_regions", "mirrored_imbalance", "refit_suggestions", "call_x_segments", "call_subclones", "one_sample_t_pvalue", "segment_standardised_error",
    "segment_ln_likelihood_ratio", "coverage_track", "write_profile_extended", "multisample_run",
]


def plain(df, columns):
    """Rows as sorted tuples of text, floats at 6 digits."""
    text = lambda v: "None" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (float, Decimal)) else str(v)
    return sorted(tuple(map(text, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    assert plain(got, columns) == plain(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
